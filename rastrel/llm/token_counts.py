"""Token counts by offset-mapped attribution.

A whole document is encoded once. Each token is the span of bytes that it stands for; sections are
spans too. Both lists are sorted, so their interval join is a merge: by binary search, a token's
first and last section are found, and tokens that cross a boundary are allotted by rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm._io import map_slices
from rastrel.llm.bpe import codec

#: "start": the section of the token's first byte. "most": that of most of its bytes, the first of equals.
RULES = ("start", "most")


def line_ends(text: bytes) -> np.ndarray:
    """Ends of a text's lines; a line has its newline, and the last may lack one."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text)) if text else ends


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, crossing tokens that touch it first). Both lists tile one text from 0."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if not len(token_ends):
        return np.zeros(len(section_ends), np.int64), np.zeros(len(section_ends), np.int64)
    starts = np.r_[0, token_ends[:-1]]
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    owner, crossing = first.copy(), np.flatnonzero(last > first)
    if rule == "most":
        for k in crossing:  # a few of many tokens
            cuts = np.r_[starts[k], section_ends[first[k] : last[k]], token_ends[k]]
            owner[k] = first[k] + int(np.argmax(np.diff(cuts)))
    n = len(section_ends)
    return np.bincount(owner, minlength=n), np.bincount(first[crossing], minlength=n)


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "most") -> DataFrame:
    """(id, n_tokens, n_sections, n_crossing long, section_tokens array<long>) for every row of docs.

    Sections are the text's lines with their newlines, or those whose ends (code points, ascending) are listed in
    sections_col; text after the last end is a section of its own. section_tokens adds up to n_tokens: every
    token goes to one section, by `rule` where it crosses a boundary. A boundary within a character can't be.
    Null and empty texts have no tokens; they have no sections unless listed. Very long texts are encoded whole. Ends beyond
    the text give empty sections. Repeated rows come out as often as they come in, ids don't matter; further columns are
    ignored, whatever they are named. An empty table gives an empty result."""

    def kernel(batch: pa.RecordBatch) -> dict:
        own = codec(path, pattern)
        texts = batch.column(text_col).to_pylist()
        listed = batch.column(sections_col).to_pylist() if sections_col else [None] * len(texts)
        counts, crossings, parts = [], [], []
        for text, ends, ids in zip(texts, listed, own.encode_batch(texts), strict=True):
            raw = (text or "").encode()
            stops = np.cumsum(own.sizes[ids])
            if sections_col:
                leads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                at = np.r_[leads, len(raw)][np.clip(np.array(ends or [], np.int64), 0, len(leads))]
                at = at if len(at) and at[-1] == len(raw) or not raw else np.append(at, len(raw))
            else:
                at = line_ends(raw)
            got, crossing = attribute(stops, at, rule)
            counts.append(len(stops))
            crossings.append(int(crossing.sum()))
            parts.append(got)
        ends_ = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        values = pa.array(np.concatenate(parts).astype(np.int64)) if parts else pa.array([], pa.int64())
        return {
            id_col: batch.column(id_col), "n_tokens": pa.array(counts, pa.int64()), "n_sections": pa.array(np.diff(ends_).astype(np.int64)),
            "n_crossing": pa.array(crossings, pa.int64()), "section_tokens": pa.ListArray.from_arrays(pa.array(ends_), values),
        }

    kind = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, text_col] + ([sections_col] if sections_col else [])
    return map_slices(docs.select(*columns), kernel, f"`{id_col}` {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<long>", text_col)


def count_fields(docs: DataFrame, path: str, pattern: str, fields: list[str], id_col: str = "doc_id", rule: str = "most", between: str = "\n") -> DataFrame:
    """(id, n_tokens, n_crossing long, field_tokens map<string, long>) of documents whose text is in several columns.

    The document is the fields in order with `between` after each but the last, and is encoded once as a whole. A
    separator belongs to the field before it; tokens that cross go by `rule`. Null fields are empty and have no tokens of
    their own but perhaps a separator's. Repeated rows come out as often as they come in; further columns are ignored."""
    held = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    sizes = [F.length(h) + (len(between) if k < len(held) - 1 else 0) for k, h in enumerate(held)]
    ends = F.array(*[sum(sizes[1 : k + 1], sizes[0]) for k in range(len(sizes))])
    rows = docs.select(F.col(f"`{id_col}`"), F.concat_ws(between, *held).alias("text"), ends.alias("ends"))
    found = count_tokens(rows, path, pattern, id_col, "text", "ends", rule)
    names = F.array(*[F.lit(f) for f in fields])
    return found.select(id_col, "n_tokens", "n_crossing", F.map_from_arrays(names, F.slice("section_tokens", 1, len(fields))).alias("field_tokens"))
