"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the word k-grams in each window of `length` words, the one with the
least hash (the leftmost of ties). Equal windows choose the same anchor at the same place, so
documents that share a window meet at an anchor. The windows of a document that choose one anchor
form a run; its context is all that they cover. Extension goes both ways over the run:

* occurrences of an anchor with one and the same context are covered at once by its first holder;
* where contexts differ, each context's first holder alone lays out the run's windows, which are
  matched window by window, so that a group of n copies costs n rows and never n * n pairs.

Matched windows merge into maximal repeats when their words are marked. Every decision compares
64-bit names within a 64-bit anchor.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm._io import map_slices, materialise, own_name
from rastrel.llm._words import U64, flat, mix, run_hashes, spans, word_hashes

#: Words of a repeat, and of an anchor.
LENGTH, ANCHOR = 50, 10


def anchor_runs(texts: pa.Array, length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, Any]:
    """Runs of windows that choose one anchor: row, start (word within the row), n, anchor, ctx."""
    raw, offs = flat(texts)
    starts, ends, bounds = spans(raw, offs)
    names = word_hashes(raw, starts, ends)
    none = np.zeros(0, np.int64)
    out = {"names": names, "bounds": bounds, "row": none, "start": none, "n": none, "anchor": none, "ctx": none}
    if len(names) < length:
        return out
    grams = run_hashes(names, np.arange(len(names) - anchor + 1), anchor)
    least, place, have, width = grams, np.arange(len(grams)), 1, length - anchor + 1
    while have < width:
        step = min(have, width - have)
        left = least[:-step] <= least[step:]
        least = np.where(left, least[:-step], least[step:])
        place = np.where(left, place[:-step], place[step:])
        have += step
    sizes = np.maximum(np.diff(bounds) - length + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    if not len(rows):
        return out
    first = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[rows]
    chosen = place[first]
    opens = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])])
    n = np.diff(np.r_[opens, len(rows)])
    at, where = first[opens], chosen[opens]
    ctx = mix(run_hashes(names, at, n + length - 1) + (where - at).astype(U64) * U64(0xE7037ED1A0B428DB))
    return out | {"row": rows[opens], "start": at - bounds[rows[opens]], "n": n, "anchor": grams[where].view(np.int64), "ctx": ctx.view(np.int64)}


def _marks(spans_of: pa.Array, bounds: np.ndarray, length: int, n_words: int) -> np.ndarray:
    """Which words of the batch are covered by the windows [start, start + n) listed for each row."""
    edge = np.zeros(n_words + 1, np.int64)
    lists = spans_of.combine_chunks() if isinstance(spans_of, pa.ChunkedArray) else spans_of
    flat_ = lists.flatten()
    if len(flat_):
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        base = np.repeat(bounds[:-1], sizes)
        at = base + flat_.field("start").to_numpy(zero_copy_only=False)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + flat_.field("n").to_numpy(zero_copy_only=False) + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(id, tag, start, n): windows [start, start + n) of a row whose words also start in a row of smaller id.

    tag is a 64-bit hash of the text and tells rows apart that repeat an id. Rows that are equal in both have the same
    windows, which are listed once for each of them and never for pairs of them."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))

    def seeds(batch: pa.RecordBatch) -> dict:
        got = anchor_runs(batch.column("text"), length, anchor)
        take = pa.array(got["row"])
        return {"id": batch.column("id").take(take), "tag": batch.column("tag").take(take)} | {k: pa.array(got[k].astype(np.int32) if k in ("start", "n") else got[k]) for k in ("start", "n", "anchor", "ctx")}

    runs = materialise(map_slices(rows, seeds, f"id {kind}, tag long, start int, n int, anchor long, ctx long"), "runs")
    group = runs.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    shared = materialise(group.where("first < last").select("anchor", "first", (F.col("c0") != F.col("c1")).alias("open")), "shared")
    hits = materialise(runs.join(shared, "anchor"), "hits")
    holders = materialise(hits.where("open").groupBy("anchor", "ctx").agg(F.min("id").alias("holder")), "holders")
    held = materialise(hits.where("open").join(holders, ["anchor", "ctx"]).select("id", "tag", "start", "n", "anchor", (F.col("id") > F.col("holder")).alias("whole")), "held")

    # Sets, not lists: n equal rows list a run n times.
    todo = held.where("not whole").groupBy("id", "tag").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("runs"))
    texts = rows.join(todo, ["id", "tag"])

    def windows(batch: pa.RecordBatch) -> dict:
        raw, offs = flat(batch.column("text"))
        starts, ends, bounds = spans(raw, offs)
        names = word_hashes(raw, starts, ends)
        lists = batch.column("runs")
        run = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        n = run.field("n").to_numpy(zero_copy_only=False)
        start = run.field("start").to_numpy(zero_copy_only=False)
        at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, of = np.repeat(row, n), np.repeat(np.arange(len(n)), n)
        win = run_hashes(names, bounds[row] + at, length)
        return {"id": batch.column("id").take(pa.array(row)), "tag": batch.column("tag").take(pa.array(row)), "start": pa.array(at.astype(np.int32)), "anchor": run.field("anchor").take(pa.array(of)), "win": pa.array(win.view(np.int64))}

    laid = materialise(map_slices(texts, windows, f"id {kind}, tag long, start int, anchor long, win long"), "windows")
    firsts = laid.groupBy("anchor", "win").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    firsts = materialise(firsts.select("anchor", "win", "first"), "firsts")
    single = laid.join(firsts, ["anchor", "win"]).where("id > first").select("id", "tag", "start", F.lit(1).alias("n"))
    sure = hits.where("not open and id > first").select("id", "tag", "start", "n").unionByName(held.where("whole").select("id", "tag", "start", "n"))
    return sure.unionByName(single).withColumnsRenamed({"id": id_col})


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, counts: tuple[str, str] = ("n_words", "n_removed")
) -> DataFrame:
    """docs with the repeats cut out of text_col, and two columns named by counts: words and removed words, long.

    A word is a run of non-space characters (ASCII spaces). It goes if a window of `length` words that covers
    it also starts in a row with a smaller id; windows are those of the input. A cut goes from the first word
    of a repeat to the next kept word, so all else of a text stays as it is.

    Null texts stay null with no words; texts shorter than a window stay whole, and very long ones are cut as any
    other. Rows that repeat an id are one document's versions: none removes words of another, and n equal rows cost n
    times one. A row with a null id neither loses words nor removes any. Further columns are carried along, but columns
    of docs that are named as in counts are replaced. An empty table gives an empty result."""
    found = repeats(docs, id_col, text_col, length, anchor)
    columns = [c for c in docs.columns if c not in counts]
    of, tag, spans_col, own = (own_name(n, [*docs.columns, *counts]) for n in ("_id", "_tag", "_spans", "_own"))
    per = found.groupBy(F.col(id_col).alias(of), F.col("tag").alias(tag)).agg(F.collect_set(F.struct("start", "n")).alias(spans_col))
    tagged = docs.select(*columns, F.xxhash64(F.col(text_col)).alias(own))
    joined = tagged.join(per, (F.col(id_col) == F.col(of)) & (F.col(own) == F.col(tag)), "left").drop(of, tag, own)

    def cut(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text_col)
        raw, offs = flat(texts)
        starts, ends, bounds = spans(raw, offs)
        gone = _marks(batch.column(spans_col), bounds, length, len(starts))
        n_words = np.diff(bounds)
        total = np.r_[0, np.cumsum(gone)]
        removed = total[bounds[1:]] - total[bounds[:-1]]
        if removed.any():
            out = texts.to_pylist()
            for k in np.flatnonzero(removed):
                a, b = bounds[k], bounds[k + 1]
                first, last = np.flatnonzero(~gone[a:b] & np.r_[True, gone[a : b - 1]]), np.flatnonzero(~gone[a:b] & np.r_[gone[a + 1 : b], True])
                opens, ends_ = starts[a:b][first], ends[a:b][last]
                # A kept stretch goes on to the next repeat, with the space before it.
                follow = np.r_[starts[a:b], offs[k + 1]][last + 1]
                head = offs[k] if len(first) and first[0] == 0 else None
                parts = [raw[(head if j == 0 and head is not None else o) : f].tobytes() for j, (o, f) in enumerate(zip(opens, follow, strict=True))]
                out[k] = b"".join(parts).decode() if len(ends_) else ""
            texts = pa.array(out, texts.type)
        return {c: texts if c == text_col else batch.column(c) for c in columns} | {counts[0]: pa.array(n_words), counts[1]: pa.array(removed)}

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in columns)
    return map_slices(joined, cut, f"{fields}`{counts[0]}` long, `{counts[1]}` long", text_col)
