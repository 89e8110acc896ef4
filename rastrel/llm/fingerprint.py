"""Document fingerprints by locally consistent parsing.

A text's bytes are the symbols of level 0. On each level, runs of one symbol become one; deterministic
coin tossing against the symbol before (the lowest bit that differs, and its value) is repeated until
few labels are left, and a phrase opens at every local maximum. A phrase's name is a hash of its
symbols; names are the symbols of the next level. A cut depends on a few symbols around it alone, so equal
substrings have equal phrases inside, at whatever offset. The fingerprint holds all names of
the signature levels, for texts of few phrases those of the lower levels too, and two fingerprints' likeness is the
Jaccard index of their phrases.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.llm._io import SLICE_BYTES
from rastrel.llm._words import _BYTE, U64, flat, mix, powers

#: Levels whose phrases make up a fingerprint (of about 27 and 81 bytes).
LEVELS = (3, 4)
#: Phrases of LEVELS below which the levels before join them (of about 3 and 9 bytes).
FEW = 16
_ROUNDS = 4
_LOW = np.array([0, *(((k & -k).bit_length() - 1) for k in range(1, 256))], np.uint8)


def _toss(labels: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """One round on small labels."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[heads] = ~labels[heads]
    low = _LOW[labels ^ before]
    return 2 * low + ((labels >> low) & 1)


def next_level(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and bounds (of each text's symbols) one level up; a text that has symbols keeps one at least."""
    full = np.flatnonzero(np.diff(bounds))
    if not len(names):
        return names, bounds
    heads = bounds[full]
    opens = np.empty(len(names), bool)
    opens[0] = True
    np.not_equal(names[1:], names[:-1], out=opens[1:])
    opens[heads] = True
    at = np.flatnonzero(opens)
    if len(at) < len(names):
        runs = np.diff(np.append(at, len(names)))
        names = names[at]
        long_ = runs > 1
        names[long_] = mix(names[long_] + runs[long_].astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        heads = np.searchsorted(at, heads)
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[heads] = ~names[heads]
    differ = names ^ before
    low = differ & (~differ + U64(1))
    labels = 2 * np.bitwise_count(low - U64(1)) + ((names & low) != 0)
    labels = labels.astype(np.uint8)
    for _ in range(_ROUNDS - 1):
        labels = _toss(labels, heads)
    cut = np.zeros(len(names), bool)
    cut[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:])
    cut[heads[1:] - 1] = False  # a text's last symbol never stands alone
    cut[heads] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(names)))
    place = np.arange(len(names)) - np.repeat(starts, sizes)
    value = np.add.reduceat(names * powers(int(sizes.max()))[place], starts)
    counts = np.zeros(len(bounds) - 1, np.int64)
    counts[full] = np.diff(np.append(np.searchsorted(starts, heads), len(starts)))
    return mix(value + sizes.astype(U64) * U64(0x165667B19E3779F9)), np.r_[0, np.cumsum(counts)]


def sketches(texts: pa.Array, levels: tuple[int, ...] = LEVELS, kept: int | None = None) -> list[np.ndarray]:
    """For each whole text the 32-bit names of its signature phrases, ascending, or the `kept` least; an empty text has none.

    The lowest bit is set in names of levels before the signature's, which only texts of under FEW phrases have."""
    raw, bounds = flat(texts)
    names = _BYTE[raw]
    found, lower = [], []
    for level in range(1, max(levels) + 1):
        names, bounds = next_level(names, bounds)
        short = (names >> U64(32)).astype(np.uint32) & ~np.uint32(1)
        if level in levels:
            found.append((short, bounds))
        elif level < min(levels):
            lower.append((short | np.uint32(1), bounds))
    few = sum(np.diff(b) for _, b in found) < FEW
    return [np.unique(np.concatenate([n[b[k] : b[k + 1]] for n, b in (found + lower if few[k] else found)]))[:kept] for k in range(len(texts))]


def likeness(a: np.ndarray, b: np.ndarray, kept: int | None = None) -> float:
    """Jaccard index of two sketches (an estimate with `kept`); 1 for equal ones, two empty ones too.

    If only one has lower levels, they are left out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if (a & 1).any() != (b & 1).any():
        a, b = a[a & 1 == 0], b[b & 1 == 0]
    least = np.union1d(a, b)[:kept]
    return float(np.intersect1d(np.intersect1d(a, b, True), least, True).size / len(least))


def text_of(sketch: np.ndarray) -> str:
    """A fingerprint as lowercase hex, eight digits a name."""
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row's whole text; null and empty texts have an empty fingerprint."""
    from rastrel.llm._io import map_slices

    def kernel(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(id_col), "fingerprint": pa.array([text_of(s) for s in sketches(batch.column(text_col))], pa.string())}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(id_col, text_col), kernel, f"`{id_col}` {kind}, fingerprint string", text_col)


_PLACE = "struct<a:int,b:bigint,c:bigint>"


def _place(id_: Column, hot: list[int], text: Column) -> Column:
    """What rows are dealt by, in descending order: ids, null ones last; rows of hot ids and of none by a hash of the text too."""
    crowded = id_.isNull() | id_.isin(hot) if hot else id_.isNull()
    return F.struct(id_.isNotNull().cast("int").alias("a"), F.coalesce(id_, F.lit(0)).alias("b"), F.when(crowded, F.xxhash64(text)).otherwise(F.lit(0).cast("long")).alias("c"))


def _literal(value: list, kind: str) -> Column:
    """One constant of any type, however long; keys of structs are those of kind."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _above(value: Column, cuts: list[tuple[int, int, int]]) -> Column:
    """How many of the descending cuts exceed value, in two steps of about a square root of them each."""
    if not cuts:
        return F.lit(0)
    size = isqrt(len(cuts)) + 1
    named = [dict(zip("abc", c, strict=True)) for c in cuts]
    groups = [named[k : k + size] for k in range(0, len(named), size)]
    passed = F.size(F.filter(_literal([g[-1] for g in groups], f"array<{_PLACE}>"), lambda c: c > value))
    rest = F.coalesce(F.get(_literal(groups, f"array<array<{_PLACE}>>"), passed), F.array().cast(f"array<{_PLACE}>"))
    return F.least(F.lit(len(cuts)), passed * size) + F.size(F.filter(rest, lambda c: c > value))


def _cuts(docs: DataFrame, id_col: str, text_col: str, parts: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(descending cuts of the places, hot ids). An id that takes up several quantiles is hot; its rows, and those without an
    id, are cut by quantiles of their hash. No more than a few values for each task come to the driver."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = ids.agg(F.percentile_approx("id", F.lit(shares), 100 * parts).alias("q"), F.count("id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    values = list(found["q"] or []) if parts > 1 else []
    hot = sorted({v for v in values if values.count(v) > 1}) if len(set(values)) < len(values) else []
    cuts = {(1, v, 0) for v in set(values).difference(hot)}
    empty = found["all"] - found["n"]
    if parts > 1 and (hot or empty * parts > found["all"]):
        crowded = ids.where(F.col("id").isNull() | F.col("id").isin(hot)) if hot else ids.where(F.col("id").isNull())
        for row in crowded.groupBy("id").agg(F.percentile_approx(F.xxhash64("text"), F.lit(shares), 100 * parts).alias("q")).collect():
            times = values.count(row["id"]) + 1 if row["id"] is not None else max(1, ceil(parts * empty / found["all"]))
            picked = [row["q"][min(len(row["q"]) - 1, k * len(row["q"]) // times)] for k in range(1, times)]
            # Ends of the group keep its neighbours out of its first and last part.
            cuts |= {(int(row["id"] is not None), row["id"] or 0, h) for h in (-(1 << 63), *picked, (1 << 63) - 1)}
    return sorted(cuts, reverse=True), hot


def ring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(id, place, text, task int, tail boolean), number of tasks: docs by ranges of descending place (see _place), each range
    with the first rows of the next one (the last: of the first) as its tail. Texts are shuffled once and never sorted in
    one task, nor do many rows of one id or of none gather in one, unless their texts are equal as well."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, hot = _cuts(docs, id_col, text_col, parts)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("place", _place(F.col("id"), hot, F.col("text")))
    rows = rows.withColumn("task", _above(F.col("place"), cuts).cast("int"))
    # One row for each range comes to the driver.
    heads = {r["task"]: tuple(r["place"]) for r in rows.groupBy("task").agg(F.max("place").alias("place")).collect()}
    order, n = sorted(heads), len(cuts) + 1
    back = {t: order[k - 1] for k, t in enumerate(order)}
    of_task = F.get(_literal([heads.get(t) and dict(zip("abc", heads[t], strict=True)) for t in range(n)], f"array<{_PLACE}>"), F.col("task"))
    before = F.get(_literal([back.get(t) for t in range(n)], "array<int>"), F.col("task"))
    own = F.struct("task", F.lit(False).alias("tail"))
    tail = F.struct(before.alias("task"), F.lit(True).alias("tail"))
    to = F.explode(F.when(F.col("place") == of_task, F.array(own, tail)).otherwise(F.array(own)))
    return rows.select("id", "place", "text", to.alias("to")).select("id", "place", "text", "to.task", "to.tail"), n


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row, in descending id: its fingerprint, that of its text with the last third replaced by the start
    of the next row's text, and how like its fingerprint is to that one and to the next row's.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Ids are whole
    numbers; after the last row comes the first. Null texts are empty, long ones count whole. Equal ids are ordered by text
    (hot ones by its hash first), and so are null ids, which come last; repeated rows are rows of their own. Further
    columns are ignored, whatever they are named. An empty table gives an empty result."""
    rows, n = ring(docs, id_col, text_col)
    rows = rows.repartitionById(n, F.col("task")).sortWithinPartitions("tail", F.desc("place"), "text")

    def edited(text: str, following: str) -> str:
        third = len(text) // 3
        return text[: len(text) - third] + following[:third]

    def compared(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All but the last, which is only the one next to the last but one."""
        new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, other = sketches(pa.array(texts, pa.large_string())), sketches(pa.array(new, pa.large_string()))
        return pa.RecordBatch.from_pydict({
            id_col: pa.array(ids[:-1], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            "fingerprint": pa.array([text_of(s) for s in own[:-1]], pa.string()),
            "edited_fingerprint": pa.array([text_of(s) for s in other], pa.string()),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for k, (row_id, text, tail) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "text", "tail")), strict=True)):
                ids.append(row_id)
                texts.append(text)
                size += len(text)
                if tail or size > SLICE_BYTES and len(texts) > 1:
                    yield compared(ids, texts)
                    if tail:
                        return
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    return rows.select("id", "text", "tail").mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
