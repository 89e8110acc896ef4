"""Near copies by their sets of 5-word shingles: SimHash and MinHash propose, the sets themselves decide.

Texts that are equal but for case and spacing are one class. Classes whose SimHash fingerprints (of the same shingles)
the Gray-order index links share a bucket. Fingerprints within two bits miss most pairs at Jaccard 0.8 (about ten bits
differ there), so a class also goes to BANDS buckets, each keyed by ROWS minima of its shingle names; at 0.8 a pair shares
none of them with probability (1 - 0.8**4)**24 = 3e-6. Buckets that hold the same classes are searched once.

Within a bucket a search grows each component from one class over all that are not yet reached, so no pair is left out
and a group of n copies costs about n comparisons. A bucket of more than HOT shingles is first compared with one of its
classes, in as many tasks as it needs: what is near is linked, and as Jaccard distance is a metric, only those of it that
lie within 0.2 of the rest's distance are kept for the rest. What stays too large after ROUNDS such comparisons is
dealt into chunks, and every two chunks meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm._io import map_slices, materialise, text_slices
from rastrel.llm._words import SPACE, U64, flat, mix, run_hashes, spans, word_hashes
from rastrel.llm import simhash
from rastrel.llm.simhash import components

#: Words of a shingle.
SHINGLE = 5
#: Least Jaccard similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Buckets of a class, and minima in the key of each.
BANDS, ROWS = 24, 4
#: Shingles of a bucket that one task searches, and comparisons of a larger one before it is dealt into chunks.
HOT, ROUNDS = 1 << 17, 4
_SLACK = 1e-9
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_TURNS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U64)).astype(np.uint32).reshape(2, -1)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, names of each text, name of each whole text) of lower-cased words; a shorter text is one shingle."""
    raw, offs = flat(texts)
    raw = _LOWER[raw]
    starts, ends, bounds = spans(raw, offs, SPACE)
    names = word_hashes(raw, starts, ends)
    words = np.diff(bounds)
    whole = np.zeros(len(words), U64)
    full = np.flatnonzero(words)
    whole[full] = run_hashes(names, bounds[:-1][full], words[full])
    counts = np.where(words > size, words - size + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(words)), counts)
    firsts = bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return run_hashes(names, firsts, np.minimum(words, size)[row]), counts, whole


def buckets(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys of the buckets of each text that has shingles, a row for each."""
    full = counts[counts > 0]
    if not len(full):
        return np.zeros((0, BANDS), U64)
    opens = np.cumsum(full) - full
    short = (names >> U64(32)).astype(np.uint32)
    keys = np.empty((len(full), BANDS), U64)
    for b in range(BANDS):
        key = np.full(len(full), b + 1, U64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = mix((key << U64(1)) ^ np.minimum.reduceat((short ^ _TURNS[0, k]) * (_TURNS[1, k] | np.uint32(1)), opens))
        keys[:, b] = key
    return keys


def linked(names: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of texts of SIMILAR or more that span the components of all such pairs."""
    _, code = np.unique(names, return_inverse=True)
    pair = np.unique(np.repeat(np.arange(len(counts)), counts) * (len(names) + 1) + code)
    member, code = pair // (len(names) + 1), pair % (len(names) + 1)
    sizes = np.bincount(member, minlength=len(counts))
    first = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(names) + 1, bool)
    every, rest, todo, found = code, np.arange(len(counts)), [], []
    over, under = SIMILAR
    while len(rest):
        if not todo:
            todo.append(int(rest[0]))
            keep = member != rest[0]
            rest, member, code = rest[1:], member[keep], code[keep]
        now = todo.pop()
        own = every[first[now] : first[now + 1]]
        mark[own] = True
        shared = np.bincount(member[mark[code]], minlength=len(counts))[rest]
        mark[own] = False
        near = under * shared >= over * (sizes[now] + sizes[rest] - shared)
        if near.any():
            new = rest[near]
            found += [(now, int(k)) for k in new]
            todo += new.tolist()
            gone = np.zeros(len(counts), bool)
            gone[new] = True
            keep = ~gone[member]
            rest, member, code = rest[~near], member[keep], code[keep]
    return found


def prints_of(batch: pa.RecordBatch) -> dict:
    """fp (name of the whole text), SimHash, number of shingles and MinHash buckets of every row."""
    names, counts, whole = shingles(batch.column("text"))
    keys = pa.array(buckets(names, counts).view(np.int64).ravel())
    ends = pa.array(np.r_[0, np.cumsum((counts > 0) * BANDS)].astype(np.int32))
    out = {c: batch.column(c) for c in ("__id", "__tag")} | {"fp": pa.array(whole.view(np.int64)), "keys": pa.ListArray.from_arrays(ends, keys)}
    return out | {"sim": pa.array(simhash.majority(names, counts).view(np.int64)), "n": pa.array(counts)}


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(key, fp, n): of the buckets of classes (fp, sim, n, keys) that hold several, one of each set of classes."""
    full = classes.where("n > 0")
    label = materialise(components(materialise(simhash.links(full.select(F.col("sim").alias("fp")).distinct()), "sim-links")), "sim-components")
    alike = full.select("fp", "n", "sim").join(label.withColumnRenamed("node", "sim"), "sim", "left").select("fp", "n", F.xxhash64(F.lit("sim"), F.coalesce("comp", "sim")).alias("key"))
    rows = materialise(full.select("fp", "n", F.explode("keys").alias("key")).distinct().unionByName(alike), "buckets")
    held = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor(F.xxhash64("fp")).alias("x"))
    once = materialise(held.where("c > 1").groupBy("c", "a", "b", "x").agg(F.min("key").alias("key")).select("key"), "shared-buckets")
    return materialise(rows.join(once.hint("merge"), "key").select("key", "fp", "n"), "candidates")


def _loads(found: DataFrame, hot: int) -> DataFrame:
    """found with `parts`: the tasks that its bucket's shingles are worth."""
    load = found.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(hot)).cast("int").alias("parts"))
    return materialise(found.join(load.hint("merge"), "key").select("key", "fp", "n", "parts"), "loads")


def _distances(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, fp, n, near boolean, far double): each class of a bucket against the bucket's pivot, a class chosen by a hash.

    near: linked to the pivot, which has far = -1 itself; far: the Jaccard distance. A task holds one pivot and a batch."""
    pivots = hot.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "fp"), "fp"))["fp"].alias("pivot"), F.first("parts").alias("parts"))
    own = pivots.join(texts.withColumnRenamed("fp", "pivot").hint("merge"), "pivot").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("pivot").alias("fp"), F.lit(0).cast("long").alias("n"), "text")
    rows = hot.join(texts.hint("merge"), "fp").select("key", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "fp", "n", "text")
    parts = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.unionByName(own).repartition(parts, "key", "part").sortWithinPartitions("key", "part", "kind")
    over, under = SIMILAR

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = 0, np.zeros(0, U64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                kind, fps = part.column("kind").to_numpy(), part.column("fp").to_numpy()
                opens = np.flatnonzero(kind == 0)
                names, counts, _ = shingles(part.column("text"))
                ends = np.r_[0, np.cumsum(counts)]
                stops = [*opens, len(fps)]  # a slice may hold no pivot of its own and go on with the last one
                runs = [(-1, 0, stops[0]), *((o, o + 1, e) for o, e in zip(opens, stops[1:], strict=True))]
                near, far = np.zeros(len(fps), bool), np.zeros(len(fps))
                to = np.zeros(len(fps), np.int64)
                for o, a, b in runs:
                    if o >= 0:
                        pivot, own = int(fps[o]), np.unique(names[ends[o] : ends[o + 1]])
                    to[a:b] = pivot
                    for k in range(a, b):
                        mine = np.unique(names[ends[k] : ends[k + 1]])
                        shared = len(np.intersect1d(mine, own, assume_unique=True))
                        union = len(mine) + len(own) - shared
                        near[k], far[k] = under * shared >= over * union, 1 - shared / max(1, union)
                        if fps[k] == pivot:
                            far[k] = -1.0
                take = pa.array(np.flatnonzero(kind == 1))
                yield pa.RecordBatch.from_pydict({"key": part.column("key").take(take), "fp": part.column("fp").take(take), "n": part.column("n").take(take), "pivot": pa.array(to).take(take), "near": pa.array(near).take(take), "far": pa.array(far).take(take)})

    return rows.mapInArrow(compare, "key long, fp long, n long, pivot long, near boolean, far double")


def settle_hot(found: DataFrame, texts: DataFrame, hot: int = HOT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(buckets (key, fp) of no more than about `hot` shingles, links (a, b)) that together stand for found's buckets.

    The links join what the large buckets' pivots are near to. Nothing is left out: see the module's text."""
    rows = _loads(found, hot)
    small, linked_ = [rows.where("parts = 1").select("key", "fp")], []
    rows = rows.where("parts > 1")
    reach = 1 - SIMILAR[0] / SIMILAR[1] + _SLACK
    for _ in range(rounds):
        if rows.isEmpty():
            break
        scored = materialise(_distances(rows, texts), "distances")
        linked_.append(scored.where("near and far >= 0").select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
        least = scored.where("not near").groupBy("key").agg(F.min("far").alias("least"))
        left = scored.join(least.hint("merge"), "key").where((F.col("far") >= 0) & (~F.col("near") | (F.col("far") >= F.col("least") - reach)))
        rows = _loads(left.select("key", "fp", "n"), hot)
        small.append(rows.where("parts = 1").select("key", "fp"))
        rows = rows.where("parts > 1")
    if not rows.isEmpty():
        # Chunk i of a bucket meets chunk j in the bucket of i and j.
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pairs = rows.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        small.append(pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp").distinct())
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, linked_) if linked_ else None


def links(found: DataFrame, texts: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between the classes of shared_buckets(), checked on the shingle sets. texts: (fp, text), one row of each class."""
    buckets_, more = settle_hot(found, texts, hot)
    searched = _search(buckets_, texts)
    return searched.unionByName(more) if more is not None else searched


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of batches (key, fp, text) in order of key. Strings are made of a slice at a time and kept for one bucket, so
    that a task's memory follows neither the size of Spark's batches nor their number."""
    now, fps, held = None, [], []

    def close() -> pa.RecordBatch:
        pairs = linked(*shingles(pa.array(held, pa.large_string()))[:2])
        return pa.RecordBatch.from_pydict({n: pa.array([fps[p[k]] for p in pairs], pa.int64()) for k, n in enumerate("ab")})

    for part in (p for batch in batches for p in text_slices(batch, "text")):
        for key, fp, text in zip(*(part.column(c).to_pylist() for c in ("key", "fp", "text")), strict=True):
            if key != now:
                if len(fps) > 1:
                    yield close()
                now, fps, held = key, [], []
            fps.append(fp)
            held.append(text)
    if len(fps) > 1:
        yield close()


def _search(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that span each bucket's components; one bucket is one task's."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = found.join(texts.hint("merge"), "fp").repartition(parts, "key").sortWithinPartitions("key")
    return rows.select("key", "fp", "text").mapInArrow(search, "a long, b long")


def _rows(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__row: a struct of docs' columns, and named's columns) where id, null or not, and text are those of a row of named (__id, __tag, ...)."""
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.xxhash64(F.col(f"`{text_col}`")).alias("__own"), F.col(f"`{id_col}`").alias("__key"))
    same = tagged["__key"].eqNullSafe(named["__id"]) & (tagged["__own"] == named["__tag"])
    return tagged.join(named.hint("merge"), same).drop("__own", "__key")  # the same plan at every size


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row of docs of each component of near copies: that of the smallest id, a null id last.

    Near copies share 0.8 or more of their sets of 5-word shingles; texts without words are copies of each other.
    Rows are told apart by id and text, so that neither null ids nor unlike texts of one id lose a component; of rows that
    are equal in both, that with the least other columns stays. Texts count whole, however long; null and empty ones are
    alike. Further columns are carried along, also if named as ours are (__id, __tag, fp, ...). An empty table gives an
    empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    tagged = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__tag"), F.col(text_col).alias("text"))
    prints = materialise(map_slices(tagged, prints_of, f"__id {kind}, __tag long, fp long, keys array<long>, sim long, n long"), "prints")
    place = F.struct(F.col("__id").isNull().alias("last"), "__id", "__tag")
    classes = materialise(prints.groupBy("fp").agg(F.min(place).alias("row"), *[F.first(c).alias(c) for c in ("keys", "sim", "n")]), "classes")
    found = shared_buckets(classes)
    wanted = materialise(classes.join(found.select("fp").distinct().hint("merge"), "fp", "left_semi").select("row.__id", "row.__tag", F.col("fp").alias("__fp")), "wanted")
    texts = _rows(docs.select(id_col, text_col), wanted, id_col, text_col).groupBy(F.col("__fp").alias("fp")).agg(F.min(F.col(f"__row.`{text_col}`")).alias("text"))
    label = materialise(components(materialise(links(found, materialise(texts, "texts"), hot), "links")), "components")
    of_class = classes.select("fp", "row").join(label.withColumnRenamed("node", "fp"), "fp", "left")
    kept = materialise(of_class.groupBy(F.coalesce("comp", "fp").alias("comp")).agg(F.min("row").alias("row")).select("row.__id", "row.__tag"), "kept")
    same = prints.groupBy("__id", "__tag").agg((F.count("*") > 1).alias("__twice")).where("__twice")
    twice = materialise(_marked(kept, same), "repeated")
    whole = _rows(docs, twice, id_col, text_col)
    once = whole.where("not __twice").select("__row.*")
    if twice.where("__twice").isEmpty():
        return once
    # Only rows that repeat both id and text are gathered by them.
    first = whole.where("__twice").groupBy("__id", "__tag").agg(F.min("__row").alias("__row"))
    return once.unionByName(first.select("__row.*"))


def _marked(kept: DataFrame, same: DataFrame) -> DataFrame:
    """kept (__id, __tag) with __twice: whether same has the row."""
    same = same.select(F.col("__id").alias("i"), F.col("__tag").alias("t"), "__twice")
    both = kept.join(same, kept["__id"].eqNullSafe(same["i"]) & (kept["__tag"] == same["t"]), "left")
    return both.select("__id", "__tag", F.coalesce("__twice", F.lit(False)).alias("__twice"))
