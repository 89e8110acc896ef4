"""SimHash near-duplicates: fingerprints of 3-word shingles, linked by a Gray-order hierarchical index.

Equal fingerprints are first merged into classes. Two fingerprints within two bits agree on two
of four 16-bit blocks at least, so each class goes to six buckets (one for each pair of blocks).
A bucket is sorted by Gray rank and indexed as a tree whose upper nodes hold the bit pattern
that all fingerprints below share; a search adds up differences on the way down and drops a
whole group as soon as they exceed the limit. Buckets yield spanning links, never all pairs,
and min-label contraction turns the links into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.llm._io import map_slices, materialise
from rastrel.llm._words import U64

#: Children of a node of the index.
FANOUT = 8
#: Differing bits that still link two fingerprints; the buckets' blocks are made for it.
MAX_BITS = 2
#: Fingerprints of a bucket beyond which it is dealt out again by its remaining bits.
HOT_BUCKET = 50_000
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(U64).ravel()


def fingerprints_of(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (unsigned 64 bits) of whole texts; a text without words has zero."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    values: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(pc.cast(texts, pa.large_binary()).to_pylist()):
        words = (text or b"").lower().split()
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            values.append(digest(line, seed))
            counts[k] = 1
            continue
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        ends = np.append(gaps, len(line))[shingle - 1 :].tolist()
        starts = [0, *(gaps[: len(ends) - 1] + 1).tolist()]
        values += [digest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)]
        counts[k] = len(ends)
    return majority(np.array(values, U64), counts)


def majority(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each group of counts[k] consecutive values, the bits set in over half of them."""
    out = np.zeros(len(counts), U64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # Eight 8-bit counters lie in one word, so at most 255 values are added before widening.
    blocks = -(-counts[full] // 255)
    first = np.cumsum(counts[full]) - counts[full]
    opens = np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - opens)
    sums = np.empty((len(full), 64), np.int64)
    columns = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    at = np.cumsum(blocks) - blocks
    for b in range(8):
        lanes = np.add.reduceat(_SPREAD[columns[:, b]], starts)
        sums[:, 8 * b : 8 * b + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), at, axis=0)
    out[full] = np.packbits(2 * sums > counts[full][:, None], axis=1, bitorder="little").view(U64).ravel()
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint of every row's whole text."""

    def kernel(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(id_col), "fp": pa.array(fingerprints_of(batch.column(text_col)).view(np.int64))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(id_col, text_col), kernel, f"`{id_col}` {kind}, fp long", text_col)


def gray_rank(fp: Column) -> Column:
    """Rank of fp in the reflected Gray code, moved so that signed order is the unsigned one."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def near_pairs(fps: np.ndarray, bucket: np.ndarray, limit: int = MAX_BITS, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one bucket within `limit` bits. fps: by bucket, then Gray rank."""
    n = len(fps)
    pattern, mask, owner = [fps], [np.full(n, ~U64(0))], [bucket]
    firsts: list[np.ndarray] = []
    while True:
        own = owner[-1]
        opens = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        if len(opens) == len(own):
            break
        sizes = np.diff(np.r_[opens, len(own)])
        place = np.arange(len(own)) - np.repeat(opens, sizes)
        heads = np.flatnonzero(place % FANOUT == 0)
        spread = np.diff(np.r_[heads, len(own)])
        unlike = np.bitwise_or.reduceat(pattern[-1] ^ np.repeat(pattern[-1][heads], spread), heads)
        shared = np.bitwise_and.reduceat(mask[-1], heads) & ~unlike
        firsts.append(np.r_[heads, len(own)])
        pattern.append(pattern[-1][heads] & shared)
        mask.append(shared)
        owner.append(own[heads])
    # What a node adds: the bits that it fixes and its parent doesn't.
    rest = [m & ~np.repeat(mask[k + 1], np.diff(firsts[k])) for k, m in enumerate(mask[:-1])] + [mask[-1]]
    last = [np.arange(n)]
    for f in firsts:
        last.append(last[-1][f[1:] - 1])
    root = np.searchsorted(owner[-1], bucket) if len(owner[-1]) else np.zeros(0, np.int64)
    for a in range(0, n, chunk):
        query = np.arange(a, min(n, a + chunk))
        node, level = root[query], len(pattern) - 1
        far = np.bitwise_count((fps[query] ^ pattern[level][node]) & rest[level][node])
        while True:
            keep = (far <= limit) & (last[level][node] > query)
            query, node, far = query[keep], node[keep], far[keep]
            if not level or not len(query):
                break
            level -= 1
            opens, sizes = firsts[level][node], firsts[level][node + 1] - firsts[level][node]
            step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            query, node, far = np.repeat(query, sizes), np.repeat(opens, sizes) + step, np.repeat(far, sizes)
            far = far + np.bitwise_count((fps[query] ^ pattern[level][node]) & rest[level][node])
        if not level and len(query):
            yield query, node


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each index's component under the given pairs."""
    low = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = low[a], low[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while True:
                nxt = low[low]
                if (nxt == low).all():
                    break
                low = nxt
    return low


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key and Gray rank -> links (a, b) that span each bucket's components."""

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[opens, len(key)])
        many = np.repeat(sizes > 1, sizes)
        if many.any():
            own, fp = np.repeat(np.arange(len(opens)), sizes)[many], fp[many]
            low = spanning(len(fp), near_pairs(fp.view(U64), own))
            linked = np.flatnonzero(low != np.arange(len(low)))
            yield pa.RecordBatch.from_pydict({"a": fp[linked], "b": fp[low[linked]]})

    held_key, held_fp = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = (batch.column(c).to_numpy() for c in ("key", "fp"))
        cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
        if cut:
            yield from links(np.concatenate([*held_key, key[:cut]]), np.concatenate([*held_fp, fp[:cut]]))
            held_key, held_fp = [], []
        held_key.append(key[cut:])
        held_fp.append(fp[cut:])
    yield from links(np.concatenate(held_key), np.concatenate(held_fp))


def _buckets(fp: Column) -> Column:
    block = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for k, (i, j) in enumerate(combinations(range(4), 2))]
    return F.array(*keys)


def _finer(fp: Column, key: Column) -> Column:
    """Keys of a hot bucket: its own with each third of the 32 bits that its key leaves open."""
    rest = F.lit(None).cast("long")
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        p, q = (x for x in range(4) if x not in (i, j))
        own = F.shiftleft(F.shiftrightunsigned(fp, 16 * p).bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF)))
        rest = F.when(F.shiftright(key, 32) == k, own).otherwise(rest)
    cuts = ((0, 11), (11, 11), (22, 10))
    parts = [F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << n) - 1)) for at, n in cuts]
    return F.array(*[F.shiftleft(key, 13).bitwiseOR(F.lit((k + 1) << 11)).bitwiseOR(p) for k, p in enumerate(parts)])


def links(classes: DataFrame, hot: int = HOT_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp`; their components are those of all pairs within MAX_BITS.

    A bucket of more than `hot` fingerprints is dealt out by thirds of its remaining 32 bits, one of which
    two linked fingerprints must share, so that no link is lost and no bucket exceeds 2**21 fingerprints."""
    rows = classes.select("fp", F.explode(_buckets(F.col("fp"))).alias("key"))
    large = materialise(rows.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("large")), "hot-buckets")
    if not large.isEmpty():
        rows = rows.join(large, "key", "left")
        keys = F.when(F.col("large"), _finer(F.col("fp"), F.col("key"))).otherwise(F.array(F.shiftleft("key", 13)))
        rows = rows.select("fp", F.explode(keys).alias("key"))
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key").withColumn("rank", gray_rank(F.col("fp"))).sortWithinPartitions("key", "rank")
    return rows.select("key", "fp").mapInArrow(bucket_links, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): a common node for each component of the links (a, b), by min-label contraction.

    Every round hooks each node to its smallest neighbour, shortens the chains by pointer jumping and
    joins the edges to what is left; state lies in shared tables, so that nothing is gathered."""
    both = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    both = materialise(both.distinct(), "edges")
    label = None
    while not both.isEmpty():
        parent = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = materialise(parent.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")), "parents")
            parent = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = parent.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            step = parent.select(F.col("a").alias("comp"), "p")
            label = materialise(label.join(step, "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        pa_, pb = parent.select("a", F.col("p").alias("x")), parent.select(F.col("a").alias("b"), F.col("p").alias("y"))
        half = materialise(both.join(pa_, "a").select("x", "b"), "edges")
        both = materialise(half.join(pb, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if label is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_BUCKET) -> DataFrame:
    """(id, fp, component_id) for every row of docs: component_id is the smallest id reachable over
    links of at most two differing bits.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id keep
    their own row but never name a component that has another id. Repeated rows come out as often
    as they come in, and texts count whole, however long. Further columns are ignored, whatever they
    are named. An empty table gives an empty result."""
    prints = materialise(simhash(docs, id_col, text_col), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    label = materialise(components(links(classes, hot)), "components")
    named = materialise(label.join(classes, label.node == classes.fp).select("node", "comp", "rep"), "named")
    least = materialise(named.groupBy("comp").agg(F.min("rep").alias("least")), "least")
    found = named.join(least, "comp").select(F.col("node").alias("fp"), "least")
    of_class = materialise(classes.join(found, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "of-class")
    return prints.join(of_class, "fp").select(id_col, "fp", "component_id")
