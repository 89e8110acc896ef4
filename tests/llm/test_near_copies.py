import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from rastrel.llm import near_copies


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(seed, n_bases, copies):
    """Texts with copies of which a few words are edited, around and beyond the limit."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 250))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            out.append(" ".join(words))
    return out


def smallest(texts):
    """Of each text, the smallest index of its component over all pairs."""
    sets, low = [shingle_set(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])]
    while any(low[i] != low[j] for i, j in pairs):
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_search_spans_the_components_of_all_pairs():
    texts = [*edited(1, 3, 12), "one two three four five"]
    names, counts, _ = near_copies.shingles(pa.array(texts))
    low = np.arange(len(texts))
    found = near_copies.linked(names, counts)
    assert all(near(shingle_set(texts[a]), shingle_set(texts[b])) for a, b in found)
    for _ in texts:
        for a, b in found:
            low[a] = low[b] = min(low[a], low[b])
    assert low.tolist() == smallest(texts)


def test_stage_keeps_one_of_edited_copies(spark):
    texts = [*edited(2, 25, 8), None, "", " \n", "a b", "A  b", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(smallest(texts)) and len(kept) < len(texts)


def test_rows_without_id_and_unlike_texts_of_one_id_stay(spark):
    a, b, c, d = edited(3, 4, 1)
    rows = [(None, a), (None, a), (None, b), (1, b), (None, None), (7, c), (7, d), (7, d), (8, d), (9, a + " more")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp int")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    # Each component keeps its smallest id; that of no id keeps a row as well.
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(9, a + " more"), (1, b), (0, ""), (7, c), (7, d)])
    assert all(rows[r.fp] == (r.doc_id, r.text) for r in kept)
    alone = corpus_pipeline.near_dedup(spark, docs.where("doc_id is null"), "").collect()
    assert sorted((r.doc_id is None, r.text or "") for r in alone) == sorted([(True, a), (True, b), (True, "")])


def test_large_buckets_lose_no_link(spark):
    """Groups of near copies beyond a task's bound are settled by pivots and chunks; the result doesn't change."""
    texts = [*edited(5, 3, 40), *edited(6, 10, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(smallest(texts))
    for hot in (near_copies.HOT, 2_000, 300):
        assert {r.doc_id for r in near_copies.keep_one(docs, hot=hot).collect()} == want
    # A pivot and the classes that meet it may come in different batches.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r.doc_id for r in near_copies.keep_one(docs, hot=2_000).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 10 < len(want) < len(texts)


def test_clashing_columns_and_empty_table(spark):
    rows = [(1, "a b c", "p", 4), (2, "A b  c", "q", 5), (3, "x", "r", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, fp int")
    assert sorted(map(tuple, near_copies.keep_one(docs).collect())) == [rows[0], rows[2]]
    assert near_copies.keep_one(docs.limit(0)).collect() == []


def test_a_search_holds_strings_of_a_slice_alone():
    """Memory for a batch of 32 MB of texts in buckets of two stays at a few slices, and each bucket finds its link."""
    texts = [f"{k} " + "word " * 3300 for k in range(1000) for _ in "ab"]
    batch = pa.RecordBatch.from_pydict({"key": pa.array([k // 2 for k in range(2000)]), "fp": pa.array(range(2000)), "text": pa.array(texts)})
    del texts
    tracemalloc.start()
    found = [(a, b) for part in near_copies.search(iter([batch])) for a, b in zip(*(part.column(c).to_pylist() for c in "ab"), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(k, k + 1) for k in range(0, 2000, 2)] and peak < 16 << 20
