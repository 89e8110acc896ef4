import numpy as np
import pyarrow as pa
import xxhash

from rastrel.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [words] if len(words) < 3 else [words[k : k + 3] for k in range(len(words) - 2)]
    values = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(rows):
    label = {k: i for k, (i, _) in enumerate(rows)}
    while True:
        new = {k: min(label[j] for j, (_, g) in enumerate(rows) if bin(f ^ g).count("1") <= 2) for k, (_, f) in enumerate(rows)}
        if new == label:
            return sorted((i, label[k]) for k, (i, _) in enumerate(rows))
        label = new


def test_fingerprints():
    rng = np.random.default_rng(1)
    texts = [None, "", " \n", "One", "one two", "A b C", "é É x", *[" ".join(rng.choice(list("abcdefgh"), n)) for n in (3, 4, 50, 255, 256, 257, 258, 600, 2000)]]
    assert simhash.fingerprints_of(pa.array(texts)).tolist() == [brute_print(t) for t in texts]


def close_prints(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    out = []
    for _ in range(n):
        f = int(rng.choice(base))
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            f ^= 1 << int(b)
        out.append(f)
    return out


def test_index_finds_every_pair_once():
    fps = np.unique(np.array(close_prints(2, 400), np.uint64))
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    bucket = np.sort(np.random.default_rng(3).integers(0, 3, len(fps)))
    got = [(int(a), int(b)) for x, y in simhash.near_pairs(fps, bucket, chunk=37) for a, b in zip(x, y, strict=True)]
    far = np.bitwise_count(fps[:, None] ^ fps[None])
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if far[a, b] <= 2 and bucket[a] == bucket[b]}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_match_brute_force_and_hot_buckets_lose_none(spark):
    prints = close_prints(4, 150)
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(prints)], "fp long")
    found = []
    for hot in (simhash.HOT_BUCKET, 2):
        label = {r.node: r.comp for r in simhash.components(simhash.links(classes, hot)).collect()}
        groups = {}
        for f in set(prints):
            v = int(np.uint64(f).view(np.int64))
            groups.setdefault(label.get(v, v), set()).add(f)
        found.append(sorted(map(sorted, groups.values())))
    want = {}
    for i, (k, c) in enumerate(brute_components([(f, f) for f in sorted(set(prints))])):
        want.setdefault(c, []).append(k)
    assert found[0] == found[1] == sorted(map(sorted, want.values()))


def test_documents(spark):
    long = " ".join(f"word{k}" for k in range(400))
    rows = [(4, long), (2, long + " more"), (9, long), (9, long), (None, long), (7, None), (3, ""), (8, "quite another text of some words")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    # A row without an id takes part by its text, and never names a component.
    want = dict(brute_components([(10**6 if i is None else i, brute_print(t)) for i, t in rows]))
    assert sorted((r.doc_id or 10**6, r.component_id) for r in got) == sorted((i or 10**6, want[i or 10**6]) for i, t in rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
