import random

import pytest

from rastrel.llm import substring_dedup


def brute(rows, length):
    """(id, text) -> (n_words, kept words) in input order; windows of equal ids don't count against each other."""
    first = {}
    for i, text in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            if i is not None and first[tuple(words[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        out.append((i, len(words), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def found(spark, rows, length=12, anchor=4):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = substring_dedup.dedup_substrings(docs, length=length, anchor=anchor).collect()
    assert all(r.n == 1 for r in got)
    assert all(r.n_removed == r.n_words - len((r.text or "").encode().split()) for r in got)
    return sorted(((r.doc_id, r.n_words, " ".join((r.text or "").split())) for r in got), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 2)
    passages = [[word() for _ in range(rng.randint(10, 40))] for _ in range(6)]
    rows = []
    for i in rng.sample(range(200), 40):
        words = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(passages)
            a = rng.randint(0, 8)
            words += [word() for _ in range(rng.randint(0, 10))] + part[a : a + rng.randint(5, 40)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows, 12)


def test_edges(spark):
    same = " ".join(f"w{k}" for k in range(30))
    rows = [(5, same), (5, same), (3, same + " end"), (7, "x " * 40), (8, "x " * 40), (None, same), (9, None), (10, ""), (11, "a b"), (2, "é " + same)]
    assert found(spark, rows) == brute(rows, 12)
    assert found(spark, []) == []


def test_cut_keeps_the_rest_as_it_is(spark):
    same = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, same), (2, f"  one\n\ntwo {same}\nthree  ")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(docs, length=12, anchor=4).collect()}
    assert got == {1: same, 2: "  one\n\ntwo three  "}


def test_repeated_rows_cost_no_more_than_their_number(spark):
    same = " ".join(f"w{k}" for k in range(40))
    rows = lambda n: [(5, "x y z " + same)] * n + [(3, same + " end"), (4, "q " + same[:120])]
    counts = []
    for n in (20, 200):
        docs = spark.createDataFrame(rows(n), "doc_id long, text string")
        counts.append(substring_dedup.repeats(docs, length=12, anchor=4).where("id = 5").count())
    assert counts[1] <= 11 * counts[0] and found(spark, rows(200)) == brute(rows(200), 12)


def test_columns_may_clash_and_texts_be_long(spark):
    same = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, same, "a", "t"), (2, "x " * 40_000 + same, "b", "u")], "doc_id long, text string, n_words string, _tag string")
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got[2].n_words == 40_060 and got[2].n_removed == 60
    assert got[2]._tag == "u" and docs.columns[:2] == ["doc_id", "text"]
    kept = substring_dedup.dedup_substrings(docs, counts=("_w", "_r"))
    assert kept.where("doc_id = 1").first().n_words == "a" and kept.columns[-2:] == ["_w", "_r"]
