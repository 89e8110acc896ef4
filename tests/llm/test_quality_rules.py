import random
from collections import Counter

from rastrel.llm import quality_rules


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(grams)
    covered = {p for k, g in enumerate(grams) if often[g] > 1 for p in range(k, k + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\n", "one", "a\tb\x0bc\x0cd\re", "é\u00a0ü 漢 # | <b>", "x " * 8, "x " * 9, "a b c d e f g h " * 2, "a b c d e f g h i " * 2, "l\nl\n l\nl \n"]
    for _ in range(150):
        part = [rng.choice("abc#é") for _ in range(rng.randint(1, 30))]
        out.append(rng.choice([" ", "\n", " \n"]).join(part * rng.randint(1, 3) + [str(rng.random()) for _ in range(rng.randint(0, 60))]))
    return out


def test_base_metrics(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "o") for i, t in rows] + [(None, "a b", "o")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t)
        assert not (r.base_failed and r.kept)
    assert got[None].source == "o"


def test_verdict_and_filter_agree(spark):
    clean = " ".join(["the quick fox and a dog of note"] * 1 + [f"word{k} is in text" for k in range(10)])
    rows = [(1, clean), (2, clean.replace(" ", "### ")), (3, clean.upper().replace(" ", "!! ")), (4, clean.replace(" ", " | ")), (5, "same same " * 40), (6, None), (1, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in quality_rules.judge(docs).where("kept").collect())
    assert kept == [1, 1] and sorted(r.doc_id for r in quality_rules.keep(docs).collect()) == kept
    assert quality_rules.keep(docs.limit(0)).collect() == []


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", "y"), (2, None, 6, "x", "z")], "doc_id long, text string, n_words int, kept string, words string")
    got = quality_rules.judge(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.kept, r.words) for r in got] == [(2, False, "y"), (0, False, "z")]
    loose = (quality_rules.Rule("n_words", 1, None),)
    assert [tuple(r) for r in quality_rules.keep(docs, rules=loose).collect()] == [(1, "a b", 5, "x", "y")]
    assert quality_rules.keep(docs).dtypes == docs.dtypes


def test_long_text_is_judged_whole(spark):
    words = [f"w{k}" for k in range(30_000)]
    docs = spark.createDataFrame([(1, " ".join(words + words[-9:]))], "doc_id long, text string")
    row = quality_rules.judge(docs).first()
    assert (row.n_words, row.n_repeat_words) == (30_009, 18)
