import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from rastrel.llm import chat_format, fingerprint, license_scan, quality_model
from rastrel.llm import queries as registered


def test_fingerprints_share_interiors():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    whole, moved, other, same = fingerprint.sketches(pa.array([text, "odd start " + text[7:], text[::-1], text]), kept=10**6)
    assert fingerprint.likeness(whole, moved, 10**6) > 0.95 and fingerprint.likeness(whole, other, 10**6) < 0.05
    assert (whole == same).all() and fingerprint.likeness(whole, same) == 1
    a, b = (fingerprint.sketches(pa.array([t]))[0] for t in (text, text[: 2 * len(text) // 3] + text[::-1][: len(text) // 3]))
    assert 0.3 < fingerprint.likeness(a, b) < 0.7


def test_fingerprints_of_a_batch_are_those_of_each_text():
    texts = ["", "a", "aaaa", "ab", "the quick brown fox " * 30, "é漢", "x" * 500, "the end"]
    assert [s.tolist() for s in fingerprint.sketches(pa.array(texts))] == [fingerprint.sketches(pa.array([t]))[0].tolist() for t in texts]


def test_compare_with_next(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("ab é漢\n") for _ in range(rng.randint(0, 90)))) for k in rng.sample(range(1000), 60)]
    got = {r.doc_id: r for r in fingerprint.compare_with_next(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, tail string")).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == 60
    for (i, t), (j, u) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - third] + u[:third]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == fingerprint.text_of(fingerprint.sketches(pa.array([t]))[0])
        assert got[i].near_next == fingerprint.likeness(*fingerprint.sketches(pa.array([t, u])))


def test_compare_with_next_edges(spark):
    rows = [(None, "abc"), (5, None), (5, "x"), (5, "x"), (7, "")]
    got = fingerprint.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 3), (5, 0), (5, 1), (5, 1), (7, 0)]
    assert fingerprint.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert fingerprint.compare_with_next(spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")).first().near_next == 1


def test_ring_of_hot_ids(spark):
    """A third of all rows has one id, another none: they are dealt out, and each row still meets the next one."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(400)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, words[k] * 3) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, n = fingerprint.ring(docs)
    counts = [r["count"] for r in dealt.where("not tail").groupBy("task").count().collect()]
    assert sum(counts) == 400 and max(counts) < 200 and len(counts) > 2
    got = fingerprint.compare_with_next(docs).collect()
    assert len(got) == 400 and sorted((r.doc_id or -1) for r in got) == sorted((i or -1) for i, _ in rows)
    # Each text is another's next one exactly once: the edited text ends in the next one's first third.
    ends = sorted(t[: len(t) // 3] for _, t in rows)
    own = {hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest(): u[: len(t) // 3] for _, t in rows for _, u in rows}
    assert sorted(own[r.edited_sha256] for r in got) == ends


def plain_next_level(names):
    """One level of parsing for one list of names, symbol by symbol."""
    u64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & u64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & u64
        return x ^ (x >> 31)

    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [x if n == 1 else mix((x + n * 0xC2B2AE3D27D4EB4F) & u64) for x, n in runs]

    def toss(a, before):
        low = (a ^ before) & -(a ^ before)
        return 2 * (low.bit_length() - 1) + (a & low != 0)

    labels = [toss(a, names[k - 1] if k else ~a & u64) for k, a in enumerate(names)]
    for _ in range(3):
        labels = [toss(a, labels[k - 1] if k else ~a & 255) for k, a in enumerate(labels)]
    opens = [0] + [k for k in range(1, len(names) - 1) if labels[k] > labels[k - 1] and labels[k] >= labels[k + 1]]
    radix = 0x9E3779B97F4A7C15 | 1
    phrases = [names[a:b] for a, b in zip(opens, [*opens[1:], len(names)], strict=True)] if names else []
    return [mix((sum(x * pow(radix, j, 1 << 64) for j, x in enumerate(p)) + len(p) * 0x165667B19E3779F9) & u64) for p in phrases]


def test_parsing_matches_a_plain_version():
    rng = random.Random(8)
    texts = ["", "a", "aaaa", "abab" * 9, "é" * 5] + ["".join(rng.choice("ab cde") for _ in range(rng.randint(1, 400))) for _ in range(25)]
    for text in texts:
        names = [int(fingerprint._BYTE[b]) for b in text.encode()]
        found = []
        for level in range(1, 5):
            names = plain_next_level(names)
            found.append({(x >> 32) & ~1 | (level < 3) for x in names})
        want = found[2] | found[3]
        got = set(fingerprint.sketches(pa.array([text]))[0].tolist())
        assert got in (want, want | found[0] | found[1]), text


def test_quality_model(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.learn(docs, labels)
    rows = quality_model.classify(docs, model).join(labels, "doc_id").where(quality_model.held_out("doc_id")).collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95 and model.pairs
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    more = spark.createDataFrame([(1, None, "z"), (1, None, "z"), (None, "", "z"), (2, "word " * 40_000, "z")], "doc_id long, text string, score_source string")
    got = quality_model.classify(more, model).collect()
    assert len(got) == 4 and got[0].score == got[2].score and got[3].score < 0.7
    bounded = quality_model.learn(docs, labels, sample=50)
    assert len(bounded.tables) == len(quality_model.FEATURES)
    empty = quality_model.learn(docs.limit(0), labels.limit(0))
    assert quality_model.classify(docs.limit(0), empty).collect() == [] and quality_model.classify(more, empty).first().score == 0.5


def test_trees_and_scores_match_plain_versions():
    """Each step of the fit by brute force, and a score as the sum of its bins one by one."""
    import numpy as np

    rng = np.random.default_rng(5)
    g, h = rng.normal(size=9), rng.random(9) + 0.1
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    cuts = [0, 9]
    while len(cuts) <= quality_model.LEAVES:
        tried = [(gain(a, k) + gain(k, b) - gain(a, b), k) for a, b in zip(cuts, cuts[1:], strict=False) for k in range(a + 1, b)]
        if not tried or max(tried)[0] <= 1e-9:
            break
        cuts = sorted([*cuts, max(tried)[1]])
    want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 1)) for a, b in zip(cuts, cuts[1:], strict=False)])
    assert np.allclose(quality_model._tree(g, h), want)
    g2, h2 = rng.normal(size=(5, 4)), rng.random((5, 4)) + 0.1
    best = max(sum(g2[a, b].sum() ** 2 / (h2[a, b].sum() + 1) for a in (slice(0, i), slice(i, 5)) for b in (slice(0, j), slice(j, 4))) for i in range(1, 5) for j in range(1, 4))
    assert abs(quality_model._cross(g2, h2)[0] - best) < 1e-9
    n = len(quality_model.FEATURES)
    x = rng.normal(size=(200, n))
    model = quality_model.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, score in zip(x[:20], model.score(x[:20]), strict=True):
        at = [sum(e <= v for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_classifier_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5.0, "q"), (None, None, 6.0, "r")], "doc_id long, text string, score double, predicted string")
    model = quality_model.fit(quality_model.features(pa.array(["a b"])), __import__("numpy").array([1.0]))
    got = quality_model.classify(docs, model)
    assert got.dtypes == [("doc_id", "bigint"), ("text", "string"), ("score", "double"), ("predicted", "int")] and got.count() == 2
    kept = quality_model.classify(docs, model, named=("_s", "_p")).collect()
    assert sorted((r.score, r.predicted) for r in kept) == [(5.0, "q"), (6.0, "r")] and quality_model.scores(docs, model).count() == 2


def test_features_of_a_batch_are_those_of_each_text():
    texts = ["", "One two two. Three!", "a\na\n\nb #", None, "ÄÖ über 42 | x", "the the the of"]
    both = quality_model.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert (both[k] == quality_model.features(pa.array([t], pa.string()))[0]).all()


def test_chat_round_trip():
    for role in ("user", "assistant", "", "User", "a:b", "@x", "x\\y", "### z: ", "</turn>"):
        for text in ("", "\\", "\\### Assistant: </turn> ok", "a </turn>\n### User: b", "####", "\\\\###", "line\nline "):
            segment, a, b = chat_format.format_turn(role, text)
            assert chat_format.parse_turn(segment) == (role, text) and chat_format.unescape(segment[a:b]) == text
            assert segment.count("</turn>") - segment.count("\\</turn>") == 1


def test_chat_digests_and_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 2, "assistant", "B é"), (1, 1, "user", "a"), (1, 3, "assistant", None), (2, 0, "user", "only"), (3, None, "assistant", "late"), (3, 5, None, "x"), (3, 5, "user", "x"), (None, 1, "user", "n"), (4, 1, "user", "t"), (4, 1, "user", "t")]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, ix int")
    segments = chat_format.segments(turns)
    got = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        own = sorted(((t is None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said, loss = "".join(f"{r}\n{x}\n" for *_, r, x in own), "".join(x for *_, r, x in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {(r.conv_id, r.example): r for r in chat_format.examples(segments).collect()}
    assert set(whole) == {(1, 0), (1, 1), (3, 0)}
    first, second = whole[1, 0], whole[1, 1]
    assert first.text[first.loss_start : first.loss_end] == "B é" and second.text.startswith(first.text) and second.loss_start == second.loss_end
    assert chat_format.read_back(chat_format.segments(turns.limit(0))).collect() == []


def brute_scan(text, templates=license_scan.TEMPLATES):
    """Every block of every template, by sets."""
    words = license_scan.words_of(text)
    places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.encode().split()]
    wants = [(label, set(license_scan.words_of(t)), set(license_scan.words_of(names)), license_scan.block_span(len(license_scan.words_of(t)))) for label, t, names in templates]
    found = []
    for t, (label, want, names, span) in enumerate(wants):
        for a in range(len(words)):
            block = words[a : a + span]
            if want and words[a] in want and names <= set(block) and len(want & set(block)) / len(want) >= license_scan.CONTAINMENT - 1e-9:
                found.append((t, a, max(k for k, w in enumerate(block, a) if w in want), len(want & set(block)) / len(want)))
    kept = [m for m in found if not any(wants[m[0]][1] < wants[o[0]][1] and o[1] <= m[2] and m[1] <= o[2] for o in found)]
    labels = {label for _, label in places} | {wants[m[0]][0] for m in kept}
    score = 1.0 if places else max((m[3] for m in kept), default=0.0)
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score


def test_license_scan(spark):
    rng = random.Random(4)
    vocabulary = sorted({w.decode() for _, t, _ in license_scan.TEMPLATES[:12] for w in license_scan.words_of(t)})[::3] + ["mit", "license", "x", "é"] * 9
    names = "cc by nc sa nd 4 0 licensed under attribution noncommercial creative commons international work this is a license".split()
    texts = [None, "", "MIT-License mit license", "cc by cc by", "éapache license", "Apache\nLicense", "gnu general public license " * 3, "pad " * 30_000 + "Licensed under CC BY 4.0"]
    for _, template, _ in license_scan.TEMPLATES:
        words = template.split()
        texts += [template.upper(), " ".join(words[1:]), "pad " * 40 + template, "pad " * 130 + "\n".join(words), " ".join(w for k, w in enumerate(words) if k % 6), template[: len(template) // 2] + " pad" * 9 + template[len(template) // 2 :]]
    texts += [" ".join(rng.choice(v) for _ in range(rng.randint(1, 150))) for _ in range(30) for v in (vocabulary, names)]
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(texts)] + [(2, texts[2], 0, "x"), (None, "x", 0, "x")], "doc_id long, text string, score int, labels string")
    got = license_scan.scan(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert tuple(r)[1:-1] == brute_scan("x" if r.doc_id is None else texts[r.doc_id]), r
        text = license_scan.words_of("x" if r.doc_id is None else texts[r.doc_id])
        assert {s.label for s in r.spans} == set(filter(None, r.labels.split(","))) - set(r.base_labels.split(",")) or r.n_base
        assert all(0 <= s.first_word <= s.last_word < len(text) and s.share >= 0.8 for s in r.spans)
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_license_labels():
    """Notices of one license don't get another's label, and a template of any length is found."""
    index = license_scan.Index(license_scan.TEMPLATES, {}, license_scan.CONTAINMENT)
    labels = lambda text, own=index: sorted({own.templates[m.template].label for m in own.matches(license_scan.words_of(text))})
    assert labels("Released under the Apache License") == []
    assert labels("released under the BSD license") == ["bsd"]
    assert labels("Licensed under CC BY 4.0") == ["cc-by-4.0"]
    assert labels("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License") == ["cc-by-nc-4.0"]
    assert labels("Licensed under CC BY-NC-SA 4.0") == ["cc-by-nc-sa-4.0"]
    assert labels("The minister released a report under which the driver's license fee rises") == []
    assert labels("This work is licensed under the GNU Lesser General Public License, version 3") == ["lgpl-3.0"]
    for label, text, _ in license_scan.TEMPLATES:
        assert label in labels("some words before " + text + " and after"), text
    words = [f"w{k}" for k in range(150)]
    long = license_scan.Index((("own", " ".join(words), ""),), {}, 0.8)
    assert labels("x " * 77 + " ".join(words), long) == ["own"] and labels(" ".join(words[:119]), long) == [] and labels(" ".join(words[30:]), long) == ["own"]


def test_each_query_covers_its_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op7_token_counts", "op10_license_scan", "op3_quality_model"):
        got = registered.queries()[name](spark, sf_dir)
        assert got.select(F.countDistinct("doc_id")).first()[0] == docs == got.count()
