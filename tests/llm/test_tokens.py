import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastrel.llm import bpe, packing, token_counts
from rastrel.llm._io import materialise

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    letters = "ab'sdtlXÉ 12\n\t,.!é漢\u00a0\u3000🙂İΣ̈"
    out = [None, "", " ", "a  b", "a ", " a", "a\n\nb c", "\n\n x", "don't stop", "a" * 3000, "x<|endoftext|>y", "Word, word. WORD"]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(400)]


def docs_of(spark):
    rows = [(k, t, 0) for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", 0)], "doc_id long, text string, ids int")


def test_bpe_equals_rank_merging(spark, reference):
    got = {r.doc_id: r.ids for r in bpe.encode_documents(docs_of(spark), RANKS, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(texts()):
        assert got[k] == reference.encode_ordinary(t or ""), t


def test_bpe_round_trip(spark, reference):
    rows = bpe.round_trip(docs_of(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts()) + 2
    for r in rows:
        text = "null id" if r.doc_id is None else texts()[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs_of(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.data).decode() == ("null id" if r.doc_id is None else texts()[r.doc_id] or "") for r in back)


def test_prefix_table_appends_and_edits():
    vocabulary = bpe.codec(RANKS, public_tokenizers.PATTERN).vocabulary
    rng = random.Random(2)
    table = bpe.PrefixEncoder(vocabulary)
    text = b""
    for _ in range(60):
        if text and rng.random() < 0.4:
            at, gone, new = rng.randint(0, len(text)), rng.randint(0, 4), rng.choice([b"", b"the", b"ing x"])
            table.edit(at, gone, new)
            text = text[:at] + new + text[at + gone :]
        else:
            new = rng.choice([b"a", b" there", b"tion", b"\xc3\xa9", b"  "])
            table.append(new)
            text += new
        assert table.text == text and table.ids() == bpe.PrefixEncoder(vocabulary, text).ids()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_follow_the_rule(spark, reference, rule):
    rows = token_counts.count_tokens(docs_of(spark), RANKS, public_tokenizers.PATTERN, rule=rule).collect()
    for r in rows:
        raw = ("null id" if r.doc_id is None else texts()[r.doc_id] or "").encode()
        owner = [raw[:k].count(b"\n") for k in range(len(raw))]  # a line has its newline
        want, crossing, at = [0] * (max(owner, default=-1) + 1), 0, 0
        for token in reference.encode_ordinary(raw.decode()):
            size = len(reference.decode_single_token_bytes(token))
            own = owner[at : at + size]
            crossing += own[0] != own[-1]
            want[own[0] if rule == "start" else max(sorted(set(own)), key=own.count)] += 1
            at += size
        assert (r.section_tokens, r.n_crossing, r.n_tokens, r.n_sections) == (want, crossing, sum(want), len(want)), raw


def test_counts_by_listed_sections(spark):
    rows = [(1, "héllo world", [5, 6]), (2, "abc", None), (3, None, [2]), (4, "ab", [1, 9]), (5, "", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ends array<int>")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN, sections_col="ends").collect()}
    assert all(sum(r.section_tokens) == r.n_tokens for r in got.values() if r.n_tokens)
    assert [len(got[k].section_tokens) for k in range(1, 6)] == [3, 1, 1, 2, 0] and got[1].section_tokens[1:] == [0, 1]


def test_packing(spark):
    whole = Tokenizer.from_file(WORDS)
    rows = [*enumerate(texts()), (900, "word " * 5000), (900, "word " * 5000), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    got = packing.pack_documents(docs, WORDS).collect()
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    by_sequence, by_row = {}, {}
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(part), r.ids_crc32, r.start) == (r.length, zlib.crc32(part.tobytes()), 2048 * r.piece)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_row[r.doc_id] = by_row.get(r.doc_id, 0) + r.length
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    times = {i: sum(j == i for j, _ in rows) for i, _ in rows}
    assert by_row == {i: len(x) * times[i] for i, x in ids.items()}
    assert len(by_sequence) <= -(-sum(by_row.values()) // 2048) + 1
    assert packing.pack_documents(docs.limit(0), WORDS).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.sort(np.random.default_rng(1).integers(1, 400, 500))[::-1]
    capacity = packing.Capacity(1000, 5, 200_000)
    bins, offsets = packing.best_fit(lengths, capacity, rule=rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 5 and (own**2).sum() <= 200_000
        assert sorted(offsets[bins == b]) == sorted(np.r_[0, np.cumsum(own)[:-1]])
    with pytest.raises(ValueError):
        packing.best_fit(np.array([2000]), capacity)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_choice_of_bin_matches_a_plain_version(rule):
    """Every piece goes to the bin that a search over all bins of any age would choose."""
    capacity, weights = packing.Capacity(1000, 6, 300_000), (1.0, 0.05, 0.05)
    lengths = np.sort(np.random.default_rng(4).integers(1, 500, 250))[::-1]
    got, _ = packing.best_fit(lengths, capacity, weights, rule)
    full = np.array(capacity, float)
    bins: list[np.ndarray] = []
    for size, own in zip(lengths, got, strict=True):
        need = np.array([size, 1.0, float(size) ** 2])
        fits = [k for k, room in enumerate(bins) if (room >= need).all()]
        if not fits:
            assert own == len(bins)
            bins.append(full.copy())
        else:
            cost = {k: -(bins[k] * need * weights / full**2).sum() if rule == "dot" else (((bins[k] - need) / full) ** 2 * weights).sum() for k in fits}
            assert abs(cost[own] - min(cost.values())) < 1e-12
        bins[own] -= need


def test_rows_without_id_are_dealt_out(spark):
    """Pieces of one id, or of none, go to many tasks."""
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 50 + 1).alias("length"), F.col("id").alias("offset"))
    got = packing.pack(materialise(rows, "test"), pieces_a_task=300).select("sequence_id", "length").collect()
    assert len({r.sequence_id >> 32 for r in got}) >= 8 and sum(r.length for r in got) == sum(k % 50 + 1 for k in range(3000))


def test_edits_stop_where_the_table_agrees_again():
    vocabulary = bpe.codec(RANKS, public_tokenizers.PATTERN).vocabulary
    text = b" ".join(b"word%d and some more text" % (k % 7) for k in range(400))
    table = bpe.PrefixEncoder(vocabulary, text)
    made = table.edit(100, 3, b"xyz q")
    assert made < len(text) / 4 and table.ids() == bpe.PrefixEncoder(vocabulary, text[:100] + b"xyz q" + text[103:]).ids()


def test_counts_by_fields(spark, reference):
    rows = [(1, "A title", "body text\nof two lines", 3), (2, None, "only", 0), (3, "", None, 0), (1, "A title", "body text\nof two lines", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, ends int")
    got = token_counts.count_fields(docs, RANKS, public_tokenizers.PATTERN, ["title", "body"]).collect()
    assert len(got) == 4
    for r in got:
        _, title, body, _ = rows[r.doc_id - 1]
        whole = (title or "") + "\n" + (body or "")
        assert r.n_tokens == len(reference.encode_ordinary(whole)) == sum(r.field_tokens.values()) and list(r.field_tokens) == ["title", "body"]
    assert token_counts.count_fields(docs.limit(0), RANKS, public_tokenizers.PATTERN, ["title"]).collect() == []
