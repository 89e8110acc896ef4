import random

import pyarrow as pa

from rastrel.llm import fingerprint


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_long_texts_share_the_names_of_one_passage():
    rng = random.Random(4)
    passage = words(rng, 200)
    a, b, alone = fingerprint.sketches(pa.array([words(rng, 9000) + passage + words(rng, 9000), words(rng, 7000) + passage, passage]))
    shared = set(a.tolist()) & set(b.tolist()) & set(alone.tolist())
    assert len(shared) > len(alone) / 2 and 0 < fingerprint.likeness(a, b) < 0.05


def test_short_texts_stay_like_their_edited_copies():
    rng = random.Random(5)
    for _ in range(40):
        text, other = (words(rng, 40)[:45] for _ in range(2))
        own, edited = fingerprint.sketches(pa.array([text, text[:30] + other[:15]]))
        assert 0.2 < fingerprint.likeness(own, edited) < 1
    # A text around the bound is compared with a shorter one by the levels that both have.
    text = words(rng, 90)
    many, few = fingerprint.sketches(pa.array([text, text[:150]]))
    assert not (many & 1).any() and (few & 1).any() and 0.1 < fingerprint.likeness(many, few) < 1
