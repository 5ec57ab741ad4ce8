"""How many pairs the last join of the near-copy stage makes, and that it is what completes the links."""

from __future__ import annotations

import random

import pytest
from test_corpus import docs_of, prose
from test_near_copies import brute_jaccard_kept


@pytest.fixture
def told(monkeypatch):
    """Rows of pairs that each comparison hands on: the stars first, the rest last."""
    from sitequarry.llm import jaccard

    rows, enough = [], jaccard._enough

    def counted(pairs, least):
        rows.append(pairs.count())
        return enough(pairs, least)

    monkeypatch.setattr(jaccard, "_enough", counted)
    return rows


def test_groups_too_small_for_bands_make_no_squares(spark, told):
    from sitequarry.llm import jaccard

    rng = random.Random(5)
    texts = []
    for _ in range(15):  # near copies whose fingerprints are further apart than the search proposes
        base = prose(rng, 90).split()
        for _ in range(14):
            words = list(base)
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    for _ in range(12):  # a passage that dissimilar texts share
        passage = prose(rng, 12)
        texts += [f"{passage} {prose(rng, 6)} own{rng.randrange(10**6)} {prose(rng, 6)}" for _ in range(12)]
    got = {r.doc_id for r in jaccard.keep_one(docs_of(spark, texts)).collect()}
    assert got == brute_jaccard_kept(dict(enumerate(texts)))
    # groups of 14 are compared in stars; what is left is less than two rows for each pair of a group
    assert told[0] and told[-1] < 2 * 15 * 14 * 13 / 2


def test_links_that_neither_search_nor_stars_find_are_found_by_the_last_join(spark, told, monkeypatch):
    from sitequarry.llm import jaccard

    rng = random.Random(6)
    base = prose(rng, 60).split()
    pairs = []
    for k in range(20):  # two near copies of a text of their own: no value has members enough for a star
        one = prose(rng, 60).split()
        two = list(one)
        two[rng.randrange(len(two))] = f"edit{k}"
        pairs += [" ".join(one), " ".join(two)]
    texts = [*pairs, " ".join(base)]
    monkeypatch.setattr(jaccard, "near_sets", lambda rows, radius: spark.createDataFrame([], "a long, b long"))
    want = brute_jaccard_kept(dict(enumerate(texts)))
    assert len(want) < len(texts)
    assert {r.doc_id for r in jaccard.keep_one(docs_of(spark, texts)).collect()} == want and told[-1]


def test_long_texts_that_share_much_but_too_little_leave_the_last_join_a_few_times_only(spark, told):
    from sitequarry.llm import jaccard

    rng = random.Random(7)
    texts = []
    for _ in range(3):  # similarity about 0.7: parities of sets this long say nothing, so every pair is made
        base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        for _ in range(8):
            words = list(base)
            for _ in range(27):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        for _ in range(2):  # and one text that is nearly the last
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    want = brute_jaccard_kept(dict(enumerate(texts)))
    assert len(want) == 3 * 8
    assert {r.doc_id for r in jaccard.keep_one(docs_of(spark, texts)).collect()} == want
    pairs = 3 * 10 * 9 // 2
    assert told[-1] <= 6 * pairs, told
