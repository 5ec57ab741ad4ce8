"""The near-copy stage of the pipeline against brute-force Jaccard groups."""

from __future__ import annotations

import random

import pytest
from test_corpus import SF, docs_of, near_texts, prose



def brute_jaccard_kept(texts, words=5, least=0.8):
    """The smallest id of each group joined by pairs of that similarity, over exact shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i for i in sets if find(i) == i}


def jaccard_texts():
    rng = random.Random(9)
    out = near_texts(4, 25)
    dense = prose(rng, 120)
    for _ in range(50):  # a dense group: many values that more than LARGE classes share
        words = dense.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = rng.choice(["other", "changed", "new"])
        out.append(" ".join(words))
    passage = prose(rng, 30)  # in many texts that are no near copies, and in a few that nearly are
    out += [f"{prose(rng, rng.choice([5, 8, 40]))} {passage}" for _ in range(40)]
    return out


def test_near_copy_stage_equals_brute_force_jaccard(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = dict(enumerate(jaccard_texts()))
    got = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs_of(spark, list(texts.values())), SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_jaccard_kept(texts)


def test_a_dense_group_around_the_bound(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(120):  # pairs of similarity 0.5 to 1: some join in chains, some stay alone
        words = list(base)
        for k in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    want = brute_jaccard_kept(dict(enumerate(texts)))
    assert 1 < len(want) < 100
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs_of(spark, texts), SF).collect()} == want


def test_parities_and_bands_bound_the_difference():
    import numpy as np

    from sitequarry.llm import jaccard

    rng = np.random.default_rng(3)
    factors = rng.integers(0, 1 << 63, jaccard.BANDS * jaccard.DEEP, np.uint64) * 2 + 1
    for _ in range(60):
        both = rng.integers(-(1 << 63), 1 << 63, rng.integers(1, 400))
        a, b = (np.unique(np.concatenate([both, rng.integers(-(1 << 63), 1 << 63, rng.integers(0, 80))])) for _ in range(2))
        odd = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(jaccard.parity_of(a), jaccard.parity_of(b), strict=True))
        apart = len(np.setxor1d(a, b))
        assert odd <= apart and (apart - odd) % 2 == 0
        assert jaccard.bands_of(a, factors) == jaccard.bands_of(a.copy(), factors) and len(jaccard.bands_of(b, factors)) == jaccard.BANDS


def test_near_copy_stage_on_the_given_documents(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_jaccard_kept({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()} == want


def test_the_simhash_search_proposes_the_close_ones(spark):
    import numpy as np

    from sitequarry.llm import jaccard, simhash

    texts = [t for t in jaccard_texts() if t and t.split()]
    sets = {i: jaccard.shingle_set(t) for i, t in enumerate(texts)}
    fps = {i: simhash.vote(s) for i, s in sets.items()}
    assert all(fps[i] == simhash.fingerprint(t, 5) for i, t in enumerate(texts) if len(sets[i]) == max(1, len(t.encode().lower().split()) - 4))
    got = {(r.a, r.b) for r in simhash.near_sets(spark.createDataFrame(list(fps.items()), "id long, fp long"), 3).collect()}
    first = {}
    for i in sorted(fps):
        first.setdefault(fps[i], i)
    own = sorted(set(first.values()))
    want = {(a, b) for k, a in enumerate(own) for b in own[k + 1 :] if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= 3} | {(first[f], i) for i, f in fps.items() if first[f] != i}
    assert got == want and want


def test_odd_tables(spark):
    from sitequarry.llm import jaccard

    rows = [(5, None), (None, ""), (3, " "), (None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (9, "other text that is one of a kind"), (None, "alone without an id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, label string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, " "), (9, "a b c d e f"), (9, "other text that is one of a kind"), (None, "alone without an id")], key=str)
    assert jaccard.keep_one(df.limit(0)).count() == 0
