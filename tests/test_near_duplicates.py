"""Near-duplicate clusters against all pairs, recall at the threshold, and rows that stay linear in a large group."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitequarry.functions import text as tx
from sitequarry.operators import similarity


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é漢😀\n-_İß", max_size=80), st.integers(1, 4))
def test_signature_of_a_text(text, size):
    shingles = similarity.shingles_of(text, size)
    assert similarity.text_signature(text, size, 16) == (similarity.signature(shingles, 16) if shingles else None)
    if shingles:
        hashes = [[tx.fnv1a(s, b) for b in similarity.BASES] for s in shingles]
        assert similarity.signature(shingles, 16) == [min((a + i * b) % 2**32 for a, b in hashes) for i in range(16)]


def _docs(seed, families, each, words=80):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = [f"w{rng.randrange(3000)}" for _ in range(words)]
        for _ in range(each):
            own = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                own[rng.randrange(words)] = f"w{rng.randrange(3000)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def brute(texts, threshold, bands, rows, size=128):
    """Clusters by every pair that shares a band and reaches the threshold; texts that recur are left out."""
    own = {k: similarity.signature(s) for k, t in enumerate(texts) if texts.count(t) == 1 and (s := similarity.shingles_of(t, 5))}
    root = {k: k for k in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    same = lambda a, b: sum(x == y for x, y in zip(own[a], own[b], strict=True)) / size
    keys = sorted(own)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(own[a][k * rows : (k + 1) * rows] == own[b][k * rows : (k + 1) * rows] for k in range(bands)) and same(a, b) >= threshold:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).append(k)
    return {(c, k, int(1000 * min(same(a, b) for a in m for b in m) + 0.5) / 1000) for c, m in groups.items() if len(m) > 1 for k in m}


@pytest.mark.parametrize(("rows", "block"), [(None, 1024), (None, 4), (8, 3)])
def test_clusters_against_all_pairs(spark, rows, block):
    texts = _docs(block, 8, 9)
    bands, width = (16, 8) if rows else similarity.bands_of(128, 0.75)
    docs = spark.createDataFrame([(k, t, len(t.split())) for k, t in enumerate(texts)], "id long, text string, word_count int").withColumn("content_hash", F.sha2("text", 256))
    got = {tuple(r) for r in similarity.near_duplicates(docs, rows=rows, block=block).collect()}
    want = brute(texts, 0.75, bands, width)
    assert len({c for c, _, _ in want}) > 2 and got == want


def test_recall_at_the_threshold():
    """Pairs of sets of Jaccard similarity 0.75 whose estimate reaches it: at least nine of ten share a band."""
    bands, rows = similarity.bands_of(128, 0.75)
    assert 1 - (1 - 0.75**rows) ** bands >= 0.98
    rng, met, passed = random.Random(3), 0, 0
    for _ in range(250):
        common = [str(rng.random()) for _ in range(120)]
        one, two = (similarity.signature([*common, *(str(rng.random()) for _ in range(20))]) for _ in range(2))
        if sum(x == y for x, y in zip(one, two, strict=True)) >= 96:
            passed += 1
            met += any(one[k * rows : (k + 1) * rows] == two[k * rows : (k + 1) * rows] for k in range(bands))
    assert passed > 60 and met >= 0.9 * passed


def test_large_group_makes_linear_rows(spark):
    """6 000 signatures around one: joined by their buckets' least members; no bucket is left to compare in pairs of blocks."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**32, 128)
    sig = np.repeat(base[None, :], 6_000, axis=0)
    for row in sig:
        row[rng.integers(0, 128, 8)] = rng.integers(0, 2**32, 8)
    classes = spark.createDataFrame([(k, [int(x) for x in s]) for k, s in enumerate(sig)], "id long, sig array<long>").repartition(4)
    done = similarity.linked_classes(classes, 0.75)
    assert done.count() == 6_000 and done.select("component").distinct().count() == 1


def test_copies_of_one_signature(spark):
    """Texts that differ only in signs have one signature: a cluster of similarity 1, told in one row a page."""
    texts = [f"some words that are the same for all of them here{'!' * k}" for k in range(40)] + ["nothing like the others at all in any way here"]
    docs = spark.createDataFrame([(f"p{k:02d}", t, len(t.split()), t) for k, t in enumerate(texts)] + [("x", None, 0, None), ("y", "", 0, "")], "id string, text string, word_count int, content_hash string")
    got = similarity.near_duplicates(docs).collect()
    assert {tuple(r) for r in got} == {("p00", f"p{k:02d}", 1.0) for k in range(40)}
    assert similarity.near_duplicates(docs.limit(0)).collect() == []
