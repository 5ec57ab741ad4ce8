"""The cosine band against all pairs, its audit, and link opportunities against a plain computation."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitequarry.operators import cosine, linking


def _clustered(n, dims, seed, spread):
    """Vectors around a few centres: many pairs fall into the band."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(2, n // 40), dims))
    return centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dims))


def _table(spark, matrix):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(matrix)], "id long, v array<double>")


def brute(matrix, low, high):
    u = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    c = u @ u.T
    return {(i, j): c[i, j] for i in range(len(u)) for j in range(i + 1, len(u)) if low - 1e-12 <= c[i, j] < high}


def test_plan_of_tables():
    assert cosine.plan_tables(2048, 0.78, 0.95) == (0, 1)
    bits, tables = cosine.plan_tables(100_000, 0.78, 0.95)
    meet = (1 - math.acos(0.78) / math.pi) ** bits
    assert bits == 6 and 1 - (1 - meet) ** tables >= 0.95 > 1 - (1 - meet) ** (tables - 1)


@pytest.mark.parametrize(("n", "block"), [(300, 2048), (300, 64), (900, 64)])
def test_band_against_all_pairs(spark, n, block):
    m = _clustered(n, 24, n, 0.5)
    classes, members = cosine.unit_classes(_table(spark, m), "id", "v")
    want = brute(m, 0.78, 0.85)
    assert len(want) > 100
    rows = cosine.cosine_band(classes, block=block).collect()
    got = {(r.a, r.b): r.cosine for r in rows}
    assert len(got) == len(rows), "a pair is given once"
    assert set(got) <= set(want) and all(abs(c - want[p]) < 1e-9 for p, c in got.items())
    assert len(got) >= 0.9 * len(want) and (block < n or set(got) == set(want))
    exact = {(r.a, r.b) for r in cosine.all_pairs(classes, 0.78, 0.85, block).collect()}
    assert exact == set(want)
    report = cosine.audit(classes, cosine.cosine_band(classes, block=block), sample=10 * n).first()
    assert (report.asked, report.present, report.found, report.wrong) == (n, len(want), len(got), 0)


def test_hot_bucket_is_cut_into_blocks(spark):
    """All rows around one direction: the first tables hold them in one bucket."""
    rng = np.random.default_rng(1)
    m = np.ones(16) + 0.5 * rng.standard_normal((400, 16))
    classes, _ = cosine.unit_classes(_table(spark, m), "id", "v")
    want = brute(m, 0.78, 0.85)
    pairs, recall = cosine.audited_band(classes, block=32)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert recall >= 0.9 and got <= set(want) and len(got) >= 0.85 * len(want)


def test_classes_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (8, [float("inf"), 1.0]), (9, [0.0, 1.0])]
    classes, members = cosine.unit_classes(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e")
    assert {(r.member, r.id) for r in members.collect()} == {(1, 1), (2, 1), (9, 9)}
    assert {r.id for r in classes.collect()} == {1, 9}
    empty, _ = cosine.unit_classes(spark.createDataFrame([], "vec_id long, e array<double>"), "vec_id", "e")
    assert cosine.cosine_band(empty).collect() == [] and cosine.audit(empty, cosine.cosine_band(empty)).first().recall == 1.0


def test_shared_queries(spark):
    rows = [(1, "q", 10, 2.0), (1, "q", 10, 4.0), (2, "q", 5, 1.0), (3, "q", 5, 1.0), (1, "r", 1, 1.0), (2, "r", 1, 9.0), (4, "s", 0, 1.0), (None, "q", 5, 1.0), (5, None, 5, 1.0)]
    got = linking.shared_queries(spark.createDataFrame(rows, "page_id long, query string, impressions long, position double")).collect()
    assert {tuple(r) for r in got} == {(1, 2, 1), (3, 2, 1), (2, 1, 1)}


def test_opportunities(spark):
    pages = [(1, True, 80, 0.5), (2, True, 20, None), (3, False, 100, 1.0), (4, True, None, 0.0), (5, True, 50, 0.9)]
    edges = [(1, 2), (1, 2), (2, 2), (4, 5)]
    mentions = [(1, 2, 3, 0.1), (1, 5, 2, 0.5), (2, 5, 1, 0.0), (1, 3, 9, 0.0), (5, 5, 1, 0.0)]
    similar = [(1, 5, 0.82), (4, 5, 0.84), (5, 4, 0.84), (2, 1, 0.90), (3, 1, 0.80)]
    queries = [(1, 5, 4), (2, 4, 1)]
    frame = spark.createDataFrame
    got = linking.opportunities(
        frame(pages, "page_id long, linkable boolean, score int, value double"), frame(edges, "src long, dst long"), frame(mentions, "source_id long, target_id long, mentions long, first_place double"),
        frame(similar, "source_id long, target_id long, cosine double"), frame(queries, "source_id long, target_id long, queries long"), most=2,
    ).collect()
    links = {(a, b) for a, b in edges if a != b}
    fact, inl, outl = {p[0]: p for p in pages}, Counter(b for _, b in links), Counter(a for a, _ in links)
    pairs = defaultdict(lambda: [None, None, None, None])
    for s, t, n, at in mentions:
        pairs[s, t][0:2] = n, at
    for s, t, c in similar:
        pairs[s, t][2] = c
    for s, t, q in queries:
        pairs[s, t][3] = q
    want = defaultdict(list)
    for (s, t), (n, at, c, q) in pairs.items():
        if s == t or (s, t) in links or not fact[t][1]:
            continue
        need = 1 - math.log1p(min(inl[t], 40)) / math.log1p(40)
        rel = 0.5 * (min(1, max(0, (c - 0.78) / 0.07)) if c is not None else 0) + ((c is not None) + bool(n) + bool(q)) / 6
        auth = (fact[s][2] or 0) / 100 / (1 + outl[s] / 100)
        place = 1 - 0.5 * at if n else 0.25
        want[t].append((-round(0.25 * need + 0.2 * (fact[t][3] or 0) + 0.3 * rel + 0.15 * auth + 0.1 * place, 6), s))
    assert {(r.target_id, r.source_id, r.score, r.place) for r in got} == {(t, s, -x, k) for t, own in want.items() for k, (x, s) in enumerate(sorted(own)[:2], 1)}


def test_pairs_run_both_ways_for_all_members(spark):
    pairs = spark.createDataFrame([(1, 2, 0.8)], "a long, b long, cosine double")
    members = spark.createDataFrame([(1, 1), (11, 1), (2, 2)], "member long, id long")
    assert {tuple(r)[:2] for r in linking.both_ways(pairs, members).collect()} == {(1, 2), (2, 1), (11, 2), (2, 11)}
    assert linking.both_ways(pairs).count() == 2 and F is not None
