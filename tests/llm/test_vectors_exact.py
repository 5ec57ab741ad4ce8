"""The exact way of op6_vectors, taken where the audit stays below its bound."""

from __future__ import annotations

import numpy as np
import pytest
from test_corpus import brute_links, vector_rows

from sitequarry.llm import vectors


@pytest.mark.parametrize("shard", [40, 2000])
def test_a_low_audit_ends_in_an_exact_search(spark, monkeypatch, shard):
    find = vectors._find

    def poor(*args):
        counts, edges = find(*args)
        return counts.limit(0), edges.limit(0)

    monkeypatch.setattr(vectors, "_find", poor)
    rows = [r for r in vector_rows(7, n=200) if not (r[1] and any(x and abs(x) in (1e300, 2e300, 1e-200) for x in r[1]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, recall = vectors.near_vectors(df, shard=shard)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert recall == 1.0 and got == brute_links(rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, -1.0], 1), (5, [0.01, 1.0], 1), (5, [0.01, 1.0], 1), (None, None, 1), (7, [-0.0, 3.0], 1)]
    out = vectors.op6(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 3, 1, True), (None, 1, 1, False), (None, 0, None, False), (5, 3, 1, False), (5, 3, 1, False), (None, 0, None, False), (7, 3, 1, False)], key=str)


def test_a_large_label_among_many_is_cut(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v], 0 if i < 1200 else i) for i, v in enumerate(rng.normal(size=(2000, 4)))]
    classes = vectors.classes_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label")
    large = classes.groupBy("label").count().withColumnRenamed("count", "size").where("size > 100")
    assert {k: len(v) for k, v in vectors.centroids(classes, large, 100).items()} == {"4|0": 12}
