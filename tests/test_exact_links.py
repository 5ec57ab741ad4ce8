"""Links by cosine as queries: every pair, also where the rows fill several buckets."""

import numpy as np
import pandas as pd

import __spark_entry__


def test_cosine_links_over_more_rows_than_a_bucket_are_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(5)
    e = (rng.standard_normal((40, 64))[rng.integers(0, 40, 5000)] + 1.2 * rng.standard_normal((5000, 64))).astype(np.float32)
    spark.createDataFrame(pd.DataFrame({"vec_id": range(len(e)), "embedding": e.tolist()}), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = e.astype(float)
    sums = np.add.reduce([v[k : len(v) - 4 + k] for k in range(5)])  # pages 0 to n - 5; the last four have fewer vectors
    sums = np.concatenate([sums, [v[k:].sum(axis=0) for k in range(len(v) - 4, len(v))]])
    unit = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    cosine = np.triu(unit @ unit.T, 1)
    a, b = np.nonzero((cosine >= 0.78) & (cosine < 0.85))
    got = {(r.a, r.b) for r in __spark_entry__.queries()["cosine_links"](spark, str(tmp_path)).collect()}
    assert got == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) > 300
