"""The exact check after the graph search: links that the search misses and the audit would let pass are found."""

from test_corpus import brute_links, vector_rows

from sitequarry.llm import vectors


def test_the_check_finds_what_the_search_misses(spark, monkeypatch):
    find = vectors._find

    def poor(*args):
        counts, edges = find(*args)
        return counts.limit(0), edges.limit(0)

    monkeypatch.setattr(vectors, "_find", poor)
    monkeypatch.setattr(vectors, "audit", lambda *args: 0.96)
    rows = [r for r in vector_rows(7, n=200) if not (r[1] and any(x and abs(x) in (1e300, 2e300, 1e-200) for x in r[1]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, _ = vectors.near_vectors(df, complete=True)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()} == brute_links(rows)
