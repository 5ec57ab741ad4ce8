"""A round of ranks joins lists of links, a row for each node and not for each link; hubs are cut into several lists."""

import duckdb

from sitequarry.operators import graph
from sitequarry.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_links_come_in_lists_and_hubs_in_several(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST", 100)
    links = spark.range(3000).selectExpr("0L as src", "id + 1 as dst").union(spark.range(1, 51).selectExpr("id as src", "0L as dst"))
    lists = graph.link_lists(links).collect()
    hub = [x for x in lists if x.src == 0]
    assert {x.out for x in hub} == {3000} and sorted(d for x in hub for d in x.to) == list(range(1, 3001))
    assert 20 <= len(hub) <= 30 and max(len(x.to) for x in hub) < 200
    assert sorted((x.src, x.out, *x.to) for x in lists if x.src) == [(k, 1, 0) for k in range(1, 51)]


def test_nodes_may_be_those_that_edges_name(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (1, 2), (4, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "id long")
    got, want = ({r.id: r.rank for r in graph.pagerank(n, edges).collect()} for n in (None, nodes))
    assert got.keys() == want.keys() == {1, 2, 3, 4} and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_rank_traders_gives_the_rows_of_its_sql(spark):
    own = duckdb.connect()
    for name in ("orders", "lineitem"):
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = dict(own.execute(SQL["rank_traders"]).fetchall())
    assert {r.id: r.rank for r in QUERIES["rank_traders"](spark, SF).collect()} == want
