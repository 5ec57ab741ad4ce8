"""The crawl derived from the tables, structured-data subtypes, and phrases of link suggestions."""

from __future__ import annotations

import duckdb
import pytest

from sitequarry.operators import graph
from sitequarry.plans import derived
from sitequarry.plans.catalog import Tables
from sitequarry.sources import crawl, schema_org

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["page_rules_on_parts", "site_rules_on_parts", "worst_derived_pages"])
def test_rules_find_the_pages_that_sql_says(spark, name):
    con = duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    run, sql = derived.CHECKS[name]
    got = run(Tables(spark, SF))
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


def test_subtypes_have_their_parents_profile():
    assert {k: schema_org.profile_of(k) for k in ("Plumber", "Hostel", "FundingScheme", "LibrarySystem", "VideoGame", "Product", "CollectionPage")} == {
        "Plumber": "LocalBusiness", "Hostel": "LocalBusiness", "FundingScheme": "Organization", "LibrarySystem": "Organization", "VideoGame": "SoftwareApplication", "Product": "Product", "CollectionPage": None,
    }
    assert all(parent in schema_org.PROFILES for parent in schema_org.SUBTYPES)


def test_link_suggestions_by_phrase(spark):
    rows = [("a", "We sell Blue  Widgets, and gears."), ("b", "blue, widgets!"), ("c", "widgets that are blue"), ("d", None)]
    pages = crawl.complete(spark.createDataFrame(rows, "page_id string, t string").selectExpr("page_id", "concat('https://x.org/', page_id) AS url", "named_struct('text', t, 'word_count', 1, 'content_hash', '', 'area_method', '', 'aria_hidden_words', 0) AS content", "cast(array() AS array<struct<target: string, target_normalized: string, anchor: string, type: string, rel: string, nofollow: boolean, sponsored: boolean, ugc: boolean, target_attr: string>>) AS links"))
    phrases = spark.createDataFrame([("z", "blue widgets"), ("z", "gears"), ("c", "Widgets"), ("y", "")], "target_id string, phrase string")
    got = {(r.target_id, r.page_id, r.mentions) for r in graph.link_suggestions(pages, phrases).collect()}
    assert got == {("z", "a", 2), ("z", "b", 1), ("c", "a", 1), ("c", "b", 1)}
