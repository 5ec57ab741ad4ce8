"""Tables of a run that grow with it are not joined by broadcasts, which go through the driver, whatever the size of their files says."""

import duckdb
import pytest

from sitequarry.operators import measurements
from sitequarry.operators.site_rules import Site
from sitequarry.plans import derived
from sitequarry.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def site(spark):
    return derived.site(spark.read.parquet(f"{SF}/part.parquet"), spark.read.parquet(f"{SF}/lineitem.parquet"))


@pytest.mark.parametrize("of", [measurements.summary, measurements.measurements])
def test_small_files_are_joined_by_sorted_shuffles(site, of):
    plan = of(site)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_a_run_may_lack_all_but_its_pages(site):
    assert Site(site.pages).failures is None


@pytest.mark.parametrize("name", ["site_rules_on_parts", "run_summary", "derived_measurements"])
def test_results_are_those_of_the_sql(spark, name):
    own = duckdb.connect()
    for table in ("part", "lineitem"):
        own.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = sorted(own.execute(SQL[name]).fetchall(), key=str)
    assert sorted((tuple(r) for r in QUERIES[name](spark, SF).collect()), key=str) == want
