"""The derived crawl uses all cores, and a comparison of two sets of its issues evaluates the rules once."""

from sitequarry.plans import derived
from sitequarry.plans.catalog import Tables

SF = "/root/testdata/sf0.001"


def test_parts_of_one_file_are_dealt_over_all_cores(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").coalesce(1)
    assert derived.pages(part).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_issue_changes_evaluates_the_rules_once(spark, monkeypatch):
    issues, calls = derived._issues, []
    monkeypatch.setattr(derived, "_issues", lambda t: calls.append(t) or issues(t))
    got = derived.CHECKS["issue_changes"][0](Tables(spark, SF))
    assert {r.change for r in got.select("change").distinct().collect()} == {"persisting", "resolved", "new"} and len(calls) == 1
