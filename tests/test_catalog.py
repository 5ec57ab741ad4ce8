"""Queries over the raw pages that no SQL holds."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rule_issue_counts", "site_rule_counts", "health_score", "worst_pages", "findings_priority", "run_measurements", "page_rank"])
def test_queries_over_the_run_of_raw_pages_give_rows(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0
