"""Substring search by trigrams against a scan of all rows, and the folders that a search reads."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sitequarry.operators import explore, search


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "Ünder", "漢字", "shop", "x%y_z", "🙂", "a'b"]
    rows = [(k, f"https://e.com/{rng.choice(words)}/{k}", None if k % 9 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))) for k in range(600)]
    return spark.createDataFrame(rows, "page_id long, url string, title string"), rows


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return search.build(table[0], str(tmp_path_factory.mktemp("index") / "i"), buckets=8, shelves=8)


@pytest.mark.parametrize("sought", ["alpha", "ALPHA/5", "beta 漢", "漢字", "ünder", "x%y", "_z", "/59", "🙂 a", "https://e.com/", "none of them", "a", "é", "a'b"])
def test_search_equals_a_scan(spark, index, table, sought):
    want = {k for k, u, t in table[1] if sought.lower() in u.lower() or sought.lower() in (t or "").lower()}
    assert {r.page_id for r in index.search(spark, sought).collect()} == want
    rows = table[0].withColumns({"status_class": F.lit("2xx"), "words": F.lit(1)})
    assert {r.page_id for r in explore.filter_pages(rows, q=sought, index=index).collect()} == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_buckets_with_candidates_are_read(spark, index, table):
    """One candidate: the scan of rows is filtered to its bucket, those of lists and counts to the shelves of the trigrams."""
    k, url, _ = table[1][77]
    found = index.search(spark, url)
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", _plan(found))
    assert any(re.search(r"bucket#\d+ = \d+", f) for f in filters) and any("shelf" in f for f in filters)
    assert [r.page_id for r in found.collect()] == [k]


def test_page_by_id_reads_one_bucket(spark, index, table):
    one = index.page(spark, 77)
    assert [r.url for r in one.collect()] == [table[1][77][1]]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", _plan(one)) and "EqualTo(page_id,77)" in _plan(one)
    assert index.page(spark, 10_000).collect() == []


def test_empty_index(spark, table, tmp_path):
    own = search.build(table[0].limit(0), str(tmp_path / "e"), buckets=2, shelves=2)
    assert own.search(spark, "alpha").collect() == [] == own.search(spark, "a").collect()
