"""The extractor over pages made of documents: every fact that the SQL states."""

from __future__ import annotations

import duckdb
import pytest

from sitequarry.plans import markup
from sitequarry.sources.extract import extract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def facts(spark):
    out = extract(markup.raw_pages(spark.read.parquet(f"{SF}/documents.parquet"))).cache()
    yield out
    out.unpersist()


@pytest.mark.parametrize("name", sorted(markup.FACTS))
def test_facts_equal_their_sql(facts, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    columns = markup.FACTS[name][0]()
    want = con.sql(markup.checks()[f"markup_{name}"][1]).select("k", *columns).fetchall()
    got = [tuple(r) for r in facts.select("k", *[c.alias(n) for n, c in columns.items()]).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) == 200


def test_rules_over_extracted_facts(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = {tuple(r) for r in markup.rule_hits(spark, SF).select("k", "rule_id").collect()}
    assert got == set(con.sql(markup.RULE_SQL).fetchall()) and len({r for _, r in got}) == len(markup.RULES)
