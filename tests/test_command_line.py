"""The command line over a stored run."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sitequarry.__main__ import main
from sitequarry.sources import crawl, issues, sinks

PAGE = "<html><head><title>{t}</title></head><body><main><h1>{t}</h1><p>{w}</p><a href='/b'>next page of all</a><a href='/c'>third</a></main></body></html>"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    rows = [(k, f"https://e.com/{p}", PAGE.format(t=t, w=w)) for k, (p, t, w) in enumerate([("", "Home", "word " * 90), ("b", "B", "few"), ("c", "B", "few")])]
    pages = crawl.from_html(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumns({"status_code": F.lit(200), "depth": F.lit(0)})
    (folder / "pages").mkdir()
    for r in pages.toJSON().collect():
        page = json.loads(r)
        (folder / "pages" / f"{page['page_id']}.json").write_text(r)
    (folder / "pages" / "bad.json").write_text("{")
    return str(folder)


def test_analyze(spark, run, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"rules": {"thin-content": {"severity": "error"}, "og-missing": {"enabled": False}}}))
    assert main(["analyze", run, str(tmp_path / "out"), "--config", str(tmp_path / "config.json")], spark) == 0
    found = issues.read_issues(spark, str(tmp_path / "out" / "issues.json")).collect()
    report = issues.read_report(spark, str(tmp_path / "out" / "issues.json"))
    rules = {r.rule_id for r in found}
    assert {"thin-content", "duplicate-title", "canonical-absent"} <= rules and "og-missing" not in rules
    assert {r.severity for r in found if r.rule_id == "thin-content"} == {"error"}
    assert 0 < report["healthScore"] <= 100 and sum(report["counts"].values()) == len(found)
    assert spark.read.parquet(str(tmp_path / "out" / "graph")).count() == 3


def test_other_commands(spark, run, tmp_path):
    out = str(tmp_path / "out")
    assert main(["graph", run, out], spark) == main(["fixplan", run, out], spark) == main(["automation", run, out], spark) == main(["diff", run, run, out], spark) == 0
    assert spark.read.parquet(f"{out}/edges").count() == 4
    assert spark.read.parquet(f"{out}/fixplan").where("rule_id = 'canonical-absent'").count() == 3
    assert spark.read.parquet(f"{out}/automation").count() > 3
    with pytest.raises(SystemExit):
        main(["nonsense"], spark)


def test_raw_html(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u", "<p>"), ("b", "v", None)], "page_id string, url string, html string")
    for _ in range(2):
        sinks.save_raw(rows, str(tmp_path / "raw"), files=1)
    assert [(r.page_id, r.html) for r in spark.read.parquet(str(tmp_path / "raw")).collect()] == [("a", "<p>")]
    sinks.save(rows, str(tmp_path / "lines"), "json")
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
