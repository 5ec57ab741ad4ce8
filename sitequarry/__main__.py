"""Command line over stored runs: python -m sitequarry COMMAND ...

A run is a folder with `pages` (JSON documents, one a file) and, where there are some, `failures.json`. Results go to a folder:
`issues.json` as one report, other tables as Parquet.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.operators import diff, graph, scoring
from sitequarry.operators.site_rules import Site
from sitequarry.plans import analyze
from sitequarry.plans.config import Config
from sitequarry.plans.lineage import cut
from sitequarry.sources import crawl, issues, sinks


def _site(spark: SparkSession, run: str) -> Site:
    failures = crawl.read_or_empty(spark, f"{run}/failures.json", crawl.FAILURE)
    return Site(pages=crawl.read_pages(spark, f"{run}/pages", tolerant=True), failures=failures)


def _config(path: str | None) -> Config:
    if path is None:
        return Config()
    with issues.open_bytes(path) as file:
        return Config.load(json.loads(file.read()))


def _analyze(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    done = analyze.analyze(_site(spark, a.run), _config(a.config))
    found = cut(done.issues)
    health = done.health.first()
    counts = {r["severity"]: r["issues"] for r in scoring.severity_counts(found).collect()}
    texts = found.withColumn("evidence", F.transform("evidence", lambda e: F.struct(e["field"].alias("field"), e["value"].cast("string").alias("value"))))
    issues.write_issues(texts, f"{a.out}/issues.json", {"healthScore": health["score"] if health else None, "counts": counts})
    return {"evaluated": done.evaluated, "findings": done.findings, "worst_pages": done.worst_pages, "measurements": done.measurements, "graph": done.graph}


def _automation(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    return {"automation": scoring.automation_report(analyze.analyze(_site(spark, a.run), _config(a.config)).issues)}


def _fixplan(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    site = _site(spark, a.run)
    site.pages = cut(site.pages)
    return {"fixplan": analyze.fix_plan(site, _config(a.config))}


def _graph(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    pages = cut(_site(spark, a.run).pages)
    _, edges = graph.link_graph(pages)
    return {"graph": graph.page_graph(pages).orderBy(F.col("rank").desc(), "url"), "edges": edges.select("src", "dst")}


def _diff(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    before, after = (cut(_site(spark, run).pages) for run in (a.before, a.run))
    return {"pages": diff.run_diff(before, after)}


COMMANDS = {"analyze": _analyze, "automation": _automation, "fixplan": _fixplan, "graph": _graph, "diff": _diff}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("sitequarry", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        own = commands.add_parser(name)
        if name == "diff":
            own.add_argument("before", help="the run to compare with")
        own.add_argument("run", help="the folder of a run")
        own.add_argument("out", help="a folder for the results")
        own.add_argument("--config", help="thresholds and rules as JSON")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"sitequarry {a.command}").getOrCreate()
    for name, table in COMMANDS[a.command](spark, a).items():
        sinks.save(table, f"{a.out}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
