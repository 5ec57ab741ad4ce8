"""The entry points: analyse a run, its graph, its near duplicates, its fix plan, and what differs from another run."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.operators import diff, graph, measurements, page_rules, scoring, similarity, site_rules
from sitequarry.operators.site_rules import Site
from sitequarry.plans.config import Config
from sitequarry.plans.lineage import cut


@dataclass
class Analysis:
    issues: DataFrame
    evaluated: DataFrame
    health: DataFrame
    categories: DataFrame
    findings: DataFrame
    worst_pages: DataFrame
    measurements: DataFrame
    graph: DataFrame


def analyze(site: Site, config: Config = Config(), mutes: DataFrame | None = None, now: Column | None = None) -> Analysis:
    """Everything about one run. Pages are written once, after extraction, and read by all that follows."""
    site = replace(site, pages=cut(site.pages))
    if site.near_duplicates is None:
        near = similarity.near_duplicates(site.pages.select(F.col("page_id").alias("id"), F.col("content.text").alias("text"), F.col("content.word_count").alias("word_count"), F.col("content.content_hash").alias("content_hash")), threshold=config.thresholds.near_dup_similarity)
        site = replace(site, near_duplicates=near.withColumnRenamed("id", "page_id"))
    page_issues, page_counts = page_rules.evaluate(site.pages, config, both=True)
    site_issues, site_counts = site_rules.evaluate(site, config)
    issues = cut(page_issues.unionByName(site_issues))
    evaluated = cut(page_counts.unionByName(site_counts))
    ranks = graph.page_graph(site.pages)
    weight = scoring.importance(site.pages, ranks)
    heard = scoring.unmuted(issues, mutes, now if now is not None else F.current_timestamp())
    return Analysis(
        scoring.ordered(issues), evaluated, scoring.health_score(heard, evaluated), scoring.category_scores(heard, evaluated),
        scoring.findings(issues, evaluated, weight, mutes, now), scoring.worst_pages(issues), measurements.measurements(site), ranks,
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    return diff.run_diff(before, after)


def fix_plan(site: Site, config: Config = Config()) -> DataFrame:
    page_issues, _ = page_rules.evaluate(site.pages, config)
    site_issues, _ = site_rules.evaluate(site, config)
    return scoring.fix_plan(page_issues.unionByName(site_issues), site.pages)
