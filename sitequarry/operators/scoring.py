"""Health score, findings, importance of pages, worst pages, mutes, effort and fix plans, from issues and evaluated counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitequarry.functions import text as tx
from sitequarry.operators import page_rules, site_rules

#: Categories of the score and their weights.
CATEGORY_WEIGHTS = {"indexability": 30, "content": 25, "links": 15, "media": 15, "performance": 15}
#: Points and category of rules that have their own; others take the points of their severity.
POINTS = {
    "redirect-chain": (15, "indexability"), "orphan-page": (20, "indexability"), "robots-blocked": (50, "indexability"),
    "title-missing": (40, "content"), "title-too-long": (12, "content"), "title-too-short": (5, "content"), "meta-description-missing": (20, "content"),
    "meta-description-too-long": (6, "content"), "h1-missing": (15, "content"), "h1-multiple": (8, "content"), "thin-content": (20, "content"),
    "broken-internal-link": (15, "links"), "image-missing-alt": (25, "media"), "og-missing": (12, "media"),
    "mixed-content": (25, "performance"), "viewport-missing": (15, "performance"),
}
SEVERITY_POINTS = {"error": 25, "warning": 10, "notice": 4}
SEVERITY_RANK = {"error": 0, "warning": 1, "notice": 2}
PRIORITY_WEIGHTS = {"error": 1.0, "warning": 0.6, "notice": 0.3}


def _choice(column: Column, values: dict, default: object) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def severity_rank(column: Column) -> Column:
    return _choice(column, SEVERITY_RANK, 3)


def catalog(spark: SparkSession) -> DataFrame:
    """The rulebook: a row for each rule."""
    return spark.createDataFrame([*page_rules.catalog(), *site_rules.catalog()], "rule_id string, category string, severity string, scope string, automation string, tier string")


def unmuted(issues: DataFrame, mutes: DataFrame | None, now: Column) -> DataFrame:
    """Issues of rules without a mute that still holds (mutes: rule_id, expires_at)."""
    if mutes is None:
        return issues
    held = mutes.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("rule_id").distinct()
    return issues.join(F.broadcast(held), "rule_id", "left_anti")


def affected(issues: DataFrame) -> DataFrame:
    """For each rule its worst severity, how many pages (or else URLs) it hits, and how many issues it has."""
    key = F.coalesce("page_id", F.concat(F.lit("__unanchored__:"), F.coalesce("url", F.lit(""))))
    return issues.groupBy("run_id", "rule_id").agg(F.min(severity_rank(F.col("severity"))).alias("rank"), F.min("category").alias("category"), F.countDistinct(key).alias("affected"), F.count(F.lit(1)).alias("issues"))


def contributions(issues: DataFrame, evaluated: DataFrame) -> DataFrame:
    """What each failing rule takes from the score: points by the root of the share of evaluated pages that it hits."""
    rows = affected(issues).join(evaluated.select("run_id", "rule_id", "evaluated"), ["run_id", "rule_id"], "left")
    reach = F.least(F.lit(1.0), F.col("affected") / F.greatest(F.coalesce("evaluated", F.lit(1)), F.lit(1)))
    severity = _choice(F.col("rank"), {v: k for k, v in SEVERITY_RANK.items()}, "notice")
    points = _choice(F.col("rule_id"), {k: float(p) for k, (p, _) in POINTS.items()}, None)
    own = _choice(F.col("rule_id"), {k: c for k, (_, c) in POINTS.items()}, None)
    fallback = F.when(F.lower("category").isin(*CATEGORY_WEIGHTS), F.lower("category")).otherwise(F.lit("content"))
    return rows.select(
        "run_id", "rule_id", severity.alias("severity"), F.coalesce(own, fallback).alias("score_category"), "affected", "issues", "evaluated", reach.alias("reach"),
        F.coalesce(points, _choice(F.col("rank"), {SEVERITY_RANK[k]: float(v) for k, v in SEVERITY_POINTS.items()}, 5.0)).alias("points"),
    ).withColumn("loss", F.col("points") * F.sqrt("reach")).withColumn("damage", tx.round_half_up(F.col("loss"), 1))


def category_scores(issues: DataFrame, evaluated: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """100 less the losses of a category's rules, for every category."""
    spark = issues.sparkSession
    weights = F.broadcast(spark.createDataFrame(list(CATEGORY_WEIGHTS.items()), "score_category string, weight int"))
    runs = runs if runs is not None else evaluated.select("run_id").distinct()
    lost = contributions(issues, evaluated).groupBy("run_id", "score_category").agg(F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("rules_failing"))
    rows = runs.crossJoin(weights).join(lost, ["run_id", "score_category"], "left")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), tx.round_half_up(100 - F.coalesce("loss", F.lit(0.0)))))
    return rows.select("run_id", "score_category", "weight", score.alias("score"), F.coalesce("rules_failing", F.lit(0)).alias("rules_failing"))


def health_score(issues: DataFrame, evaluated: DataFrame) -> DataFrame:
    """The weighted mean of the categories, with grade and band."""
    mean = tx.round_half_up(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 1)
    rows = category_scores(issues, evaluated).groupBy("run_id").agg(mean.alias("score"))
    return rows.withColumns({"grade": tx.grade(F.col("score")), "band": tx.band(F.col("score"))})


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("run_id", "severity").agg(F.count(F.lit(1)).alias("issues"))


def depth_score(depth: Column) -> Column:
    """Fixed steps by clicks from the seed."""
    return F.when(depth <= 0, 1.0).when(depth == 1, 0.8).when(depth == 2, 0.6).when(depth == 3, 0.45).otherwise(0.3)


def importance(pages: DataFrame, graph: DataFrame | None = None, sitemap_paths: DataFrame | None = None) -> DataFrame:
    """How much a page matters: depth, links and sitemap, clamped to 0..1. graph: (page_id, score, inlinks)."""
    rows = pages.select("page_id", "depth", F.coalesce("normalized_url", "url").alias("url"))
    if graph is not None:
        rows = rows.join(graph.select("page_id", F.col("score").alias("rank_score"), "inlinks"), "page_id", "left")
    else:
        rows = rows.withColumns({"rank_score": F.lit(None).cast("double"), "inlinks": F.lit(0)})
    link = F.coalesce(0.7 + 0.3 * F.col("rank_score") / 100, 0.7 + F.least(F.lit(0.3), F.log10(1 + F.coalesce("inlinks", F.lit(0))) / 5))
    if sitemap_paths is not None:
        rows = rows.join(sitemap_paths.select("url").distinct().withColumn("listed", F.lit(True)), "url", "left")
        listed = F.when(F.col("listed"), 1.0).otherwise(0.9)
    else:
        listed = F.lit(1.0)
    return rows.select("page_id", "url", F.greatest(F.lit(0.0), F.least(F.lit(1.0), depth_score(F.coalesce("depth", F.lit(0))) * link * listed)).alias("importance"))


def findings(issues: DataFrame, evaluated: DataFrame, importances: DataFrame, mutes: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """One row for each rule that ran: status, reach, mean importance of its pages and priority."""
    spark = issues.sparkSession
    book = F.broadcast(catalog(spark).select("rule_id", "scope", "automation", "tier"))
    hit = affected(issues)
    mean = issues.select("run_id", "rule_id", "page_id").distinct().join(importances.select("page_id", "importance"), "page_id").groupBy("run_id", "rule_id").agg(F.avg("importance").alias("mean_importance"))
    first = issues.select("run_id", "rule_id", "url").distinct().withColumn("r", F.row_number().over(Window.partitionBy("run_id", "rule_id").orderBy("url"))).where("r <= 5").groupBy("run_id", "rule_id").agg(F.array_sort(F.collect_list("url")).alias("sample_urls"))
    rows = evaluated.join(hit.drop("category"), ["run_id", "rule_id"], "left").join(mean, ["run_id", "rule_id"], "left").join(first, ["run_id", "rule_id"], "left").join(book, "rule_id", "left")
    if mutes is not None:
        held = mutes.where(F.col("expires_at").isNull() | (F.col("expires_at") > (now if now is not None else F.current_timestamp()))).select("rule_id").distinct().withColumn("muted", F.lit(True))
        rows = rows.join(F.broadcast(held), "rule_id", "left")
    else:
        rows = rows.withColumn("muted", F.lit(False))
    reach = F.when(F.col("scope") == "site", 1.0).otherwise(F.sqrt(F.least(F.lit(1.0), F.col("affected") / F.greatest("evaluated", F.lit(1)))))
    status = F.when(F.coalesce("muted", F.lit(False)), "muted").when(F.col("affected") > 0, "failing").when(F.col("evaluated") == 0, "skipped").otherwise("passed")
    confidence = _choice(F.coalesce("tier", F.lit("heuristic")), page_rules.CONFIDENCE, 0.7)
    priority = tx.round_half_up(100 * _choice(F.col("severity"), PRIORITY_WEIGHTS, 0.3) * reach * F.coalesce("mean_importance", F.lit(0.7)) * confidence)
    return rows.select("run_id", "rule_id", "category", "severity", "scope", "automation", "tier", status.alias("status"), "evaluated", F.coalesce("affected", F.lit(0)).alias("affected"), F.coalesce("issues", F.lit(0)).alias("issues"), reach.alias("reach"), F.when(F.col("affected") > 0, priority).otherwise(0.0).alias("priority"), effort(F.col("automation"), F.col("scope"), F.coalesce("affected", F.lit(0))).alias("effort"), "sample_urls")


def effort(automation: Column, scope: Column, hit: Column) -> Column:
    return F.when(automation == "auto-safe", "low").when((automation == "auto-with-review") & (hit <= 50), "low").when(automation == "auto-with-review", "medium").when((scope == "site") | (hit > 50), "high").otherwise("medium")


def worst_pages(issues: DataFrame, top: int | None = None) -> DataFrame:
    """Harm of each page, the weight and confidence of its issues summed, and its three worst rules."""
    book = F.broadcast(catalog(issues.sparkSession).select("rule_id", "tier"))
    harm = _choice(F.col("severity"), PRIORITY_WEIGHTS, 0.3) * _choice(F.coalesce("tier", F.lit("heuristic")), page_rules.CONFIDENCE, 0.7)
    rows = issues.where("page_id is not null").join(book, "rule_id", "left").groupBy("run_id", "page_id", "rule_id").agg(F.sum(harm).alias("harm"), F.count(F.lit(1)).alias("n"))
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("run_id", "page_id").orderBy(F.col("harm").desc(), "rule_id"))).where("r <= 3").groupBy("run_id", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "rule_id"))), lambda x: x["rule_id"]).alias("top_rules"))
    out = rows.groupBy("run_id", "page_id").agg(tx.round_half_up(F.sum("harm"), 2).alias("harm"), F.sum("n").alias("issues")).join(best, ["run_id", "page_id"])
    return out.orderBy(F.col("harm").desc(), F.col("issues").desc(), "page_id").limit(top) if top else out


def rule_status(evaluated: DataFrame) -> DataFrame:
    """Rules by whether they failed, passed or could not be evaluated."""
    return evaluated.select("run_id", "rule_id", F.when(F.col("failed") > 0, "failing").when(F.col("evaluated") == 0, "skipped").otherwise("passed").alias("status"))


def automation_report(issues: DataFrame) -> DataFrame:
    book = F.broadcast(catalog(issues.sparkSession).select("rule_id", "automation", "scope"))
    return affected(issues).join(book, "rule_id").select("run_id", "rule_id", "automation", "affected", effort(F.col("automation"), F.col("scope"), F.col("affected")).alias("effort"))


def rulebook_counts(spark: SparkSession) -> DataFrame:
    return catalog(spark).groupBy("automation").agg(F.count(F.lit(1)).alias("rules"))


def fix_plan(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """A patch for each issue of the rules that can be fixed alone; a note for the others."""
    safe = issues.where(F.col("rule_id").isin("canonical-absent", "mixed-content", "image-missing-dimensions", "redirect-chain"))
    rows = safe.join(pages.select("page_id", F.coalesce("final_url", "url").alias("final_url"), F.coalesce("normalized_url", "url").alias("page_url")), "page_id", "left")
    value = F.col("evidence")[0]["value"]
    patch = (
        F.when(F.col("rule_id") == "canonical-absent", F.concat(F.lit('<link rel="canonical" href="'), F.coalesce("page_url", "url"), F.lit('">')))
        .when(F.col("rule_id") == "mixed-content", F.concat(F.lit("load over https: "), F.regexp_replace(value, "^http://", "https://")))
        .when(F.col("rule_id") == "image-missing-dimensions", F.concat(F.lit("set width and height: "), value))
        .otherwise(F.concat(F.lit("link to "), F.coalesce("final_url", "url")))
    )
    fixed = rows.select("run_id", "rule_id", "page_id", "url", patch.alias("patch"), F.lit("auto-safe").alias("automation"))
    rest = issues.join(safe.select("rule_id").distinct(), "rule_id", "left_anti").join(F.broadcast(catalog(issues.sparkSession).select("rule_id", "automation")), "rule_id", "left")
    return fixed.unionByName(rest.select("run_id", "rule_id", "page_id", "url", F.concat(F.lit("review "), F.col("rule_id")).alias("patch"), "automation"))


def issues_by_rule(issues: DataFrame, pages_total: Column | int) -> DataFrame:
    """Pages that each rule hits, evidence pages included, worst severity and share of all pages."""
    return affected(issues).withColumn("percent", tx.round_half_up(F.col("affected") * 100.0 / pages_total, 1))


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy(severity_rank(F.col("severity")), "rule_id", F.coalesce("url", F.lit("")))
