"""Run against run, issues against issues, site against site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import text as tx
from sitequarry.functions import urls

FIELDS = ("title", "meta_description", "canonical", "status_code", "h1", "word_count", "content_hash", "noindex", "links")


def comparable(pages: DataFrame) -> DataFrame:
    """One row for each path, the last page by input order, with the fields that a diff compares."""
    rows = pages.withColumn("path", urls.pathname(F.coalesce("normalized_url", "url"))).where("path is not null")
    last = rows.groupBy("path").agg(F.max_by(F.struct(
        F.coalesce("normalized_url", "url").alias("url"), "title", "meta_description", "canonical", F.col("status_code").cast("string").alias("status_code"),
        F.array_join("headings.h1", " | ").alias("h1"), F.col("content.word_count").cast("string").alias("word_count"), F.col("content.content_hash").alias("content_hash"),
        F.col("robots.noindex").cast("string").alias("noindex"), F.size("links").cast("string").alias("links"),
    ), F.struct("input_order", "page_id")).alias("p"))
    return last.select("path", "p.*")


def keyed_diff(before: DataFrame, after: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Full outer join on a key, in long form: a row (key, change, field, old, new) for each key added or removed and each field changed, and one for each key unchanged."""
    a = before.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("a"))
    b = after.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("b"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("old"), F.col(f"b.{f}").alias("new"))) for f in fields]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size("changed") == 0, "unchanged").otherwise("changed")
    rows = both.withColumn("changed", F.when(F.col("a").isNull() | F.col("b").isNull(), F.array().cast("array<struct<field:string,old:string,new:string>>")).otherwise(changed)).withColumn("change", change)
    return rows.select(key, "change", F.explode(F.when(F.size("changed") > 0, F.col("changed")).otherwise(none)).alias("c")).select(key, "change", "c.*")


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    return keyed_diff(comparable(before), comparable(after), "path", FIELDS)


def issue_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule_id, url, change): issues new, resolved and persisting."""
    a = before.select("rule_id", F.coalesce("url", F.lit("")).alias("url")).distinct().withColumn("a", F.lit(True))
    b = after.select("rule_id", F.coalesce("url", F.lit("")).alias("url")).distinct().withColumn("b", F.lit(True))
    return a.join(b, ["rule_id", "url"], "full_outer").select("rule_id", "url", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved").otherwise("persisting").alias("change"))


def rule_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule_id, before, after, status) from counts (rule_id, n)."""
    rows = before.select("rule_id", F.col("n").alias("before")).join(after.select("rule_id", F.col("n").alias("after")), "rule_id", "full_outer").na.fill(0, ["before", "after"])
    status = F.when((F.col("before") == 0) & (F.col("after") > 0), "new").when((F.col("before") > 0) & (F.col("after") == 0), "resolved").when(F.col("after") < F.col("before"), "improved").when(F.col("after") > F.col("before"), "worsened").otherwise("unchanged")
    return rows.withColumn("status", status)


def _rate(n: Column, of: Column) -> Column:
    return F.when(of > 0, tx.round_half_up(n * 100.0 / of, 1))


def profile(pages: DataFrame) -> DataFrame:
    """The metrics by which sites are compared, in one pass."""
    n = F.count(F.lit(1))
    internal = F.size(F.filter("links", lambda x: x["type"] == "internal"))
    return pages.agg(
        n.cast("double").alias("pages"), tx.round_half_up(F.avg("content.word_count"), 1).alias("mean_words"), F.median("content.word_count").cast("double").alias("median_words"),
        tx.round_half_up(F.avg("depth"), 1).alias("mean_depth"), F.max("depth").cast("double").alias("max_depth"), tx.round_half_up(F.avg(internal), 1).alias("mean_internal_links"),
        _rate(F.count_if(F.col("title").isNull() | (F.trim("title") == "")), n).alias("missing_title_rate"), _rate(F.count_if(F.col("meta_description").isNull()), n).alias("missing_description_rate"),
        _rate(F.count_if(F.size("headings.h1") == 0), n).alias("missing_h1_rate"), _rate(F.sum(F.size(F.filter("images", lambda x: x["alt"].isNull()))), F.sum(F.size("images"))).alias("missing_alt_rate"),
        _rate(F.count_if(F.size("schema_items") > 0), n).alias("schema_rate"), tx.round_half_up(F.avg(tx.utf16_length(F.col("title"))), 1).alias("mean_title_length"),
        _rate(F.count_if(F.col("robots.noindex")), n).alias("noindex_rate"), _rate(F.count_if(F.col("status_code") >= 400), n).alias("error_rate"),
    )


def competitor_grid(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(metric, ours, theirs, delta, comparable) for each metric; both sides are one row."""
    names = profile(ours).columns
    spread = lambda df, alias: profile(df).select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(alias)) for m in names])).alias("x")).select("x.*")
    rows = spread(ours, "ours").join(F.broadcast(spread(theirs, "theirs")), "metric")
    return rows.withColumns({"delta": tx.round_half_up(F.col("ours") - F.col("theirs"), 1), "comparable": F.col("ours").isNotNull() & F.col("theirs").isNotNull()})


def schema_types(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Structured-data types of both sites with how many pages use them."""
    count = lambda df, alias: df.select("page_id", F.explode(F.array_distinct(F.flatten(F.transform("schema_items", lambda x: x["types"])))).alias("type")).groupBy("type").agg(F.countDistinct("page_id").alias(alias))
    return count(ours, "ours").join(count(theirs, "theirs"), "type", "full_outer").na.fill(0)
