"""Across runs: health history, legends, filter counts, stored category scores, trends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import text as tx
from sitequarry.functions import urls
from sitequarry.operators.scoring import CATEGORY_WEIGHTS, PRIORITY_WEIGHTS, _choice
from sitequarry.plans.lineage import cut


def health_history(runs: DataFrame, counts: DataFrame, start_url: str, most: int = 20) -> DataFrame:
    """The last runs of one start URL, oldest first, each with the issues of its rules. runs: (run_id, start_url, started_at, score); counts: (run_id, rule_id, n)."""
    newest = Window.partitionBy("start_url").orderBy(F.col("started_at").desc(), "run_id")
    last = runs.where(F.col("start_url") == start_url).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most).drop("_r")
    rules = counts.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("rules"))
    return last.join(rules, "run_id", "left").orderBy("started_at", "run_id")


def status_legend(rows: DataFrame) -> DataFrame:
    """Pages and percent by status class."""
    counted = rows.groupBy(tx.status_class(F.col("status_code")).alias("status_class")).agg(F.count(F.lit(1)).alias("pages"))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    return counted.crossJoin(total).select("status_class", "pages", tx.round_half_up(F.col("pages") * 100.0 / F.col("total"), 1).alias("percent"))


def filter_counts(pages: DataFrame, orphans: DataFrame) -> DataFrame:
    """The five counts beside the listing's filters, one row a run."""
    own = pages.groupBy("run_id").agg(
        F.count_if("robots.noindex").alias("noindex"), F.count_if(F.exists("images", lambda x: x["alt"].isNull())).alias("missing_alt"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.count_if("needs_js").alias("needs_js"),
    )
    return own.join(orphans.groupBy("run_id").agg(F.count(F.lit(1)).alias("orphan")), "run_id", "left").na.fill(0, ["orphan"])


def captured_fields(pages: DataFrame) -> DataFrame:
    """(run_id, field) for every field that some page of a run has."""
    names = [c for c in pages.columns if c not in ("run_id", "page_id", "input_order")]
    seen = pages.groupBy("run_id").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in names])
    return seen.select("run_id", F.explode(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in names]))).alias("field"))


def stored_categories(findings: DataFrame) -> DataFrame:
    """Category scores from stored findings: 100 less 60 times severity weight times reach. Not the score of an analysis, only near it."""
    reach = F.least(F.lit(1.0), F.coalesce("reach", F.col("affected") / F.greatest("evaluated", F.lit(1))))
    loss = F.sum(F.when(F.col("status") == "failing", _choice(F.col("severity"), PRIORITY_WEIGHTS, 0.5) * reach * 60).otherwise(0.0))
    rows = findings.groupBy("category").agg(loss.alias("loss"))
    return rows.select("category", _choice(F.col("category"), CATEGORY_WEIGHTS, 15).alias("weight"), F.greatest(F.lit(0.0), tx.round_half_up(100 - F.col("loss"))).alias("score"))


def top_failures(failures: DataFrame, n: int = 5) -> DataFrame:
    return failures.groupBy("reason").agg(F.count(F.lit(1)).alias("failures")).orderBy(F.col("failures").desc(), "reason").limit(n)


def property_matches(property_url: Column, domain: str) -> Column:
    """Whether a search property covers a domain."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^https?://", ""), r"[/?].*$", ""), r"^www\.|:\d+$", "")
    return F.when(property_url.startswith("sc-domain:"), bare(F.regexp_replace(property_url, "^sc-domain:", "")) == bare(F.lit(domain))).otherwise(urls.is_url(property_url) & (bare(property_url) == bare(F.lit(domain))))


def property_type(property_url: Column) -> Column:
    return F.when(property_url.startswith("sc-domain:"), "domain").otherwise("url_prefix")


def theil_sen(rows: DataFrame, key: str, x: str, y: str, least: int = 3) -> DataFrame:
    """(key, slope, n): the median slope over all pairs of a series' points. A series is one key's points, of which there is one a day."""

    def run(keys: tuple, points: pd.DataFrame) -> pd.DataFrame:
        points = points.groupby("x", as_index=False)["y"].mean()
        n = len(points)
        if n < least:
            return pd.DataFrame({"key": pd.Series(dtype="object"), "slope": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})
        a, b = points["x"].to_numpy(float), points["y"].to_numpy(float)
        i, j = np.triu_indices(n, 1)
        return pd.DataFrame({"key": [keys[0]], "slope": [float(np.median((b[j] - b[i]) / (a[j] - a[i])))], "n": [n]})

    own = rows.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    return own.groupBy("key").applyInPandas(run, "key string, slope double, n long")


def greedy_groups(pairs: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """(id, leader): nodes taken in order, each not yet taken leads those after it that are paired with it. pairs: (a, b), a before b.

    A node is a leader once all its partners before it are known not to lead, and belongs to its first partner that leads;
    each round settles all nodes whose earlier partners are settled.
    """
    edges = cut(pairs.select("a", "b").distinct())
    state = cut(nodes.select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("leader")))
    for _ in range(most):
        before = edges.join(state.select(F.col("id").alias("a"), F.col("leader").alias("of_a")), "a")
        seen = before.groupBy(F.col("b").alias("id")).agg(F.min(F.when(F.col("of_a") == F.col("a"), F.col("a"))).alias("lead"), F.min(F.when(F.col("of_a").isNull(), F.col("a"))).alias("open"))
        settled = F.when(F.col("leader").isNotNull(), F.col("leader")).when(F.col("lead").isNotNull() & (F.col("open").isNull() | (F.col("lead") < F.col("open"))), F.col("lead")).when(F.col("lead").isNull() & F.col("open").isNull(), F.col("id"))
        after = cut(state.join(seen, "id", "left").select("id", settled.alias("leader")))
        left = after.where("leader is null").limit(1).count()
        state = after
        if not left:
            break
    return state
