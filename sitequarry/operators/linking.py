"""Internal-link opportunities: candidates from mentions, similar vectors and shared queries, weighed and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of need, value, relevance, authority and placement; links in from which a page needs no more; the band in which similarity counts.
WEIGHTS = {"need": 0.25, "value": 0.20, "relevance": 0.30, "authority": 0.15, "placement": 0.10}
ENOUGH_INLINKS = 40
BAND = (0.78, 0.85)


def shared_queries(metrics: DataFrame) -> DataFrame:
    """(source_id, target_id, queries): pages that show for queries whose first page is another one.

    metrics(page_id, query, impressions, position). The first page of a query has the best mean position, then the most
    impressions, then the least id; every other page of the query makes one row with it, so rows grow with the metrics and not
    with pairs of pages.
    """
    rows = metrics.where("page_id is not null and query is not null and impressions > 0").groupBy("query", "page_id").agg(F.sum("impressions").alias("impressions"), (F.sum(F.col("position") * F.col("impressions")) / F.sum("impressions")).alias("position"))
    first = rows.groupBy("query").agg(F.min_by("page_id", F.struct("position", -F.col("impressions"), "page_id")).alias("target_id"))
    pairs = rows.join(first, "query").where("page_id != target_id")
    return pairs.groupBy(F.col("page_id").alias("source_id"), "target_id").agg(F.count(F.lit(1)).alias("queries"))


def both_ways(pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, cosine) of undirected pairs (a, b, cosine); members(member, id) names the rows of a class."""
    rows = pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "cosine").unionByName(pairs.select(F.col("b").alias("source_id"), F.col("a").alias("target_id"), "cosine"))
    if members is None:
        return rows
    rows = rows.join(members.select(F.col("member").alias("s"), F.col("id").alias("source_id")), "source_id").join(members.select(F.col("member").alias("t"), F.col("id").alias("target_id")), "target_id")
    return rows.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), "cosine")


def need(inlinks: Column) -> Column:
    """1 without links in, falling ever more slowly to 0."""
    return F.round(1 - F.log1p(F.least(inlinks, F.lit(ENOUGH_INLINKS))) / F.log1p(F.lit(float(ENOUGH_INLINKS))), 12)


def relevance(cosine: Column, mentions: Column, queries: Column) -> Column:
    """Half from the similarity's place in the band, half from how many of the three channels agree."""
    low, high = BAND
    place = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - low) / (high - low))), F.lit(0.0))
    agree = cosine.isNotNull().cast("int") + (F.coalesce(mentions, F.lit(0)) > 0).cast("int") + (F.coalesce(queries, F.lit(0)) > 0).cast("int")
    return 0.5 * place + 0.5 * agree / 3


def opportunities(pages: DataFrame, edges: DataFrame, mentions: DataFrame | None = None, similar: DataFrame | None = None, queries: DataFrame | None = None, most: int = 5, weights: dict[str, float] | None = None) -> DataFrame:
    """(target_id, source_id, mentions, cosine, queries, score, place): for each target its best sources, at most `most`, that don't link to it yet.

    pages(page_id, linkable, score, value): linkable is false for pages that are not indexed, redirect or name another page as
    canonical; score (0 to 100) is a page's rank, value (0 to 1) what more visits to it are worth. edges(src, dst) are the links
    there are; the channels are mentions(source_id, target_id, mentions, first_place), similar(source_id, target_id, cosine) and
    queries(source_id, target_id, queries). Null values count as none. Ties go to the least source.
    """
    w = weights or WEIGHTS
    empty = "source_id long, target_id long"
    spark = pages.sparkSession
    mentions = mentions if mentions is not None else spark.createDataFrame([], f"{empty}, mentions long, first_place double")
    similar = similar if similar is not None else spark.createDataFrame([], f"{empty}, cosine double")
    queries = queries if queries is not None else spark.createDataFrame([], f"{empty}, queries long")
    key = ["source_id", "target_id"]
    # One shuffle by pair instead of two full joins: each channel fills its own columns.
    pairs = mentions.select(*key, "mentions", "first_place").unionByName(similar.select(*key, "cosine"), allowMissingColumns=True).unionByName(queries.select(*key, "queries"), allowMissingColumns=True)
    pairs = pairs.where("source_id != target_id").groupBy(*key).agg(F.sum("mentions").alias("mentions"), F.min("first_place").alias("first_place"), F.max("cosine").alias("cosine"), F.sum("queries").alias("queries"))
    links = edges.where("src != dst").select(F.col("src").alias("source_id"), F.col("dst").alias("target_id")).distinct()
    into = links.groupBy(F.col("target_id").alias("page_id")).agg(F.count(F.lit(1)).alias("inlinks"))
    out = links.groupBy(F.col("source_id").alias("page_id")).agg(F.count(F.lit(1)).alias("outlinks"))
    facts = pages.select("page_id", "linkable", "score", "value").join(into, "page_id", "left").join(out, "page_id", "left")
    targets = facts.where("linkable").select(F.col("page_id").alias("target_id"), need(F.coalesce("inlinks", F.lit(0))).alias("need"), F.coalesce("value", F.lit(0.0)).alias("value"))
    sources = facts.select(F.col("page_id").alias("source_id"), (F.coalesce("score", F.lit(0)) / 100 / (1 + F.coalesce("outlinks", F.lit(0)) / 100)).alias("authority"))
    new = pairs.join(links, key, "left_anti").join(targets, "target_id").join(sources, "source_id")
    placement = F.when(F.coalesce("mentions", F.lit(0)) > 0, 1 - 0.5 * F.coalesce("first_place", F.lit(1.0))).otherwise(0.25)
    parts = {"need": F.col("need"), "value": F.col("value"), "relevance": relevance(F.col("cosine"), F.col("mentions"), F.col("queries")), "authority": F.col("authority"), "placement": placement}
    score = sum((w[k] * c for k, c in parts.items()), F.lit(0.0))
    scored = new.withColumn("score", F.round(score, 6))
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(F.col("score").desc(), "source_id"))
    return scored.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("target_id", "source_id", "mentions", F.round("cosine", 6).alias("cosine"), "queries", "score", "place")
