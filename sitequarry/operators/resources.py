"""What pages load: bytes attributed by normalised URL, heavy images, page weight, and the time that requests block the first paint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import urls

#: Fixed value: bytes beyond which an image is heavy.
HEAVY_IMAGE_BYTES = 204_800
#: Kinds of requests that can hold back the first paint.
BLOCKING_KINDS = ("script", "stylesheet")


def keyed(resources: DataFrame, url: str = "url") -> DataFrame:
    """resources with key: the normalised URL, or the URL itself where that has none (data and blob URLs)."""
    return resources.withColumn("key", F.coalesce(urls.normalize_url(url), F.col(url)))


def per_request(resources: DataFrame) -> DataFrame:
    """One row for each (page_id, key): repeated requests of a page for a URL are one resource, of the most bytes, the least start and the last end."""
    return resources.where("key is not null").groupBy("page_id", "key").agg(
        F.max_by("kind", F.struct(F.coalesce("bytes", F.lit(-1)), "kind")).alias("kind"), F.max("bytes").alias("bytes"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.coalesce(F.bool_or("deferred"), F.lit(False)).alias("deferred"),
    )


def image_bytes(images: DataFrame, requests: DataFrame) -> DataFrame:
    """images(page_id, position, src_key) with bytes: what the page itself has measured for the URL, or else the most that any page has.

    The measurement by URL alone is grouped before it is joined, and only for images that their own page hasn't measured, so a logo
    on every page is one row on that side and a skewed key, which Spark splits, on the other.
    """
    own = requests.where("bytes is not null").select("page_id", F.col("key").alias("src_key"), F.col("bytes").alias("own_bytes"))
    anywhere = own.groupBy("src_key").agg(F.max("own_bytes").alias("any_bytes"))
    return images.join(own, ["page_id", "src_key"], "left").join(anywhere, "src_key", "left").withColumn("bytes", F.coalesce("own_bytes", "any_bytes")).drop("own_bytes", "any_bytes")


def heavy_images(sized: DataFrame, limit: int = HEAVY_IMAGE_BYTES) -> DataFrame:
    """One row (value, sample): images over the limit, and images with a size."""
    return sized.agg(F.count_if(F.col("bytes") > limit).alias("value"), F.count("bytes").alias("sample"))


def page_weights(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """(page_id, html_bytes, resource_bytes, weight, requests, unmeasured) of pages(page_id, html_bytes)."""
    loaded = requests.groupBy("page_id").agg(F.sum("bytes").alias("resource_bytes"), F.count(F.lit(1)).alias("requests"), F.count_if(F.col("bytes").isNull()).alias("unmeasured"))
    rows = pages.select("page_id", "html_bytes").join(loaded, "page_id", "left").na.fill(0, ["resource_bytes", "requests", "unmeasured"])
    return rows.withColumn("weight", F.coalesce("html_bytes", F.lit(0)) + F.col("resource_bytes"))


def blocks(kind: Column, deferred: Column) -> Column:
    return kind.isin(*BLOCKING_KINDS) & ~F.coalesce(deferred, F.lit(False))


def render_blocking(requests: DataFrame, paints: DataFrame) -> DataFrame:
    """Per page of paints(page_id, first_paint_ms): how many blocking requests were under way before the first paint, how long at least one of them was, and the last to end.

    A sweep over the intervals of a page in the order of their starts: one that begins behind the furthest end so far opens a new
    stretch, and the stretches' lengths are summed. Intervals are cut at the paint; requests without both times don't count.
    """
    rows = requests.where(blocks(F.col("kind"), F.col("deferred"))).join(paints.where("first_paint_ms is not null"), "page_id")
    rows = rows.where("start_ms < first_paint_ms and end_ms > start_ms").withColumn("until", F.least("end_ms", "first_paint_ms"))
    order = Window.partitionBy("page_id").orderBy("start_ms", "until", "key")
    furthest = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # What an interval adds: the part of it behind the furthest end so far.
    swept = rows.withColumn("adds", F.greatest(F.lit(0), F.col("until") - F.greatest("start_ms", F.coalesce(furthest, F.col("start_ms")))))
    found = swept.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocking"), F.sum("adds").alias("blocked_ms"), F.max_by("key", F.struct("until", "key")).alias("last"))
    return paints.select("page_id").join(found, "page_id", "left").na.fill(0, ["blocking", "blocked_ms"])


def resource_measurements(sized: DataFrame, weights: DataFrame, blocked: DataFrame) -> DataFrame:
    """(measurement, value, sample) of heavy-images, average-page-weight and render-blocking (pages that a request blocks)."""
    name = lambda n: F.lit(n).alias("measurement")
    heavy = heavy_images(sized).select(name("heavy-images"), F.col("value").cast("double").alias("value"), "sample")
    weight = weights.agg(F.avg("weight").alias("value"), F.count(F.lit(1)).alias("sample")).select(name("average-page-weight"), F.round("value", 1).alias("value"), "sample")
    block = blocked.agg(F.count_if(F.col("blocking") > 0).cast("double").alias("value"), F.count(F.lit(1)).alias("sample")).select(name("render-blocking"), "value", "sample")
    return heavy.unionByName(weight).unionByName(block)
