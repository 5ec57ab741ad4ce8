"""Readers and adapters: stored runs, and bare (url, html) tables as runs of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitequarry.functions import urls
from sitequarry.plans.lineage import spread
from sitequarry.sources.extract import FIELDS, extract

#: Columns of a crawled page besides the facts of its HTML.
META = """
run_id string, page_id string, input_order long, url string, normalized_url string, final_url string, status_code int,
redirect_chain array<struct<from: string, to: string, status_code: int>>, headers map<string, string>, rendered_with string,
response_time_ms double, ttfb_ms double, transfer_bytes long, content_encoding string, fetched_at timestamp, depth int,
parent_url string, discovery_sources array<string>,
render_divergence struct<static_noindex: boolean, rendered_noindex: boolean, static_canonical: string, rendered_canonical: string, word_count_delta: int, link_count_delta: int, title_changed: boolean, description_changed: boolean>
"""
FAILURE = "run_id string, url string, normalized_url string, reason string, status_code int, attempts int, error string, depth int, parent_url string"
SITEMAP_ENTRY = "run_id string, input_order long, loc string, normalized_loc string, lastmod string, changefreq string, priority double, source_sitemap string"


def page_schema() -> StructType:
    return StructType.fromDDL(META + "," + FIELDS)


def complete(pages: DataFrame) -> DataFrame:
    """pages with every column of a crawled page, null where it lacks one; other columns are dropped."""
    return pages.select(*[(F.col(f.name).cast(f.dataType) if f.name in pages.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in page_schema().fields])


def from_html(pages: DataFrame, run_id: str = "run", order: str = "page_id", headers: Column | None = None) -> DataFrame:
    """A run from a table of (url, html): identities and the facts of the HTML; nothing is known of status, depth or time."""
    pages = spread(pages)
    facts = extract(pages.withColumnRenamed(order, "input_order") if order != "input_order" else pages, headers=headers)
    normalized = F.coalesce(urls.normalize_url("url"), F.col("url"))
    own = facts.withColumns({"run_id": F.lit(run_id), "normalized_url": normalized, "final_url": F.col("url")}).withColumn("page_id", urls.page_id(F.col("normalized_url")))
    return complete(own)


def first_pages(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """Of the rows of a (url, html) table whose URLs have one identity, the first by an order column without repeats: a run holds a page once."""
    key = F.coalesce(urls.normalize_url("url"), F.col("url"))
    first = pages.select(key.alias("k"), order).groupBy("k").agg(F.min(order).alias(order)).select(order)
    return pages.join(first, order, "left_semi")


def read_pages(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Stored pages, one JSON document a file; malformed files fail, or are left out if tolerant. The page's id is its file's name where it has none."""
    mode = "PERMISSIVE" if tolerant else "FAILFAST"
    kind = StructType.fromDDL(META + "," + FIELDS + (", _corrupt string" if tolerant else ""))
    rows = spark.read.schema(kind).option("multiLine", True).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if tolerant:
        rows = rows.where(F.col("_corrupt").isNull() & F.coalesce("url", "normalized_url", "title").isNotNull()).drop("_corrupt")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json$", 1)
    return rows.select("*", name.alias("_file")).withColumn("page_id", F.coalesce("page_id", "_file")).drop("_file")


def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON documents at path with this schema; no rows if there is nothing at the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def read_events(spark: SparkSession, path: str, after: int | None = None) -> DataFrame:
    """An event log, one JSON object a line; malformed lines are left out; only what follows the cursor."""
    kind = "seq long, run_id string, kind string, at timestamp, url string, status_code int, message string, detail map<string, string>, _corrupt string"
    rows = spark.read.schema(kind).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where(F.col("seq").isNotNull() & F.col("_corrupt").isNull()).drop("_corrupt")
    return rows.where(F.col("seq") > after) if after is not None else rows


def explode_links(pages: DataFrame) -> DataFrame:
    """One row for each link: page, position and the link's fields."""
    return pages.select("run_id", "page_id", "input_order", F.col("url").alias("source"), F.col("normalized_url").alias("source_normalized"), F.col("final_url").alias("source_final"), F.col("depth").alias("source_depth"), F.posexplode("links").alias("position", "link")).select("*", "link.*").drop("link")


def explode_images(pages: DataFrame) -> DataFrame:
    return pages.select("run_id", "page_id", "url", F.posexplode("images").alias("position", "image")).select("*", "image.*").drop("image")


def explode_headings(pages: DataFrame) -> DataFrame:
    return pages.select("run_id", "page_id", "url", F.posexplode("structure.headings").alias("position", "heading")).select("*", "heading.*").drop("heading")


def explode_redirects(pages: DataFrame) -> DataFrame:
    return pages.select("run_id", "page_id", "url", F.posexplode("redirect_chain").alias("hop", "redirect")).select("*", "redirect.*").drop("redirect")


def gather_children(pages: DataFrame, children: DataFrame, into: str, position: str = "position") -> DataFrame:
    """pages with an array of their children's rows, in order: the reverse of an explode."""
    names = [c for c in children.columns if c not in ("run_id", "page_id", position)]
    lists = children.groupBy("run_id", "page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(position, *names))), lambda x: F.struct(*[x[n].alias(n) for n in names])).alias(into))
    return pages.drop(into).join(lists, ["run_id", "page_id"], "left")


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """existing and the rows of incoming whose key it lacks: an idempotent load."""
    return existing.unionByName(incoming.dropDuplicates(key).join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_runs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Run lists: local rows win, remote rows fill the gaps; newest first."""
    return local.unionByName(remote.join(local.select("run_id"), "run_id", "left_anti"), allowMissingColumns=True).orderBy(F.col("started_at").desc_nulls_last(), "run_id")
