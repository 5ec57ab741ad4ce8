"""Static against rendered versions of a page: what rendering gains, and what it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: words that rendering must add to count.
LEAST_WORDS = 10


def _pair(static: DataFrame, rendered: DataFrame) -> DataFrame:
    a, b = (df.select("page_id", F.struct(*[c for c in df.columns if c != "page_id"]).alias(n)) for df, n in ((static, "s"), (rendered, "r")))
    return a.join(b, "page_id")


def _internal(x: Column) -> Column:
    return F.size(F.filter(x["links"], lambda y: y["type"] == "internal"))


def _images(x: Column) -> Column:
    return F.size(x["images"]) + F.coalesce(x["image_summary"]["backgrounds"], F.lit(0))


def _headings(x: Column) -> Column:
    return F.size(x["headings"]["h1"]) + F.size(x["headings"]["h2"]) + F.size(x["headings"]["h3"])


def _given(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def render_gain(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """(page_id, six signals, gained, keep, reasons): the rendered version is kept if it has any of them."""
    s, r = F.col("s"), F.col("r")
    words, links, images, headings, data = r["content"]["word_count"] - s["content"]["word_count"], _internal(r) - _internal(s), _images(r) - _images(s), _headings(r) - _headings(s), F.size(r["structured_data"]) - F.size(s["structured_data"])
    metas = F.lit(False)
    for name in ("title", "meta_description", "canonical"):
        metas = metas | (~_given(s[name]) & _given(r[name]))
    signals = {"text": words >= LEAST_WORDS, "links": links > 0, "images": images > 0, "headings": headings > 0, "meta_tags": metas, "json_ld": data > 0}
    deltas = {"text": F.concat(words.cast("string"), F.lit("w")), "links": links.cast("string"), "images": images.cast("string"), "headings": headings.cast("string"), "json_ld": data.cast("string")}
    rows = _pair(static, rendered).select("page_id", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in signals.items()], F.struct(*[v.alias(k) for k, v in deltas.items()]).alias("d"))
    gained = F.exists(F.array(*signals), lambda x: x)
    reasons = F.array_compact(F.array(*[F.when(F.col(k), F.concat(F.lit(f"render-gain:{k.replace('_', '-')}"), F.concat(F.lit("+"), F.col(f"d.{k}")) if k in deltas else F.lit(""))) for k in signals]))
    return rows.select("page_id", *signals, gained.alias("gained"), F.when(gained, "rendered").otherwise("static").alias("keep"), F.when(gained, reasons).otherwise(F.array(F.lit("render-gain:kept-static"))).alias("reasons"))


def render_divergence(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """(page_id, render_divergence): the struct that the rendering rules read."""
    s, r = F.col("s"), F.col("r")
    changed = lambda name: ~s[name].eqNullSafe(r[name])
    return _pair(static, rendered).select("page_id", F.struct(
        s["robots"]["noindex"].alias("static_noindex"), r["robots"]["noindex"].alias("rendered_noindex"), s["canonical"].alias("static_canonical"), r["canonical"].alias("rendered_canonical"),
        (r["content"]["word_count"] - s["content"]["word_count"]).alias("word_count_delta"), (F.size(r["links"]) - F.size(s["links"])).alias("link_count_delta"),
        changed("title").alias("title_changed"), changed("meta_description").alias("description_changed"),
    ).alias("render_divergence"))


def add_observed_images(pages: DataFrame, observed: DataFrame) -> DataFrame:
    """pages whose images are joined by observed(page_id, src) ones that their HTML doesn't list; those carry `observed` as their source."""
    listed = pages.select("page_id", F.explode(F.transform("images", lambda x: x["src"])).alias("src"))
    kind = pages.schema["images"].dataType.elementType
    new = observed.select("page_id", "src").distinct().join(listed, ["page_id", "src"], "left_anti")
    lists = new.groupBy("page_id").agg(F.array_sort(F.collect_list("src")).alias("srcs"))
    rows = pages.join(lists, "page_id", "left")
    made = F.transform(F.coalesce("srcs", F.array().cast("array<string>")), lambda u: F.struct(*[(u if f.name == "src" else F.lit("observed") if f.name == "source" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields]))
    return rows.withColumn("images", F.concat("images", made)).drop("srcs").select(*pages.columns)
