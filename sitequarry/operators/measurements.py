"""Run summary and measurements: each a value, or unavailable with a reason; never a made-up zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import text as tx
from sitequarry.functions import urls
from sitequarry.operators.site_rules import AUTH, Site

DEEP, HEAVY_BYTES = 3, 204_800


def blank(x: str) -> Column:
    return F.col(x).isNull() | (F.trim(x) == "")


def summary(site: Site, blocked: DataFrame | None = None) -> DataFrame:
    """One row: discovered, attempted and successful URLs, coverage, depth, link counts, orphans, sitemap differences."""
    pages, key = site.own, F.coalesce("normalized_url", "url")
    failures = site.failures.select(key.alias("url"), F.col("status_code").alias("failed_status"), "reason") if site.failures is not None else None
    names = pages.select(F.col("key").alias("url"))
    attempted = names if failures is None else names.unionByName(failures.select("url"))
    blocked = blocked if blocked is not None else site.blocked
    known = attempted if blocked is None else attempted.unionByName(blocked.select("url"))
    ok = F.col("status_code").between(200, 299) | (F.col("status_code").between(300, 399) & (F.size("redirect_chain") > 0))
    good = pages.where(ok).select(F.col("key").alias("url")).distinct()
    if failures is not None:
        good = good.join(failures.select("url"), "url", "left_anti")
    from sitequarry.operators.site_rules import orphans

    links = site.pages.select(F.explode("links").alias("l"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(known.distinct(), "discovered").crossJoin(one(attempted.distinct(), "attempted")).crossJoin(one(good, "successful"))
    out = out.crossJoin(site.pages.agg(F.max("depth").alias("max_depth"))).crossJoin(links.agg(F.count_if(F.col("l.type") == "internal").alias("internal_links"), F.count_if(F.col("l.type") == "external").alias("external_links")))
    out = out.crossJoin(one(orphans(site), "orphan_candidates"))
    if site.entries is not None:
        out = out.crossJoin(one(site.entries.join(site.by_path, F.col("entry_path") == F.col("at_path"), "left_anti"), "sitemap_not_crawled"))
        out = out.crossJoin(one(pages.join(site.entries, F.col("path") == F.col("entry_path"), "left_anti"), "crawled_not_in_sitemap"))
    return out.withColumn("coverage", F.when(F.col("attempted") > 0, tx.round_half_up(1000.0 * F.col("successful") / F.col("attempted")) / 10))


def status_histogram(pages: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """URLs by status; a page counts before a failure of the same URL."""
    own = pages.select(F.coalesce("normalized_url", "url").alias("url"), F.col("status_code").alias("page_status")).groupBy("url").agg(F.max("page_status").alias("page_status"))
    if failures is None:
        return own.groupBy(F.col("page_status").alias("status_code")).agg(F.count(F.lit(1)).alias("urls"))
    other = failures.select(F.coalesce("normalized_url", "url").alias("url"), "status_code").groupBy("url").agg(F.min("status_code").alias("failed_status"))
    return own.join(other, "url", "full_outer").groupBy(F.coalesce("page_status", "failed_status").alias("status_code")).agg(F.count(F.lit(1)).alias("urls"))


def depth_histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy("depth").agg(F.count(F.lit(1)).alias("pages"))


def failures_by_class(failures: DataFrame) -> DataFrame:
    return failures.groupBy("reason").agg(F.count(F.lit(1)).alias("failures")).orderBy(F.col("failures").desc(), "reason")


def percentiles(rows: DataFrame, value: str, points: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles, maximum, mean (1 decimal) and median of the two middle values."""
    cols = [F.expr(f"percentile_disc({p}) within group (order by {value})").cast("double").alias(f"p{round(100 * p)}") for p in points]
    return rows.where(F.col(value).isNotNull()).agg(*cols, F.max(value).cast("double").alias("max"), tx.round_half_up(F.avg(value), 1).alias("mean"), F.median(value).cast("double").alias("median"))


def measurements(site: Site, external: DataFrame | None = None, discovered: int | None = None, loaded: DataFrame | None = None) -> DataFrame:
    """(measurement, value, available, sample, reason), all page-wise ones in one pass. loaded: rows of resource_measurements(), in place of those that pages alone can't tell."""
    p = site.own
    n = F.count(F.lit(1))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(False))).cast("double")
    px = tx.estimate_px(F.col("title"), tx.TITLE_PX)
    mixed = (urls.scheme(F.coalesce("final_url", "url")) == "https") & (F.exists("images", lambda x: x["src"].startswith("http://")) | F.exists("videos", lambda x: x["url"].startswith("http://")))
    images = F.sum(F.size("images"))
    known = lambda c: F.count(c).cast("double")
    spec: dict[str, tuple[Column, Column, str]] = {
        "pages-crawled": (n.cast("double"), n.cast("double"), ""),
        "redirects": (count(F.size("redirect_chain") > 0), known("redirect_chain"), "no redirects recorded"),
        "missing-title": (count(blank("title")), n.cast("double"), ""),
        "missing-meta-description": (count(blank("meta_description")), n.cast("double"), ""),
        "missing-h1": (count(F.size("headings.h1") == 0), known("headings"), "no headings"),
        "multiple-h1": (count(F.size("headings.h1") > 1), known("headings"), "no headings"),
        "title-too-wide": (count(px > 561), known(px), "no titles"),
        "thin-content": (count(F.col("content.word_count") < 80), known("content.word_count"), "no content"),
        "average-word-count": (tx.round_half_up(F.avg("content.word_count"), 1), known("content.word_count"), "no content"),
        "reading-ease": (tx.round_half_up(F.avg(tx.reading_ease(F.col("content.text"))), 1), known(tx.reading_ease(F.col("content.text"))), "no text"),
        "noindex": (count(F.col("robots.noindex")), known("robots"), "no robots"),
        "deep-pages": (count(F.col("depth") > DEEP), known("depth"), "no depth"),
        "needs-javascript": (count(F.col("rendered_with") == "playwright"), known("rendered_with"), "no renderer"),
        "missing-open-graph": (count(F.size(F.map_keys("social.og")) == 0), known("social"), "not captured"),
        "incomplete-schema": (count(F.exists("schema_items", lambda x: F.size(x["missing_required"]) > 0)), known("schema_items"), "not captured"),
        "images-without-alt": (F.sum(F.size(F.filter("images", lambda x: x["alt"].isNull()))).cast("double"), images.cast("double"), "no images"),
        "mixed-content": (count(mixed), n.cast("double"), ""),
        "average-ttfb": (tx.round_half_up(F.avg("ttfb_ms"), 1), known("ttfb_ms"), "not measured"),
        "average-response": (tx.round_half_up(F.avg("response_time_ms"), 1), known("response_time_ms"), "not measured"),
        "average-dom-nodes": (tx.round_half_up(F.avg("page_stats.dom_nodes"), 1), known("page_stats.dom_nodes"), "not measured"),
        "average-page-weight": (tx.round_half_up(F.coalesce(F.avg("transfer_bytes"), F.avg("page_stats.html_bytes")), 1), known("page_stats.html_bytes"), "not measured"),
        "certificate": (F.lit(None).cast("double"), F.lit(0.0), "not collected"),
        "render-blocking": (F.lit(None).cast("double"), F.lit(0.0), "not collected"),
        "heavy-images": (F.lit(None).cast("double"), F.lit(0.0), "image sizes not collected"),
    }
    wide = p.agg(*[v.alias(f"v{i}") for i, (v, _, _) in enumerate(spec.values())], *[s.alias(f"s{i}") for i, (_, s, _) in enumerate(spec.values())])
    items = [F.struct(F.lit(k).alias("measurement"), F.col(f"v{i}").alias("value"), F.col(f"s{i}").alias("sample"), F.lit(r).alias("reason")) for i, (k, (_, _, r)) in enumerate(spec.items())]
    out = wide.select(F.explode(F.array(*items)).alias("m")).select("m.*")
    one = lambda name, df, value: df.agg(value.cast("double").alias("value"), F.count(F.lit(1)).cast("double").alias("sample")).select(F.lit(name).alias("measurement"), "value", F.greatest("sample", F.lit(1.0)).alias("sample"), F.lit("").alias("reason"))
    broken = p.where("status_code >= 400").select(F.col("key").alias("url"))
    if site.failures is not None:
        broken = broken.unionByName(site.failures.where("status_code >= 400").select(F.coalesce("normalized_url", "url").alias("url")))
    out = out.unionByName(one("broken-pages", broken, F.countDistinct("url")))
    out = out.unionByName(one("broken-internal-links", site.resolved, F.count_if((F.col("status") >= 400) & ~F.col("status").isin(*AUTH))))
    from sitequarry.operators.site_rules import orphans

    out = out.unionByName(one("orphan-pages", orphans(site), F.count(F.lit(1))))
    repeated = p.where("content.word_count > 0").groupBy(F.col("content.content_hash").alias("h")).agg(F.countDistinct("key").alias("n")).where("n > 1")
    out = out.unionByName(one("duplicate-content", repeated, F.coalesce(F.sum("n"), F.lit(0))))
    if external is not None:
        bad = (F.col("status_code") >= 400) | (F.col("status_code").isNull() & F.col("error").isNotNull())
        out = out.unionByName(one("broken-outbound-links", external, F.count_if(bad & ~F.coalesce("status_code", F.lit(0)).isin(*AUTH))))
        out = out.unionByName(one("outbound-links-refused", external, F.count_if(F.col("status_code").isin(*AUTH))))
    if discovered is not None:
        out = out.unionByName(one("pages-discovered", p, F.lit(discovered)))
    if loaded is not None:
        told = loaded.select("measurement", "value", F.col("sample").cast("double").alias("sample"), F.lit("not measured").alias("reason"))
        out = out.join(told.select("measurement"), "measurement", "left_anti").unionByName(told)
    available = F.col("sample") > 0
    return out.select("measurement", F.when(available, F.col("value")).alias("value"), available.alias("available"), F.col("sample").cast("long").alias("sample"), F.when(~available, F.col("reason")).alias("reason"))


def kpi_deltas(runs: DataFrame, value: str, site: str = "site", order: str = "started_at") -> DataFrame:
    """Each run's value, the run's before, and the direction."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(site).orderBy(order))
    rows = runs.withColumn("previous", before).withColumn("delta", F.col(value) - F.col("previous"))
    return rows.withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").when(F.col("delta") == 0, "flat"))
