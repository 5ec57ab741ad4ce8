"""Listings: rows, filters, sorts, pages of rows, group-bys, and their exports."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import text as tx
from sitequarry.functions import domains, urls
from sitequarry.operators.scoring import severity_rank
from sitequarry.operators.search import Index
from sitequarry.operators.site_rules import Site

MOST_ROWS, DEFAULT_ROWS = 200, 50


def page_rows(pages: DataFrame, issues: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """One listing row for each page; issues join by the page."""
    rows = pages.select(
        "page_id", F.coalesce("normalized_url", "url").alias("url"), "title", "status_code", tx.status_class(F.col("status_code")).alias("status_class"), "depth", F.col("content.word_count").alias("words"), "rendered_with",
        urls.section(F.coalesce("normalized_url", "url")).alias("section"), F.size("links").alias("links"), "response_time_ms", F.coalesce("ttfb_ms", "response_time_ms").alias("ttfb_ms"), ((F.coalesce("status_code", F.lit(200)) < 300) & ~F.coalesce("robots.noindex", F.lit(False))).alias("indexable"),
    )
    if issues is not None:
        per = issues.groupBy("page_id").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "notice")], F.collect_set("rule_id").alias("rules"))
        rows = rows.join(per, "page_id", "left").na.fill(0, ["errors", "warnings", "notices"])
    if graph is not None:
        rows = rows.join(graph.select("page_id", F.col("score").alias("rank_score"), "inlinks"), "page_id", "left")
    return rows


def filter_pages(rows: DataFrame, *, status: str | int | None = None, q: str | None = None, min_words: int | None = None, max_words: int | None = None, depth: int | None = None, section: str | None = None, rendered: str | None = None, severity: str | None = None, rule: str | None = None, indexable: bool | None = None, index: Index | None = None) -> DataFrame:
    """Rows that meet every condition given; a missing word count counts as 0. With an index over the rows' URLs and titles, q is looked up there first."""
    tests: list[Column] = []
    if q and index is not None:
        rows = rows.join(index.search(rows.sparkSession, q).select(index.id_col), index.id_col, "left_semi")
    if status is not None:
        tests.append(F.col("status_class") == status if isinstance(status, str) else F.col("status_code") == status)
    if q:
        tests.append(F.contains(F.lower("url"), F.lit(q.lower())) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q.lower())))
    words = F.coalesce("words", F.lit(0))
    tests += [words >= min_words] if min_words is not None else []
    tests += [words <= max_words] if max_words is not None else []
    tests += [F.col(c) == v for c, v in (("depth", depth), ("section", section), ("rendered_with", rendered), ("indexable", indexable)) if v is not None]
    tests += [F.col(f"{severity}s") > 0] if severity else []
    tests += [F.array_contains("rules", rule)] if rule else []
    for t in tests:
        rows = rows.where(t)
    return rows


def sort_rows(rows: DataFrame, by: str, descending: bool = False, tie: str = "url") -> DataFrame:
    """Ordered by a column, nulls last in both directions; `issues` weighs errors 100, warnings 10, notices 1."""
    key = F.col("errors") * 100 + F.col("warnings") * 10 + F.col("notices") if by == "issues" else F.col(by)
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), tie)


def offset_page(rows: DataFrame, page: int = 1, size: int = DEFAULT_ROWS) -> DataFrame:
    size = max(1, min(size, MOST_ROWS))
    return rows.offset((max(1, page) - 1) * size).limit(size)


def signature(filters: dict) -> str:
    return hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:12]


def encode_cursor(last: dict, filters: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps({"last": last, "sig": signature(filters)}, default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, filters: dict) -> dict:
    """The last row's key; a cursor of other filters is refused."""
    body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    if body.get("sig") != signature(filters):
        raise ValueError("cursor belongs to other filters")
    return body["last"]


def keyset_page(rows: DataFrame, key: str, tie: str, after: tuple | None = None, size: int = DEFAULT_ROWS) -> DataFrame:
    """The next rows by (key, tie): a filter instead of an offset."""
    if after is not None:
        k, t = after
        rows = rows.where((F.col(key) > F.lit(k)) | (F.col(key) == F.lit(k)) & (F.col(tie) > F.lit(t)))
    return rows.orderBy(key, tie).limit(max(1, min(size, MOST_ROWS)))


def explorer_rows(pages: DataFrame, failures: DataFrame, blocked: DataFrame) -> DataFrame:
    """Pages, failures and blocked URLs as one listing."""
    a = page_rows(pages).withColumn("kind", F.lit("page"))
    b = failures.select(F.coalesce("normalized_url", "url").alias("url"), "status_code", "depth", F.col("reason")).withColumns({"kind": F.lit("failure"), "status_class": tx.status_class(F.col("status_code"))})
    c = blocked.select("url").withColumns({"kind": F.lit("blocked"), "status_class": F.lit("blocked")})
    rows = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return rows.withColumn("section", urls.section(F.col("url")))


def section_rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(F.col("status_class") == s).alias(f"n_{s}") for s in ("2xx", "3xx", "4xx", "5xx", "blocked")])


def link_rows(links: DataFrame) -> DataFrame:
    """For each type and target: inbound and nofollow counts, distinct anchors, and the first 50 sources."""
    target = F.coalesce("target_normalized", "target")
    rows = links.withColumn("to", target)
    few = rows.select("type", "to", "source").distinct().withColumn("r", F.row_number().over(Window.partitionBy("type", "to").orderBy("source"))).where("r <= 50").groupBy("type", "to").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return rows.groupBy("type", "to").agg(F.count(F.lit(1)).alias("inbound"), F.count_if("nofollow").alias("nofollow"), F.countDistinct("anchor").alias("anchors")).join(few, ["type", "to"])


def edges_with_status(links: DataFrame, pages: DataFrame) -> DataFrame:
    status = pages.select(F.coalesce("normalized_url", "url").alias("to"), "status_code").dropDuplicates(["to"])
    return links.withColumn("to", F.coalesce("target_normalized", "target")).join(status, "to", "left")


def page_links(links: DataFrame, page_url: str) -> DataFrame:
    """Links out of and into one page."""
    own = links.withColumn("to", F.coalesce("target_normalized", "target"))
    out = own.where(F.col("source_normalized") == page_url).withColumn("direction", F.lit("out"))
    return out.unionByName(own.where(F.col("to") == page_url).withColumn("direction", F.lit("in")))


def image_rows(images: DataFrame) -> DataFrame:
    """For each image: uses, its first alt, whether it is missing anywhere."""
    return images.groupBy("src").agg(F.count(F.lit(1)).alias("uses"), F.min_by("alt", F.when(F.col("alt").isNotNull(), F.struct("page_id", "position"))).alias("alt"), F.count_if(F.col("alt").isNull()).alias("missing_alt")).withColumn("alt_state", tx.alt_state(F.col("alt")))


def redirect_rows(pages: DataFrame) -> DataFrame:
    first, last = F.col("redirect_chain")[0]["from"], F.coalesce("final_url", "url")
    statuses = F.transform("redirect_chain", lambda x: x["status_code"])
    targets = F.transform("redirect_chain", lambda x: x["from"])
    kind = F.when((F.size("redirect_chain") > 3) & (F.size(F.array_distinct(statuses)) < F.size(statuses)), "loop").when(F.size("redirect_chain") > 1, "chain").otherwise("single")
    return pages.where(F.size("redirect_chain") > 0).select("page_id", "url", "final_url", F.size("redirect_chain").alias("hops"), (urls.host(first) != urls.host(last)).alias("cross_host"), ((urls.scheme(first) == "http") & (urls.scheme(last) == "https")).alias("to_https"), kind.alias("kind"), (F.size(F.array_distinct(targets)) < F.size(targets)).alias("repeats_url"))


def filter_issues(issues: DataFrame, *, severity: str | None = None, category: str | None = None, rule: str | None = None, q: str | None = None) -> DataFrame:
    for name, value in (("severity", severity), ("category", category), ("rule_id", rule)):
        if value:
            issues = issues.where(F.col(name) == value)
    return issues.where(F.contains(F.lower(F.concat_ws(" ", "rule_id", "url")), F.lit(q.lower()))) if q else issues


def findings_for_page(issues: DataFrame, page_id: str) -> DataFrame:
    return issues.where(F.col("page_id") == page_id)


def group_issues(issues: DataFrame, by: str) -> DataFrame:
    """Counts by rule, category, severity or page, with the worst severity."""
    return issues.groupBy(by).agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("page_id").alias("pages"), F.min(severity_rank(F.col("severity"))).alias("worst"))


#: Which part of a page a piece of evidence belongs to.
FIELD_SECTIONS = {"title": "metadata", "meta": "metadata", "canonical": "indexability", "robots": "indexability", "headings": "headings", "structure": "headings", "links": "links", "images": "images", "videos": "media", "schema": "structured data", "structured": "structured data", "content": "content", "social": "social", "og": "social", "head": "head", "charset": "head", "favicons": "head", "fonts": "performance", "page_stats": "performance", "response": "performance", "redirect": "redirects", "hreflang": "hreflang"}


def field_section(field: Column) -> Column:
    out = F.lit("other")
    for prefix, name in FIELD_SECTIONS.items():
        out = F.when(field.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def work_queue(rows: DataFrame, thin: int = 80) -> DataFrame:
    """Pages with something to do, each with its labels."""
    labels = F.array_compact(F.array(F.when(F.col("status_code") >= 400, F.lit("broken")), F.when(F.col("words") < thin, F.lit("thin")), F.when(~F.col("indexable"), F.lit("not indexable")), F.when(F.col("title").isNull() | (F.trim("title") == ""), F.lit("no title"))))
    return rows.withColumn("labels", labels).where(F.size("labels") > 0)


def behind() -> dict[str, Column]:
    """Tests of the pages behind each measurement that a page alone decides."""
    https = urls.scheme(F.coalesce("final_url", "url")) == "https"
    return {
        "pages-crawled": F.lit(True), "missing-title": F.col("title").isNull() | (F.trim("title") == ""), "missing-meta-description": F.col("meta_description").isNull() | (F.trim("meta_description") == ""),
        "missing-h1": F.size("headings.h1") == 0, "multiple-h1": F.size("headings.h1") > 1, "title-too-wide": tx.estimate_px(F.col("title"), tx.TITLE_PX) > 561, "thin-content": F.col("content.word_count") < 80, "noindex": F.col("robots.noindex"),
        "deep-pages": F.col("depth") > 3, "needs-javascript": F.col("rendered_with") == "playwright", "redirects": F.size("redirect_chain") > 0, "missing-open-graph": F.size(F.map_keys("social.og")) == 0,
        "broken-pages": F.col("status_code") >= 400, "incomplete-schema": F.exists("schema_items", lambda x: F.size(x["missing_required"]) > 0), "images-without-alt": F.exists("images", lambda x: x["alt"].isNull()),
        "mixed-content": https & (F.exists("images", lambda x: x["src"].startswith("http://")) | F.exists("videos", lambda x: x["url"].startswith("http://"))),
    }


def drilldown(pages: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Pages behind a measurement, by URL: all of them, or the first `limit`."""
    rows = pages.where(F.coalesce(behind()[name], F.lit(False))).orderBy(F.coalesce("normalized_url", "url"))
    return rows if limit is None else rows.limit(limit)


def drilldown_counts(pages: DataFrame) -> DataFrame:
    """(measurement, pages): how many pages stand behind each measurement, of all in one pass."""
    tests = behind()
    counts = pages.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(f"n{k}") for k, t in enumerate(tests.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measurement"), F.col(f"n{k}").alias("pages")) for k, n in enumerate(tests)])).alias("m")).select("m.*")


def site_drilldown(site: Site, name: str) -> DataFrame:
    """Pages behind a measurement that needs the whole run: copies of a text, pages with a broken internal link, images over the limit are in resources."""
    own = site.own
    if name == "duplicate-content":
        again = own.where("content.word_count > 0").groupBy(F.col("content.content_hash").alias("h")).agg(F.countDistinct("key").alias("n")).where("n > 1").select("h")
        return own.join(again, own["content.content_hash"] == again["h"], "left_semi")
    if name == "broken-internal-links":
        bad = site.resolved.where((F.col("status") >= 400) & ~F.col("status").isin(401, 403)).select("page_id").distinct()
        return own.join(bad, "page_id", "left_semi")
    raise ValueError(f"no drilldown: {name}")


def frontier(seen: DataFrame, scope: domains.Scope, rules: tuple[str, ...], most_depth: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """URLs to crawl from (url, depth, parent_url, source): within caps, scope and depth, safe; one row a URL with the first depth and parent and all sources."""
    ok = ~urls.exceeds_caps(F.col("url")) & domains.in_scope(F.col("url"), scope, rules) & (F.col("depth") <= most_depth) & ~urls.is_unsafe(F.col("url"), exclude)
    return seen.where(ok).groupBy("url").agg(F.min("depth").alias("depth"), F.min_by("parent_url", F.struct("depth", "parent_url")).alias("parent_url"), F.array_sort(F.collect_set("source")).alias("sources"))


def newest_per_group(rows: DataFrame, group: str, order: str, n: int, tie: str) -> DataFrame:
    """The newest n rows of each group: what retention keeps."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc(), tie))).where(F.col("_r") <= n).drop("_r")


def screenshots(pages: DataFrame, first: int) -> DataFrame:
    """All error pages and the first N others."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("input_order", "page_id"))
    error = F.coalesce("status_code", F.lit(200)) >= 400
    others = pages.where(~error).withColumn("_r", rank).where(F.col("_r") <= first).drop("_r")
    return pages.where(error).unionByName(others)
