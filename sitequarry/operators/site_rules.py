"""The rules over a whole run: group-bys, joins and anti-joins on pages, links, failures, blocked URLs, the sitemap and robots.

Each takes a Site and the thresholds and gives its issues, or None where its inputs were not captured: then it was not
evaluated. Pages are joined on their path; where several pages share one, the first by input order stands for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import urls
from sitequarry.plans.config import Config, Thresholds
from sitequarry.sources.crawl import explode_links

AUTH = (401, 403)


@dataclass
class Site:
    """The inputs of one run. All but pages may be missing."""

    pages: DataFrame
    failures: DataFrame | None = None
    blocked: DataFrame | None = None
    sitemap: DataFrame | None = None
    sitemap_files: DataFrame | None = None
    robots: DataFrame | None = None
    lastmod: DataFrame | None = None
    seed: str | None = None
    near_duplicates: DataFrame | None = None

    def __post_init__(self) -> None:
        # tables that grow with the run are joined by sorted shuffles: the size of a few columns of compressed files says little
        # of their rows in memory, and a table that is broadcast by that estimate goes through the driver whole
        for name in ("pages", "failures", "blocked", "sitemap"):
            rows = getattr(self, name)
            if rows is not None:
                setattr(self, name, rows.hint("merge"))

    @cached_property
    def own(self) -> DataFrame:
        """Pages with their requested and final path."""
        return self.pages.withColumns({"key": F.coalesce("normalized_url", "url"), "path": urls.pathname(F.coalesce("normalized_url", "url")), "final_path": urls.pathname(F.coalesce("final_url", "url"))})

    @cached_property
    def by_path(self) -> DataFrame:
        """One page for each path under which one was requested or ended: an equi-join instead of one on either of two keys."""
        facts = F.struct("page_id", "key", "status_code", "depth", F.size("redirect_chain").alias("hops"), F.col("robots.noindex").alias("noindex"), F.col("canonical").alias("canonical"), "path", "final_path")
        both = self.own.select("input_order", "page_id", F.explode(F.array_distinct(F.array("path", "final_path"))).alias("at_path"), facts.alias("page")).where("at_path is not null")
        return both.groupBy("at_path").agg(F.min_by("page", F.struct(F.col("input_order").isNull(), "input_order", "page_id")).alias("page"))

    @cached_property
    def links(self) -> DataFrame:
        """Internal links with the path they lead to."""
        return explode_links(self.pages).where(F.col("type") == "internal").withColumn("target_path", urls.pathname(F.coalesce("target_normalized", "target")))

    @cached_property
    def inlinks(self) -> DataFrame:
        """Occurrences of links to each path, from other pages."""
        from_paths = self.links.withColumns({"a": urls.pathname(F.coalesce("source_normalized", "source")), "b": urls.pathname(F.coalesce("source_final", "source"))})
        return from_paths.where((F.col("target_path") != F.col("a")) & (F.col("target_path") != F.coalesce("b", "a"))).groupBy("target_path").agg(F.count(F.lit(1)).alias("inlinks"))

    @cached_property
    def failed(self) -> DataFrame | None:
        """The first HTTP error status of each failed path."""
        if self.failures is None:
            return None
        rows = self.failures.where(F.col("status_code") >= 400).withColumn("failed_path", urls.pathname(F.coalesce("normalized_url", "url")))
        return rows.where("failed_path is not null").groupBy("failed_path").agg(F.min("status_code").alias("failed_status"))

    @cached_property
    def entries(self) -> DataFrame | None:
        """One sitemap entry for each path, the first."""
        if self.sitemap is None:
            return None
        rows = self.sitemap.withColumn("entry_path", urls.pathname(F.coalesce("normalized_loc", "loc"))).where("entry_path is not null")
        return rows.groupBy("entry_path").agg(F.min_by("loc", F.struct(F.col("input_order").isNull(), "input_order", "loc")).alias("loc"))

    @cached_property
    def resolved(self) -> DataFrame:
        """Links with the status of what they lead to, of the page or else of the failure."""
        rows = self.links.join(self.by_path.select(F.col("at_path").alias("target_path"), F.col("page.status_code").alias("page_status")), "target_path", "left")
        if self.failed is None:
            return rows.withColumn("status", F.col("page_status"))
        return rows.join(self.failed.withColumnRenamed("failed_path", "target_path"), "target_path", "left").withColumn("status", F.coalesce("page_status", "failed_status"))


def _issue(rows: DataFrame, url: Column | str, evidence: dict[str, Column | str], page: Column | str | None = "page_id") -> DataFrame:
    col = lambda x: F.col(x) if isinstance(x, str) else x
    shown = F.array(*[F.struct(F.lit(k).alias("field"), col(v).cast("string").alias("value")) for k, v in evidence.items()])
    return rows.select((col(page) if page is not None else F.lit(None)).cast("string").alias("page_id"), col(url).alias("url"), shown.alias("evidence"))


@dataclass(frozen=True)
class SiteRule:
    id: str
    category: str
    severity: str
    automation: str
    tier: str
    run: Callable[[Site, Thresholds], DataFrame | None]


RULES: list[SiteRule] = []


def rule(id: str, kind: str, automation: str = "human-only", tier: str = "derived"):
    category, severity = kind.split("/")

    def add(f):
        RULES.append(SiteRule(id, category, severity, automation, tier, f))
        return f

    return add


REVIEW = "auto-with-review"


def _shared(site: Site, key: Column, field: str, condition: Column | None = None) -> DataFrame:
    """Pages that share a key with others: an issue each, with up to 5 of the others."""
    rows = site.own.withColumn("k", key).where("k is not null and k != ''")
    if condition is not None:
        rows = rows.where(condition)
    # the first six of a group by a ranked limit, which is taken before the shuffle: no list of a whole group
    first = rows.select("k", "key").withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("key"))).where("rank <= 6").groupBy("k").agg(F.array_sort(F.collect_set("key")).alias("urls"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(first, "k")
    peers = F.slice(F.filter("urls", lambda u: u != F.col("key")), 1, 5)
    return _issue(rows.join(groups, "k"), "key", {field: "k", "peers": F.array_join(peers, " "), "group_size": "n"})


@rule("duplicate-title", "duplicates/warning")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _shared(site, F.trim("title"), "title")


@rule("duplicate-description", "duplicates/warning")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _shared(site, F.trim("meta_description"), "meta_description")


@rule("exact-duplicate-content", "duplicates/warning")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _shared(site, F.col("content.content_hash"), "content.content_hash", F.col("content.word_count") > 0)


@rule("url-variant-duplicate", "duplicates/warning", REVIEW)
def _(site: Site, t: Thresholds) -> DataFrame:
    rows = site.own.where((F.coalesce("status_code", F.lit(200)).between(200, 299)) & (F.col("content.word_count") > 0)).withColumn("k", urls.variant_key(F.col("key")))
    groups = rows.groupBy("k").agg(F.countDistinct("key").alias("n"), F.countDistinct("content.content_hash").alias("hashes")).where("n > 1 and hashes = 1")
    return _issue(rows.join(groups, "k"), "key", {"variant": "k", "group_size": "n"})


@rule("near-duplicate-content", "duplicates/notice", tier="heuristic")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    if site.near_duplicates is None:
        return None
    return _issue(site.near_duplicates.join(site.own.select("page_id", "key"), "page_id"), "key", {"cluster": "cluster_id", "similarity": "similarity"})


@rule("favicon-inconsistent", "head/notice")
def _(site: Site, t: Thresholds) -> DataFrame:
    declared = F.filter("favicons", lambda x: x["source"] != "implicit")
    rows = site.own.withColumns({"icon": F.try_element_at(declared, F.lit(-1))["href"], "host": urls.host(F.col("key"))}).where("icon is not null")
    hosts = rows.groupBy("host").agg(F.countDistinct("icon").alias("icons")).where("icons > 1")
    return _issue(rows.join(hosts, "host"), "key", {"favicon": "icon", "distinct": "icons"})


@rule("hreflang-not-reciprocal", "hreflang/warning", REVIEW)
def _(site: Site, t: Thresholds) -> DataFrame:
    there = site.own.select("page_id", "key", "path", F.explode("hreflang").alias("h")).select("page_id", "key", "path", F.col("h.lang").alias("lang"), F.col("h.href").alias("href"), urls.pathname(F.col("h.href")).alias("to_path"))
    crawled = site.by_path.select(F.col("at_path").alias("to_path"), F.col("page.path").alias("target"))
    pairs = there.join(crawled, "to_path").where("to_path != path")
    back = there.select(F.col("path").alias("target"), F.col("to_path").alias("path")).distinct()
    return _issue(pairs.join(back, ["target", "path"], "left_anti"), "key", {"hreflang": "lang", "target": "href"})


@rule("internal-link-scheme-mix", "link-consistency/warning", REVIEW)
def _(site: Site, t: Thresholds) -> DataFrame:
    rows = site.links.withColumns({"host": urls.host(F.col("target")), "scheme": urls.scheme(F.col("target"))})
    mixed = rows.groupBy("host").agg(F.countDistinct("scheme").alias("n"), F.min(F.when(F.col("scheme") == "http", F.col("target"))).alias("plain"), F.min(F.when(F.col("scheme") == "https", F.col("target"))).alias("secure")).where("n > 1")
    return _issue(mixed, "plain", {"host": "host", "http": "plain", "https": "secure"}, None)


@rule("internal-link-www-mix", "link-consistency/warning")
def _(site: Site, t: Thresholds) -> DataFrame:
    rows = site.links.withColumn("host", urls.host(F.col("target")))
    www = F.col("host").startswith("www.")
    mixed = rows.groupBy(urls.strip_www(F.col("host")).alias("family")).agg(F.min(F.when(www, F.col("target"))).alias("with_www"), F.min(F.when(~www, F.col("target"))).alias("bare")).where("with_www is not null and bare is not null")
    return _issue(mixed, "with_www", {"family": "family", "www": "with_www", "bare": "bare"}, None)


@rule("weakly-linked", "links/warning")
def _(site: Site, t: Thresholds) -> DataFrame:
    rows = site.own.where("depth > 0").join(site.inlinks, F.col("path") == F.col("target_path")).where(F.col("inlinks").between(1, t.weak_inlink_count))
    return _issue(rows, "key", {"inlinks": "inlinks"})


@rule("canonical-target-invalid", "canonical/warning")
def _(site: Site, t: Thresholds) -> DataFrame:
    rows = site.own.withColumn("to", urls.pathname(F.col("canonical"))).where("to is not null and to != path").select("page_id", "key", "canonical", "to")
    rows = rows.join(site.by_path.select(F.col("at_path").alias("to"), "page"), "to", "left")
    if site.failed is not None:
        rows = rows.join(site.failed.withColumnRenamed("failed_path", "to"), "to", "left")
    else:
        rows = rows.withColumn("failed_status", F.lit(None).cast("int"))
    reason = F.when(F.col("failed_status").isNotNull(), "failed").when(F.col("page.status_code") >= 400, "error status").when(F.col("page.hops") > 0, "redirects").when(F.col("page.noindex"), "noindex")
    return _issue(rows.withColumn("reason", reason).where("reason is not null"), "key", {"canonical": "canonical", "reason": "reason"})


@rule("broken-internal-link", "links/error")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _issue(site.resolved.where((F.col("status") >= 400) & ~F.col("status").isin(*AUTH)), "source", {"target": "target", "status_code": "status", "anchor": "anchor", "position": "position"})


@rule("auth-required-link", "links/notice")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _issue(site.resolved.where(F.col("status").isin(*AUTH)), "source", {"target": "target", "status_code": "status", "position": "position"})


@rule("canonical-chain", "canonical/warning", REVIEW)
def _(site: Site, t: Thresholds) -> DataFrame:
    first = site.own.withColumn("to", urls.pathname(F.col("canonical"))).where("to is not null and to != path").select("page_id", "key", "path", F.col("canonical").alias("first"), "to")
    second = site.by_path.select(F.col("at_path").alias("to"), F.col("page.canonical").alias("second"), F.col("page.path").alias("middle"), F.col("page.final_path").alias("middle_final"))
    rows = first.join(second, "to").withColumn("next", urls.pathname(F.col("second")))
    return _issue(rows.where("next is not null and next != middle and next != coalesce(middle_final, middle)"), "key", {"canonical": "first", "then": "second"})


@rule("excessive-links", "links/notice", tier="heuristic")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _issue(site.own.where(F.size("links") > t.excessive_links_count), "key", {"links": F.size("links")})


#: Anchors that name the click and not the target.
VAGUE = r"(?i)^(click here|here|read more|more|learn more|find out more|continue|continue reading|this|this page|link|download|see more|view more|details|go)$"


@rule("vague-anchor-text", "links/notice", tier="heuristic")
def _(site: Site, t: Thresholds) -> DataFrame:
    found = F.filter("links", lambda x: F.trim(x["anchor"]).rlike(VAGUE))
    return _issue(site.own.withColumn("found", found).where(F.size("found") > 0), "key", {"anchors": F.array_join(F.slice(F.transform("found", lambda x: x["anchor"]), 1, 5), " | "), "count": F.size("found")})


@rule("high-empty-anchor-ratio", "links/notice", tier="heuristic")
def _(site: Site, t: Thresholds) -> DataFrame:
    inner = F.filter("links", lambda x: x["type"] == "internal")
    rows = site.own.withColumns({"n": F.size(inner), "blank": F.size(F.filter(inner, lambda x: x["anchor"].isNull() | (F.trim(x["anchor"]) == "")))})
    return _issue(rows.where((F.col("n") > 0) & (F.col("blank") / F.col("n") > t.empty_anchor_ratio_max)), "key", {"blank": "blank", "links": "n"})


@rule("page-no-internal-links", "links/warning", tier="observed")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _issue(site.own.where((F.col("status_code") < 400) & ~F.exists("links", lambda x: x["type"] == "internal")), "key", {"status_code": "status_code"})


def orphans(site: Site, definition: str = "summary") -> DataFrame:
    """Pages that no page links to. `summary`: 2xx pages but the seed, by normalised URL, self-links count; `graph`: by path and query, without self-links; `rollup`: depth over 0 and no link to the path from another page."""
    if definition == "rollup":
        return site.own.where("depth > 0").join(site.inlinks, F.col("path") == F.col("target_path"), "left_anti")
    ok = F.coalesce("status_code", F.lit(200)).between(200, 299)
    rows = site.own.where(ok & (~F.col("key").eqNullSafe(F.lit(site.seed)) if site.seed else F.coalesce("depth", F.lit(1)) > 0))
    if definition == "graph":
        targets = site.links.where(~urls.path_and_query(F.coalesce("target_normalized", "target")).eqNullSafe(urls.path_and_query(F.coalesce("source_normalized", "source"))))
        return rows.withColumn("k", urls.path_and_query(F.col("key"))).join(targets.select(urls.path_and_query(F.coalesce("target_normalized", "target")).alias("k")).distinct(), "k", "left_anti").drop("k")
    return rows.join(site.links.select(F.coalesce("target_normalized", "target").alias("key")).distinct(), "key", "left_anti")


@rule("orphan-page", "orphans/warning")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _issue(orphans(site), "key", {"inlinks": F.lit(0)})


@rule("redirect-chain", "redirects/warning", "auto-safe")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _issue(site.own.where(F.size("redirect_chain") > t.redirect_chain_max), "key", {"hops": F.size("redirect_chain"), "final_url": "final_url"})


@rule("redirect-loop", "redirects/error", tier="observed")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    return None if site.failures is None else _issue(site.failures.where("reason = 'redirect-loop'"), F.coalesce("normalized_url", "url"), {"reason": "reason"}, None)


@rule("redirect-to-error", "redirects/error")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _issue(site.own.where((F.size("redirect_chain") > 0) & (F.col("status_code") >= 400)), "key", {"status_code": "status_code", "final_url": "final_url"})


@rule("redirect-temporary", "redirects/notice", tier="observed")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _issue(site.own.where(F.exists("redirect_chain", lambda x: x["status_code"].isin(302, 307))), "key", {"hops": F.size("redirect_chain")})


@rule("redirect-single-hop", "redirects/notice", tier="observed")
def _(site: Site, t: Thresholds) -> DataFrame:
    return _issue(site.own.where(F.size("redirect_chain") == 1), "key", {"final_url": "final_url"})


@rule("robots-blocked", "robots/notice", tier="observed")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    return None if site.blocked is None else _issue(site.blocked, "url", {"url": "url"}, None)


@rule("no-usable-robots-txt", "robots/notice", REVIEW, "observed")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    return None if site.robots is None else _issue(site.robots.where("parse_status != 'ok'"), "url", {"parse_status": "parse_status"}, None)


def _listed(site: Site, test: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    return None if site.entries is None else _issue(test(site.entries), "loc", {"loc": "loc"}, None)


@rule("sitemap-404-entry", "sitemap/warning")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    if site.failed is None:
        return None
    return _listed(site, lambda e: e.join(site.failed, F.col("entry_path") == F.col("failed_path"), "left_semi"))


@rule("sitemap-noindex-included", "sitemap/warning")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    return None if site.entries is None else _issue(site.own.where("robots.noindex").join(site.entries, F.col("path") == F.col("entry_path"), "left_semi"), "key", {"robots.noindex": F.lit(True)})


@rule("sitemap-not-crawled", "sitemap/notice")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    def missing(e: DataFrame) -> DataFrame:
        e = e.join(site.by_path, F.col("entry_path") == F.col("at_path"), "left_anti")
        return e if site.failed is None else e.join(site.failed, F.col("entry_path") == F.col("failed_path"), "left_anti")

    return _listed(site, missing)


@rule("crawled-not-in-sitemap", "sitemap/notice", REVIEW)
def _(site: Site, t: Thresholds) -> DataFrame | None:
    if site.entries is None:
        return None
    rows = site.own.where("status_code is null or status_code < 400")
    for key in ("path", "final_path"):
        rows = rows.join(site.entries.select(F.col("entry_path").alias(key)), key, "left_anti")
    return _issue(rows, "key", {"path": "path"})


@rule("sitemap-too-many-urls", "sitemap/error", tier="observed")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    return None if site.sitemap_files is None else _issue(site.sitemap_files.where(F.col("url_count") > t.sitemap_max_urls), "url", {"url_count": "url_count"}, None)


@rule("no-sitemap-found", "sitemap/warning", REVIEW)
def _(site: Site, t: Thresholds) -> DataFrame | None:
    return None if site.sitemap is None else _issue(site.sitemap.agg(F.count(F.lit(1)).alias("n")).where("n = 0").withColumn("url", F.lit(site.seed).cast("string")), "url", {"entries": "n"}, None)


@rule("sitemap-lists-blocked-urls", "sitemap/warning")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    if site.blocked is None:
        return None
    return _listed(site, lambda e: e.join(site.blocked.select(urls.pathname(F.col("url")).alias("entry_path")).distinct(), "entry_path", "left_semi"))


@rule("sitemap-page-no-inlinks", "sitemap/notice")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    def unlinked(e: DataFrame) -> DataFrame:
        crawled = e.join(site.by_path, F.col("entry_path") == F.col("at_path")).where("page.depth is null or page.depth != 0")
        return crawled.join(site.inlinks, F.col("entry_path") == F.col("target_path"), "left_anti")

    return _listed(site, unlinked)


@rule("sitemap-url-noncanonical", "sitemap/warning", REVIEW)
def _(site: Site, t: Thresholds) -> DataFrame | None:
    if site.entries is None:
        return None
    rows = site.own.withColumn("to", urls.pathname(F.col("canonical"))).where("to is not null and to != path")
    return _issue(rows.join(site.entries, F.col("path") == F.col("entry_path"), "left_semi"), "key", {"canonical": "canonical"})


@rule("sitemap-lastmod-suspect", "sitemap/notice", tier="heuristic")
def _(site: Site, t: Thresholds) -> DataFrame | None:
    return None if site.lastmod is None else _issue(site.lastmod.where("verdict like 'suspect%'").withColumn("url", F.lit(site.seed).cast("string")), "url", {"verdict": "verdict"}, None)


def evaluate(site: Site, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(issues, evaluated), as of the page rules; a site rule counts as evaluated over all pages."""
    spark = site.pages.sparkSession
    issues, met = None, []
    for r in RULES:
        if r.id in config.disabled:
            continue
        found = r.run(site, config.thresholds)
        met.append((r.id, r.category, config.severities.get(r.id, r.severity), found is not None))
        if found is not None:
            rows = found.select(F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(config.severities.get(r.id, r.severity)).alias("severity"), F.lit("site").alias("scope"), "page_id", "url", "evidence")
            issues = rows if issues is None else issues.unionByName(rows)
    run = F.broadcast(site.pages.agg(F.min("run_id").alias("run_id"), F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")))  # one row
    rules = spark.createDataFrame(met, "rule_id string, category string, severity string, met boolean")
    issues = issues.crossJoin(run.select("run_id")).select("run_id", "rule_id", "category", "severity", "scope", "page_id", "url", "evidence")
    failed = issues.groupBy("rule_id").agg(F.count_distinct(F.coalesce("page_id", "url")).alias("failed"))
    counts = rules.crossJoin(run).join(failed, "rule_id", "left").select("run_id", "rule_id", "category", "severity", F.when(F.col("met"), F.col("n")).otherwise(F.lit(0)).alias("evaluated"), F.coalesce("failed", F.lit(0)).alias("failed"))
    return issues, counts


def catalog() -> list[tuple[str, str, str, str, str, str]]:
    return [(r.id, r.category, r.severity, "site", r.automation, r.tier) for r in RULES]
