"""The rules over one page, as column expressions: what a rule needs, and the issues it finds, each a list of evidence.

A rule whose needs are not met was not evaluated: it leaves the denominator. All rules run in one projection; the issues are
one generator over its array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions import text as tx
from sitequarry.functions import urls
from sitequarry.plans.lineage import cut
from sitequarry.plans.config import Config, Thresholds

EVIDENCE = "array<struct<field: string, value: string>>"
#: How sure a finding of each tier is.
CONFIDENCE = {"observed": 1.0, "derived": 0.9, "heuristic": 0.7}


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    automation: str
    tier: str
    evaluated: Callable[[Thresholds], Column]
    #: One list of evidence for each issue.
    issues: Callable[[Thresholds], Column]


RULES: list[Rule] = []


def c(name: str) -> Column:
    return F.col(name)


def _evidence(*names: str) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("field"), c(n).cast("string").alias("value")) for n in names])


def _add(id: str, kind: str, automation: str, tier: str, test: Callable[[Thresholds], Column], shows: tuple[str, ...], needs: str | Callable[[Thresholds], Column] | None = None) -> None:
    """A rule with at most one issue a page."""
    category, severity = kind.split("/")
    met = (lambda t: F.lit(True)) if needs is None else (lambda t: c(needs).isNotNull()) if isinstance(needs, str) else needs
    RULES.append(Rule(id, category, severity, automation, tier, met, lambda t: F.when(F.coalesce(test(t), F.lit(False)), F.array(_evidence(*shows)))))


def _items(path: str, sub: str, test: Callable[[Column], Column]) -> Column:
    """Evidence for the elements of an array that meet test: `path[i].sub`."""
    own = F.transform(c(path), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    hit = F.filter(own, lambda e: F.coalesce(test(e["x"]), F.lit(False)))
    value = (lambda e: e["x"][sub].cast("string")) if sub else (lambda e: e["x"].cast("string"))
    return F.transform(hit, lambda e: F.struct(F.concat(F.lit(f"{path}["), e["i"].cast("string"), F.lit("]" + (f".{sub}" if sub else ""))).alias("field"), value(e).alias("value")))


def _add_any(id: str, kind: str, automation: str, tier: str, path: str, sub: str, test: Callable[[Column], Column], needs: str | None = None, most: int | None = None) -> None:
    """A rule with one issue a page if any element meets test; the elements are its evidence."""
    category, severity = kind.split("/")

    def issues(t: Thresholds) -> Column:
        found = _items(path, sub, test)
        return F.when(F.size(found) > 0, F.array(F.slice(found, 1, most) if most else found))

    RULES.append(Rule(id, category, severity, automation, tier, lambda t: c(needs or path.split(".")[0]).isNotNull(), issues))


def _add_each(id: str, kind: str, automation: str, tier: str, path: str, sub: str, test: Callable[[Column], Column], needs: str | None = None) -> None:
    """A rule with an issue for each element that meets test."""
    category, severity = kind.split("/")
    RULES.append(Rule(id, category, severity, automation, tier, lambda t: c(needs or path.split(".")[0]).isNotNull(), lambda t: F.transform(_items(path, sub, test), lambda e: F.array(e))))


def blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


REVIEW, HUMAN, SAFE = "auto-with-review", "human-only", "auto-safe"
OBSERVED, DERIVED, HEURISTIC = "observed", "derived", "heuristic"

# content
_add("thin-content", "content/warning", HUMAN, HEURISTIC, lambda t: c("content.word_count") < t.thin_content_words, ("content.word_count",), "content")
_add("low-text-ratio", "content/notice", HUMAN, HEURISTIC, lambda t: c("page_stats.text_ratio") < t.low_text_ratio, ("page_stats.text_ratio",), "page_stats")
_add("zero-word-content", "content/error", HUMAN, OBSERVED, lambda t: c("content.word_count") <= 0, ("content.word_count",), "content")
_add(
    "low-readability", "content/notice", HUMAN, HEURISTIC,
    lambda t: (c("content.area_method") == "article") & (c("content.word_count") >= 100) & (tx.readability(c("content.text"))["ease"] < t.flesch_min),
    ("content.word_count",), lambda t: c("content.area_method").isNotNull(),
)

# fonts
_add_any("font-preload-missing-crossorigin", "performance/warning", REVIEW, OBSERVED, "fonts.faces", "family", lambda x: x["preload_missing_crossorigin"])
_add_any("font-display-blocking", "performance/notice", REVIEW, OBSERVED, "fonts.faces", "display", lambda x: F.lower(x["display"]).isin("block", "auto"))
_add("third-party-font-host", "privacy/notice", HUMAN, OBSERVED, lambda t: F.size("fonts.third_party_hosts") > 0, ("fonts.third_party_hosts",), "fonts")

# head
_add("viewport-missing", "mobile/warning", REVIEW, OBSERVED, lambda t: c("head_meta.viewport").isNull(), ("head_meta.viewport",), "head_meta")
_add("viewport-blocks-zoom", "mobile/warning", REVIEW, OBSERVED, lambda t: c("head_meta.viewport_blocks_zoom"), ("head_meta.viewport",), "head_meta")
_add("charset-missing", "head/warning", HUMAN, OBSERVED, lambda t: c("charset.value").isNull(), ("charset.value",), "charset")
_add("charset-not-effective", "head/warning", HUMAN, OBSERVED, lambda t: c("charset.value").isNotNull() & ~c("charset.effective"), ("charset.value", "charset.source"), "charset")
_add("base-href-multiple", "head/warning", HUMAN, OBSERVED, lambda t: c("base_href.count") > 1, ("base_href.count",), "base_href")


def _base_elsewhere(t: Thresholds) -> Column:
    own = F.coalesce(c("final_url"), c("url"))
    href = F.when(c("base_href.href").startswith("//"), F.concat(urls.scheme(own), F.lit(":"), c("base_href.href"))).otherwise(c("base_href.href"))
    return urls.is_url(href) & (urls.origin(href) != urls.origin(own))


_add("base-href-cross-origin", "head/warning", HUMAN, OBSERVED, _base_elsewhere, ("base_href.href",), "base_href")
_add_any("head-signal-stranded", "head/warning", HUMAN, OBSERVED, "head_boundary.stranded", "signal", lambda x: ~x["honoured"])
_add("favicon-not-declared", "head/notice", HUMAN, HEURISTIC, lambda t: ~F.exists("favicons", lambda x: x["source"] != "implicit"), ("favicons",), "favicons")

# http
_add("http-error-4xx", "http/error", HUMAN, OBSERVED, lambda t: c("status_code").between(400, 499), ("status_code",), "status_code")
_add("http-error-5xx", "http/error", HUMAN, OBSERVED, lambda t: c("status_code").between(500, 599), ("status_code",), "status_code")
_add("slow-page", "http/warning", HUMAN, HEURISTIC, lambda t: c("response_time_ms") > t.slow_page_ms, ("response_time_ms",), lambda t: c("response_time_ms").isNotNull() & ~c("rendered_with").eqNullSafe("playwright"))
_add("no-compression", "http/notice", REVIEW, OBSERVED, lambda t: c("content_encoding").isNull() & (c("page_stats.html_bytes") > t.no_compression_min_bytes), ("page_stats.html_bytes",), lambda t: c("page_stats").isNotNull() & c("status_code").isNotNull())

# images
_add_any("image-missing-alt", "images/warning", HUMAN, OBSERVED, "images", "src", lambda x: x["alt"].isNull())
_add_any("image-empty-alt", "images/notice", HUMAN, HEURISTIC, "images", "src", lambda x: x["alt"] == "")
_add_any("image-bad-format", "images/warning", REVIEW, OBSERVED, "images", "format", lambda x: F.lower(x["format"]).isin("bmp", "tiff", "tif", "ico"))
_add_any("image-missing-dimensions", "images/notice", SAFE, OBSERVED, "images", "src", lambda x: x["width"].isNull() | x["height"].isNull())

# indexability
_add("noindex", "indexability/error", HUMAN, OBSERVED, lambda t: c("robots.noindex"), ("robots.meta",), "robots")
_add("canonical-mismatch", "indexability/warning", HUMAN, OBSERVED, lambda t: urls.is_url(c("canonical")) & (urls.same_key(c("canonical")) != urls.same_key(F.coalesce(c("final_url"), c("url")))), ("canonical", "url"))
_add("canonical-absent", "indexability/notice", SAFE, OBSERVED, lambda t: c("canonical").isNull(), ("canonical",))
_add("nofollow", "indexability/warning", HUMAN, OBSERVED, lambda t: c("robots.nofollow"), ("robots.meta",), "robots")
#: Fixed value: phrases by which a page says that it is none.
SOFT_404 = r"(?i)\b(404|page not found|not found|doesn'?t exist|no longer available|nothing here)\b"
_add(
    "soft-404", "indexability/warning", HUMAN, HEURISTIC,
    lambda t: (c("status_code") == 200) & (c("content.word_count") <= t.soft_404_max_words) & F.concat_ws(" ", c("title"), F.array_join("headings.h1", " ")).rlike(SOFT_404),
    ("title", "content.word_count"), lambda t: c("status_code").isNotNull() & c("content").isNotNull(),
)
_add("meta-refresh-present", "indexability/warning", REVIEW, OBSERVED, lambda t: c("meta_refresh").isNotNull(), ("meta_refresh",), "robots")

# on-page
_add("url-too-long", "on-page/notice", HUMAN, OBSERVED, lambda t: tx.utf16_length(c("normalized_url")) > t.url_max_chars, ("normalized_url",), "normalized_url")
_add("title-missing", "on-page/error", HUMAN, OBSERVED, lambda t: blank(c("title")), ("title",))
_add("title-too-short", "on-page/warning", HUMAN, OBSERVED, lambda t: ~blank(c("title")) & ((tx.utf16_length(c("title")) < t.title_min_chars) | (tx.estimate_px(c("title"), tx.TITLE_PX) < t.title_min_px)), ("title",))
_add("title-too-long", "on-page/warning", HUMAN, OBSERVED, lambda t: ~blank(c("title")) & ((tx.utf16_length(c("title")) > t.title_max_chars) | (tx.estimate_px(c("title"), tx.TITLE_PX) > t.title_max_px)), ("title",))
_add("title-multiple", "on-page/warning", HUMAN, OBSERVED, lambda t: F.size("titles") > 1, ("titles",), "titles")
_add("meta-description-missing", "on-page/warning", HUMAN, OBSERVED, lambda t: blank(c("meta_description")), ("meta_description",))
_add("meta-description-too-short", "on-page/warning", HUMAN, OBSERVED, lambda t: ~blank(c("meta_description")) & ((tx.utf16_length(c("meta_description")) < t.desc_min_chars) | (tx.estimate_px(c("meta_description"), tx.DESCRIPTION_PX) < t.desc_min_px)), ("meta_description",))
_add("meta-description-too-long", "on-page/warning", HUMAN, OBSERVED, lambda t: ~blank(c("meta_description")) & ((tx.utf16_length(c("meta_description")) > t.desc_max_chars) | (tx.estimate_px(c("meta_description"), tx.DESCRIPTION_PX) > t.desc_max_px)), ("meta_description",))
_add("meta-description-multiple", "on-page/warning", HUMAN, OBSERVED, lambda t: F.size("meta_descriptions") > 1, ("meta_descriptions",), "meta_descriptions")
_add("h1-missing", "on-page/warning", HUMAN, OBSERVED, lambda t: F.size("headings.h1") == 0, ("headings.h1",), "headings")
_add("h1-multiple", "on-page/notice", HUMAN, OBSERVED, lambda t: F.size("headings.h1") > 1, ("headings.h1",), "headings")


def _level_skipped(t: Thresholds) -> Column:
    levels = F.transform("structure.headings", lambda h: h["level"])
    before = F.concat(F.array(F.lit(1)), levels)
    by_order = F.exists(F.arrays_zip(levels.alias("a"), F.slice(before, 1, F.greatest(F.size(levels), F.lit(0))).alias("b")), lambda x: x["a"] - x["b"] > 1)
    by_level = (F.size("headings.h3") > 0) & (F.size("headings.h2") == 0)
    return F.when(c("structure.headings").isNotNull(), by_order).otherwise(by_level)


_add("heading-hierarchy-skip", "on-page/notice", HUMAN, OBSERVED, _level_skipped, ("headings",), "headings")
_add_any("heading-empty", "on-page/notice", HUMAN, OBSERVED, "structure.headings", "text", lambda x: F.trim(x["text"]) == "", most=5)


def _unlike(t: Thresholds) -> Column:
    a, b = tx.significant_words(c("title")), tx.significant_words(F.try_element_at("headings.h1", F.lit(1)))
    return (F.size(a) >= 2) & (F.size(b) >= 2) & ~F.arrays_overlap(a, b)


_add("title-h1-mismatch", "on-page/notice", HUMAN, HEURISTIC, _unlike, ("title", "headings.h1"), lambda t: c("title").isNotNull() & (F.size("headings.h1") > 0))
_add("long-content-no-subheadings", "on-page/notice", HUMAN, HEURISTIC, lambda t: (c("content.word_count") > t.long_content_words) & (F.size("headings.h2") + F.size("headings.h3") <= 1), ("content.word_count",), "content")

# what rendering changes
_add("js-applied-noindex", "indexability/error", HUMAN, OBSERVED, lambda t: ~c("render_divergence.static_noindex") & c("render_divergence.rendered_noindex"), ("render_divergence.rendered_noindex",), lambda t: c("render_divergence.static_noindex").isNotNull() & c("render_divergence.rendered_noindex").isNotNull())
_add("noindex-in-raw-html-only", "indexability/error", HUMAN, OBSERVED, lambda t: c("render_divergence.static_noindex") & ~c("render_divergence.rendered_noindex"), ("render_divergence.static_noindex",), lambda t: c("render_divergence.static_noindex").isNotNull() & c("render_divergence.rendered_noindex").isNotNull())
_add("canonical-changed-by-js", "canonical/warning", HUMAN, OBSERVED, lambda t: ~c("render_divergence.static_canonical").eqNullSafe(c("render_divergence.rendered_canonical")), ("render_divergence.static_canonical", "render_divergence.rendered_canonical"), "render_divergence")
_add(
    "content-requires-javascript", "indexability/warning", HUMAN, HEURISTIC,
    lambda t: (c("render_divergence.word_count_delta") > 0) & (F.try_divide(c("render_divergence.word_count_delta"), c("content.word_count")) >= t.js_only_content_ratio) & (c("render_divergence.word_count_delta") >= t.thin_content_words),
    ("render_divergence.word_count_delta", "content.word_count"), "render_divergence",
)
_add(
    "render-added-nothing", "performance/notice", HUMAN, DERIVED,
    lambda t: (c("render_divergence.word_count_delta") <= 0) & (F.coalesce(c("render_divergence.link_count_delta"), F.lit(0)) <= 0) & ~F.coalesce(c("render_divergence.title_changed"), F.lit(False)) & ~F.coalesce(c("render_divergence.description_changed"), F.lit(False)) & c("render_divergence.static_canonical").eqNullSafe(c("render_divergence.rendered_canonical")) & c("render_divergence.static_noindex").eqNullSafe(c("render_divergence.rendered_noindex")),
    ("render_divergence.word_count_delta",), lambda t: c("render_divergence").isNotNull() & c("rendered_with").eqNullSafe("playwright"),
)

# security
SECURITY_HEADERS = ("content-security-policy", "x-frame-options", "x-content-type-options", "referrer-policy")


def _headers_missing(t: Thresholds) -> Column:
    wanted = F.when(urls.scheme(c("url")) == "https", F.array(*[F.lit(h) for h in (*SECURITY_HEADERS, "strict-transport-security")])).otherwise(F.array(*[F.lit(h) for h in SECURITY_HEADERS]))
    return F.size(F.array_except(wanted, F.transform(F.map_keys("headers"), F.lower))) > 0


_add("security-headers-missing", "security/notice", HUMAN, OBSERVED, _headers_missing, ("headers",), lambda t: c("headers").isNotNull() & c("page_stats").isNotNull())

# social
_add("og-missing", "social/notice", HUMAN, OBSERVED, lambda t: F.size(F.map_keys("social.og")) == 0, ("social.og",), "social")
_add("twitter-missing", "social/notice", HUMAN, OBSERVED, lambda t: F.size(F.map_keys("social.twitter")) == 0, ("social.twitter",), "social")
_add("og-incomplete", "social/notice", HUMAN, OBSERVED, lambda t: (F.size(F.map_keys("social.og")) > 0) & (F.size(F.array_except(F.array(*[F.lit(f"og:{k}") for k in ("title", "description", "image", "url")]), F.map_keys("social.og"))) > 0), ("social.og",), "social")

# structure
_add("main-landmark-missing", "structure/notice", HUMAN, OBSERVED, lambda t: ~F.array_contains("structure.landmarks", "main") & ~c("content.area_method").eqNullSafe("role-main"), ("structure.landmarks",), "structure")

# structured data
_add_any("structured-data-missing-recommended-property", "structured-data/notice", HUMAN, OBSERVED, "schema_items", "path", lambda x: (x["status"] != "reference") & (F.size(x["missing_recommended"]) > 0) & ~F.array_contains(x["types"], "ImageObject"))
_add_any("structured-data-unknown-type", "structured-data/warning", HUMAN, OBSERVED, "schema_items", "path", lambda x: x["status"] == "unknown-type")
for _kind, _severity, _automation in (("missing-type", "warning", HUMAN), ("missing-context", "warning", REVIEW), ("invalid-context", "warning", REVIEW), ("empty-block", "notice", REVIEW)):
    _add_any(f"structured-data-{_kind}", f"structured-data/{_severity}", _automation, OBSERVED, "schema_errors", "path", lambda x, kind=_kind: x["kind"] == kind)
_add("structured-data-no-json-ld", "structured-data/notice", HUMAN, OBSERVED, lambda t: (F.size("schema_items") > 0) & ~F.exists("schema_items", lambda x: x["format"] == "json-ld"), ("schema_items",), lambda t: c("schema_items").isNotNull() & ~c("schema_truncated"))
_add("no-structured-data", "structured-data/notice", HUMAN, OBSERVED, lambda t: F.size("schema_items") == 0, ("schema_items",), lambda t: c("schema_items").isNotNull() & ~c("schema_truncated"))
_add_each("structured-data-parse-error", "structured-data/error", HUMAN, OBSERVED, "schema_errors", "path", lambda x: x["kind"] == "malformed-json")
_add_each("structured-data-missing-required-property", "structured-data/warning", HUMAN, OBSERVED, "schema_items", "path", lambda x: (x["status"] != "reference") & (F.size(x["missing_required"]) > 0))
#: Words of which a page about a type of item has one.
TYPE_HINTS = {"Recipe": "recipe recipes cook food", "Event": "event events", "JobPosting": "job jobs career careers", "Course": "course courses", "Movie": "movie movies film", "Book": "book books"}


def _off_topic(x: Column) -> Column:
    about = F.lower(F.concat_ws(" ", c("url"), c("title"), F.array_join("headings.h1", " "), c("content.text")))
    out = F.lit(False)
    for kind, hints in TYPE_HINTS.items():
        out = out | (F.array_contains(x["types"], kind) & ~about.rlike("|".join(hints.split())))
    return out & (F.size(x["missing_required"]) > 0) & (x["status"] != "reference")


_add_each("structured-data-type-mismatch", "structured-data/warning", HUMAN, HEURISTIC, "schema_items", "path", _off_topic)
_add("video-embed-without-schema", "structured-data/notice", HUMAN, OBSERVED, lambda t: F.exists("videos", lambda v: v["kind"].isin("youtube", "vimeo")) & ~F.exists("schema_items", lambda x: F.array_contains(x["types"], "VideoObject")), ("videos",), lambda t: c("videos").isNotNull() & c("schema_items").isNotNull())

# transport
_add("page-not-https", "security/error", HUMAN, OBSERVED, lambda t: (urls.scheme(F.coalesce(c("final_url"), c("url"))) == "http") & ~urls.host(F.coalesce(c("final_url"), c("url"))).rlike(r"^(localhost|127\.[\d.]+|\[::1\])$"), ("url",))


def _plain_parts(t: Thresholds) -> Column:
    parts = F.concat(
        F.transform("images", lambda x: x["src"]), F.transform("videos", lambda x: x["url"]), F.transform("videos", lambda x: F.coalesce(x["poster"], F.lit(""))),
        F.flatten(F.transform("fonts.faces", lambda x: x["urls"])), F.transform(F.filter("favicons", lambda x: x["source"] != "implicit"), lambda x: x["href"]),
    )
    return (urls.scheme(F.coalesce(c("final_url"), c("url"))) == "https") & F.exists(parts, lambda u: u.startswith("http://"))


_add("mixed-content", "security/warning", SAFE, OBSERVED, _plain_parts, ("url",), lambda t: c("images").isNotNull() & c("videos").isNotNull() & c("fonts").isNotNull() & c("favicons").isNotNull())
_add("oversized-html", "performance/warning", HUMAN, HEURISTIC, lambda t: c("page_stats.html_bytes") > t.oversized_html_bytes, ("page_stats.html_bytes",), "page_stats")


def chosen(config: Config) -> list[Rule]:
    return [r for r in RULES if r.id not in config.disabled]


def evaluate(pages: DataFrame, config: Config = Config(), both: bool = False) -> tuple[DataFrame, DataFrame]:
    """(issues, evaluated): a row for each issue, and for each rule over how many pages it was evaluated and how many failed. both: the rules run once for both tables, whose results are written in between."""
    t, rules = config.thresholds, chosen(config)
    none = F.array().cast(f"array<{EVIDENCE}>")
    results = F.array(*[
        F.struct(
            F.lit(r.id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(config.severities.get(r.id, r.severity)).alias("severity"),
            F.when(F.coalesce(r.evaluated(t), F.lit(False)), F.coalesce(r.issues(t).cast(f"array<{EVIDENCE}>"), none)).alias("issues"),
        )
        for r in rules
    ])
    ids = ("run_id", "page_id", "url", "normalized_url")
    run = (cut(pages.select(*ids, results.alias("results"))).select(*ids, F.explode("results").alias("r")) if both else pages.select(*ids, F.explode(results).alias("r"))).select(*ids, "r.*")
    issues = run.select("run_id", "rule_id", "category", "severity", F.lit("page").alias("scope"), "page_id", F.coalesce("normalized_url", "url").alias("url"), F.explode("issues").alias("evidence"))
    counts = run.groupBy("run_id", "rule_id", "category", "severity").agg(F.count("issues").alias("evaluated"), F.count_if(F.size("issues") > 0).alias("failed"))
    return issues, counts


def catalog() -> list[tuple[str, str, str, str, str, str]]:
    """(rule, category, severity, scope, automation, tier) of the page rules."""
    return [(r.id, r.category, r.severity, "page", r.automation, r.tier) for r in RULES]
