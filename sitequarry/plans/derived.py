"""A crawl derived from the driver's tables, to hold every rule against SQL: parts are pages, line items are links.

Each fact of a page follows from its key by arithmetic, so that SQL can say by itself which pages a rule must find. Every 19th
part could not be fetched. The rules run through page_rules.evaluate and site_rules.evaluate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from sitequarry.operators import diff, explore, measurements, page_rules, scoring, site_rules
from sitequarry.operators.site_rules import Site
from sitequarry.plans.config import Config, Thresholds
from sitequarry.plans.lineage import cut
from sitequarry.sources import crawl

HOST = "https://shop.example.com"
#: Facts of a page by its key k, as Spark SQL.
FACTS = {
    "run_id": "'r'", "page_id": "string(k)", "input_order": "k", "url": "u", "normalized_url": "u",
    "final_url": f"CASE WHEN k % 11 = 0 THEN concat('{HOST}/r/', k) WHEN k % 23 = 5 THEN concat('http://shop.example.com/p/', k) ELSE u END",
    "status_code": "CASE WHEN k % 37 = 1 THEN 404 WHEN k % 41 = 1 THEN 503 WHEN k % 43 = 1 THEN 403 WHEN k % 47 = 1 THEN NULL ELSE 200 END",
    "redirect_chain": "transform(CASE WHEN k % 22 = 0 THEN array(1, 2) WHEN k % 11 = 0 THEN array(1) ELSE array() END, x -> named_struct('from', u, 'to', u, 'status_code', if(k % 3 = 0, 302, 301)))",
    "response_time_ms": "k % 5 * 1000", "rendered_with": "if(k % 7 = 0, 'playwright', 'http')", "content_encoding": "if(k % 2 = 0, 'gzip', null)",
    "headers": "if(k % 4 = 0, map('X-Frame-Options', '1', 'content-security-policy', '1', 'x-content-type-options', '1', 'referrer-policy', '1', 'strict-transport-security', '1'), map('x-frame-options', '1'))",
    "depth": "if(k = 1, 0, 1 + k % 4)",
    "title": "CASE WHEN k % 13 = 0 THEN NULL WHEN k % 13 = 1 THEN '  ' WHEN k % 13 = 2 THEN repeat(p_name, 12) WHEN k % 13 = 3 THEN 'A reasonable title of some forty letters' ELSE p_name END",
    "titles": "if(k % 14 = 3, array('a', 'b'), array('a'))",
    "meta_description": "CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'short' WHEN k % 9 = 2 THEN repeat('long words ', 20) ELSE concat(p_name, repeat(' describes the thing', 5)) END",
    "meta_descriptions": "if(k % 15 = 4, array('a', 'b'), array('a'))",
    "meta_refresh": "if(k % 53 = 2, named_struct('delay', 1.0), null)",
    "canonical": f"CASE WHEN k % 10 IN (3, 7) THEN concat('{HOST}/p/', k + 4) WHEN k % 10 = 5 THEN NULL ELSE u END",
    "robots": "named_struct('meta', array('x'), 'noindex', k % 17 = 0, 'nofollow', k % 17 = 1)",
    "headings": "named_struct('h1', CASE WHEN k % 12 = 0 THEN array() WHEN k % 12 = 1 THEN array(p_name, 'b') WHEN k % 59 = 3 THEN array('Page not found') ELSE array(p_name) END, 'h2', if(k % 3 = 0, array(), array('x')), 'h3', if(k % 6 = 0, array('y'), array()))",
    "structure": "named_struct('headings', CASE WHEN k % 8 = 0 THEN array(named_struct('level', 1, 'text', 'a'), named_struct('level', 3, 'text', 'b')) WHEN k % 8 = 1 THEN array(named_struct('level', 2, 'text', ' ')) ELSE array(named_struct('level', 1, 'text', 'a'), named_struct('level', 2, 'text', 'b')) END, 'landmarks', if(k % 5 = 0, array(), array('main')))",
    "content": "named_struct('text', p_name, 'word_count', 2 * (p_size - 1), 'content_hash', concat(p_brand, p_type, p_size), 'area_method', if(k % 6 = 0, 'article', 'body'))",
    "page_stats": "named_struct('html_bytes', 1000 * (k % 5) + if(k % 101 = 0, 600000, 0), 'text_ratio', (k % 20) / 20.0)",
    "fonts": "named_struct('faces', CASE WHEN k % 21 = 0 THEN array(named_struct('family', 'f', 'display', 'swap', 'urls', array('x'), 'preload_missing_crossorigin', true)) WHEN k % 21 = 1 THEN array(named_struct('family', 'f', 'display', 'Block', 'urls', array('x'), 'preload_missing_crossorigin', false)) ELSE array() END, 'third_party_hosts', if(k % 21 = 2, array('fonts.gstatic.com'), array()))",
    "head_meta": "named_struct('viewport', if(k % 16 = 0, null, 'width=device-width'), 'viewport_blocks_zoom', k % 16 = 1)",
    "charset": "named_struct('value', if(k % 18 = 0, null, 'utf-8'), 'source', 'meta', 'effective', k % 18 > 1)",
    "base_href": "named_struct('href', if(k % 24 = 1, 'https://other.example.com/', null), 'count', if(k % 24 = 0, 2, 1))",
    "head_boundary": "named_struct('stranded', CASE WHEN k % 25 = 0 THEN array(named_struct('signal', 's', 'honoured', false)) WHEN k % 25 = 1 THEN array(named_struct('signal', 's', 'honoured', true)) ELSE array() END)",
    "favicons": f"array(named_struct('href', concat('{HOST}/i', k % 2, '.ico'), 'source', if(k % 5 = 0, 'implicit', 'declared')))",
    "images": f"array(named_struct('src', concat(if(k % 26 = 4, 'http', 'https'), '://shop.example.com/a'), 'alt', CASE WHEN k % 26 = 0 THEN NULL WHEN k % 26 = 1 THEN '' ELSE 'a' END, 'width', if(k % 26 = 3, null, 1), 'height', 1, 'format', if(k % 26 = 2, 'BMP', 'png')))",
    "videos": "if(k % 27 = 0, array(named_struct('kind', 'youtube', 'url', 'https://v')), array())",
    "social": "named_struct('og', CASE WHEN k % 28 = 0 THEN map() WHEN k % 28 = 1 THEN map('og:title', 'a') ELSE map('og:title', 'a', 'og:description', 'a', 'og:image', 'a', 'og:url', 'a') END, 'twitter', if(k % 28 = 2, map(), map('twitter:card', 'a')))",
    "schema_items": "if(k % 30 = 0, array(), array(named_struct('format', if(k % 30 = 1, 'microdata', 'json-ld'), 'types', array(if(k % 30 = 5, 'VideoObject', 'Product')), 'path', '$', 'status', CASE WHEN k % 30 = 2 THEN 'unknown-type' WHEN k % 30 = 3 THEN 'incomplete' WHEN k % 30 = 6 THEN 'reference' ELSE 'valid' END, 'missing_required', if(k % 30 IN (3, 6), array('name'), array()), 'missing_recommended', if(k % 30 IN (4, 6), array('image'), array()))))",
    "schema_errors": "if(k % 31 < 5, array(named_struct('kind', element_at(array('malformed-json', 'missing-type', 'missing-context', 'invalid-context', 'empty-block'), int(k % 31 + 1)), 'path', '$')), array())",
    "schema_truncated": "k % 29 = 3",
    "render_divergence": "if(k % 7 = 0, named_struct('static_noindex', k % 2 = 0, 'rendered_noindex', k % 3 = 0, 'static_canonical', 'a', 'rendered_canonical', if(k % 5 = 0, 'b', 'a'), 'word_count_delta', if(k % 4 = 3, 90, int(k % 4) - 1)), null)",
    "hreflang": f"CASE WHEN k % 6 = 0 THEN array(named_struct('lang', 'de', 'href', concat('{HOST}/p/', k + 1))) WHEN k % 12 = 1 THEN array(named_struct('lang', 'en', 'href', concat('{HOST}/p/', k - 1))) ELSE array() END",
}
#: Which pages (c) a page rule must find, as the SQL of the oracle. T is the trimmed title.
PAGE_SQL = {
    "thin-content": "words < 80", "zero-word-content": "words = 0", "low-text-ratio": "k % 20 < 2",
    "font-preload-missing-crossorigin": "k % 21 = 0", "font-display-blocking": "k % 21 = 1", "third-party-font-host": "k % 21 = 2",
    "viewport-missing": "k % 16 = 0", "viewport-blocks-zoom": "k % 16 = 1", "charset-missing": "k % 18 = 0", "charset-not-effective": "k % 18 = 1",
    "base-href-multiple": "k % 24 = 0", "base-href-cross-origin": "k % 24 = 1", "head-signal-stranded": "k % 25 = 0", "favicon-not-declared": "k % 5 = 0",
    "http-error-4xx": "status BETWEEN 400 AND 499", "http-error-5xx": "status >= 500", "slow-page": "k % 5 >= 3 AND k % 7 <> 0",
    "no-compression": "k % 2 = 1 AND bytes > 2000 AND status IS NOT NULL", "oversized-html": "bytes > 512000",
    "image-missing-alt": "k % 26 = 0", "image-empty-alt": "k % 26 = 1", "image-bad-format": "k % 26 = 2", "image-missing-dimensions": "k % 26 = 3",
    "noindex": "k % 17 = 0", "nofollow": "k % 17 = 1", "canonical-absent": "k % 10 = 5", "canonical-mismatch": "k % 10 <> 5 AND (k % 10 IN (3, 7) OR k % 11 = 0)",
    "soft-404": "status = 200 AND words <= 120 AND k % 59 = 3 AND k % 12 > 1", "meta-refresh-present": "k % 53 = 2",
    "title-missing": "k % 13 < 2", "title-too-short": "k % 13 > 3", "title-too-long": "k % 13 = 2", "title-multiple": "k % 14 = 3",
    "meta-description-missing": "k % 9 = 0", "meta-description-too-short": "k % 9 = 1", "meta-description-too-long": "k % 9 = 2", "meta-description-multiple": "k % 15 = 4",
    "h1-missing": "k % 12 = 0", "h1-multiple": "k % 12 = 1", "heading-hierarchy-skip": "k % 8 = 0", "heading-empty": "k % 8 = 1",
    "js-applied-noindex": "k % 7 = 0 AND k % 2 = 1 AND k % 3 = 0", "noindex-in-raw-html-only": "k % 7 = 0 AND k % 2 = 0 AND k % 3 <> 0", "canonical-changed-by-js": "k % 7 = 0 AND k % 5 = 0",
    "content-requires-javascript": "k % 7 = 0 AND k % 4 = 3 AND words BETWEEN 1 AND 180", "render-added-nothing": "k % 7 = 0 AND k % 4 < 2 AND k % 5 <> 0 AND (k % 2 = 0) = (k % 3 = 0)",
    "security-headers-missing": "k % 4 <> 0", "og-missing": "k % 28 = 0", "og-incomplete": "k % 28 = 1", "twitter-missing": "k % 28 = 2", "main-landmark-missing": "k % 5 = 0",
    "structured-data-missing-recommended-property": "k % 30 = 4", "structured-data-unknown-type": "k % 30 = 2", "structured-data-missing-required-property": "k % 30 = 3",
    "structured-data-missing-type": "k % 31 = 1", "structured-data-missing-context": "k % 31 = 2", "structured-data-invalid-context": "k % 31 = 3", "structured-data-empty-block": "k % 31 = 4", "structured-data-parse-error": "k % 31 = 0",
    "structured-data-no-json-ld": "k % 30 = 1 AND k % 29 <> 3", "no-structured-data": "k % 30 = 0 AND k % 29 <> 3", "video-embed-without-schema": "k % 27 = 0 AND k % 30 <> 5",
    "page-not-https": "k % 11 <> 0 AND k % 23 = 5", "mixed-content": "k % 26 = 4 AND (k % 11 = 0 OR k % 23 <> 5)",
}
#: Tables of the oracle: parts, crawled pages, failures, links, statuses by key, canonical targets, sitemap entries.
TABLES_SQL = f"""
p AS (SELECT p_partkey AS k, '{HOST}/p/' || p_partkey AS url, p_name, p_brand, p_type, p_size FROM part),
c AS (SELECT *, 2 * (p_size - 1) AS words, 1000 * (k % 5) + CASE WHEN k % 101 = 0 THEN 600000 ELSE 0 END AS bytes, CASE WHEN k = 1 THEN 0 ELSE 1 + k % 4 END AS depth,
  CASE WHEN k % 37 = 1 THEN 404 WHEN k % 41 = 1 THEN 503 WHEN k % 43 = 1 THEN 403 WHEN k % 47 = 1 THEN NULL ELSE 200 END AS status, CASE WHEN k % 22 = 0 THEN 2 WHEN k % 11 = 0 THEN 1 ELSE 0 END AS hops,
  CASE WHEN k % 13 = 2 THEN repeat(p_name, 12) WHEN k % 13 = 3 THEN 'm' WHEN k % 13 > 3 THEN p_name END AS title, CASE WHEN k % 9 = 1 THEN 's' WHEN k % 9 = 2 THEN 'l' WHEN k % 9 > 2 THEN 'n' || p_name END AS descr,
  CASE WHEN k % 10 IN (3, 7) THEN k + 4 WHEN k % 10 <> 5 THEN k END AS canon FROM p WHERE k % 19 <> 0),
f AS (SELECT k, url, CASE k % 4 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 410 ELSE 500 END AS status, k % 57 = 0 AS loops FROM p WHERE k % 19 = 0),
l AS (SELECT l_partkey AS src, l_orderkey AS dst, l_returnflag <> 'R' AS inner_link, CASE WHEN l_quantity <= 10 THEN '' WHEN l_quantity <= 20 THEN 'Read more' ELSE 'goods' END AS anchor,
  CASE WHEN l_linenumber = 6 THEN 'http://shop.example.com' WHEN l_linenumber = 5 THEN 'https://www.shop.example.com' ELSE '{HOST}' END || '/p/' || l_orderkey AS target FROM lineitem JOIN c ON k = l_partkey),
i AS (SELECT * FROM l WHERE inner_link),
s AS (SELECT k, status FROM c UNION ALL SELECT k, status FROM f),
n AS (SELECT dst AS k, count(*) AS inlinks FROM i WHERE src <> dst GROUP BY 1),
e AS (SELECT k, url FROM p WHERE k % 3 <> 0 UNION ALL SELECT -1 - k, '{HOST}/q/' || k FROM p WHERE k % 50 = 0)"""
SITE_SQL = {
    "duplicate-title": "SELECT url FROM c WHERE title IN (SELECT title FROM c GROUP BY 1 HAVING count(*) > 1)",
    "duplicate-description": "SELECT url FROM c WHERE descr IN (SELECT descr FROM c GROUP BY 1 HAVING count(*) > 1)",
    "exact-duplicate-content": "SELECT url FROM c WHERE words > 0 AND (p_brand, p_type, p_size) IN (SELECT (p_brand, p_type, p_size) FROM c GROUP BY p_brand, p_type, p_size HAVING count(*) > 1)",
    "favicon-inconsistent": "SELECT url FROM c WHERE k % 5 <> 0",
    "hreflang-not-reciprocal": "SELECT a.url FROM c a JOIN c b ON b.k = a.k + 1 WHERE a.k % 6 = 0 AND a.k % 12 <> 0",
    "internal-link-scheme-mix": "SELECT min(target) FILTER (target LIKE 'http:%') AS url FROM i GROUP BY regexp_extract(target, '//([^/]*)', 1) HAVING count(DISTINCT split_part(target, ':', 1)) > 1",
    "internal-link-www-mix": "SELECT min(target) FILTER (target LIKE '%//www.%') AS url FROM i",
    "weakly-linked": "SELECT url FROM c JOIN n USING (k) WHERE depth > 0 AND inlinks = 1",
    "canonical-target-invalid": "SELECT a.url FROM c a LEFT JOIN c b ON b.k = a.canon LEFT JOIN f ON f.k = a.canon WHERE a.canon <> a.k AND (f.k IS NOT NULL OR b.status >= 400 OR b.hops > 0 OR b.k % 17 = 0)",
    "broken-internal-link": "SELECT c.url FROM i JOIN c ON c.k = src JOIN s ON s.k = dst WHERE s.status >= 400 AND s.status NOT IN (401, 403)",
    "auth-required-link": "SELECT c.url FROM i JOIN c ON c.k = src JOIN s ON s.k = dst WHERE s.status IN (401, 403)",
    "canonical-chain": "SELECT a.url FROM c a JOIN c b ON b.k = a.canon WHERE a.canon <> a.k AND b.canon <> b.k",
    "excessive-links": "SELECT url FROM c JOIN (SELECT src AS k, count(*) AS n FROM l GROUP BY 1) USING (k) WHERE n > 35",
    "vague-anchor-text": "SELECT url FROM c WHERE k IN (SELECT src FROM l WHERE anchor = 'Read more')",
    "high-empty-anchor-ratio": "SELECT url FROM c JOIN (SELECT src AS k, count(*) FILTER (anchor = '') / count(*) AS r FROM i GROUP BY 1) USING (k) WHERE r > 0.3",
    "page-no-internal-links": "SELECT url FROM c WHERE status < 400 AND k NOT IN (SELECT src FROM i)",
    "orphan-page": "SELECT url FROM c WHERE coalesce(status, 200) BETWEEN 200 AND 299 AND depth > 0 AND url NOT IN (SELECT target FROM i)",
    "redirect-chain": "SELECT url FROM c WHERE hops > 1", "redirect-single-hop": "SELECT url FROM c WHERE hops = 1",
    "redirect-to-error": "SELECT url FROM c WHERE hops > 0 AND status >= 400", "redirect-temporary": "SELECT url FROM c WHERE hops > 0 AND k % 3 = 0",
    "redirect-loop": "SELECT url FROM f WHERE loops", "robots-blocked": "SELECT url FROM p WHERE k % 29 = 0",
    "no-usable-robots-txt": f"SELECT '{HOST}/robots.txt' AS url",
    "sitemap-404-entry": "SELECT url FROM f WHERE k % 3 <> 0", "sitemap-noindex-included": "SELECT url FROM c WHERE k % 17 = 0 AND k % 3 <> 0",
    "sitemap-not-crawled": "SELECT url FROM e WHERE k < 0", "crawled-not-in-sitemap": "SELECT url FROM c WHERE coalesce(status, 200) < 400 AND k % 3 = 0",
    "sitemap-too-many-urls": f"SELECT '{HOST}/sitemap-1.xml' AS url", "sitemap-lists-blocked-urls": "SELECT url FROM e WHERE k >= 0 AND k % 29 = 0",
    "sitemap-page-no-inlinks": "SELECT url FROM c WHERE k % 3 <> 0 AND depth <> 0 AND k NOT IN (SELECT k FROM n)",
    "sitemap-url-noncanonical": "SELECT url FROM c WHERE canon <> k AND k % 3 <> 0",
}


def page_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, url FROM c WHERE {test}" for r, test in PAGE_SQL.items())
    return f"WITH {TABLES_SQL} {rules}"


def site_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, url FROM ({sql})" for r, sql in SITE_SQL.items())
    return f"WITH {TABLES_SQL} SELECT rule_id, url, count(*) AS issues FROM ({rules}) WHERE url IS NOT NULL GROUP BY 1, 2"


def parts(part: DataFrame) -> DataFrame:
    return part.selectExpr("p_partkey AS k", f"concat('{HOST}/p/', p_partkey) AS u", "p_name", "p_brand", "p_type", "p_size")


def pages(part: DataFrame, lineitem: DataFrame | None = None) -> DataFrame:
    """The crawled pages, with their links if lineitem is given. A part is few bytes and much work as a page: however few files and row groups hold them, they are dealt over all cores."""
    kinds = {f.name: f.dataType for f in crawl.page_schema().fields}
    rows = parts(part).where("k % 19 != 0").repartition(2 * part.sparkSession.sparkContext.defaultParallelism)
    if lineitem is not None:
        target = f"concat(CASE WHEN l_linenumber = 6 THEN 'http://shop.example.com' WHEN l_linenumber = 5 THEN 'https://www.shop.example.com' ELSE '{HOST}' END, '/p/', l_orderkey)"
        link = f"named_struct('target', {target}, 'target_normalized', {target}, 'anchor', CASE WHEN l_quantity <= 10 THEN '' WHEN l_quantity <= 20 THEN 'Read more' ELSE 'goods' END, 'type', if(l_returnflag = 'R', 'external', 'internal'))"
        links = lineitem.selectExpr("l_partkey AS k", f"{link} AS link").groupBy("k").agg(F.collect_list("link").alias("_links"))
        rows = rows.join(links, "k", "left").withColumn("_links", F.coalesce("_links", F.expr("array()")))

    def fact(name: str, sql: str):
        kind = kinds[name]
        if isinstance(kind, StructType) or (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)):
            # fields that the expression leaves out become null
            return F.from_json(F.to_json(F.expr(sql)), kind).alias(name)
        return F.expr(sql).cast(kind).alias(name)

    facts = FACTS | ({"links": "_links"} if lineitem is not None else {})
    return crawl.complete(rows.select(*[fact(n, sql) for n, sql in facts.items()]))


def page_rule_hits(part: DataFrame) -> DataFrame:
    config = Config(disabled=frozenset(r.id for r in page_rules.RULES) - frozenset(PAGE_SQL))
    return page_rules.evaluate(pages(part), config)[0].select("rule_id", "url")


def site(part: DataFrame, lineitem: DataFrame) -> Site:
    spark, own = part.sparkSession, parts(part)
    failures = own.where("k % 19 = 0").selectExpr("u AS url", "u AS normalized_url", "if(k % 57 = 0, 'redirect-loop', 'http-error') AS reason", "CASE k % 4 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 410 ELSE 500 END AS status_code")
    entries = own.where("k % 3 != 0").selectExpr("k AS input_order", "u AS loc", "u AS normalized_loc").unionByName(own.where("k % 50 = 0").selectExpr("k AS input_order", f"concat('{HOST}/q/', k) AS loc", f"concat('{HOST}/q/', k) AS normalized_loc"))
    files = spark.createDataFrame([(f"{HOST}/sitemap-1.xml", 50_001), (f"{HOST}/sitemap-2.xml", 50_000)], "url string, url_count int")
    robots = spark.createDataFrame([(f"{HOST}/robots.txt", "missing"), ("https://www.shop.example.com/robots.txt", "ok")], "url string, parse_status string")
    return Site(cut(pages(part, lineitem)), failures=cut(failures), blocked=own.where("k % 29 = 0").selectExpr("u AS url"), sitemap=cut(entries), sitemap_files=files, robots=robots)


def site_rule_hits(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    config = Config(Thresholds(excessive_links_count=35), disabled=frozenset(r.id for r in site_rules.RULES) - frozenset(SITE_SQL))
    return site_rules.evaluate(site(part, lineitem), config)[0].groupBy("rule_id", "url").agg(F.count(F.lit(1)).alias("issues"))


def hits_sql() -> str:
    """Tables and h(rule_id, k, url, severity, tier, automation, category): the pages that each rule must find, with the rule's own marks."""
    rules = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, k, url FROM c WHERE {test}" for r, test in PAGE_SQL.items())
    book = ", ".join(f"('{r.id}', '{r.category}', '{r.severity}', '{r.automation}', '{r.tier}')" for r in page_rules.RULES if r.id in PAGE_SQL)
    return f"WITH {TABLES_SQL}, book(rule_id, category, severity, automation, tier) AS (VALUES {book}), h AS (SELECT * FROM ({rules}) JOIN book USING (rule_id))"


def _issues(t) -> DataFrame:
    config = Config(disabled=frozenset(r.id for r in page_rules.RULES) - frozenset(PAGE_SQL))
    return cut(page_rules.evaluate(pages(t.part), config)[0])


def _changes(t) -> DataFrame:
    found = _issues(t)
    return diff.issue_diff(found.where("rule_id in ('noindex', 'nofollow')"), found.where("rule_id in ('noindex', 'title-missing')"))


def _site(t) -> Site:
    return site(t.part, t.lineitem)


#: Queries over the derived crawl by name: the library's operator, and its SQL.
CHECKS: dict[str, tuple] = {
    "page_rules_on_parts": (lambda t: page_rule_hits(t.part), page_sql()),
    "site_rules_on_parts": (lambda t: site_rule_hits(t.part, t.lineitem), site_sql()),
    "explored_pages": (
        lambda t: explore.filter_pages(explore.page_rows(pages(t.part), _issues(t)), status=200, q="/p/1", min_words=20, max_words=60, depth=2, section="/p", indexable=True).select("url", "errors", "warnings", "notices"),
        hits_sql() + ", g AS (SELECT url, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'notice') AS notices FROM h GROUP BY 1) SELECT url, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(notices, 0) AS notices FROM c LEFT JOIN g USING (url) WHERE words BETWEEN 20 AND 60 AND status = 200 AND k % 17 <> 0 AND depth = 2 AND url LIKE '%/p/1%'",
    ),
    "issues_of_rule": (lambda t: explore.filter_issues(_issues(t), severity="warning", category="on-page", q="/p/2").select("rule_id", "url"), hits_sql() + " SELECT rule_id, url FROM h WHERE severity = 'warning' AND category = 'on-page' AND url LIKE '%/p/2%'"),
    "pages_by_rule": (lambda t: explore.filter_pages(explore.page_rows(pages(t.part), _issues(t)), severity="error", rule="noindex").select("url"), hits_sql() + " SELECT url FROM h WHERE rule_id = 'noindex'"),
    "severity_counts": (lambda t: scoring.severity_counts(_issues(t)).select("severity", "issues"), hits_sql() + " SELECT severity, count(*) AS issues FROM h GROUP BY 1"),
    "issues_by_category": (lambda t: explore.group_issues(_issues(t), "category").select("category", "issues", "pages"), hits_sql() + " SELECT category, count(*) AS issues, count(DISTINCT k) AS pages FROM h GROUP BY 1"),
    "issues_by_rule": (lambda t: scoring.issues_by_rule(_issues(t), 100).select("rule_id", "affected", "issues", "percent"), hits_sql() + " SELECT rule_id, count(DISTINCT k) AS affected, count(*) AS issues, floor(count(DISTINCT k) * 100.0::DOUBLE / 100 * 10 + 0.5) / 10 AS percent FROM h GROUP BY 1"),
    "automation_report": (
        lambda t: scoring.automation_report(_issues(t)).select("rule_id", "automation", "affected", "effort"),
        hits_sql() + " SELECT rule_id, automation, affected, CASE WHEN automation = 'auto-safe' THEN 'low' WHEN automation = 'auto-with-review' AND affected <= 50 THEN 'low' WHEN automation = 'auto-with-review' THEN 'medium' WHEN affected > 50 THEN 'high' ELSE 'medium' END AS effort FROM (SELECT rule_id, automation, count(DISTINCT k) AS affected FROM h GROUP BY 1, 2)",
    ),
    "worst_derived_pages": (
        lambda t: scoring.worst_pages(_issues(t)).select("page_id", "issues", F.floor(F.col("harm") * 100 + 0.5).cast("long").alias("harm"), F.col("top_rules")[0].alias("worst")),
        hits_sql() + ", w AS (SELECT k, rule_id, CASE severity WHEN 'error' THEN 100 WHEN 'warning' THEN 60 ELSE 30 END * CASE tier WHEN 'observed' THEN 10 WHEN 'derived' THEN 9 ELSE 7 END AS harm FROM h) SELECT k::VARCHAR AS page_id, count(*) AS issues, CAST(sum(harm) // 10 AS BIGINT) AS harm, arg_min(rule_id, (-harm, rule_id)) AS worst FROM w GROUP BY 1",
    ),
    "fix_patches": (
        lambda t: scoring.fix_plan(_issues(t), pages(t.part)).where("rule_id in ('canonical-absent', 'noindex')").select("rule_id", "url", "patch", "automation"),
        hits_sql() + " SELECT rule_id, url, '<link rel=\"canonical\" href=\"' || url || '\">' AS patch, 'auto-safe' AS automation FROM h WHERE rule_id = 'canonical-absent' UNION ALL SELECT rule_id, url, 'review noindex', automation FROM h WHERE rule_id = 'noindex'",
    ),
    "status_urls": (lambda t: measurements.status_histogram(_site(t).pages, _site(t).failures), f"WITH {TABLES_SQL} SELECT status AS status_code, count(*) AS urls FROM s GROUP BY 1"),
    "depth_pages": (lambda t: measurements.depth_histogram(pages(t.part)), f"WITH {TABLES_SQL} SELECT depth, count(*) AS pages FROM c GROUP BY 1"),
    "failure_reasons": (lambda t: measurements.failures_by_class(_site(t).failures), f"WITH {TABLES_SQL} SELECT CASE WHEN loops THEN 'redirect-loop' ELSE 'http-error' END AS reason, count(*) AS failures FROM f GROUP BY 1"),
    "run_summary": (
        lambda t: measurements.summary(_site(t)).select("discovered", "attempted", "successful", "max_depth", "internal_links", "external_links", "orphan_candidates", "coverage"),
        f"WITH {TABLES_SQL}, g AS (SELECT count(*) AS n FROM c WHERE status BETWEEN 200 AND 299) SELECT (SELECT count(*) FROM p) AS discovered, (SELECT count(*) FROM p) AS attempted, g.n AS successful, (SELECT max(depth) FROM c) AS max_depth, (SELECT count(*) FROM i) AS internal_links, (SELECT count(*) FROM l WHERE NOT inner_link) AS external_links, (SELECT count(*) FROM ({SITE_SQL['orphan-page']})) AS orphan_candidates, floor(1000.0::DOUBLE * g.n / (SELECT count(*) FROM p) + 0.5) / 10 AS coverage FROM g",
    ),
    "derived_measurements": (
        lambda t: measurements.measurements(_site(t)).where("measurement not in ('title-too-wide', 'reading-ease')").select("measurement", "value"),
        f"WITH {TABLES_SQL} SELECT measurement, CAST(value AS DOUBLE) AS value FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS measurement, {v} AS value" for m, v in {
            "pages-crawled": "(SELECT count(*) FROM c)", "redirects": "(SELECT count(*) FROM c WHERE hops > 0)", "missing-title": "(SELECT count(*) FROM c WHERE k % 13 < 2)", "missing-meta-description": "(SELECT count(*) FROM c WHERE k % 9 = 0)",
            "missing-h1": "(SELECT count(*) FROM c WHERE k % 12 = 0)", "multiple-h1": "(SELECT count(*) FROM c WHERE k % 12 = 1)", "thin-content": "(SELECT count(*) FROM c WHERE words < 80)", "average-word-count": "(SELECT floor(avg(words) * 10 + 0.5) / 10 FROM c)",
            "noindex": "(SELECT count(*) FROM c WHERE k % 17 = 0)", "deep-pages": "(SELECT count(*) FROM c WHERE depth > 3)", "needs-javascript": "(SELECT count(*) FROM c WHERE k % 7 = 0)", "missing-open-graph": "(SELECT count(*) FROM c WHERE k % 28 = 0)",
            "incomplete-schema": "(SELECT count(*) FROM c WHERE k % 30 IN (3, 6))", "images-without-alt": "(SELECT count(*) FROM c WHERE k % 26 = 0)", "mixed-content": "(SELECT count(*) FROM c WHERE k % 26 = 4 AND (k % 11 = 0 OR k % 23 <> 5))",
            "average-ttfb": "NULL", "average-response": "(SELECT floor(avg(k % 5 * 1000) * 10 + 0.5) / 10 FROM c)", "average-dom-nodes": "NULL", "average-page-weight": "(SELECT floor(avg(bytes) * 10 + 0.5) / 10 FROM c)",
            "certificate": "NULL", "render-blocking": "NULL", "heavy-images": "NULL", "broken-pages": "(SELECT count(*) FROM s WHERE status >= 400)",
            "broken-internal-links": f"(SELECT count(*) FROM ({SITE_SQL['broken-internal-link']}))", "orphan-pages": f"(SELECT count(*) FROM ({SITE_SQL['orphan-page']}))", "duplicate-content": f"(SELECT count(*) FROM ({SITE_SQL['exact-duplicate-content']}))",
        }.items()) + ")",
    ),
    "inlink_index": (lambda t: _site(t).inlinks.select(F.col("target_path").alias("path"), "inlinks"), f"WITH {TABLES_SQL} SELECT '/p/' || k AS path, inlinks FROM n"),
    "orphans_by_links": (lambda t: site_rules.orphans(_site(t), "rollup").select("url"), f"WITH {TABLES_SQL} SELECT url FROM c WHERE depth > 0 AND k NOT IN (SELECT k FROM n)"),
    "orphans_by_graph": (lambda t: site_rules.orphans(_site(t), "graph").select("url"), f"WITH {TABLES_SQL} SELECT url FROM c WHERE coalesce(status, 200) BETWEEN 200 AND 299 AND depth > 0 AND k NOT IN (SELECT k FROM n)"),
    "link_targets": (
        lambda t: explore.link_rows(crawl.explode_links(pages(t.part, t.lineitem))).select("type", "to", "inbound", "anchors", F.size("sources").cast("long").alias("sources")),
        f"WITH {TABLES_SQL} SELECT CASE WHEN inner_link THEN 'internal' ELSE 'external' END AS type, target AS to, count(*) AS inbound, count(DISTINCT anchor) AS anchors, least(50, count(DISTINCT src)) AS sources FROM l GROUP BY 1, 2",
    ),
    "edge_status": (
        lambda t: explore.edges_with_status(crawl.explode_links(pages(t.part, t.lineitem)), pages(t.part)).groupBy("status_code").agg(F.count(F.lit(1)).alias("links")),
        f"WITH {TABLES_SQL} SELECT c.status AS status_code, count(*) AS links FROM l LEFT JOIN c ON c.url = l.target GROUP BY 1",
    ),
    "redirect_listing": (
        lambda t: explore.redirect_rows(pages(t.part)).select("url", F.col("hops").cast("long").alias("hops"), "kind"),
        f"WITH {TABLES_SQL} SELECT url, CAST(hops AS BIGINT) AS hops, CASE WHEN hops > 1 THEN 'chain' ELSE 'single' END AS kind FROM c WHERE hops > 0",
    ),
    "image_uses": (lambda t: explore.image_rows(crawl.explode_images(pages(t.part))).select("src", "uses", "missing_alt"), f"WITH {TABLES_SQL} SELECT CASE WHEN k % 26 = 4 THEN 'http' ELSE 'https' END || '://shop.example.com/a' AS src, count(*) AS uses, count(*) FILTER (k % 26 = 0) AS missing_alt FROM c GROUP BY 1"),
    "work_queue": (
        lambda t: explore.work_queue(explore.page_rows(pages(t.part))).select("url", F.array_join("labels", ",").alias("labels")),
        f"WITH {TABLES_SQL}, w AS (SELECT url, list_filter([CASE WHEN status >= 400 THEN 'broken' END, CASE WHEN words < 80 THEN 'thin' END, CASE WHEN coalesce(status, 200) >= 300 OR k % 17 = 0 THEN 'not indexable' END, CASE WHEN k % 13 < 2 THEN 'no title' END], lambda x: x IS NOT NULL) AS l FROM c) SELECT url, array_to_string(l, ',') AS labels FROM w WHERE len(l) > 0",
    ),
    "drilldown_noindex": (lambda t: explore.drilldown(pages(t.part), "noindex").select("url"), f"WITH {TABLES_SQL} SELECT url FROM c WHERE k % 17 = 0"),
    "drilldown_pages": (
        lambda t: explore.drilldown_counts(pages(t.part)).where("measurement != 'title-too-wide'"),
        f"WITH {TABLES_SQL} " + " UNION ALL ".join(f"SELECT '{m}' AS measurement, count(*) AS pages FROM c WHERE {test}" for m, test in {
            "pages-crawled": "true", "missing-title": "k % 13 < 2", "missing-meta-description": "k % 9 = 0", "missing-h1": "k % 12 = 0", "multiple-h1": "k % 12 = 1", "thin-content": "words < 80", "noindex": "k % 17 = 0", "deep-pages": "depth > 3", "needs-javascript": "k % 7 = 0",
            "redirects": "hops > 0", "missing-open-graph": "k % 28 = 0", "broken-pages": "status >= 400", "incomplete-schema": "k % 30 IN (3, 6)", "images-without-alt": "k % 26 = 0", "mixed-content": "k % 26 = 4 AND (k % 11 = 0 OR k % 23 <> 5)",
        }.items()),
    ),
    "section_pages": (lambda t: explore.section_rollup(explore.page_rows(pages(t.part))).select("section", "pages", "n_2xx", "n_4xx", "n_5xx"), f"WITH {TABLES_SQL} SELECT '/p' AS section, count(*) AS pages, count(*) FILTER (status = 200) AS n_2xx, count(*) FILTER (status BETWEEN 400 AND 499) AS n_4xx, count(*) FILTER (status >= 500) AS n_5xx FROM c"),
    "explorer_kinds": (lambda t: explore.explorer_rows(_site(t).pages, _site(t).failures.withColumn("depth", F.lit(None).cast("int")), _site(t).blocked).groupBy("kind").agg(F.count(F.lit(1)).alias("rows")), f"WITH {TABLES_SQL} SELECT 'page' AS kind, count(*) AS \"rows\" FROM c UNION ALL SELECT 'failure', count(*) FROM f UNION ALL SELECT 'blocked', count(*) FROM p WHERE k % 29 = 0"),
    "issue_changes": (
        _changes,
        hits_sql() + " SELECT rule_id, url, CASE rule_id WHEN 'noindex' THEN 'persisting' WHEN 'nofollow' THEN 'resolved' ELSE 'new' END AS change FROM h WHERE rule_id IN ('noindex', 'nofollow', 'title-missing')",
    ),
    "schema_type_use": (lambda t: diff.schema_types(pages(t.part), pages(t.part).where("status_code = 200")).select("type", "ours", "theirs"), f"WITH {TABLES_SQL} SELECT CASE WHEN k % 30 = 5 THEN 'VideoObject' ELSE 'Product' END AS type, count(*) AS ours, count(*) FILTER (status = 200) AS theirs FROM c WHERE k % 30 <> 0 GROUP BY 1"),
    "site_against_site": (
        lambda t: diff.competitor_grid(pages(t.part, t.lineitem), pages(t.part, t.lineitem).where("status_code = 200")).where("metric in ('pages', 'mean_words', 'max_depth', 'missing_h1_rate', 'noindex_rate', 'missing_alt_rate', 'schema_rate')").select("metric", "ours", "theirs", "delta"),
        f"WITH {TABLES_SQL}, z AS (SELECT *, true AS own FROM c UNION ALL SELECT *, false FROM c WHERE status = 200), m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, own, CAST({v} AS DOUBLE) AS v FROM z GROUP BY own" for m, v in {
            "pages": "count(*)", "mean_words": "floor(avg(words) * 10 + 0.5) / 10", "max_depth": "max(depth)", **{n: f"floor(count(*) FILTER ({x}) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10" for n, x in {"missing_h1_rate": "k % 12 = 0", "noindex_rate": "k % 17 = 0", "missing_alt_rate": "k % 26 = 0", "schema_rate": "k % 30 <> 0"}.items()},
        }.items()) + ") SELECT metric, ours, theirs, floor((ours - theirs) * 10 + 0.5) / 10 AS delta FROM (SELECT metric, max(v) FILTER (own) AS ours, max(v) FILTER (NOT own) AS theirs FROM m GROUP BY 1)",
    ),
}
