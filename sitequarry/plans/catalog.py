"""Registered queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitequarry.functions import domains, urls
from sitequarry.functions import text as tx
from sitequarry.operators import cosine, diff, explore, graph, linking, measurements, metrics, page_rules, resources, scoring, search, similarity, site_rules
from sitequarry.operators.site_rules import Site
from sitequarry.plans import derived, markup
from sitequarry.plans.config import Config
from sitequarry.plans.lineage import cut, shared_folder
from sitequarry.sources import crawl, sinks, site_files, sitemaps
from sitequarry.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        own = name or f.__name__
        QUERIES[own] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[own] = sql
        return f

    return add


# ---- URLs of pages ----

PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END"
PATHNAME = rf"regexp_replace({PATH}, '^(.+)/$', '\1')"
HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
SCHEME = r"lower(regexp_extract(url, '^([A-Za-z]+)://', 1))"
QUERY = r"regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
H1 = r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"


@query(f"SELECT page_id, {SCHEME} AS scheme, {HOST} AS host, {PATHNAME} AS pathname, {QUERY} AS query FROM pages")
def url_parts(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.pathname(u).alias("pathname"), urls.query(u).alias("query"))


@query(f"SELECT page_id, substr(sha256(url), 1, 12) AS id, CASE WHEN {SCHEME} = 'https' THEN 443 ELSE 80 END AS port FROM pages")
def page_ids(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.page_id(F.col("url")).alias("id"), F.when(urls.scheme(F.col("url")) == "https", 443).otherwise(80).alias("port"))


NORMALIZED = rf"""
WITH p AS (SELECT page_id, url, {SCHEME} AS s, {HOST} AS h, {PATHNAME} AS p, {QUERY} AS q FROM pages),
k AS (SELECT page_id, list_sort(list_distinct(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ('gclid', 'fbclid', 'msclkid', 'ref')))) AS l FROM p)
SELECT p.page_id, s || '://' || h || p || CASE WHEN len(l) > 0 THEN '?' || array_to_string(l, '&') ELSE '' END AS normalized FROM p JOIN k USING (page_id)"""


@query(NORMALIZED)
def url_normalized(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.normalize_url("url").alias("normalized"))


@query(f"SELECT CASE WHEN regexp_extract({PATH}, '^/([^/]+)', 1) = '' THEN '(root)' ELSE '/' || regexp_extract({PATH}, '^/([^/]+)', 1) END AS section, count(*) AS pages FROM pages GROUP BY 1")
def url_section_counts(t: Tables) -> DataFrame:
    return t.pages.groupBy(urls.section(F.col("url")).alias("section")).agg(F.count(F.lit(1)).alias("pages"))


@query(rf"SELECT regexp_replace({HOST}, '^www\.', '') AS family, count(DISTINCT {HOST}) AS hosts, count(*) AS pages, bool_or({HOST} LIKE 'www.%') AS with_www, bool_or({HOST} NOT LIKE 'www.%') AS bare FROM pages GROUP BY 1")
def host_family_mix(t: Tables) -> DataFrame:
    h = urls.host(F.col("url"))
    return t.pages.groupBy(urls.strip_www(h).alias("family")).agg(F.countDistinct(h).alias("hosts"), F.count(F.lit(1)).alias("pages"), F.bool_or(h.startswith("www.")).alias("with_www"), F.bool_or(~h.startswith("www.")).alias("bare"))


#: Hosts of the pages moved below suffixes of one and two labels, of a wildcard and of an exception, and addresses: by turns of the id.
MOVED = rf"CASE page_id % 6 WHEN 0 THEN {HOST} WHEN 1 THEN regexp_replace({HOST}, '[.][^.]*$', '.co.uk') WHEN 2 THEN regexp_replace({HOST}, '[.][^.]*$', '.ck') WHEN 3 THEN regexp_replace({HOST}, '[.][^.]*[.][^.]*$', '.city.kawasaki.jp') WHEN 4 THEN '10.0.0.' || page_id % 250 ELSE regexp_replace({HOST}, '[^.]*[.][^.]*$', 'www.ck') END"
MOVED_DOMAIN = rf"CASE page_id % 6 WHEN 0 THEN regexp_extract(h, '([^.]*[.][^.]*)$', 1) WHEN 1 THEN regexp_extract(h, '([^.]*[.]co[.]uk)$', 1) WHEN 2 THEN regexp_extract(h, '([^.]*[.][^.]*[.]ck)$', 1) WHEN 3 THEN 'city.kawasaki.jp' WHEN 5 THEN 'www.ck' END"


@query(f"WITH m AS (SELECT page_id, {MOVED} AS h FROM pages) SELECT page_id, h AS host, {MOVED_DOMAIN} AS domain FROM m")
def registrable_domains(t: Tables) -> DataFrame:
    k, h = F.col("page_id") % 6, urls.host(F.col("url"))
    moved = (
        F.when(k == 0, h).when(k == 1, F.regexp_replace(h, "[.][^.]*$", ".co.uk")).when(k == 2, F.regexp_replace(h, "[.][^.]*$", ".ck")).when(k == 3, F.regexp_replace(h, "[.][^.]*[.][^.]*$", ".city.kawasaki.jp"))
        .when(k == 4, F.concat(F.lit("10.0.0."), (F.col("page_id") % 250).cast("string"))).otherwise(F.regexp_replace(h, "[^.]*[.][^.]*$", "www.ck"))
    )
    return t.pages.select("page_id", moved.alias("host")).withColumn("domain", domains.registrable_domain(domains.suffix_rules(t.spark))("host"))


@query(rf"""WITH l AS (SELECT a.page_id AS source, b.page_id AS target, {HOST.replace("url", "a.url")} AS h, {HOST.replace("url", "b.url")} AS g FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)
SELECT source, target, CASE WHEN regexp_extract(h, '([^.]*[.][^.]*)$', 1) = regexp_extract(g, '([^.]*[.][^.]*)$', 1) THEN 'internal' ELSE 'external' END AS type FROM l""")
def links_by_site(t: Tables) -> DataFrame:
    """Each page linked to the next one: internal within a registrable domain, whatever the hosts below it."""
    after = t.pages.select(F.col("page_id").alias("target"), F.col("url").alias("there"), (F.col("page_id") - 1).alias("source"))
    links = t.pages.select(F.col("page_id").alias("source"), "url").join(after, "source")
    return domains.typed_links(links, domains.suffix_rules(t.spark), "url", "there").select("source", "target", "type")


@query(rf"SELECT page_id, regexp_extract({HOST}, '([^.]*[.][^.]*)$', 1) = 'example.com' OR regexp_replace({HOST}, '^www[.]', '') = 'tionble.example.org' AS inside FROM pages")
def pages_in_scope(t: Tables) -> DataFrame:
    rules = domains.suffix_rules(t.spark)
    scope = domains.derive_scope("https://www.example.com/", rules, ["www.tionble.example.org"])
    return t.pages.select("page_id", domains.in_scope(F.col("url"), scope, rules).alias("inside"))


@query(f"SELECT {HOST} AS host, count(*) FILTER ({SCHEME} = 'http') AS plain, count(*) FILTER ({SCHEME} = 'https') AS secure FROM pages GROUP BY 1 HAVING count(DISTINCT {SCHEME}) > 1")
def scheme_mix_by_host(t: Tables) -> DataFrame:
    s = urls.scheme(F.col("url"))
    return t.pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count_if(s == "http").alias("plain"), F.count_if(s == "https").alias("secure")).where("plain > 0 and secure > 0")


@query(rf"SELECT {HOST} || regexp_replace(regexp_replace(lower({PATH}), '/index\.html?$', '/'), '/$', '') || CASE WHEN {QUERY} <> '' THEN '?' || {QUERY} ELSE '' END AS variant, count(DISTINCT url) AS urls FROM pages GROUP BY 1")
def url_variant_groups(t: Tables) -> DataFrame:
    return t.pages.groupBy(urls.variant_key(F.col("url")).alias("variant")).agg(F.countDistinct("url").alias("urls"))


@query("SELECT page_id, length(url) AS chars FROM pages WHERE length(url) > 40")
def url_too_long(t: Tables) -> DataFrame:
    return t.pages.where(tx.utf16_length(F.col("url")) > 40).select("page_id", F.length("url").cast("long").alias("chars"))


# ---- facts of pages, native and through the extractor ----


@query(f"SELECT page_id, {TITLE} AS title, length({TITLE}) AS chars FROM pages")
def page_titles(t: Tables) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return t.pages.select("page_id", title.alias("title"), F.length(title).cast("long").alias("chars"))


ENTITY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&quot;?', '\"', 'g'), '&lt;?', '<', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {ENTITY.format(TITLE)} AS title, {ENTITY.format(H1)} AS h1, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links FROM pages")
def extracted_heads(t: Tables) -> DataFrame:
    """The extractor's title, first heading and number of links."""
    p = crawl.from_html(t.pages)
    return p.select(F.col("input_order").alias("page_id"), "title", F.col("headings.h1")[0].alias("h1"), F.size("links").cast("long").alias("links"))


@query(rf"SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_hrefs(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query(r"""SELECT target, count(*) AS inbound, count(DISTINCT anchor) AS anchors, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS target, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages) GROUP BY 1""")
def link_target_rollup(t: Tables) -> DataFrame:
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1)).alias("target"), F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1)).alias("anchor"))
    rows = t.pages.select("page_id", F.explode(pairs).alias("l")).select("page_id", "l.*")
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("inbound"), F.countDistinct("anchor").alias("anchors"), F.countDistinct("page_id").alias("pages"))


@query(r"""SELECT anchor, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor FROM pages) GROUP BY 1 ORDER BY uses DESC, anchor LIMIT 50""")
def anchor_rollup(t: Tables) -> DataFrame:
    return t.pages.select(F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.col("uses").desc(), "anchor").limit(50)


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS html_bytes FROM pages")
def html_bytes(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.octet_length("html").cast("long").alias("html_bytes"))


@query(f"SELECT title, n AS group_size, page_id FROM (SELECT page_id, trim({TITLE}) AS title, count(*) OVER (PARTITION BY trim({TITLE})) AS n FROM pages) WHERE n > 1 AND title <> ''")
def duplicate_titles(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title")).where("title != ''")
    return similarity.exact_groups(rows, "title").select("title", "group_size", "page_id")


@query(f"SELECT page_id, {SCHEME} = 'http' AS not_https FROM pages WHERE {SCHEME} = 'http'")
def page_not_https(t: Tables) -> DataFrame:
    return t.pages.where(urls.scheme(F.col("url")) == "http").select("page_id", F.lit(True).alias("not_https"))


def _run(t: Tables) -> DataFrame:
    return cut(crawl.from_html(crawl.first_pages(t.pages)))


@query()
def rule_issue_counts(t: Tables) -> DataFrame:
    """All page rules: evaluated and failed pages."""
    return page_rules.evaluate(_run(t))[1].select("rule_id", "category", "severity", "evaluated", "failed")


DECODED = f"trim(regexp_replace(regexp_replace(regexp_replace({TITLE}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"
PX = "+".join(f"(length(x) - length(translate(x, '{''.join(c.replace(chr(39), chr(39) * 2) for c in chars)}', ''))) * {w - tx.FALLBACK_WIDTH}" for w, chars in tx.WIDTHS.items() if w != tx.FALLBACK_WIDTH)
WIDE = f"floor((length(x) * {tx.FALLBACK_WIDTH} + {PX})::DOUBLE / 1000 * 20 + 0.5)"
RULE_SQL = f"""
WITH t AS (SELECT page_id, url, html, {DECODED} AS x FROM pages)
SELECT page_id, 'title-too-short' AS rule_id FROM t WHERE x <> '' AND (length(x) < 30 OR {WIDE} < 200)
UNION ALL SELECT page_id, 'title-too-long' FROM t WHERE x <> '' AND (length(x) > 60 OR {WIDE} > 561)
UNION ALL SELECT page_id, 'title-missing' FROM t WHERE x = ''
UNION ALL SELECT page_id, 'page-not-https' FROM t WHERE {SCHEME} = 'http'
UNION ALL SELECT page_id, 'meta-description-missing' FROM t WHERE html NOT LIKE '%name="description"%'
UNION ALL SELECT page_id, 'viewport-missing' FROM t WHERE html NOT LIKE '%name="viewport"%'
UNION ALL SELECT page_id, 'og-missing' FROM t WHERE html NOT LIKE '%property="og:%'
UNION ALL SELECT page_id, 'canonical-absent' FROM t WHERE html NOT LIKE '%rel="canonical"%'
UNION ALL SELECT page_id, 'h1-multiple' FROM t WHERE len(regexp_extract_all(html, '<h1[^>]*>')) > 1
UNION ALL SELECT page_id, 'oversized-html' FROM t WHERE octet_length(encode(html)) > 512000"""
RULE_IDS = ("title-too-short", "title-too-long", "title-missing", "page-not-https", "meta-description-missing", "viewport-missing", "og-missing", "canonical-absent", "h1-multiple", "oversized-html")


@query(RULE_SQL)
def page_rule_hits(t: Tables) -> DataFrame:
    """Pages by rule, of the rules that SQL can express over raw pages."""
    pages = crawl.from_html(t.pages).withColumn("page_id", F.col("input_order").cast("string"))
    config = Config(disabled=frozenset(r.id for r in page_rules.RULES) - frozenset(RULE_IDS))
    return page_rules.evaluate(pages, config)[0].select(F.col("page_id").cast("long").alias("page_id"), "rule_id")


HEALTH_SQL = f"""
WITH h AS ({RULE_SQL}), n AS (SELECT count(*) AS n FROM pages), a AS (SELECT rule_id, count(DISTINCT page_id) AS k FROM h GROUP BY 1),
p(rule_id, points, cat) AS (VALUES ('title-missing', 40.0, 'content'), ('title-too-long', 12.0, 'content'), ('title-too-short', 5.0, 'content'), ('page-not-https', 25.0, 'content'), ('meta-description-missing', 20.0, 'content'), ('h1-multiple', 8.0, 'content'),
 ('viewport-missing', 15.0, 'performance'), ('oversized-html', 10.0, 'performance'), ('og-missing', 12.0, 'media'), ('canonical-absent', 4.0, 'indexability')),
c(cat, weight) AS (VALUES ('indexability', 30), ('content', 25), ('links', 15), ('media', 15), ('performance', 15)),
l AS (SELECT cat, sum(points::DOUBLE * sqrt(least(1.0::DOUBLE, k::DOUBLE / n.n))) AS loss FROM a JOIN p USING (rule_id) CROSS JOIN n GROUP BY 1),
s AS (SELECT weight, greatest(0, least(100, floor(100 - coalesce(loss, 0) + 0.5))) AS score FROM c LEFT JOIN l USING (cat)),
t AS (SELECT floor(sum(score * weight)::DOUBLE / sum(weight) * 10 + 0.5) / 10 AS score FROM s)
SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' WHEN score >= 40 THEN 'E' ELSE 'F' END AS grade FROM t"""


@query(HEALTH_SQL)
def health_of_shown_rules(t: Tables) -> DataFrame:
    """The health score over the rules of page_rule_hits alone."""
    pages = cut(crawl.from_html(t.pages).withColumn("page_id", F.col("input_order").cast("string")))
    issues, counts = page_rules.evaluate(pages, Config(disabled=frozenset(r.id for r in page_rules.RULES) - frozenset(RULE_IDS)), both=True)
    return scoring.health_score(cut(issues), cut(counts)).select("score", "grade")


@query()
def site_rule_counts(t: Tables) -> DataFrame:
    return site_rules.evaluate(Site(_run(t)))[1].select("rule_id", "category", "severity", "evaluated", "failed")


@query()
def health_score(t: Tables) -> DataFrame:
    issues, counts = page_rules.evaluate(_run(t), both=True)
    return scoring.health_score(cut(issues), cut(counts))


@query()
def worst_pages(t: Tables) -> DataFrame:
    return scoring.worst_pages(cut(page_rules.evaluate(_run(t))[0])).select("page_id", "harm", "issues", F.array_join("top_rules", ",").alias("top_rules"))


@query()
def findings_priority(t: Tables) -> DataFrame:
    pages = _run(t)
    issues, counts = page_rules.evaluate(pages, both=True)
    return scoring.findings(cut(issues), cut(counts), scoring.importance(pages)).drop("sample_urls")


@query()
def run_measurements(t: Tables) -> DataFrame:
    return measurements.measurements(Site(_run(t)))


@query()
def page_rank(t: Tables) -> DataFrame:
    return graph.page_graph(_run(t)).select("page_id", "url", "score", "inlinks", "unique_inlinks")


# ---- texts ----

WORDS = "len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, CAST({WORDS} AS BIGINT) AS words FROM documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).cast("long").alias("words"))


@query(f"SELECT doc_id, CAST({WORDS} AS BIGINT) AS words FROM documents WHERE {WORDS} < 80")
def thin_content(t: Tables) -> DataFrame:
    return word_counts(t).where("words < 80")


@query(f"SELECT CAST(floor(w / 100) * 100 AS BIGINT) AS at_least, count(*) AS documents FROM (SELECT {WORDS} AS w FROM documents) GROUP BY 1")
def word_histogram(t: Tables) -> DataFrame:
    return word_counts(t).groupBy((F.floor(F.col("words") / 100) * 100).cast("long").alias("at_least")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT lang, CAST(quantile_disc(n_chars, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(n_chars, 0.9) AS DOUBLE) AS p90, CAST(quantile_disc(n_chars, 0.99) AS DOUBLE) AS p99, CAST(max(n_chars) AS DOUBLE) AS max, CAST(median(n_chars) AS DOUBLE) AS median FROM documents GROUP BY 1")
def text_percentiles(t: Tables) -> DataFrame:
    cols = [F.expr(f"percentile_disc({p}) within group (order by n_chars)").cast("double").alias(a) for p, a in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return t.documents.groupBy("lang").agg(*cols, F.max("n_chars").cast("double").alias("max"), F.median("n_chars").cast("double").alias("median"))


READ = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*') AS l FROM documents),
s AS (SELECT doc_id, len(l) AS n, CASE WHEN len(regexp_extract_all(text || ' ', '[.!?]+\s')) > 0 THEN len(regexp_extract_all(text || ' ', '[.!?]+\s')) WHEN len(l) > 0 THEN 1 ELSE 0 END AS sentences,
 list_sum(list_transform(l, lambda x: CASE WHEN length(regexp_replace(lower(x), '[^a-z]', '', 'g')) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(x), '[^a-z]', '', 'g'), '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]{1,2}'))) END)) AS syllables FROM w)
SELECT doc_id, CAST(sentences AS BIGINT) AS sentences, CAST(syllables AS BIGINT) AS syllables, floor((206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / sentences) - 84.6::DOUBLE * (syllables::DOUBLE / n)) * 10 + 0.5) / 10 AS ease FROM s WHERE n > 0"""


@query(READ)
def readability(t: Tables) -> DataFrame:
    r = t.documents.select("doc_id", tx.readability(F.col("text")).alias("r"))
    return r.where("r.ease is not null").select("doc_id", F.col("r.sentences").cast("long").alias("sentences"), F.col("r.syllables").cast("long").alias("syllables"), F.col("r.ease").alias("ease"))


STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(tx.STOPWORDS))
TERMS = f"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z''’-]{{1,}}'), lambda x: length(x) > 2 AND x NOT IN ({STOPS})) AS l FROM documents"


def _top_terms(rows: DataFrame) -> DataFrame:
    """The ten most frequent terms of each document, with their share of all its tokens."""
    counted = rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total")).where("n > 1")
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "term"))).where("place <= 10")
    return ranked.select("doc_id", F.col("place").cast("long").alias("place"), "term", "n", tx.round_half_up(F.col("n") * 100.0 / F.col("total"), 2).alias("density"))


@query(f"WITH t AS ({TERMS}), e AS (SELECT doc_id, len(l) AS total, unnest(l) AS term FROM t), c AS (SELECT doc_id, term, count(*) AS n, any_value(total) AS total FROM e GROUP BY 1, 2 HAVING count(*) > 1) SELECT doc_id, place, term, n, floor(n * 100.0::DOUBLE / total * 100 + 0.5) / 100 AS density FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS place FROM c) WHERE place <= 10")
def keyword_top10(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", tx.keyword_tokens(F.col("text")).alias("l"))
    return _top_terms(rows.select("doc_id", F.size("l").alias("total"), F.explode("l").alias("term")))


@query(f"WITH t AS ({TERMS}), e AS (SELECT doc_id, len(l) AS total, unnest(list_transform(list_zip(l[:-2], l[2:]), lambda x: x[1] || ' ' || x[2])) AS term FROM t WHERE len(l) > 1), c AS (SELECT doc_id, term, count(*) AS n, any_value(total) AS total FROM e GROUP BY 1, 2 HAVING count(*) > 1) SELECT doc_id, place, term, n, floor(n * 100.0::DOUBLE / total * 100 + 0.5) / 100 AS density FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS place FROM c) WHERE place <= 10")
def bigram_top10(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", tx.keyword_tokens(F.col("text")).alias("l")).where(F.size("l") > 1)
    pairs = F.zip_with(F.slice("l", F.lit(1), F.size("l") - 1), F.slice("l", F.lit(2), F.size("l") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return _top_terms(rows.select("doc_id", F.size("l").alias("total"), F.explode(pairs).alias("term")))


@query(f"SELECT page_id, CAST(floor((length(x) * {tx.FALLBACK_WIDTH} + {PX})::DOUBLE / 1000 * 20 + 0.5) AS INTEGER) AS px FROM (SELECT page_id, {TITLE} AS x FROM pages) WHERE x <> ''")
def title_pixels(t: Tables) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return t.pages.select("page_id", tx.estimate_px(title, tx.TITLE_PX).alias("px")).where("px is not null")


@query("SELECT text_hash, doc_id, n AS group_size FROM (SELECT sha256(text) AS text_hash, doc_id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1")
def duplicate_documents(t: Tables) -> DataFrame:
    return similarity.exact_groups(t.documents.select("doc_id", F.sha2("text", 256).alias("text_hash")), "text_hash").select("text_hash", "doc_id", "group_size")


SHINGLES = r"""
WITH t AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS l FROM t),
s AS (SELECT DISTINCT id, array_to_string(l[i:i + 4], ' ') AS s FROM (SELECT id, l, unnest(range(1, len(l) - 3)) AS i FROM w WHERE len(l) >= 5)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, floor(common::DOUBLE / (p.n + q.n - common) * 10000 + 0.5) / 10000 AS jaccard FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE common::DOUBLE / (p.n + q.n - common) >= 0.8"""


@query(SHINGLES)
def exact_jaccard_pairs(t: Tables) -> DataFrame:
    """Near copies among all documents: pairs of the distinct texts, each under its smallest id."""
    return similarity.text_jaccard_pairs(t.documents.select(F.col("doc_id").alias("id"), "text")).select("a", "b", tx.round_half_up(F.col("jaccard"), 4).alias("jaccard"))


@query()
def near_dup_clusters(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", F.size(F.split("text", r"\s+")).alias("word_count"), F.sha2(F.lower("text"), 256).alias("content_hash"))
    return similarity.near_duplicates(docs)


# ---- labels, benchmark, conversations, embeddings ----


@query("SELECT d.lang, count(*) AS documents, count(l.doc_id) AS labelled, floor(count(l.doc_id) * 1000.0::DOUBLE / count(*) + 0.5) / 10 AS percent FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def label_coverage(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels.select("doc_id", F.lit(1).alias("labelled")), "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count("labelled").alias("labelled"))
    return rows.withColumn("percent", F.floor(F.col("labelled") * 1000.0 / F.col("documents") + 0.5) / 10)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def toxic_docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels.where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, turn - lag(turn, 1, turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations")
def turn_lag(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), (F.col("turn") - F.coalesce(F.lag("turn").over(w), F.col("turn"))).alias("step"))


@query("SELECT conv_id, arg_max(role, turn) AS last_role, max(turn) AS last_turn, arg_min(role, turn) AS first_role, count(*) AS turns FROM conversations GROUP BY 1")
def last_turn_per_conv(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), F.min_by("role", "turn").alias("first_role"), F.count(F.lit(1)).alias("turns"))


@query("SELECT a.conv_id, a.turn, string_agg(b.turn::VARCHAR, ',' ORDER BY b.turn) AS peers FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY 1, 2")
def cluster_peers(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn")
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("all"))
    return rows.join(turns, "conv_id").select("conv_id", "turn", F.array_join(F.filter("all", lambda x: x != F.col("turn")), ",").alias("peers")).where("peers != ''")


@query("WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)) AS dot FROM q JOIN embeddings e ON q.vec_id <> e.vec_id) SELECT query_id, vec_id, CAST(place AS BIGINT) AS place FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, vec_id) AS place FROM s) WHERE place <= 5")
def cosine_top5(t: Tables) -> DataFrame:
    """The five most similar vectors of a stated set of queries, every row whose id is divisible by 100, in blocks against all rows."""
    e = t.embeddings
    return similarity.top_similar(e, e.where("vec_id % 100 = 0")).withColumnRenamed("id", "vec_id")


# ---- event log ----


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS events FROM events GROUP BY 1")
def timeline_minute(t: Tables) -> DataFrame:
    return ev.minute_counts(t.events, "ts")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY 1, 2")
def timeline_day_by_type(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"), tx.round_half_up(F.sum("value"), 2).alias("total"))


@query("SELECT w AS start, w + INTERVAL 1 HOUR AS \"end\", count(*) AS events FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (15 * k) MINUTE AS w FROM events, generate_series(0, 3) AS g(k)) GROUP BY 1")
def sliding_hour(t: Tables) -> DataFrame:
    return ev.sliding_counts(t.events, "ts")


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS events FROM s GROUP BY user_id, k")
def sessions(t: Tables) -> DataFrame:
    return ev.sessions(t.events)


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_event_per_user(t: Tables) -> DataFrame:
    return ev.latest_state(t.events, "user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def event_upsert(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "value", "event_id")
    return metrics.upsert(rows.where("value < 50"), rows.where("value is null or value >= 50"), ("user_id", "event_type"), "event_id").select("user_id", "event_type", "value", "event_id")


@query("SELECT user_id, count(*) AS samples, count(*) FILTER (value < 50) AS without_gain, count(*) >= 10 AND count(*) FILTER (value < 50) * 1.0 / count(*) >= 0.9 AS stop FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 10 GROUP BY 1")
def first_ten_calibration(t: Tables) -> DataFrame:
    return ev.calibration(t.events.select("user_id", "event_id", (F.col("value") >= 50).alias("gained")), "user_id", "event_id")


@query("SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS least, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1")
def json_props_stats(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


# ---- search metrics: events stand for daily rows, the user for the page ----

METRIC = "SELECT CAST(ts AS DATE) AS date, 'u' || user_id AS page_url, event_type AS search_type, CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS BIGINT) AS clicks, CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 5 + 5 AS BIGINT) AS impressions, 1.0::DOUBLE + event_id % 20 AS position FROM events"


def _metrics(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    rows = t.events.select(F.to_date("ts").alias("date"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("page_url"), F.col("event_type").alias("search_type"), (k % 5).alias("clicks"), (k % 5 + 5).alias("impressions"), (1.0 + F.col("event_id") % 20).alias("position"))
    return rows.withColumn("ctr", F.col("clicks") / F.col("impressions"))


@query(f"WITH m AS ({METRIC}) SELECT page_url, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, floor(sum(clicks)::DOUBLE / sum(impressions) * 10000 + 0.5) / 10000 AS ctr, floor(sum(position * impressions)::DOUBLE / sum(impressions) * 10000 + 0.5) / 10000 AS position, count(*) AS days FROM m WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY 1")
def metric_page_rollup(t: Tables) -> DataFrame:
    rows = metrics.page_rollup(metrics.in_range(_metrics(t), "2024-01-03", "2024-01-20"))
    return rows.withColumns({"ctr": tx.round_half_up(F.col("ctr"), 4), "position": tx.round_half_up(F.col("position"), 4)})


@query(f"WITH m AS ({METRIC}) SELECT date, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM m GROUP BY 1")
def metric_daily_trend(t: Tables) -> DataFrame:
    return metrics.daily_trend(_metrics(t))


@query(f"WITH m AS ({METRIC}) SELECT count(*) AS \"rows\", CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, floor(sum(clicks)::DOUBLE / sum(impressions) * 10000 + 0.5) / 10000 AS ctr, floor(sum(position * impressions)::DOUBLE / sum(impressions) * 10000 + 0.5) / 10000 AS position, min(date) AS first_date, max(date) AS last_date, count(DISTINCT page_url) AS pages FROM m")
def metric_totals(t: Tables) -> DataFrame:
    return metrics.totals(_metrics(t)).withColumns({"ctr": tx.round_half_up(F.col("ctr"), 4), "position": tx.round_half_up(F.col("position"), 4)})


@query(f"WITH m AS ({METRIC}) SELECT min(date) <= DATE '2024-01-05' AND max(date) >= DATE '2024-01-25' AS covered FROM m")
def metric_coverage(t: Tables) -> DataFrame:
    return metrics.is_covered(_metrics(t), "2024-01-05", "2024-01-25")


@query(f"WITH m AS ({METRIC}), d AS (SELECT search_type, date, CAST(sum(clicks) AS BIGINT) AS clicks FROM m GROUP BY 1, 2) SELECT search_type, date, clicks, lag(clicks) OVER w AS previous, clicks - lag(clicks) OVER w AS delta, CASE WHEN clicks > lag(clicks) OVER w THEN 'up' WHEN clicks < lag(clicks) OVER w THEN 'down' WHEN clicks = lag(clicks) OVER w THEN 'flat' END AS direction FROM d WINDOW w AS (PARTITION BY search_type ORDER BY date)")
def kpi_delta_lag(t: Tables) -> DataFrame:
    daily = _metrics(t).groupBy("search_type", "date").agg(F.sum("clicks").alias("clicks"))
    return measurements.kpi_deltas(daily, "clicks", "search_type", "date")


# ---- graph: customers buy from suppliers, suppliers deliver parts, parts go to customers ----

EDGES = "SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'c' || o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def _edges(t: Tables) -> DataFrame:
    named = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(named("c", "o_custkey").alias("c"), named("s", "l_suppkey").alias("s"), named("p", "l_partkey").alias("p"))
    delivered = t.lineitem.select(named("s", "l_suppkey").alias("src"), named("p", "l_partkey").alias("dst"))
    return lines.select(F.col("c").alias("src"), F.col("s").alias("dst")).unionByName(delivered).unionByName(lines.select(F.col("p").alias("src"), F.col("c").alias("dst"))).distinct()


def _rank_sql(rounds: int) -> str:
    steps = [f"e AS MATERIALIZED ({EDGES})", "n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)", "o AS MATERIALIZED (SELECT src, count(*) AS outs FROM e GROUP BY 1)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT n.id, (0.15::DOUBLE + 0.85::DOUBLE * (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM o))) / (SELECT count(*) FROM n) + 0.85::DOUBLE * coalesce(g.g, 0) AS r FROM n LEFT JOIN (SELECT dst AS id, sum(r / outs) AS g FROM e JOIN o USING (src) JOIN r{k - 1} ON r{k - 1}.id = e.src GROUP BY 1) g USING (id))")
    return f"WITH {', '.join(steps)} SELECT id, floor(r * 100000 + 0.5) / 100000 AS rank FROM r{rounds}"


@query(_rank_sql(20))
def rank_traders(t: Tables) -> DataFrame:
    # ids are numbers in the rounds, the kind as the remainder by 3: less to shuffle and to compare than text
    kinds = ("c", "s", "p")
    number = lambda kind, key: F.col(key).cast("long") * 3 + kinds.index(kind)
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(number("c", "o_custkey").alias("c"), number("s", "l_suppkey").alias("s"), number("p", "l_partkey").alias("p"))
    delivered = t.lineitem.select(number("s", "l_suppkey").alias("src"), number("p", "l_partkey").alias("dst"))
    edges = lines.select(F.col("c").alias("src"), F.col("s").alias("dst")).unionByName(delivered).unionByName(lines.select(F.col("p").alias("src"), F.col("c").alias("dst")))
    kind = F.pmod("id", F.lit(3))
    name = F.concat(F.element_at(F.array(*[F.lit(k) for k in kinds]), (kind + 1).cast("int")), F.expr("(id - pmod(id, 3)) div 3").cast("string"))
    return graph.simple_rank(None, edges).withColumn("id", name)


@query(f"SELECT CAST(degree AS BIGINT) AS degree, count(*) AS nodes FROM (SELECT src, count(DISTINCT dst) AS degree FROM ({EDGES}) GROUP BY 1) GROUP BY 1")
def degree_histogram(t: Tables) -> DataFrame:
    return graph.degree_histogram(_edges(t))


@query("SELECT l_suppkey, count(*) AS inlinks, count(DISTINCT l_orderkey) AS unique_inlinks FROM lineitem GROUP BY 1")
def inlink_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("inlinks"), F.countDistinct("l_orderkey").alias("unique_inlinks"))


@query("SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def orphan_parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_brand").join(t.lineitem.where("l_quantity > 48"), F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_custkey + 1000000000000 AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS component FROM u UNION SELECT u.b, r.component FROM r JOIN u ON u.a = r.id) SELECT id, min(component) AS component FROM r GROUP BY 1")
def order_components(t: Tables) -> DataFrame:
    """Orders and customers that orders join."""
    e = t.orders.select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + F.lit(1000000000000)).alias("dst")).distinct()
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return graph.components(nodes, e)


# ---- diffs: two slices of the orders ----

BEFORE = "SELECT o_custkey AS k, count(*) AS orders, max(o_orderstatus) AS status, max(o_orderpriority) AS priority FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1"
AFTER = "SELECT o_custkey AS k, count(*) AS orders, max(o_orderstatus) AS status, max(o_orderpriority) AS priority FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1"


def _slices(t: Tables) -> tuple[DataFrame, DataFrame]:
    def one(when: Column) -> DataFrame:
        return t.orders.where(when).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderstatus").alias("status"), F.max("o_orderpriority").alias("priority"))

    return one(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")), one(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))


FIELDS = ("orders", "status", "priority")


@query(f"WITH a AS ({BEFORE}), b AS ({AFTER}) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.orders = b.orders AND a.status = b.status AND a.priority = b.priority THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k")
def diff_slices(t: Tables) -> DataFrame:
    return diff.keyed_diff(*_slices(t), "k", FIELDS).select("k", "change").distinct()


@query(f"WITH a AS ({BEFORE}), b AS ({AFTER}), j AS (SELECT a.k, a.orders::VARCHAR AS o1, b.orders::VARCHAR AS o2, a.status AS s1, b.status AS s2, a.priority AS p1, b.priority AS p2 FROM a JOIN b ON a.k = b.k) SELECT k, 'orders' AS field, o1 AS old, o2 AS new FROM j WHERE o1 <> o2 UNION ALL SELECT k, 'status', s1, s2 FROM j WHERE s1 <> s2 UNION ALL SELECT k, 'priority', p1, p2 FROM j WHERE p1 <> p2")
def diff_fields_changed(t: Tables) -> DataFrame:
    return diff.keyed_diff(*_slices(t), "k", FIELDS).where("change = 'changed'").select("k", "field", "old", "new")


@query("WITH a AS (SELECT o_orderpriority AS r, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_orderpriority AS r, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT coalesce(a.r, b.r) AS rule_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, CASE WHEN coalesce(a.n, 0) = 0 AND b.n > 0 THEN 'new' WHEN a.n > 0 AND coalesce(b.n, 0) = 0 THEN 'resolved' WHEN b.n < a.n THEN 'improved' WHEN b.n > a.n THEN 'worsened' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.r = b.r")
def rule_delta_status(t: Tables) -> DataFrame:
    count = lambda rows: rows.groupBy(F.col("o_orderpriority").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))
    return diff.rule_delta(count(t.orders.where("o_orderstatus = 'O'")), count(t.orders.where("o_orderstatus = 'F'")))


@query("WITH m AS (SELECT c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_nationkey IN (3, 7)) SELECT c_mktsegment AS metric, ours, theirs, floor((ours - theirs) * 10 + 0.5) / 10 AS delta FROM (SELECT c_mktsegment, floor(avg(c_acctbal) FILTER (c_nationkey = 3) * 10 + 0.5) / 10 AS ours, floor(avg(c_acctbal) FILTER (c_nationkey = 7) * 10 + 0.5) / 10 AS theirs FROM m GROUP BY 1)")
def competitor_grid(t: Tables) -> DataFrame:
    mean = lambda k, a: t.customer.where(F.col("c_nationkey") == k).groupBy(F.col("c_mktsegment").alias("metric")).agg(tx.round_half_up(F.avg("c_acctbal"), 1).alias(a))
    return mean(3, "ours").join(mean(7, "theirs"), "metric", "full_outer").withColumn("delta", tx.round_half_up(F.col("ours") - F.col("theirs"), 1))


# ---- listings ----


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    return explore.newest_per_group(t.orders, "o_custkey", "o_totalprice", 3, "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(t: Tables) -> DataFrame:
    return explore.offset_page(explore.sort_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", True, "o_orderkey"), 3)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey > 500) ORDER BY o_custkey, o_orderkey LIMIT 50")
def keyset_page(t: Tables) -> DataFrame:
    return explore.keyset_page(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", (100, 500))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def newest_n_per_group(t: Tables) -> DataFrame:
    return explore.newest_per_group(t.orders, "o_custkey", "o_orderdate", 2, "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders")
def set_union(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").union(t.orders.select("o_custkey")).distinct()


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").intersect(t.orders.select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").subtract(t.orders.select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_except_all(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").select("o_custkey").exceptAll(t.orders.where("o_orderstatus = 'O'").select("o_custkey"))


@query("SELECT doc_id, q FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)) ORDER BY q DESC NULLS LAST, doc_id")
def nulls_last_sort(t: Tables) -> DataFrame:
    return explore.sort_rows(t.documents.select("doc_id").join(t.labels.select("doc_id", F.col("quality").alias("q")), "doc_id", "left"), "q", True, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE n_chars BETWEEN 500 AND 900 AND lang IN ('de', 'fr') AND contains(lower(text), 'en')")
def filter_rows(t: Tables) -> DataFrame:
    d = t.documents
    tests: list[Column] = [F.col("n_chars").between(500, 900), F.col("lang").isin("de", "fr"), F.contains(F.lower("text"), F.lit("en"))]
    return reduce(lambda rows, test: rows.where(test), tests, d).select("doc_id", "lang")


@query("""SELECT '"' || replace(p_name, '"', '""') || '"' AS line FROM part WHERE contains(p_name, '"') OR contains(p_name, ',') UNION ALL SELECT p_name FROM part WHERE NOT (contains(p_name, '"') OR contains(p_name, ','))""")
def csv_lines(t: Tables) -> DataFrame:
    return sinks.csv_lines(t.part.select("p_name"))


@query("SELECT source, lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def source_rollup(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query("SELECT n_name, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, floor(sum(l_extendedprice * (1 - l_discount)) / 1000 + 0.5) AS revenue FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nation_revenue(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("orders"), (F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000 + 0.5)).cast("double").alias("revenue"))


# ---- stored site files ----

#: robots.txt of the pages, by turns of the id.
ROBOTS = ("User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/ok\n", "User-agent: *\nDisallow:\n", "User-agent: CCBot\nUser-agent: ClaudeBot\nDisallow: /x\n")


def _robots(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").cast("string").alias("host"), F.element_at(F.array(*map(F.lit, ROBOTS)), (F.col("page_id") % 3 + 1).cast("int")).alias("body"))


@query("""SELECT CAST(page_id AS VARCHAR) AS host, agent, CASE WHEN agent = 'ChatGPT-User' THEN 'ignores robots.txt' WHEN page_id % 3 = 0 AND agent = 'GPTBot' THEN 'blocked' WHEN page_id % 3 = 0 OR page_id % 3 = 2 AND agent IN ('CCBot', 'ClaudeBot') THEN 'partly blocked' ELSE 'allowed' END AS access
FROM pages, (VALUES ('GPTBot'), ('CCBot'), ('ClaudeBot'), ('ChatGPT-User')) a(agent)""")
def robots_verdicts(t: Tables) -> DataFrame:
    return site_files.ai_access(site_files.parse_robots(_robots(t)), t.spark).where(F.col("agent").isin("GPTBot", "CCBot", "ClaudeBot", "ChatGPT-User")).select("host", "agent", "access")


@query("""SELECT CAST(page_id AS VARCHAR) AS host, "group", agent, directive, value, line FROM pages JOIN (VALUES
  (0, 0, 'gptbot', 'user-agent', 'GPTBot', 1), (0, 0, 'gptbot', 'disallow', '/', 2), (0, 1, '*', 'user-agent', '*', 4), (0, 1, '*', 'disallow', '/private', 5), (0, 1, '*', 'allow', '/private/ok', 6), (1, 0, '*', 'user-agent', '*', 1), (1, 0, '*', 'disallow', '', 2),
  (2, 0, 'ccbot', 'user-agent', 'CCBot', 1), (2, 0, 'claudebot', 'user-agent', 'ClaudeBot', 2), (2, 0, 'ccbot', 'disallow', '/x', 3), (2, 0, 'claudebot', 'disallow', '/x', 3)) r(k, "group", agent, directive, value, line) ON k = page_id % 3""")
def robots_rules(t: Tables) -> DataFrame:
    return site_files.parse_robots(_robots(t))


def _sitemaps(t: Tables) -> DataFrame:
    """Sitemaps of a hundred pages each, s0, s1, ..., and a tree of indexes over them: i0 is the root, each lists its sitemap, up to four further indexes, and the root again."""
    url = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    number = F.expr("page_id div 100")
    entry = F.concat(F.lit("<url><loc>"), url, F.lit("</loc><priority>0.5</priority></url>"))
    bodies = t.pages.select(number.alias("k"), F.struct("page_id", entry.alias("e")).alias("e")).groupBy("k").agg(F.array_sort(F.collect_list("e")).alias("e"))
    maps = bodies.select(F.concat(F.lit("s"), "k").alias("url"), F.concat(F.lit("<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), F.array_join(F.transform("e", lambda e: e["e"]), ""), F.lit("</urlset>")).alias("content"))
    numbers = bodies.select("k")
    listed = numbers.select("k", F.explode(F.expr("transform(sequence(1, 4), x -> 4 * k + x)")).alias("child")).join(numbers.select(F.col("k").alias("child")), "child").groupBy("k").agg(F.array_sort(F.collect_list("child")).alias("more"))
    names = F.concat(F.array(F.concat(F.lit("s"), "k")), F.transform(F.coalesce("more", F.array().cast("array<long>")), lambda x: F.concat(F.lit("i"), x)), F.array(F.lit("i0")))
    indexes = numbers.join(listed, "k", "left").select(F.concat(F.lit("i"), "k").alias("url"), F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(names, lambda n: F.concat(F.lit("<sitemap><loc>"), n, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("content"))
    return maps.unionByName(indexes)


@query("""WITH e AS (SELECT url AS loc, 's' || page_id // 100 AS source_sitemap, CAST(floor(ln(3 * (page_id // 100) + 1) / ln(4) + 1e-9) AS INT) + 1 AS level, row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS input_order FROM pages)
SELECT loc, source_sitemap, level, input_order FROM e QUALIFY row_number() OVER (PARTITION BY loc ORDER BY level, source_sitemap, input_order) = 1""")
def sitemap_listings(t: Tables) -> DataFrame:
    """Every listed location, found through indexes of any depth that lead back to the root."""
    return sitemaps.discover(_sitemaps(t), ["i0"]).select("loc", "source_sitemap", "level", "input_order")


@query("""WITH n AS (SELECT DISTINCT page_id // 100 AS k FROM pages), c AS (SELECT p.k, count(*) AS more FROM n p JOIN n ON n.k BETWEEN 4 * p.k + 1 AND 4 * p.k + 4 GROUP BY 1)
SELECT 's' || page_id // 100 AS url, 'urlset' AS kind, count(*) AS entries, 0 AS children, count(*) - count(DISTINCT url) AS repeated FROM pages GROUP BY 1 UNION ALL SELECT 'i' || k, 'index', 0, 2 + coalesce(more, 0), 0 FROM n LEFT JOIN c USING (k)""")
def sitemap_files(t: Tables) -> DataFrame:
    return sitemaps.per_file(sitemaps.parse(_sitemaps(t))).drop("error")


@query("""WITH o AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'yesterday' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS lastmod FROM orders)
SELECT count(*) AS total, count(lastmod) AS with_lastmod, count(*) FILTER (lastmod = 'yesterday') AS invalid, count(DISTINCT lastmod) AS distinct_values, CASE WHEN count(*) FILTER (lastmod = 'yesterday') > 0 THEN 'suspect-invalid' ELSE 'partial' END AS verdict FROM o""")
def sitemap_lastmod_verdict(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 10
    rows = t.orders.select(F.when(k == 0, None).when(k == 1, "yesterday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("lastmod"))
    return site_files.lastmod_trust(rows, F.lit("2030-06-01").cast("timestamp")).select("total", "with_lastmod", "invalid", "distinct_values", "verdict")


for _name, (_derived_query, _sql) in derived.CHECKS.items():
    query(_sql, _name)(_derived_query)

for _name, (_markup_query, _sql) in markup.checks().items():
    QUERIES[_name], SQL[_name] = _markup_query, _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all page rules by host, over the raw pages."""
    issues, _ = page_rules.evaluate(crawl.from_html(crawl.first_pages(Tables(spark, sf_dir).pages)))
    return issues.groupBy(urls.host(F.col("url")).alias("host"), "severity").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("rule_id").alias("rules"))


# ---- internal-link opportunities ----

#: Vectors of pages: sums of five neighbours in the order of their ids, so that close ones are alike.
BLENDED = "(SELECT page_id, list(x ORDER BY k) AS v FROM (SELECT vec_id - d AS page_id, k, sum(CAST(embedding[k] AS DOUBLE)) AS x FROM embeddings, range(0, 5) r(d), range(1, 65) s(k) WHERE vec_id >= d GROUP BY 1, 2) GROUP BY 1)"
COSINES = f"b AS MATERIALIZED {BLENDED}, u AS (SELECT x.page_id AS a, y.page_id AS b, list_cosine_similarity(x.v, y.v) AS cosine FROM b x JOIN b y ON x.page_id < y.page_id)"


def _blended(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("k", "x")).select(F.explode(F.sequence(F.col("vec_id") - 4, F.col("vec_id"))).alias("page_id"), "k", F.col("x").cast("double").alias("x")).where("page_id >= 0")
    return rows.groupBy("page_id", "k").agg(F.sum("x").alias("x")).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("v"))


@query(f"WITH {COSINES} SELECT a, b, round(cosine, 6) AS cosine FROM u WHERE cosine >= 0.78 AND cosine < 0.85")
def cosine_links(t: Tables) -> DataFrame:
    """All pairs in the band, over all vectors."""
    classes, _ = cosine.unit_classes(_blended(t), "page_id", "v")
    return cosine.all_pairs(classes).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("SELECT 0.9 AS least, true AS reached, 0 AS wrong")
def cosine_links_audit(t: Tables) -> DataFrame:
    """Whether the audited recall is what is asked for, and no pair is out of the band."""
    classes, _ = cosine.unit_classes(_blended(t), "page_id", "v")
    pairs, _ = cosine.audited_band(classes)
    report = cosine.audit(classes, pairs)
    return report.select(F.lit(0.9).cast("decimal(2,1)").alias("least"), (F.col("recall") >= 0.9).alias("reached"), F.col("wrong").cast("int").alias("wrong"))


#: Users stand for pages and hours for queries: a view of one at an hour is an impression there.
SHOWN = "SELECT user_id AS page_id, strftime(ts, '%Y-%m-%d %H') AS query, count(*) AS impressions, avg(value) AS position FROM events GROUP BY 1, 2"


def _shown(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("page_id"), F.date_format("ts", "yyyy-MM-dd HH").alias("query")).agg(F.count(F.lit(1)).alias("impressions"), F.avg("value").alias("position"))


@query(f"""WITH m AS ({SHOWN}), f AS (SELECT query, page_id AS target_id FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY position, impressions DESC, page_id) = 1)
SELECT page_id AS source_id, target_id, count(*) AS queries FROM m JOIN f USING (query) WHERE page_id <> target_id GROUP BY 1, 2""")
def shared_query_pairs(t: Tables) -> DataFrame:
    return linking.shared_queries(_shown(t))


@query(f"""WITH {COSINES}, p AS (SELECT page_id, page_id % 7 <> 0 AS linkable, page_id % 101 AS score, (page_id % 11) / 10.0 AS value FROM b),
l AS (SELECT DISTINCT page_id AS s, page_id + 1 AS t FROM b WHERE page_id % 3 = 0),
m AS ({SHOWN}), f AS (SELECT query, page_id AS t FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY position, impressions DESC, page_id) = 1),
q AS (SELECT page_id AS s, t, count(*) AS queries FROM m JOIN f USING (query) WHERE page_id <> t GROUP BY 1, 2),
k AS (SELECT a, b, cosine FROM u WHERE cosine >= 0.78 AND cosine < 0.85), c AS (SELECT a AS s, b AS t, cosine FROM k UNION ALL SELECT b, a, cosine FROM k),
w AS (SELECT coalesce(c.s, q.s) AS s, coalesce(c.t, q.t) AS t, cosine, queries FROM c FULL JOIN q ON c.s = q.s AND c.t = q.t),
i AS (SELECT t AS page_id, count(*) AS inlinks FROM l GROUP BY 1), o AS (SELECT s AS page_id, count(*) AS outlinks FROM l GROUP BY 1),
z AS (SELECT w.t AS target_id, w.s AS source_id, cosine, queries,
  round(0.25 * (1 - ln(1 + least(coalesce(inlinks, 0), 40)) / ln(41)) + 0.2 * pt.value + 0.3 * (0.5 * coalesce(least(1, greatest(0, (cosine - 0.78) / 0.07)), 0) + 0.5 * ((cosine IS NOT NULL)::INT + (coalesce(queries, 0) > 0)::INT) / 3) + 0.15 * (ps.score / 100 / (1 + coalesce(outlinks, 0) / 100)) + 0.1 * 0.25, 6) AS score
  FROM w JOIN p pt ON pt.page_id = w.t AND pt.linkable JOIN p ps ON ps.page_id = w.s LEFT JOIN i ON i.page_id = w.t LEFT JOIN o ON o.page_id = w.s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.s = w.s AND l.t = w.t))
SELECT target_id, source_id, CAST(NULL AS BIGINT) AS mentions, round(cosine, 6) AS cosine, queries, score, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, source_id) AS place FROM z QUALIFY place <= 5""")
def link_opportunities(t: Tables) -> DataFrame:
    """The best new sources of every page by similar vectors and shared queries."""
    vectors = cut(_blended(t))
    classes, members = cosine.unit_classes(vectors, "page_id", "v")
    pairs = cut(cosine.all_pairs(classes))
    k = F.col("page_id")
    pages = vectors.select("page_id", (k % 7 != 0).alias("linkable"), (k % 101).cast("int").alias("score"), ((k % 11) / 10.0).alias("value"))
    edges = vectors.where(k % 3 == 0).select(k.alias("src"), (k + 1).alias("dst"))
    return linking.opportunities(pages, edges, similar=linking.both_ways(pairs, members), queries=linking.shared_queries(_shown(t)))



@query("""WITH s AS (SELECT 'https://shop.example.com/u' || user_id AS key, CAST(sum(event_id % 3) AS BIGINT) AS clicks, CAST(sum(event_id % 3 + 1) AS BIGINT) AS impressions, sum(value * (event_id % 3 + 1)) / sum(event_id % 3 + 1) AS position FROM events GROUP BY 1),
c AS (SELECT 'https://shop.example.com/u' || c_custkey AS key, c_custkey AS page_id FROM customer)
SELECT coalesce(c.key, s.key) AS key, page_id, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, round(position, 6) AS position, page_id IS NOT NULL AS crawled, s.key IS NOT NULL AS shown FROM c FULL JOIN s ON s.key = c.key""")
def metrics_with_crawl(t: Tables) -> DataFrame:
    """All customers' pages and all URLs that events stand for."""
    k = F.col("event_id") % 3
    rows = t.events.select(F.concat(F.lit("HTTPS://Shop.example.com:443/u"), "user_id", F.lit("?utm_medium=x#top")).alias("page_url"), k.alias("clicks"), (k + 1).alias("impressions"), F.col("value").alias("position"))
    pages = t.customer.select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://shop.example.com/u"), "c_custkey").alias("normalized_url"))
    return metrics.with_crawl(rows, pages).withColumn("position", F.round("position", 6))


@query("SELECT 'HTTPS://Shop.example.com/u' || user_id AS url, min(event_id) AS place FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def inspection_requests(t: Tables) -> DataFrame:
    asked = t.events.select(F.concat(F.lit("HTTPS://Shop.example.com/u"), "user_id").alias("url"), F.col("event_id").alias("place"))
    allowed = t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("https://shop.example.com/u"), "c_custkey", F.lit("/")).alias("url"))
    return metrics.asked_and_allowed(asked, allowed)


# ---- search ----

#: What is sought: rare and common parts of URLs and titles, in either case, signs, one that is shorter than a trigram, and one that nothing holds.
SOUGHT = ("TION", "blog.", "ththth", "page=", "&&&", "en", "no such page")


@query("SELECT page_id, sought FROM (SELECT *, " + TITLE + " AS title FROM pages) p, (VALUES " + ", ".join(f"('{s}')" for s in SOUGHT) + ") v(sought) WHERE contains(lower(url), lower(sought)) OR contains(lower(title), lower(sought))")
def search_pages(t: Tables) -> DataFrame:
    """Every page that holds one of the words, by an index of all pages."""
    rows = t.pages.select("page_id", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    index = search.build(rows, f"{shared_folder(t.spark)}/search-{uuid.uuid4().hex}", buckets=16, shelves=16)
    return reduce(DataFrame.unionByName, [index.search(t.spark, s).select("page_id", F.lit(s).alias("sought")) for s in SOUGHT])


# ---- what pages load: orders are pages, line items their requests ----

REQUESTS = """r AS (SELECT l_orderkey AS page_id, 'https://cdn.example.com/p' || l_partkey AS key, arg_max(k, (coalesce(b, -1), k)) AS kind, max(b) AS bytes,
  min(l_quantity * 10) AS start_ms, max(l_quantity * 10 + l_discount * 2000) AS end_ms, bool_or(l_returnflag = 'R') AS deferred
  FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'script' WHEN 1 THEN 'stylesheet' ELSE 'image' END AS k, CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_extendedprice * 10) AS BIGINT) END AS b FROM lineitem) GROUP BY 1, 2)"""
PAINTS = "p AS (SELECT o_orderkey AS page_id, CAST(floor(o_totalprice % 400) AS BIGINT) AS first_paint_ms, CAST(floor(o_totalprice) AS BIGINT) AS html_bytes FROM orders)"


def _requests(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 3
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("page_id"), F.concat(F.lit("https://CDN.example.com:443/p"), "l_partkey", F.lit("?utm_source=x")).alias("url"), F.when(n == 0, "script").when(n == 1, "stylesheet").otherwise("image").alias("kind"),
        F.when(F.col("l_linestatus") == "O", F.floor(F.col("l_extendedprice") * 10)).alias("bytes"), (F.col("l_quantity") * 10).alias("start_ms"), (F.col("l_quantity") * 10 + F.col("l_discount") * 2000).alias("end_ms"), (F.col("l_returnflag") == "R").alias("deferred"),
    )
    return resources.per_request(resources.keyed(rows))


def _paints(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("page_id"), F.floor(F.col("o_totalprice") % 400).alias("first_paint_ms"), F.floor("o_totalprice").alias("html_bytes"))


def _sized(t: Tables, requests: DataFrame) -> DataFrame:
    images = t.lineitem.where("l_linenumber % 3 = 2").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("https://cdn.example.com/p"), "l_partkey").alias("src_key"))
    return resources.image_bytes(images, requests)


@query(f"""WITH {REQUESTS}, {PAINTS},
i AS (SELECT p.page_id, key, start_ms, least(end_ms, first_paint_ms) AS until FROM r JOIN p USING (page_id) WHERE kind IN ('script', 'stylesheet') AND NOT deferred AND start_ms < first_paint_ms AND end_ms > start_ms),
e AS (SELECT page_id, start_ms AS tick FROM i UNION SELECT page_id, until FROM i),
s AS (SELECT page_id, tick, lead(tick) OVER (PARTITION BY page_id ORDER BY tick) AS nxt FROM e),
c AS (SELECT s.page_id, sum(nxt - tick) AS blocked_ms FROM s WHERE nxt IS NOT NULL AND EXISTS (SELECT 1 FROM i WHERE i.page_id = s.page_id AND i.start_ms <= s.tick AND i.until >= s.nxt) GROUP BY 1),
l AS (SELECT page_id, count(*) AS blocking, arg_max(key, (until, key)) AS last FROM i GROUP BY 1)
SELECT p.page_id, coalesce(blocking, 0) AS blocking, round(coalesce(blocked_ms, 0), 3) AS blocked_ms, last FROM p LEFT JOIN l USING (page_id) LEFT JOIN c USING (page_id)""")
def paint_blocking(t: Tables) -> DataFrame:
    """Every page's blocking requests; the SQL cuts time at all ends and counts the pieces that a request covers."""
    return resources.render_blocking(_requests(t), _paints(t)).withColumn("blocked_ms", F.round("blocked_ms", 3))


@query(f"""WITH {REQUESTS}, a AS (SELECT key, max(bytes) AS m FROM r GROUP BY 1), i AS (SELECT l_orderkey AS page_id, l_linenumber AS position, 'https://cdn.example.com/p' || l_partkey AS key FROM lineitem WHERE l_linenumber % 3 = 2)
SELECT i.page_id, position, coalesce(r.bytes, a.m) AS bytes FROM i LEFT JOIN r ON r.page_id = i.page_id AND r.key = i.key LEFT JOIN a ON a.key = i.key""")
def image_sizes(t: Tables) -> DataFrame:
    return _sized(t, _requests(t)).select("page_id", "position", "bytes")


@query(f"""WITH {REQUESTS}, {PAINTS}, w AS (SELECT page_id, html_bytes + coalesce(s, 0) AS weight FROM p LEFT JOIN (SELECT page_id, sum(bytes) AS s FROM r GROUP BY 1) USING (page_id)),
a AS (SELECT key, max(bytes) AS m FROM r GROUP BY 1), i AS (SELECT l_orderkey AS page_id, 'https://cdn.example.com/p' || l_partkey AS key FROM lineitem WHERE l_linenumber % 3 = 2), z AS (SELECT coalesce(r.bytes, a.m) AS bytes FROM i LEFT JOIN r ON r.page_id = i.page_id AND r.key = i.key LEFT JOIN a ON a.key = i.key),
b AS (SELECT DISTINCT p.page_id FROM r JOIN p USING (page_id) WHERE kind IN ('script', 'stylesheet') AND NOT deferred AND start_ms < first_paint_ms AND end_ms > start_ms)
SELECT 'heavy-images' AS measurement, CAST(count(*) FILTER (bytes > 204800) AS DOUBLE) AS value, count(bytes) AS sample FROM z UNION ALL SELECT 'average-page-weight', round(avg(weight), 1), count(*) FROM w UNION ALL SELECT 'render-blocking', CAST((SELECT count(*) FROM b) AS DOUBLE), count(*) FROM p""")
def resource_measurements(t: Tables) -> DataFrame:
    requests = cut(_requests(t))
    return resources.resource_measurements(_sized(t, requests), resources.page_weights(_paints(t), requests), resources.render_blocking(requests, _paints(t)))
