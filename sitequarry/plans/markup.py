"""Extraction held to SQL: every document becomes a page of raw HTML, whose parts vary with its id, and each group of extracted facts has the SQL that gives the same from the documents.

The HTML is put together by Spark from the tables; the facts come from it by the extractor alone. The SQL never sees the HTML: it
states, from id and text, what a reader of the page would note.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.functions.domains import suffix_rules
from sitequarry.operators import page_rules
from sitequarry.plans.config import Config
from sitequarry.sources import crawl
from sitequarry.sources.extract import extract

#: (condition or None, HTML) in the order of the page; {k} is the id, {text} the escaped text, both put in by Spark SQL.
HEAD: tuple[tuple[str | None, str], ...] = (
    ("k % 5 <> 0", '<meta charset="UTF-8">'),
    ("k % 8 = 5", '<base href="https://base.example.org/x/">'),
    (None, "<title> T{k} &amp;  more</title>"),
    ("k % 7 = 0", "<title>Again {k}</title>"),
    ("k % 3 <> 0", '<meta name="Description" content=" D{k} ">'),
    ("k % 6 = 1", '<meta name="description" content="second">'),
    ("k % 4 = 2", '<meta name="keywords" content="a{k}, b">'),
    ("k % 11 = 0", '<meta http-equiv="Refresh" content="{k}; url=/r{k}">'),
    ("k % 4 <> 0", '<link rel="canonical" href="/c{k}">'),
    ("k % 9 = 0", '<meta name="robots" content="NOINDEX, follow">'),
    ("k % 9 = 1", '<meta name="googlebot" content="none">'),
    ("k % 2 = 0", '<meta name="viewport" content="width=device-width, user-scalable=no">'),
    ("k % 4 = 1", '<meta name="viewport" content="width=device-width, maximum-scale=1">'),
    (None, '<meta property="og:title" content="O{k}"><meta property="og:image" content="/o{k}.png"><meta property="og:image:width" content="{k}">'),
    ("k % 3 = 0", '<meta property="og:image" content="https://img.example.net/p.png"><meta name="twitter:card" content="summary{k}">'),
    ("k % 10 = 3", '<meta name="google-site-verification" content="g{k}">'),
    ("k % 2 = 1", '<link rel="alternate" hreflang="de" href="/de/{k}"><link rel="alternate" hreflang="x-default" href="https://www.example.com/">'),
    ("k % 3 = 0", '<link rel="Icon" href="/i{k}.png" sizes="32x32" type="image/png">'),
    ("k % 6 = 0", '<link rel="apple-touch-icon" href="/t.png?v=1">'),
    (None, '<style>@font-face {{ font-family: "F{k}"; src: url(/f{k}.woff2); font-display: swap }} .a {{ background-image: url("/bg{k}.png") }} .b {{ background: url(data:image/gif;base64,AAAA) }}</style>'),
    ("k % 4 = 1", '<link rel="preload" as="font" href="/f{k}.woff2">'),
    ("k % 4 = 2", '<link rel="preload" as="font" href="/f{k}.woff2" crossorigin><link rel="stylesheet" href="https://fonts.googleapis.com/css?f={k}">'),
    (None, '<script src="/one.js"></script><script async src="/two.js"></script>'),
    ("k % 3 = 1", '<script src="/three.js"></script><link rel="stylesheet" href="/s.css"><link rel="preconnect" href="https://cdn.example.net">'),
    ("k % 6 = 0", '<script type="application/ld+json">{{"@context": "https://schema.org", "@type": "Brand", "name": "B{k}"}}</script>'),
    ("k % 6 = 1", '<script type="application/ld+json">{{"@context": "https://schema.org", "@graph": [{{"@type": "Movie", "image": "i"}}, {{"@type": "Zoo"}}]}}</script>'),
    ("k % 6 = 2", '<script type="application/ld+json">{{"@type": "Brand", "name": ""}}</script>'),
    ("k % 6 = 3", '<script type="application/ld+json">{{"@context": "https://other.example", "@type": "FooPage"}}</script><script type="application/ld+json"> </script>'),
    ("k % 6 = 4", '<script type="application/ld+json">{{"@type": </script>'),
)
BODY: tuple[tuple[str | None, str], ...] = (
    (None, '<header><nav><a href="/n{k}">Nav</a></nav></header>'),
    ("k % 2 = 0", "<main>"),
    ("k % 2 = 1", "<article>"),
    (None, "<h1>H<b>{k}</b></h1><h2> Two  {k} </h2>"),
    ("k % 3 = 1", "<h4>Four</h4><h1>Other</h1>"),
    (None, "<p>{text}</p><ul><li>u</li></ul><ol><li>o</li></ol>"),
    ("k % 4 = 1", "<dl><dt>a</dt><dd>b</dd></dl><pre>p  p</pre><blockquote>q</blockquote>"),
    ("k % 4 = 2", "<table><caption>Cap {k}</caption><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table>"),
    ("k % 5 = 1", '<div aria-hidden="true">one two <span aria-hidden="true">three</span></div>'),
    (None, '<a href="a{k}?utm_source=q&amp;b=2#f" target="_blank">In {k}</a> <a href="https://other.example.net/" rel="NoFollow sponsored">Out</a>'),
    ("k % 3 = 2", '<a href="https://b.example.com/{k}" rel="ugc">Sub</a><a href="#top">t</a><a href="javascript:x()">j</a>'),
    (None, '<a href="mailto:M{k}@example.com?subject=x">m</a><a href="tel:+49 30">t</a><a href="MAILTO:m{k}@EXAMPLE.com">again</a>'),
    (None, '<img src="/m{k}.JPG" alt="A" width="10" height="20" loading="lazy"><img data-src="/l.png"><img src="data:image/png;base64,AAAABBBB" alt="">'),
    ("k % 3 = 0", '<img srcset="/a.png 1x, /b.png 2x" alt=""><picture><source srcset="/p1.webp 480w, /p2.webp 800w"><img src="/p.gif" alt="P" width="5"></picture>'),
    ("k % 4 = 3", '<div style="background: #fff url(/st{k}.png)">s</div>'),
    ("k % 5 = 2", '<video src="/v{k}.mp4" poster="/po.jpg"><source src="/v{k}.webm"></video><iframe src="https://www.youtube.com/embed/{k}"></iframe><iframe src="https://maps.example.com/"></iframe>'),
    ("k % 3 = 1", '<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">N{k}</span></div>'),
    ("k % 9 = 2", "<div itemscope><i itemprop=x>y</i></div>"),
    ("k % 3 = 2", '<div vocab="https://schema.org/" typeof="Brand"><span property="name">R</span></div>'),
    ("k % 2 = 0", "</main>"),
    ("k % 2 = 1", "</article>"),
    ("k % 7 = 3", '<link rel="canonical" href="/late"><meta name="robots" content="nofollow">'),
    (None, '<aside>side</aside><footer role="contentinfo">foot</footer>'),
)


def _sql(parts: tuple[tuple[str | None, str], ...]) -> str:
    """Spark SQL that puts parts together."""

    def literal(html: str) -> str:
        plain = html.replace("{{", "\1").replace("}}", "\2").replace("'", "\\'")
        return "concat('" + plain.replace("{k}", "', k, '").replace("{text}", "', escaped, '").replace("\1", "{").replace("\2", "}") + "')"

    return "concat(" + ", ".join(literal(html) if test is None else f"CASE WHEN {test} THEN {literal(html)} ELSE '' END" for test, html in parts) + ")"


def raw_pages(documents: DataFrame) -> DataFrame:
    """(k, url, html) of every document."""
    own = documents.select(F.col("doc_id").alias("k"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("escaped"))
    html = f"concat('<!DOCTYPE html><html><head>', {_sql(HEAD)}, '</head><body>', {_sql(BODY)}, '</body></html>')"
    return own.select("k", F.expr("concat('https://s', k % 3, '.example.com/d/p', k)").alias("url"), F.expr(html).alias("html"))


#: White space as a browser's text is split: DuckDB's own class holds ASCII only.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
D = rf"""WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 8 = 5 THEN 'https://base.example.org' ELSE 'https://s' || doc_id % 3 || '.example.com' END AS o,
  CASE WHEN doc_id % 8 = 5 THEN 'https://base.example.org/x/' ELSE 'https://s' || doc_id % 3 || '.example.com/d/' END AS dir, trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS t FROM documents) """


def _joined(column: str, *fields: str) -> Column:
    """An array of structs as text: fields by |, rows by a semicolon, null as a dash."""
    return F.array_join(F.transform(column, lambda x: F.array_join(F.array(*[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields]), "|")), ";")


def _list(*items: str) -> str:
    """SQL: the items that aren't null, by semicolons."""
    return "array_to_string(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), ';')"


def _if(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} END"


SIGNAL = "k % 7 = 3"
#: Name of the query: facts as columns, and what SQL says of them.
FACTS: dict[str, tuple[Callable[[], dict[str, Column]], str]] = {
    "titles": (lambda: {"title": F.col("title"), "titles": F.array_join("titles", ";")}, f"'T' || k || ' & more' AS title, {_list("'T' || k || ' & more'", _if('k % 7 = 0', "'Again ' || k"))} AS titles"),
    "descriptions": (lambda: {"first": F.col("meta_description"), "n": F.size("meta_descriptions")}, "CASE WHEN k % 3 <> 0 THEN 'D' || k END AS first, CAST(k % 3 <> 0 AS INT) + CAST(k % 6 = 1 AS INT) AS n"),
    "keywords": (lambda: {"keywords": F.col("keywords")}, "CASE WHEN k % 4 = 2 THEN 'a' || k || ', b' END AS keywords"),
    "refresh": (lambda: {"delay": F.col("meta_refresh.delay"), "target": F.col("meta_refresh.url")}, "CASE WHEN k % 11 = 0 THEN CAST(k AS DOUBLE) END AS delay, CASE WHEN k % 11 = 0 THEN o || '/r' || k END AS target"),
    "canonical": (lambda: {"canonical": F.col("canonical")}, f"CASE WHEN k % 4 <> 0 THEN o || '/c' || k WHEN {SIGNAL} THEN o || '/late' END AS canonical"),
    "robots": (lambda: {"noindex": F.col("robots.noindex"), "nofollow": F.col("robots.nofollow"), "rules": F.array_join("robots.meta", ";")}, f"k % 9 IN (0, 1) AS noindex, k % 9 = 1 OR {SIGNAL} AS nofollow, {_list(_if('k % 9 = 0', "'noindex;follow'"), _if(SIGNAL, "'nofollow'"), _if('k % 9 = 1', "'none'"))} AS rules"),
    "headings": (lambda: {"h1": F.array_join("headings.h1", ";"), "h2": F.array_join("headings.h2", ";"), "h3": F.size("headings.h3")}, "'H' || k || CASE WHEN k % 3 = 1 THEN ';Other' ELSE '' END AS h1, 'Two ' || k AS h2, 0 AS h3"),
    "heading_order": (lambda: {"headings": _joined("structure.headings", "level", "text", "in_main")}, f"{_list("'1|H' || k || '|' || (k % 2 = 0)", "'2|Two ' || k || '|' || (k % 2 = 0)", _if('k % 3 = 1', "'4|Four|' || (k % 2 = 0) || ';1|Other|' || (k % 2 = 0)"))} AS headings"),
    "structure": (
        lambda: {"paragraphs": F.col("structure.paragraphs"), "lists": F.col("structure.ordered_lists") * 10 + F.col("structure.unordered_lists"), "others": F.col("structure.definition_lists") * 100 + F.col("structure.preformatted") * 10 + F.col("structure.quotes"), "tables": _joined("structure.tables", "headers", "caption"), "landmarks": F.array_join(F.array_sort("structure.landmarks"), ";")},
        "1 AS paragraphs, 11 AS lists, CASE WHEN k % 4 = 1 THEN 111 ELSE 0 END AS others, CASE WHEN k % 4 = 2 THEN '2|Cap ' || k ELSE '' END AS tables, CASE WHEN k % 2 = 0 THEN 'aside;footer;header;main;nav' ELSE 'aside;footer;header;nav' END AS landmarks",
    ),
    "links": (
        lambda: {"links": _joined("links", "target", "target_normalized", "anchor", "type")},
        f"{_list("o || '/n' || k || '|' || o || '/n' || k || '|Nav|' || CASE WHEN k % 8 = 5 THEN 'external' ELSE 'internal' END", "dir || 'a' || k || '?utm_source=q&b=2#f|' || dir || 'a' || k || '?b=2|In ' || k || '|' || CASE WHEN k % 8 = 5 THEN 'external' ELSE 'internal' END", "'https://other.example.net/|https://other.example.net/|Out|external'", _if('k % 3 = 2', "'https://b.example.com/' || k || '|https://b.example.com/' || k || '|Sub|internal'"))} AS links",
    ),
    "link_flags": (lambda: {"flags": _joined("links", "rel", "nofollow", "sponsored", "ugc", "target_attr")}, f"{_list("'-|false|false|false|-'", "'-|false|false|false|_blank'", "'NoFollow sponsored|true|true|false|-'", _if('k % 3 = 2', "'ugc|false|false|true|-'"))} AS flags"),
    "images": (
        lambda: {"images": _joined("images", "src", "alt", "width", "height", "format", "loading")},
        f"{_list("o || '/m' || k || '.JPG|A|10|20|jpg|lazy'", "o || '/l.png|-|-|-|png|-'", _if('k % 3 = 0', "o || '/a.png||-|-|png|-'"), _if('k % 3 = 0', "o || '/p.gif|P|5|-|gif|-'"))} AS images",
    ),
    "srcset": (lambda: {"candidates": F.array_join(F.flatten(F.transform("images", lambda i: F.transform(i["candidates"], lambda c: F.concat(c["url"], F.lit("@"), c["density"].cast("int"))))), ";")}, "CASE WHEN k % 3 = 0 THEN o || '/a.png@1;' || o || '/b.png@2' ELSE '' END AS candidates"),
    "pictures": (lambda: {"sources": F.array_join(F.flatten(F.transform("images", lambda i: i["picture_sources"])), ";")}, "CASE WHEN k % 3 = 0 THEN o || '/p1.webp;' || o || '/p2.webp' ELSE '' END AS sources"),
    "image_summary": (
        lambda: {c: F.col(f"image_summary.{c}") for c in ("total", "missing_alt", "empty_alt", "lazy", "missing_dimensions", "data_uris", "backgrounds", "responsive")},
        "2 + 2 * CAST(k % 3 = 0 AS INT) AS total, 1 AS missing_alt, CAST(k % 3 = 0 AS INT) AS empty_alt, 1 AS lazy, 1 + 2 * CAST(k % 3 = 0 AS INT) AS missing_dimensions, 1 AS data_uris, 1 + CAST(k % 4 = 3 AS INT) AS backgrounds, CAST(k % 3 = 0 AS INT) AS responsive",
    ),
    "data_uri_bytes": (lambda: {"bytes": F.col("image_summary.data_uri_bytes")}, "CAST(6 AS BIGINT) AS bytes"),
    "videos": (lambda: {"videos": _joined("videos", "kind", "url", "poster")}, "CASE WHEN k % 5 = 2 THEN 'file|' || o || '/v' || k || '.mp4|' || o || '/po.jpg;file|' || o || '/v' || k || '.webm|' || o || '/po.jpg;youtube|https://www.youtube.com/embed/' || k || '|-' ELSE '' END AS videos"),
    "json_ld_blocks": (lambda: {"blocks": F.size("structured_data"), "broken": F.size(F.filter("structured_data", lambda b: b["parse_error"].isNotNull()))}, "CASE k % 6 WHEN 3 THEN 2 WHEN 5 THEN 0 ELSE 1 END AS blocks, CASE WHEN k % 6 IN (3, 4) THEN 1 ELSE 0 END AS broken"),
    "json_ld_items": (
        lambda: {"items": F.array_join(F.transform(F.filter("schema_items", lambda i: i["format"] == "json-ld"), lambda i: F.concat_ws("|", F.array_join(i["types"], ","), i["path"], i["status"], F.array_join(i["missing_required"], ","))), ";")},
        "CASE k % 6 WHEN 0 THEN 'Brand|$[0]|valid|' WHEN 1 THEN 'Movie|$[0].@graph[0]|incomplete|name;Zoo|$[0].@graph[1]|known-type|' WHEN 2 THEN 'Brand|$[0]|incomplete|name' WHEN 3 THEN 'FooPage|$[0]|unknown-type|' ELSE '' END AS items",
    ),
    "recommended": (lambda: {"missing": F.array_join(F.flatten(F.transform("schema_items", lambda i: i["missing_recommended"])), ",")}, "array_to_string(list_filter([CASE WHEN k % 6 = 1 THEN 'dateCreated,director,aggregateRating,review' END, CASE WHEN k % 3 = 1 THEN 'url,image,jobTitle,sameAs' END], lambda x: x IS NOT NULL), ',') AS missing"),
    "microdata": (lambda: {"items": F.array_join(F.transform(F.filter("schema_items", lambda i: i["format"] == "microdata"), lambda i: F.concat_ws("|", F.array_join(i["types"], ","), i["path"], i["status"])), ";")}, f"{_list(_if('k % 3 = 1', "'Person|microdata[0]|valid'"), _if('k % 9 = 2', "'|microdata[0]|missing-type'"))} AS items"),
    "rdfa": (lambda: {"items": F.array_join(F.transform(F.filter("schema_items", lambda i: i["format"] == "rdfa"), lambda i: F.concat_ws("|", F.array_join(i["types"], ","), i["path"], i["profile"], i["status"])), ";")}, "CASE WHEN k % 3 = 2 THEN 'Brand|rdfa[0]|Brand|valid' ELSE '' END AS items"),
    "schema_errors": (lambda: {"errors": F.array_join(F.array_sort(F.transform("schema_errors", lambda e: F.concat(e["kind"], F.lit("@"), e["path"]))), ";")}, f"array_to_string(list_sort(list_filter([{_if('k % 6 = 2', "'missing-context@$[0]'")}, {_if('k % 6 = 3', "'invalid-context@$[0]'")}, {_if('k % 6 = 3', "'empty-block@$[1]'")}, {_if('k % 6 = 4', "'malformed-json@$[0]'")}, {_if('k % 9 = 2', "'missing-type@microdata[0]'")}], lambda x: x IS NOT NULL)), ';') AS errors"),
    "content": (
        lambda: {"text_hash": F.sha2("content.text", 256), "words": F.col("content.word_count"), "area": F.col("content.area_method")},
        "sha256(c) AS text_hash, CAST(len(string_split(c, ' ')) AS INT) AS words, CASE WHEN k % 2 = 0 THEN 'main' ELSE 'article' END AS area FROM (SELECT k, trim(regexp_replace('H' || k || ' Two ' || k || CASE WHEN k % 3 = 1 THEN ' Four Other' ELSE '' END || ' ' || t || ' u o' || CASE WHEN k % 4 = 1 THEN ' a b p p q' WHEN k % 4 = 2 THEN ' Cap ' || k || 'x y 1 2' ELSE '' END || CASE WHEN k % 5 = 1 THEN ' one two three' ELSE '' END || ' In ' || k || ' Out' || CASE WHEN k % 3 = 2 THEN 'Subtj' ELSE '' END || 'mtagain' || CASE WHEN k % 4 = 3 THEN 's ' ELSE '' END || CASE WHEN k % 3 = 1 THEN 'N' || k || ' ' ELSE '' END || CASE WHEN k % 9 = 2 THEN 'y ' ELSE '' END || CASE WHEN k % 3 = 2 THEN 'R ' ELSE '' END, ' +', ' ', 'g')) AS c FROM d) d",
    ),
    "hidden_words": (lambda: {"words": F.col("content.aria_hidden_words")}, "CASE WHEN k % 5 = 1 THEN 3 ELSE 0 END AS words"),
    "social": (lambda: {"og": F.to_json("social.og"), "twitter": F.element_at("social.twitter", "twitter:card")}, "'{\"og:title\":\"O' || k || '\",\"og:image\":\"/o' || k || '.png\",\"og:image:width\":\"' || k || '\"}' AS og, CASE WHEN k % 3 = 0 THEN 'summary' || k END AS twitter"),
    "og_images": (lambda: {"images": _joined("head_meta.og_images", "url", "width", "alt")}, f"{_list("o || '/o' || k || '.png|' || k || '|-'", _if('k % 3 = 0', "'https://img.example.net/p.png|-|-'"))} AS images"),
    "head_meta": (lambda: {"viewport": F.col("head_meta.viewport"), "fixed": F.col("head_meta.viewport_blocks_zoom"), "verified": F.element_at("head_meta.verification", "google")}, "CASE WHEN k % 2 = 0 THEN 'width=device-width, user-scalable=no' WHEN k % 4 = 1 THEN 'width=device-width, maximum-scale=1' END AS viewport, k % 4 <> 3 AS fixed, CASE WHEN k % 10 = 3 THEN 'g' || k END AS verified"),
    "head_boundary": (lambda: {"stranded": _joined("head_boundary.stranded", "signal", "tag", "honoured"), "closed_by": F.col("head_boundary.closed_by")}, f"CASE WHEN {SIGNAL} THEN 'canonical|link|false;meta-robots|meta|true' ELSE '' END AS stranded, CASE WHEN {SIGNAL} THEN 'header' END AS closed_by"),
    "charset": (lambda: {"charset": F.col("charset.value"), "source": F.col("charset.source"), "effective": F.col("charset.effective")}, "CASE WHEN k % 5 <> 0 THEN 'utf-8' END AS charset, CASE WHEN k % 5 <> 0 THEN 'meta' END AS source, k % 5 <> 0 AS effective"),
    "base_href": (lambda: {"href": F.col("base_href.href"), "n": F.col("base_href.count")}, "CASE WHEN k % 8 = 5 THEN 'https://base.example.org/x/' END AS href, CAST(k % 8 = 5 AS INT) AS n"),
    "hreflang": (lambda: {"alternates": _joined("hreflang", "lang", "href")}, "CASE WHEN k % 2 = 1 THEN 'de|' || o || '/de/' || k || ';x-default|https://www.example.com/' ELSE '' END AS alternates"),
    "contacts": (lambda: {"contacts": _joined("contacts", "kind", "value")}, "'email|M' || k || '@example.com;phone|+49 30' AS contacts"),
    "favicons": (
        lambda: {"icons": _joined("favicons", "href", "rel", "sizes", "type", "source", "unstable")},
        "CASE WHEN k % 3 = 0 THEN o || '/i' || k || '.png|icon|32x32|image/png|declared|false' || CASE WHEN k % 6 = 0 THEN ';' || o || '/t.png?v=1|apple-touch-icon|-|-|declared|true' ELSE '' END ELSE 'https://s' || k % 3 || '.example.com/favicon.ico|icon|-|-|implicit|false' END AS icons",
    ),
    "fonts": (
        lambda: {"faces": F.array_join(F.transform("fonts.faces", lambda f: F.concat_ws("|", f["family"], f["display"], F.array_join(f["urls"], ","), f["preload_missing_crossorigin"].cast("string"))), ";"), "hosts": F.array_join("fonts.third_party_hosts", ";")},
        "'F' || k || '|swap|' || o || '/f' || k || '.woff2|' || (k % 4 = 1) AS faces, CASE WHEN k % 4 = 2 THEN 'fonts.googleapis.com' ELSE '' END AS hosts",
    ),
    "resource_hints": (
        lambda: {c: F.col(f"resource_hints.{c}") for c in ("scripts", "blocking_scripts", "stylesheets", "preloads", "preconnects")},
        "2 + CAST(k % 3 = 1 AS INT) AS scripts, 1 + CAST(k % 3 = 1 AS INT) AS blocking_scripts, CAST(k % 3 = 1 AS INT) + CAST(k % 4 = 2 AS INT) AS stylesheets, CAST(k % 4 IN (1, 2) AS INT) AS preloads, CAST(k % 3 = 1 AS INT) AS preconnects",
    ),
    "needs_js": (lambda: {"needs_js": F.col("needs_js")}, "false AS needs_js"),
}


#: Rules over the extracted facts, and the pages that each finds.
RULES: dict[str, str] = {
    "title-multiple": "k % 7 = 0", "meta-description-missing": "k % 3 = 0", "meta-description-multiple": "k % 6 = 1", "canonical-absent": "k % 4 = 0 AND k % 7 <> 3", "noindex": "k % 9 IN (0, 1)", "nofollow": "k % 9 = 1 OR k % 7 = 3",
    "meta-refresh-present": "k % 11 = 0", "viewport-missing": "k % 4 = 3", "viewport-blocks-zoom": "k % 4 <> 3", "charset-missing": "k % 5 = 0", "base-href-cross-origin": "k % 8 = 5", "head-signal-stranded": "k % 7 = 3",
    "favicon-not-declared": "k % 3 <> 0", "font-preload-missing-crossorigin": "k % 4 = 1", "third-party-font-host": "k % 4 = 2", "h1-multiple": "k % 3 = 1", "heading-hierarchy-skip": "k % 3 = 1", "image-missing-alt": "true",
    "image-empty-alt": "k % 3 = 0", "twitter-missing": "k % 3 <> 0", "main-landmark-missing": "k % 2 = 1", "structured-data-unknown-type": "k % 6 = 3", "structured-data-missing-context": "k % 6 = 2",
    "structured-data-invalid-context": "k % 6 = 3", "structured-data-empty-block": "k % 6 = 3", "structured-data-missing-required-property": "k % 6 IN (1, 2)", "structured-data-missing-type": "k % 9 = 2", "video-embed-without-schema": "k % 5 = 2",
}


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, rule_id) of the rules over facts that were extracted, not set."""
    pages = raw_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = crawl.from_html(pages, order="k").withColumn("page_id", F.col("input_order").cast("string"))
    config = Config(disabled=frozenset(r.id for r in page_rules.RULES) - RULES.keys())
    return page_rules.evaluate(own, config)[0].select(F.col("page_id").cast("long").alias("k"), "rule_id").distinct()


RULE_SQL = "WITH d AS (SELECT doc_id AS k FROM documents) " + " UNION ALL ".join(f"SELECT k, '{rule}' AS rule_id FROM d WHERE {test}" for rule, test in RULES.items())


def _query(columns: Callable[[], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = raw_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        facts = extract(pages, rules=suffix_rules(spark))
        return facts.select("k", *[c.alias(n) for n, c in columns().items()])

    return run


def checks() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Per query: the facts of every document's page, and their SQL."""
    return {"markup_rule_hits": (rule_hits, RULE_SQL)} | {f"markup_{name}": (_query(columns), D + "SELECT k, " + (sql if " FROM (" in sql else f"{sql} FROM d")) for name, (columns, sql) in FACTS.items()}
