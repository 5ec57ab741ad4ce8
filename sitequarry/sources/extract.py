"""Page facts from HTML: one vectorised function from (url, html, headers) to a nested struct.

Every group of facts is computed by itself: a failure in one leaves its default and never loses the page.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitequarry.functions.domains import Suffixes, suffix_rules, suffixes
from sitequarry.functions.urls import normalize
from sitequarry.sources import schema_org
from sitequarry.sources.dom import Node, collapse, parse

FIELDS = """
title string, titles array<string>, meta_description string, meta_descriptions array<string>, keywords string,
meta_refresh struct<delay: double, url: string>, canonical string,
robots struct<meta: array<string>, noindex: boolean, nofollow: boolean>,
headings struct<h1: array<string>, h2: array<string>, h3: array<string>>,
structure struct<headings: array<struct<level: int, text: string, in_main: boolean>>, paragraphs: int, ordered_lists: int, unordered_lists: int, definition_lists: int, tables: array<struct<headers: int, caption: string>>, preformatted: int, quotes: int, landmarks: array<string>>,
links array<struct<target: string, target_normalized: string, anchor: string, type: string, rel: string, nofollow: boolean, sponsored: boolean, ugc: boolean, target_attr: string>>,
images array<struct<src: string, alt: string, width: int, height: int, format: string, loading: string, source: string, candidates: array<struct<url: string, width: int, density: double>>, picture_sources: array<string>>>,
image_summary struct<total: int, missing_alt: int, empty_alt: int, lazy: int, missing_dimensions: int, data_uris: int, data_uri_bytes: long, backgrounds: int, responsive: int>,
videos array<struct<kind: string, url: string, poster: string>>,
structured_data array<struct<raw: string, parse_error: string>>,
schema_items array<struct<format: string, types: array<string>, path: string, profile: string, status: string, missing_required: array<string>, missing_recommended: array<string>>>,
schema_errors array<struct<kind: string, path: string>>, schema_truncated boolean,
content struct<text: string, word_count: int, content_hash: string, area_method: string, aria_hidden_words: int>,
social struct<og: map<string, string>, twitter: map<string, string>>,
head_meta struct<viewport: string, viewport_blocks_zoom: boolean, og_images: array<struct<url: string, width: string, height: string, alt: string>>, verification: map<string, string>, tags: int>,
head_boundary struct<elements: int, closed_by: string, stranded: array<struct<signal: string, tag: string, honoured: boolean>>>,
charset struct<value: string, source: string, effective: boolean>, base_href struct<href: string, count: int>,
hreflang array<struct<lang: string, href: string>>, contacts array<struct<kind: string, value: string>>,
favicons array<struct<href: string, rel: string, sizes: string, type: string, source: string, unstable: boolean>>,
fonts struct<faces: array<struct<family: string, display: string, urls: array<string>, preload_missing_crossorigin: boolean>>, third_party_hosts: array<string>>,
resource_hints struct<scripts: int, blocking_scripts: int, stylesheets: int, preloads: int, preconnects: int>,
page_stats struct<html_bytes: long, text_bytes: long, text_ratio: double, dom_nodes: int>,
needs_js boolean
"""

#: Pages, and characters of HTML, whose facts a task holds before it gives them back.
ROWS, CHARS = 256, 4 << 20

NOISE = frozenset("script style noscript template".split())
BLOCK = frozenset("address article aside blockquote dd details dt div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main nav ol p pre section table td th tr ul".split())
SECTIONS = ("article", "section", "aside", "nav")
#: Landmark elements.
LANDMARKS = ("main", "header", "footer", "nav", "aside", "search", "form")
#: Schemes of references that are no links.
NOT_LINKS = ("mailto:", "tel:", "javascript:", "sms:", "fax:")
#: Attributes in which lazy loaders keep an image's address.
SRC_ATTRIBUTES = ("src", "data-src", "data-lazy-src", "data-original", "data-lazy", "data-srcset", "data-url", "data-img", "data-image", "data-hi-res-src")
#: Names of site-verification tags and who they are for.
VERIFICATION = {"google-site-verification": "google", "msvalidate.01": "bing", "p:domain_verify": "pinterest", "facebook-domain-verification": "facebook", "yandex-verification": "yandex", "norton-safeweb-site-verification": "norton-safeweb", "ahrefs-site-verification": "ahrefs"}
#: Signals that may stand past the head: name, whether search engines honour them there, tag and test.
STRANDED: tuple[tuple[str, bool, str, Callable[[Node], bool]], ...] = (
    ("canonical", False, "link", lambda n: "canonical" in _rel(n)),
    ("hreflang", False, "link", lambda n: "alternate" in _rel(n) and bool(n.get("hreflang"))),
    ("meta-robots", True, "meta", lambda n: _name(n) in ("robots", "googlebot")),
    ("meta-description", False, "meta", lambda n: _name(n) == "description"),
    ("title", False, "title", lambda n: n.above("svg") is None),
    ("open-graph", False, "meta", lambda n: (n.get("property") or "").startswith("og:")),
    ("twitter-card", False, "meta", lambda n: (n.get("name") or n.get("property") or "").startswith("twitter:")),
)
#: Hosts that serve fonts.
FONT_HOSTS = ("fonts.googleapis.com", "fonts.gstatic.com", "use.typekit.net", "p.typekit.net", "fonts.bunny.net", "use.fontawesome.com", "kit.fontawesome.com", "cloud.typography.com", "fast.fonts.net")


def _rel(n: Node) -> list[str]:
    return (n.get("rel") or "").lower().split()


def _name(n: Node) -> str:
    return (n.get("name") or "").strip().lower()


def _int(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if text.isascii() and text.isdigit() and len(text) < 10 else None


class Page:
    """One parsed page and its facts."""

    def __init__(self, url: str, html: str, headers: dict[str, str], suffixes: Suffixes | None = None) -> None:
        self.url, self.html, self.headers = url, html, {k.lower(): v for k, v in headers.items()}
        self.suffixes = suffixes or Suffixes()
        self.root = parse(html)
        self.nodes = list(self.root.walk())
        bases = [n.get("href") for n in self.nodes if n.name == "base" and n.get("href")]
        self.bases = bases
        self.base = self._join(url, bases[0]) if bases else url

    def all(self, *names: str) -> list[Node]:
        return [n for n in self.nodes if n.name in names]

    @staticmethod
    def _join(base: str, ref: str) -> str:
        try:
            return urljoin(base, ref.strip())
        except ValueError:
            return ref

    def resolve(self, ref: str) -> str:
        return self._join(self.base, ref)

    def metas(self, name: str) -> list[str]:
        return [n.get("content").strip() for n in self.all("meta") if _name(n) == name and n.get("content") is not None]

    def titles(self) -> dict:
        found = [collapse(n.text()) for n in self.all("title") if n.above("svg") is None]
        return {"title": found[0] if found else None, "titles": found}

    def description(self) -> dict:
        found = self.metas("description")
        words = self.metas("keywords")
        return {"meta_description": found[0] if found else None, "meta_descriptions": found, "keywords": words[0] if words else None}

    def refresh(self) -> dict:
        for n in self.all("meta"):
            if (n.get("http-equiv") or "").lower() == "refresh":
                m = re.match(r"\s*(\d+(?:\.\d+)?)\s*(?:[;,]\s*(?:url\s*=\s*)?['\"]?([^'\"]*))?", n.get("content") or "", re.IGNORECASE)
                if m:
                    return {"meta_refresh": {"delay": float(m[1]), "url": self.resolve(m[2]) if m[2] else None}}
        return {"meta_refresh": None}

    def canonical(self) -> dict:
        found = next((n.get("href") for n in self.all("link") if "canonical" in _rel(n) and n.get("href")), None)
        return {"canonical": self.resolve(found) if found else None}

    def robots(self) -> dict:
        rules = [r.strip().lower() for c in [*self.metas("robots"), *self.metas("googlebot"), self.headers.get("x-robots-tag", "")] for r in c.split(",") if r.strip()]
        rules = [r.rpartition(":")[2].strip() if r.startswith(("googlebot:", "bingbot:", "*:")) else r for r in rules]
        return {"robots": {"meta": rules, "noindex": "noindex" in rules or "none" in rules, "nofollow": "nofollow" in rules or "none" in rules}}

    def headings(self) -> dict:
        own = {f"h{k}": [collapse(n.text()) for n in self.all(f"h{k}")] for k in (1, 2, 3)}
        order = [{"level": int(n.name[1]), "text": collapse(n.text()), "in_main": n.above("main") is not None} for n in self.all("h1", "h2", "h3", "h4", "h5", "h6")]
        tables = [{"headers": sum(1 for t in n.find("th") if t.above("table") is n), "caption": next((collapse(c.text()) for c in n.find("caption")), None)} for n in self.all("table")]
        marks = [k for k in LANDMARKS if any(n.name == k or n.get("role") == {"header": "banner", "footer": "contentinfo", "nav": "navigation", "aside": "complementary"}.get(k, k) for n in self.nodes)]
        count = lambda *names: len(self.all(*names))
        return {"headings": own, "structure": {"headings": order, "paragraphs": count("p"), "ordered_lists": count("ol"), "unordered_lists": count("ul"), "definition_lists": count("dl"), "tables": tables, "preformatted": count("pre"), "quotes": count("blockquote"), "landmarks": marks}}

    def links(self) -> dict:
        own, out = self.suffixes.site(normalize(self.url) or self.url), []
        for n in self.all("a"):
            href = (n.get("href") or "").strip()
            if not href or href.startswith("#") or href.lower().startswith(NOT_LINKS):
                continue
            target = self.resolve(href)
            there = normalize(href, self.base)
            rel = _rel(n)
            inner = bool(there and own) and self.suffixes.site(there) == own
            out.append({"target": target, "target_normalized": there, "anchor": collapse(n.text()), "type": "internal" if inner else "external", "rel": n.get("rel"), "nofollow": "nofollow" in rel, "sponsored": "sponsored" in rel, "ugc": "ugc" in rel, "target_attr": n.get("target")})
        return {"links": out}

    @staticmethod
    def srcset(text: str) -> list[dict]:
        out = []
        for m in re.finditer(r"\s*,*\s*(\S*[^\s,])(?:\s+([\d.]+)([wx]))?\s*(?:,|$)", text or ""):
            number, unit = m[2], m[3]
            out.append({"url": m[1], "width": int(float(number)) if unit == "w" else None, "density": float(number) if unit == "x" else None if unit == "w" else 1.0})
        return out

    def images(self) -> dict:
        out, data, data_bytes = [], 0, 0
        for n in self.all("img", "input"):
            if n.name == "input" and (n.get("type") or "").lower() != "image":
                continue
            candidates = [{**c, "url": self.resolve(c["url"])} for a in ("srcset", "data-srcset", "data-lazy-srcset") for c in self.srcset(n.get(a) or "")]
            refs = [n.get(a) for a in SRC_ATTRIBUTES if n.get(a)]
            real = [r for r in refs if not r.startswith("data:")]
            for r in refs:
                if r.startswith("data:"):
                    data += 1
                    body = r.partition(",")[2]
                    data_bytes += len(body.rstrip("=")) * 3 // 4 if ";base64" in r[:80] else len(body)
            src = self.resolve(real[0]) if real else candidates[0]["url"] if candidates else None
            if not src:
                continue
            picture = n.above("picture")
            ext = re.search(r"\.([A-Za-z0-9]{1,5})$", urlsplit(src).path)
            out.append({"src": src, "alt": n.get("alt"), "width": _int(n.get("width")), "height": _int(n.get("height")), "format": ext[1].lower() if ext else None, "loading": n.get("loading"), "source": "element", "candidates": candidates, "picture_sources": [self.resolve(c["url"]) for s in (picture.find("source") if picture else []) for c in self.srcset(s.get("srcset") or "")]})
        css = [n.get("style") for n in self.nodes if n.get("style")] + [n.text() for n in self.all("style")]
        backgrounds = list(dict.fromkeys(self.resolve(u) for c in css for u in re.findall(r"(?:background|background-image|list-style|list-style-image|border-image|border-image-source|mask|mask-image|content|cursor|-webkit-mask|-webkit-mask-image)\s*:[^;}]*?url\(\s*['\"]?([^'\")]+)", c) if not u.startswith("data:")))
        summary = {"total": len(out), "missing_alt": sum(i["alt"] is None for i in out), "empty_alt": sum(i["alt"] == "" for i in out), "lazy": sum(i["loading"] == "lazy" for i in out), "missing_dimensions": sum(i["width"] is None or i["height"] is None for i in out), "data_uris": data, "data_uri_bytes": data_bytes, "backgrounds": len(backgrounds), "responsive": sum(bool(i["candidates"]) for i in out)}
        return {"images": out, "image_summary": summary}

    def videos(self) -> dict:
        out: dict[str, dict] = {}
        for n in self.all("video", "iframe"):
            if n.name == "video":
                refs = [("file", r) for r in [n.get("src"), *(s.get("src") for s in n.find("source"))] if r]
            else:
                src = n.get("src") or n.get("data-src") or ""
                kind = "youtube" if re.search(r"youtube(-nocookie)?\.com/embed|youtu\.be/", src) else "vimeo" if "player.vimeo.com" in src else "iframe" if re.search(r"video|player|wistia|dailymotion", src) else None
                refs = [(kind, src)] if kind else []
            for kind, r in refs:
                out.setdefault(self.resolve(r), {"kind": kind, "url": self.resolve(r), "poster": self.resolve(n.get("poster")) if n.get("poster") else None})
        return {"videos": list(out.values())}

    def structured(self) -> dict:
        blocks, found = schema_org.report(self.root)
        return {"structured_data": blocks, "schema_items": found.items, "schema_errors": found.errors, "schema_truncated": found.truncated}

    def content(self) -> dict:
        chrome = {id(n) for n in self.all("header", "footer", "nav") if n.above(*SECTIONS) is None}
        main, role = self.root.first("main"), next((n for n in self.nodes if n.get("role") == "main"), None)
        articles = self.all("article")
        area, method = (main, "main") if main else (role, "role-main") if role else (articles[0], "article") if len(articles) == 1 else (self.root.first("body") or self.root, "body-minus-chrome")

        def text_of(node: Node) -> str:
            out: list[str] = []
            stack: list[Any] = list(reversed(node.children))
            while stack:
                item = stack.pop()
                if isinstance(item, str):
                    out.append(item)
                elif item.name == "br":
                    out.append(" ")
                elif item.name not in NOISE and item.name not in ("head", "title") and id(item) not in chrome:
                    if item.name in BLOCK:
                        stack.append(" ")
                    stack.extend(reversed(item.children))
            return collapse("".join(out))

        text = text_of(area)
        hidden = sum(len(text_of(n).split()) for n in area.walk() if n.get("aria-hidden") == "true" and not _hidden_above(n, area))
        return {"content": {"text": text, "word_count": len(text.split(" ")) if text else 0, "content_hash": hashlib.sha256(text.lower().encode("utf-8", "surrogatepass")).hexdigest(), "area_method": method, "aria_hidden_words": hidden}}

    def social(self) -> dict:
        og: dict[str, str] = {}
        twitter: dict[str, str] = {}
        images: list[dict] = []
        marks: dict[str, str] = {}
        for n in self.all("meta"):
            key, value = (n.get("property") or n.get("name") or "").strip().lower(), n.get("content")
            if value is None:
                continue
            if key.startswith("og:"):
                og.setdefault(key, value)
                if key in ("og:image", "og:image:url"):
                    images.append({"url": self.resolve(value), "width": None, "height": None, "alt": None})
                elif images and key in ("og:image:width", "og:image:height", "og:image:alt"):
                    images[-1][key.rpartition(":")[2]] = value
            elif key.startswith("twitter:"):
                twitter[key] = value
            if key in VERIFICATION:
                marks.setdefault(VERIFICATION[key], value)
        views = self.metas("viewport")
        pairs = dict(re.findall(r"([a-z_-]+)\s*=\s*([^,;\s]+)", views[0].lower())) if views else {}
        try:
            scale = float(pairs.get("maximum-scale", "10"))
        except ValueError:
            scale = 10.0
        return {"social": {"og": og, "twitter": twitter}, "head_meta": {"viewport": views[0] if views else None, "viewport_blocks_zoom": pairs.get("user-scalable") in ("no", "0") or scale < 2, "og_images": images, "verification": marks, "tags": len(self.all("meta"))}}

    def head(self) -> dict:
        head, body = self.root.first("head"), self.root.first("body")
        stranded = [{"signal": s, "tag": n.name, "honoured": ok} for s, ok, tag, test in STRANDED for n in (body.find(tag) if body else []) if test(n) and n.above("template") is None]
        culprit = next((c.name for c in (body.children if body and stranded else []) if isinstance(c, Node) and c.name not in ("base", "link", "meta", "noscript", "script", "style", "template", "title")), None)
        value, source, offset = None, None, 0
        if self.html.startswith("﻿"):
            value, source = "utf-8", "bom"
        elif m := re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", self.headers.get("content-type", ""), re.IGNORECASE):
            value, source = m[1].lower(), "header"
        else:
            for n in self.all("meta"):
                found = n.get("charset") or (re.findall(r"charset\s*=\s*([^\s;\"']+)", n.get("content") or "", re.IGNORECASE) or [None])[0] if (n.get("charset") or (n.get("http-equiv") or "").lower() == "content-type") else None
                if found:
                    value, source, offset = found.lower(), "meta", len(self.html[: n.start].encode("utf-8", "surrogatepass"))
                    break
        bases = [n for n in self.all("base") if n.get("href") is not None]
        return {"head_boundary": {"elements": sum(isinstance(c, Node) for c in head.children) if head else 0, "closed_by": culprit, "stranded": stranded}, "charset": {"value": value, "source": source, "effective": value is not None and offset < 1024}, "base_href": {"href": bases[0].get("href") if bases else None, "count": len(bases)}}

    def alternates(self) -> dict:
        langs = [{"lang": n.get("hreflang"), "href": self.resolve(n.get("href"))} for n in self.all("link") if "alternate" in _rel(n) and n.get("hreflang") and n.get("href")]
        contacts: dict[tuple[str, str], dict] = {}
        for n in self.all("a"):
            m = re.match(r"\s*(mailto|tel):([^?]+)", n.get("href") or "", re.IGNORECASE)
            if m:
                kind = "email" if m[1].lower() == "mailto" else "phone"
                contacts.setdefault((kind, m[2].strip().lower()), {"kind": kind, "value": m[2].strip()})
        return {"hreflang": langs, "contacts": list(contacts.values())}

    def icons(self) -> dict:
        out = []
        for n in self.all("link"):
            if n.get("href") and {"icon", "apple-touch-icon", "mask-icon", "apple-touch-icon-precomposed"} & set(_rel(n)):
                href = self.resolve(n.get("href"))
                out.append({"href": href, "rel": n.get("rel").lower(), "sizes": n.get("sizes"), "type": n.get("type"), "source": "declared", "unstable": bool(re.search(r"[?&](v|ver|version|t|ts)=|[0-9a-f]{8,}", href))})
        if not out:
            out.append({"href": self._join(self.url, "/favicon.ico"), "rel": "icon", "sizes": None, "type": None, "source": "implicit", "unstable": False})
        return {"favicons": out}

    def fonts(self) -> dict:
        preloads = {self.resolve(n.get("href")): "crossorigin" in n.attrs for n in self.all("link") if "preload" in _rel(n) and (n.get("as") or "").lower() == "font" and n.get("href")}
        faces, hosts = [], []
        for style in self.all("style"):
            for body in re.findall(r"@font-face\s*\{([^}]*)\}", style.text(), re.IGNORECASE):
                family, display = (re.search(rf"{p}\s*:\s*([^;]+)", body, re.IGNORECASE) for p in ("font-family", "font-display"))
                urls = [self.resolve(u) for u in re.findall(r"url\(\s*['\"]?([^'\")]+)", body)]
                faces.append({"family": family[1].strip(" '\"") if family else None, "display": display[1].strip() if display else None, "urls": urls, "preload_missing_crossorigin": any(u in preloads and not preloads[u] for u in urls)})
        known = {u for f in faces for u in f["urls"]}
        faces += [{"family": None, "display": None, "urls": [u], "preload_missing_crossorigin": not ok} for u, ok in preloads.items() if u not in known]
        refs = [*(u for f in faces for u in f["urls"]), *(self.resolve(n.get("href")) for n in self.all("link") if n.get("href") and {"stylesheet", "preload", "preconnect"} & set(_rel(n)))]
        for u in refs:
            host = urlsplit(u).hostname or ""
            if host in FONT_HOSTS and host not in hosts:
                hosts.append(host)
        return {"fonts": {"faces": faces, "third_party_hosts": hosts}}

    def hints(self) -> dict:
        scripts = [n for n in self.all("script") if n.get("src")]
        blocking = [n for n in scripts if not {"async", "defer"} & set(n.attrs) and (n.get("type") or "").lower() != "module" and n.above("head") is not None]
        rel = lambda kind: sum(kind in _rel(n) for n in self.all("link"))
        return {"resource_hints": {"scripts": len(scripts), "blocking_scripts": len(blocking), "stylesheets": rel("stylesheet"), "preloads": rel("preload"), "preconnects": rel("preconnect")}}

    def stats(self) -> dict:
        body = self.root.first("body") or self.root
        text = len(collapse(body.text(skip=NOISE)).encode("utf-8", "surrogatepass"))
        size = len(self.html.encode("utf-8", "surrogatepass"))
        scripts = sum(len(n.text()) for n in self.all("script"))
        ratio = min(1.0, text / size) if size else 0.0
        mount = any(n.get("id") in ("root", "app", "__next", "__nuxt") for n in self.nodes)
        links = len(self.links()["links"])
        return {"page_stats": {"html_bytes": size, "text_bytes": text, "text_ratio": ratio, "dom_nodes": len(self.nodes)}, "needs_js": (mount and text < 200) or (ratio < 0.05 and scripts > 3 * text and links < 3)}

    GROUPS = (titles, description, refresh, canonical, robots, headings, links, images, videos, structured, content, social, head, alternates, icons, fonts, hints, stats)

    def facts(self) -> dict:
        out: dict = {}
        for group in self.GROUPS:
            try:
                out |= group(self)
            except (ValueError, KeyError, IndexError, AttributeError, TypeError, RecursionError):
                continue
        return out

    def release(self) -> None:
        """Parts the tree, whose nodes know their parents, so that it is freed at once and not when Python next looks for cycles."""
        for n in self.nodes:
            n.parent = None


def _facts(url: str | None, html: str | None, headers: Any, known: Suffixes) -> dict:
    if html is None:
        return {}
    page = Page(url or "", html, dict(headers) if headers is not None else {}, known)
    try:
        return page.facts()
    finally:
        page.release()


def _hidden_above(node: Node, area: Node) -> bool:
    up = node.parent
    while up is not None and up is not area:
        if up.get("aria-hidden") == "true":
            return True
        up = up.parent
    return False


def schema() -> StructType:
    return StructType.fromDDL(FIELDS)


def extract(pages: DataFrame, url: str = "url", html: str = "html", headers: Column | None = None, rules: tuple[str, ...] | None = None) -> DataFrame:
    """pages with the facts of their HTML as columns; null HTML gives null facts. A link is internal if it stays in the registrable domain of its page, by these rules of public suffixes or those that come with Spark."""
    kind, rules = schema(), suffix_rules(pages.sparkSession) if rules is None else rules
    names = kind.fieldNames()

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = suffixes(rules)
        for urls, htmls, own in batches:
            # facts are given back after a few pages: a task holds the HTML of one batch and the facts of CHARS of it
            rows, held = [], 0
            for u, h, x in zip(urls, htmls, own, strict=True):
                rows.append(_facts(u, h, x, known))
                held += len(h) if h is not None else 0
                if len(rows) == ROWS or held >= CHARS:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    own = headers if headers is not None else F.lit(None).cast("map<string,string>")
    out = pages.withColumn("_facts", run(F.col(url), F.col(html), own))
    return out.withColumns({n: F.col(f"_facts.{n}") for n in names}).drop("_facts")
