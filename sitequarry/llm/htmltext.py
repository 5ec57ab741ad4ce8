"""Main-text extraction by line-block distribution.

Markup is stripped to lines, one for each block of text; a boundary of a container leaves an empty line, that of a marked
article a window of them. A line weighs its characters outside links. Lines in elements, roles or named parts that belong to
the page and not to its article (menus, forms, comments, adverts and the like) are stripped as markup. In a marked article
(article, main, or their role) a line that has any weight weighs BONUS times its characters and LIFT more: so much and no more.

Weights are summed over sliding windows of WINDOW lines. Lines between windows of nothing are a run. A run counts where a sum
surges to the threshold, a share of the page's largest sum up to a limit; its text begins where the weight rises and ends where it dives to
nothing. So a teaser, a notice or an unnamed advert beside the article goes because its windows don't surge beside the
article's, a list of links at the end of an article goes because it has no weight, and a page whose text stands outside a small
marked card keeps it. Outside marks the containers at either end of a run go that hold no surge, no title and no sentence, and
so do copyright lines.

Defined results: null and empty pages give the empty text; character references are decoded as HTML does, within one text
node, without the semicolon too; white space in a block becomes one space; blocks are joined by a newline; an element left open
ends with its parent; columns text and n_chars of the caller are replaced, others kept; repeated pages give a row each.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import per_text

#: Lines of a window; the share of the page's largest sum that a surge reaches, and the limit of that, without and with marks.
WINDOW, SHARE, LIMIT, MARKED_SHARE, MARKED_LIMIT = 3, 0.5, 80, 0.4, 3000
#: What a mark gives a line of weight: so many times its characters, and so many more.
BONUS, LIFT = 8, 100
#: Elements whose boundaries leave an empty line.
CONTAINERS = frozenset("div section table td main header footer nav aside form figure center details fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "iframe", "noembed", "noframes", "xmp", "noscript", "template", "svg", "math", "object", "canvas", "select", "button", "audio", "video")
ASIDE = frozenset("nav footer aside form dialog menu head title fieldset label datalist dir".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form note tablist".split())
#: Words of a name (class or id) that say a part is no article, words that say it only has such a part, and whole names.
_WORDS = frozenset("comment comments disqus replies sidebar breadcrumb breadcrumbs cookie cookies newsletter pagination ad ads advert adverts advertisement advertisements adsbygoogle sponsored".split())
_HOLDS = frozenset("has have with without no".split())
_NAMES = re.compile(r"^(?:respond|side-?bar|share-?(?:bar|buttons|links)|related-?(?:articles|posts|links|stories)?|site-?(?:header|footer|nav)|nav-?(?:bar|menu)|skip-link)$", re.IGNORECASE)
_APART = re.compile(r"[-_]+")
#: A line that is a sentence, and one that states a copyright.
_SENTENCE = re.compile(r"[.!?\u2026\u3002]['\")\]\u2019\u201d\u00bb]*$")
_COPYRIGHT = re.compile(r"^(?:\u00a9|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
#: Elements that the start of another one ends.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _stripped(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of the article."""
    if name in ASIDE or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    a = _attributes(attributes)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}".split()
    return any(_NAMES.match(n) or (_WORDS.intersection(words := _APART.split(n.lower())) and not _HOLDS.intersection(words)) for n in names)


class Line(NamedTuple):
    """A block's text, its characters outside links, and whether it stands inside a marked article; a title counts as a surge of its own."""

    text: str
    plain: int
    inside: bool
    title: bool

    @property
    def weight(self) -> int:
        return BONUS * self.plain + LIFT if self.inside and self.plain else self.plain

    @property
    def furniture(self) -> bool:
        """Nothing that a text begins or ends with, unless it surges."""
        return not _SENTENCE.search(self.text) or bool(_COPYRIGHT.search(self.text))


def lines_of(html: str) -> tuple[list[Line | None], bool]:
    """The lines that are not stripped, None for an empty line, and whether the page marks an article."""
    out: list[Line | None] = []
    stack: list[tuple[str, bool, bool]] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    at, marked, linked = 0, False, 0
    beside, inside = False, False

    def flush(title: bool = False) -> None:
        nonlocal linked
        if parts:
            line = " ".join("".join(parts).split())
            if line and not beside:
                out.append(Line(line, max(0, len(line) - linked), inside, title))
            parts.clear()
            linked = 0

    def gap(lines: int = 1) -> None:
        if not inside:
            out.extend([None] * lines)

    def close(name: str) -> None:
        nonlocal beside, inside
        while stack:
            top, b, i = stack.pop()
            opened[top] -= 1
            was, beside, inside = inside, b, i
            if top in CONTAINERS or was != inside:
                gap(WINDOW if was != inside else 1)
            if top == name:
                return

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece)
            parts.append(piece)
            if opened.get("a"):
                linked += len(" ".join(piece.split()))

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _ENDS:
            if not ending and not attributes.rstrip().endswith("/"):
                end = _ENDS[name].search(html, at)
                at = end.end() if end else len(html)
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush(ending and name == "h1")
        if ending:
            if opened.get(name):
                close(name)
            continue
        if name in BLOCKS and opened.get("p"):
            close("p")
        for other in _CLOSES.get(name, ()):
            if opened.get(other) and stack[-1][0] == other:
                close(other)
        if name in VOID:
            continue
        stack.append((name, beside, inside))
        opened[name] = opened.get(name, 0) + 1
        kind = _stripped(name, attributes, inside)
        article = not beside and not kind and (name in ("article", "main") or 'role="main"' in attributes or 'itemprop="articleBody"' in attributes)
        if name in CONTAINERS or (article and not inside):
            gap(WINDOW if article else 1)
        if article:
            inside = marked = True
        beside = beside or kind
    text(html[at:])
    flush()
    return out, marked


def runs(weights: list[int]) -> list[tuple[int, int]]:
    """(first, last) of the runs: places with weight, with fewer than WINDOW places of none between."""
    out: list[list[int]] = []
    for i, w in enumerate(weights):
        if w:
            if out and i - out[-1][1] <= WINDOW:
                out[-1][1] = i
            else:
                out.append([i, i])
    return [(a, b) for a, b in out]


def _trimmed(lines: list[Line | None], weights: list[int], first: int, last: int, threshold: float) -> tuple[int, int]:
    """The run without the containers at either end that are page furniture: no title, no sentence, and no surge unless of a copyright."""

    def group(i: int, step: int) -> tuple[int, bool]:
        """The place behind the container that i is in, and whether it stays."""
        own: list[int] = []
        stays = False
        while first <= i <= last and (line := lines[i]) is not None:
            if line.title or line.inside:
                return i, True
            stays = stays or not line.furniture
            own.append(0 if _COPYRIGHT.search(line.text) else weights[i])
            i += step
        while first <= i <= last and lines[i] is None:
            i += step
        return i, stays or any(sum(own[k : k + WINDOW]) >= threshold for k in range(len(own)))

    while first < last and (after := group(first, 1))[0] <= last and not after[1]:
        first = after[0]
    while first < last and (after := group(last, -1))[0] >= first and not after[1]:
        last = after[0]
    return first, last


def main_text(html: str | None) -> str:
    """The kept lines, joined by newlines."""
    if not html:
        return ""
    lines, marked = lines_of(html)
    weights = [0 if x is None else x.weight for x in lines]
    if marked:
        # A title that is a link has no weight of its own; beside its article it belongs to it.
        weights = [w or (LIFT if x is not None and x.title and x.inside else 0) for w, x in zip(weights, lines, strict=True)]
    sums, window = [0] * len(lines), 0
    for i in reversed(range(len(lines))):
        window += weights[i] - (weights[i + WINDOW] if i + WINDOW < len(lines) else 0)
        sums[i] = window
    peak = max(sums, default=0)
    threshold = min(MARKED_LIMIT, peak * MARKED_SHARE) if marked else min(LIMIT, peak * SHARE)
    kept = []
    for first, last in runs(weights):
        if max(sums[first : last + 1]) >= threshold:
            first, last = _trimmed(lines, weights, first, last, threshold)
            kept += [x.text for x in lines[first : last + 1] if x is not None]
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars."""

    def make():
        def one(html: str | None) -> tuple:
            text = main_text(html)
            return text, len(text)

        return one

    out = pages.withColumn("_main", per_text(make, "text string, n_chars long")(F.col(html_col)))
    return out.withColumns({"text": F.col("_main.text"), "n_chars": F.col("_main.n_chars")}).drop("_main")


def op5(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
