"""Sitemaps, their indexes and feeds from stored bodies: parsed as a stream, a row an entry, and followed to a fixed point.

A body is inflated and parsed in pieces: an element is dropped as soon as it has ended, so memory follows the longest entry and not
the file. A first pass tells whether the file is sound and within the bound on inflated bytes - a file that isn't is refused whole,
with its error - and a second one puts out its rows.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions import urls
from sitequarry.plans.lineage import cut, drop_cut

#: Fixed value: inflated bytes beyond which a file is refused.
MOST_BYTES = 64 << 20
PIECE = 1 << 16
#: Rows of parse(): one of part `file` for each file, with its kind or error, and one for each entry and child.
ROW = "url string, part string, kind string, error string, input_order long, loc string, lastmod string, changefreq string, priority string, images array<string>, videos array<string>, news array<string>"
_ARROW = pa.schema([("url", pa.string()), ("part", pa.string()), ("kind", pa.string()), ("error", pa.string()), ("input_order", pa.int64()), ("loc", pa.string()), ("lastmod", pa.string()), ("changefreq", pa.string()), ("priority", pa.string()), ("images", pa.list_(pa.string())), ("videos", pa.list_(pa.string())), ("news", pa.list_(pa.string()))])


class Refused(ValueError):
    """A file that isn't parsed, and why."""


def pieces(body: bytes, most_bytes: int = MOST_BYTES, piece: int = PIECE) -> Iterator[bytes]:
    """The plain bytes in pieces, inflated if the body begins as gzip does; Refused beyond the bound or where inflating fails."""
    if body[:2] != b"\x1f\x8b":
        for at in range(0, len(body), piece):
            yield body[at : at + piece]
        return
    total, left = 0, body
    while left:
        inflate = zlib.decompressobj(wbits=31)
        while not inflate.eof:
            try:
                out = inflate.decompress(left, piece)
            except zlib.error as e:
                raise Refused(f"gzip decompression failed: {e}") from e
            left = inflate.unconsumed_tail if not inflate.eof else inflate.unused_data
            total += len(out)
            if total > most_bytes:
                raise Refused(f"over {most_bytes} bytes when inflated")
            if not out and not inflate.eof and not left:
                raise Refused("gzip decompression failed: the file is cut off")
            yield out
        left = left.lstrip(b"\0")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _child(node: ET.Element, name: str) -> str | None:
    return next((c.text.strip() for c in node if _local(c.tag) == name and c.text and c.text.strip()), None)


def _all(node: ET.Element, name: str, field: str) -> list[str]:
    return [v for c in node if _local(c.tag) == name and (v := _child(c, field))]


def _entry(kind: str, node: ET.Element) -> dict | None:
    """The row of a finished element, None if it makes none."""
    if kind == "index":
        loc = _child(node, "loc")
        return {"part": "child", "loc": loc} if loc else None
    if kind == "urlset":
        loc = _child(node, "loc")
        return {"part": "entry", "loc": loc, "lastmod": _child(node, "lastmod"), "changefreq": _child(node, "changefreq"), "priority": _child(node, "priority"), "images": _all(node, "image", "loc"), "videos": _all(node, "video", "title"), "news": _all(node, "news", "title")} if loc else None
    if kind == "atom":
        links = [c for c in node if _local(c.tag) == "link" and c.get("href")]
        loc = next((c.get("href") for c in links if c.get("rel", "alternate") == "alternate"), None) or _child(node, "id")
        return {"part": "entry", "loc": loc, "lastmod": _child(node, "updated")} if loc else None
    guid = next((c for c in node if _local(c.tag) == "guid" and c.get("isPermaLink", "true") != "false" and c.text and c.text.strip()), None)
    loc = _child(node, "link") or (guid.text.strip() if guid is not None else None)
    return {"part": "entry", "loc": loc, "lastmod": _child(node, "pubdate")} if loc else None


#: By root element: the kind of file, and the element that is a row, where it may stand.
_ROOTS = {"sitemapindex": ("index", None, 2), "urlset": ("urlset", "url", 2), "feed": ("atom", "entry", 2), "rss": ("rss", "item", 0), "rdf": ("rss", "item", 0)}


def _xml(parts: Iterator[bytes]) -> Iterator[dict]:
    parser = ET.XMLPullParser(("start", "end"))
    stack: list[ET.Element] = []
    kind, tag, level, seen = None, None, 0, b""

    def events() -> Iterator[tuple[str, ET.Element]]:
        nonlocal seen
        try:
            for part in parts:
                seen = seen if len(seen) > 2000 else seen + part
                if b"<!ENTITY" in seen[:2000]:
                    raise Refused("it declares entities")
                parser.feed(part)
                yield from parser.read_events()
            parser.close()
            yield from parser.read_events()
        except ET.ParseError as e:
            raise Refused(f"no well-formed XML: {e}") from e

    for what, node in events():
        if what == "start":
            if not stack:
                kind, tag, level = _ROOTS.get(_local(node.tag), (None, None, 0))
                if kind is None:
                    raise Refused(f"unknown root element {_local(node.tag)}")
                yield {"part": "file", "kind": kind}
            stack.append(node)
            continue
        depth = len(stack)
        stack.pop()
        if (tag is None or _local(node.tag) == tag) and (depth == level or (not level and depth > 1)):
            if row := _entry(kind, node):
                yield row
            node.clear()
        if depth == 2 or (not level and stack and _local(stack[-1].tag) == "channel"):
            stack[-1].remove(node)


def _lines(parts: Iterator[bytes]) -> Iterator[dict]:
    yield {"part": "file", "kind": "text"}
    left = b""
    for part in parts:
        lines = (left + part).split(b"\n")
        left = lines.pop()
        for line in [x for raw in lines for x in raw.decode("utf-8", "replace").splitlines()]:
            if re.match(r"https?://", line.strip()):
                yield {"part": "entry", "loc": line.strip()}
    for line in left.decode("utf-8", "replace").splitlines():
        if re.match(r"https?://", line.strip()):
            yield {"part": "entry", "loc": line.strip()}


def _json(parts: Iterator[bytes]) -> Iterator[dict]:
    """A JSON feed is read whole: it is bounded like any file."""
    try:
        items = json.loads(b"".join(parts).decode("utf-8-sig", "replace")).get("items", [])
    except (ValueError, AttributeError) as e:
        raise Refused(f"no JSON feed: {e}") from e
    yield {"part": "file", "kind": "json"}
    for i in items if isinstance(items, list) else []:
        if isinstance(i, dict) and (loc := i.get("url") or i.get("id")):
            yield {"part": "entry", "loc": str(loc), "lastmod": i.get("date_modified") or i.get("date_published")}


def rows_of(body: bytes | str | None, most_bytes: int = MOST_BYTES) -> Iterator[dict]:
    """The rows of a body: the file's first, then its entries or children in order. Refused where it isn't sound."""
    data = body.encode() if isinstance(body, str) else bytes(body or b"")
    stream = pieces(data, most_bytes)
    head = b""
    for part in stream:
        head += part
        if head.strip(b"\xef\xbb\xbf \t\r\n"):
            break
    begin = head.removeprefix(b"\xef\xbb\xbf").lstrip()

    def all_parts() -> Iterator[bytes]:
        yield begin
        yield from stream

    yield from (_xml if begin.startswith(b"<") else _json if begin.startswith(b"{") else _lines)(all_parts())


def sound_rows(body: bytes | str | None, most_bytes: int = MOST_BYTES) -> Iterator[dict]:
    """The rows of a body, or of one that isn't sound a single row with its error."""
    try:
        for _ in rows_of(body, most_bytes):
            pass
    except Refused as e:
        yield {"part": "file", "kind": "invalid", "error": str(e)}
        return
    at = 0
    for row in rows_of(body, most_bytes):
        yield row if row["part"] == "file" else row | {"input_order": at}
        at += row["part"] != "file"


def parse(files: DataFrame, url: str = "url", body: str = "content", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows (see ROW) of files; each file, refused ones too, has one of part `file`."""

    @F.arrow_udtf(returnType=ROW)
    class Rows:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            held: list[dict] = []
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                for row in sound_rows(data.as_py(), most_bytes):
                    held.append(row | {"url": name.as_py()})
                    if len(held) >= 5000:
                        yield pa.Table.from_pylist(held, _ARROW)
                        held = []
            yield pa.Table.from_pylist(held, _ARROW)

    return Rows(files.select(F.col(url).cast("string").alias("url"), F.col(body)).asTable())


def reach(children: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(url, level) of all files that roots(url) reach over children(url, child): each round looks only behind what the round before has found first.

    Cycles end as what is known isn't found again. most_depth: indexes below that level are not followed; without it the search
    goes on until nothing is new.
    """
    level = 0
    fresh = cut(roots.select("url").distinct().withColumn("level", F.lit(0)))
    known, made = fresh, [fresh]
    while (most_depth is None or level < most_depth) and fresh.limit(1).count():
        level += 1
        found = fresh.join(children, "url").select(F.col("child").alias("url")).distinct()
        fresh = cut(found.join(known.select("url"), "url", "left_anti").withColumn("level", F.lit(level)), few=True)
        made.append(fresh)
        known = known.unionByName(fresh)
    out = cut(known, few=True)
    for one in made:
        drop_cut(one)
    return out


def discover(files: DataFrame, roots: list[str], most_depth: int | None = None, most_entries: int | None = None) -> DataFrame:
    """Entries of all sitemaps that the roots reach over stored files(url, content); of a location the first listing wins, by level, file and place.

    most_entries keeps so many of the first by that order; without it all stay.
    """
    rows = cut(parse(files))
    spark = files.sparkSession
    children = rows.where("part = 'child'").select("url", F.col("loc").alias("child"))
    levels = reach(children, spark.createDataFrame([(r,) for r in roots], "url string"), most_depth)
    entries = rows.where("part = 'entry'").join(levels, "url").select(F.col("url").alias("source_sitemap"), "level", "input_order", "loc", "lastmod", "changefreq", "priority")
    order = F.struct("level", "source_sitemap", "input_order")
    first = entries.groupBy("loc").agg(F.min_by(F.struct("source_sitemap", "level", "input_order", "lastmod", "changefreq", "priority"), order).alias("f")).select("loc", "f.*")
    if most_entries is not None:
        first = first.orderBy("level", "source_sitemap", "input_order", "loc").limit(most_entries)
    return first.withColumn("normalized_loc", urls.normalize_url("loc"))


def refused(rows: DataFrame) -> DataFrame:
    """(url, error) of files that were not parsed."""
    return rows.where("part = 'file' and error is not null").select("url", "error")


def per_file(rows: DataFrame) -> DataFrame:
    """Per file: kind, error, and how many entries and children it lists, and how many of its entries repeat one of its own."""
    own = Window.partitionBy("url", "loc").orderBy("input_order")
    marked = rows.withColumn("again", (F.col("part") == "entry") & (F.row_number().over(own) > 1))
    return marked.groupBy("url").agg(F.max("kind").alias("kind"), F.max("error").alias("error"), F.count_if(F.col("part") == "entry").alias("entries"), F.count_if(F.col("part") == "child").alias("children"), F.count_if("again").alias("repeated"))
