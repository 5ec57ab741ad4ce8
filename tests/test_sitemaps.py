"""Sitemaps parsed as streams, refused at the bound, and followed to a fixed point, against plain walks."""

from __future__ import annotations

import gzip
import random
import tracemalloc

import pytest

from sitequarry.sources import site_files, sitemaps

URLSET = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="i"><url><loc> https://e.com/a </loc><lastmod>2024-01-01</lastmod><image:image><image:loc>i.png</image:loc></image:image><image:image/></url><url/></urlset>'


def locs(body, **options):
    return [r["loc"] for r in sitemaps.sound_rows(body, **options) if r["part"] != "file"]


def kind(body, **options):
    return next(iter(sitemaps.sound_rows(body, **options)))


def test_forms():
    rows = list(sitemaps.sound_rows(gzip.compress(URLSET.encode())))
    assert rows[0] == {"part": "file", "kind": "urlset"} and len(rows) == 2 and rows[1]["images"] == ["i.png"] and rows[1]["lastmod"] == "2024-01-01" and rows[1]["input_order"] == 0
    assert locs("<rss><channel><title>t</title><item><guid>https://e.com/g</guid></item><item><guid isPermaLink=\"false\">x</guid></item><item><link>https://e.com/l</link></item></channel></rss>") == ["https://e.com/g", "https://e.com/l"]
    assert locs('<feed xmlns="a"><link href="no"/><entry><link rel="self" href="s"/><link href="https://e.com/t"/></entry><entry><id>urn:1</id></entry></feed>') == ["https://e.com/t", "urn:1"]
    assert locs('{"items":[{"url":"https://e.com/j"},{"id":"k"},{}]}') == ["https://e.com/j", "k"]
    assert locs("https://e.com/x\r\nno\n  https://e.com/y") == ["https://e.com/x", "https://e.com/y"]
    assert locs("﻿" + URLSET) == ["https://e.com/a"] and locs(b"\n " + URLSET.partition("?>")[2].encode()) == ["https://e.com/a"]
    assert [kind(x)["kind"] for x in (None, "", "<a", "<html/>", b"\x1f\x8bbad", "https://e.com/x", '<!DOCTYPE x [<!ENTITY y "z">]><urlset/>', URLSET[:-5])] == ["text", "text", "invalid", "invalid", "invalid", "text", "invalid", "invalid"]


def test_bound_on_inflated_bytes():
    body = ("<urlset>" + "<url><loc>https://e.com/p</loc></url>" * 5000 + "</urlset>").encode()
    packed = gzip.compress(body)
    assert len(locs(packed, most_bytes=len(body))) == 5000
    row = kind(packed, most_bytes=len(body) - 1)
    assert row["kind"] == "invalid" and "inflated" in row["error"] and locs(packed, most_bytes=1000) == []
    assert "cut off" in kind(packed[:-20])["error"]
    assert locs(gzip.compress(b"https://e.com/1\n") + gzip.compress(b"https://e.com/2\n")) == ["https://e.com/1", "https://e.com/2"]


def test_memory_follows_an_entry_and_not_the_file():
    """A file of 11 MB that is 40 KB packed: a few pieces are held at a time."""
    packed = gzip.compress(b"<urlset>" + b"<url><loc>https://e.com/a-page-of-the-site</loc></url>" * 200_000 + b"</urlset>")
    tracemalloc.start()
    n = sum(1 for _ in sitemaps.rows_of(packed))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_001 and peak < 4 << 20


def test_a_row_an_entry_and_refused_files_named(spark):
    files = spark.createDataFrame([("a", bytearray(gzip.compress(URLSET.encode()))), ("b", bytearray(b"\x1f\x8bbad")), ("c", None), (None, bytearray(b"https://e.com/z"))], "url string, content binary").repartition(3)
    rows = sitemaps.parse(files)
    assert {(r.url, r.part, r.kind, r.loc) for r in rows.collect()} == {("a", "file", "urlset", None), ("a", "entry", None, "https://e.com/a"), ("b", "file", "invalid", None), ("c", "file", "text", None), (None, "file", "text", None), (None, "entry", None, "https://e.com/z")}
    assert [(r.url, r.error[:4]) for r in sitemaps.refused(rows).collect()] == [("b", "gzip")]
    rules = site_files.parse_robots(spark.createDataFrame([("h", "User-agent: A\nDisallow: /x"), ("g", None)], "host string, body string"))
    assert [tuple(r) for r in rules.collect()] == [("h", 0, "a", "user-agent", "A", 1), ("h", 0, "a", "disallow", "/x", 2)]


def _walk(files, roots, most_depth=None):
    """First listing of each location by level, file and place."""
    level, seen, now = 0, dict.fromkeys(roots, 0), list(roots)
    while now and (most_depth is None or level < most_depth):
        level += 1
        now = sorted({c for f in now if f in files and files[f][0] == "index" for c in files[f][1]} - seen.keys())
        seen |= dict.fromkeys(now, level)
    best = {}
    for f, at in seen.items():
        if f in files and files[f][0] == "urlset":
            for k, loc in enumerate(files[f][1]):
                best[loc] = min(best.get(loc, (99, "", 0)), (at, f, k))
    return {(loc, f, at, k) for loc, (at, f, k) in best.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_fix_point_against_a_walk(spark, seed):
    """Cycles, missing files, repeated locations, and depth beyond six."""
    rng = random.Random(seed)
    files = {f"i{k}": ("index", [f"i{k + 1}", f"s{k}", rng.choice(["i0", "gone", f"i{k}"])]) for k in range(9)}
    files |= {f"s{k}": ("urlset", [f"https://e.com/{rng.randrange(40)}" for _ in range(rng.randrange(12))]) for k in range(10)}
    text = lambda kind, names: "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>" if kind == "index" else "<urlset>" + "".join(f"<url><loc>{n}</loc></url>" for n in names) + "</urlset>"
    df = spark.createDataFrame([(n, text(*f)) for n, f in files.items()], "url string, content string")
    for depth in (None, 3):
        got = {(r.loc, r.source_sitemap, r.level, r.input_order) for r in sitemaps.discover(df, ["i0", "s9"], most_depth=depth).collect()}
        assert got == _walk(files, ["i0", "s9"], depth) and (depth or max(g[2] for g in got) > 6)
    assert len(sitemaps.discover(df, ["i0"], most_entries=5).collect()) == 5
    assert sitemaps.discover(df.limit(0), ["i0"]).collect() == []


def test_sixty_thousand_entries_stay(spark):
    body = "<urlset>" + "".join(f"<url><loc>https://e.com/{k}</loc></url>" for k in range(60_000)) + "</urlset>"
    assert sitemaps.discover(spark.createDataFrame([("s", body)], "url string, content string"), ["s"]).count() == 60_000
