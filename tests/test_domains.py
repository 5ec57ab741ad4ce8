"""Registrable domains and scope against a walk over all suffixes of a host."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitequarry.functions import domains
from sitequarry.sources import crawl

RULES = ("com", "uk", "co.uk", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "ck", "*.ck", "!www.ck", "xn--p1ai", "公司.cn", "cn")


def walk(host, rules):
    """Every suffix of the host against every rule."""
    labels = host.split(".")
    best, exception = 1, None
    for rule in rules:
        want = [x if x.isascii() else x.encode("idna").decode() for x in rule.lstrip("!").split(".")]
        own = [x if x.isascii() else x.encode("idna").decode() for x in labels[-len(want) :]]
        if len(own) == len(want) and all(w in ("*", o) for w, o in zip(want, own, strict=True)):
            if rule.startswith("!"):
                exception = len(want) - 1
            else:
                best = max(best, len(want))
    n = best if exception is None else exception
    return ".".join(labels[-n - 1 :]) if len(labels) > n else None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["com", "uk", "co", "jp", "kawasaki", "city", "ck", "www", "a", "b", "xn--p1ai", "公司", "cn", "example"]), min_size=1, max_size=5))
def test_trie_equals_the_walk(labels):
    host = ".".join(labels)
    assert domains.Suffixes(RULES).registrable(host) == walk(host, RULES)


@pytest.mark.parametrize(("host", "domain"), [
    ("blog.example.co.uk", "example.co.uk"), ("co.uk", None), ("example.com.", "example.com"), ("EXAMPLE.com", "example.com"), ("localhost", None), ("127.0.0.1", None), ("[::1]", None), ("::1", None),
    ("", None), (None, None), ("a..com", None), ("x.shop.ck", "x.shop.ck"), ("shop.ck", None), ("a.www.ck", "www.ck"), ("a.b.city.kawasaki.jp", "city.kawasaki.jp"), ("unlisted.zz", "unlisted.zz"), ("zz", None),
])
def test_hosts(host, domain):
    assert domains.Suffixes(RULES).registrable(host) == domain


def test_list_on_the_class_path_and_by_path(spark, tmp_path):
    rules = domains.suffix_rules(spark)
    assert len(rules) > 5000 and {"co.uk", "*.ck", "!www.ck"} <= set(rules)
    assert "github.io" not in rules and "github.io" in domains.suffix_rules(spark, private=True)
    (tmp_path / "list.txt").write_text("// a list\ncom\n\n// ===BEGIN PRIVATE DOMAINS===\nhosted.com\n// ===END PRIVATE DOMAINS===\n*.uk note\n")
    assert domains.suffix_rules(spark, str(tmp_path / "list.txt")) == ("com", "*.uk")
    hosts = ["a.b.co.uk", "x.example.co.jp", "www.parliament.uk", "a.github.io", None, "10.0.0.1"] * 3
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(domains.registrable_domain(rules)(F.col("h")).alias("d")).collect()
    assert [r.d for r in got] == ["b.co.uk", "example.co.jp", "parliament.uk", "github.io", None, None] * 3


def _scoped(spark, seed, urls, aliases=()):
    scope = domains.derive_scope(seed, RULES, aliases)
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string")
    return [r.ok for r in rows.select("k", domains.in_scope(F.col("u"), scope, RULES).alias("ok")).orderBy("k").collect()]


def test_scope(spark):
    scope = domains.derive_scope("HTTPS://Example.com/start", RULES, [" Alias.example ", "alias.EXAMPLE", "www.alias.example", ""])
    assert (scope.registrable_domain, scope.fallback_host, scope.seed_origin, scope.seed_url) == ("example.com", None, "https://example.com", "https://example.com/start")
    assert scope.host_aliases == ("alias.example", "www.alias.example")
    assert domains.derive_scope("http://localhost:3105/", RULES).fallback_host == "localhost:3105"
    assert domains.derive_scope("http://[::1]:80/", RULES).fallback_host == "[::1]"
    with pytest.raises(ValueError):
        domains.derive_scope("not a url", RULES)
    assert _scoped(spark, "https://blog.example.co.uk/", ["https://shop.example.co.uk/x", "http://example.co.uk:8443/", "https://other.co.uk/", "https://notexample.co.uk/", None, "mailto:a", "https://u:p@www.example.co.uk/"]) == [True, True, False, False, False, False, True]
    assert _scoped(spark, "http://localhost:3105/", ["http://localhost:3105/p", "http://localhost:3000/p", "http://127.0.0.1:3105/p", "https://www.alias.example/y", "https://alias.example/", "https://sub.alias.example/"], ["alias.example"]) == [True, False, False, True, True, False]
    assert _scoped(spark, "http://[::1]/", ["http://[::1]/a", "http://[::1]:81/a", "http://[::2]/a"]) == [True, False, False]


def test_links_follow_the_scope(spark):
    html = '<a href="/a">1</a><a href="https://shop.example.co.uk/b">2</a><a href="https://other.co.uk/">3</a><a href="http://127.0.0.1/">4</a><a href="https://city.kawasaki.jp/">5</a>'
    pages = spark.createDataFrame([(1, "https://blog.example.co.uk/", html), (2, "http://127.0.0.1/x", html), (3, "https://a.city.kawasaki.jp/", html)], "page_id long, url string, html string")
    got = {r.input_order: [x.type for x in r.links] for r in crawl.from_html(pages).collect()}
    assert got == {1: ["internal", "internal", "external", "external", "external"], 2: ["internal", "external", "external", "internal", "external"], 3: ["internal", "external", "external", "external", "internal"]}
    links = crawl.explode_links(crawl.from_html(pages)).select("input_order", "source", "target_normalized", F.col("type").alias("was"))
    assert all(r.type == r.was for r in domains.typed_links(links, domains.suffix_rules(spark)).collect())
