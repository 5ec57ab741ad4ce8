"""Registrable domains by a trie of public suffixes, and the scope of a crawl that follows from them."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sitequarry.functions import urls

#: The list of public suffixes that comes with Spark's HTTP client.
LIST_ON_CLASSPATH = "mozilla/public-suffix-list.txt"


def parse_rules(text: str, private: bool = False) -> tuple[str, ...]:
    """The rules of a suffix list: one a line, `//` begins a comment, `*` stands for any label, `!` makes an exception. Those of private registries only if asked for."""
    out, open_section = [], True
    for line in text.splitlines():
        if "===BEGIN PRIVATE" in line:
            open_section = private
        elif "===END PRIVATE" in line:
            open_section = True
        rule = line.strip().split(" ")[0]
        if open_section and rule and not rule.startswith("//"):
            out.append(rule)
    return tuple(out)


def suffix_rules(spark: SparkSession, path: str | None = None, private: bool = False) -> tuple[str, ...]:
    """The rules of the list at a path that Spark reads, or of the one on Spark's class path. A list has some ten thousand short lines."""
    if path is not None:
        return parse_rules("\n".join(r.value for r in spark.read.text(path).collect()), private)
    jvm = spark._jvm
    stream = jvm.java.lang.Thread.currentThread().getContextClassLoader().getResourceAsStream(LIST_ON_CLASSPATH)
    if stream is None:
        raise FileNotFoundError(f"{LIST_ON_CLASSPATH} isn't on Spark's class path: name a list by path")
    return parse_rules(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"), private)


def _ascii(label: str) -> str:
    try:
        return label if label.isascii() else label.encode("idna").decode()
    except UnicodeError:
        return label


class Suffixes:
    """A trie over the labels of rules from right to left. A node's entry "" says what ends there: a rule, or an exception from a wildcard."""

    def __init__(self, rules: Iterable[str] = ()) -> None:
        self.root: dict = {}
        for rule in rules:
            at = self.root
            for label in reversed(rule.lstrip("!").lower().split(".")):
                at = at.setdefault(_ascii(label), {})
            at[""] = rule.startswith("!")

    def length(self, labels: list[str]) -> int:
        """Labels of the public suffix: of the longest rule that matches, one less for an exception; the last label where none does."""
        best, at = 1, self.root
        for k, label in enumerate(reversed(labels), 1):
            if "" in at.get("*", ()):
                best = k
            at = at.get(label)
            if at is None:
                break
            if at.get(""):
                return k - 1
            if "" in at:
                best = k
        return best

    def registrable(self, host: str | None) -> str | None:
        """The public suffix of a host and the label before it; None for addresses, for suffixes themselves and for what is no host name."""
        name = (host or "").lower().removesuffix(".")
        labels = name.split(".")
        if not name or "" in labels or is_address(name):
            return None
        n = self.length([_ascii(x) for x in labels])
        return ".".join(labels[-n - 1 :]) if n < len(labels) else None

    def site(self, url: str) -> str:
        """What URLs of one site share: the registrable domain, or host and port where there is none."""
        try:
            parts = urlsplit(url)
            own = self.registrable(parts.hostname)
            return own or ":".join(str(x) for x in (parts.hostname, parts.port) if x)
        except ValueError:
            return ""


def is_address(host: str) -> bool:
    try:
        ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    return True


@lru_cache(maxsize=4)
def suffixes(rules: tuple[str, ...]) -> Suffixes:
    """One trie a worker."""
    return Suffixes(rules)


def registrable_domain(rules: tuple[str, ...]) -> Callable[[Column], Column]:
    """A function of a host column. Each batch walks the trie once for each of its distinct hosts, however often one recurs, and nothing is shuffled."""

    @F.arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = suffixes(rules)
        for hosts in batches:
            known = hosts.dictionary_encode()
            found = pa.array([trie.registrable(h) for h in known.dictionary.to_pylist()], pa.string())
            yield found.take(known.indices)

    return run


@dataclass(frozen=True)
class Scope:
    """What belongs to a crawl: a registrable domain, or a host and port where the seed has none, and alias hosts."""

    registrable_domain: str
    fallback_host: str | None
    host_aliases: tuple[str, ...]
    seed_origin: str
    seed_url: str


def derive_scope(start_url: str, rules: tuple[str, ...], host_aliases: Iterable[str] = ()) -> Scope:
    """The scope of a start URL; ValueError if that can't be crawled."""
    seed = urls.normalize(start_url)
    if seed is None:
        raise ValueError(f"no URL to start from: {start_url!r}")
    parts = urlsplit(seed)
    domain = suffixes(rules).registrable(parts.hostname) or ""
    where = parts.netloc.rpartition("@")[2]
    aliases = tuple(dict.fromkeys(a.strip().lower() for a in host_aliases if a.strip()))
    return Scope(domain, None if domain else where, aliases, f"{parts.scheme}://{where}", seed)


def _full_host(url: Column) -> Column:
    """Host with its brackets, if it is such an address."""
    six = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\])", 1)
    return F.when(six != "", F.lower(six)).otherwise(urls.host(url))


def _where(url: Column) -> Column:
    """Host and port, without a port that is the scheme's own."""
    net = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return F.when(urls.scheme(url) == "http", F.regexp_replace(net, r":80$", "")).when(urls.scheme(url) == "https", F.regexp_replace(net, r":443$", "")).otherwise(net)


def _bare(hosts: Iterable[str]) -> list[str]:
    return [h.removeprefix("www.") for h in hosts]


def in_scope(url: Column, scope: Scope, rules: tuple[str, ...]) -> Column:
    """Whether a normalised URL belongs to the site: the same registrable domain, the same host and port, or an alias with or without www; false for what is no URL."""
    host = _full_host(url)
    tests = [urls.strip_www(host).isin(_bare(scope.host_aliases))] if scope.host_aliases else []
    if scope.registrable_domain:
        tests.append(registrable_domain(rules)(host) == scope.registrable_domain)
    if scope.fallback_host is not None:
        tests.append(_where(url) == scope.fallback_host)
    return urls.is_url(url) & reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def same_site(one: Column, two: Column, rules: tuple[str, ...]) -> Column:
    """Whether two URLs are of one site, whatever sites a table holds: equal registrable domains, or equal hosts and ports where there are none. Null if either is no URL."""
    find = registrable_domain(rules)

    def key(url: Column) -> Column:
        return F.coalesce(find(_full_host(url)), _where(url))

    return F.when(urls.is_url(one) & urls.is_url(two), key(one) == key(two))


def typed_links(links: DataFrame, rules: tuple[str, ...], source: str = "source", target: str = "target_normalized") -> DataFrame:
    """links with type: internal if the target is of the source's site, else external."""
    return links.withColumn("type", F.when(F.coalesce(same_site(F.col(source), F.col(target), rules), F.lit(False)), "internal").otherwise("external"))
