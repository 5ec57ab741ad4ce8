"""URL identities as column expressions, and normalisation as one vectorised function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import parse_qsl, quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track.
TRACKING_PREFIXES = ("utm_",)
TRACKING_NAMES = frozenset({"gclid", "fbclid", "msclkid", "ref"})
#: URL caps of the crawl frontier.
MOST_URL_CHARS, MOST_PARAMETERS = 2000, 10

_SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
_PORTS = {"http": 80, "https": 443}


def _form(text: str) -> str:
    """application/x-www-form-urlencoded, as URL search parameters are written."""
    return quote(text, safe="*-._ ").replace(" ", "+").replace("~", "%7E")


def normalize(raw: str | None, base: str | None = None) -> str | None:
    """The identity of a URL: resolved, http(s) only, lower-case host, no default port, fragment, tracking parameter, repeated parameter or trailing slash; parameters sorted. None if it can't be crawled."""
    if raw is None or not raw.strip():
        return None
    text = re.sub(r"[\t\n\r]", "", raw.strip())
    try:
        if base:
            text = urljoin(base, text)
        elif not _SCHEME.match(text):
            return None
        parts = urlsplit(text.replace("\\", "/"))
        scheme, host, port = parts.scheme.lower(), parts.hostname, parts.port
        if scheme not in _PORTS or not host or re.search(r"[\s<>^|%]", host):
            return None
        host = host.encode("idna").decode() if not host.isascii() else host.lower()
    except (ValueError, UnicodeError):
        return None
    if ":" in host:
        host = f"[{host}]"
    kept = sorted({(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith(TRACKING_PREFIXES) and k.lower() not in TRACKING_NAMES}, key=lambda p: (p[0].encode("utf-16-be", "surrogatepass"), p[1].encode("utf-16-be", "surrogatepass")))
    segments: list[str] = []
    for s in parts.path.split("/")[1:]:
        if s in ("..", "%2e%2e", ".%2e", "%2e."):
            segments = segments[:-1]
        elif s not in (".", "%2e"):
            segments.append(s)
    ends = parts.path.rpartition("/")[2] in ("..", ".")
    path = quote("/" + "/".join(segments) + ("/" if ends and segments else ""), safe="/%:@!$&'()*+,;=-._~[]|^")
    if len(path) > 1 and path.endswith("/"):
        path = path[:-1]
    login = (parts.username or "") + (f":{parts.password}" if parts.password else "")
    where = (f"{login}@" if login else "") + host + (f":{port}" if port and port != _PORTS[scheme] else "")
    return urlunsplit((scheme, where, path, "&".join(f"{_form(k)}={_form(v)}" for k, v in kept), ""))


@lru_cache(maxsize=1 << 16)
def remembered(raw: str | None) -> str | None:
    """normalize() of what a worker has seen of late: links and resources recur on many pages."""
    return normalize(raw)


@F.pandas_udf(StringType())
def normalize_url(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for urls in batches:
        yield pd.Series([remembered(u) for u in urls], dtype=object)


@F.pandas_udf(StringType())
def resolve_url(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A reference resolved against a base and normalised."""
    for refs, bases in batches:
        yield pd.Series([normalize(r, b) for r, b in zip(refs, bases, strict=True)], dtype=object)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def path(url: Column) -> Column:
    """The raw path, `/` if empty."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(raw == "", F.lit("/")).otherwise(raw)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"), F.lit(False))


def pathname(url: Column) -> Column:
    """Path without a trailing slash, except for the root; null for what is no URL."""
    return F.when(is_url(url), F.regexp_replace(path(url), r"^(.+)/$", "$1"))


def path_and_query(url: Column) -> Column:
    q = query(url)
    return F.when(is_url(url), F.concat(pathname(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))


def section(url: Column, root: str = "(root)") -> Column:
    """The first segment of the path."""
    first = F.regexp_extract(path(url), r"^/([^/]+)", 1)
    return F.when(first == "", F.lit(root)).otherwise(F.concat(F.lit("/"), first))


def strip_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def origin(url: Column) -> Column:
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]+(:\d+)", 1)
    own = F.when((scheme(url) == "http") & (port == ":80") | (scheme(url) == "https") & (port == ":443"), F.lit("")).otherwise(port)
    return F.when(is_url(url), F.concat(scheme(url), F.lit("://"), host(url), own))


def same_key(url: Column) -> Column:
    """Host without www, path without a trailing slash, and query: scheme and port don't count."""
    q = query(url)
    return F.concat(strip_www(host(url)), F.regexp_replace(path(url), r"/$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def variant_key(url: Column) -> Column:
    """What URL variants of a page share: lower-case host and path, without index file and trailing slash, and the query."""
    q = query(url)
    own = F.regexp_replace(F.regexp_replace(F.lower(path(url)), r"/index\.html?$", "/"), r"/$", "")
    return F.concat(host(url), own, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def page_id(normalized_url: Column) -> Column:
    return F.substring(F.sha2(normalized_url, 256), 1, 12)


def exceeds_caps(url: Column) -> Column:
    q = query(url)
    return (F.length(url) > MOST_URL_CHARS) | (F.when(q == "", F.lit(0)).otherwise(F.size(F.split(q, "&"))) > MOST_PARAMETERS)


#: Words of a path that log out or destroy.
UNSAFE_WORDS = ("logout", "log-out", "signout", "sign-out", "delete", "remove", "destroy", "unsubscribe", "cancel", "deactivate")


def is_unsafe(url: Column, exclude: tuple[str, ...] = ()) -> Column:
    """Whether a crawl should leave this URL alone: an excluded substring, or an unsafe word between word boundaries."""
    text = F.lower(F.concat(path(url), F.lit("?"), query(url)))
    out = text.rlike(r"(?:^|[^a-z])(?:" + "|".join(UNSAFE_WORDS) + r")(?:$|[^a-z])")
    for part in exclude:
        out = out | F.contains(url, F.lit(part))
    return out


def remap_alias(url: Column, aliases: tuple[str, ...], seed_origin: str) -> Column:
    """URLs of an alias host on the seed's origin."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    return F.when(strip_www(host(url)).isin([re.sub(r"^www\.", "", a.lower()) for a in aliases]), F.concat(F.lit(seed_origin.rstrip("/")), rest)).otherwise(url)


def file_format(url: Column) -> Column:
    """Lower-case extension of the last path segment, null if none."""
    ext = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(ext != "", ext)
