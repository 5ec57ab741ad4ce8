"""Licence scan by ordered signature rules.

A text becomes its lower-case words joined by single spaces. Rules (license_rules) whose keyword occurs are matched; their
detections, intervals of words, are taken by priority, then length, then place, and a detection that lies inside one already
taken is suppressed. Three base phrases are counted beside, at every place.

Defined results: null and empty texts have no words, no places, null first and last word, empty labels and score 0; ties of
priority go to the longer, then the earlier, then the first label by name; repeated labels appear once; columns of the caller
with the names of the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re._parser import parse
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sitequarry.llm.license_rules import RULES

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: A-Z to a-z; every ASCII byte but letters and digits parts words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Rule(NamedTuple):
    """A signature: priority, label, pattern over whole words with the space before them, and the most bytes that a match spans."""

    priority: int
    label: str
    pattern: re.Pattern[bytes]
    reach: int


@lru_cache(maxsize=1)
def rules() -> dict[bytes, list[Rule]]:
    """By keyword, which every match of the pattern holds."""
    out: dict[bytes, list[Rule]] = {}
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = line.split("|", 3)
        own = re.compile(rb" (?:" + pattern.encode() + rb")(?= )")
        out.setdefault(keyword.encode(), []).append(Rule(int(priority), label, own, parse(own.pattern).getwidth()[1] + 1))
    return out


def words_of(text: str | None) -> bytes:
    """The words with a space before and after each."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []
    return b" " + b" ".join(words) + b" " if words else b" "


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which phrase starts, overlapping places included."""
    out, at, seen, word = [], line.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = line.find(b" " + phrase + b" ", at + 1)
    return out


def _found(line: bytes) -> set[tuple[int, int, int, str]]:
    """All detections (start, end, priority, label): each rule is tried on the stretches around its keyword only."""
    out = set()
    for keyword, own in rules().items():
        at = line.find(keyword)
        if at < 0:
            continue
        reach = max(r.reach for r in own)
        stretches: list[list[int]] = []
        while at >= 0:
            low, high = max(0, at - reach), at + len(keyword) + reach
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = high
            else:
                stretches.append([low, high])
            at = line.find(keyword, at + 1)
        if 4 * sum(high - low for low, high in stretches) > len(line):
            stretches = [[0, len(line)]]
        for priority, label, pattern, _ in own:
            for low, high in stretches:
                for m in pattern.finditer(line, low, high):
                    out.add((m.start() + 1, m.end(), priority, label))
    return out


def suppress(found: set[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections by priority, then length, then place, then label, without those that lie inside one taken before. A tree over the starts holds the furthest end of what is taken, so each test takes a logarithm of their number."""
    starts = sorted({d[0] for d in found})
    place = {x: i + 1 for i, x in enumerate(starts)}
    furthest = [0] * (len(starts) + 1)
    kept = []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        start, end = d[0], d[1]
        k = place[start]
        inside = False
        while k and not inside:
            inside = furthest[k] >= end
            k &= k - 1
        if inside:
            continue
        kept.append(d)
        k = place[start]
        while k < len(furthest):
            furthest[k] = max(furthest[k], end)
            k += k & -k
    return kept


def detections(line: bytes) -> list[tuple[int, int, int, str]]:
    """Kept detections (first word, last word, priority, label), in order of place."""
    kept = suppress(_found(line))
    out, seen, word = {}, 0, 0
    for at in sorted({p for a, b, _, _ in kept for p in (a, b)}):
        word += line.count(b" ", seen, at)
        seen = at
        out[at] = word - 1
    return sorted((out[a], out[b], p, label) for a, b, p, label in kept)


def scan(text: str | None) -> tuple:
    line = words_of(text)
    base = {label: p for phrase, label in BASE.items() if (p := places(line, phrase.encode()))}
    every = [w for p in base.values() for w in p]
    found = detections(line)
    miss = 1.0
    for _, _, priority, _ in found:
        miss *= 1 - priority / 100
    labels = sorted({*base, *(d[3] for d in found)})
    return (line.count(b" ") - 1, len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(labels), 1 - miss, [{"label": d[3], "first_word": d[0], "last_word": d[1], "priority": d[2]} for d in found])


SCHEMA = "struct<n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label string, first_word long, last_word long, priority int>>>"


def license_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections."""

    @pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([scan(t) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    out = docs.withColumn("_scan", run(F.col(text_col)))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    return out.withColumns({c: F.col(f"_scan.{c}") for c in names}).drop("_scan")


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return license_scan(docs.select("doc_id", "text")).drop("text", "detections")
