"""The licence scan: rules against a plain scan, gates against every string of a pattern, base columns against SQL, long texts and ties."""

from __future__ import annotations

import itertools
import random
import re
import time
from re import _constants as k
from re._parser import parse

import duckdb
import pytest

from sitequarry.llm import licenses, queries
from sitequarry.llm.license_rules import RULES

LINES = (
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "Licensed under CC BY-NC-SA 4.0", "GNU General Public License, version 3 or any later version",
    "GNU Lesser General Public License v2.1", "open rail m license", "two clause license", "altered source versions must be plainly marked as such", "some other text between", "BSD 3 clause", "cc by cc by",
)


def plain(line):
    """Every rule over the whole line, and suppression by the definition."""
    found = set()
    for rule in RULES.strip().splitlines():
        label, priority, _, pattern = rule.split("|", 3)
        for m in re.finditer(rb" (?:" + pattern.encode() + rb")(?= )", line):
            found.add((m.start() + 1, m.end(), int(priority), label))
    kept = []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        if not any(a <= d[0] and d[1] <= b for a, b, _, _ in kept):
            kept.append(d)
    return sorted((line.count(b" ", 0, a) - 1, line.count(b" ", 0, b) - 1, p, label) for a, b, p, label in kept)


@pytest.mark.parametrize("seed", range(4))
def test_detections_equal_the_plain_scan(seed):
    rng = random.Random(seed)
    for n in (0, 1, 3, 40):
        line = licenses.words_of(" ".join(rng.choice(LINES) for _ in range(n)) + " word" * rng.choice([0, 2000]))
        assert licenses.detections(line) == plain(line)


def test_ties_go_to_the_longer_the_earlier_the_first_label():
    assert sorted(licenses.suppress({(0, 9, 50, "b"), (0, 9, 50, "a"), (2, 9, 50, "c"), (2, 12, 50, "d"), (0, 4, 90, "e")})) == [(0, 4, 90, "e"), (0, 9, 50, "a"), (2, 12, 50, "d")]


def strings(tree, most=400):
    """The strings of a parsed pattern, repeats taken least and most often, wild cards as one sign."""
    out = [""]
    for op, arg in tree:
        if op is k.LITERAL:
            own = [chr(arg)]
        elif op is k.IN:
            own = [chr(x) for o, x in arg if o is k.LITERAL] or ["0"]
        elif op in (k.MAX_REPEAT, k.MIN_REPEAT):
            low, high, inner = arg
            own = [s * n for s in strings(inner) for n in {low, min(high, low + 1)}]
        elif op is k.SUBPATTERN:
            own = strings(arg[3])
        elif op is k.BRANCH:
            own = [s for branch in arg[1] for s in strings(branch)]
        else:
            own = ["~"]
        out = [a + b for a, b in itertools.islice(itertools.product(out, own), 20_000)]
    return out


def test_every_string_of_a_pattern_holds_its_keyword():
    for rule in RULES.strip().splitlines():
        label, _, keyword, pattern = rule.split("|", 3)
        assert all(keyword in s for s in strings(parse(pattern))), (label, keyword, pattern)


def test_long_texts_take_time_in_proportion():
    rng = random.Random(1)
    text = "\n".join(rng.choice(LINES) for _ in range(40_000))
    began = time.perf_counter()
    row = licenses.scan(text)
    assert time.perf_counter() - began < 10 and row[0] > 150_000


def test_base_columns_equal_sql(spark):
    rng = random.Random(7)
    signs = [" ", ", ", "-", "\n", "\x7f", "é", "İ"]
    texts = [None, "", "é", *["".join(rng.choice([*"cc by all rights reserved general public license CC All x".split(), *signs]) + rng.choice(signs) for _ in range(30)) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.op2(df).collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert got == sorted(con.execute(queries.BASE_LICENSE_SQL).fetchall())
