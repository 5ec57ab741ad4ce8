"""Infill cuts against tokens taken one by one; rank and select against counting."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitequarry.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    digest = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 1.0])
def test_rank_and_select(n, share):
    bits = np.random.default_rng(n).random(n) < share
    own = infill.Bits(bits)
    places = np.flatnonzero(bits)
    assert own.total == len(places)
    assert own.rank(np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    assert own.select(np.arange(len(places))).tolist() == places.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab \t\n\v\f\r\x85\xa0é漢😀<P>", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=6))
def test_cuts(rows):
    blobs = [t.encode() for t, _, _ in rows]
    ends = np.cumsum([len(b) for b in blobs]).astype(np.int64)
    starts = ends - np.array([len(b) for b in blobs], np.int64)
    one, two = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    n, p, m = infill.cuts(np.frombuffer(b"".join(blobs), np.uint8), starts, ends, one, two)
    for k, (text, x, y) in enumerate(rows):
        units = TOKEN.findall(text)
        a, b = sorted((x % (len(units) + 1), y % (len(units) + 1)))
        assert (n[k], p[k], m[k]) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))


def test_op13_against_tokens(spark):
    """Null and repeated ids, null, empty, blank and very long texts, markers, other white space, clashing columns; bit vectors over many short stretches."""
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(["wort ", "é漢 ", "\n\n", "\t", "<", "P>", " ", "\x85", "　x", "😀"]) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(None, "a b c"), (None, None), (7, None), (8, ""), (9, "  \n "), (10, "x <P> y"), (11, "x<S>"), (12, "<M>"), (13, "long " * 60_000), (14, "z" * 200_000), (14, "z" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "infill": F.lit(1), "form": F.lit(0), "_cut": F.lit(1)})
    want = sorted((expected(*r) for r in rows), key=repr)
    assert sorted((tuple(r) for r in infill.op13(docs).collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_transform_keeps_columns_and_restores(spark):
    docs = spark.createDataFrame([(k, f"some words  of text {k}\n", k) for k in range(50)], "doc_id long, text string, other int")
    done = infill.transform(docs, seed=1, rate=100).withColumn("back", infill.restore(F.col("infill.output"), F.col("infill.form")))
    rows = done.collect()
    assert done.columns == ["doc_id", "text", "other", "infill", "back"]
    assert all(r.back == r.text for r in rows) and all(r.infill.form in ("psm", "spm") for r in rows)


def test_empty_table(spark):
    assert infill.op13(spark.createDataFrame([], "doc_id long, text string")).collect() == []
