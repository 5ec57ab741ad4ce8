"""Packing against the library's ids, and levels against the definition of the sum of squares."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitequarry.llm import packing
from sitequarry.llm.queries import token_file


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_file())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_level_is_the_least_sum_of_squares():
    rng = random.Random(1)
    packer = packing.Packer(window=12)
    for k in range(400):
        size = rng.choice([1, 2, 3, 5, 7, 11])
        before = Counter({g: int(c) for g, c in enumerate(packer.count) if c})

        def cost(g, before=before, size=size):
            after = Counter(before)
            if g:
                after[g] -= 1
            if g + size < 12:
                after[g + size] += 1
            return sum(c * c for c in after.values())

        open_levels = [0, *(g for g in before if g + size <= 12)]
        best = min(cost(g) for g in open_levels)
        assert packer.level(size) == max(g for g in open_levels if cost(g) == best)
        list(packer.add(k, 0, b"\1\0\0\0" * size, size))
        assert packer.n_open == sum(before.values()) + (packer.n_open - sum(before.values())) == int(packer.count.sum())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 20))
def test_every_id_once_and_one_open_window(sizes, most_open):
    packer = packing.Packer(window=16, most_open=most_open)
    full = []
    for k, size in enumerate(sizes):
        full += packer.add(k, 0, np.arange(size, dtype="<u4").tobytes(), size)
        assert packer.n_open <= most_open
    full += packer.pour()
    rest = packer.rest()
    assert all(sum(len(p[2]) for p in w) == 4 * 16 for w in full)
    assert packer.n_open == (rest is not None) and (rest is None or sum(len(p[2]) for p in rest) < 4 * 16)
    parts = defaultdict(list)
    for doc, start, ids, _ in [p for w in [*full, *([rest] if rest else [])] for p in w]:
        parts[doc].append((start, np.frombuffer(ids, "<u4").tolist()))
    for k, size in enumerate(sizes):
        assert [i for _, ids in sorted(parts[k]) for i in ids] == list(range(size))


LIBRARY = Tokenizer.from_file(token_file())


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab1.,'s \n\t\r\x1c\x85\xa0\u3000é漢😀<|endoftext|>", max_size=60)))
def test_ids_are_the_library_s(text):
    own = packing.encoding(token_file())
    for t in (text, " " + text, text + "<|endoftext|> " + text):
        assert np.frombuffer(packing.ids_of(own, t), "<u4").tolist() == ids_of(LIBRARY, t)


@pytest.mark.parametrize("text", [" " * 300_000, "z" * 200_000, "\n \t" * 50_000, "é" * 100_000, "1234567890" * 20_000, "!?" * 50_000])
def test_ids_of_long_runs(text):
    assert np.frombuffer(packing.ids_of(packing.encoding(token_file()), text), "<u4").tolist() == ids_of(LIBRARY, text)


def test_other_tokenizers_are_refused(tmp_path):
    import json

    spec = json.loads(open(token_file(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            packing.encoding.__wrapped__(str(tmp_path / "t.json"))


def _check(rows, pieces, library, window=2048):
    want = Counter((d, tuple(ids_of(library, t))) for d, t in rows)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.concatenate([[0], np.cumsum([p.length for p in own])])[:-1].tolist()
        assert sum(p.length for p in own) <= window and all(p.length > 0 for p in own)
    by_id = {d: ids for d, ids in want}
    if len(by_id) == sum(want.values()):
        at = Counter()
        for p in sorted(pieces, key=lambda p: p.start):
            ids = by_id[p.doc_id]
            assert p.start == at[p.doc_id] and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
            at[p.doc_id] += p.length
        assert all(at[d] == len(ids) for d, ids in by_id.items())
    assert sum(p.length for p in pieces) == sum(n * len(ids) for (_, ids), n in want.items())
    return by_sequence


def test_op12_on_a_table(spark, library, sf_dir="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for table in (docs, docs.repartition(7)):
        pieces = packing.op12(table, token_file()).collect()
        sequences = _check(rows, pieces, library)
        assert sum(sum(p.length for p in s) < 2048 for s in sequences.values()) <= 1


def test_op12_odd_rows(spark, library):
    """Null, empty and very long texts, special strings, repeated rows and ids, null ids, clashing columns, an empty table."""
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "<|endoftext|> and <|endoftext|>"), (5, "z" * 50_000), (6, " \n "), (7, "tie"), (8, "tie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "last": F.lit(True), "offset": F.lit(2)})
    _check(rows, packing.op12(docs, token_file()).collect(), library)
    again = [(None, "a b"), (None, "a b"), (7, "x"), (7, "y")]
    _check(again, packing.op12(spark.createDataFrame(again, "doc_id long, text string"), token_file()).collect(), library)
    empty = packing.op12(spark.createDataFrame([], "doc_id long, text string"), token_file())
    assert empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and empty.collect() == []


def test_sequences(spark, library):
    rows = [(k, "some text " * k) for k in range(1, 60)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), token_file(), window=64)
    got = packing.sequences(pieces, window=64, pad_id=9).collect()
    ids = Counter(i for _, t in rows for i in ids_of(library, t))
    assert Counter(i for r in got for i in r.ids[: r.length]) == ids
    assert all(len(r.ids) == (r.length if r.length & (r.length - 1) == 0 else 64) and set(r.ids[r.length :]) <= {9} for r in got)
