"""The Merkle manifest against trees built level by level."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sitequarry.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        run = at - at % 3
        out.append((at - run, [d for k, d in enumerate(level[run : run + 3], run) if k != at]))
        at //= 3
    return out


def leaf(row, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text))


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in groups[s]), key=lambda x: x[:3])
        trees[s] = [x[3] for x in own], levels([x[2] for x in own])
    top = levels([trees[s][1][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        own, tree = trees[s]
        for at, r in enumerate(own):
            path = siblings(tree, at) + siblings(top, k)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for place, others in path:
                folded = h([*others[:place], folded, *others[place:]])
            out.append((r[0], tree[0][at], tree[-1][0], top[-1][0], h(x for _, others in path for x in others), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 82, 200])
@pytest.mark.parametrize("band", [1, 2, 3])
def test_traversal_gives_the_paths_of_the_whole_tree(n, band):
    leaves = [h([str(k)]) for k in range(n)]
    tree = levels(leaves)
    height = manifest.height_of(n)
    assert height == len(tree) - 1
    assert [list(p) for p in manifest.traverse(leaves, height, band)] == [siblings(tree, k) for k in range(n)]
    assert manifest.block_root(leaves, height) == tree[-1][0]


def test_traversal_holds_two_subtrees_a_band(monkeypatch):
    """The nodes held grow with the bands, not with the leaves."""
    made = []

    class Counted(manifest.Growing):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(manifest, "Growing", Counted)
    leaves = [str(k) for k in range(3**7)]
    for _ in manifest.traverse(leaves, 7, 2):
        pass
    assert max(len(g.nodes) for g in made) <= 4 * (9 + 3)


def test_short_last_block_rises_with_the_others():
    leaves = [h([str(k)]) for k in range(4)]
    paths = list(map(list, manifest.traverse(leaves, 3)))
    assert [len(p) for p in paths] == [3] * 4
    root = manifest.block_root(leaves, 3)
    assert root == h([h([h(leaves[:3]), h(leaves[3:])])])
    assert all(manifest.fold(x, p) == root for x, p in zip(leaves, paths, strict=True))


def _rows(seed, n):
    rng = random.Random(seed)
    text = ["", None, "a\nb", "no breaks", "\n", "é\n\n", "x" * 3000 + "\n"]
    rows = [(rng.choice([None, k, k, k]), rng.choice(text), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "s1", "s2", None, "", "é"]), rng.choice([None, k])) for k in range(n)]
    return rows + rows[:20]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_op11_against_brute_force(spark, height):
    """Blocks of 3, 9 and 2187 leaves: forests of several stages and of one; null and repeated ids, null sources, repeated rows, extra columns."""
    rows = _rows(height, 150)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"leaf": F.lit("clash"), "pos": F.lit(1), "key": F.lit(2), "root": F.lit(3), "block": F.lit(0)})
    got = sorted((tuple(r) for r in manifest.op11(docs, height).collect()), key=repr)
    assert got == expected(rows)


def test_empty_and_single(spark):
    assert manifest.op11(spark.createDataFrame([], SCHEMA)).collect() == []
    row = (7, "a\nb", "en", "s", 3)
    (only,) = manifest.op11(spark.createDataFrame([row], SCHEMA)).collect()
    assert tuple(only) == expected([row])[0]
    assert only.subroot == only.root == only.leaf and only.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_manifest_verifies_itself_and_tells_changes(spark):
    rows = _rows(5, 60)
    done = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).withColumn("ok", manifest.verify(F.col("leaf"), F.col("path"), F.col("root"))).withColumn("bad", manifest.verify(F.sha2("leaf", 256), F.col("path"), F.col("root")))
    assert {(r.ok, r.bad) for r in done.collect()} == {(True, False)}
