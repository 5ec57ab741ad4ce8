"""Merkle manifest of a dataset: authentication paths by fractal traversal of aligned blocks, upper paths appended.

Nodes have up to three children. Leaves are numbered inside their group by a range partitioning and counts of its runs, so no
group is held by one task. Aligned blocks of 3^HEIGHT leaves are traversed by a task each: the levels of a block are banded, and
each band keeps the existing subtree (around the present leaf) and the desired one, its right neighbour, which grows by one leaf
a step and is complete when the traversal enters it. Successive paths need no other node. The blocks' roots are the leaves of the
next forest, until each group has one node; paths above a block are found first and appended while the block is traversed. The
groups' roots, in order of their sources, are the leaves of one more forest.

Defined results: a null field is `-`; null ids come first, rows of equal id in the order of their leaves; equal rows have equal
leaves, and a leaf and a path each; a null source is a group of its own, the first; a null id is never tampered with; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.common import cut

ARITY = 3
#: Levels of a block, and of a band in it.
HEIGHT, BAND = 7, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The step of a path at one level: the place among its run, and the run's others from left to right.
Path = list[tuple[int, list[str]]]
_PATH = "array<struct<place: int, others: array<string>>>"
_PATH_ARROW = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))


def node(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def fold(digest: str, path: Path) -> str:
    """The root that a digest and its path give."""
    for place, others in path:
        digest = node([*others[:place], digest, *others[place:]])
    return digest


def height_of(n: int) -> int:
    """Levels from n leaves to one node."""
    height = 0
    while ARITY**height < n:
        height += 1
    return height


class Growing:
    """A subtree that takes its leaves in order and holds one unfinished run a level; keeps the nodes that `keeps(level, index)` asks for."""

    def __init__(self, n: int, height: int, first: int, keeps: Callable[[int, int], bool]) -> None:
        self.leaf, self.widths, self.keeps = first, [-(-n // ARITY**k) for k in range(height)], keeps
        self.runs: list[list[str]] = [[] for _ in range(height)]
        self.index = [first // ARITY**k for k in range(height)]
        self.nodes: dict[tuple[int, int], str] = {}
        self.root: str | None = None

    def push(self, digest: str) -> None:
        self.leaf += 1
        for level, run in enumerate(self.runs):
            at = self.index[level]
            self.index[level] = at + 1
            if self.keeps(level, at):
                self.nodes[level, at] = digest
            run.append(digest)
            if len(run) < ARITY and at + 1 < self.widths[level]:
                return
            digest = node(run)
            run.clear()
        self.root = digest


def block_root(leaves: Sequence[str], height: int) -> str:
    tree = Growing(len(leaves), height, 0, lambda *_: False)
    for leaf in leaves:
        tree.push(leaf)
    return tree.root


def traverse(leaves: Sequence[str], height: int, band: int = BAND) -> Iterator[Path]:
    """The path of each leaf in turn, from the leaves up to `height`; the list is reused, so take what you need of it before the next.

    Beside the leaves it holds two subtrees of `band` levels for each band.
    """
    n = len(leaves)
    bands = [(low, min(low + band, height)) for low in range(0, height, band)]
    top = {level: high for low, high in bands for level in range(low, high)}
    start = Growing(n, height, 0, lambda level, at: at < ARITY ** (top[level] - level))
    for leaf in leaves:
        start.push(leaf)

    def next_to(high: int, low: int, first: int) -> Growing | None:
        return Growing(n, high, first, lambda level, _: level >= low) if first < n else None

    existing = [{k: v for k, v in start.nodes.items() if low <= k[0] < high} for low, high in bands]
    desired = [next_to(high, low, ARITY**high) for low, high in bands]
    widths, path = start.widths, [(0, [])] * height
    for t in range(n):
        for (low, high), nodes in zip(bands, existing, strict=True):
            for level in range(low, high):
                if t % ARITY**level:
                    break
                at = t // ARITY**level
                run = at - at % ARITY
                path[level] = (at - run, [nodes[level, k] for k in range(run, min(run + ARITY, widths[level])) if k != at])
            if t % ARITY**high:
                break
        yield path
        for k, (low, high) in enumerate(bands):
            grows = desired[k]
            if grows is None:
                continue
            if grows.leaf < n and grows.root is None:
                grows.push(leaves[grows.leaf])
            if (t + 1) % ARITY**high == 0:
                existing[k], desired[k] = grows.nodes, next_to(high, low, t + 1 + ARITY**high)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, the place in the group from 0, and n, the rows of the group.

    The rows are range-partitioned over the whole order and counted by run (a group in a partition): a group may span
    partitions, and a run's offset comes from the counts of the group's earlier runs.
    """
    laid = cut(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")))
    runs = laid.groupBy(group, "part").agg(F.count(F.lit(1)).alias("m"), F.min("seq").alias("first"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("m").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("m").over(own).alias("n"))
    return laid.join(runs, [group, "part"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _in_order(table: pa.Table, most: int) -> tuple[pa.Table, int]:
    """A block's rows by place, and its height: `most`, or less where it is its group's only block."""
    table = table.sort_by("pos")
    n = table["n"][0].as_py()
    return table, most if n > ARITY**most else height_of(n)


def _roots(most: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table, height = _in_order(table, most)
        n = pa.array([-(-table["n"][0].as_py() // ARITY**most)], pa.int64())
        return pa.table({"key": table["key"][:1], "pos": table["block"][:1], "n": n, "digest": [block_root(table["digest"].to_pylist(), height)]})

    return run


def _proving(finish: Callable[[dict, Path, Path, dict], tuple], fields: list[tuple[str, pa.DataType]], columns: list[str], most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function of a block's leaves and the row above it: finish(row, path in the block, path above, row above) gives the values of fields."""

    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        leaves, height = _in_order(leaves, most)
        top = above.to_pylist()[0]
        upper = [(s["place"], s["others"]) for s in top["path"]]
        rows = zip(*(leaves[c].to_pylist() for c in columns), strict=True)
        digests = leaves["digest"].to_pylist()
        made = [finish(dict(zip(columns, row, strict=True)), path, upper, top) for row, path in zip(rows, traverse(digests, height), strict=True)]
        return pa.table({name: pa.array([m[k] for m in made], kind) for k, (name, kind) in enumerate(fields)})

    return run


def _path_values(row: dict, path: Path, upper: Path, top: dict) -> tuple:
    steps = [{"place": p, "others": o} for p, o in (*path, *upper)]
    return row["key"], row["pos"], steps, top["root"]


def _blocked(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {ARITY**most}"))


def above_blocks(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Of nodes (key, pos, n, digest) per block: key, block, the path from the block's root to the group's root, and that root."""
    roots = cut(_blocked(nodes, height).groupBy("key", "block").applyInArrow(_roots(height), "key string, pos long, n long, digest string"))
    most = roots.agg(F.max("n")).first()[0] or 0  # one number
    if most <= 1:
        return roots.select("key", F.col("pos").alias("block"), F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    return paths(roots, height).withColumnRenamed("pos", "block")


def paths(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Of nodes (key, pos, n, digest) per node: key, pos, path to its group's root, root."""
    fields = [("key", pa.string()), ("pos", pa.int64()), ("path", _PATH_ARROW), ("root", pa.string())]
    run = _proving(_path_values, fields, ["key", "pos"], height)
    left, right = _blocked(nodes, height).select("key", "block", "pos", "n", "digest").groupBy("key", "block"), above_blocks(nodes, height).groupBy("key", "block")
    return left.cogroup(right).applyInArrow(run, f"key string, pos long, path {_PATH}, root string")


def leaf_of(text: Column) -> Column:
    """The leaf of a row of documents, with this text."""
    values = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values)), 256)


def _tampered() -> Column:
    """Where 2 divides the id's checksum: the text without its line feeds."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even & F.col("text").contains("\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def _leaves(docs: DataFrame, tampered: Column, height: int) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves (key, doc_id, digest, tampered, pos, n), and the rows above their blocks (key, block, path to the dataset's root, subroot, root)."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key")
    rows = cut(docs.select(key, F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("digest"), F.when(tampered.isNotNull(), leaf_of(tampered)).alias("tampered"), F.monotonically_increasing_id().alias("tie")))
    leaves = numbered(rows, "key", ["doc_id", "digest", "tie"]).drop("tie")
    blocks = cut(above_blocks(leaves, height))
    sources = blocks.groupBy("key").agg(F.min("root").alias("digest")).withColumn("all", F.lit(""))
    placed = cut(numbered(sources, "all", ["key"]).withColumnRenamed("key", "source_key").withColumnRenamed("all", "key"))
    tops = paths(placed, height).join(placed.select("pos", F.col("source_key")), "pos").select(F.col("source_key").alias("key"), F.col("path").alias("source_path"), F.col("root").alias("top"))
    above = blocks.join(tops, "key").select("key", "block", F.concat("path", "source_path").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    return leaves, above


def _whole(row: dict, path: Path, upper: Path, top: dict) -> tuple:
    return (row["doc_id"], row["digest"], top["subroot"], top["root"], [{"place": p, "others": o} for p, o in (*path, *upper)])


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row: doc_id, leaf, subroot (of its source), root, and path, whose steps verify() folds."""
    leaves, above = _leaves(docs, F.lit(None).cast("string"), height)
    fields = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("path", _PATH_ARROW)]
    run = _proving(_whole, fields, ["doc_id", "digest"], height)
    left = _blocked(leaves, height).groupBy("key", "block")
    return left.cogroup(above.groupBy("key", "block")).applyInArrow(run, f"doc_id long, leaf string, subroot string, root string, path {_PATH}")


def verify(leaf: Column, path: Column, root: Column) -> Column:
    """Whether a leaf folds to the root along a path."""
    one = lambda acc, s: F.sha2(F.concat(F.concat_ws("", F.slice(s["others"], F.lit(1), s["place"])), acc, F.concat_ws("", F.slice(s["others"], s["place"] + 1, F.lit(ARITY)))), 256)
    return F.aggregate(path, leaf, one) == root


def _digest(row: dict, path: Path, upper: Path, top: dict) -> tuple:
    whole = [*path, *upper]
    proof = hashlib.sha256("".join("".join(others) for _, others in whole).encode()).hexdigest()
    folded = fold(row["tampered"] or row["digest"], whole)
    return row["doc_id"], row["digest"], top["subroot"], top["root"], proof, folded, folded == top["root"]


def op11(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves, above = _leaves(docs, _tampered(), height)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    fields = [(n, pa.int64() if n == "doc_id" else pa.string()) for n in names] + [("verified", pa.bool_())]
    run = _proving(_digest, fields, ["doc_id", "digest", "tampered"], height)
    left = _blocked(leaves, height).groupBy("key", "block")
    return left.cogroup(above.groupBy("key", "block")).applyInArrow(run, "doc_id long, " + ", ".join(f"{n} string" for n in names[1:]) + ", verified boolean")
