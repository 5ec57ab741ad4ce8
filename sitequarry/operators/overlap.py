"""All pairs of sets by exact Jaccard similarity: a prefix filter finds groups that hold them, and whole sets are compared inside groups only.

Sets are 64-bit hashes of their members and are made in Python, where they are needed; what is shuffled of every row are its
prefix (of threshold 0.8 a fifth of its set) and its parities, one or two bits a member. Values are put in one order, those
frequent in a bounded sample last (the order decides the cost only); two sets this similar share one of their first
n - ceil(threshold * n) + 1. A pair that shares such a value may be similar only if its sizes and its parities allow it, and
such pairs are needed only to join rows into groups, so no table of them is made: a value's rows are first held against the
least of them, which is one row each, and only of values whose rows are still in several groups all pairs are compared, in
blocks, where each pair of blocks gives no more links than join its groups. Every similar pair is then inside one group. The
sets of a group are made again from their source and compared in blocks, whatever the size of the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.operators.graph import components
from sitequarry.plans.lineage import cut, drop_cut, spread

#: Sampled rows for the order, frequent values kept of them.
SAMPLE, FREQUENT = 4_000, 100_000
#: Rows of a value up to which its pairs are made by a join; rows of a block, and members of the sets of a block.
FEW, ROWS, MEMBERS = 8, 1_024, 1 << 18
#: Words whose hashes a process keeps; rows whose sets it holds; bytes of parities compared at once.
KNOWN, SLICE, AT_ONCE = 1 << 17, 256, 1 << 22
#: Bits of a filter for each key in it, the least and the most bits of one (16 MB), bits of one row of it.
EACH, LEAST_BITS, MOST_BITS, CHUNK = 8, 1 << 20, 1 << 27, 1 << 15

#: Makes, in a task, the function from a row's source to its set: sorted distinct uint64.
SetsOf = Callable[[], Callable[[object], np.ndarray]]


class _Words(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def hashed_shingles(size: int) -> SetsOf:
    """Of lists of texts, words apart by white space: the union of their word n-grams."""
    factors = np.random.default_rng(size).integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)

    def make():
        known = _Words()

        def grams(text: str) -> np.ndarray:
            words = text.encode("utf-8", "surrogatepass").split()
            n = len(words) - size + 1
            if n < 1:
                return np.zeros(0, np.uint64)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            out = np.zeros(n, np.uint64)
            for k in range(size):
                out += h[k : k + n] * factors[k]
            # one to one: spreads the values evenly
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
            return out

        return lambda texts: np.unique(np.concatenate([grams(t) for t in texts])) if len(texts) else np.zeros(0, np.uint64)

    return make


def hashed_values() -> Callable[[object], np.ndarray]:
    """Of lists of 64-bit hashes: their set."""
    return lambda x: np.unique(np.asarray(x, np.int64).view(np.uint64))


def needed(n: int, threshold: float) -> int:
    """ceil(threshold * n), safe from rounding."""
    return int(np.ceil(n * threshold - 1e-9))


def parities(x: np.ndarray) -> bytes:
    """For each of m places, m the first power of two that is not less than the set (64 at least), whether an odd number of the set's values falls there. Two sets differ in at least as many values as their parities in places."""
    m = max(64, 1 << (len(x) - 1).bit_length())
    return np.packbits(np.bincount((x & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(rows: list[bytes], width: int) -> np.ndarray:
    """Parities of one width, over fewer places."""
    at = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)
    while at.shape[1] * 8 > width:
        half = at.shape[1] // 2
        at = at[:, :half] ^ at[:, half:]
    return at


def _sizes_allow(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9


def _parities_allow(differ: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    return differ * (1 + threshold) <= (1 - threshold) * (na + nb) + 1e-9


def _allowed(na: np.ndarray, pa_: list[bytes], nb: np.ndarray, pb: list[bytes], threshold: float) -> np.ndarray:
    """Of rows of two sets each: whether sizes and parities allow the similarity."""
    out = _sizes_allow(na, nb, threshold)
    la, lb = np.array([len(x) for x in pa_]), np.array([len(x) for x in pb])
    for one, two in sorted(set(zip(la[out].tolist(), lb[out].tolist(), strict=True))):
        rows = np.flatnonzero(out & (la == one) & (lb == two))
        for at in range(0, len(rows), step := max(1, AT_ONCE // max(one, two))):
            own = rows[at : at + step]
            width = min(one, two)
            differ = np.bitwise_count(_folded([pa_[i] for i in own], width) ^ _folded([pb[i] for i in own], width)).sum(axis=1, dtype=np.int64)
            out[own] = _parities_allow(differ, na[own], nb[own], threshold)
    return out


def _allowed_across(n: np.ndarray, p: list[bytes], left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of left and right whose sizes and parities allow the similarity, in parts."""
    length = np.array([len(x) for x in p])
    for one in np.unique(length[left]).tolist():
        for two in np.unique(length[right]).tolist():
            a, b, width = left[length[left] == one], right[length[right] == two], min(one, two)
            if not _sizes_allow(n[a][:, None], n[b][None, :], threshold).any():
                continue
            pa_, pb = _folded([p[i] for i in a], width), _folded([p[i] for i in b], width)
            for at in range(0, len(a), step := max(1, AT_ONCE // (len(b) * width))):
                own = a[at : at + step]
                differ = np.bitwise_count(pa_[at : at + step, None, :] ^ pb[None, :, :]).sum(axis=2, dtype=np.int64)
                i, j = np.nonzero(_sizes_allow(n[own][:, None], n[b][None, :], threshold) & _parities_allow(differ, n[own][:, None], n[b][None, :], threshold))
                yield own[i], b[j]


def _with_sets(docs: DataFrame, sets_of: SetsOf, kinds: dict[str, tuple[str, pa.DataType]], describe: Callable[[np.ndarray], tuple]) -> DataFrame:
    """docs without its source, with what `describe` makes of its set, in columns of these kinds. A task holds the sets of SLICE rows, beside a batch of Spark's."""
    names = docs.drop("source").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = sets_of()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = zip(*(describe(one(x)) for x in part.column("source").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(list(x), kind) for x, (_, kind) in zip(made, kinds.values(), strict=True))], [*names, *kinds])

    types = {f.name: f.dataType.simpleString() for f in docs.schema} | {c: kind for c, (kind, _) in kinds.items()}
    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in [*names, *kinds]))


def _described(docs: DataFrame, sets_of: SetsOf, threshold: float, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """docs with n, prefix and p, parities. frequent: sorted values that come last, in order of rank."""

    def describe(s: np.ndarray) -> tuple:
        if not len(s):
            return 0, [], b""
        at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
        last = frequent[at] == s if len(frequent) else np.zeros(len(s), bool)
        ordered = np.concatenate([s[~last], s[last][np.argsort(rank[at[last]])]])
        return len(s), ordered[: len(s) - needed(len(s), threshold) + 1].view(np.int64), parities(s)

    return _with_sets(docs, sets_of, {"n": ("int", pa.int32()), "prefix": ("array<long>", pa.list_(pa.int64())), "p": ("binary", pa.binary())}, describe)


def _frequent(docs: DataFrame, sets_of: SetsOf) -> tuple[np.ndarray, np.ndarray]:
    """Values of three or more of a bounded sample of rows, the most frequent ones, in order; and their ranks, the most frequent last."""
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, total)) * (1 << 20)))
    sets = _with_sets(part.select("source"), sets_of, {"x": ("array<long>", pa.list_(pa.int64()))}, lambda s: (s.view(np.int64),))
    counts = sets.select(F.explode("x").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    found = np.array([r["s"] for r in counts.orderBy(F.col("c").desc(), "s").limit(FREQUENT).collect()], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], -order


def _maybe(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of a hash column: false only where the hash is none of keys(h). It spares rows a shuffle, and a join decides after it; it grows with the keys up to MOST_BITS, beyond which it lets more pass."""
    n = keys.count()
    size = LEAST_BITS
    while size < min(EACH * n, MOST_BITS):
        size *= 2
    place = F.pmod("h", F.lit(size))
    chunks = keys.groupBy(F.floor(place / CHUNK).cast("int").alias("c")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(CHUNK))).alias("m"))
    packed = np.zeros(size // 8, np.uint8)
    for r in chunks.toLocalIterator():
        packed[r["c"] * CHUNK // 8 : (r["c"] + 1) * CHUNK // 8] = np.frombuffer(r["m"], np.uint8)

    @F.pandas_udf("boolean")
    def test(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda h: test(F.pmod(h, F.lit(size)))


def _links(pairs: DataFrame, described: DataFrame, threshold: float) -> DataFrame:
    """Of pairs(a, b) those that may be similar, as (src, dst)."""
    kind = described.schema["id"].dataType.simpleString()
    both = pairs
    for side in "ab":
        both = both.join(described.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("p").alias(f"p{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            na, nb = (t.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            ok = pa.array(_allowed(na, t.column("pa").to_pylist(), nb, t.column("pb").to_pylist(), threshold))
            yield pa.RecordBatch.from_arrays([t.column("a").filter(ok), t.column("b").filter(ok)], ["src", "dst"])

    return both.select("a", "na", "pa", "b", "nb", "pb").mapInArrow(run, f"src {kind}, dst {kind}")


def _link_block(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Of two blocks of a value's rows: links between groups, no more than would join them all."""

    def run(table: pa.Table) -> pa.Table:
        part, n, p = table["part"].to_numpy(), table["n"].to_numpy().astype(np.int64), table["p"].to_pylist()
        names, group = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
        root = np.arange(len(names))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        left, right = np.flatnonzero(part == table["one"][0].as_py()), np.flatnonzero(part == table["two"][0].as_py())
        made: list[tuple[int, int]] = []
        for i, j in _allowed_across(n, p, left, right, threshold):
            apart = group[i] != group[j]
            i, j = i[apart], j[apart]
            _, first = np.unique(group[i] * len(names) + group[j], return_index=True)
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                x, y = find(group[a]), find(group[b])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    made.append((a, b))
        ids = table["id"]
        return pa.table({"src": ids.take(pa.array([a for a, _ in made], pa.int64())), "dst": ids.take(pa.array([b for _, b in made], pa.int64()))})

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(id, blocks, ...) dealt by a hash of the id into blocks, once for each pair of blocks (one <= two)."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("one", F.least("part", "other")).withColumn("two", F.greatest("part", "other")).drop("other", "blocks")


def _labels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) of the ids that edges link."""
    return components(ids, edges).select("id", F.col("component").alias("label"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _groups(described: DataFrame, near: DataFrame, threshold: float) -> DataFrame:
    """(id, label): groups of which each similar pair is inside one. near(k, id, first): rows of the values that several prefixes have."""
    kind = described.schema["id"].dataType.simpleString()
    star = near.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    edges = cut(_links(star, described, threshold))
    joined = _labels(_ends(edges), edges)
    value = Window.partitionBy("k")
    named = near.select("k", "id").join(joined, "id", "left").withColumn("label", F.coalesce("label", "id"))
    apart = cut(named.withColumn("apart", F.min("label").over(value) != F.max("label").over(value)).where("apart").drop("apart"))
    # of the values that the same rows have one is enough: rows are told apart by 128 bits
    had = apart.groupBy("k").agg(*(F.bit_xor(F.xxhash64("id", F.lit(s))).alias(f"x{s}") for s in range(2)), F.count(F.lit(1)).alias("c"))
    told = had.groupBy("x0", "x1", "c").agg(F.min("k").alias("k")).select("k", "c")
    open_ = cut(apart.join(told, "k"))
    few = open_.where(F.col("c") <= FEW)
    pairs = few.select("k", F.col("id").alias("a"), F.col("label").alias("la")).join(few.select("k", F.col("id").alias("b"), F.col("label").alias("lb")), "k")
    small = _links(pairs.where("a < b and la != lb").select("a", "b").distinct(), described, threshold)
    many = open_.where(F.col("c") > FEW).withColumn("blocks", F.ceil(F.col("c") / ROWS).cast("int")).join(described, "id")
    large = _dealt(many).groupBy("k", "one", "two").applyInArrow(_link_block(threshold), f"src {kind}, dst {kind}")
    every = cut(edges.unionByName(small).unionByName(large))
    found = cut(_labels(_ends(every), every))
    for one in (edges, apart, open_, every):
        drop_cut(one)
    return found


def _compare_block(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """The similar pairs of a table of whole groups, or of two blocks of one group: (a, b, jaccard)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("id", "ascending")])
        _, group = np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)
        part, one, two = table["part"].to_numpy(), table["one"][0].as_py(), table["two"][0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table["x"].to_pylist()]
        lefts, rights, found = [], [], []
        bounds = np.flatnonzero(np.diff(group, prepend=-1, append=len(group) + 1))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = np.array([len(x) for x in sets[start:end]], np.int64)
            values, code = np.unique(np.concatenate(sets[start:end]), return_inverse=True)
            code = np.split(code, np.cumsum(n)[:-1])
            right = np.flatnonzero(part[start:end] == two)
            flat, offset = np.concatenate([code[j] for j in right]) if len(right) else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(n[right])])
            held = np.zeros(len(values), np.int32)
            for at, i in enumerate(np.flatnonzero(part[start:end] == one).tolist()):
                skip = at + 1 if one == two else 0
                if skip >= len(right):
                    break
                held[code[i]] = 1
                common = np.add.reduceat(held[flat[offset[skip] :]], offset[skip:-1] - offset[skip], dtype=np.int64)
                held[code[i]] = 0
                j = right[skip:]
                jaccard = common / (n[i] + n[j] - common)
                ok = jaccard >= threshold - 1e-12
                lefts.append(start + np.minimum(i, j[ok]))
                rights.append(start + np.maximum(i, j[ok]))
                found.append(jaccard[ok])
        ids = table["id"]
        a, b = (ids.take(pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (lefts, rights))
        return pa.table({"a": a, "b": b, "jaccard": pa.array(np.concatenate(found) if found else [], pa.float64())})

    return run


def _by_size(members: DataFrame) -> DataFrame:
    """members(id, n, label) with the number of blocks of their group, and for groups of one block the table that they are compared in."""
    sizes = cut(members.groupBy("label").agg(F.greatest(F.ceil(F.sum("n") / MEMBERS), F.ceil(F.count(F.lit(1)) / ROWS)).cast("int").alias("blocks"), F.sum("n").alias("w"), F.count(F.lit(1)).alias("c")), few=True)
    total = sizes.where("blocks = 1").agg(F.sum("w").alias("w"), F.sum("c").alias("c")).first()
    tables = max(1, -(-(total["w"] or 0) // (2 * MEMBERS)), -(-(total["c"] or 0) // (2 * ROWS)))
    out = cut(members.join(sizes, "label").select("id", "label", "blocks", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(tables))).alias("table")), few=True)
    drop_cut(sizes)
    return out


def similar_pairs(docs: DataFrame, sets_of: SetsOf, threshold: float) -> DataFrame:
    """All pairs (a, b, jaccard), a < b, of docs(id, source) whose sets have a Jaccard similarity of at least threshold; no two rows have one id. If docs has a column key, rows of one key are copies and stand under the least id."""
    docs = spread(docs.where("id is not null"))
    rows = _described(docs, sets_of, threshold, *_frequent(docs, sets_of))
    if "key" in docs.columns:
        rows = rows.groupBy("key").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "prefix", "p"))).drop("key")
    rows = cut(rows)
    value = Window.partitionBy("k")
    index = rows.select("id", F.explode("prefix").alias("k"))
    near = cut(index.withColumn("first", F.min("id").over(value)).withColumn("last", F.max("id").over(value)).where("first != last").drop("last"))
    described = cut(rows.select("id", "n", "p"))
    drop_cut(rows)
    groups = _groups(described, near, threshold)
    drop_cut(near)
    members = _by_size(groups.join(described.select("id", "n"), "id"))
    for one in (described, groups):
        drop_cut(one)
    # only the sources of a group's members are shuffled
    maybe = _maybe(members.select(F.xxhash64("id").alias("h")))
    sets = _with_sets(docs.where(maybe(F.xxhash64("id"))).select("id", "source").join(members, "id"), sets_of, {"x": ("binary", pa.binary())}, lambda s: (s.tobytes(),))
    whole = F.when(F.col("table").isNull(), F.col("label")).alias("whole")
    kind = docs.schema["id"].dataType.simpleString()
    return _dealt(sets).groupBy("table", whole, "one", "two").applyInArrow(_compare_block(threshold), f"a {kind}, b {kind}, jaccard double")
