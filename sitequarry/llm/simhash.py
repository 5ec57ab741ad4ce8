"""SimHash near-dedup with a generalised pigeonhole search.

Fingerprints of 64 bits by majority vote over XXH64 hashes of word shingles. Pairs within a Hamming radius are found on the
distinct fingerprints: correlated bits are grouped into partitions; each fingerprint gets its own threshold per partition,
by dynamic programming over estimated candidate counts, so that the thresholds sum to radius - partitions + 1; its partition
values and their neighbours up to the threshold are looked up in an index of all partition values; hits are verified on the
whole fingerprint. A partition with threshold -1 is not probed: that is how frequent values (large groups of near copies) are
avoided. The search is exact: of partitions differing in more than their thresholds each, the differences would sum to more
than the radius.

Defined results: null or blank texts have fingerprint 0 and link like any other; equal fingerprints always link; a table with
no rows gives no rows; repeated doc_ids give a row each; rows with null doc_id take part and get the component of their
fingerprint; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sitequarry.llm.common import components, cut

SEED = 42
BITS = 64
#: Shingles that are hashed and summed at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit integer."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    votes = np.zeros(BITS, np.int64)
    for start in range(0, n, BLOCK):
        stop = min(n, start + BLOCK)
        own = tokens[start : stop + words - 1]
        shingles = map(b" ".join, zip(*(own[k:] for k in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, stop - start)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def vote(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes as a signed 64-bit integer."""
    votes = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[start : start + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text") -> DataFrame:
    """docs with a column fp (long)."""

    @pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn("fp", fp(F.col(text_col)))


def _bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them each pair of bits is set: 2 080 sums, whatever the input."""
    places = [(i, j) for i in range(BITS) for j in range(i, BITS)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(batch)
        if n:
            yield pd.DataFrame({"k": range(-1, len(places)), "n": [n, *(int(total[p]) for p in places)]})

    sums = {r["k"]: r["n"] for r in classes.select("fp").mapInPandas(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    together = np.zeros((BITS, BITS))
    for k, (i, j) in enumerate(places):
        together[i, j] = together[j, i] = sums.get(k, 0)
    return sums.get(-1, 0), together


def correlated_parts(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of nearly equal size, the most correlated pairs together as far as the size allows."""
    p = np.diag(together) / max(1, n)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    rho = np.abs(together / max(1, n) - np.outer(p, p)) / np.maximum(spread, 1e-9)
    cap = -(-BITS // parts)
    group = {b: [b] for b in range(BITS)}
    pairs = sorted(((-round(float(rho[i, j]), 9), i, j) for i in range(BITS) for j in range(i + 1, BITS)))
    for _, i, j in pairs:
        a, b = group[i], group[j]
        if a is not b and len(a) + len(b) <= cap:
            a.extend(b)
            for x in b:
                group[x] = a
    left = sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-len(g), g))
    out, rest = left[:parts], [b for g in left[parts:] for b in g]
    for b in rest:
        min(out, key=len).append(b)
    return [sorted(g) for g in out]


def _value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of one partition, packed."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps.astype(np.uint64) >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _ball(width: int, radius: int) -> int:
    return sum(1 for r in range(radius + 1) for _ in itertools.combinations(range(width), r))


def allocate(found: np.ndarray, widths: list[int], mean: np.ndarray, radius: int) -> np.ndarray:
    """Thresholds (n x parts) by dynamic programming. found: how many fingerprints share each partition value; mean: how many a value of that width has if all are alike.

    The estimated cost of threshold t is the look-ups plus the candidates: those that share the value, and for each further
    value in the ball the mean and a tenth of the others that share this one (neighbours of frequent values are frequent).
    """
    n, parts = found.shape
    target = radius - parts + 1
    options = range(-1, radius + 1)
    cost = np.zeros((parts, len(options), n))
    for i, width in enumerate(widths):
        for k, t in enumerate(options):
            if t >= 0:
                ball = _ball(width, t)
                cost[i, k] = ball + found[:, i] + (ball - 1) * (mean[i] + 0.1 * (found[:, i] - 1))
    low = -parts
    best = {0: np.zeros(n)}
    picks: list[dict[int, np.ndarray]] = []
    for i in range(parts):
        after: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for total, so_far in best.items():
            for k, t in enumerate(options):
                s = total + t
                if not low <= s <= target + parts:
                    continue
                new = so_far + cost[i, k]
                if s not in after:
                    after[s], pick[s] = new.copy(), np.full(n, t)
                else:
                    better = new < after[s]
                    after[s] = np.where(better, new, after[s])
                    pick[s] = np.where(better, t, pick[s])
        best = after
        picks.append(pick)
    out = np.zeros((n, parts), np.int64)
    state = np.full(n, target)
    for i in reversed(range(parts)):
        for s, pick in picks[i].items():
            here = state == s
            out[here, i] = pick[here]
        state = state - out[:, i]
    return out


def part_count(n: int, radius: int) -> int:
    """The number of partitions with the least look-ups and expected candidates among n scattered fingerprints; a candidate, whose number grows with the square of n, counts as a hundred look-ups."""

    def cost(parts: int) -> float:
        width, total = BITS // parts, radius - parts + 1
        thresholds = [total // parts + (i < total % parts) for i in range(parts)]
        asked = sum(_ball(width, t) for t in thresholds if t >= 0)
        return n * asked + 100 * n * n / 2 * asked / 2.0**width

    return min(range(2, max(2, radius + 1) + 1), key=cost)


def close_pairs(classes: DataFrame, radius: int = 2) -> DataFrame:
    """All pairs (u, v), u < v, of classes(fp), distinct fingerprints, that differ in 1 to radius bits."""
    n, together = _bit_counts(classes)
    parts = part_count(n, radius)
    groups = correlated_parts(n, together, parts)
    widths = [len(g) for g in groups]

    @pandas_udf("array<long>")
    def values(fps: pd.Series) -> pd.Series:
        raw = fps.to_numpy(np.int64)
        return pd.Series(list(np.stack([_value(raw, g) | (i << 56) for i, g in enumerate(groups)], axis=1)))

    index = classes.select("fp", F.explode(values("fp")).alias("key"))
    counted = index.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    mean = np.array([n / 2.0**w for w in widths])
    # Only values that several fingerprints share are worth a look-up of their counts.
    shared = counted.where(F.col("c") > 1)
    costs = index.join(shared, "key", "left").groupBy("fp").agg(F.collect_list(F.struct("key", F.coalesce("c", F.lit(1)).alias("c"))).alias("counts"))

    @pandas_udf("array<long>")
    def probes(fps: pd.Series, counts: pd.Series) -> pd.Series:
        found = np.array([[x["c"] for x in sorted(row, key=lambda x: x["key"])] for row in counts], float).reshape(-1, parts)
        raw = fps.to_numpy(np.int64)
        own = np.stack([_value(raw, g) for g in groups], axis=1)
        chosen = allocate(found, widths, mean, radius)
        out = []
        for row, thresholds in zip(own, chosen, strict=True):
            keys = []
            for i, t in enumerate(thresholds):
                for r in range(t + 1):
                    keys += [int(row[i]) ^ sum(1 << b for b in flips) | (i << 56) for flips in itertools.combinations(range(widths[i]), r)]
            out.append(keys)
        return pd.Series(out)

    ask = costs.select(F.col("fp").alias("u"), F.explode(probes("fp", "counts")).alias("key"))
    hits = ask.join(index.select("key", F.col("fp").alias("v")), "key").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
    return hits.select("u", "v").distinct()


def near_copies(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, key (hash of the text), fp, label (a fingerprint that names the component), component_id (smallest id reachable by links of at most radius differing bits)."""
    text = F.col(text_col)
    rows = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")), words).select("doc_id", "key", "fp"))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), few=True)
    # fingerprints without a link are components of their own
    linked = cut(components(close_pairs(classes, radius)), few=True)
    labelled = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    named = linked.select("label").distinct()
    many = labelled.join(named, "label", "left_semi").groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = labelled.join(many, "label", "left").select("fp", "label", F.coalesce("component_id", "least_id").alias("component_id"))
    return rows.join(of_class, "fp").select("doc_id", "key", "fp", "label", "component_id")


def near_sets(rows: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of rows(id, fp), sets with their fingerprints, that the search proposes as near copies: each set with the first of its fingerprint, and the firsts of fingerprints within the radius. A group of one fingerprint makes no square of pairs."""
    firsts = cut(rows.groupBy("fp").agg(F.min("id").alias("first")), few=True)
    alike = rows.join(firsts, "fp").where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    close = close_pairs(firsts, radius)
    near = close.join(firsts.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(firsts.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v").select("a", "b")
    return alike.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def op1(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_copies(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component, with the columns of docs: that of the smallest doc_id (null only if there is no other), and of rows with that id the one whose text has the smallest hash. Rows alike in id and text count as one."""
    found = near_copies(docs, words, radius)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("r"))
    kept = cut(first.select(F.col("r.doc_id").alias("_id"), F.col("r.key").alias("_key")), few=True)
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_key"]), "left_semi")
    several = found.join(kept, found["doc_id"].eqNullSafe(kept["_id"]) & (found["key"] == kept["_key"]), "left_semi").groupBy("doc_id", "key").count().where("count > 1")
    return out.dropDuplicates(["doc_id", "text"]) if several.limit(1).count() else out
