"""Pairs of vectors within a band of cosines, by random projections, with an exact audit of what they find."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sitequarry.plans.lineage import cut

#: Rows that a bucket, or a block of a larger one, should have.
BLOCK = 2048
#: Rows of the largest block of the exact search, and cosines that a task holds at once.
MOST_BLOCK, CELLS = 32_768, 1 << 23


def plan_tables(n: int, low: float, recall: float, block: int = BLOCK) -> tuple[int, int]:
    """(bits, tables): signs of so many projections leave about `block` of n rows in a bucket, and so many independent tables let a pair at the lower edge meet in one with this probability."""
    bits = max(0, math.ceil(math.log2(max(1, n) / block)))
    meet = (1 - math.acos(low) / math.pi) ** bits
    return bits, 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meet))


def _keys(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The bucket of each row in each table."""
    directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ directions > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(vectors), tables), np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def unit_classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(classes, members): one row (id, v) for each different vector, v of unit length and id the least of its rows; (member, id) for every row that has one.

    Vectors that are null, zero, or hold null or non-finite components belong to no class. Vectors of the commonest length are compared, as others have no cosine with them.
    """
    v = F.col(vec_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("member"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1)  # one row
    rows = rows.join(F.broadcast(size.select("size")), F.size("v") == F.col("size"), "left_semi")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("v", F.transform("v", lambda x: x / norm))
    classes = cut(rows.groupBy("v").agg(F.min("member").alias("id")).select("id", "v"))
    return classes, rows.join(classes, "v").select("member", "id")


def _compare(low: float, high: float, bits: int, tables: int, seed: int) -> Callable[[pa.Table], pa.Table]:
    """Pairs within the band of one block, or of two blocks of a bucket; each pair in the first table in which it meets."""

    def run(rows: pa.Table) -> pa.Table:
        table, one, two = (rows[c][0].as_py() for c in ("tab", "one", "two"))
        ids, part, m = rows["id"].to_numpy(), rows["part"].to_numpy(), _matrix(rows["v"])
        keys = _keys(m, bits, tables, seed)[:, :table]
        left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, min(512, CELLS // max(1, len(right))))
        for at in range(0, len(left), step):
            own = left[at : at + step]
            cosine = m[own] @ m[right].T
            i, j = np.nonzero((cosine >= low - 1e-12) & (cosine < high) & ((ids[own][:, None] < ids[right][None, :]) if one == two else True))
            if table and len(i):
                fresh = ~(keys[own[i]] == keys[right[j]]).any(axis=1)
                i, j = i[fresh], j[fresh]
            a, b = ids[own[i]], ids[right[j]]
            found.append((np.minimum(a, b), np.maximum(a, b), cosine[i, j]))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": a, "b": b, "cosine": c})

    return run


def cosine_band(classes: DataFrame, low: float = 0.78, high: float = 0.85, recall: float = 0.95, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(a, b, cosine), a < b, of classes(id, v of unit length) with low <= cosine < high.

    The number of projections follows from the rows. A bucket larger than a block is cut into blocks by a hash of the ids, and each
    pair of its blocks is compared by a task of its own, so no task holds a bucket. A pair is given once, in the first of the
    tables that bring it together.
    """
    n = classes.count()
    bits, tables = plan_tables(n, low, recall, block)

    @F.arrow_udf(ArrayType(LongType()))
    def keys(v: pa.Array) -> pa.Array:
        return pa.array(list(_keys(_matrix(v), bits, tables, seed)) if len(v) else [], pa.list_(pa.int64()))

    placed = cut(classes.select("id", "v", keys("v").alias("keys")))
    spots = placed.select("id", F.posexplode("keys").alias("tab", "key"))
    counted = spots.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")).drop("rows")
    own = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks")).cast("int")
    dealt = spots.join(counted, ["tab", "key"]).withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "tab", "key", "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    rows = dealt.join(placed.select("id", "v"), "id")
    return rows.groupBy("tab", "key", "one", "two").applyInArrow(_compare(low, high, bits, tables, seed), "a long, b long, cosine double")


def audit(classes: DataFrame, pairs: DataFrame, low: float = 0.78, high: float = 0.85, sample: int = 500, seed: int = 11) -> DataFrame:
    """One row (asked, present, found, recall, wrong): a sample of at most about `sample` rows is compared with all rows; wrong counts pairs given that are not in the band."""
    n = classes.count()
    chosen = classes.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(1, n))).collect()  # bounded by the sample
    ids, m = np.array([r["id"] for r in chosen], np.int64), np.array([r["v"] for r in chosen], np.float64)

    def run(batches):
        for batch in batches:
            own, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            cosine = m @ v.T if len(m) else np.zeros((0, len(own)))
            i, j = np.nonzero((cosine >= low - 1e-12) & (cosine < high) & (ids[:, None] != own[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], own[j])), pa.array(np.maximum(ids[i], own[j]))], names=["a", "b"])

    true = classes.select("id", "v").mapInArrow(run, "a long, b long").distinct().withColumn("present", F.lit(1))
    asked = classes.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
    mine = pairs.join(F.broadcast(asked), (F.col("a") == F.col("id")) | (F.col("b") == F.col("id")), "left_semi").select("a", "b").withColumn("found", F.lit(1))
    out = true.join(mine, ["a", "b"], "full").agg(F.count("present").alias("present"), F.count(F.when(F.col("present").isNotNull(), F.col("found"))).alias("found"), F.count(F.when(F.col("present").isNull(), F.col("found"))).alias("wrong"))
    return out.select(F.lit(len(ids)).alias("asked"), "present", "found", F.when(F.col("present") > 0, F.col("found") / F.col("present")).otherwise(1.0).alias("recall"), "wrong")


def audited_band(classes: DataFrame, low: float = 0.78, high: float = 0.85, least: float = 0.9, recall: float = 0.95, block: int = BLOCK) -> tuple[DataFrame, float]:
    """cosine_band() and its audited recall; where the audit stays below `least`, the pairs that one more set of tables misses are halved, again and again, and at last all blocks are compared."""
    for target in (recall, 1 - (1 - recall) / 4, 1 - (1 - recall) / 64):
        pairs = cut(cosine_band(classes, low, high, target, block=block))
        measured = audit(classes, pairs, low, high).first()["recall"]
        if measured >= least:
            return pairs, measured
    return cut(all_pairs(classes, low, high, block)), 1.0


def all_pairs(classes: DataFrame, low: float = 0.78, high: float = 0.85, block: int | None = None) -> DataFrame:
    """The exact band: every block against every other, in the square of the rows.

    A row is sent once for each block, so blocks grow with the rows up to MOST_BLOCK: some eight of them keep all cores busy.
    """
    n = classes.count()
    blocks = max(1, math.ceil(n / (block or min(MOST_BLOCK, max(BLOCK, n // 8)))))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = classes.select("id", "v", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = dealt.select("id", "v", F.lit(0).alias("tab"), "part", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    return dealt.groupBy("one", "two").applyInArrow(_compare(low, high, 0, 1, 0), "a long, b long, cosine double")
