"""Sharding by sampled splitters, law `bytes`: shards of nearly equal size.

Records are ordered by (hash of the text, doc_id). A size-weighted sample of those keys gives quantile boundaries of many
small ranges; ranges that turn out overfull are subdivided by a denser sample of their own. Exact prefix sums of bytes and
rows - inside a range by a window, over the ranges by their totals - then give each record its place, and the place gives
shard and slot. Copies of a text are neighbours in this order and stay in one shard, unless they fill more than a hundredth of
a shard; then they are cut like any other run of records.

Defined results: a null text has size 1 and the checksum of no bytes; an empty table gives no rows; repeated rows get a slot
each; rows with null doc_id, told apart by their place in the table that this job writes, come first among copies; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sitequarry.llm.common import cut

LEAST = -(2**63)
#: Rows that a range should have, samples for each range, and the most sampled keys that the driver holds at once.
RANGE_ROWS, PER_RANGE, MOST_SAMPLES = 100_000, 24, 400_000


def _range_of(splitters: list[tuple[int, int]]):
    """A function of (key, id) columns: how many splitters are not above them."""
    keys = np.array([k for k, _ in splitters], np.int64)
    ids = np.array([d for _, d in splitters], np.int64)
    split = {int(k) for k, d in splitters if d != LEAST}

    @pandas_udf("int")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, doc in batches:
            k, d = key.to_numpy(np.int64), doc.to_numpy(np.int64)
            out = np.searchsorted(keys, k, "right")
            for hot in split.intersection(np.unique(k).tolist()):
                here = k == hot
                low, high = np.searchsorted(keys, hot, "left"), np.searchsorted(keys, hot, "right")
                out[here] = low + np.searchsorted(ids[low:high], d[here], "right")
            yield pd.Series(out.astype(np.int32))

    return find


def _splitters(sample: list, parts: int, known: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Boundaries between parts of equal sampled weight; within a text only where a text spans several boundaries."""
    if not sample or parts < 2:
        return []
    sample = sorted((r["key"], r["id"], r["weight"]) for r in sample)
    total = np.cumsum([w for _, _, w in sample])
    cuts = [sample[i] for i in np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)]
    often = {k for k in (c[0] for c in cuts) if sum(c[0] == k for c in cuts) > 1} if len(cuts) < 2000 else {a[0] for a, b in zip(cuts, cuts[1:], strict=False) if a[0] == b[0]}
    out = {(k, LEAST) for k, _, _ in cuts} | {(k, d) for k, d, _ in cuts if k in often}
    return sorted(out - known)


def place(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, shard, slot."""
    text = F.col(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST + 1) + F.monotonically_increasing_id()).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        )
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(max(shards * 8, n // range_rows), MOST_SAMPLES // PER_RANGE))
    chance = F.pmod(F.xxhash64("key", "id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)

    def sample(of: DataFrame, weight: int, count: int) -> list:
        rate = count / max(1, weight)
        return of.where(chance < F.col("size") * rate).select("key", "id", F.greatest(F.col("size").cast("double"), F.lit(1 / rate)).alias("weight")).collect()

    def filled(splitters: list[tuple[int, int]]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
        """The rows with their range, and bytes and rows of each range."""
        placed = rows.withColumn("range", _range_of(splitters)("key", "id"))
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        return placed, {r["range"]: (r["bytes"], r["n"]) for r in sums}

    splitters = _splitters(sample(rows, total, ranges * PER_RANGE), ranges, set())
    placed, sums = filled(splitters)
    for _ in range(3):
        over = {k: b for k, (b, m) in sums.items() if b > 3 * total / ranges and m > range_rows / 50}
        more = sample(placed.where(F.col("range").isin(list(over))), sum(over.values()), min(MOST_SAMPLES, len(over) * 8 * PER_RANGE)) if over else []
        new = _splitters(more, len(over) * 8, set(splitters))
        if not new:
            break
        splitters = sorted({*splitters, *new})
        placed, sums = filled(splitters)
    before, at = [], (0, 0)
    for k in sorted(sums):
        before.append((k, *at))
        at = (at[0] + sums[k][0], at[1] + sums[k][1])
    spark = docs.sparkSession
    # one row for each range: at most MOST_SAMPLES / PER_RANGE and what subdividing adds
    offsets = F.broadcast(spark.createDataFrame(pd.DataFrame(before, columns=["range", "bytes_before", "rows_before"]), "range int, bytes_before long, rows_before long") if before else spark.createDataFrame([], "range int, bytes_before long, rows_before long"))
    order = Window.partitionBy("range").orderBy("key", "id", "text_crc32", "size")
    copies = Window.partitionBy("range", "key")
    whole = F.col("copy_bytes") * shards * 100 <= total
    laid = (
        placed.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("row", F.row_number().over(order).cast("long") - 1)
        .withColumn("copy_bytes", F.sum("size").over(copies)).withColumn("copy_upto", F.max("upto").over(copies))
        .join(offsets, "range")
        .withColumn("twice_middle", F.when(whole, 2 * (F.col("bytes_before") + F.col("copy_upto")) - F.col("copy_bytes")).otherwise(2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")))
        .select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.expr(f"cast(twice_middle * {shards} div {2 * max(1, total)} as int)")).cast("int").alias("shard"), (F.col("rows_before") + F.col("row")).alias("rank"))
    )
    laid = cut(laid)
    first = F.broadcast(laid.groupBy("shard").agg(F.min("rank").alias("first_rank")))  # one row for each shard
    return laid.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """The rows of docs (ids distinct and not null) as Parquet under path/shard=N, in the shard that place() gives."""
    where = place(docs, shards, id_col=id_col).select(F.col("doc_id").alias(id_col), "shard", "slot")
    docs.drop("shard", "slot").join(where, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return place(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
