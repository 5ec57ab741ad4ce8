"""What the operators of this package share: cutting lineage, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from sitequarry.plans.lineage import cut, drop_cut


def per_text(make: Callable[[], Callable[[str | None], tuple]], fields: str) -> Callable[[Column], Column]:
    """A function of a text column that gives a struct of fields: make(), called once a task, gives the function of one text.

    Texts are taken from the Arrow batch one by one, so that a worker holds no second copy of a batch.
    """
    schema = StructType.fromDDL(fields) if hasattr(StructType, "fromDDL") else DataType.fromDDL(fields)
    names = schema.fieldNames()
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for texts in batches:
            columns: list[list] = [[] for _ in names]
            for text in texts:
                for column, value in zip(columns, one(text.as_py()), strict=True):
                    column.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def sampled(rows: DataFrame, keys: list[str], most: int, seed: int) -> DataFrame:
    """The distinct rows by keys, where those are more than `most` a sample of about that many, taken by a hash of the keys: rows that share an id, or have none, are told apart by their other keys, and repeated rows are taken once."""
    h = F.xxhash64(*keys, F.lit(seed))
    n = rows.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    if n > most:
        rows = rows.where(F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * most / n))
    return rows.dropDuplicates(keys)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, held_out: Column, most: int, seed: int = 13) -> DataFrame:
    """(doc_id, mark, text) of labels 0 and 1 outside the held-out fold, distinct, at most about `most`."""
    marks = labels.where(F.col(label_col).isin(0, 1) & ~held_out).select("doc_id", F.col(label_col).cast("int").alias("mark"))
    # broadcast: at most about `most` rows of an id and a mark, by the sampling
    marks = F.broadcast(sampled(marks, ["doc_id", "mark"], most, seed))
    rows = docs.select("doc_id", "text").join(marks, "doc_id").withColumn("key", F.xxhash64("text"))
    # an id with many texts: counted without the texts, and sampled by text too
    n = docs.select("doc_id").join(marks, "doc_id").count()
    if n > 1.2 * most:
        rows = sampled(rows, ["doc_id", "mark", "key"], most, seed + 1)
    return rows.dropDuplicates(["doc_id", "mark", "key"]).select("doc_id", "mark", "text")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u long, v long): rows (node, label), label the smallest node of the component.

    Alternating large-star and small-star rounds; each takes minima by key (combined before the shuffle) and joins them
    back on the key, so that a node with very many neighbours is a skewed join that Spark can split, not a group held by
    one task. Self-links and repeated links are allowed. Nodes without a link to another node don't appear.
    """
    now = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), few=True)
    mark = None
    for _ in range(max_rounds):
        stats = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not stats[0] or stats == mark:
            break
        mark = stats
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        step = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = cut(step, few=True)
        drop_cut(now)
        now = after
    else:
        raise RuntimeError(f"components: not done after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
