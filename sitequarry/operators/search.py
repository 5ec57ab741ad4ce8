"""Substring search over URLs and titles by an inverted index of trigrams.

The rows are stored in buckets, a folder each, with Bloom filters of their ids. Beside them stands a list of (trigram, page, bucket),
by trigram, and how many pages each trigram has. A search takes the rarest trigrams of what is sought, intersects their lists, reads
only the buckets in which pages remain, and verifies those. What is shorter than a trigram is sought in all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Trigrams that a search intersects at most: the rarest.
MOST_GRAMS = 6
_PAGES, _LISTS, _COUNTS = "pages", "lists", "counts"


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))).otherwise(F.array().cast("array<string>"))


def matches(columns: tuple[str, ...], sought: str) -> Column:
    """Whether a column holds what is sought, whatever the case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(sought))) for c in columns])


def _shelf(gram: Column, shelves: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(shelves)).cast("int")


@dataclass(frozen=True)
class Index:
    """An index at a path: the columns it covers, its buckets of rows and shelves of trigrams."""

    path: str
    id_col: str
    columns: tuple[str, ...]
    buckets: int
    shelves: int
    #: Of the stored rows, their bucket behind them.
    schema: StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/{_PAGES}")

    def _of(self, spark: SparkSession, table: str, sought: list[str]) -> DataFrame:
        """The rows of these trigrams; their shelves are worked out here, so that only those folders are read."""
        shelf = spark.range(1).select(F.array(*[_shelf(F.lit(g), self.shelves) for g in sought]).alias("s")).first()["s"]
        kind = {_COUNTS: "gram string, n long, shelf int", _LISTS: f"{self.id_col} {self.schema[self.id_col].dataType.simpleString()}, bucket int, gram string, shelf int"}[table]
        return spark.read.schema(kind).parquet(f"{self.path}/{table}").where(F.col("shelf").isin(sorted(set(shelf))) & F.col("gram").isin(sought))

    def candidates(self, spark: SparkSession, sought: str) -> DataFrame | None:
        """(id, bucket) of the pages that have the rarest trigrams of what is sought; None if that is shorter than one."""
        low = sought.lower()
        own = sorted({low[k : k + 3] for k in range(len(low) - 2)})
        if not own:
            return None
        counts = {r["gram"]: r["n"] for r in self._of(spark, _COUNTS, own).collect()}  # a row for each trigram of what is sought
        rare = sorted(own, key=lambda g: (counts.get(g, 0), g))[:MOST_GRAMS]
        lists = self._of(spark, _LISTS, rare)
        return lists.groupBy(self.id_col, "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).drop("n")

    def search(self, spark: SparkSession, sought: str) -> DataFrame:
        """The rows that hold what is sought."""
        found = self.candidates(spark, sought)
        rows = self.rows(spark)
        if found is None:
            return rows.where(matches(self.columns, sought)).drop("bucket")
        # at most as many numbers as there are buckets
        buckets = sorted(r["bucket"] for r in found.select("bucket").distinct().collect())
        return rows.where(F.col("bucket").isin(buckets)).join(found, [self.id_col, "bucket"], "left_semi").where(matches(self.columns, sought)).drop("bucket")

    def page(self, spark: SparkSession, page_id: object) -> DataFrame:
        """The row of an id: its bucket's folder alone is read, and of that the row groups whose Bloom filter may hold the id."""
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(page_id).cast(self.rows(spark).schema[self.id_col].dataType)), F.lit(self.buckets)).cast("int").alias("b")).first()["b"]
        return self.rows(spark).where((F.col("bucket") == bucket) & (F.col(self.id_col) == F.lit(page_id))).drop("bucket")


def build(rows: DataFrame, path: str, columns: tuple[str, ...] = ("url", "title"), id_col: str = "page_id", buckets: int = 64, shelves: int = 64) -> Index:
    """Writes an index of rows (ids distinct) to a path. Lists are put down by trigram in ranges, so a common one spans several files and no task holds it."""
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int"))
    index = Index(path.rstrip("/"), id_col, columns, buckets, shelves, placed.schema)
    placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", id_col).write.option(f"parquet.bloom.filter.enabled#{id_col}", "true").partitionBy("bucket").parquet(f"{index.path}/{_PAGES}")
    all_grams = F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in columns])))
    lists = placed.select(id_col, "bucket", F.explode(all_grams).alias("gram")).withColumn("shelf", _shelf(F.col("gram"), shelves))
    lists.repartitionByRange("shelf", "gram", id_col).sortWithinPartitions("shelf", "gram", id_col).write.partitionBy("shelf").parquet(f"{index.path}/{_LISTS}")
    lists.groupBy("shelf", "gram").agg(F.count(F.lit(1)).alias("n")).repartition("shelf").sortWithinPartitions("shelf", "gram").write.partitionBy("shelf").parquet(f"{index.path}/{_COUNTS}")
    return index
