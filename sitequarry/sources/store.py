"""A store of runs: Parquet tables behind one manifest. Loading a run twice, or after it was killed, changes nothing.

A load first writes what is new as directories that nobody reads, then names them in a new manifest, numbered one above the
last. That is one step for all tables: a reader sees all of a load or nothing. A load that ends before leaves directories that
vacuum() deletes; of two loads at once, the one that comes second begins again from the other's manifest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitequarry.plans.lineage import drop_path
from sitequarry.sources.issues import replace_file


class Conflict(RuntimeError):
    """Another load has committed in between."""


@dataclass(frozen=True)
class Incoming:
    """Rows to load: of a table with a key of its own, or of children that follow the rows of a parent."""

    rows: DataFrame
    key: tuple[str, ...] = ()
    parent: str | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.system = self.hadoop.Path(self.root).getFileSystem(self.conf)

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join((self.root, *parts)))

    def _listed(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(path)) if self.system.exists(path) else []

    def manifest(self) -> dict:
        """{"number": the load's, "tables": {name: {"schema": DDL, "parts": [directory]}}}"""
        names = [n for n in self._listed("_manifest") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return {"number": 0, "tables": {}}
        stream = self.system.open(self._path("_manifest", names[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, manifest: dict | None = None) -> DataFrame | None:
        """The rows of a table as of a manifest, the last if none is given; None if it has never had any."""
        entry = (manifest or self.manifest())["tables"].get(name)
        return self.spark.read.schema(StructType.fromDDL(entry["schema"])).parquet(*(f"{self.root}/{p}" for p in entry["parts"])) if entry else None

    def _commit(self, was: dict, added: dict[str, tuple[str, str]]) -> dict:
        tables = {n: {"schema": e["schema"], "parts": list(e["parts"])} for n, e in was["tables"].items()}
        for name, (schema, part) in added.items():
            entry = tables.setdefault(name, {"schema": schema, "parts": []})
            entry["parts"].append(part)
        new = {"number": was["number"] + 1, "tables": tables}
        target = self._path("_manifest", f"{new['number']:012d}.json")
        fresh = self._path("_manifest", f".{uuid.uuid4().hex}")
        out = self.system.create(fresh, True)
        out.write(json.dumps(new, sort_keys=True).encode())
        out.close()
        try:
            replace_file(self.spark, fresh, target, overwrite=False)
        except Py4JJavaError as e:
            if self.system.exists(target):
                raise Conflict(f"load {new['number']} has been committed by another") from e
            raise
        finally:
            self.system.delete(fresh, False)
        return new

    def _fresh(self, name: str, incoming: Incoming, was: dict, landed: dict[str, DataFrame]) -> DataFrame:
        """Rows that the store lacks: by their key, of repeated ones the first in the order of their columns; of children, those of parents that this load brings."""
        rows = incoming.rows
        if incoming.parent is not None:
            return rows.join(landed[incoming.parent], list(incoming.key), "left_semi")
        order = F.xxhash64(*sorted(rows.columns))
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*incoming.key).orderBy(order))).where("_r = 1").drop("_r")
        old = self.table(name, was)
        return rows.join(old.select(*incoming.key), list(incoming.key), "left_anti") if old is not None else rows

    def sync(self, tables: dict[str, Incoming], attempts: int = 3) -> dict[str, int]:
        """Loads what the store lacks, parents before their children; the rows that each table gained.

        A row whose key is there stays as it is. Children come with their parent and with it only, so a load after one that was
        killed brings whole parents, and a second one brings none.
        """
        for left in reversed(range(attempts)):
            was = self.manifest()
            parts: dict[str, tuple[str, str]] = {}
            gained: dict[str, int] = {}
            landed: dict[str, DataFrame] = {}
            for name in sorted(tables, key=lambda n: tables[n].parent is not None):
                own = tables[name]
                part = f"data/{name}/{uuid.uuid4().hex}"
                self._fresh(name, own, was, landed).write.parquet(f"{self.root}/{part}")
                written = self.spark.read.schema(own.rows.schema).parquet(f"{self.root}/{part}")
                gained[name], parts[name] = written.count(), (_ddl(own.rows.schema), part)
                if own.parent is None:
                    landed[name] = written.select(*own.key)
            try:
                if any(gained.values()):
                    self._commit(was, {n: p for n, p in parts.items() if gained[n]})
            except Conflict:
                gained = dict.fromkeys(gained, 0)
                if not left:
                    raise
                continue
            finally:
                for name, (_, part) in parts.items():
                    if not gained[name]:
                        drop_path(self.spark, f"{self.root}/{part}")
            return gained
        raise AssertionError

    def vacuum(self) -> int:
        """Deletes directories that no manifest names, as loads that were killed leave them; run it while no load runs. Their number."""
        used = {p for e in self.manifest()["tables"].values() for p in e["parts"]}
        gone = [f"data/{t}/{p}" for t in self._listed("data") for p in self._listed(f"data/{t}") if f"data/{t}/{p}" not in used]
        for p in gone:
            drop_path(self.spark, f"{self.root}/{p}")
        return len(gone)


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def sync_run(store: Store, pages: DataFrame, children: dict[str, DataFrame], others: dict[str, tuple[DataFrame, tuple[str, ...]]] | None = None) -> dict[str, int]:
    """Loads a run: pages by (run_id, page_id), children (links, images, headings, ...) with their page, other tables by their key."""
    key = ("run_id", "page_id")
    tables = {"pages": Incoming(pages, key)} | {n: Incoming(d, key, "pages") for n, d in children.items()} | {n: Incoming(d, k) for n, (d, k) in (others or {}).items()}
    return store.sync(tables)


def import_findings(store: Store, run_id: str, issues: DataFrame, evaluated: int) -> dict[str, int]:
    """Findings by rule and the issues behind them, once for a run: pages hit, their reach (the root of the share of evaluated pages), five URLs; an issue keeps its page only if that is in the store."""
    old = store.table("findings")
    if old is not None and old.where(F.col("run_id") == run_id).limit(1).count():
        return {"findings": 0, "issues": 0}
    own = issues.withColumn("_order", F.xxhash64(*sorted(issues.columns)))
    first = lambda c: F.min_by(c, "_order").alias(c)
    by_rule = own.groupBy("rule_id").agg(first("scope"), first("category"), first("severity"), F.count_distinct("page_id").alias("affected"), F.count(F.lit(1)).alias("instances"))
    urls = own.where("url is not null").select("rule_id", "url").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("rule_id").orderBy("url"))).where("_r <= 5").groupBy("rule_id").agg(F.array_sort(F.collect_list("url")).alias("sample_urls"))
    reach = F.sqrt(F.least(F.lit(1.0), F.col("affected") / F.lit(float(evaluated or 1))))
    found = by_rule.join(urls, "rule_id", "left").select(F.lit(run_id).alias("run_id"), "rule_id", "scope", "category", F.upper("severity").alias("severity"), F.lit("FAILING").alias("status"), "affected", "instances", F.lit(evaluated).cast("long").alias("evaluated"), reach.alias("reach"), F.coalesce("sample_urls", F.array().cast("array<string>")).alias("sample_urls"))
    pages = store.table("pages")
    known = pages.where(F.col("run_id") == run_id).select("page_id", F.lit(True).alias("_known")) if pages is not None else own.select("page_id", F.lit(True).alias("_known")).limit(0)
    detail = issues.join(known, "page_id", "left").select(F.lit(run_id).alias("run_id"), "rule_id", F.when(F.col("_known"), F.col("page_id")).alias("page_id"), F.upper("severity").alias("severity"), "category", "message", F.transform("evidence", lambda e: e["field"]).alias("evidence_paths"), "evidence")
    return store.sync({"findings": Incoming(found, ("run_id", "rule_id")), "issues": Incoming(detail, ("run_id", "rule_id"), "findings")})
