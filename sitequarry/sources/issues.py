"""Issue reports as one JSON file: written whole or not at all, and read by all cores however large the file is.

A JSON file can't be cut at any byte, as whether a byte is inside a string depends on all before it. A first pass over equal
ranges notes, for either state a range may begin in, the state it ends in and how much deeper; the few numbers of each range
are put together in order. A second pass, which knows each range's state, finds the first issue that begins in it and the end of the
array. From then on a range is read as a run of whole issues, in windows of a few megabytes.
"""

from __future__ import annotations

import codecs
import json
import re
import uuid
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sitequarry.plans.lineage import drop_path, shared_folder

#: Fields of an issue in the file, by column.
NAMES = {"rule_id": "ruleId", "category": "category", "severity": "severity", "scope": "scope", "url": "url", "page_id": "pageId", "message": "message", "how_to_fix": "howToFix", "evidence": "evidence"}
SCHEMA = "rule_id string, category string, severity string, scope string, url string, page_id string, message string, how_to_fix string, evidence array<struct<field: string, value: string>>"
KEY = re.compile(rb'"issues"\s*:\s*\[')
#: Bytes of a range, of a window of reading, and behind a range in which a key that begins there may end.
RANGE, WINDOW, BEYOND = 16 << 20, 4 << 20, 4096
#: Order of severities in a report.
SEVERITIES = ("error", "warning", "notice")


def open_bytes(path: str) -> BinaryIO:
    """A file that tasks can open: local, or of any store that Arrow knows by its URI."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
        return system.open_input_file(inner)
    return open(path, "rb")


def _size(file: BinaryIO) -> int:
    file.seek(0, 2)
    return file.tell()


def _bytes(file: BinaryIO, start: int, end: int) -> tuple[int, np.ndarray]:
    """Begin and bytes of a range whose ends are moved behind backslashes, so that none begins with an escaped character."""

    def moved(at: int) -> int:
        while at > 0:
            file.seek(at - 1)
            if file.read(1) != b"\\":
                break
            at += 1
        return at

    start, end = moved(start), moved(end)
    file.seek(start)
    return start, np.frombuffer(file.read(end - start), np.uint8)


def _structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Per byte: quotes before it, modulo 2, and +1 or -1 for brackets wherever they stand; whether the quotes are odd."""
    quote = data == 0x22
    slash = data == 0x5C
    if slash.any():
        at = np.flatnonzero(quote)
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        run = at - 1 - np.where(at > 0, plain[np.maximum(at - 1, 0)], -1)
        quote = quote.copy()
        quote[at[run % 2 == 1]] = False
    upto = np.cumsum(quote, dtype=np.int64)
    step = ((data == 0x7B) | (data == 0x5B)).astype(np.int8) - ((data == 0x7D) | (data == 0x5D)).astype(np.int8)
    return ((upto - quote) & 1).astype(bool), step, bool(len(data) and upto[-1] & 1)


def profile(data: np.ndarray, beyond: bytes = b"") -> list[dict]:
    """For a range that begins outside (0) and inside (1) a string: how it ends, how much deeper, and where the key of issues stands at which depth."""
    parity, step, odd = _structure(data)
    out = []
    found = [m for m in KEY.finditer(data.tobytes() + beyond) if m.start() < len(data)]
    for inside in (False, True):
        depth = np.cumsum(np.where(parity == inside, step, 0), dtype=np.int64)
        keys = [(m.start(), m.end(), int(depth[m.start()])) for m in found if parity[m.start()] == inside]
        out.append({"inside": odd != inside, "deeper": int(depth[-1]) if len(depth) else 0, "keys": keys})
    return out


def first_issue(data: np.ndarray, inside: bool, depth: int) -> tuple[int | None, int | None]:
    """Of a range that begins in this state, depth 2 being inside the array: where the first issue begins, and where the array ends."""
    parity, step, _ = _structure(data)
    step = np.where(parity == inside, step, 0)
    after = depth + np.cumsum(step, dtype=np.int64)
    close = np.flatnonzero((after < 2) & (step == -1))
    begin = np.flatnonzero((after == 3) & (step == 1) & (data == 0x7B))
    return int(begin[0]) if len(begin) else None, int(close[0]) if len(close) else None


def _over(spark: SparkSession, rows: list[tuple], schema: str, run, out: str) -> list:
    """run over each row, one task a row; what returns is a few numbers a row."""
    if not rows:
        return []
    return spark.createDataFrame(rows, schema).repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, out).collect()


def issue_ranges(spark: SparkSession, path: str, size: int = RANGE) -> tuple[list[tuple[int, int]], int, int, bool]:
    """(ranges of whole issues, begin and end of the array, whether the array is closed) of a report."""
    with open_bytes(path) as file:
        total = _size(file)
    spans = [(k, at, min(total, at + size)) for k, at in enumerate(range(0, total, size))]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_bytes(path) as file:
                    start, data = _bytes(file, r["a"], r["b"])
                    file.seek(start + len(data))
                    yield pa.RecordBatch.from_pydict({"k": [r["k"]], "start": [start], "n": [len(data)], "told": [json.dumps(profile(data, file.read(BEYOND)))]})

    told = sorted(_over(spark, spans, "k long, a long, b long", one, "k long, start long, n long, told string"), key=lambda r: r.k)
    inside, depth, states, opened = False, 0, [], None
    for r in told:
        states.append((r.start, r.start + r.n, inside, depth))
        own = json.loads(r.told)[inside]
        if opened is None:
            opened = next((r.start + end for _, end, deeper in own["keys"] if depth + deeper == 1), None)
        inside, depth = own["inside"], depth + own["deeper"]
    if opened is None:
        return [], total, total, not inside and depth == 0
    known = [(max(a, opened), b, inside and a >= opened, depth if a >= opened else 2) for a, b, inside, depth in states if b > opened]

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_bytes(path) as file:
                    file.seek(r["a"])
                    begin, close = first_issue(np.frombuffer(file.read(r["b"] - r["a"]), np.uint8), r["inside"], r["depth"])
                yield pa.RecordBatch.from_pydict({"begin": pa.array([None if begin is None else r["a"] + begin], pa.int64()), "close": pa.array([None if close is None else r["a"] + close], pa.int64())})

    places = _over(spark, known, "a long, b long, inside boolean, depth long", two, "begin long, close long")
    closes = [r.close for r in places if r.close is not None]
    end = min(closes, default=total)
    begins = sorted(r.begin for r in places if r.begin is not None and r.begin < end)
    return list(zip(begins, [*begins[1:], end][: len(begins)], strict=True)), opened, end, bool(closes) and not inside and depth == 0


class Issues(DataSource):
    """Format `issues_json`: the issues of one report. Columns that aren't in the schema asked for are not built."""

    @classmethod
    def name(cls) -> str:
        return "issues_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return IssuesReader(schema, dict(self.options))


class IssuesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.path = schema.fieldNames(), options["path"]
        self.ranges, self.tolerant = json.loads(options["ranges"]), options.get("tolerant") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.ranges] or [InputPartition([0, 0])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = {n: pa.list_(pa.struct([("field", pa.string()), ("value", pa.string())])) if n == "evidence" else pa.string() for n in self.names}
        start, end = partition.value
        rows: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_value(r, n) for r in rows], k) for n, k in kinds.items()], names=list(kinds))

        with open_bytes(self.path) as file:
            try:
                for issue in whole_values(file, start, end):
                    rows.append(issue)
                    if len(rows) >= 2000:
                        yield batch()
                        rows.clear()
            except ValueError:
                if not self.tolerant:
                    raise
        if rows:
            yield batch()


def _value(issue: dict, name: str) -> Any:
    value = issue.get(NAMES.get(name, name)) if isinstance(issue, dict) else None
    if name == "evidence":
        return [{"field": _text(e.get("field")), "value": _text(e.get("value"))} for e in value if isinstance(e, dict)] if isinstance(value, list) else None
    return _text(value)


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def whole_values(file: BinaryIO, start: int, end: int, window: int = WINDOW) -> Iterator[Any]:
    """The values of a run of JSON values with commas between; ValueError for what is none."""
    decoder, take = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder().raw_decode
    text, at = "", start
    while True:
        file.seek(at)
        more = file.read(min(window, end - at)) if at < end else b""
        at += len(more)
        text += decoder.decode(more, final=not more)
        place = 0
        while True:
            while place < len(text) and text[place] in ", \t\r\n":
                place += 1
            if place == len(text):
                break
            try:
                value, place = take(text, place)
            except json.JSONDecodeError:
                if not more:
                    raise
                break
            yield value
        text = text[place:]
        if not more:
            return


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_issues(spark: SparkSession, path: str, columns: list[str] | None = None, tolerant: bool = False, size: int = RANGE) -> DataFrame:
    """The issues of a report, `columns` of them; no rows where a run was never analysed.

    A report that is cut off or isn't JSON is an error; if tolerant, the issues before the place where it breaks remain.
    """
    kind = StructType.fromDDL(SCHEMA)
    kind = StructType([f for f in kind.fields if columns is None or f.name in columns])
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    ranges, _, _, whole = issue_ranges(spark, path, size)
    if not whole and not tolerant:
        raise ValueError(f"{path} is cut off or isn't JSON")
    spark.dataSource.register(Issues)
    return spark.read.format("issues_json").schema(kind).option("path", path).option("ranges", json.dumps(ranges)).option("tolerant", str(tolerant).lower()).load()


def read_report(spark: SparkSession, path: str, size: int = RANGE) -> dict | None:
    """A report without its issues (what is left has to be small), or None where a run was never analysed."""
    if not _exists(spark, path):
        return None
    _, begin, end, _ = issue_ranges(spark, path, size)
    with open_bytes(path) as file:
        total = _size(file)
        if begin + total - end > 64 << 20:
            raise ValueError(f"{path}: over 64 MB beside the issues")
        file.seek(0)
        head = file.read(begin)
        file.seek(end)
        return json.loads(head + file.read(total - end))


def write_issues(issues: DataFrame, path: str, report: dict | None = None) -> None:
    """One JSON file of a report and its issues by severity, rule and URL, so that the same analysis gives the same bytes.

    Tasks write the issues' text in parts; the parts follow one another into a new file beside the target, which takes its name in one
    step: a reader sees the old report or the new one, and a writer that is killed leaves the old one.
    """
    spark = issues.sparkSession
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    fields = [F.col(c).alias(n) for c, n in NAMES.items() if c in issues.columns]
    line = F.concat(F.lit(",\n    "), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    ordered = issues.select(F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank).alias("_rank"), "rule_id", F.coalesce("url", F.lit("")).alias("_url"), line.alias("value")).orderBy("_rank", "rule_id", "_url", "value").select("value")
    parts = f"{shared_folder(spark)}/issues-{uuid.uuid4().hex}"
    ordered.write.option("lineSep", "\n").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(conf)
    fresh = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    try:
        out = system.create(fresh, True)
        head = json.dumps(report or {}, ensure_ascii=False, sort_keys=True)
        out.write((head[:-1] + (", " if len(head) > 2 else "") + '"issues": [').encode())
        files = hadoop.Path(parts).getFileSystem(conf).globStatus(hadoop.Path(parts, "part-*"))
        first = True
        for status in sorted(files, key=lambda s: s.getPath().getName()):
            if status.getLen() == 0:
                continue
            source = status.getPath().getFileSystem(conf).open(status.getPath())
            source.skip(1 if first else 0)  # the comma before the first issue
            first = False
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
        out.write(b"]}\n")
        out.close()
        replace_file(spark, fresh, target)
    finally:
        system.delete(fresh, False)
        drop_path(spark, parts)


def replace_file(spark: SparkSession, fresh: Any, target: Any, overwrite: bool = True) -> None:
    """Gives a file another's name in one step; without overwrite it is an error if that name is taken."""
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    mode = spark.sparkContext._gateway.new_array(kind, 1)
    mode[0] = kind.OVERWRITE if overwrite else kind.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, mode)
