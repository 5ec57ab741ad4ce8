"""Detectors and job states over event streams whose state ends: with a terminal event, or when a key has been silent for long.

Each processor keeps one small value a key. An event-time timer, moved by every event, drops the value once the watermark passes
the key's last event by the time to live; a terminal event drops it at once. Late events of a key that has ended open a new state,
as a key that is used again would. The streams need the state store of RocksDB (rocks()).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitequarry.streaming.events import TERMINAL

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Job states that end a job, and the events that move one: what happens by state.
FINAL = ("done", "failed", "cancelled")
MOVES = {
    ("", "submitted"): "queued", ("queued", "started"): "running", ("queued", "cancel"): "cancelled", ("running", "cancel"): "stopping", ("running", "finished"): "done", ("running", "failed"): "failed",
    ("stopping", "finished"): "done", ("stopping", "failed"): "cancelled", ("queued", "restarted"): "failed", ("running", "restarted"): "failed", ("stopping", "restarted"): "failed",
}


def rocks(spark: SparkSession) -> None:
    """The state store that these streams need, for the queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Ending(StatefulProcessor):
    """A value a key, dropped by terminal events and by silence. A subclass names the value's columns and folds one row into it."""

    VALUE, START = "", ()

    def __init__(self, ttl_seconds: float, order: str) -> None:
        self.ttl, self.order = int(ttl_seconds * 1000), order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", f"{self.VALUE}, due long")

    def fold(self, value: tuple, row: Any) -> tuple[tuple | None, tuple | None]:
        """(the value after a row, None if it ends there; the row that is put out, or None)"""
        raise NotImplementedError

    def _move_timer(self, was: int, due: int) -> None:
        if was and was != due:
            self.handle.deleteTimer(was)
        if due and was != due:
            self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.value.get() if self.value.exists() else None
        value, due = (tuple(held[:-1]), held[-1]) if held else (None, 0)
        was = due
        out = []
        frame = pd.concat(list(rows))
        for row in frame.sort_values(self.order, kind="stable").itertuples(index=False):
            value, made = self.fold(self.START if value is None else value, row)
            due = max(due, int(row.at.timestamp() * 1000) + self.ttl) if value is not None else 0
            if made is not None:
                out.append((*key, *made))
        self._move_timer(was, due)
        if value is None:
            self.value.clear()
        else:
            self.value.update((*value, due))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield pd.DataFrame([], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class Calibration(Ending):
    """Stops rendering once, of a run's first samples, at least this share gained nothing."""

    VALUE, START, COLUMNS = "n long, lost long", (0, 0), ["run_id", "samples", "without_gain", "stop"]

    def __init__(self, ttl_seconds: float, first: int, least: float) -> None:
        super().__init__(ttl_seconds, "seq")
        self.first, self.least = first, least

    def fold(self, value: tuple, row: Any) -> tuple[tuple | None, tuple | None]:
        n, lost = value
        if row.kind in TERMINAL:
            return None, None
        if n >= self.first or pd.isna(row.gained):
            return value, None
        n, lost = n + 1, lost + (not row.gained)
        return (n, lost), (n, lost, lost / n >= self.least) if n == self.first else None


class AuthLoss(Ending):
    """Warns once a run, of the first 401 or 403 after a success."""

    VALUE, START, COLUMNS = "ok boolean, warned boolean", (False, False), ["run_id", "seq", "url"]

    def __init__(self, ttl_seconds: float) -> None:
        super().__init__(ttl_seconds, "seq")

    def fold(self, value: tuple, row: Any) -> tuple[tuple | None, tuple | None]:
        ok, warned = value
        if row.kind in TERMINAL:
            return None, None
        if pd.isna(row.status_code):
            return value, None
        if 200 <= row.status_code <= 299:
            return (True, warned), None
        if row.status_code in (401, 403) and ok and not warned:
            return (ok, True), (row.seq, row.url)
        return value, None


class Jobs(Ending):
    """Moves jobs between their states; a final state ends a job. Events that a state doesn't know are passed over."""

    VALUE, START, COLUMNS = "state string", ("",), ["job_id", "seq", "state", "at"]

    def __init__(self, ttl_seconds: float) -> None:
        super().__init__(ttl_seconds, "seq")

    def fold(self, value: tuple, row: Any) -> tuple[tuple | None, tuple | None]:
        to = MOVES.get((value[0], row.kind))
        if to is None:
            return (value if value[0] else None), None
        return (None if to in FINAL else (to,)), (row.seq, to, row.at)


def _run(events: DataFrame, key: str, processor: Ending, output: str, watermark: str) -> DataFrame:
    return events.withWatermark("at", watermark).groupBy(key).transformWithStateInPandas(processor, output, "append", "eventTime")


def calibration_stream(samples: DataFrame, first: int = 10, least: float = 0.9, ttl_seconds: float = 86400, watermark: str = "10 minutes") -> DataFrame:
    """(run_id, samples, without_gain, stop) of a stream (run_id, seq, at, kind, gained): a row for a run when its tenth sample has come."""
    return _run(samples.select("run_id", "seq", "at", "kind", "gained"), "run_id", Calibration(ttl_seconds, first, least), "run_id string, samples long, without_gain long, stop boolean", watermark)


def auth_loss_stream(events: DataFrame, ttl_seconds: float = 86400, watermark: str = "10 minutes") -> DataFrame:
    """(run_id, seq, url) of a stream of events: one warning a run."""
    return _run(events.select("run_id", "seq", "at", "kind", "status_code", "url"), "run_id", AuthLoss(ttl_seconds), "run_id string, seq long, url string", watermark)


def job_stream(events: DataFrame, ttl_seconds: float = 7 * 86400, watermark: str = "1 hour") -> DataFrame:
    """(job_id, seq, state, at) of a stream (job_id, seq, at, kind): a row for each change of a job's state."""
    return _run(events.select("job_id", "seq", "at", "kind"), "job_id", Jobs(ttl_seconds), "job_id string, seq long, state string, at timestamp", watermark)


def job_changes(events: DataFrame) -> DataFrame:
    """The same rows of a table of events: each job's events in order are folded by the moves, as a column expression."""
    moves = F.create_map(*[x for (state, kind), to in MOVES.items() for x in (F.lit(f"{state}>{kind}"), F.lit(to))])
    own = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "at"))).alias("events"))

    def step(acc, e):
        # a job that has ended may be submitted again
        now = F.when(acc["state"].isin(*FINAL), F.lit("")).otherwise(acc["state"])
        to = moves[F.concat(now, F.lit(">"), e["kind"])]
        return F.struct(F.coalesce(to, now).alias("state"), F.when(to.isNotNull(), F.array_append(acc["made"], F.struct(e["seq"].alias("seq"), to.alias("state"), e["at"].alias("at")))).otherwise(acc["made"]).alias("made"))

    start = F.struct(F.lit("").alias("state"), F.array().cast("array<struct<seq: bigint, state: string, at: timestamp>>").alias("made"))
    return own.select("job_id", F.explode(F.aggregate("events", start, step)["made"]).alias("m")).select("job_id", "m.seq", "m.state", "m.at")


def job_table(changes: DataFrame, jobs: DataFrame, keep: int = 50) -> DataFrame:
    """Jobs (job_id, priority, submitted_at) with their state and, while they wait, their place; of finished ones beyond `keep` jobs the oldest are left out.

    A waiting job's place is counted from the jobs of higher priorities, of which only the counts are put in order (a row for each
    priority); jobs of one priority are ranked together.
    """
    last = changes.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"))
    own = jobs.join(last, "job_id", "left").withColumn("state", F.coalesce("state", F.lit("queued")))
    waiting = own.where("state = 'queued'")
    higher = Window.orderBy(F.col("priority").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = waiting.groupBy("priority").agg(F.count(F.lit(1)).alias("n")).select("priority", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("ahead"))
    place = waiting.join(ahead, "priority").select("job_id", (F.col("ahead") + F.row_number().over(Window.partitionBy("priority").orderBy("submitted_at", "job_id"))).alias("place"))
    done = own.where(F.col("state").isin(*FINAL)).select("job_id", "submitted_at")
    surplus = own.agg(F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("surplus"))
    oldest = done.orderBy("submitted_at", "job_id").limit(max(0, surplus.first()["surplus"]))
    return own.join(oldest.select("job_id"), "job_id", "left_anti").join(place, "job_id", "left").select("job_id", "priority", "submitted_at", "state", "place")
