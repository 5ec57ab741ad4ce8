"""The event log as a stream: replay, rollups by minute, sessions, and the detectors over tables; those over streams are in states.

The same functions of columns run on batch and stream frames; on a stream they carry a watermark, so state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENT = "seq long, run_id string, kind string, at timestamp, url string, status_code int, message string, detail map<string, string>"
TERMINAL = ("crawl-finished", "crawl-failed", "crawl-cancelled")


def stream_log(spark: SparkSession, path: str, schema: str = EVENT, form: str = "json", files: int | None = None) -> DataFrame:
    """An event log as a stream; malformed lines come as null rows and are dropped. The checkpoint of the query is its cursor."""
    reader = spark.readStream.schema(schema).format(form)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = reader.load(path)
    return rows.where(F.col(StructType.fromDDL(schema).fieldNames()[0]).isNotNull())


def after(events: DataFrame, cursor: int) -> DataFrame:
    """Events behind a cursor, the cursor's own left out."""
    return events.where(F.col("seq") > cursor)


def minute_counts(events: DataFrame, ts: str = "at", by: str | None = None, watermark: str | None = "10 minutes") -> DataFrame:
    """Events of each minute."""
    if watermark and events.isStreaming:
        events = events.withWatermark(ts, watermark)
    groups = [F.window(ts, "1 minute").alias("w"), *([by] if by else [])]
    return events.groupBy(*groups).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("minute"), *([by] if by else []), "events")


def sliding_counts(events: DataFrame, ts: str = "at", size: str = "1 hour", step: str = "15 minutes", watermark: str | None = "2 hours") -> DataFrame:
    if watermark and events.isStreaming:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(F.window(ts, size, step).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", watermark: str | None = "1 hour") -> DataFrame:
    """Sessions of each user: events with less than the gap between them."""
    if watermark and events.isStreaming:
        events = events.withWatermark(ts, watermark)
    return events.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def first_seen(events: DataFrame, key: str = "url", ts: str = "at", watermark: str = "1 hour") -> DataFrame:
    """The first event of each key; on a stream among those of the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(ts, "seq"))).where("_r = 1").drop("_r")


def pages_per_minute(minutes: DataFrame) -> DataFrame:
    """Mean over the minutes in which something happened."""
    return minutes.agg(F.avg("events").alias("per_minute"), F.count(F.lit(1)).alias("minutes"))


def calibration(samples: DataFrame, key: str = "run_id", order: str = "seq", gain: str = "gained", first: int = 10, least: float = 0.9) -> DataFrame:
    """Whether rendering pays: of the first samples of a run, stop if at least this share gained nothing."""
    ranked = samples.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= first)
    out = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), F.count_if(~F.col(gain)).alias("without_gain"))
    return out.withColumn("stop", (F.col("samples") >= first) & (F.col("without_gain") / F.col("samples") >= least))


def auth_loss(events: DataFrame) -> DataFrame:
    """The first 401 or 403 of a run after a success: the session was lost."""
    ok = F.min(F.when(F.col("status_code").between(200, 299), F.col("seq"))).over(Window.partitionBy("run_id"))
    lost = events.withColumn("ok", ok).where(F.col("status_code").isin(401, 403) & (F.col("seq") > F.col("ok")))
    return lost.groupBy("run_id").agg(F.min("seq").alias("seq"), F.min_by("url", "seq").alias("url"))


def held_failures(events: DataFrame) -> DataFrame:
    """Failures of URLs that never succeeded later."""
    good = events.where("kind = 'page'").select("run_id", "url", F.col("seq").alias("ok_seq"))
    failed = events.where("kind = 'failure'")
    return failed.join(good, (failed["run_id"] == good["run_id"]) & (failed["url"] == good["url"]) & (good["ok_seq"] > failed["seq"]), "left_anti")


def latest_state(events: DataFrame, key: str, state: str, order: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(state, order).alias(state), F.max(order).alias(order))


def replay(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now into a table in memory, for small results, and reads it."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
