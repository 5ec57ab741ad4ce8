"""Stateful streams against their batch forms, over restarts; what they keep after terminal events and after silence."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sitequarry.streaming import events as ev
from sitequarry.streaming import states

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    states.rocks(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r | {"at": (T0 + dt.timedelta(seconds=r["at"])).isoformat()}) + "\n" for r in rows))


def _advance(spark, make, schema, folder, out, checkpoint):
    """One start of the query over what has come, from its checkpoint."""
    stream = make(ev.stream_log(spark, str(folder), schema, files=1))
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def _held(spark, checkpoint):
    return spark.read.format("statestore").option("stateVarName", "value").load(str(checkpoint)).selectExpr("key.*").count()


EVENTS = "seq long, run_id string, kind string, at timestamp, url string, status_code int, gained boolean"


def test_detectors_over_restarts(spark, tmp_path, rocks):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        run = f"r{k % 3}"
        rows.append({"seq": k, "run_id": run, "kind": "page", "at": 10 * k, "url": f"u{k}", "status_code": rng.choice([200, 200, 401, 403, None]), "gained": rng.random() < 0.1})
    parts = [rows[:25], rows[25:45], rows[45:]]
    makes = {"lost": lambda s: states.auth_loss_stream(s, ttl_seconds=3600), "calibration": lambda s: states.calibration_stream(s, ttl_seconds=3600)}
    for k, part in enumerate(parts):
        _write(tmp_path / "log", f"{k}.json", part)
        for name, make in makes.items():
            _advance(spark, make, EVENTS, tmp_path / "log", tmp_path / name, tmp_path / f"{name}-c")
    table = spark.read.schema(EVENTS).json(str(tmp_path / "log"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "lost")).collect())) == sorted(map(tuple, ev.auth_loss(table).collect())) != []
    want = [tuple(r) for r in ev.calibration(table).collect()]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "calibration")).collect())) == sorted(want) and len(want) == 3
    assert _held(spark, tmp_path / "lost-c") == 3
    # r0 ends, r1 and r2 fall silent: a much later run moves the watermark past them
    _write(tmp_path / "log", "3.json", [{"seq": 100, "run_id": "r0", "kind": "crawl-finished", "at": 700}])
    _advance(spark, makes["lost"], EVENTS, tmp_path / "log", tmp_path / "lost", tmp_path / "lost-c")
    assert _held(spark, tmp_path / "lost-c") == 2
    for k in (4, 5):
        _write(tmp_path / "log", f"{k}.json", [{"seq": 100 + k, "run_id": "r9", "kind": "page", "at": 90_000 + k, "status_code": 200}])
        _advance(spark, makes["lost"], EVENTS, tmp_path / "log", tmp_path / "lost", tmp_path / "lost-c")
    assert _held(spark, tmp_path / "lost-c") == 1


def test_jobs_by_stream_and_by_table(spark, tmp_path, rocks):
    rng = random.Random(2)
    kinds = ["submitted", "submitted", "started", "started", "started", "cancel", "finished", "failed", "restarted", "noise"]
    rows = [{"seq": k, "job_id": f"j{rng.randrange(6)}", "kind": rng.choice(kinds), "at": k} for k in range(450)]
    schema = "seq long, job_id string, kind string, at timestamp"
    for k in range(3):
        _write(tmp_path / "log", f"{k}.json", rows[k * 150 : (k + 1) * 150])
        _advance(spark, lambda s: states.job_stream(s, ttl_seconds=10_000), schema, tmp_path / "log", tmp_path / "out", tmp_path / "c")
    got = sorted((r.job_id, r.seq, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    state, want = {}, []
    for r in rows:
        now = state.get(r["job_id"], "")
        to = states.MOVES.get(("" if now in states.FINAL else now, r["kind"]))
        if to:
            state[r["job_id"]] = to
            want.append((r["job_id"], r["seq"], to))
    assert got == sorted(want) and {s for _, _, s in want} >= {"queued", "running", "stopping", "done", "failed", "cancelled"}
    table = spark.read.schema(schema).json(str(tmp_path / "log"))
    assert sorted((r.job_id, r.seq, r.state) for r in states.job_changes(table).collect()) == sorted(want)
    assert _held(spark, tmp_path / "c") == sum(s not in states.FINAL for s in state.values())


def test_job_table(spark):
    changes = spark.createDataFrame([("a", 1, "queued"), ("b", 2, "queued"), ("c", 3, "queued"), ("c", 5, "running"), ("c", 6, "done"), ("d", 4, "queued"), ("e", 7, "failed"), ("f", 8, "running")], "job_id string, seq long, state string")
    jobs = spark.createDataFrame([("a", 1, 5), ("b", 2, 9), ("c", 9, 1), ("d", 1, 2), ("e", 0, 3), ("f", 5, 4), ("g", 1, 9)], "job_id string, priority int, submitted_at int")
    got = {r.job_id: (r.state, r.place) for r in states.job_table(changes, jobs).collect()}
    assert got == {"b": ("queued", 1), "d": ("queued", 2), "a": ("queued", 3), "g": ("queued", 4), "c": ("done", None), "e": ("failed", None), "f": ("running", None)}
    kept = {r.job_id for r in states.job_table(changes, jobs, keep=6).collect()}
    assert kept == {"a", "b", "d", "e", "f", "g"} and F is not None
