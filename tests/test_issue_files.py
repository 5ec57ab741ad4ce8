"""Issue reports cut at any byte, read in ranges and replaced whole; a store whose loads can be repeated and killed."""

from __future__ import annotations

import io
import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitequarry.sources import issues as files
from sitequarry.sources import store as stores

VALUES = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text(alphabet='a"\\[]{},: é\n😀', max_size=8)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["issues", "a", '"issues": [', "\\"]), x, max_size=3)), max_leaves=6)
ISSUES = st.lists(st.dictionaries(st.sampled_from(["ruleId", "url", "evidence", "issues", "x\\"]), VALUES, max_size=4), max_size=5)


class _Spark:
    class sparkContext:
        defaultParallelism = 2


@settings(max_examples=250, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "issuesx", "z"]), VALUES, max_size=3), ISSUES, st.dictionaries(st.sampled_from(["q", "r"]), VALUES, max_size=2), st.integers(1, 60), st.sampled_from([None, 2]), st.booleans())
def test_any_cut_gives_the_issues(head, issues, tail, size, indent, ascii_only):
    blob = json.dumps(head | {"issues": issues} | tail, indent=indent, ensure_ascii=ascii_only).encode()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(files, "open_bytes", lambda path: io.BytesIO(blob))

        def over(_, rows, schema, run, __):
            names = [c.split()[0] for c in schema.split(", ")]
            return [type("Row", (), d)() for r in rows for b in run(iter([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True))])])) for d in b.to_pylist()]

        patch.setattr(files, "_over", over)
        ranges, _, end, whole = files.issue_ranges(_Spark, "x", size)
        assert whole
        got = [v for a, b in ranges for v in files.whole_values(io.BytesIO(blob), a, b, window=7)]
        assert got == issues
        assert json.loads(blob[: files.issue_ranges(_Spark, "x", size)[1]] + blob[end:]) == head | {"issues": []} | tail


def _issues(spark, n, partitions=3):
    rows = [(f"rule-{k % 4}", "cat", ("error", "warning", "notice", "odd")[k % 4], "page", None if k % 7 == 0 else f"https://e.com/{k}", f"p{k}", f'say "{k}" \\ [x] {{y}}\n', "fix", [("f", f"v{k}"), ("g", None)]) for k in range(n)]
    return spark.createDataFrame(rows, files.SCHEMA).repartition(partitions), rows


def test_round_trip(spark, tmp_path):
    df, rows = _issues(spark, 500)
    path = str(tmp_path / "run" / "issues.json")
    files.write_issues(df, path, {"runId": "r", "healthScore": 71, "counts": {"error": 1}})
    plain = json.load(open(path, encoding="utf-8"))
    rank = {"error": 0, "warning": 1, "notice": 2}
    keys = [(rank.get(i["severity"], 9), i["ruleId"], i["url"] or "") for i in plain["issues"]]
    assert keys == sorted(keys) and len(keys) == 500 and plain["healthScore"] == 71
    for size in (1 << 24, 1000):
        got = files.read_issues(spark, path, size=size)
        assert got.rdd.getNumPartitions() == (1 if size > 10_000 else got.rdd.getNumPartitions()) and (size > 10_000 or got.rdd.getNumPartitions() > 20)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    assert files.read_report(spark, path) == {"runId": "r", "healthScore": 71, "counts": {"error": 1}, "issues": []}
    assert files.read_issues(spark, path, ["rule_id", "url"]).columns == ["rule_id", "url"]
    blob = open(path, "rb").read()
    files.write_issues(df.repartition(5), path, {"runId": "r", "healthScore": 71, "counts": {"error": 1}})
    assert open(path, "rb").read() == blob and [p.name for p in (tmp_path / "run").iterdir() if not p.name.endswith(".crc")] == ["issues.json"]


def test_odd_reports(spark, tmp_path):
    assert files.read_issues(spark, str(tmp_path / "none.json")).collect() == [] and files.read_report(spark, str(tmp_path / "none.json")) is None
    empty = tmp_path / "empty.json"
    files.write_issues(_issues(spark, 1)[0].limit(0), str(empty))
    assert json.load(open(empty)) == {"issues": []} and files.read_issues(spark, str(empty)).collect() == []
    cut_off = tmp_path / "cut.json"
    whole = json.dumps({"runId": "r", "issues": [{"ruleId": f"r{k}", "evidence": [{"field": "f", "value": {"n": k}}]} for k in range(50)]})
    cut_off.write_text(whole[: len(whole) // 2])
    with pytest.raises(ValueError):
        files.read_issues(spark, str(cut_off))
    some = [r.rule_id for r in files.read_issues(spark, str(cut_off), tolerant=True, size=100).collect()]
    assert 15 < len(some) < 30 and sorted(some) == sorted(f"r{k}" for k in range(len(some)))
    (tmp_path / "plain.json").write_text('{"other": [1]}')
    assert files.read_issues(spark, str(tmp_path / "plain.json")).collect() == []


def test_a_killed_writer_leaves_the_old_report(spark, tmp_path, monkeypatch):
    path = tmp_path / "issues.json"
    files.write_issues(_issues(spark, 5)[0], str(path))
    before = path.read_bytes()
    monkeypatch.setattr(files, "replace_file", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        files.write_issues(_issues(spark, 50)[0], str(path))
    assert path.read_bytes() == before


def _run(spark, n):
    pages = spark.createDataFrame([("r", f"p{k}", f"https://e.com/{k}") for k in range(n)] + [("r", "p0", "https://e.com/again")], "run_id string, page_id string, url string")
    links = spark.createDataFrame([("r", f"p{k}", j, f"t{j}") for k in range(n) for j in range(k % 3)], "run_id string, page_id string, position int, target string")
    failures = spark.createDataFrame([("r", f"u{k}") for k in range(n)] + [("r", "u0")], "run_id string, url string")
    return pages, {"links": links}, {"failures": (failures, ("run_id", "url"))}


def _content(store):
    return {n: sorted(map(repr, store.table(n).collect())) for n in ("pages", "links", "failures")}


def test_sync_can_be_repeated_and_resumed(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "a"))
    assert store.table("pages") is None
    assert stores.sync_run(store, *_run(spark, 5)) == {"pages": 5, "links": 4, "failures": 5}
    first = _content(store)
    assert stores.sync_run(store, *_run(spark, 5)) == {"pages": 0, "links": 0, "failures": 0}
    assert _content(store) == first and store.manifest()["number"] == 1
    assert stores.sync_run(store, *_run(spark, 9)) == {"pages": 4, "links": 5, "failures": 4}
    other = stores.Store(spark, str(tmp_path / "b"))
    stores.sync_run(other, *_run(spark, 9))
    assert {k: v for k, v in _content(store).items() if k != "pages"} == {k: v for k, v in _content(other).items() if k != "pages"}
    assert store.table("pages").select("page_id").distinct().count() == store.table("pages").count() == 9
    assert store.vacuum() == 0


def test_killed_sync(spark, tmp_path, monkeypatch):
    """Killed while tables are written, and between the tables and the manifest: nothing is seen, and the next load is whole."""
    store = stores.Store(spark, str(tmp_path / "s"))
    stores.sync_run(store, *_run(spark, 3))
    before = _content(store)
    with monkeypatch.context() as patch:
        patch.setattr(stores, "replace_file", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            stores.sync_run(store, *_run(spark, 6))
    assert _content(store) == before
    bad = _run(spark, 6)
    bad[1]["links"] = bad[1]["links"].withColumn("target", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        stores.sync_run(store, *bad)
    assert _content(store) == before
    assert stores.sync_run(store, *_run(spark, 6)) == {"pages": 3, "links": 3, "failures": 3}
    assert store.vacuum() >= 3 and store.table("links").count() == 6


def test_two_loads_at_once(spark, tmp_path, monkeypatch):
    """The second to commit finds the number taken, and begins again from the other's manifest."""
    store, other = (stores.Store(spark, str(tmp_path / "s")) for _ in range(2))
    real, once = store._commit, []

    def late(was, added):
        if not once:
            once.append(1)
            stores.sync_run(other, *_run(spark, 4))
        return real(was, added)

    monkeypatch.setattr(store, "_commit", late)
    assert stores.sync_run(store, *_run(spark, 6)) == {"pages": 2, "links": 3, "failures": 2}
    assert store.table("pages").count() == 6 and store.manifest()["number"] == 2


def test_findings_once(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    stores.sync_run(store, *_run(spark, 8))
    df, rows = _issues(spark, 40)
    assert stores.import_findings(store, "r", df, 20) == {"findings": 4, "issues": 40}
    got = {r.rule_id: r for r in store.table("findings").collect()}
    own = [r for r in rows if r[0] == "rule-1"]
    assert (got["rule-1"].affected, got["rule-1"].instances, got["rule-1"].severity, round(got["rule-1"].reach, 9)) == (10, 10, "WARNING", round((10 / 20) ** 0.5, 9))
    assert got["rule-1"].sample_urls == sorted({r[4] for r in own if r[4]})[:5]
    assert {r.page_id for r in store.table("issues").collect()} == {None, *(f"p{k}" for k in range(8))}
    assert stores.import_findings(store, "r", df, 20) == {"findings": 0, "issues": 0}
