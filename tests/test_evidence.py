import hashlib
import json
import os

import pytest
from conftest import one, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from traceframe.sources import evidence as E
from traceframe.sources import integrity as N
from traceframe.streaming import feeds as S


def test_files_against_a_seal(spark, tmp_path):
    run = tmp_path / "run-1"
    run.mkdir()
    (run / "traces.jsonl").write_text('{"a": 1}\n')
    (run / "tasks.jsonl").write_text("x")
    (run / "extra.jsonl").write_text("y")
    good = hashlib.sha256(b'{"a": 1}\n').hexdigest()
    seal = spark.createDataFrame([("run-1", {"traces.jsonl": good, "tasks.jsonl": "0" * 64, "probes.jsonl": good})],
                                 "run_id string, files map<string,string>")
    out = N.file_integrity(N.seal_entries(seal), N.file_digests(spark, f"{run}/*.jsonl"))
    assert {r["name"]: r["status"] for r in rows(out)} == {
        "traces.jsonl": "ok", "tasks.jsonl": "mismatch", "probes.jsonl": "missing", "extra.jsonl": "undeclared"}


def test_seal_change_verify(spark):
    """Every way a run can fail: units changed, lost or added, seals lost, cut off, altered or of other entries, other manifests."""
    runs = ["good", "changed", "lost", "added", "no_seal", "cut", "altered", "foreign", "manifest", "no_manifest"]
    units = spark.createDataFrame([(r, f"u{i}", hashlib.sha256(f"{r}{i}".encode()).hexdigest()) for r in runs for i in range(40)], "run_id string, name string, actual string")
    manifests = spark.createDataFrame([(r, f"m-{r}") for r in runs], "run_id string, manifest_sha256 string")
    entries = units.withColumnRenamed("actual", "expected")
    run, name = F.col("run_id"), F.col("name")
    seals = N.seal_table(units, manifests, leaf=4).where(run != "no_seal")
    seals = seals.withColumn("entries_sha256", F.when(run == "foreign", F.lit("f" * 64)).when(run != "cut", F.col("entries_sha256")))
    seals = seals.withColumn("seal_sha256", F.when(run == "foreign", N.seal_digest("run_id")).otherwise(F.col("seal_sha256")))
    seals = seals.withColumn("n_units", F.when(run == "altered", 41).otherwise(F.col("n_units")))
    now = units.where(~((run == "lost") & (name == "u7"))).withColumn("actual", F.when((run == "changed") & (name == "u3"), "0").otherwise(F.col("actual")))
    now = now.unionByName(spark.createDataFrame([("added", "extra", "1")], now.schema))
    current = manifests.where(run != "no_manifest").withColumn("manifest_sha256", F.when(run == "manifest", "other").otherwise(F.col("manifest_sha256")))
    out = {r["run_id"]: r for r in rows(N.verify_runs(seals, entries, now, current, leaf=4))}
    assert {r for r in runs if out[r]["passed"]} == {"good"}
    assert {r: out[r]["seal"] for r in runs if out[r]["seal"] != "ok"} == {"no_seal": "missing", "cut": "corrupt", "altered": "corrupt", "foreign": "mismatching"}
    assert (out["changed"]["n_mismatch"], out["lost"]["n_missing"], out["added"]["n_undeclared"]) == (1, 1, 1)
    assert not out["manifest"]["manifest_ok"] and not out["no_manifest"]["manifest_ok"] and out["changed"]["manifest_ok"]


def test_create_once(spark, tmp_path):
    E.write_once(spark.range(3).toDF("x"), f"{tmp_path}/t")
    with pytest.raises(AnalysisException):
        E.write_once(spark.range(5).toDF("x"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_scan_skips_blank_lines_and_keeps_corrupt_ones(spark, tmp_path):
    good = {"run_id": "r", "trial_id": "a", "task_id": "t", "condition_id": "c", "condition": {"mode": "greedy", "repeat": 0},
            "termination": {"capped": False}, "trace": {"token_ids": [1, 2]}}
    odd = {**good, "trial_id": "b", "condition_id": "x", "condition": {"mode": "greedy", "repeat": 1}}
    lines = [json.dumps(good), "", json.dumps(good), json.dumps(odd), json.dumps({**odd, "trial_id": "c", "trace": None}), '{"run_id": "r", "tri']
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "traces.jsonl").write_text("\n".join(lines))
    traces = E.scan_traces(spark, f"{tmp_path}/*/traces.jsonl")
    assert traces.count() == 5
    flat = rows(E.flat_records(traces).where("trial_id = 'a'"))
    assert flat[0]["tokens"] == [1, 2] and flat[0]["presentation_id"] == "t" and flat[0]["seed"] is None
    declared = spark.createDataFrame([("r", "c")], "run_id string, condition_id string")
    runs = spark.createDataFrame([("r", None, "s", None)], "run_id string, deployment_id string, source_artifact_id string, weight_variant_id string")
    faults = {(r["error"], r["item"]): r["n"] for r in rows(N.structural_audit(traces, declared, runs))}
    assert faults == {("unreadable", ""): 1, ("fields_absent", "trace"): 1, ("id_repeated", "a"): 1,
                      ("key_repeated", "t/greedy/null/0"): 1, ("condition_unknown", "x"): 1}
    silent = {(r["error"], r["item"]) for r in rows(N.structural_audit(traces, declared.limit(0), runs))}
    assert ("conditions_undeclared", "") in silent and ("condition_unknown", "x") not in silent


def test_absent_probes_are_an_empty_table(spark, tmp_path):
    assert E.scan_probes(spark, [f"{tmp_path}/none.jsonl"]).count() == 0


def test_manifests_keep_known_fields_and_latest_run(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}" / "manifest.json").write_text(json.dumps({"run_id": f"r{i}", "spec": {"max_tokens": 5, "odd": 1}}, indent=2))
    runs = E.scan_runs(spark, f"{tmp_path}/*/manifest.json")
    assert {r["run_id"] for r in rows(runs)} == {"r1", "r2"} and "odd" not in runs.schema["spec"].dataType.fieldNames()
    same_time = runs.select(F.lit(0).alias("g"), F.lit(1).alias("modified"), "run_id")
    assert one(E.latest_run(same_time, ["g"], "modified", "run_id"))["run_id"] == "r2"


def test_redaction_and_secrets(spark):
    df = spark.createDataFrame([(1, "see /Users/ann/x", "plain"), (2, "clean", "hf_" + "a" * 24)], "id long, path string, note string")
    assert rows(N.redact(df, ["path"]), "id")[0]["path"] == "see /REDACTED_HOME/x"
    assert [(r["id"], r["location"]) for r in rows(N.redaction_log(df, "id", ["path", "note"]))] == [(1, "path")]
    assert [(r["id"], r["location"]) for r in rows(N.secret_scan(df, "id", ["path", "note"]))] == [(2, "note")]
    with pytest.raises(ValueError):
        N.require_no_secrets(df, "id", ["note"])
    with pytest.raises(Exception, match="protected content: path"):
        N.redact(df, ["path"], protected=["path"]).collect()


def test_stream_ingest_is_exactly_once_and_picks_up_new_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"trial_id": "1", "ts": "2024-01-01 00:00:00"}\n{"trial_id": "1", "ts": "2024-01-01 00:05:00"}\n')
    schema = "trial_id string, ts timestamp"

    def run(name, shape):
        stream = shape(S.file_stream(spark, str(source), schema))
        S.stream_ingest(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-mark").awaitTermination()
        return sorted(r["trial_id"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect())

    keep = lambda s: s
    first = lambda s: S.first_arrivals(s, F.col("ts"), ["trial_id"], "1 hour")
    assert run("all", keep) == ["1", "1"] and run("unique", first) == ["1"]
    (source / "b.json").write_text('{"trial_id": "1", "ts": "2024-01-01 00:20:00"}\n{"trial_id": "2", "ts": "2024-01-01 00:20:00"}\n')
    assert run("all", keep) == ["1", "1", "1", "2"] and run("unique", first) == ["1", "2"]


def test_streams_forget_what_the_watermark_has_passed(spark, tmp_path):
    """A file an hour: sessions are told once they are over, keys leave the state, late rows are dropped and counted."""
    source = tmp_path / "in"
    source.mkdir()
    lines = lambda hour, extra=(): "\n".join(json.dumps({"trial_id": f"{hour}-{i}", "run": "r", "ts": f"2024-01-01 {hour:02}:{i // 2:02}:00"}) for i in range(20)) + "".join("\n" + x for x in extra)
    late = json.dumps({"trial_id": "0-0", "run": "r", "ts": "2024-01-01 00:00:00"})
    for hour in range(8):
        (source / f"{hour}.json").write_text(lines(hour, [late] if hour == 5 else []))
        os.utime(source / f"{hour}.json", (1_700_000_000 + hour, 1_700_000_000 + hour))
    stream = lambda: S.file_stream(spark, str(source), "trial_id string, run string, ts timestamp", files_per_trigger=1)
    unique = S.stream_ingest(S.first_arrivals(stream(), F.col("ts"), ["trial_id"], "30 minutes"), f"{tmp_path}/u", f"{tmp_path}/um")
    unique.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/u").count() == 160 and S.late_rows(unique) == 1
    assert max(S.state_rows(unique)) <= 60
    sessions = S.stream_ingest(S.activity_sessions(stream(), F.col("ts"), "run", "10 minutes", "30 minutes"), f"{tmp_path}/s", f"{tmp_path}/sm")
    sessions.awaitTermination()
    told = rows(spark.read.parquet(f"{tmp_path}/s"), "active_from")
    assert [(r["active_from"].hour, r["n_events"]) for r in told] == [(h, 20) for h in range(7)] and S.late_rows(sessions) == 1
    assert max(S.state_rows(sessions)) <= 3


def test_stored_records_are_compressed_files_of_bounded_size(spark, tmp_path):
    from traceframe.catalog import evidence as Q

    records = spark.range(1000).select(F.concat(F.lit("run-"), F.col("id") % 2).alias("run_id"), F.col("id").cast("string").alias("trial_id"), F.lit("task-1").alias("task_id"))
    path = str(tmp_path / "traces")
    E.write_once(records.coalesce(1), path, "json", **(Q.STORED | {"maxRecordsPerFile": "300"}))
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 4 and all(f.endswith(".json.gz") for f in files)
    assert {(r["run_id"], r["trial_id"]) for r in E.scan_traces(spark, path).collect()} == {(f"run-{i % 2}", str(i)) for i in range(1000)}


def test_manifests_are_listed_in_few_files(spark, tmp_path):
    """Every supplier has its row, once, a null name included, from files of up to about a thousand manifests."""
    from traceframe.catalog import load_catalog

    suppliers = spark.range(2500).select(
        F.col("id").alias("s_suppkey"), F.when(F.col("id") != 7, F.concat(F.lit("s-"), "id")).alias("s_name"), (F.col("id") % 25).alias("s_nationkey"), (F.col("id") - 5.5).alias("s_acctbal"))
    suppliers.unionByName(suppliers.where("s_suppkey < 3")).write.parquet(str(tmp_path / "supplier.parquet"))
    out = load_catalog()[0]["scan_runs"](spark, str(tmp_path))
    assert len(out.inputFiles()) == 3
    got = {r["run_id"]: r for r in out.collect()}
    assert len(got) == out.count() == 2500 and got["run-7"]["presentation"] is None and got["run-5"]["max_tokens"] is None
    assert all(got[f"run-{i}"]["max_tokens"] == i % 25 and got[f"run-{i}"]["n_conditions"] == 1 + i % 25 % 2 for i in range(6, 2500))
