"""Run folders with absent and broken artifacts, logs, registries and predictions by place."""

import json

import pytest

from tidemark import sources as so
from tidemark.sources import runs as ru


@pytest.fixture
def root(tmp_path):
    def put(path, text):
        p = tmp_path / "my fleet" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("a/kernel.py", "CFG.SEED = 3\nprint(1)\nCFG.SEED=41\n")
    put("a/output/explorer_run_summary.json", json.dumps({"forward_blend_corr": 0.1, "metabolism": {"elapsed_min": 7}, "forensics": {"shipped_selector": ""}, "extra": [1, {"x": 2}]}))
    put("a/output/forensic_selection_decision.json", json.dumps({"winner": "steady"}))
    put("a/output/many_worlds_cv.csv", 'member,floor\n"x, y",0.5\nz,\n')
    put("a/output/second.log", "never read")
    put("a/output/first.log", '{"stream_name":"stderr","time": 1.5}\n{"time":12.25}\nTraceback (most)\n' + "".join(f"line {i}\n" for i in range(9)))
    put("a/output/deep/many_worlds_cv.csv", "member\nhidden\n")
    put("b/output/explorer_run_summary.json", '{"forward_blend_corr": 0.2')
    put("b/output/many_worlds_cv.csv", "floor,other\n1,2\n")
    put("b/output/submission.csv", "id,y\n1,2\n")
    put("c/notes.txt", "no output here")
    return str(tmp_path / "my fleet")


def test_runs_are_folders_with_output(spark, root):
    got = {(r["run"], r["file"]) for r in ru.scan_runs(spark, root).collect()}
    assert {r for r, _ in got} == {"a", "b"} and ("a", "deep/many_worlds_cv.csv") in got and len(got) == 9


def test_artifacts_of_differing_headers(spark, root):
    rows = {(r["run"], r["place"]): r["fields"] for r in ru.artifact_rows(spark, root, "many_worlds_cv.csv").collect()}
    assert rows == {("a", 0): {"member": "x, y", "floor": "0.5"}, ("a", 1): {"member": "z", "floor": ""}, ("b", 0): {"floor": "1", "other": "2"}}
    assert ru.artifact_rows(spark, root, "trap_map.csv").count() == 0


def test_registry_with_absent_and_broken_files(spark, root):
    scores = spark.createDataFrame([("a", 0.08, 0.06), ("a", 0.09, None), ("z", 0.1, 0.1)], "run string, private double, public double")
    rows = {r["run"]: r for r in ru.run_registry(spark, root, scores).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["seed"], a["forward_blend_corr"], a["elapsed_min"], a["selector"], a["best_external_private"], a["external_observations"]) == (41, 0.1, 7.0, "steady", 0.09, 2)
    assert (a["log_file"], a["log_runtime_sec"], a["log_stderr_events"], a["log_tracebacks"]) == ("first.log", 12.25, 1, 1) and a["log_tail"] == "\n".join(f"line {i}" for i in range(1, 9))
    assert json.loads(a["artifact_manifest"]) == {"summary": "a/output/explorer_run_summary.json", "worlds": "a/output/many_worlds_cv.csv"} and a["artifact_count"] == 6 and not a["has_submission"]
    assert (b["forward_blend_corr"], b["seed"], b["log_file"], b["external_observations"], b["has_submission"]) == (None, None, None, 0, True)


def test_predictions_by_place(spark):
    sample = spark.createDataFrame([(0, 10, 0.0), (1, 11, 0.0)], "row_idx long, id long, target double")
    pred = spark.createDataFrame([(1, 0.5), (0, 0.25)], "row_idx long, pred double")
    assert {(r["id"], r["target"]) for r in so.map_to_sample(pred, sample, "target").collect()} == {(10, 0.25), (11, 0.5)}
    with pytest.raises(ValueError, match="prediction length mismatch"):
        so.map_to_sample(pred.limit(1), sample, "target")
    with pytest.raises(ValueError):
        so.map_to_sample(pred.selectExpr("row_idx + 5 as row_idx", "pred"), sample, "target")


def test_runs_are_dealt_to_tasks_and_read_once(spark, tmp_path, monkeypatch):
    from tidemark.plans.artifacts import fleet

    monkeypatch.setattr(ru, "EACH", 2, raising=False)
    spark.range(1, 10).selectExpr("id as s_suppkey", "id % 4 as s_nationkey", "id / 2 as s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.sparkContext.setJobGroup("fleet", "fleet")
    folder = fleet(spark, str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("fleet") for i in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) == 5  # nine runs, two a task
    assert ru.scan_runs(spark, folder).rdd.getNumPartitions() == 5
    out = ru.run_registry(spark, folder, spark.createDataFrame([], "run string, private double, public double"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan binaryFile" not in plan and out.count() == 8


def test_files_without_a_byte_hidden_ones_and_an_output_that_is_a_file(spark, root, tmp_path):
    out = tmp_path / "my fleet" / "b" / "output"
    (out / "trap_map.csv").touch()
    (out / "_SUCCESS").write_text("x")
    (tmp_path / "my fleet" / "d").mkdir()
    (tmp_path / "my fleet" / "d" / "output").write_text("no folder")
    got = {(r["run"], r["file"]): r["bytes"] for r in ru.scan_runs(spark, root).collect()}
    assert got["b", "trap_map.csv"] == 0 and ("b", "_SUCCESS") not in got and {r for r, _ in got} == {"a", "b"} and len(got) == 10
    assert ru.artifact_rows(spark, root, "trap_map.csv").count() == 0


def test_a_store_that_only_spark_can_open(spark, root, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.fleet.link./in", f"file://{tmp_path}")
    scores = spark.createDataFrame([("a", 0.08, 0.06)], "run string, private double, public double")
    columns = sorted(ru.run_registry(spark, root, scores).columns)
    a, b = (sorted(map(tuple, ru.run_registry(spark, r, scores).select(columns).collect())) for r in (root, "viewfs://fleet/in/my fleet"))
    assert a == b and len(a) == 2
    assert ru.artifact_rows(spark, "viewfs://fleet/in/my fleet", "many_worlds_cv.csv").count() == 3
