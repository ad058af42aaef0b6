"""Folders of runs: `<root>/<run>/output/<artifact>`, read by name with the run taken from the path.

An artifact that a run lacks is absent from its table; a broken one counts as an empty one. Logs and JSON are read as whole texts. A run counts
from its first file in `output`, at whatever depth; hidden files (as Spark's readers have them) do not.

Runs are listed by name in one task, dealt out by number, and each task lists and reads the few files of its own runs through pyarrow's file
systems: no index of all files is made, on the driver or elsewhere. Of a store that pyarrow does not know, Spark's readers make that index.
"""

from __future__ import annotations

import csv
import io
from fnmatch import fnmatchcase
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import safe_float, stable_id
from tidemark.operators.arrow import arrow_map, dealt
from tidemark.operators.keys import written

# The artifacts that a registry names, and their files.
ARTIFACTS = {
    "lessons": "explorer_lessons.csv",
    "shipping": "shipping_court_report.csv",
    "worlds": "many_worlds_cv.csv",
    "path_texture": "path_texture_report.csv",
    "shared_library": "shared_library.csv",
    "trap_map": "trap_map.csv",
    "partial_dynamics": "partial_dynamics_tensor.csv",
    "support_sheaf": "support_sheaf_consistency.csv",
    "feature_topology": "feature_topology_report.csv",
    "summary": "explorer_run_summary.json",
    "ledger": "learning_ledger.json",
    "cairn": "world_cairn.json",
}
# What a registry takes from which file: (column, path in the file, type).
FIELDS = {
    "explorer_run_summary.json": (
        ("forward_blend_corr", "forward_blend_corr", "double"), ("sealed_holdout_corr", "sealed_holdout_corr", "double"), ("shipped_selector", "forensics.shipped_selector", "string"),
        ("elapsed_min", "metabolism.elapsed_min", "double"), ("time_budget_min", "metabolism.time_budget_min", "double"), ("hardware_schedule", "hardware.schedule", "string"), ("gpus", "hardware.gpus", "string"),
    ),
    "complexity_governor.json": (("width_decay_corr", "width_decay_corr", "double"),),
    "regime_criticality.json": (("criticality", "criticality", "string"), ("members_down_weighted", "members_down_weighted", "string")),
    "submission_contract.json": (("rows", "rows", "long"), ("pred_std", "pred_std", "double")),
    "forensic_selection_decision.json": (("winner", "winner", "string"),),
    "extrema_reconciliation.json": (("extrema_method", "selected.method", "string"),),
}


#: Runs that one task lists and reads.
EACH = 500
#: Characters of texts in a batch, about.
AT_ONCE = 1 << 20


def hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))


def store_at(uri: str):
    """(pyarrow file system, path) of a qualified URI; those of local files are plain paths behind `file:`."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").strip("/")
    store, path = fs.FileSystem.from_uri(uri)
    return store, path.rstrip("/")


def qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def run_names(spark: SparkSession, uri: str) -> DataFrame:
    """(run): the folders directly below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for _ in batches:
            store, top = store_at(uri)
            names = [i.base_name for i in store.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.Directory and not hidden(i.base_name)]
            for at in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 10_000], pa.string())], ["run"])

    return arrow_map(spark.range(0, 1, 1, 1), run, "run string")


def run_files(spark: SparkSession, root: str, read: tuple[str, ...] = ()) -> DataFrame:
    """(run, path, bytes, text): every file in the output of every run, by its path in the run; text of those that `read` names, else null.

    read: `output/<pattern>`, or the name of a file beside `output`, which is listed then too.
    """
    uri = qualified(spark, root)
    beside = [r for r in read if "/" not in r]
    patterns = [r.removeprefix("output/") for r in read if "/" in r]
    try:
        store_at(uri)
    except (pa.ArrowInvalid, OSError):
        return files_by_index(spark, root, beside, patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = store_at(uri)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string()))], ["run", "path", "bytes", "text"])

        for b in batches:
            for name in b.column(0).to_pylist():
                own = f"{top}/{name}/"
                try:
                    infos = store.get_file_info(fs.FileSelector(f"{own}output", allow_not_found=True, recursive=True))
                except NotADirectoryError:
                    infos = []
                if beside:
                    infos += store.get_file_info([own + n for n in beside])
                for i in infos:
                    path = i.path[len(own) :]
                    parts = path.split("/")
                    if i.type != fs.FileType.File or any(map(hidden, parts)):
                        continue
                    text = None
                    if len(parts) == 1 or len(parts) == 2 and any(fnmatchcase(parts[1], p) for p in patterns):
                        with store.open_input_stream(i.path, compression=None) as f:
                            text = f.read().decode(errors="replace")
                    rows.append((name, path, i.size, text))
                    size += len(text or "")
                    if size > AT_ONCE or len(rows) == 10_000:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    # The names are written first: they are counted, and listed once.
    return arrow_map(dealt(written(run_names(spark, uri)), EACH), run, "run string, path string, bytes long, text string")


def files_by_index(spark: SparkSession, root: str, beside: list[str], patterns: list[str]) -> DataFrame:
    """run_files by Spark's readers, which do not see files without a byte."""
    top = root.rstrip("/").rsplit("/", 1)[-1]

    def placed(t: DataFrame, *more: Column) -> DataFrame:
        of = lambda i: F.regexp_extract(F.url_decode("path"), rf"/\Q{top}\E/([^/]+)/(output/.+|[^/]+)$", i)
        kept = t.select(of(1).alias("run"), of(2).alias("path"), *more)
        return kept.filter((F.col("run") != "") & (F.col("path").startswith("output/") | F.col("path").isin(beside)))

    files = placed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"), F.col("length").alias("bytes"))
    if not beside + patterns:
        return files.withColumn("text", F.lit(None).cast("string"))
    t = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{" + ",".join(beside + patterns) + "}")
    t = placed(t.select(F.col("_metadata.file_path").alias("path"), "value"), F.col("value").alias("text")).filter(F.col("path").rlike("^(output/)?[^/]+$"))
    return files.join(t, ["run", "path"], "left")


def scan_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, file, bytes): every file in the output of every run; contents are not read."""
    return run_files(spark, root).select("run", in_output(F.col("path")).alias("file"), "bytes")


def in_output(path: Column) -> Column:
    return F.substring(path, len("output/") + 1, 1 << 20)


def texts(spark: SparkSession, root: str, path: str) -> DataFrame:
    """(run, path, text) of the files that `path` names (see run_files), each as one text."""
    return run_files(spark, root, (path,)).filter("text is not null").select("run", "path", "text")


def artifact_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(run, place, fields): the rows of a CSV artifact of all runs, each a map by its own file's header; a file that cannot be read has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = [{k: v for k, v in r.items() if k is not None and isinstance(v, str)} for r in csv.DictReader(io.StringIO(text, newline=""), strict=True)]
                except csv.Error:
                    rows = []
                for at in range(0, len(rows), 10_000):
                    some = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(range(at, at + len(some)), pa.int64()), pa.array([list(r.items()) for r in some], pa.map_(pa.string(), pa.string()))], ["run", "place", "fields"])

    found = texts(spark, root, f"output/{name}").select("run", "text")
    return arrow_map(found, run, "run string, place long, fields map<string,string>")


def json_fields(text: Column, fields: tuple[tuple[str, str, str], ...]) -> dict[str, Column]:
    """Columns of a JSON text, by paths such as `metabolism.elapsed_min`: null where it lacks them or is no JSON."""
    whole = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1  # null where the text is no JSON
    return {c: F.when(whole, F.get_json_object(text, f"$.{path}").try_cast(kind)) for c, path, kind in fields}


def log_health(text: Column, bytes_: Column) -> dict[str, Column]:
    """Columns on a log's text: its size, the largest `"time": x`, how many events on stderr, how many tracebacks, and its last eight lines."""
    times = F.transform(F.regexp_extract_all(text, F.lit(r'"time"\s*:\s*([0-9.]+)'), F.lit(1)), lambda t: t.try_cast("double"))
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.greatest(F.lit(0), F.size(lines) - 1))).otherwise(lines)  # no line after the last end of one
    return {
        "log_bytes": bytes_, "log_runtime_sec": F.array_max(times), "log_stderr_events": F.regexp_count(text, F.lit('"stream_name":"stderr"')), "log_tracebacks": F.regexp_count(text, F.lit("Traceback")),
        "log_tail": F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 7), 8), "\n"),
    }


def first_log(path: Column, text: Column) -> Column:
    """An aggregate: (path, text) of the first log by name."""
    return F.min(F.when(path.rlike(r"^output/[^/]*\.log$"), F.struct(path.alias("path"), text.alias("text"))))


def log_columns(first: Column) -> dict[str, Column]:
    text = first["text"]
    return {"log_file": in_output(first["path"]), **log_health(text, F.octet_length(text).cast("long"))}


def run_logs(spark: SparkSession, root: str) -> DataFrame:
    """(run, log_file, and the columns of log_health): of several logs in a run's output, the first by name."""
    first = texts(spark, root, "output/*.log").groupBy("run").agg(first_log(F.col("path"), F.col("text")).alias("l"))
    return first.select("run", *[c.alias(n) for n, c in log_columns(F.col("l")).items()])


def seed_of(kernel: Column) -> Column:
    """The last `CFG.SEED = n` of a kernel's text."""
    found = F.regexp_extract_all(kernel, F.lit(r"CFG\.SEED\s*=\s*(\d+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).try_cast("long")


def run_registry(spark: SparkSession, root: str, scores: DataFrame) -> DataFrame:
    """One row per run: what its JSON artifacts and log say, its seed, its artifacts, and the best outside scores. scores: (run, private, public).

    Every run's files are listed and read once, for all columns together.
    """
    path, text = F.col("path"), F.col("text")
    files = run_files(spark, root, (*(f"output/{name}" for name in FIELDS), "output/*.log", "kernel.py"))
    inside = path.startswith("output/")
    named = F.create_map(*[F.lit(x) for k, v in ARTIFACTS.items() for x in (f"output/{v}", k)])
    key = F.element_at(named, path)
    entry = F.when(key.isNotNull(), F.struct(key.alias("k"), F.concat("run", F.lit("/"), path).alias("v")))
    runs = files.groupBy("run").agg(
        F.count_distinct(F.when(inside, F.substring_index(in_output(path), "/", 1))).alias("artifact_count"), F.bool_or(path == "output/submission.csv").alias("has_submission"),
        F.to_json(F.map_from_entries(F.sort_array(F.collect_set(entry)))).alias("artifact_manifest"),
        *[F.max(F.when(path == f"output/{name}", text)).alias(name) for name in FIELDS], first_log(path, text).alias("_log"), F.max(F.when(path == "kernel.py", text)).alias("_kernel"),
    ).filter("artifact_count > 0")
    found = {c: v for name, fields in FIELDS.items() for c, v in json_fields(F.col(f"`{name}`"), fields).items()}
    found |= log_columns(F.col("_log")) | {"seed": seed_of(F.col("_kernel"))}
    out = runs.select("run", "artifact_count", "has_submission", "artifact_manifest", stable_id(F.lit("run"), F.col("run")).alias("run_id"), *[v.alias(c) for c, v in found.items()])
    best = scores.groupBy("run").agg(F.max(safe_float("private")).alias("best_external_private"), F.max(safe_float("public")).alias("best_external_public"), F.count("*").alias("external_observations"))
    out = out.join(best, "run", "left").withColumn("external_observations", F.coalesce("external_observations", F.lit(0)))
    return out.withColumn("selector", F.coalesce(F.nullif("shipped_selector", F.lit("")), "winner")).drop("shipped_selector", "winner")
