"""Queries on run folders, which Spark writes from rows of the given tables, and on predictions and reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import sources as so
from tidemark.operators.arrow import arrow_map, dealt
from tidemark.operators.keys import row_index, shared_root
from tidemark.plans.queries import query, rounded, table
from tidemark.sources import runs as ru


def fresh_folder(spark: SparkSession, what: str) -> str:
    """An unused folder beside the checkpoints, which all executors reach."""
    return f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def fleet(spark: SparkSession, d: str) -> str:
    """A folder with a run per supplier: a summary (absent or broken for some), a contract, a log, lessons and a kernel."""
    folder = fresh_folder(spark, "fleet")
    uri = ru.qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = ru.store_at(uri)
        for b in batches:
            for key, nation, balance in zip(*(c.to_pylist() for c in b.columns)):
                top = f"{root}/s{key}"
                files = {"kernel.py": f"CFG.SEED = 1\nCFG.SEED={key}\n"} if key % 3 else {}
                if key % 5:
                    files["output/submission_contract.json"] = json.dumps({"rows": key * 10, "pred_std": balance / 1000})
                    files["output/run.log"] = "started\n" + "".join(f'{{"time": {key}.{i}, "stream_name":"stderr"}}\n' for i in range(key % 4)) + "Traceback\n" * (key % 2)
                if key % 5 and key % 7 != 3:
                    summary = {"forward_blend_corr": balance / 10_000, "metabolism": {"elapsed_min": nation}, "forensics": {"shipped_selector": f"pick{nation}"}}
                    files["output/explorer_run_summary.json"] = json.dumps(summary) if key % 7 != 5 else '{"forward_blend_corr": 1'
                    files["output/explorer_lessons.csv"] = "key,score\n" + "".join(f"k{i},{i / 10}\n" for i in range(nation % 4))
                if files:
                    store.create_dir(f"{top}/output" if key % 5 else top, recursive=True)
                for name, text in files.items():
                    with store.open_output_stream(f"{top}/{name}", compression=None) as f:
                        f.write(text.encode())
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64())], ["key"])

    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long"), F.col("s_acctbal").cast("double"))
    arrow_map(dealt(suppliers, ru.EACH), write, "key long").count()
    return folder


_RUNS = """
with r as (
  select s_suppkey as k, 's' || s_suppkey as run, s_nationkey as nation, s_acctbal::double as balance, s_suppkey % 7 not in (3, 5) as summary, s_suppkey % 7 <> 3 as lessons
  from supplier where s_suppkey % 5 > 0
)
"""


@query("scan_runs", _RUNS + "select run, unnest(['submission_contract.json', 'run.log'] || case when lessons then ['explorer_run_summary.json', 'explorer_lessons.csv'] else []::varchar[] end) as file from r")
def _(spark, d):
    return ru.scan_runs(spark, fleet(spark, d)).select("run", "file")


@query("artifact_rows", _RUNS + "select run, i::bigint as place, 'k' || i as key, (i / 10)::varchar as score from (select *, unnest(generate_series(0, nation % 4 - 1)) as i from r where lessons and nation % 4 > 0)")
def _(spark, d):
    rows = ru.artifact_rows(spark, fleet(spark, d), "explorer_lessons.csv")
    return rows.select("run", "place", F.col("fields")["key"].alias("key"), F.col("fields")["score"].alias("score"))


@query("log_health", _RUNS + """
select run, 'run.log' as log_file, case when k % 4 > 0 then (k || '.' || (k % 4 - 1))::double end as log_runtime_sec, (k % 4)::int as log_stderr_events, (k % 2)::int as log_tracebacks from r
""")
def _(spark, d):
    return ru.run_logs(spark, fleet(spark, d)).select("run", "log_file", "log_runtime_sec", "log_stderr_events", "log_tracebacks")


@query("run_registry", _RUNS + """
, best as (select 's' || (o_custkey % 97) as run, max(o_totalprice) as p, count(*) as n from orders group by 1)
select run, substr(sha1('run|' || run), 1, 16) as run_id, (case when k % 3 > 0 then k end)::bigint as seed, (case when lessons then 4 else 2 end)::bigint as artifact_count, false as has_submission,
  case when summary then round(balance / 10000, 9) end as forward_blend_corr, case when summary then nation::double end as elapsed_min, case when summary then 'pick' || nation end as selector, (k * 10)::bigint as rows, round(balance / 1000, 9) as pred_std,
  best.p as best_external_private, coalesce(best.n, 0)::bigint as external_observations
from r left join best using (run)
""")
def _(spark, d):
    scores = table(spark, d, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 97).alias("run"), F.col("o_totalprice").alias("private"), F.lit(None).cast("double").alias("public"))
    out = ru.run_registry(spark, fleet(spark, d), scores)
    return rounded(out.select("run", "run_id", "seed", "artifact_count", "has_submission", "forward_blend_corr", "elapsed_min", "selector", "rows", "pred_std", "best_external_private", "external_observations"), "forward_blend_corr", "pred_std", to=9)


# --- predictions and reports


@query("map_to_sample", """
select o_orderkey, (row_number() over (order by o_orderkey) - 1) / 10.0::double as target from orders
""")
def _(spark, d):
    sample = row_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    preds = row_index(table(spark, d, "orders").select(F.col("o_orderkey").alias("at")), "at").select("row_idx", (F.col("row_idx") / 10.0).alias("pred"))
    return so.map_to_sample(preds, sample.drop("n_rows"), "target").select("o_orderkey", "target")


@query("write_predictions", "select o_orderkey, o_totalprice / 2 as target from orders")
def _(spark, d):
    o, folder = table(spark, d, "orders"), fresh_folder(spark, "predictions")
    so.write_predictions(o.select("o_orderkey", (F.col("o_totalprice") / 2).alias("pred")), o.select("o_orderkey", F.lit(0.0).alias("target")), "o_orderkey", "target", folder)
    return spark.read.csv(folder, header=True, schema="o_orderkey long, target double")


@query("write_report", """
select r_name as name, null::bigint as n, r_regionkey::bigint as key from region union all select n_name, n_regionkey::bigint, null from nation
""")
def _(spark, d):
    parts = [table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("key")), table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("n"))]
    folder = fresh_folder(spark, "report")
    so.write_report(folder, *parts)
    return spark.read.csv(folder, header=True, schema="name string, key long, n long")
