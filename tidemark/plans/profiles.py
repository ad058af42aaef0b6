"""Queries on what a table looks like: verdicts, with the counts they rest on taken from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import profile as pr
from tidemark.plans.queries import CTE, FEATURES, events, query, raw_events, rounded, table


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("detect_target", f"""
with names as (select unnest({list(pr.TARGET_NAMES)}) as name, unnest(generate_series(1, {len(pr.TARGET_NAMES)})) as turn)
, c as (
  select 'embeddings' as tbl, column_name as name from (describe embeddings)
  union all select 'orders', column_name from (describe orders)
)
, known as (select tbl, arg_min(name, turn) as target from c join names using (name) group by tbl)
select 'embeddings' as tbl, target, (select count(distinct label) from embeddings)::bigint as n_values from known where tbl = 'embeddings'
union all
select 'orders', coalesce((select target from known where tbl = 'orders'), 'o_totalprice'), (select count(distinct o_totalprice) from orders)::bigint
""")
def _(spark, d):
    out = []
    for name, lacks in (("embeddings", "vec_id"), ("orders", "o_totalprice")):
        t = table(spark, d, name)
        target = pr.detect_target(t, t.drop(lacks))
        out.append(t.agg(F.lit(name).alias("tbl"), F.lit(target).alias("target"), F.count_distinct(target).alias("n_values")))
    return union(out)


_KINDS = [("events", "value"), ("labels", "quality"), ("embeddings", "label"), ("part", "p_size"), ("lineitem", "l_linenumber")]


@query("detect_task_metric", " union all ".join(f"""
select col, case when n = 2 then 'binary' when whole and n <= 20 then 'multiclass' else 'regression' end as task,
  case when n = 2 then 'gini' when whole and n <= 20 then 'spearman' else 'pearson' end as metric
from (select '{t}.{c}' as col, count(distinct {c}) as n, any_value(typeof({c})) in ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') as whole from {t})
""" for t, c in _KINDS))
def _(spark, d):
    rows = [(f"{t}.{c}", *pr.detect_task_metric(table(spark, d, t), c)) for t, c in _KINDS]
    return spark.createDataFrame(rows, "col string, task string, metric string")


_IDS = [("orders", c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")] + [("part", c) for c in ("p_partkey", "p_brand", "p_size")]


@query("detect_ids", " union all ".join(f"select '{t}.{c}' as col, count(distinct {c}) + (count(*) > count({c}))::int = count(*) as is_id from {t}" for t, c in _IDS))
def _(spark, d):
    found = {(t, c) for t in ("orders", "part") for c in pr.detect_ids(table(spark, d, t), [c for u, c in _IDS if u == t])}
    return spark.createDataFrame([(f"{t}.{c}", (t, c) in found) for t, c in _IDS], "col string, is_id boolean")


_CATS = [("part", c) for c in ("p_brand", "p_size", "p_partkey")] + [("lineitem", c) for c in ("l_linenumber", "l_returnflag", "l_suppkey", "l_tax")]


@query("detect_categoricals", " union all ".join(f"""
select '{t}.{c}' as col, any_value(typeof({c})) = 'VARCHAR' or (any_value(typeof({c})) in ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') and count(distinct {c}) <= 20) as is_cat from {t}
""" for t, c in _CATS))
def _(spark, d):
    found = {(t, c) for t in ("part", "lineitem") for c in pr.detect_categoricals(table(spark, d, t), [c for u, c in _CATS if u == t])}
    return spark.createDataFrame([(f"{t}.{c}", (t, c) in found) for t, c in _CATS], "col string, is_cat boolean")


_AUTO = ", a as (select l.feature, abs(corr(l.x, b.x)) as c from l join l b on b.feature = l.feature and b.row_idx = l.row_idx - 1 group by 1)"


@query("detect_time", CTE + _AUTO + """
, s as (select e.row_idx, (e.row_idx + e.f_mod) as slow from e)
, t as (select abs(corr(a.slow, b.slow)) as c from s a join s b on b.row_idx = a.row_idx - 1)
select 'events' as rows, 'temporal' as geometry, 'ts' as time_col
union all select 'features', case when n > 200 and avg(c) > 0.15 then 'temporal' else 'tabular' end, null from a, (select count(*) as n from e) group by n
union all select 'trend', case when n > 200 and c > 0.15 then 'temporal' else 'tabular' end, null from t, (select count(*) as n from e)
""")
def _(spark, d):
    e = events(spark, d)
    slow = e.select("row_idx", (F.col("row_idx") + F.col("f_mod")).alias("slow"))
    rows = [("events", *pr.detect_time(table(spark, d, "events"), [])), ("features", *pr.detect_time(e.select("row_idx", *FEATURES), FEATURES)), ("trend", *pr.detect_time(slow, ["slow"]))]
    return spark.createDataFrame(rows, "rows string, geometry string, time_col string")


@query("detect_group", """
select 'user' as rows, case when count(distinct user_id) > 1 and count(distinct user_id) < count(*) / 2 then 'era' end as name, count(*)::bigint as n from events
union all
select 'key', case when count(distinct event_id) > 1 and count(distinct event_id) < count(*) / 2 then 'era' end, count(*)::bigint from events
""")
def _(spark, d):
    e = table(spark, d, "events")
    cases = {"user": e.withColumnRenamed("user_id", "era"), "key": e.withColumnRenamed("event_id", "era")}
    return union([t.agg(F.lit(n).alias("rows"), F.lit(pr.detect_group(t)).cast("string").alias("name"), F.count("*").alias("n")) for n, t in cases.items()])


@query("target_sensor", CTE + _AUTO + """
, t as (
  select 'y' as target, count(distinct y) as d, count_if(y <> floor(y)) as broken, count(*) as n from e
  union all select 'state', count(distinct state), 0, count(*) from e
  union all select 'half', count(distinct f_mod < 50), 0, count(*) from e
)
, k as (select *, case when d <= 2 then 'binary' when d <= least(20, greatest(3, n // 50)) and broken = 0 then 'multiclass' else 'regression' end as task from t)
select target, task, d::bigint as n_values, case when task = 'regression' then 'pearson' else 'gini' end as metric,
  round((select avg(c) from a), 6) + 0.0 as lag1, (select avg(c) from a) >= 0.15 as temporal
from k
""")
def _(spark, d):
    e = events(spark, d).withColumn("half", (F.col("f_mod") < 50).cast("int"))
    return union([rounded(pr.target_sensor(e, y, FEATURES), "lag1").withColumn("target", F.lit(y)) for y in ("y", "state", "half")])


@query("profile_table", """
with c as (
  select count(*)::bigint as n, count(distinct event_id) = count(*) as id_event, count(distinct user_id) = count(*) as id_user, count(distinct event_type) = count(*) as id_type, count(distinct props) = count(*) as id_props,
    count(distinct user_id) <= 20 as few_user, count(distinct event_id) <= 20 as few_event
  from events
)
, l as (
  select n, list_filter([case when id_event then 'event_id' end, case when id_user then 'user_id' end, case when id_type then 'event_type' end, case when id_props then 'props' end], lambda x: x is not null) as ids,
    list_filter([case when few_event and not id_event then 'event_id' end, case when few_user and not id_user then 'user_id' end, case when not id_type then 'event_type' end, case when not id_props then 'props' end], lambda x: x is not null) as cats
  from c
)
select 'value' as target, case when v = 2 then 'binary' else 'regression' end as task, case when v = 2 then 'gini' else 'pearson' end as metric, 'temporal' as geometry,
  array_to_string(ids, ',') as id_cols, array_to_string(cats, ',') as categorical_cols, null::varchar as group_col, 'ts' as time_col, n as n_rows, (5 - len(ids))::bigint as n_features
from l, (select count(distinct value) as v from events)
""")
def _(spark, d):
    row = pr.profile_row(spark, pr.profile_table(table(spark, d, "events"), target="value"))
    return row.withColumns({c: F.array_join(c, ",") for c in ("id_cols", "categorical_cols")}).drop("notes")
