"""The registered queries of the table operators. Every one reads whole tables; floats are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import candidates as ca
from tidemark.operators import ensemble as en
from tidemark.operators import features as fe
from tidemark.operators import keys as ke
from tidemark.operators import memory as my
from tidemark.operators import metrics as me
from tidemark.operators import models as mo
from tidemark.operators import transforms as tr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FEATURES = ["f_user", "f_k", "f_day", "f_mod", "f_mix"]
Q_PEARSON = "case when count(x) >= 3 and stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12 then corr(x, y) else 0 end"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id", "event_type", F.col("value").alias("y"), F.col("user_id").cast("double").alias("f_user"), F.get_json_object("props", "$.k").cast("double").alias("f_k"),
        F.dayofmonth("ts").cast("double").alias("f_day"), (F.col("event_id") * 37 % 101).cast("double").alias("f_mod"),
    ).withColumn("f_mix", F.col("f_user") * F.col("f_k") / 100)


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events by event_id with row numbers and 12 segments; y is the value, p a fixed mixture used as a prediction."""
    e = ke.assign_segments(ke.row_index(raw_events(spark, d), "event_id"))
    return e.withColumn("p", F.col("y") * 0.1 + F.col("f_mod") / 50 + F.col("f_k") / 100).withColumn("state", (F.col("f_k") % 3).cast("int"))


CTE = """with e0 as (select event_id, event_type, value as y, user_id::double as f_user, (props::json->>'$.k')::double as f_k,
  day(ts)::double as f_day, (event_id * 37 % 101)::double as f_mod, row_number() over (order by event_id) - 1 as row_idx, count(*) over () as n_rows from events),
e as (select *, f_user * f_k / 100 as f_mix, (row_idx * 12 // n_rows)::int as seg, y * 0.1 + f_mod / 50 + f_k / 100 as p, (f_k % 3)::int as state from e0),
l as (select row_idx, n_rows, seg, state, y, 'f_user' as feature, 0 as pos, f_user as x from e union all select row_idx, n_rows, seg, state, y, 'f_k', 1, f_k from e
  union all select row_idx, n_rows, seg, state, y, 'f_day', 2, f_day from e union all select row_idx, n_rows, seg, state, y, 'f_mod', 3, f_mod from e
  union all select row_idx, n_rows, seg, state, y, 'f_mix', 4, f_mix from e),
sc as (select seg, feature, pos, case when count(*) >= 50 then """ + Q_PEARSON + """ else 0 end as corr from l group by all)
"""


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    # Adding 0 makes a negative zero positive.
    return df.withColumns({c: F.round(c, to) + F.lit(0.0) for c in columns})


# --- sources, keys and splits


@query("count_rows", "select 'lineitem' as name, count(*)::bigint as n from lineitem union all select 'orders', count(*)::bigint from orders union all select 'events', count(*)::bigint from events")
def _(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("lineitem", "orders", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("order_key", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, (row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1)::bigint as row_idx from lineitem")
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ke.row_index(table(spark, d, "lineitem").select(*keys), *keys).select(*keys, F.col("row_idx").cast("long").alias("row_idx"))


@query("assign_segments", CTE + "select event_id, seg from e")
def _(spark, d):
    return events(spark, d).select("event_id", "seg")


@query("stride_sample", CTE + "select event_id from e where row_idx % greatest(1, n_rows // 700) = 0")
def _(spark, d):
    return ke.stride_sample(events(spark, d), 700).select("event_id")


@query("probe_sample", CTE + "select distinct event_id from e join (select distinct round_even(i * (n - 1) / 99.0, 0)::bigint as spot from (select unnest(generate_series(0, 99)) as i, (select count(*) from events) as n)) on row_idx = spot")
def _(spark, d):
    return ke.probe_sample(events(spark, d), 100).select("event_id")


@query("permute_rows", "select event_id, md5('7' || event_id::varchar) as order_key from events")
def _(spark, d):
    return ke.permuted(table(spark, d, "events").select("event_id"), "event_id", "7")


@query("holdout_carve", CTE + "select event_id, case when row_idx >= greatest(1, floor(n_rows * 0.85)) then 'holdout' else 'train' end as role from e")
def _(spark, d):
    return events(spark, d).select("event_id", ke.split_role(0.15).alias("role"))


@query("sealed_split", CTE + "select event_id, case when row_idx >= greatest(1, floor(n_rows * 0.9)) then 'holdout' else 'train' end as role from e")
def _(spark, d):
    return events(spark, d).select("event_id", ke.split_role(0.1).alias("role"))


@query("forward_split", CTE + "select event_id, case when row_idx >= floor(n_rows * 0.75) then 'future' when row_idx < floor(n_rows * 0.75) - 50 then 'past' else 'gap' end as role from e")
def _(spark, d):
    return events(spark, d).select("event_id", ke.forward_role().alias("role"))


@query("walk_forward_folds", CTE + """, s as (select seg, min(row_idx) as start, max(row_idx) + 1 as stop, row_number() over (order by seg) as place, count(*) over () as al from e group by seg)
select seg as fold, (start - 50)::bigint as train_end, start::bigint as start, stop::bigint as stop from s where place > al - least(4, al - 2) and start - 50 > 200""")
def _(spark, d):
    return ke.walk_forward_bounds(events(spark, d), 4, 50)


@query("forensic_worlds", CTE + "select kind, state, count(*)::bigint as n from (select 'seg' as kind, seg as state from e union all select 'state', state from e) group by all having count(*) >= 100")
def _(spark, d):
    return ke.worlds(events(spark, d), ["seg", "state"], 100)


@query("quantile_bands", "with q as (select quantile_cont(value, 1/3) as a, quantile_cont(value, 2/3) as b from events) select event_id, ((a < value)::int + (b < value)::int) as band from events, q")
def _(spark, d):
    return ke.bands(table(spark, d, "events").select("event_id", "value"), "value").select("event_id", "band")


# --- preparation


@query("joint_label_encode", "select value, (row_number() over (order by value) - 1)::bigint as code from (select distinct coalesce(v, 'None') as value from (select c_mktsegment as v from customer union all select o_orderpriority from orders))")
def _(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_mktsegment").alias("v")), table(spark, d, "orders").select(F.col("o_orderpriority").alias("v"))
    return tr.joint_codes(a, b, "v").withColumn("code", F.col("code").cast("long"))


@query("impute_median", """with t as (select l_orderkey, l_linenumber, l_partkey, case when l_quantity < 10 then null else l_quantity end as q, case when l_tax > 0.07 then null else l_tax end as t from lineitem),
m as (select median(q) as mq, median(t) as mt from t) select l_orderkey, l_linenumber, l_partkey, coalesce(q, mq) as q, coalesce(t, mt) as t from t, m""")
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    t = table(spark, d, "lineitem").select(*keys, F.when(F.col("l_quantity") >= 10, F.col("l_quantity")).alias("q"), F.when(F.col("l_tax") <= 0.07, F.col("l_tax")).otherwise(float("inf")).alias("t"))
    return tr.impute_median(t, ["q", "t"])


_MARKET_SQL = ", ".join(f"round({e.replace('eps', '1e-8')}, 6) + 0.0 as {k}" for k, e in tr.MARKET.items())


@query("market_features", f"with m as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as bid, l_extendedprice / 1000 as ask, l_discount * 100 as buy, l_tax * 100 as sell, l_quantity * 2 as vol from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_MARKET_SQL} from m")
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    q = table(spark, d, "lineitem").select(
        *keys, F.col("l_quantity").alias("bid_qty"), (F.col("l_extendedprice") / 1000).alias("ask_qty"), (F.col("l_discount") * 100).alias("buy_qty"), (F.col("l_tax") * 100).alias("sell_qty"), (F.col("l_quantity") * 2).alias("volume")
    )
    return rounded(tr.market_features(q), *tr.MARKET).select(*keys, *tr.MARKET)


@query("safe_float", "select event_id, try_cast(regexp_extract(props, '[0-9]+') as double) as a, try_cast(event_type as double) as b from events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("digits", F.regexp_extract("props", "[0-9]+", 0))
    return e.select("event_id", fn.safe_float("digits").alias("a"), fn.safe_float("event_type").alias("b"))


@query("clip01", "select event_id, greatest(0.0, least(1.0, value / 10)) as unit, greatest(-1.0, least(1.0, value / 10 - 1)) as signed from events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", fn.clip(F.col("value") / 10, 0.0, 1.0).alias("unit"), fn.clip(F.col("value") / 10 - 1, -1.0, 1.0).alias("signed"))


@query("parse_path_key", """with k as (select p_partkey, p_brand || '|' || 'anon' || p_size::varchar || '_' || p_type as key from part)
select p_partkey, split_part(key, '|', 1) as skill, regexp_extract(split_part(key, '|', 2), '^([a-zA-Z]+)([0-9]+)_(.*)$', 1) as family,
  regexp_extract(split_part(key, '|', 2), '^([a-zA-Z]+)([0-9]+)_(.*)$', 2)::int as k, regexp_extract(split_part(key, '|', 2), '^([a-zA-Z]+)([0-9]+)_(.*)$', 3) as transform from k""")
def _(spark, d):
    key = F.concat(F.col("p_brand"), F.lit("|anon"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_type"))
    p = table(spark, d, "part").select("p_partkey", F.split_part(key, F.lit("|"), F.lit(1)).alias("skill"), F.split_part(key, F.lit("|"), F.lit(2)).alias("r"))
    part = lambda i: F.regexp_extract("r", "^([a-zA-Z]+)([0-9]+)_(.*)$", i)
    return p.select("p_partkey", "skill", part(1).alias("family"), part(2).cast("int").alias("k"), part(3).alias("transform"))


@query("stable_id", "select o_orderkey, substr(sha1(o_orderkey::varchar || '|' || coalesce(o_orderstatus, '') || '|' || coalesce(o_orderpriority, '')), 1, 16) as id from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.stable_id(F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("id"))


# --- profiles


@query("symmetry_field", CTE + """, z as (select l.*, (x - m) / s as z from l join (select feature, avg(x) as m, stddev_pop(x) as s from l group by 1) using (feature))
select feature, round(corr(z, y), 6) + 0.0 as odd, round(corr(abs(z), y), 6) + 0.0 as even, case when abs(corr(z, y)) >= abs(corr(abs(z), y)) then 'odd' else 'even' end as verdict from z group by 1""")
def _(spark, d):
    e = events(spark, d)
    m = tr.moments(e, FEATURES)
    z = e.withColumns({f: tr.z(f, *m[f]) for f in FEATURES})
    out = fe.per_feature(z, FEATURES, {"odd": lambda f: fn.pearson(f, "y"), "even": lambda f: fn.pearson(F.abs(f), "y")})
    return rounded(out.withColumn("verdict", F.when(F.abs("odd") >= F.abs("even"), "odd").otherwise("even")), "odd", "even").select("feature", "odd", "even", "verdict")


@query("label_archaeology", CTE + """, h as (select unnest([1, 2, 3, 5]) as h), c as (select h, l.feature, l.pos, corr(l.x, b.y) as c from l, h join e b on b.row_idx = l.row_idx + h group by all),
a as (select h, corr(e.y, b.y) as auto from e, h join e b on b.row_idx = e.row_idx + h group by all)
select c.h, arg_max(feature, abs(c)) as feature, round(max(abs(c)), 6) + 0.0 as strength, round(any_value(auto), 6) + 0.0 as auto from c join a on a.h = c.h group by c.h""")
def _(spark, d):
    e, out = events(spark, d), None
    for h in (1, 2, 3, 5):
        lag = ke.lagged(e.select("row_idx", "y", *FEATURES), [*FEATURES, "y"], h)
        c = fe.per_feature(lag, FEATURES, {"c": lambda f: F.abs(fn.pearson(f"{f}_lag", "y")), "auto": lambda f: fn.pearson("y_lag", "y")})
        one = c.agg(F.lit(h).alias("h"), F.max_by("feature", "c").alias("feature"), F.max("c").alias("strength"), F.first("auto").alias("auto"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "strength", "auto")


@query("trap_map", CTE + """, p as (select feature, corr(x, y) as pooled from l group by 1), m as (select median(abs(pooled)) as med from p),
s as (select feature, pos, sum(case when sign(corr) >= 0 then 1 else 0 end) as up, count(*) as n from sc group by all)
select feature, round(least(up, n - up) / n, 6) + 0.0 as disagree, least(up, n - up) / n >= 0.4 and abs(pooled) >= med as trap from s join p using (feature), m""")
def _(spark, d):
    e = events(spark, d)
    s = fe.segment_corrs(e, FEATURES, "y").groupBy("feature", "pos").agg(F.count_if(F.col("corr") >= 0).alias("up"), F.count("*").alias("n"))
    pooled = fe.corr_vector(e, FEATURES, "y").select("feature", F.abs("corr").alias("pooled")).withColumn("med", F.percentile("pooled", 0.5).over(W.partitionBy(F.lit(1))))
    share = F.least("up", F.col("n") - F.col("up")) / F.col("n")
    out = s.join(F.broadcast(pooled), "feature").select("feature", share.alias("disagree"), ((share >= 0.4) & (F.col("pooled") >= F.col("med"))).alias("trap"))
    return rounded(out, "disagree")


@query("feature_shift", CTE + """, a as (select feature, avg(x) as m, var_pop(x) as v from l where row_idx < floor(n_rows * 0.75) group by 1), b as (select feature, avg(x) as m2, var_pop(x) as v2 from l where row_idx >= floor(n_rows * 0.75) group by 1)
select feature, round(abs(m2 - m) / (sqrt(v) + 1e-9) + 0.5 * abs(ln((v2 + 1e-9) / (v + 1e-9))), 6) + 0.0 as shift from a join b using (feature)""")
def _(spark, d):
    e = events(spark, d)
    late = F.col("row_idx") >= F.floor(F.col("n_rows") * 0.75)
    return rounded(fe.feature_shift(e.filter(~late), e.filter(late), FEATURES), "shift").select("feature", "shift")


@query("prediction_shift", CTE + """, m as (select avg(p) as m, stddev_pop(p) as s from e where row_idx < n_rows // 2), z as (select case when row_idx < n_rows // 2 then 'early' else 'late' end as part, (p - m) / (s + 1e-12) as z from e, m),
c as (select *, avg(z) over (partition by part) as mu, stddev_pop(z) over (partition by part) as sd from z)
select part, round(avg(z), 6) + 0.0 as mean, round(stddev_pop(z), 6) as sd, round(avg(((z - mu) / sd) ** 3), 5) + 0.0 as skew, round(avg(((z - mu) / sd) ** 4), 5) as kurt,
  round(quantile_cont(z, 0.01), 6) + 0.0 as q01, round(quantile_cont(z, 0.99), 6) + 0.0 as q99, round(avg(case when abs(z) > 3 then 1 else 0 end), 6) + 0.0 as beyond from c group by part""")
def _(spark, d):
    e = events(spark, d)
    early = F.col("row_idx") < F.floor(F.col("n_rows") / 2)
    m = tr.moments(e.filter(early), ["p"])["p"]
    z = e.select(F.when(early, "early").otherwise("late").alias("part"), tr.z("p", *m).alias("z"))
    out = z.groupBy("part").agg(
        F.avg("z").alias("mean"), F.stddev_pop("z").alias("sd"), F.skewness("z").alias("skew"), fn.excess_free_kurtosis("z").alias("kurt"), F.percentile("z", 0.01).alias("q01"), F.percentile("z", 0.99).alias("q99"),
        F.avg(F.when(F.abs("z") > 3, 1.0).otherwise(0.0)).alias("beyond"),
    )
    return rounded(rounded(out, "mean", "sd", "q01", "q99", "beyond"), "skew", "kurt", to=5)


# --- metrics


@query("pearson", CTE + "select round(corr(p, y), 6) as corr from e")
def _(spark, d):
    return rounded(raw_events(spark, d).agg(fn.pearson(F.col("y") * 0.1 + F.col("f_mod") / 50 + F.col("f_k") / 100, "y").alias("corr")), "corr")


@query("corr_vector", CTE + f"select feature, round({Q_PEARSON}, 6) + 0.0 as corr from l group by feature")
def _(spark, d):
    return rounded(fe.corr_vector(raw_events(spark, d), FEATURES, "y"), "corr").select("feature", "corr")


@query("gini", """with t as (select doc_id, quality, n_chars, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as r from labels join documents using (doc_id)),
s as (select sum(case when quality = 1 then r end) as s, sum(quality) as p, count(*) as n from t) select round(2 * ((s - p * (p + 1) / 2) / (p * (n - p))) - 1, 6) + 0.0 as gini from s""")
def _(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")), "doc_id")
    return rounded(me.gini(t, "n_chars", "quality"), "gini")


@query("auc_rank", """with t as (select quality, row_number() over (order by n_chars, doc_id) as r from labels join documents using (doc_id)),
s as (select sum(case when quality = 1 then r end) as s, sum(quality) as p, count(*) as n from t) select round((s - p * (p + 1) / 2) / (p * (n - p)), 6) as auc from s""")
def _(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")), "doc_id")
    return rounded(me.auc_rank(t, "n_chars", "quality", "doc_id"), "auc")


@query("spearman", CTE + ", r as (select row_number() over (order by p, row_idx) as a, row_number() over (order by y, row_idx) as b from e) select round(corr(a, b), 6) as spearman from r")
def _(spark, d):
    return rounded(me.spearman(events(spark, d), "p", "y", "row_idx"), "spearman")


@query("neg_rmse", CTE + "select round(-sqrt(avg((p - y) ** 2)) / (stddev_pop(y) + 1e-9), 6) as neg_rmse from e")
def _(spark, d):
    return rounded(events(spark, d).agg(fn.neg_rmse("p", "y").alias("neg_rmse")), "neg_rmse")


_ERA = CTE + ", s as (select seg, corr(p, y) as score from e group by seg having count(*) >= 50) select round(avg(score), 6) as era_mean, round(avg(case when seg > 12 - 1 - 4 then score end), 6) as late_mean, round(min(score), 6) as worst from s"


@query("era_scores", _ERA)
def _(spark, d):
    return rounded(me.era_scores(events(spark, d), "p", "y"), "era_mean", "late_mean", "worst")


for _name, _column in (("era_mean_score", "era_mean"), ("late_era_score", "late_mean"), ("worst_segment_score", "worst")):
    query(_name, f"select {_column} from ({_ERA})")(lambda spark, d, c=_column: rounded(me.era_scores(events(spark, d), "p", "y"), c).select(c))


@query("path_width", CTE + "select feature, round(avg(corr) - stddev_pop(corr) + least(0, min(corr)), 6) + 0.0 as width from sc group by feature")
def _(spark, d):
    return rounded(fe.segment_corrs(events(spark, d), FEATURES, "y").groupBy("feature").agg(fn.path_width("corr").alias("width")), "width")


@query("block_bootstrap", CTE + """, r as (select unnest(generate_series(0, 99)) as rep), g as (select rep, seg from r, (select distinct seg from e)),
w as (select rep, seg, (rep * 7 + seg * 13 + rep * seg) % 3 as times from g), s as (select seg, count(*) as n, sum(p) as sp, sum(y) as sy, sum(p * p) as pp, sum(y * y) as yy, sum(p * y) as py from e group by seg),
t as (select rep, sum(n * times) as n, sum(sp * times) as sp, sum(sy * times) as sy, sum(pp * times) as pp, sum(yy * times) as yy, sum(py * times) as py from w join s using (seg) group by rep)
select rep, round((py / n - sp * sy / n / n) / sqrt((pp / n - (sp / n) ** 2) * (yy / n - (sy / n) ** 2)), 6) + 0.0 as corr from t""")
def _(spark, d):
    e = events(spark, d)
    draws = spark.range(100).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("seg")).withColumn("times", (F.col("rep") * 7 + F.col("seg") * 13 + F.col("rep") * F.col("seg")) % 3)
    return rounded(me.block_bootstrap(e, "p", "y", draws), "corr")


@query("shrunk_mean", "select l_returnflag, l_linestatus, round((sum(l_discount) + (select avg(l_discount) from lineitem) * 4) / (count(*) + 4), 8) as shrunk from lineitem group by all")
def _(spark, d):
    t = table(spark, d, "lineitem")
    mean = t.agg(F.avg("l_discount")).first()[0]
    return rounded(t.groupBy("l_returnflag", "l_linestatus").agg(fn.shrunk_mean("l_discount", F.lit(mean)).alias("shrunk")), "shrunk", to=8)


@query("column_stats", CTE + "select feature, count(x)::bigint as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as sd, round(quantile_cont(x, 0.1), 6) as q10, round(quantile_cont(x, 0.5), 6) as q50, round(quantile_cont(x, 0.9), 6) as q90 from l group by feature")
def _(spark, d):
    stats = {"n": lambda f: F.count(f), "mean": lambda f: F.avg(f), "sd": lambda f: F.stddev_pop(f)} | {f"q{q}": (lambda f, q=q: F.percentile(f, q / 100)) for q in (10, 50, 90)}
    return rounded(fe.per_feature(raw_events(spark, d), FEATURES, stats), "mean", "sd", "q10", "q50", "q90").drop("pos")


_PAIRS = ", a as (select a.feature as i, b.feature as j, a.pos as pi, b.pos as pj, a.x as x, b.x as z, a.row_idx from l a join l b using (row_idx) where a.pos <= b.pos)"


@query("gram_by_cell", CTE + _PAIRS + ", g as (select a.i, a.j, e.seg, count(*)::bigint as n, sum(x) as sum_i, sum(z) as sum_j, sum(x * z) as sum_ij from a join e using (row_idx) group by all) select i, j, seg, n, round(sum_i, 3) as sum_i, round(sum_j, 3) as sum_j, round(sum_ij, 3) as sum_ij from g")
def _(spark, d):
    return rounded(fe.gram_cells(events(spark, d), FEATURES, ("seg",)), "sum_i", "sum_j", "sum_ij", to=3)


@query("information_matrix", CTE + _PAIRS + ", c as (select i, j, corr(x, z) as c, count(*) as n from a group by i, j) select i, j, round(c * n / (n - 1), 6) + 0.0 as value from c")
def _(spark, d):
    return rounded(fe.information_matrix(raw_events(spark, d), FEATURES), "value")


@query("feature_edges", CTE + _PAIRS + "select i, j, round(corr(x, z), 6) + 0.0 as corr from a where pi < pj group by i, j")
def _(spark, d):
    return rounded(fe.correlations(fe.moment_rows(raw_events(spark, d), FEATURES)), "corr")


@query("zscore", "select event_id, round((value - avg(value) over ()) / (stddev_pop(value) over () + 1e-12), 6) + 0.0 as z from events")
def _(spark, d):
    e = table(spark, d, "events")
    return rounded(e.select("event_id", tr.z("value", *tr.moments(e, ["value"])["value"]).alias("z")), "z")


@query("world_floor", CTE + "select feature, round(min(corr), 6) + 0.0 as floor, round(quantile_cont(corr, 0.25), 6) + 0.0 as q25, arg_min(seg, corr) as worst from sc group by feature")
def _(spark, d):
    s = fe.segment_corrs(events(spark, d), FEATURES, "y")
    return rounded(s.groupBy("feature").agg(F.min("corr").alias("floor"), F.percentile("corr", 0.25).alias("q25"), F.min_by("seg", "corr").alias("worst")), "floor", "q25")


_SEGMENTS = "with c as (select c_mktsegment as key, sum(c_acctbal) as s from customer group by 1)"


@query("softmax_weights", _SEGMENTS + ", m as (select key, exp(greatest(-80, (s - max(s) over ()) / 1e5)) as e from c) select key, round(e / sum(e) over (), 6) as weight from m")
def _(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.sum("c_acctbal").alias("s"))
    return rounded(me.softmax_weights(c, "s", 1e-5), "weight").select("key", "weight")


@query("normalize01", _SEGMENTS + " select key, round((s - min(s) over ()) / (max(s) over () - min(s) over ()), 6) + 0.0 as unit from c")
def _(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.sum("c_acctbal").alias("s"))
    return rounded(me.normalize01(c, "s"), "unit").select("key", "unit")


@query("bucket_weights", "with b as (select o_orderpriority as key, greatest(0, sum(o_totalprice)) as w from orders where o_orderpriority <> '' group by 1) select key, round(w / sum(w) over (), 6) as weight from b")
def _(spark, d):
    return me.bucket_weights(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


# --- rankers


def ranker(name: str, sql: str, make: Callable[[DataFrame], DataFrame]) -> None:
    query(name, CTE + sql)(lambda spark, d: rounded(make(events(spark, d)), "score").select("feature", "score"))


ranker("rank_top", "select feature, round(abs(corr(x, y)), 6) + 0.0 as score from l group by 1", lambda e: fe.rank_top(e, FEATURES, "y"))
ranker("rank_stable", "select feature, round(abs(avg(corr)) - stddev_pop(corr), 6) + 0.0 as score from sc group by 1", lambda e: fe.rank_stable(e, FEATURES, "y"))
_CLOCKS = ", t as (select feature, abs(corr(x, y)) as f, abs(corr(x, y) filter (where row_idx >= floor(n_rows * 0.75))) as r, abs(corr(x, y) filter (where row_idx < floor(n_rows * 0.75))) as b from l group by 1)"
ranker("rank_two_clocks", _CLOCKS + "select feature, round(least(f, r), 6) + 0.0 as score from t", lambda e: fe.rank_two_clocks(e, FEATURES, "y"))
ranker("rank_dawn", _CLOCKS + "select feature, round(case when r > f then r else r - 1 end, 6) + 0.0 as score from t", lambda e: fe.rank_two_clocks(e, FEATURES, "y", "dawn"))
ranker("rank_shadow", ", t as (select feature, abs(corr(x, y)) as c, var_pop(x) as v from l group by 1), m as (select median(v) as m from t) select feature, round(case when v >= m then -c else -10 - c end, 6) + 0.0 as score from t, m", lambda e: fe.rank_shadow(e, FEATURES, "y"))
ranker("rank_fault", ", j as (select feature, abs(corr - lag(corr) over (partition by feature order by seg)) as j from sc) select feature, round(coalesce(max(j), 0), 6) + 0.0 as score from j group by 1", lambda e: fe.rank_fault(e, FEATURES, "y"))
ranker("rank_sign_stability", ", p as (select feature, corr(x, y) as q from l group by 1), o as (select feature, q, avg(case when sign(corr) <> sign(q) then 1.0 else 0 end) as o from sc join p using (feature) group by all) select feature, round(abs(q) - case when o > 0.25 then 1 else 0 end, 6) + 0.0 as score from o", lambda e: fe.rank_sign_stability(e, FEATURES, "y"))
ranker("rank_springs", ", a as (select l.feature, greatest(0, corr(l.x, b.x)) as a from l join l b on b.feature = l.feature and b.row_idx = l.row_idx - 1 group by 1), t as (select feature, abs(corr(x, y)) as c from l group by 1) select feature, round(a * c, 6) + 0.0 as score from a join t using (feature)", lambda e: fe.rank_springs(e, ke.lagged(e, FEATURES), FEATURES, "y"))
ranker("rank_echo", "select feature, round(abs(corr(l.x, b.y)), 6) + 0.0 as score from l join e b on b.row_idx = l.row_idx - 1 group by 1", lambda e: fe.rank_echo(ke.lagged(e, ["y"]), FEATURES, "y"))
_STATES = ", t as (select feature, state, abs(corr(x, y)) as c from l group by all having count(*) >= 300)"
ranker("rank_weather", _STATES + "select feature, round(min(c), 6) + 0.0 as score from t group by 1", lambda e: fe.rank_by_state(e, FEATURES, "y", "state"))
ranker("rank_watershed", _STATES + ", p as (select feature, abs(corr(x, y)) as q from l group by 1) select feature, round(max(c) - any_value(q), 6) + 0.0 as score from t join p using (feature) group by 1", lambda e: fe.rank_by_state(e, FEATURES, "y", "state", pick="lift"))
ranker("rank_invariant", f", t as (select feature, {Q_PEARSON} as c from l group by feature, seg having count(*) >= 80 union all select feature, {Q_PEARSON} from l group by feature, state having count(*) >= 80) select feature, round(abs(avg(c)) - stddev_pop(c), 6) + 0.0 as score from t group by 1", lambda e: fe.rank_invariant(e, FEATURES, "y", ["seg", "state"]))
ranker("rank_irm", ", t as (select feature, covar_pop(x, y) / (stddev_pop(x) + 1e-9) as s from l group by feature, seg having count(*) >= 80 union all select feature, covar_pop(x, y) / (stddev_pop(x) + 1e-9) from l group by feature, state having count(*) >= 80), m as (select *, avg(s) over (partition by feature) as m, count(*) over (partition by feature) as k from t), q as (select feature, abs(corr(x, y)) as q from l group by 1), b as (select feature, abs(any_value(m)) - stddev_pop(s) - 0.5 * avg(case when sign(s) <> sign(m) then 1.0 else 0 end) * abs(any_value(m)) as b from m where k >= 3 group by 1) select feature, round(coalesce(b, q), 6) + 0.0 as score from q left join b using (feature)", lambda e: fe.rank_irm(e, FEATURES, "y", ["seg", "state"]))
ranker("anova_f_rank", ", g as (select feature, state, count(*) as n, avg(x) as m, var_pop(x) as v from l group by all), h as (select *, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) as a from g) select feature, round(sum(n * (m - a) ** 2) / (sum(n * v) + 1e-12), 6) + 0.0 as score from h group by 1", lambda e: fe.anova_f(e, FEATURES, "state"))
ranker("rank_periphery", _CLOCKS + "select feature, round(abs(r - b) / (1 + 10 * f), 6) + 0.0 as score from t", lambda e: fe.rank_periphery(e, FEATURES, "y", fe.corr_vector(e, FEATURES, "y").select("feature", F.abs("corr").alias("credit"))))


# --- transforms


def transform(name: str, sql: str, make: Callable[[DataFrame], DataFrame], columns: tuple[str, ...] = ("out",), to: int = 6) -> None:
    query(name, CTE + sql)(lambda spark, d: rounded(make(events(spark, d)), *columns, to=to).select("event_id", *columns))


_LAG = ", g as (select *, lag(y, 1) over (order by row_idx) as y1, lag(y, 2) over (order by row_idx) as y2 from e) "
transform("tf_quantize", ", q as (select quantile_cont(y, 0.005) as lo, quantile_cont(y, 0.995) as hi from e) select event_id, round(round_even((greatest(lo, least(hi, y)) - lo) / greatest(hi - lo, 1e-12) * 15, 0) / 15 * (hi - lo) + lo, 4) + 0.0 as out from e, q", lambda e: tr.tf_quantize(e, "y"), to=4)
transform("tf_rank", ", q as (select unnest(quantile_cont(y, [i / 17.0 for i in generate_series(1, 16)])) as edge from e) select event_id, round((select count(*) from q where edge < y) / 17.0, 6) + 0.0 as out from e", lambda e: tr.tf_rank(e, "y", 16))
transform("tf_sign_only", ", q as (select median(y) as m from e) select event_id, sign(y - m)::double as out from e, q", lambda e: tr.tf_sign(e, "y"))
transform("tf_prism", ", q as (select quantile_cont(y, 1/3) as a, quantile_cont(y, 2/3) as b from e) select event_id, round(y, 6) as \"all\", round(case when y <= a then y else 0 end, 6) as low, round(case when y >= b then y else 0 end, 6) as high from e, q", lambda e: tr.tf_prism(e, "y"), ("all", "low", "high"))
transform("tf_moire", ", m as (select avg(f_k) as a, stddev_pop(f_k) as b, avg(f_mod) as c, stddev_pop(f_mod) as d from e), z as (select event_id, (f_k - a) / (b + 1e-12) as u, (f_mod - c) / (d + 1e-12) as v from e, m) select event_id, round(u, 5) + 0.0 as z_f_k, round(u * (abs(u) + abs(v)) / 2, 5) + 0.0 as m_f_k from z", lambda e: tr.tf_moire(e, ["f_k", "f_mod"]), ("z_f_k", "m_f_k"), to=5)
transform("tf_fold_abs", ", m as (select avg(y) as a, stddev_pop(y) as b from e) select event_id, round(abs((y - a) / (b + 1e-12)), 6) + 0.0 as out from e, m", lambda e: e.withColumn("out", F.abs(tr.z("y", *tr.moments(e, ["y"])["y"]))))
transform("tf_doppler", _LAG + "select event_id, round(coalesce(y - y1, 0), 6) + 0.0 as out from g", lambda e: tr.tf_doppler(e, "y"))
transform("tf_curvature", _LAG + "select event_id, round(coalesce(y - 2 * y1 + y2, 0), 6) + 0.0 as out from g", lambda e: tr.tf_curvature(e, "y"))
_EMA = ", m as (select a.event_id, any_value(a.y) as y, sum(b.y * pow({k}, a.row_idx - b.row_idx) * case when b.row_idx = 0 then 1 else 1 - {k} end) as m{n} from e a join e b on b.row_idx between a.row_idx - {r} and a.row_idx group by 1)"
transform("tf_tide", _EMA.format(k="(63.0/65.0)", r=1300, n="") + " select event_id, round(y - m, 6) + 0.0 as out from m", lambda e: tr.tf_tide(e, "y"))
transform("tf_reaction_diffusion", ", p as (select a.event_id, sum(b.y * pow(0.6, a.row_idx - b.row_idx) * case when b.row_idx = 0 then 1 else 0.4 end) as f, sum(b.y * pow(31.0/33.0, a.row_idx - b.row_idx) * case when b.row_idx = 0 then 1 else 2.0/33.0 end) as s from e a join e b on b.row_idx between a.row_idx - 700 and a.row_idx group by 1) select event_id, round(f - s, 6) + 0.0 as out from p", lambda e: tr.tf_reaction_diffusion(e, "y"))
transform("room_change", ", g as (select *, lag(state) over (order by row_idx) as s1 from e) select event_id, (s1 is not null and s1 <> state)::double as out from g", lambda e: ke.lagged(e, ["state"]).withColumn("out", F.coalesce((F.col("state_lag") != F.col("state")).cast("double"), F.lit(0.0))))


@query("weather_state", CTE + """, m as (select avg(f_k) as a, stddev_pop(f_k) as b, avg(f_mod) as c, stddev_pop(f_mod) as d from e), w as (select event_id, (abs((f_k - a) / (b + 1e-12)) + abs((f_mod - c) / (d + 1e-12))) / 2 as g from e, m),
q as (select quantile_cont(g, 1/3) as x, quantile_cont(g, 2/3) as z from w) select event_id, (g > x)::int + (g > z)::int as weather from w, q""")
def _(spark, d):
    e = raw_events(spark, d)
    m = tr.moments(e, ["f_k", "f_mod"])
    gauge = (F.abs(tr.z("f_k", *m["f_k"])) + F.abs(tr.z("f_mod", *m["f_mod"]))) / 2
    return ke.bands(e.withColumn("g", gauge), "g", name="weather").select("event_id", "weather")


# --- models


@query("fit_ols", CTE + "select seg, round(regr_slope(y, f_k), 6) + 0.0 as slope, round(regr_intercept(y, f_k), 6) + 0.0 as intercept, round(regr_r2(y, f_k), 6) + 0.0 as r2 from e group by seg")
def _(spark, d):
    return rounded(mo.fit_ols(events(spark, d), "f_k", "y", ("seg",)), "slope", "intercept", "r2")


@query("fit_bin_means", CTE + ", q as (select unnest(quantile_cont(f_mix, [i / 16.0 for i in generate_series(1, 15)])) as edge from e), b as (select (select count(*) from q where edge <= f_mix)::int as bin, y from e) select bin, count(*)::bigint as n, round(avg(y), 6) as mean from b group by bin")
def _(spark, d):
    return rounded(mo.fit_bin_means(raw_events(spark, d), "f_mix", "y"), "mean")


@query("fit_majority_vote", CTE + ", m as (select feature, sign(corr(x, y)) as s, median(x) as m from l group by 1) select l.row_idx::bigint as row_idx, round(avg(sign(x - m) * s), 6) + 0.0 as vote from l join m using (feature) group by 1")
def _(spark, d):
    e = events(spark, d)
    return rounded(e.select(F.col("row_idx").cast("long").alias("row_idx"), mo.fit_majority_vote(e, FEATURES, "y").alias("vote")), "vote")


@query("fit_ridge", CTE + """, s as (select count(*) as n, avg(f_k) as ma, avg(f_mod) as mb, avg(y) as my, stddev_pop(f_k) + 1e-12 as sa, stddev_pop(f_mod) + 1e-12 as sb, covar_pop(f_k, f_mod) as cab, covar_pop(f_k, y) as cay, covar_pop(f_mod, y) as cby, var_pop(f_k) as va, var_pop(f_mod) as vb from e),
t as (select *, n * va / sa / sa + 10 as p, n * cab / sa / sb as q, n * vb / sb / sb + 10 as r, n * cay / sa as u, n * cby / sb as v from s),
b as (select *, (u * r - v * q) / (p * r - q * q) / sa as wa, (v * p - u * q) / (p * r - q * q) / sb as wb from t)
select event_id, round(my - wa * ma - wb * mb + wa * f_k + wb * f_mod, 6) as pred from e, b""")
def _(spark, d):
    e = raw_events(spark, d)
    return rounded(e.select("event_id", mo.linear(*mo.fit_ridge(e, ["f_k", "f_mod"], "y", 10.0)).alias("pred")), "pred")


# --- candidates and memory: a lesson for every (type of event, user group, k group) of the whole table


def lessons(spark: SparkSession, d: str) -> DataFrame:
    e = raw_events(spark, d).withColumn("u", F.col("f_user") % 5).withColumn("t", F.col("f_k") % 4)
    c = e.groupBy(F.col("event_type").alias("skill"), F.concat(F.lit("u"), F.col("u").cast("int").cast("string")).alias("family"), F.concat(F.lit("t"), F.col("t").cast("int").cast("string")).alias("transform"))
    c = c.agg(F.count("*").alias("n"), fn.pearson("f_mod", "y").alias("oof"), (F.avg("y") / 100 - 0.1).alias("width"), fn.pearson("f_day", "y").alias("wf_width"))
    c = c.withColumn("key", F.concat_ws("|", "skill", "family", "transform")).withColumn("overfit", F.col("n") % 9).withColumn("cost", F.col("n") * 0.5)
    return c.withColumn("promoted", (F.col("oof") > 0) & (F.col("width") > 0)).withColumn("stage", F.concat(F.lit("s"), (F.col("n") % 4).cast("string")))


LESSONS = CTE + """, k as (select event_type as skill, 'u' || (f_user % 5)::int as family, 't' || (f_k % 4)::int as transform, count(*)::bigint as n,
  case when count(*) >= 3 and stddev_pop(f_mod) > 1e-12 and stddev_pop(y) > 1e-12 then corr(f_mod, y) else 0 end as oof, avg(y) / 100 - 0.1 as width,
  case when count(*) >= 3 and stddev_pop(f_day) > 1e-12 and stddev_pop(y) > 1e-12 then corr(f_day, y) else 0 end as wf_width from e group by 1, 2, 3),
c as (select *, skill || '|' || family || '|' || transform as key, n % 9 as overfit, n * 0.5::double as cost, oof > 0 and width > 0 as promoted, 's' || (n % 4)::varchar as stage from k)
"""


def on_lessons(name: str, sql: str, make: Callable[[DataFrame], DataFrame], *round_: str) -> None:
    query(name, LESSONS + sql)(lambda spark, d: rounded(make(lessons(spark, d)), *round_, to=9))


on_lessons("gate_decision", """select key, case when oof > 0 and width > 0 and wf_width > 0 and overfit <= 6 then 'promote' when oof > 0 then 'expand' else 'reject' end as decision,
  concat_ws('|', case when oof <= 0 then 'oof<=0' end, case when width <= 0 then 'width<=0' end, case when wf_width <= 0 then 'wf_width<=0' end, case when overfit > 6 then 'overfit>6' end) as reasons from c""", lambda c: ca.gate_decision(c).select("key", "decision", "reasons"))
on_lessons("draft_gate", ", g as (select *, row_number() over w as r, quantile_cont(width, 0.5) over (partition by skill order by key rows between unbounded preceding and 1 preceding) as m from c window w as (partition by skill order by key)) select key, coalesce(r <= 5 or width >= 0.06 or width >= m, false) as passes from g", lambda c: ca.draft_gate(c, "key", "skill").select("key", F.coalesce("passes", F.lit(False)).alias("passes")))
on_lessons("fitness", "select key, round((1 - (0.5 + 0.3 * pow(0.5, n / 60.0))) * oof + (0.5 + 0.3 * pow(0.5, n / 60.0)) * least(width, wf_width), 9) + 0.0 as fitness from c", lambda c: rounded(ca.fitness(c, "n").select("key", "fitness"), "fitness", to=9))
on_lessons("archive_best", "select skill, overfit, key, round(oof, 9) + 0.0 as oof from (select *, row_number() over (partition by skill, overfit order by oof desc, key) as r from c where oof > 0) where r = 1", lambda c: ca.archive_best(c, ["skill", "overfit"], "key").select("skill", "overfit", "key", "oof"), "oof")
on_lessons("learning_curve", ", g as (select key, (sum(cost) over w)::double as total_cost, max(width) over w as best_width from c window w as (partition by skill order by key rows unbounded preceding)) select key, total_cost, round(best_width, 9) + 0.0 as best_width, round(best_width / total_cost, 9) + 0.0 as best_per_cost from g", lambda c: rounded(ca.learning_curve(c, "skill", "key", "cost").select("key", "total_cost", "best_width", "best_per_cost"), "best_width", "best_per_cost", to=9))
on_lessons("quorum_report", "select family, count(distinct skill)::bigint as voters, count(distinct skill) >= 3 as quorum, string_agg(distinct skill, ',' order by skill) as names from c group by family", lambda c: ca.quorum_report(c, "skill"))
on_lessons("species_report", "select skill, count(*)::bigint as lessons, sum(promoted::int)::bigint as promoted, round(max(oof), 9) + 0.0 as best_oof, arg_max(stage, key) as last_stage from c group by skill", lambda c: ca.species_report(c, "skill", "key"), "best_oof")
on_lessons("study_reports", """select case when grouping(skill) = 0 then 'skill' when grouping(family) = 0 then 'family' else 'transform' end as axis, coalesce(skill, family, transform) as value, count(*)::bigint as n,
  round(avg(oof), 9) + 0.0 as mean_oof, round(max(oof), 9) + 0.0 as max_oof, round(avg(width), 9) + 0.0 as mean_width, round(avg(promoted::int), 9) + 0.0 as promote_rate from c group by grouping sets ((skill), (family), (transform))""", ca.study_reports, "mean_oof", "max_oof", "mean_width", "promote_rate")
_TYPO = ", t as (select skill, family, transform, count(*)::bigint as n, avg(oof) as mean_oof, (sum(oof) + (select avg(oof) from c) * 4) / (count(*) + 4) as shrunk, max(key) as best_key from c group by 1, 2, 3)"
on_lessons("typology_memory", _TYPO + " select skill, family, transform, n, round(mean_oof, 9) + 0.0 as mean_oof, round(shrunk, 9) + 0.0 as shrunk, best_key from t", ca.typology_memory, "mean_oof", "shrunk")
on_lessons("typology_gradients", _TYPO + """ select a.best_key as from_id, b.best_key as to_id, case when a.skill <> b.skill then 'skill' when a.family <> b.family then 'family' else 'transform' end as axis, round(b.shrunk - a.shrunk, 9) + 0.0 as delta
from t a join t b on (a.skill <> b.skill)::int + (a.family <> b.family)::int + (a.transform <> b.transform)::int = 1""", lambda c: ca.typology_gradients(ca.typology_memory(c).withColumn("cell", F.concat_ws("|", *ca.AXES))), "delta")
on_lessons("ledger_merge", ", a as (select skill as key, count(*)::bigint as n, avg(oof) as mean from c where family < 'u3' group by 1), b as (select skill as key, count(*)::bigint as n, avg(oof) as mean from c where family >= 'u2' group by 1) select coalesce(a.key, b.key) as key, (coalesce(a.n, 0) + coalesce(b.n, 0))::bigint as n, round((coalesce(a.n * a.mean, 0) + coalesce(b.n * b.mean, 0)) / (coalesce(a.n, 0) + coalesce(b.n, 0)), 9) + 0.0 as mean from a full join b on a.key = b.key",
           lambda c: ca.ledger_merge(*[c.filter(f).groupBy(F.col("skill").alias("key")).agg(F.count("*").alias("n"), F.avg("oof").alias("mean")) for f in ("family < 'u3'", "family >= 'u2'")]), "mean")
on_lessons("governor", "select round(covar_pop(overfit, wf_width) / var_pop(overfit), 9) + 0.0 as beta, round(greatest(0, least(0.04, covar_pop(overfit, wf_width) / var_pop(overfit) / 2)), 9) + 0.0 as strength, round(corr(width, wf_width), 9) + 0.0 as width_decay from c", lambda c: ca.governor(c.withColumn("complexity", F.col("overfit").cast("double")).withColumn("decay", F.col("wf_width"))), "beta", "strength", "width_decay")


@query("attack_subperiod", CTE + ", s as (select feature, seg, corr as score, avg(corr) over (partition by feature order by seg rows between 2 preceding and current row) as m, row_number() over (partition by feature order by seg) as k, row_number() over (partition by feature order by seg desc) as b from sc) select feature, round(min(m) filter (where k >= 3), 6) + 0.0 as worst_run, round(avg(score) filter (where b <= 2), 6) + 0.0 as last_two from s group by 1")
def _(spark, d):
    s = fe.segment_corrs(events(spark, d), FEATURES, "y").withColumnRenamed("corr", "score")
    return rounded(ca.attack_subperiod(s, "feature"), "worst_run", "last_two")


@query("segment_senate", CTE + "select feature, count(*) filter (where corr > 0.01)::bigint as yes, count(*) filter (where corr < -0.02)::bigint as veto, count(*)::bigint as segments from sc group by 1")
def _(spark, d):
    return ca.segment_senate(fe.segment_corrs(events(spark, d), FEATURES, "y").withColumnRenamed("corr", "score"), "feature")


@query("rank_average_blend", CTE + ", r as (select row_idx, feature, row_number() over (partition by feature order by x, row_idx) - 1 - (count(*) over (partition by feature) - 1) / 2.0 as r from l where feature in ('f_k', 'f_mod', 'f_mix')) select row_idx::bigint as row_idx, round(avg(r), 6) + 0.0 as blend from r group by 1")
def _(spark, d):
    e = events(spark, d)
    long = e.select("row_idx", F.explode(F.array(*[F.struct(F.lit(c).alias("member"), F.col(c).alias("pred")) for c in ("f_k", "f_mod", "f_mix")])).alias("m")).select("row_idx", "m.*")
    return rounded(ca.rank_average_blend(long, "member", "row_idx").withColumn("row_idx", F.col("row_idx").cast("long")), "blend")


@query("weather_report", CTE + "select state, count(*)::bigint as n, round(corr(p, y), 6) + 0.0 as corr from e group by state")
def _(spark, d):
    return rounded(events(spark, d).groupBy("state").agg(F.count("*").alias("n"), fn.pearson("p", "y").alias("corr")), "corr")


@query("support_lattice", CTE + "select state, seg, count(*)::bigint as n, round(corr(p, y), 6) + 0.0 as corr from e group by state, seg")
def _(spark, d):
    return rounded(events(spark, d).groupBy("state", "seg").agg(F.count("*").alias("n"), fn.pearson("p", "y").alias("corr")), "corr")


# --- ensembles: three features as members, z-scored

MEMBERS = ["f_k", "f_mod", "f_mix"]
ZED = CTE + """, mm as (select avg(f_k) a1, stddev_pop(f_k) + 1e-12 b1, avg(f_mod) a2, stddev_pop(f_mod) + 1e-12 b2, avg(f_mix) a3, stddev_pop(f_mix) + 1e-12 b3, avg(p) ap, stddev_pop(p) + 1e-12 bp from e),
z as (select row_idx, n_rows, event_id, seg, y, p, (f_k - a1) / b1 as m1, (f_mod - a2) / b2 as m2, (f_mix - a3) / b3 as m3, (p - ap) / bp as zp from e, mm),
r as (select corr(m1, y) c1, corr(m2, y) c2, corr(m3, y) c3, abs(corr(m1, m2)) r12, abs(corr(m1, m3)) r13, abs(corr(m2, m3)) r23 from z),
g0 as (select case when c1 > 0 or c2 > 0 or c3 > 0 then greatest(c1, 0) else 1 end u1, case when c1 > 0 or c2 > 0 or c3 > 0 then greatest(c2, 0) else 1 end u2, case when c1 > 0 or c2 > 0 or c3 > 0 then greatest(c3, 0) else 1 end u3 from r),
g as (select u1 / (u1 + u2 + u3) w1, u2 / (u1 + u2 + u3) w2, u3 / (u1 + u2 + u3) w3 from g0)
"""


def zed(spark: SparkSession, d: str) -> DataFrame:
    return en.standardised(events(spark, d), MEMBERS)


@query("blend_corr_weighted", ZED + "select event_id, round(w1 * m1 + w2 * m2 + w3 * m3, 6) + 0.0 as blend from z, g")
def _(spark, d):
    e = zed(spark, d)
    return rounded(e.select("event_id", en.blended(en.weights_by_corr(en.member_corrs(e, MEMBERS, "y")[0])).alias("blend")), "blend")


@query("blend_median", ZED + "select event_id, round(m1 + m2 + m3 - least(m1, m2, m3) - greatest(m1, m2, m3), 6) + 0.0 as blend from z")
def _(spark, d):
    return rounded(zed(spark, d).select("event_id", en.row_median(MEMBERS).alias("blend")), "blend")


@query("blend_agreement", ZED + """, a0 as (select c1 * (r12 + r13) / 2 as u1, c2 * (r12 + r23) / 2 as u2, c3 * (r13 + r23) / 2 as u3 from r),
a as (select case when greatest(u1, u2, u3) > 0 then greatest(u1, 0) else 1 end u1, case when greatest(u1, u2, u3) > 0 then greatest(u2, 0) else 1 end u2, case when greatest(u1, u2, u3) > 0 then greatest(u3, 0) else 1 end u3 from a0)
select unnest(['f_k', 'f_mod', 'f_mix']) as member, round(unnest([u1, u2, u3]) / (u1 + u2 + u3), 6) + 0.0 as weight from a""")
def _(spark, d):
    w = en.weights_by_agreement(*en.member_corrs(zed(spark, d), MEMBERS, "y"))
    return rounded(spark.createDataFrame(list(w.items()), "member string, weight double"), "weight")


@query("dominance", ZED + """, b as (select corr(w1 * m1 + w2 * m2 + w3 * m3, y) as al, corr(w2 * m2 + w3 * m3, y) as o1, corr(w1 * m1 + w3 * m3, y) as o2, corr(w1 * m1 + w2 * m2, y) as o3 from z, g),
t as (select unnest(['f_k', 'f_mod', 'f_mix']) as member, unnest([w1, w2, w3]) as weight, unnest([c1, c2, c3]) as own, coalesce(unnest([case when w2 + w3 > 1e-9 then o1 else 0 end, case when w1 + w3 > 1e-9 then o2 else 0 end, case when w1 + w2 > 1e-9 then o3 else 0 end]), 0) as without, al from r, g, b)
select member, round(weight, 6) + 0.0 as weight, round(own, 6) + 0.0 as own, round(without, 6) + 0.0 as without, round(al - without, 6) + 0.0 as marginal from t""")
def _(spark, d):
    e = zed(spark, d)
    return rounded(en.dominance(e, en.weights_by_corr(en.member_corrs(e, MEMBERS, "y")[0]), "y"), "weight", "own", "without", "marginal")


@query("chorus", ZED + ", s as (select event_id, (m1 + m2 + m3) / 3 as m, sqrt((pow(m1 - (m1 + m2 + m3) / 3, 2) + pow(m2 - (m1 + m2 + m3) / 3, 2) + pow(m3 - (m1 + m2 + m3) / 3, 2)) / 3) as s from z) select event_id, round(m * exp(-s / ((select avg(s) from s) + 1e-12)), 6) + 0.0 as chorus from s")
def _(spark, d):
    return rounded(en.chorus(zed(spark, d), MEMBERS, 1.0).select("event_id", "chorus"), "chorus")


@query("shape_prediction", ZED + ", t as (select corr(zp, y) as a, corr(sign(zp) * sqrt(abs(zp)), y) as b, corr(sign(zp) * pow(abs(zp), 1.5), y) as c, corr(tanh(zp), y) as d from z) select unnest(['raw', 'sqrt', 'pow15', 'tanh']) as shape, round(unnest([a, b, c, d]), 6) + 0.0 as corr from t")
def _(spark, d):
    return rounded(en.shape_scores(en.standardised(events(spark, d), ["p"]), "p", "y"), "corr")


@query("winsorize_audit", ZED + ", q as (select quantile_cont(p, 0.001) a, quantile_cont(p, 0.999) b, quantile_cont(p, 0.005) c, quantile_cont(p, 0.995) d from z), t as (select corr(p, y) as x, corr(greatest(a, least(b, p)), y) as u, corr(greatest(c, least(d, p)), y) as v from z, q) select unnest([0.0, 0.001, 0.005])::double as q, round(unnest([x, u, v]), 6) + 0.0 as corr from t")
def _(spark, d):
    return rounded(en.winsorize_audit(events(spark, d), "p", "y"), "corr")


@query("carve_lenses", ZED + """, k as (select event_id, zp as raw, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rk, sign(zp) * sqrt(abs(zp)) as sq, tanh(zp) as th, greatest(quantile_cont(zp, 0.01) over (), least(quantile_cont(zp, 0.99) over (), zp)) as cl, sign(zp) * pow(abs(zp), 1.5) as pw from z),
s as (select avg(rk) ra, stddev_pop(rk) + 1e-12 rb, avg(sq) sa, stddev_pop(sq) + 1e-12 sb, avg(th) ta, stddev_pop(th) + 1e-12 tb, avg(cl) ca, stddev_pop(cl) + 1e-12 cb, avg(pw) pa, stddev_pop(pw) + 1e-12 pb from k)
select event_id, round(raw, 6) + 0.0 as raw, round((rk - ra) / rb, 6) + 0.0 as rank, round((sq - sa) / sb, 6) + 0.0 as sqrt, round((th - ta) / tb, 6) + 0.0 as tanh, round((cl - ca) / cb, 6) + 0.0 as clip, round((pw - pa) / pb, 6) + 0.0 as pow15 from k, s""")
def _(spark, d):
    names = ["raw", "rank", "sqrt", "tanh", "clip", "pow15"]
    return rounded(en.carve_lenses(events(spark, d).select("event_id", "p"), "p").select("event_id", *names), *names)


@query("sealed_audit", CTE + "select round(corr(p, y), 6) + 0.0 as corr, count(*)::bigint as n from e where row_idx >= greatest(1, floor(n_rows * 0.9))")
def _(spark, d):
    e = events(spark, d).filter(ke.split_role(0.1) == "holdout")
    return rounded(e.agg(fn.pearson("p", "y").alias("corr"), F.count("*").alias("n")), "corr")


@query("forward_holdout", CTE + "select feature, round(corr(x, y) filter (where row_idx < floor(n_rows * 0.75) - 50), 6) + 0.0 as past, round(corr(x, y) filter (where row_idx >= floor(n_rows * 0.75)), 6) + 0.0 as future from l group by feature")
def _(spark, d):
    part = lambda role: lambda f: fn.pearson(F.when(ke.forward_role() == role, F.col(f)), "y")
    return rounded(fe.per_feature(events(spark, d), FEATURES, {"past": part("past"), "future": part("future")}), "past", "future").select("feature", "past", "future")


@query("attack_null", CTE + """, q as (select unnest(generate_series(0, 9)) as rd), a as (select rd, seg, p, row_number() over (partition by seg, rd order by row_idx) as k from e, q), b as (select rd, seg, y, row_number() over (partition by seg, rd order by md5(rd::varchar || '-' || row_idx::varchar)) as k from e, q),
n as (select rd, abs(corr(p, y)) as c from a join b using (rd, seg, k) group by rd), t as (select quantile_cont(c, 0.95) as tax from n) select round(tax, 6) as tax, round((select corr(p, y) from e), 6) + 0.0 as oof, round((select corr(p, y) from e) - tax, 6) + 0.0 as deflated from t""")
def _(spark, d):
    return rounded(en.attack_null(events(spark, d), "p", "y", 10), "tax", "oof", "deflated")


@query("many_worlds", CTE + ", w as (select feature, 'seg' as kind, corr(x, y) as c from l group by feature, seg having count(*) >= 80 union all select feature, 'state', corr(x, y) from l group by feature, state having count(*) >= 80) select feature, kind, round(min(c), 6) + 0.0 as worst, round(avg((c > 0)::int), 6) + 0.0 as positive from w group by all")
def _(spark, d):
    e, out = events(spark, d), None
    for s in ("seg", "state"):
        c = fe.per_feature(e, FEATURES, {"c": lambda f: fn.pearson(f, "y"), "n": lambda f: F.count("*")}, (s,)).filter("n >= 80")
        one = c.groupBy("feature").agg(F.lit(s).alias("kind"), F.min("c").alias("worst"), F.avg((F.col("c") > 0).cast("int")).alias("positive"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "worst", "positive")


@query("regime_stress", CTE + ", q as (select quantile_cont(f_mix, 0.7) as q from e), s as (select feature, min(corr) as worst, avg(corr) as mean, avg((corr <= 0)::int) as under from sc group by 1) select l.feature, round(corr(l.x, l.y), 6) + 0.0 as full_corr, round(any_value(worst), 6) + 0.0 as worst, round(any_value(mean), 6) + 0.0 as mean, round(any_value(under), 6) + 0.0 as under, round(case when count(*) filter (where e.f_mix >= q) >= 50 then corr(l.x, l.y) filter (where e.f_mix >= q) end, 6) + 0.0 as loud from l join e using (row_idx) join s on s.feature = l.feature, q group by l.feature")
def _(spark, d):
    e = events(spark, d)
    loud = tr.quantiles(e, "f_mix", [0.7])[0]
    s = fe.segment_corrs(e, FEATURES, "y").groupBy("feature").agg(F.min("corr").alias("worst"), F.avg("corr").alias("mean"), F.avg((F.col("corr") <= 0).cast("int")).alias("under"))
    out = fe.per_feature(e, FEATURES, {"full_corr": lambda f: fn.pearson(f, "y"), "loud": lambda f: F.when(F.count_if(F.col("f_mix") >= loud) >= 50, fn.pearson(F.when(F.col("f_mix") >= loud, F.col(f)), "y"))}).join(s, "feature")
    return rounded(out, "full_corr", "worst", "mean", "under", "loud").drop("pos")


# --- run memory

on_lessons("library_summary", "select family, count(*)::bigint as tries, round(avg(oof), 9) + 0.0 as mean_oof, round(avg(least(width, wf_width)), 9) + 0.0 as mean_width from c group by family", lambda c: c.groupBy("family").agg(F.count("*").alias("tries"), F.avg("oof").alias("mean_oof"), F.avg(F.least("width", "wf_width")).alias("mean_width")), "mean_oof", "mean_width")
on_lessons("ledger_stats", "select skill, count(*)::bigint as n, round(avg(oof - wf_width), 9) + 0.0 as decay from c where oof > 0.02 group by skill", lambda c: c.filter("oof > 0.02").groupBy("skill").agg(F.count("*").alias("n"), F.avg(F.col("oof") - F.col("wf_width")).alias("decay")), "decay")
on_lessons("attention_views", "select 'oof' as kind, key, round(oof, 9) + 0.0 as priority, place::int as place from (select *, row_number() over (order by oof desc, key) as place from c) where place <= 12", lambda c: my.attention_view(c, "oof", "key", "oof", 12), "priority")
on_lessons("relation_edges", "select distinct 'key:' || key as src, 'of' as kind, 'skill:' || skill as dst from c union select distinct 'key:' || key, 'in', 'family:' || family from c", lambda c: my.relation_edges(c, [("key", "of", "skill"), ("key", "in", "family")]))
on_lessons("path_memory", ", s as (select skill, family, transform, oof as a_oof from (select *, row_number() over (partition by skill, family, transform order by n desc) as r from c where family < 'u3') where r = 1) select key, round(oof, 9) + 0.0 as oof, round(a_oof, 9) + 0.0 as a_oof from c left join s using (skill, family, transform)", lambda c: my.path_memory(c.select("key", *ca.AXES, "oof"), {"a": c.filter("family < 'u3'").select(*ca.AXES, "oof", "n")}, list(ca.AXES), "n").select("key", "oof", "a_oof"), "oof", "a_oof")
on_lessons("path_score", "select key, round((greatest(-1, least(1, oof)) + greatest(-1, least(1, width)) + case when family < 'u3' then greatest(-1, least(1, wf_width)) else 0 end) / case when family < 'u3' then 3 else 2 end - overfit / 100.0, 9) + 0.0 as score from c", lambda c: rounded(c.select("key", my.path_score([F.col("oof"), F.col("width"), F.when(F.col("family") < "u3", F.col("wf_width"))], [F.col("overfit") / 100]).alias("score")), "score", to=9))
on_lessons("control_vectors", ", m as (select key, exp(greatest(-80, (oof - max(oof) over ()) * 5)) as e from c) select key, round(e / sum(e) over (), 9) as weight from m", lambda c: rounded(me.softmax_weights(c, "oof", 5.0).select("key", "weight"), "weight", to=9))
on_lessons("hazard_report", ", h as (select transform as col, sum(case when oof <= 0 then -oof else 0 end) as hazard from c group by 1) select col, round(hazard, 9) + 0.0 as hazard, row_number() over (order by hazard desc, col)::int as place from h", lambda c: c.groupBy(F.col("transform").alias("col")).agg(F.sum(F.when(F.col("oof") <= 0, -F.col("oof")).otherwise(0.0)).alias("hazard")).withColumn("place", F.row_number().over(W.orderBy(F.desc("hazard"), "col"))), "hazard")


@query("market_scan", """select n_name, r_name, count(*)::bigint as lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all""")
def _(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    j = j.join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(t("region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of every feature with the target by segment, with the width of each path."""
    s = fe.segment_corrs(events(spark, d), FEATURES, "y")
    return rounded(s.groupBy("feature").agg(F.avg("corr").alias("era_mean"), fn.path_width("corr").alias("width"), F.min("corr").alias("worst")), "era_mean", "width", "worst")


from tidemark.plans import more as _more  # noqa: E402, F401  (registers the further queries)
from tidemark.plans import artifacts as _artifacts  # noqa: E402, F401
from tidemark.plans import assessment as _assessment  # noqa: E402, F401
from tidemark.plans import carves as _carves  # noqa: E402, F401
from tidemark.plans import evidence as _evidence  # noqa: E402, F401
from tidemark.plans import landscape as _landscape  # noqa: E402, F401
from tidemark.plans import ledger as _ledger  # noqa: E402, F401
from tidemark.plans import profiles as _profiles  # noqa: E402, F401
from tidemark.plans import structure as _structure  # noqa: E402, F401
from tidemark.plans import trials as _trials  # noqa: E402, F401
from tidemark.plans import spread as _spread  # noqa: E402, F401
from tidemark.plans import experts as _experts  # noqa: E402, F401
