"""Further queries: sources, profiles, feature families, transforms, linear models, scores and blends, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import sources as so
from tidemark.operators import families as fa
from tidemark.operators import features as fe
from tidemark.operators import keys as ke
from tidemark.operators import linear as li
from tidemark.operators import learned as ml
from tidemark.operators import metrics as me
from tidemark.operators import models as mo
from tidemark.operators import profile as pr
from tidemark.operators import scores as sc
from tidemark.operators import transforms as tr
from tidemark.plans.queries import CTE, FEATURES, events, on_lessons, query, ranker, raw_events, rounded, table, transform

# --- sources and profiles


@query("read_table", "select o_orderkey, o_custkey, o_orderstatus from orders")
def _(spark, d):
    return so.read_table(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("load_pair", "select 'train' as side, count(*)::bigint as n, 6::bigint as n_columns from orders union all select 'test', count(*)::bigint, 5::bigint from orders")
def _(spark, d):
    a, b = so.load_pair(spark, f"{d}/orders.parquet", f"{d}/orders.parquet", "o_totalprice")
    one = lambda name, t: t.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.lit(len(t.columns)).cast("long").alias("n_columns"))
    return one("train", a).unionByName(one("test", b))


@query("select_features", "select unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount']) as feature, count(*)::bigint as n from lineitem")
def _(spark, d):
    t = table(spark, d, "lineitem")
    return fe.per_feature(t, so.select_features(t, t.drop("l_tax"), ("label",)), {"n": lambda f: F.count(f)}).select("feature", "n")


_RAW_SCORES = """with raw as (select case when event_id % 7 = 0 then '' else 'runs/' || event_type || '-' || event_id || '.csv' end as filename, case when event_id % 14 = 0 then 'alt/x' || event_id || '.csv' end as file,
  case when event_id % 5 = 0 then 'none' else '0.0' || lpad((event_id * 7 % 10000)::varchar, 4, '0') end as private, '0.0' || lpad((event_id * 11 % 10000)::varchar, 4, '0') as public,
  case when event_id % 9 = 0 then 'External Reference' else 'mix of s' || user_id || ' and S' || (event_id % 50) end as message from events),
scores as (select split_part(coalesce(nullif(filename, ''), nullif(file, '')), '/', -1) as filename, try_cast(private as double) as private, try_cast(public as double) as public, coalesce(message, '') as description
  from raw where coalesce(nullif(filename, ''), nullif(file, '')) is not null) """


def _scores(spark, d):
    e, at = table(spark, d, "events"), F.col("event_id")
    digits = lambda k: F.concat(F.lit("0.0"), F.lpad((at * k % 10000).cast("string"), 4, "0"))
    return sc.score_rows(e.select(
        F.when(at % 7 == 0, "").otherwise(F.concat(F.lit("runs/"), "event_type", F.lit("-"), at, F.lit(".csv"))).alias("filename"), F.when(at % 14 == 0, F.concat(F.lit("alt/x"), at, F.lit(".csv"))).alias("file"),
        F.when(at % 5 == 0, "none").otherwise(digits(7)).alias("private"), digits(11).alias("public"),
        F.when(at % 9 == 0, "External Reference").otherwise(F.concat(F.lit("mix of s"), "user_id", F.lit(" and S"), at % 50)).alias("message"),
    ))


query("scores_source", _RAW_SCORES + "select * from scores")(_scores)
query("classify_scores", _RAW_SCORES + """select filename, case when contains(lower(filename || ' ' || description), 'external reference') then 'external_reference_only' when private is null then 'missing_score' when private >= 0.09 - 0.00008 then 'promote_as_teacher'
  when private >= 0.09 - 0.0006 then 'near_champion_neighbor' when public > 0.05 and private < 0.09 then 'public_stabilizer_private_lag' when private < 0.09 - 0.006 then 'negative_witness_or_demote' when private < 0.09 - 0.002 then 'weak_route_rehabilitate_only' else 'useful_witness' end as action from scores""")(
    lambda spark, d: sc.classify_scores(_scores(spark, d), 0.09, 0.05).select("filename", "action")
)
query("match_runs", _RAW_SCORES + ", t as (select filename, unnest(list_distinct(regexp_extract_all(lower(description), '\\bs([0-9]+)\\b', 1))) as seed from scores) select distinct filename, c_name as run from t join customer on c_custkey::varchar = seed")(
    lambda spark, d: sc.match_runs(_scores(spark, d), table(spark, d, "customer").select(F.col("c_name").alias("run"), F.col("c_custkey").alias("seed")))
)


@query("drop_ids_rename_target", CTE + "select event_type, f_user, f_k, f_day, 0.0::double as f_mod, f_mix from e")
def _(spark, d):
    e = raw_events(spark, d)
    train, test = pr.drop_ids_rename_target(e, e.drop("y", "f_mod"), ["event_id"], "y")
    return test.select(*[c for c in train.columns if c != "label"])


@query("inner_time_split", CTE + ", c as (select max(seg) as s from e), g as (select s, count(*) filter (where seg = s) as k, count(*) as n from e, c group by s) select e.event_id, case when (k >= 50 and k <= 0.6 * n and seg = s) or (not (k >= 50 and k <= 0.6 * n) and event_id % 4 = 0) then 'valid' else 'train' end as role from e, g")
def _(spark, d):
    e = events(spark, d)
    last = e.agg(F.max("seg")).first()[0]
    got = e.agg(F.count_if(F.col("seg") == last).alias("k"), F.count("*").alias("n")).first()
    valid = (F.col("seg") == last) if 50 <= got["k"] <= 0.6 * got["n"] else (F.col("event_id") % 4 == 0)
    return e.select("event_id", F.when(valid, "valid").otherwise("train").alias("role"))


# --- scores


@query("score_metric", CTE + "select unnest(['pearson', 'rmse', 'neg_rmse']) as metric, round(unnest([corr(p, y), -sqrt(avg((p - y) ** 2)) / (stddev_pop(y) + 1e-9), -sqrt(avg((p - y) ** 2)) / (stddev_pop(y) + 1e-9)]), 6) + 0.0 as score from e")
def _(spark, d):
    e, out = events(spark, d), None
    for m in ("pearson", "rmse", "neg_rmse"):
        one = me.score_metric(e, "p", "y", m, "row_idx").select(F.lit(m).alias("metric"), "score")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "score")


@query("sense_gap", CTE + ", r as (select p, y, row_number() over (order by p, row_idx) as a, row_number() over (order by y, row_idx) as b from e) select round(abs(corr(p, y) - corr(a, b)), 6) as gap from r")
def _(spark, d):
    e = events(spark, d)
    return rounded(me.spearman(e, "p", "y", "row_idx").join(F.broadcast(e.agg(fn.pearson("p", "y").alias("c")))).select(F.abs(F.col("c") - F.col("spearman")).alias("gap")), "gap")


@query("uniqueness", CTE + ", c as (select a.feature, abs(corr(a.x, b.x)) as c from l a join l b on a.row_idx = b.row_idx and a.feature <> b.feature group by a.feature, b.feature) select feature, round(greatest(0, 1 - max(c)), 6) + 0.0 as uniqueness from c group by 1")
def _(spark, d):
    c = fe.correlations(fe.moment_rows(raw_events(spark, d), FEATURES)).withColumn("c", F.abs("corr"))
    both = c.select(F.col("i").alias("feature"), "c").unionByName(c.select(F.col("j").alias("feature"), "c"))
    return rounded(both.groupBy("feature").agg(F.greatest(F.lit(0.0), 1 - F.max("c")).alias("uniqueness")), "uniqueness")


# --- feature families

_ABS = ", c as (select feature, pos, corr(x, y) as c from l group by 1, 2)"
ranker("rank_credit", _ABS + ", s as (select feature, abs(c) as c, sqrt((pos + 1) * (pos + 1) * 3.0) as s from c) select feature, round(0.65 * s / (max(s) over () + 1e-12) + 0.35 * c / (max(c) over () + 1e-12), 6) + 0.0 as score from s",
       lambda e: fa.rank_credit(e, FEATURES, "y", fe.corr_vector(e, FEATURES, "y").select("feature", ((F.col("pos") + 1) * (F.col("pos") + 1) * 3.0).alias("credit"))))
ranker("rank_terrain", ", q as (select *, (row_idx * 7 % 5) as t from l), g as (select feature, t, count(*) as n, avg(x) as m, var_pop(x) as v from q group by all), h as (select *, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) as a from g) select feature, round(sum(n * (m - a) ** 2) / (sum(n * v) + 1e-12), 6) + 0.0 as score from h group by 1",
       lambda e: fe.anova_f(e.withColumn("t", F.col("row_idx") * 7 % 5), FEATURES, "t"))
ranker("rank_pressure", ", t as (select feature, row_idx % 3 as t, abs(corr(x, y)) as c from l group by all having count(*) >= 20) select feature, round(min(c), 6) + 0.0 as score from t group by 1", lambda e: fe.rank_by_state(e.withColumn("t", F.col("row_idx") % 3), FEATURES, "y", "t", 20))
ranker("rank_room_transition", ", g as (select row_idx, state, lag(state) over (order by row_idx) as s from e) select feature, round(abs(corr(x, y)), 6) + 0.0 as score from l join g using (row_idx) where g.state <> s group by 1", lambda e: fa.rank_room_transition(e, FEATURES, "y", ["state"], 30))
ranker("rank_testlike_stable", _ABS + """, a as (select feature, avg(x) as m, var_pop(x) as v from l where row_idx < floor(n_rows * 0.75) group by 1), b as (select feature, avg(x) as m2, var_pop(x) as v2 from l where row_idx >= floor(n_rows * 0.75) group by 1),
s as (select feature, abs(m2 - m) / (sqrt(v) + 1e-9) + 0.5 * abs(ln((v2 + 1e-9) / (v + 1e-9))) as s from a join b using (feature)) select feature, round(abs(c) * (1 - 0.5 * s / (max(s) over () + 1e-9)), 6) + 0.0 as score from c join s using (feature)""",
       lambda e: fa.rank_testlike_stable(e, FEATURES, "y", fe.feature_shift(e.filter("row_idx < floor(n_rows * 0.75)"), e.filter("row_idx >= floor(n_rows * 0.75)"), FEATURES)))
ranker("rank_consensus", _ABS + ", g as (select *, avg(c) over w as m, avg(abs(c)) over w as a from c window w as (partition by pos % 2)) select feature, round(abs(c) * (1 + 0.5 * abs(m) / (a + 1e-9) * (sign(c) = sign(m))::int), 6) + 0.0 as score from g",
       lambda e: fa.rank_consensus(e, FEATURES, "y", fe.corr_vector(e, FEATURES, "y").select("feature", (F.col("pos") % 2).alias("community"))))
ranker("rank_pls_weight", ", k as (select feature, pos, covar_pop(x, y) / (stddev_pop(x) + 1e-12) as u, stddev_pop(x) + 1e-12 as sd from l group by 1, 2), m as (select a.feature as i, b.feature as j, covar_pop(a.x, b.x) as c from l a join l b using (row_idx) group by 1, 2), t as (select sum(i.u * j.u * m.c / i.sd / j.sd) as q, (select sum(u * u) from k) as n from m join k i on i.feature = m.i join k j on j.feature = m.j) select feature, round(abs(u * n / q), 6) + 0.0 as score from k, t",
       lambda e: _pls_weights(e))


def _pls_weights(e):
    w = mo.pls1(e, FEATURES, "y", 1)
    return fe.corr_vector(e, FEATURES, "y").select("feature", "pos", F.element_at(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.lit(abs(w[f])))]), F.col("feature")).alias("score"))


@query("rank_decor", CTE + _ABS + ", m as (select a.feature as i, b.feature as j, abs(corr(a.x, b.x)) as r from l a join l b on a.row_idx = b.row_idx and a.feature <> b.feature group by 1, 2), o as (select *, row_number() over (order by abs(c) desc, pos) as k from c), s as (select o.feature, o.k from o where not exists (select 1 from m join o b on b.feature = m.j where m.i = o.feature and b.k < o.k and m.r >= 0.9)) select feature, row_number() over (order by k)::int as place from s")
def _(spark, d):
    kept = fa.rank_decor(raw_events(spark, d), FEATURES, "y")
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(kept)], "feature string, place int")


@query("rank_demote", CTE + _ABS + ", r as (select feature, pos, row_number() over (order by abs(c) desc, pos) as rk from c) select feature, row_number() over (order by feature = 'f_day', rk + pos * 0.75, rk)::int as place from r")
def _(spark, d):
    c = fe.rank_top(raw_events(spark, d), FEATURES, "y")
    return fa.rank_demote(fe.ranked(c), c.select("feature", (F.col("pos") * 0.75).alias("hazard")), ["f_day"]).select("feature", "place")


# --- transforms

transform("tf_dual_exposure", ", q as (select unnest(quantile_cont(y, [i / 31.0 for i in generate_series(1, 30)])) as edge from e), b as (select quantile_cont(y, 0.005) as lo, quantile_cont(y, 0.995) as hi from e) select event_id, round((select count(*) from q where edge < y) / 31.0, 4) + 0.0 as exposure, round(round_even((greatest(lo, least(hi, y)) - lo) / greatest(hi - lo, 1e-12) * 15, 0) / 15 * (hi - lo) + lo, 4) + 0.0 as out from e, b",
          lambda e: tr.tf_quantize(tr.tf_rank(e, "y", 30).withColumnRenamed("out", "exposure"), "y"), ("exposure", "out"), to=4)
_Z = ", m as (select avg(f_k) as ma, stddev_pop(f_k) + 1e-6 as sa, avg(f_mod) as mb, stddev_pop(f_mod) + 1e-6 as sb, avg(y) as mc, stddev_pop(y) + 1e-6 as sc, avg(100 - f_mod + f_k) as md, stddev_pop(100 - f_mod + f_k) + 1e-6 as sd from e), z as (select event_id, (f_k - ma) / sa as a, (f_mod - mb) / sb as b, (y - mc) / sc as c, (100 - f_mod + f_k - md) / sd as d from e, m) "
transform("tf_fold_pairs", _Z + "select event_id, round((b - d) * 0.5, 5) + 0.0 as fold_0, round(abs(b + d) * 0.5, 5) + 0.0 as ridge_0 from z", lambda e: fa.tf_fold_pairs(e.withColumn("neg", 100 - F.col("f_mod") + F.col("f_k")), ["f_k", "f_mod", "neg"], pairs=1), ("fold_0", "ridge_0"), to=5)
transform("tf_lateral_line", _Z + "select event_id, round(a - (b + c) / 2, 5) + 0.0 as eddy_f_k, round(b - (a + c) / 2, 5) + 0.0 as eddy_f_mod, round(c - (a + b) / 2, 5) + 0.0 as eddy_y from z", lambda e: fa.tf_lateral_line(e, ["f_k", "f_mod", "y"]), ("eddy_f_k", "eddy_f_mod", "eddy_y"), to=5)
_G = np.random.default_rng(7).normal(size=(3, 2)) / np.sqrt(2)
transform("tf_rand_proj", " select event_id, " + ", ".join(f"round(f_k * ({_G[0, j]!r}::double) + f_mod * ({_G[1, j]!r}::double) + f_day * ({_G[2, j]!r}::double), 6) + 0.0 as proj_{j}".replace("np.float64(", "(") for j in (0, 1)) + " from e",
          lambda e: fa.tf_rand_proj(e, ["f_k", "f_mod", "f_day"], 2, 7), ("proj_0", "proj_1"))
transform("tf_signed_hadamard", " select event_id, (f_k - f_mod + f_day) / 2 as had_0, (f_k + f_mod + f_day) / 2 as had_1, (f_k - f_mod - f_day) / 2 as had_2, (f_k + f_mod - f_day) / 2 as had_3 from e", lambda e: fa.tf_signed_hadamard(e, ["f_k", "f_mod", "f_day"], [1, -1, 1]), ("had_0", "had_1", "had_2", "had_3"))
transform("tf_lorentz", ", g as (select *, coalesce(y - lag(y) over w, 0) as vy, coalesce(f_k - lag(f_k) over w, 0) as vk from e window w as (order by row_idx)), b as (select *, 0.6 * least(0.99, (abs(vy) + abs(vk)) / 2) as b from g), h as (select *, 1 / sqrt(1 - b * b + 1e-6) as g from b) select event_id, round(g * (y - b * vy), 5) + 0.0 as x_y, round(g * (vk - b * f_k), 5) + 0.0 as v_f_k from h",
          lambda e: fa.tf_lorentz(e, ["y", "f_k"]), ("x_y", "v_f_k"), to=5)
transform("tf_fractal", ", p as (select a.event_id, any_value(a.y) as y, sum(case when a.row_idx - b.row_idx <= 200 then b.y * pow(7.0/9.0, a.row_idx - b.row_idx) * case when b.row_idx = 0 then 1 else 2.0/9.0 end else 0 end) as fine, sum(b.y * pow(31.0/33.0, a.row_idx - b.row_idx) * case when b.row_idx = 0 then 1 else 2.0/33.0 end) as coarse from e a join e b on b.row_idx between a.row_idx - 700 and a.row_idx group by 1) select event_id, round(y, 6) + 0.0 as y, round(fine, 6) + 0.0 as fine, round(coarse, 6) + 0.0 as coarse from p",
          lambda e: tr.ema(tr.ema(e, "y", 8, "fine"), "y", 32, "coarse"), ("y", "fine", "coarse"))

# --- linear models, from sums

_TWO = ", s as (select count(*) as n, avg(f_k) as ma, avg(f_mod) as mb, avg(y) as my, stddev_pop(f_k) + 1e-12 as sa, stddev_pop(f_mod) + 1e-12 as sb, covar_pop(f_k, f_mod) / (stddev_pop(f_k) + 1e-12) / (stddev_pop(f_mod) + 1e-12) as r, covar_pop(f_k, y) / (stddev_pop(f_k) + 1e-12) as ca, covar_pop(f_mod, y) / (stddev_pop(f_mod) + 1e-12) as cb, stddev_pop(y) as sy from e)"
_ALPHAS = "[" + ", ".join(repr(a) for a in li.ALPHAS) + "]"


@query("ridge_cv", CTE + _TWO + f""", a as (select unnest({_ALPHAS}::double[]) as alpha), k as (select *, n + alpha as pp, n * r as qq, (n + alpha) ** 2 - (n * r) ** 2 as det from s, a),
b as (select *, (pp * n * ca - qq * n * cb) / det as wa, (pp * n * cb - qq * n * ca) / det as wb from k), z as (select alpha, (e.y - my) as t, (f_k - ma) / sa as u, (f_mod - mb) / sb as v, wa, wb, pp, qq, det, n from e, b),
o as (select alpha, sqrt(avg(((t - wa * u - wb * v) / (1 - 1.0 / n - (pp * u * u - 2 * qq * u * v + pp * v * v) / det)) ** 2)) as loo from z group by 1) select round(alpha, 6) as alpha, round(loo, 6) as loo from o""")
def _(spark, d):
    return rounded(li.ridge_cv(raw_events(spark, d), ["f_k", "f_mod"], "y"), "alpha", "loo").select("alpha", "loo")


def _weighted(rows: str, weight: str, key: str) -> str:
    """SQL: (key, wa, wb, b0) of weighted two-feature ridge with alpha 10 over `rows` (key, f_k, f_mod, y, w)."""
    return f""", w as (select {key} as key, f_k, f_mod, y, {weight} as w from {rows}), s1 as (select key, sum(w) as n, sum(w * f_k) / sum(w) as ma, sum(w * f_mod) / sum(w) as mb, sum(w * y) / sum(w) as my from w group by 1),
s2 as (select w.key, any_value(n) as n, any_value(ma) as ma, any_value(mb) as mb, any_value(my) as my, sum(w * (f_k - ma) ** 2) / any_value(n) as va, sum(w * (f_mod - mb) ** 2) / any_value(n) as vb, sum(w * (f_k - ma) * (f_mod - mb)) / any_value(n) as vab, sum(w * (f_k - ma) * (y - my)) / any_value(n) as ca, sum(w * (f_mod - mb) * (y - my)) / any_value(n) as cb from w join s1 on s1.key = w.key group by 1),
s3 as (select *, sqrt(va) + 1e-12 as sa, sqrt(vb) + 1e-12 as sb from s2), s4 as (select *, n * va / sa / sa + 10 as p, n * vab / sa / sb as q, n * vb / sb / sb + 10 as r, n * ca / sa as u, n * cb / sb as v from s3),
fit as (select key, (u * r - v * q) / (p * r - q * q) / sa as wa, (v * p - u * q) / (p * r - q * q) / sb as wb, my, ma, mb from s4)"""


@query("fit_recency_weighted", CTE + ", g as (select e.*, lam, max(seg) over () as last from e, (select unnest([0.0, 1.0, 3.0, 8.0]::double[]) as lam))" + _weighted("g where seg < last", "exp(-lam * (n_rows - 1 - row_idx) / greatest(1, n_rows - 1))", "lam") + " select key as lam, round(corr(wa * g.f_k + wb * g.f_mod, g.y), 6) + 0.0 as score from g join fit on g.lam = fit.key where seg = last group by 1")
def _(spark, d):
    return rounded(li.recency_weighted(events(spark, d), ["f_k", "f_mod"], "y"), "score")


@query("fit_recency_ridge", CTE + ", g0 as (select *, max(seg) over () as last from e), g1 as (select *, 1 + max(case when seg < last then row_idx end) over () as upto from g0), g as (select * from g1, (select unnest([0.15, 0.3, 0.5, 1.0]::double[]) as share))" + _weighted("g where seg < last and row_idx >= floor(upto * (1 - share))", "1.0", "share") + " select key as share, round(corr(wa * g.f_k + wb * g.f_mod, g.y), 6) + 0.0 as score from g join fit on g.share = fit.key where seg = last group by 1")
def _(spark, d):
    return rounded(li.recency_ridge(events(spark, d), ["f_k", "f_mod"], "y"), "score")


@query("nnls_weights", CTE + ", s as (select covar_pop(p, f_user) / stddev_pop(p) / stddev_pop(f_user) as r, covar_pop(p, y) / stddev_pop(p) as ca, covar_pop(f_user, y) / stddev_pop(f_user) as cb from e), u as (select *, (ca - r * cb) / (1 - r * r) as a, (cb - r * ca) / (1 - r * r) as b from s), w as (select case when a > 0 and b > 0 then a when ca >= cb then greatest(ca, 0) else 0 end as a, case when a > 0 and b > 0 then b when cb > ca then greatest(cb, 0) else 0 end as b from u), x as (select unnest(['p', 'f_user']) as member, unnest([a, b]) / (a + b) as weight from w) select member, round(weight, 6) as weight from x where weight > 1e-9")
def _(spark, d):
    w = li.nnls_weights(events(spark, d), ["p", "f_user"], "y")
    return rounded(spark.createDataFrame(list(w.items()), "member string, weight double"), "weight")


@query("fit_theil_sen", CTE + "select count(*)::bigint as pairs, round(median((b.y - a.y) / (b.f_k - a.f_k)), 6) + 0.0 as slope from e a join e b on b.row_idx = a.row_idx + 7 where b.f_k <> a.f_k")
def _(spark, d):
    return rounded(li.theil_sen(events(spark, d), "f_k", "y", 7), "slope")


@query("fit_single_factor", CTE + ", g as (select *, max(seg) over () as last from l), k as (select feature, pos, sign(regr_slope(y, x) filter (where seg < last)) * corr(x, y) filter (where seg = last) as score, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from g group by 1, 2) select feature, round(slope, 6) + 0.0 as slope, round(intercept, 6) + 0.0 as intercept from k order by score desc, pos limit 1")
def _(spark, d):
    return rounded(li.single_factor(events(spark, d), FEATURES, "y"), "slope", "intercept")


@query("fit_pls", CTE + _TWO + ", q as (select *, (ca * ca + cb * cb) / (ca * ca + 2 * r * ca * cb + cb * cb) as k from s) select unnest(['f_k', 'f_mod']) as feature, round(unnest([ca * k, cb * k]), 6) + 0.0 as beta from q")
def _(spark, d):
    return rounded(spark.createDataFrame(list(mo.pls1(raw_events(spark, d), ["f_k", "f_mod"], "y", 1).items()), "feature string, beta double"), "beta")


# --- candidates and blends

_TIERS = {"click": 0.1, "view": 0.7, "purchase": 0.92}
_STEPS = {"t0": 0.0, "t1": 0.4, "t2": 0.6}
_case = lambda col, d, other: f"case {col} " + " ".join(f"when '{k}' then {v}" for k, v in d.items()) + f" else {other} end"
on_lessons("complexity", f"select key, round(0.4 * {_case('skill', _TIERS, 0.5)} + 0.3 * least(1, n % 50 / 40.0) + 0.15 * {_case('transform', _STEPS, 0.3)} + 0.15 * least(1, greatest(0, (overfit - 1) / 5.0)), 9) + 0.0 as complexity from c",
           lambda c: sc.complexity(c.withColumn("k", F.col("n") % 50), c.sparkSession.createDataFrame(list(_TIERS.items()), "skill string, tier double"), c.sparkSession.createDataFrame(list(_STEPS.items()), "transform string, step double"), 40.0, 6.0).select("key", "complexity"), "complexity")
on_lessons("selection_deflation", "select key, oof - wf_width > 0.0015 + 0.001 * ln(n) as wins from c", lambda c: c.select("key", sc.beats_selection(F.col("oof") - F.col("wf_width"), F.col("n")).alias("wins")))
on_lessons("train_cv_gap", "select key, round(width - oof, 9) + 0.0 as gap, round(oof - wf_width, 9) + 0.0 as decay, overfit > 6 or wf_width <= 0 as alarm from c", lambda c: sc.train_cv_gap(c.withColumn("fit", F.col("width")).withColumn("wf", F.col("wf_width"))).select("key", "gap", "decay", "alarm"), "gap", "decay")
on_lessons("overfit_ratio", "select key, round(case when oof > 0 then least(999, width / greatest(oof, 1e-6)) else 999 end, 6) + 0.0 as ratio from c", lambda c: c.select("key", F.round(sc.overfit_ratio(F.col("width"), F.col("oof")), 6).alias("ratio")), "ratio")


@query("apply_weights", CTE + "select event_id, round((f_k * 0.5 + f_mod * 0.3 + y * 0.2) / (0.5 + 0.3 + 0.2), 6) + 0.0 as blend from e")
def _(spark, d):
    e = raw_events(spark, d)
    long = e.select("event_id", F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.col(m).alias("pred")) for m in ("f_k", "f_mod", "y")])).alias("r")).select("event_id", "r.*")
    w = spark.createDataFrame([("f_k", 0.5), ("f_mod", 0.3), ("y", 0.2)], "member string, weight double")
    return rounded(sc.apply_weights(long, w, "event_id"), "blend")


@query("blend_simple", CTE + "select event_id, round((f_k + f_mod + y) / 3, 6) + 0.0 as equal, round((f_k * 2 + f_mod + y * 3) / 6, 6) + 0.0 as weighted, round(f_k + f_mod + y - greatest(f_k, f_mod, y) - least(f_k, f_mod, y), 6) + 0.0 as middle from e")
def _(spark, d):
    return rounded(sc.blend_simple(raw_events(spark, d), ["f_k", "f_mod", "y"], {"f_k": 2.0, "f_mod": 1.0, "y": 3.0}), "equal", "weighted", "middle").select("event_id", "equal", "weighted", "middle")


@query("pca_components", CTE + _TWO + " select unnest([1, 2]) as component, round(unnest([1 + abs(r), 1 - abs(r)]), 6) as variance, round(unnest([1 + abs(r), 1 - abs(r)]) / 2, 6) as share from s")
def _(spark, d):
    return rounded(li.pca_components(raw_events(spark, d), ["f_k", "f_mod"]), "variance", "share").select("component", "variance", "share")


# --- iterative models of MLlib, whose results SQL cannot express: tests hold them against planted truth


def _scored(e, model):
    pred = model.transform(ml.assembled(e, FEATURES))
    return rounded(pred.select("event_id", F.col("prediction").alias("pred")), "pred")


@query("fit_elastic_net")
def _(spark, d):
    e = raw_events(spark, d)
    return _scored(e, ml.fit_elastic_net(e, FEATURES, "y"))


@query("fit_huber")
def _(spark, d):
    e = raw_events(spark, d)
    return _scored(e, ml.fit_huber(e, FEATURES, "y"))


@query("fit_boosted_trees")
def _(spark, d):
    e = raw_events(spark, d)
    return _scored(e, ml.fit_boosted_trees(e, FEATURES, "y"))


@query("testlike_scores")
def _(spark, d):
    e = events(spark, d)
    return rounded(ml.testlike_scores(e.filter("row_idx < floor(n_rows * 0.75)"), e.filter("row_idx >= floor(n_rows * 0.75)"), FEATURES, "event_id"), "testlike")
