"""Queries on models solved from cells, neighbours, and the choice among blends over many partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bayes as by
from tidemark.operators import linear as li
from tidemark.operators import neighbours as nb
from tidemark.operators import robust as rb
from tidemark.operators.models import linear
from tidemark.plans.queries import CTE, FEATURES, events, query, raw_events, rounded

TWO = ["f_k", "f_mod"]

_S = """
, s as (
  select count(*)::double as n, avg(f_k) as ma, avg(f_mod) as mb, avg(y) as my, stddev_pop(f_k) as sa, stddev_pop(f_mod) as sb, count(*) * var_pop(y) as yy,
    corr(f_k, f_mod) as r, covar_pop(f_k, y) / stddev_pop(f_k) as ca, covar_pop(f_mod, y) / stddev_pop(f_mod) as cb
  from e
)
"""

# Z'Z is n times (1, r; r, 1): its eigenvalues are n (1 + r) and n (1 - r), its axes the sum and the difference of the columns.
query("fit_bayes_ridge", "with recursive " + CTE[5:] + _S + """
, g as (select *, n * (1 + r) as vp, n * (1 - r) as vm, n * (ca + cb) / sqrt(2) as tp, n * (ca - cb) / sqrt(2) as tm from s)
, it as (
  select 0 as k, n / yy as noise, 1.0::double as weight, 0.0::double as p, 0.0::double as m, false as over from g
  union all
  select k + 1, (n - gamma + 2e-6) / (greatest(yy - 2 * (np * tp + nm * tm) + vp * np * np + vm * nm * nm, 0) + 2e-6),
    (gamma + 2e-6) / (np * np + nm * nm + 2e-6), np, nm,
    k > 0 and (abs(np + nm - p - m) + abs(np - nm - p + m)) / sqrt(2) < 1e-3
  from (
    select it.*, g.*, tp / (vp + weight / noise) as np, tm / (vm + weight / noise) as nm, noise * vp / (weight + noise * vp) + noise * vm / (weight + noise * vm) as gamma
    from it, g where not over and k < 300
  )
)
, last as (select arg_max(noise, k) as noise, arg_max(weight, k) as weight from it)
, w as (select *, (tp / (vp + weight / noise) + tm / (vm + weight / noise)) / sqrt(2) as wa, (tp / (vp + weight / noise) - tm / (vm + weight / noise)) / sqrt(2) as wb from g, last)
select event_id, round(my + wa * (f_k - ma) / sa + wb * (f_mod - mb) / sb, 6) + 0.0 as pred from e, w
""")(lambda spark, d: _predicted(raw_events(spark, d), by.fit_bayes_ridge))


def _predicted(e, fit, features=TWO):
    return rounded(e.select("event_id", fit(e, features, "y").predict().alias("pred")), "pred")


query("fit_ard")(lambda spark, d: _predicted(raw_events(spark, d), by.fit_ard, FEATURES))

query("fit_relay", "with recursive " + CTE[5:] + """
, mm as (select avg(f_k) as ma, stddev_pop(f_k) + 1e-6 as sa, avg(f_mod) as mb, stddev_pop(f_mod) + 1e-6 as sb, max(seg) as last, count(*) as n from e)
, lastn as (select count(*) as k from e, mm where seg = last)
, z as materialized (
  select event_id, seg, y, (f_k - ma) / sa as u, (f_mod - mb) / sb as v, case when k >= 50 and k <= 0.6 * n then seg = last else row_idx % 4 = 0 end as valid
  from e, mm, lastn
)
, cells as (
  select 'train' as part, seg, count(*)::double as n, sum(u * u) as uu, sum(u * v) as uv, sum(v * v) as vv, sum(u * y) as uy, sum(v * y) as vy from z where not valid group by seg
  union all
  select 'all', seg, count(*), sum(u * u), sum(u * v), sum(v * v), sum(u * y), sum(v * y) from z group by seg
)
, c as (select *, row_number() over (partition by part order by seg) as k from cells where n >= 50)
, chain as (
  select part, tau, 0::bigint as k, 0.0::double as wu, 0.0::double as wv from (select distinct part from c), (select unnest([0.25, 1.0, 4.0]::double[]) as tau)
  union all
  select part, tau, k, (bu * q - bv * uv) / (p * q - uv * uv), (bv * p - bu * uv) / (p * q - uv * uv)
  from (
    select part, tau, k, uv, uu + 0.5 * n + pull as p, vv + 0.5 * n + pull as q, uy + pull * wu as bu, vy + pull * wv as bv
    from (
      select chain.part, tau, c.k, c.n, uu, uv, vv, uy, vy, wu, wv, case when c.k = 1 then 0 else tau * 0.5 * c.n end as pull
      from chain join c on c.part = chain.part and c.k = chain.k + 1
    )
  )
)
, fits as (select part, tau, arg_max(wu, k) as wu, arg_max(wv, k) as wv from chain group by 1, 2)
, tried as (select tau, corr(wu * u + wv * v, y) as score from z, fits where part = 'train' and valid group by tau)
, best as (select arg_max(tau, (score, -tau)) as tau from tried)
select event_id, round(wu * u + wv * v, 6) + 0.0 as pred from z, fits join best using (tau) where part = 'all'
""")(lambda spark, d: rounded((e := events(spark, d)).select("event_id", by.fit_relay(e, TWO, "y").predict().alias("pred")), "pred"))


_INNER = """
, mm as (select avg(f_k) as ma, stddev_pop(f_k) + 1e-6 as sa, avg(f_mod) as mb, stddev_pop(f_mod) + 1e-6 as sb, max(seg) as last, count(*) as n from e)
, lastn as (select count(*) as k from e, mm where seg = last)
, z as materialized (
  select event_id, f_k, f_mod, y, (f_k - ma) / sa as u, (f_mod - mb) / sb as v, case when k >= 50 and k <= 0.6 * n then seg = last else row_idx % 4 = 0 end as valid
  from e, mm, lastn
)
"""


def _climb(name: str, rows: str) -> str:
    """SQL: {name} (k, a, b), weights of u and v after k rounds of stagewise steps on the rows."""
    return f"""
, {name}_s as (select sum(u * u) as uu, sum(u * v) as uv, sum(v * v) as vv, sum(u * (y - my)) as uy, sum(v * (y - my)) as vy from {rows} r, (select avg(y) as my from {rows} q))
, {name} as (
  select 0 as k, 0.0::double as a, 0.0::double as b
  union all
  select k + 1, a + case when abs(lu) >= abs(lv) then 0.2 * lu / (uu + 1e-9) else 0 end, b + case when abs(lu) >= abs(lv) then 0 else 0.2 * lv / (vv + 1e-9) end
  from (select *, uy - uu * a - uv * b as lu, vy - uv * a - vv * b as lv from {name}, {name}_s where k < 80)
)
"""


@query("fit_residual_ladder", "with recursive " + CTE[5:] + _INNER + ", tr as (select * from z where not valid)" + _climb("c", "tr") + _climb("w", "z") + """
, tries as (select k, corr(a * u + b * v, y) as score from c, z where valid and k > 0 group by k)
, look as (
  select 0 as k, 0 as best, -1e9::double as top
  union all
  select tries.k, case when score > top then tries.k else best end, greatest(score, top) from look join tries on tries.k = look.k + 1 where look.k - best <= 15 or look.k = 0
)
, pick as (select arg_max(best, k) as rounds from look)
select rounds::int as rounds, unnest(['f_k', 'f_mod']) as feature, round(unnest([a, b]), 6) + 0.0 as weight from w join pick on w.k = rounds
""")
def _(spark, d):
    weights, rounds = li.residual_ladder(events(spark, d), TWO, "y")
    return rounded(spark.createDataFrame([(rounds, f, w) for f, w in weights.items()], "rounds int, feature string, weight double"), "weight")


def _ols(name: str, rows: str) -> str:
    """SQL: {name} (a1, b1, a2, c2, b2): least squares on f_k alone, and on f_k and f_mod, with their intercepts."""
    return f"""
, {name}_s as (
  select avg(f_k) as ma, avg(f_mod) as mb, avg(y) as my, var_pop(f_k) as va, var_pop(f_mod) as vb, covar_pop(f_k, f_mod) as vab, covar_pop(f_k, y) as ca, covar_pop(f_mod, y) as cb from {rows}
)
, {name}_w as (select *, ca / va as a1, (ca * vb - cb * vab) / (va * vb - vab * vab) as a2, (cb * va - ca * vab) / (va * vb - vab * vab) as c2 from {name}_s)
, {name} as (select a1, my - a1 * ma as b1, a2, c2, my - a2 * ma - c2 * mb as b2 from {name}_w)
"""


@query("fit_greedy_ols", CTE + _INNER + ", tr as (select * from z where not valid)" + _ols("c", "tr") + _ols("w", "z") + """
, tries as (select corr(a1 * f_k, y) as one, corr(a2 * f_k + c2 * f_mod, y) as two from z, c where valid)
select event_id, round(case when two > one + 1e-4 then b2 + a2 * f_k + c2 * f_mod else b1 + a1 * f_k end, 6) + 0.0 as pred from z, w, tries
""")
def _(spark, d):
    e = events(spark, d)
    return rounded(e.select("event_id", linear(*li.greedy_ols(e, TWO, "y")).alias("pred")), "pred")


query("support_sheaf", CTE + """
, g as (select 1 / (stddev_pop(f_k) + 1e-9) as ga, 1 / (stddev_pop(f_mod) + 1e-9) as gb from e)
, t as (
  select state, count(*) as n, stddev_pop(f_k) + 1e-9 as sa, stddev_pop(f_mod) + 1e-9 as sb, var_pop(f_k) as va, var_pop(f_mod) as vb,
    covar_pop(f_k, f_mod) as vab, covar_pop(f_k, y) as ca, covar_pop(f_mod, y) as cb
  from e group by state having count(*) >= 300
)
, m as (select *, n * va / sa / sa + 10 as p, n * vab / sa / sb as q, n * vb / sb / sb + 10 as r, n * ca / sa as u, n * cb / sb as v from t)
, w as (select state, (u * r - v * q) / (p * r - q * q) * ga as wa, (v * p - u * q) / (p * r - q * q) * gb as wb from m, g)
, s as (select e.state as home, w.state as applied, corr(wa * f_k + wb * f_mod, y) as c from e join t using (state), w group by 1, 2)
select a.home, b.applied, round(a.c, 6) + 0.0 as own_corr, round(b.c, 6) + 0.0 as foreign_corr, round(a.c - b.c, 6) + 0.0 as defect
from s a join s b on a.home = b.home and a.applied = a.home and b.applied <> b.home
""")(lambda spark, d: rounded(by.support_sheaf(events(spark, d), TWO, "y", "state"), "own_corr", "foreign_corr", "defect"))


_KS = (5, 15)
query("fit_knn", CTE + f"""
, b0 as (select * from e where row_idx % greatest(1, n_rows // 200) = 0)
, mm as (select avg(f_k) as ma, stddev_pop(f_k) as sa, avg(f_mod) as mb, stddev_pop(f_mod) as sb from b0)
, lastn as (select max(seg) as last, count(*) filter (where seg = (select max(seg) from e)) as k, count(*) as n from e)
, z as (select event_id, row_idx, y, (f_k - ma) / sa as u, (f_mod - mb) / sb as v, case when k >= 50 and k <= 0.6 * n then seg = last else row_idx % 4 = 0 end as valid from e, mm, lastn)
, bank as materialized (select z.row_idx as place, z.y as t, u, v from z join b0 using (row_idx))
, d as (select event_id, z.y, valid, place, t, round((z.u - bank.u) ** 2 + (z.v - bank.v) ** 2, 9) as d from z, bank)
, r as materialized (select *, row_number() over (partition by event_id order by d, place) as rk from d qualify rk <= {max(_KS)})
, p as materialized (
  select event_id, k, any_value(y) as y, any_value(valid) as valid,
    case when min(d) = 0 then avg(t) filter (where d = 0) else sum(t / sqrt(nullif(d, 0))) / sum(1 / sqrt(nullif(d, 0))) end as pred
  from r, (select unnest({list(_KS)}) as k) where rk <= k group by 1, 2
)
, best as (select arg_max(k, (score, -k)) as k from (select k, corr(pred, y) as score from p where valid group by k))
select event_id, round(pred, 6) + 0.0 as pred from p join best using (k)
""")(lambda spark, d: rounded(nb.fit_knn(events(spark, d), TWO, "y", bank=200, ks=_KS)[0].select("event_id", "pred"), "pred"))


def _cells(spark, d):
    e = events(spark, d).withColumn("terrain", (F.col("row_idx") % 3).cast("int")).withColumn("weather", F.col("state"))
    return rb.testlike_bands(e, "f_mod")


query("robust_partitions", CTE + """
, q as (select quantile_cont(f_mod, 0.75) as a, quantile_cont(f_mod, 0.6) as b from e)
, c as materialized (
  select seg, (row_idx % 3)::int as terrain, state as weather, ((f_mod >= a)::int + (f_mod >= b)::int)::int as band, count(*) as n from e, q group by all
)
, pairs as (select a, b, row_number() over (order by a, b) - 1 as i from (select unnest(generate_series(0, 5)) as a), (select unnest(generate_series(0, 5)) as b) where a < b)
, p as (
  select 'wf' || i as partition, c.*, case when seg < i then 'train' when seg = i then 'test' end as role from c, (select unnest(generate_series(6, 11)) as i)
  union all select 'slide' || i, c.*, case when seg < i and seg >= i - 3 then 'train' when seg = i then 'test' end from c, (select unnest(generate_series(2, 11)) as i)
  union all select 'rev' || i, c.*, case when seg > i then 'train' when seg = i then 'test' end from c, (select unnest(generate_series(0, 5)) as i)
  union all select 'interior0', c.*, case when seg >= 4 and seg < 8 then 'test' else 'train' end from c
  union all select 'interior1', c.*, case when seg >= 3 and seg < 9 then 'test' else 'train' end from c
  union all select 'testlike' || i, c.*, case when band >= 2 - i then 'test' else 'train' end from c, (select unnest([0, 1]) as i)
  union all select 'terr' || t, c.*, case when terrain = t then 'test' else 'train' end from c, (select distinct terrain as t from c)
  union all select 'wx' || t, c.*, case when weather = t then 'test' else 'train' end from c, (select distinct weather as t from c)
  union all select 'cpcv' || i, c.*, case when seg // 2 in (a, b) then 'test' when abs(seg // 2 - a) > 1 and abs(seg // 2 - b) > 1 then 'train' end from c, pairs where i < 12
)
, ok as (select partition from p group by 1 having coalesce(sum(n) filter (where role = 'train'), 0) >= 300 and coalesce(sum(n) filter (where role = 'test'), 0) >= 50)
select partition, seg, terrain, weather, band, role from p join ok using (partition) where role is not null
""")(lambda spark, d: rb.robust_partitions(_cells(spark, d), bands=2, least_train=300, least_test=50))


@query("robust_select")
def _(spark, d):
    members = {"near": ["f_k", "f_mod"], "far": ["f_user", "f_mix"], "all": FEATURES}
    blends = {"incumbent": {"near": 1.0}, "even": {"near": 1.0, "far": 1.0, "all": 1.0}, "wide": {"far": 0.3, "all": 0.7}}
    out = rb.robust_select(_cells(spark, d), members, blends, "y", bands=2, least_train=300, least_test=50)
    rows = [(i + 1, r["config"], r["score"], r["mean"], r["sd"], r["partitions"], r["hedged"]) for i, r in enumerate(out)]
    return rounded(spark.createDataFrame(rows, "place int, config string, score double, mean double, sd double, partitions int, hedged boolean"), "score", "mean", "sd")
