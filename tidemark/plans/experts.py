"""Queries on models made of several ridges, on suspect rows and on predictions by terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import experts as ex
from tidemark.plans.queries import CTE, events, query, raw_events, rounded

TWO = ["f_k", "f_mod"]


def _loo(name: str, rows: str, alphas: tuple[float, ...], y: str = "y", least: int = 1) -> str:
    """SQL: {name} (cell, n, wa, wb, b), ridges on f_k and f_mod by cell with the penalty of the smallest leave-one-out error."""
    return f"""
, {name}_s as (
  select cell, count(*)::double as n, avg(f_k) as ma, avg(f_mod) as mb, avg({y}) as my, stddev_pop(f_k) as sa, stddev_pop(f_mod) as sb, corr(f_k, f_mod) as r,
    covar_pop(f_k, {y}) / stddev_pop(f_k) as ca, covar_pop(f_mod, {y}) / stddev_pop(f_mod) as cb
  from {rows} group by cell having count(*) >= {least}
)
, {name}_t as (select *, n + alpha as q, (n + alpha) ** 2 - n * n * r * r as det from {name}_s, (select unnest({list(alphas)}::double[]) as alpha))
, {name}_w as materialized (select *, n * (ca * q - n * r * cb) / det as wu, n * (cb * q - n * r * ca) / det as wv from {name}_t)
, {name}_e as (
  select cell, alpha, avg(((y0 - my - wu * u - wv * v) / (1 - 1 / n - (q * (u * u + v * v) - 2 * n * r * u * v) / det)) ** 2) as error
  from (select w.*, z.{y} as y0, (f_k - ma) / sa as u, (f_mod - mb) / sb as v from {rows} z join {name}_w w on w.cell = z.cell) group by cell, alpha
)
, {name}_b as (select cell, arg_min(alpha, error) as alpha from {name}_e group by cell)
, {name} as materialized (select w.cell, n, wu / sa as wa, wv / sb as wb, my - wu / sa * ma - wv / sb * mb as b from {name}_w w join {name}_b using (cell, alpha))
"""


query("fit_bagged_ridge", CTE + ", t as (select *, row_idx % 8 as cell from e)" + _loo("m", "t", ex.ALPHAS, least=100) + """
, w as (select avg(wa) as wa, avg(wb) as wb, avg(b) as b from m)
select event_id, round(b + wa * f_k + wb * f_mod, 6) + 0.0 as pred from e, w
""")(lambda spark, d: rounded((e := events(spark, d)).select("event_id", ex.fit_bagged_ridge(e, TWO, "y").predict().alias("pred")), "pred"))

query("fit_terrain_router", CTE + ", t as (select *, state as cell from e), a as (select *, 0 as cell from e)" + _loo("g", "a", ex.ALPHAS) + _loo("m", "t", ex.EXPERT_ALPHAS, least=200) + """
select event_id, round(case when m.cell is null then base else (2000 * base + m.n * (m.b + m.wa * f_k + m.wb * f_mod)) / (m.n + 2000) end, 6) + 0.0 as pred
from (select e.*, b + wa * f_k + wb * f_mod as base from e, g) p left join m on m.cell = p.state
""")(lambda spark, d: rounded((e := raw_events(spark, d).withColumn("state", (F.col("f_k") % 3).cast("int"))).select("event_id", ex.fit_terrain_router(e, TWO, "y", "state", least=200).alias("pred")), "pred"))

query("fit_steepness", CTE + ", a as (select *, abs(y) as size, 0 as cell from e)" + _loo("g", "a", ex.ALPHAS) + _loo("h", "a", ex.ALPHAS, y="size") + """
, p as (select event_id, g.b + g.wa * f_k + g.wb * f_mod as way, h.b + h.wa * f_k + h.wb * f_mod as size from e, g, h)
, q as (select avg(size) as m, stddev_pop(size) + 1e-9 as s from p)
select event_id, round(way * (1 + 0.5 * greatest(-1.5, least(1.5, (size - m) / s))), 4) + 0.0 as pred from p, q
""")(lambda spark, d: rounded((e := raw_events(spark, d)).select("event_id", ex.fit_steepness(e, TWO, "y").alias("pred")), "pred", to=4))

query("fit_terrace", CTE + ", a as (select *, 0 as cell from e)" + _loo("g", "a", ex.ALPHAS) + """
, p as materialized (select event_id, y, b + wa * f_k + wb * f_mod as s from e, g)
, q as (select list_distinct(quantile_cont(s, list_transform(generate_series(1, 15), lambda i: i / 16))) as edges, avg(s) as ms, stddev_pop(s) + 1e-9 as ss, avg(y) as my from p)
, c as (select p.*, ms, ss, my, len(list_filter(edges, lambda x: x <= s)) as step from p, q)
, t as (select step, (sum(y) + 25 * any_value(my)) / (count(*) + 25) as level from c group by step)
, u as (select c.*, level from c join t using (step))
, v as (select avg(level) as ml, stddev_pop(level) + 1e-9 as sl from u)
select event_id, round(0.5 * (s - ms) / ss + 0.5 * (level - ml) / sl, 6) + 0.0 as pred from u, v
""")(lambda spark, d: rounded((e := raw_events(spark, d)).select("event_id", ex.fit_terrace(e, TWO, "y").alias("pred")), "pred"))

query("fit_rapids", CTE + ", a as (select *, 0 as cell from e)" + _loo("g", "a", ex.ALPHAS) + """
, p as materialized (select e.*, b + wa * f_k + wb * f_mod as way, y - (b + wa * f_k + wb * f_mod) as res from e, g)
, r as (select *, 0 as cell from p where abs(res) >= (select quantile_cont(abs(res), 0.7) from p))
""" + _loo("h", "r", ex.EXPERT_ALPHAS, y="res", least=200) + """
, k as (select max(seg) as last, count(*) as n, count(*) filter (where seg = (select max(seg) from e)) as on_last from e)
, valid as (select p.*, h.b + h.wa * f_k + h.wb * f_mod as more from p, h, k where case when on_last >= 50 and on_last <= 0.6 * k.n then seg = last else row_idx % 4 = 0 end)
, tried as (select w, corr(way + w * more, y) as score from valid, (select unnest([0.0, 0.25, 0.5]::double[]) as w) group by w having count(*) >= 50)
, best as (select coalesce(arg_max(w, (score, -w)), 0) as w from tried)
select event_id, round(way + w * coalesce(h.b + h.wa * f_k + h.wb * f_mod, 0), 6) + 0.0 as pred from p cross join best left join h on true
""")(lambda spark, d: rounded((e := events(spark, d)).select("event_id", ex.fit_rapids(e, TWO, "y").predict().alias("pred")), "pred"))

query("row_court", CTE + """
, g as (select avg(p) as mp, stddev_pop(p) + 1e-12 as sp, covar_pop(p, y) as c, stddev_pop(y) + 1e-9 as sy from e)
, lo as (select event_id, y, seg, state, y - (p - mp) / sp * (c / sp) as left_over, sy from e, g)
, z as (select *, abs(left_over) / (stddev_pop(left_over) over () + 1e-12) as r, abs(y - avg(y) over (partition by seg, state)) / sy as dev from lo)
select event_id, round(r, 6) as studentized_resid, round(dev, 6) as cell_dev, round(r * (0.5 + 0.5 * least(dev, 3)), 6) as bad_data_score
from z where r >= (select quantile_cont(r, 0.99) from z) order by r desc, event_id limit 200
""")(lambda spark, d: rounded(ex.row_court(events(spark, d), "event_id", "p", "y", ["seg", "state"]), "studentized_resid", "cell_dev", "bad_data_score"))

query("terrain_trails", CTE + """
, v as (select state, y, 'p' as path, p as x from e union all select state, y, 'f_mod', f_mod from e)
select path, state as terrain, count(*)::bigint as rows, round(corr(x, y), 6) + 0.0 as corr from v group by path, state having count(*) >= 200
""")(lambda spark, d: rounded(ex.terrain_trails(events(spark, d), ["p", "f_mod"], "y", "state", 200), "corr"))
