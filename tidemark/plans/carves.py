"""Queries on careful edits of a prediction by another: p is the champion, f_k and f_mod are routes."""

from __future__ import annotations

from tidemark.operators import carve as cv
from tidemark.plans.queries import CTE, events, query, rounded

_LENSES = """
, zz as (select event_id, (p - avg(p) over ()) / (stddev_pop(p) over () + 1e-12) as c, f_k as x, (f_k - avg(f_k) over ()) / (stddev_pop(f_k) over () + 1e-12) as zr from e)
, q as (select quantile_cont(zr, 0.025) as lo, quantile_cont(zr, 0.975) as hi from zz)
, made as (
  select event_id, c, zr as raw, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rank, sign(zr) * sqrt(abs(zr)) as sqrt, tanh(zr) as tanh,
    greatest(lo, least(hi, zr)) as clip, sign(zr) * pow(abs(zr), 1.5) as pow15
  from zz, q
)
, r0 as (select event_id, c, unnest(['raw', 'rank', 'sqrt', 'tanh', 'clip', 'pow15']) as lens, unnest([raw, rank, sqrt, tanh, clip, pow15]) as v from made)
, r1 as (select event_id, c, lens, case when lens = 'raw' then v else (v - avg(v) over w) / (stddev_pop(v) over w + 1e-12) end as r from r0 window w as (partition by lens))
, edge as (select lens, quantile_cont(abs(c - r), 0.95) as qc, quantile_cont(c * r, 0.95) as qa, quantile_cont(abs(r), 0.95) as qt, corr(c, r) as rho from r1 group by lens)
, r2 as (select *, (r - rho * c) / (stddev_pop(r - rho * c) over (partition by lens) + 1e-12) as resid, (abs(c - r) >= qc)::int as conflict, (c * r >= qa)::int as agree, (abs(r) >= qt)::int as tail from r1 join edge using (lens))
, grid as (
  select lens, alpha, c, r, rho, conflict, agree, tail, unnest(['reduce', 'resid_add', 'resid_sub', 'agree_add', 'conflict_sub', 'tail_blend', 'conflict_damp']) as edit,
    unnest([(1 - alpha) * c + alpha * r, c + alpha * resid, c - alpha * resid, c + alpha * resid * agree, c - alpha * resid * conflict,
      case when tail = 1 then (1 - alpha) * c + alpha * r else c end, case when conflict = 1 then (1 - alpha) * c else c end]) as pred
  from r2, (select unnest([0.03, 0.05, 0.08, 0.12]::double[]) as alpha)
)
, s as (
  select lens, edit, alpha, any_value(rho) as rho, corr(pred, c) as cc, corr(pred, r) as cr, avg(conflict) as fc, avg(agree) as fa, avg(tail) as ft
  from grid group by lens, edit, alpha having abs(corr(pred, c) - 1) >= 1e-10
)
, k as (select *, cc + 0.08 * cr + 0.03 * (cr - rho) - 0.015 * abs(log10(greatest(0, 1 - cc) + 1e-9) - log10(0.0018)) as score from s)
"""


@query("carve_candidates", CTE + _LENSES + """
select 'f_k_' || lens || '_' || edit || '_a' || alpha as candidate, round(rho, 6) + 0.0 as corr_champion_route, round(cc, 6) as corr_candidate_champion, round(cr, 6) + 0.0 as corr_candidate_route,
  round(fc, 6) as conflict_tail_frac, round(fa, 6) as agree_tail_frac, round(ft, 6) as route_tail_frac, round(score, 5) + 0.0 as review_score
from k
""")
def _(spark, d):
    m, _ = cv.carve_candidates(events(spark, d), "p", ["f_k"], kept=1000)
    numbers = ("corr_champion_route", "corr_candidate_champion", "corr_candidate_route", "conflict_tail_frac", "agree_tail_frac", "route_tail_frac")
    return rounded(rounded(m.select("candidate", *numbers, "review_score"), *numbers), "review_score", to=5)


@query("carve_review", CTE + _LENSES + """
select 'f_k_' || lens || '_' || edit || '_a' || alpha as candidate, round(score, 5) + 0.0 as review_score from k qualify row_number() over (order by score desc, cr desc, lens, edit, alpha) <= 80
""")
def _(spark, d):
    m, _ = cv.carve_candidates(events(spark, d), "p", ["f_k"])
    return rounded(m.select("candidate", "review_score"), "review_score", to=5)


@query("carve_predictions", CTE + _LENSES + """
, best as (select lens, edit, alpha from k where edit in ('reduce', 'tail_blend') order by score desc, cr desc limit 1)
, rows as (
  select event_id, lens, alpha, unnest(['reduce', 'tail_blend']) as edit, unnest([(1 - alpha) * c + alpha * r, case when tail = 1 then (1 - alpha) * c + alpha * r else c end]) as pred
  from r2, (select unnest([0.03, 0.05, 0.08, 0.12]::double[]) as alpha)
)
select event_id, round((pred - avg(pred) over ()) / stddev_pop(pred) over (), 5) + 0.0 as prediction from rows join best using (lens, edit, alpha)
""")
def _(spark, d):
    e = events(spark, d)
    _, weights = cv.carve_candidates(e, "p", ["f_k"], kept=1000)
    best = next(n for n in weights if "_reduce_" in n or "_tail_blend_" in n)
    return rounded(cv.carve_predictions(e, "event_id", "p", {best: weights[best]}).select("event_id", "prediction"), "prediction", to=5)
