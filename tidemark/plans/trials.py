"""Queries on candidates: what they look at in each fold, how they score, and their predictions."""

from __future__ import annotations

from tidemark.operators import assess as ax
from tidemark.operators import candidates_cv as cc
from tidemark.plans.assessment import fold_ctes
from tidemark.plans.queries import CTE, FEATURES, events, query, raw_events, rounded

TWO = ["f_k", "f_mod"]


@query("build_viewport", "with recursive " + CTE[5:] + fold_ctes(5, 30) + """
, t as (select f, row_idx from train)
, c as (select t.f, feature, pos, abs(corr(x, y)) as c from t join l using (row_idx) group by all)
select f::int as fold, feature, (row_number() over (partition by f order by c desc, pos))::int as place from c qualify place <= 3
""")
def _(spark, d):
    c = ax.fold_cells(events(spark, d), FEATURES, "y", n_segments=12, n_folds=5, embargo=30)
    rows = []
    for f in sorted(set(c.folds.values())):
        some, _ = cc.build_viewport(cc.Candidate(k=3), c.train(f), FEATURES, "y")
        rows += [(f, name, i + 1) for i, name in enumerate(some)]
    return spark.createDataFrame(rows, "fold int, feature string, place int")


def ridge_ctes(name: str, rows: str) -> str:
    """SQL: {name} (f, wa, wb, b0), ridge of y on f_k and f_mod with penalty 10 for every f of `rows`."""
    return f"""
, {name}_s as (
  select f, count(*)::double as n, avg(f_k) as ma, avg(f_mod) as mb, avg(y) as my, stddev_pop(f_k) + 1e-12 as sa, stddev_pop(f_mod) + 1e-12 as sb, var_pop(f_k) as va, var_pop(f_mod) as vb,
    covar_pop(f_k, f_mod) as vab, covar_pop(f_k, y) as ca, covar_pop(f_mod, y) as cb
  from {rows} group by f
)
, {name}_m as (select *, n * va / sa / sa + 10 as p, n * vab / sa / sb as q, n * vb / sb / sb + 10 as r, n * ca / sa as u, n * cb / sb as v from {name}_s)
, {name}_w as (select *, (u * r - v * q) / (p * r - q * q) / sa as wa, (v * p - u * q) / (p * r - q * q) / sb as wb from {name}_m)
, {name} as (select f, wa, wb, my - wa * ma - wb * mb as b0 from {name}_w)
"""


_TRIAL = "with recursive " + CTE[5:] + fold_ctes(5, 30) + """
, ahead as (select s.seg as f, e.* from e join b s on e.row_idx + 30 < s.lo where s.seg >= 8)
, next as (select seg as f, * from e where seg >= 8)
, whole as (select 0 as f, * from e)
""" + ridge_ctes("cv", "train") + ridge_ctes("wf", "ahead") + ridge_ctes("fit", "whole") + """
, oof as (select h.row_idx, h.seg, h.f, h.y, b0 + wa * f_k + wb * f_mod as pred, wa, wb from held h join cv using (f))
, fw as (select n.f, n.y, b0 + wa * f_k + wb * f_mod as pred from next n join wf using (f))
, fc as (
  select o.f, corr(o.pred, o.y) as c, sqrt(any_value(o.wa * o.wa) * any_value(k.sa) + any_value(o.wb * o.wb) * any_value(k.sb)) * 0.05 / (stddev_pop(o.pred) + 1e-12) as moved
  from oof o join (select f, var_pop(f_k) as sa, var_pop(f_mod) as sb from held group by f) k using (f) group by o.f
)
, wc as (select f, corr(pred, y) as c from fw group by f)
, ec as (select seg, corr(pred, y) as c from oof group by seg having count(*) >= 50)
, a as (select corr(pred, y) as oof_corr from oof)
, g as (select avg(c) as m, stddev_pop(c) as s, min(c) as w, avg(moved) as stability from fc)
, h as (select avg(c) as m, stddev_pop(c) as s, min(c) as w from wc)
, z as (
  select oof_corr, (select avg(c) from ec) as era_corr, g.m - g.s + least(0, g.w) - 0.05 * greatest(0, stability - 0.35) as width, (select corr(pred, y) from fw) as wf_corr, h.m - h.s + least(0, h.w) as wf_width, stability,
    (select corr(b0 + wa * f_k + wb * f_mod, y) from whole join fit using (f)) as fit_corr
  from a, g, h
)
"""


def _trial(spark, d):
    return cc.evaluate_candidates(events(spark, d), [cc.Candidate(k=2)], TWO, "y", n_folds=5, wf_folds=4, embargo=30)


@query("evaluate_candidate", _TRIAL + """
, v as (select *, case when oof_corr > 0 then least(999, fit_corr / greatest(oof_corr, 1e-6)) else 999 end as over from z)
select 'ridge|top2|identity' as candidate, round(oof_corr, 6) + 0.0 as oof_corr, round(era_corr, 6) + 0.0 as era_corr, round(width, 6) + 0.0 as width, round(wf_corr, 6) + 0.0 as wf_corr, round(wf_width, 6) + 0.0 as wf_width,
  round(stability, 6) + 0.0 as stability, round(fit_corr, 6) + 0.0 as fit_corr, round(over, 4) + 0.0 as overfit_ratio,
  case when oof_corr > 0 and width > 0 and wf_width > 0 and over <= 6 then 'promote' when oof_corr > 0 then 'expand' else 'reject' end as decision,
  concat_ws('|', case when oof_corr <= 0 then 'no_honest_correlation' end, case when width <= 0 then 'narrow_or_negative_width' end, case when wf_width <= 0 then 'negative_walk_forward_width' end, case when over > 6 then 'overpowering_fit_vs_cv' end) as reasons
from v
""")
def _(spark, d):
    report, _ = _trial(spark, d)
    numbers = ("oof_corr", "era_corr", "width", "wf_corr", "wf_width", "stability", "fit_corr")
    return rounded(rounded(report.select("candidate", *numbers, "overfit_ratio", "decision", "reasons"), *numbers), "overfit_ratio", to=4)


@query("stability_probe", _TRIAL + "select round(stability, 6) + 0.0 as stability from z")
def _(spark, d):
    return rounded(_trial(spark, d)[0].select("stability"), "stability")


@query("oof_predictions", _TRIAL + "select row_idx::bigint as row_idx, round(pred, 6) + 0.0 as pred from oof")
def _(spark, d):
    return rounded(_trial(spark, d)[1]().select("row_idx", "pred"), "pred")


@query("final_refit", CTE + ", whole as (select 0 as f, * from e)" + ridge_ctes("fit", "whole") + "select event_id, round(b0 + wa * f_k + wb * f_mod, 6) + 0.0 as pred from whole join fit using (f)")
def _(spark, d):
    e = raw_events(spark, d)
    return rounded(cc.final_refit(e, cc.Candidate(k=2), TWO, "y", e, "event_id"), "pred")
