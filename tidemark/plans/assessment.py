"""Queries on folds and blends: purged folds, nested assessment and the blends that compete in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import assess as ax
from tidemark.operators import keys as ke
from tidemark.operators.moments import total
from tidemark.plans.queries import CTE, events, query, rounded

MEMBERS = ["f_k", "f_mod", "p"]


def fold_ctes(folds: int, embargo: int) -> str:
    """SQL: fm (seg, lo, hi, fold), segments dealt to the lightest fold; held and train (f, and the columns of e)."""
    return f"""
, b as (select seg, count(*) as n, min(row_idx) as lo, max(row_idx) as hi from e group by seg)
, o as (select *, row_number() over (order by n desc, seg) as rk from b)
, deal as (
  select 0::bigint as rk, {[0] * folds}::bigint[] as load, -1 as fold
  union all
  select rk + 1, list_transform(load, lambda v, i: case when i = p then v + n else v end), p - 1
  from (select deal.rk, load, o.n, list_position(load, list_min(load)) as p from deal join o on o.rk = deal.rk + 1)
)
, fm as (select seg, lo, hi, deal.fold::int as fold from deal join o using (rk))
, held as (select fm.fold as f, e.* from e join fm using (seg))
, train as (
  select g.fold as f, e.*
  from e, (select distinct fold from fm) g
  where not exists (select 1 from fm s where s.fold = g.fold and e.row_idx between s.lo - {embargo} and s.hi + {embargo})
)
"""


query("purged_segment_folds", "with recursive " + CTE[5:] + fold_ctes(4, 30) + """
select g.fold, e.row_idx::bigint as row_idx,
  case when m.fold = g.fold then 'valid'
    when exists (select 1 from fm s where s.fold = g.fold and e.row_idx between s.lo - 30 and s.hi + 30) then 'purged'
    else 'train' end as role
from e join fm m using (seg), (select distinct fold from fm) g
""")(lambda spark, d: ke.purged_folds(events(spark, d), 4, 30))


#: Positive shares of three correlations ck, cm, cp.
_SHARES = "(greatest({c}, 0) + 1e-6) / (greatest(ck, 0) + greatest(cm, 0) + greatest(cp, 0) + 3e-6)"
_SHARE3 = ", ".join(f"{_SHARES.format(c=c)} as {w}" for c, w in (("ck", "wk"), ("cm", "wm"), ("cp", "wp")))


def blend_ctes(rows: str) -> str:
    """SQL: w (f, strategy, wk, wm, wp) from the rows (f, members, y) of `rows`, and wr (f, state, ...) of the regime blend."""
    return f"""
, i as (
  select f, corr(f_k, y) as ck, corr(f_mod, y) as cm, corr(p, y) as cp, abs(corr(f_k, f_mod)) as km, abs(corr(f_k, p)) as kp, abs(corr(f_mod, p)) as mp
  from {rows} group by f
)
, base as (select f, {_SHARE3} from i)
, lam as (select f, lam, (1 - lam) * wk + lam / 3 as wk, (1 - lam) * wm + lam / 3 as wm, (1 - lam) * wp + lam / 3 as wp from base, (select unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::double[]) as lam))
, obj as (
  select f, lam, any_value(wk) as wk, any_value(wm) as wm, any_value(wp) as wp,
    corr(wk * f_k + wm * f_mod + wp * p, y) - 0.03 * any_value(wk * wk + wm * wm + wp * wp) - 0.03 * any_value(greatest(wk, wm, wp)) as v
  from {rows} t join lam using (f) group by f, lam
)
, ag as (select f, greatest(ck, 0) * (km + kp) / 2 as a, greatest(cm, 0) * (km + mp) / 2 as b, greatest(cp, 0) * (kp + mp) / 2 as c from i)
, w as (
  select f, 'best_single' as strategy, (ck >= cm and ck >= cp)::int::double as wk, (cm > ck and cm >= cp)::int::double as wm, (cp > ck and cp > cm)::int::double as wp from i
  union all select f, 'equal_top', 1 / 3.0::double, 1 / 3.0::double, 1 / 3.0::double from i
  union all select f, 'corr_weighted', wk, wm, wp from base
  union all select f, 'parliament', arg_max(wk, (v, -lam)), arg_max(wm, (v, -lam)), arg_max(wp, (v, -lam)) from obj group by f
  union all select f, 'agreement_weighted', a / (a + b + c), b / (a + b + c), c / (a + b + c) from ag
)
, own as (select f, state, count(*) as n, corr(f_k, y) as ck, corr(f_mod, y) as cm, corr(p, y) as cp from {rows} group by f, state)
, ws as (select f, state, n, {_SHARE3} from own)
, wr as (
  select f, state, case when n >= 200 then n / (n + 500.0::double) else 0 end as a,
    a * ws.wk + (1 - a) * base.wk as wk, a * ws.wm + (1 - a) * base.wm as wm, a * ws.wp + (1 - a) * base.wp as wp
  from ws join base using (f)
)
"""


_PLAIN = ("best_single", "equal_top", "corr_weighted", "parliament", "median", "regime", "agreement_weighted")
_CLIMBS = ("hill_climb", "era_mean_hill", "late_era_hill", "minimax_era", "nnls_stack")


def _outer(spark, d, strategies):
    got = ax.nested_assessment(events(spark, d), MEMBERS, "y", n_folds=5, embargo=30, state="state", strategies=strategies)
    return rounded(spark.createDataFrame(got.outer, "strategy string, fold int, score double"), "score")


query("nested_assessment", "with recursive " + CTE[5:] + fold_ctes(5, 30) + blend_ctes("train") + """
, s as (
  select strategy, f as fold, corr(wk * f_k + wm * f_mod + wp * p, y) as score from held join w using (f) group by 1, 2
  union all
  select 'median', f, corr(f_k + f_mod + p - greatest(f_k, f_mod, p) - least(f_k, f_mod, p), y) from held group by 1, 2
  union all
  select 'regime', f, corr(wk * f_k + wm * f_mod + wp * p, y) from held join wr using (f, state) group by 1, 2
)
select strategy, fold, round(score, 6) + 0.0 as score from s
""")(lambda spark, d: _outer(spark, d, _PLAIN))
query("nested_hill_climbs")(lambda spark, d: _outer(spark, d, _CLIMBS))


def _all_rows(spark, d, state=None):
    return ax.fold_cells(events(spark, d), MEMBERS, "y", n_segments=12, n_folds=5, embargo=0, state=state)


def _weights(spark, w):
    return rounded(spark.createDataFrame(list(w.items()), "member string, weight double"), "weight")


_ALL = ", r as (select 0 as f, * from e)"


@query("blend_parliament", CTE + _ALL + blend_ctes("r") + "select unnest(['f_k', 'f_mod', 'p']) as member, round(unnest([wk, wm, wp]), 6) + 0.0 as weight from w where strategy = 'parliament'")
def _(spark, d):
    c = _all_rows(spark, d)
    return _weights(spark, ax.parliament(total(c.cells.values()), c, MEMBERS))


@query("blend_regime", CTE + _ALL + blend_ctes("r") + "select state, unnest(['f_k', 'f_mod', 'p']) as member, round(unnest([wk, wm, wp]), 6) + 0.0 as weight from wr where a > 0")
def _(spark, d):
    c = _all_rows(spark, d, "state")
    rows = [(s, m, v) for s, w in ax.by_state(c.cells, c, MEMBERS)[1].items() for m, v in w.items()]
    return rounded(spark.createDataFrame(rows, "state int, member string, weight double"), "weight")


@query("blend_hill_climb")
def _(spark, d):
    c = _all_rows(spark, d)
    m = total(c.cells.values())
    return _weights(spark, ax.hill_climb(MEMBERS, lambda w: ax.corr_of(m, c, w)))


def _forward(spark, d):
    """(cells of the first three quarters, those of the rest, their members): two scans over the rows of either part."""
    e = events(spark, d)
    late = F.col("row_idx") >= F.floor(F.col("n_rows") * 0.75)
    part = lambda rows: ax.fold_cells(rows, MEMBERS, "y", n_segments=12, n_folds=5, embargo=0)
    return part(e.filter(~late)), part(e.filter(late))


@query("shrink_to_equal", CTE + """
, r as (select 0 as f, * from e where row_idx < floor(n_rows * 0.75))
""" + blend_ctes("r") + """
, late as (select * from e where row_idx >= floor(n_rows * 0.75))
, tried as (
  select lam, corr(((1 - lam) * wk + lam / 3) * f_k + ((1 - lam) * wm + lam / 3) * f_mod + ((1 - lam) * wp + lam / 3) * p, y) as c
  from late, base, (select unnest([0.0, 0.25, 0.5, 0.75, 1.0]::double[]) as lam) group by lam
)
, best as (select arg_max(lam, (round(c, 6), -lam)) as lam from tried)
select best.lam as share, unnest(['f_k', 'f_mod', 'p']) as member, round(unnest([(1 - best.lam) * wk + best.lam / 3, (1 - best.lam) * wm + best.lam / 3, (1 - best.lam) * wp + best.lam / 3]), 6) + 0.0 as weight from best, base
""")
def _(spark, d):
    before, after = _forward(spark, d)
    share, w = ax.shrink_to_equal(after.cells, after, ax.weights_for("corr_weighted", before.cells, before, MEMBERS))
    return rounded(spark.createDataFrame([(share, m, v) for m, v in w.items()], "share double, member string, weight double"), "weight")


@query("forward_gate")
def _(spark, d):
    before, after = _forward(spark, d)
    fires, point, won = ax.forward_gate(after.cells, after, ax.best_first(before.cells, before)[0], {m: 1 / 3 for m in MEMBERS})
    return spark.createDataFrame([(fires, point, won)], "fires boolean, point boolean, won double")
