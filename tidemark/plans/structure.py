"""Queries on how columns relate: communities, clusters, medoids, projections and stability selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import topology as to
from tidemark.plans.queries import CTE, FEATURES, events, query, raw_events, rounded

#: Pairs of features (a, b) with their correlation, for all ordered pairs; v numbers the features from the widest on.
_CORR = """
, v as (select feature, pos, row_number() over (order by var_pop(x) desc, pos) as rk from l group by feature, pos)
, c as (
  select a.feature as i, b.feature as j, abs(corr(a.x, b.x)) as r
  from l a join l b on a.row_idx = b.row_idx
  group by 1, 2
)
"""

#: The leader pass: the state is the founders so far (as ranks) and the group of the feature at hand; m holds |corr| by rank.
_LEADERS = """
, m as (
  select list(case when i = j then 1.0 else r end order by a.rk, b.rk) as m, count(distinct i) as n
  from c join v a on a.feature = i join v b on b.feature = j
)
, w as (
  select 1 as rk, [1] as founders, 0 as community
  union all
  select rk + 1,
    case when hit is null then list_append(founders, rk + 1) else founders end,
    coalesce(hit - 1, len(founders))
  from (
    select w.rk, founders, list_position(list_transform(founders, lambda f: m[rk * n + f] >= 0.6), true) as hit
    from w, m
    where w.rk < n
  )
)
"""


@query("feature_communities", "with recursive " + CTE[5:] + _CORR + _LEADERS + """
, g as (select v.feature, v.pos, w.community::int as community from w join v using (rk))
, h as (
  select a.community, avg(r) as coherence
  from g a join g b on a.community = b.community and a.feature <> b.feature
  join c on c.i = a.feature and c.j = b.feature
  group by 1
)
select feature, pos, community, round(coalesce(coherence, 0), 6) + 0.0 as coherence from g left join h using (community)
""")
def _(spark, d):
    return rounded(to.feature_communities(raw_events(spark, d), FEATURES), "coherence")


@query("feature_topology_report", "with recursive " + CTE[5:] + _CORR + _LEADERS + """
, g as (select v.feature, w.community::int as community from w join v using (rk))
, h as (
  select a.community, avg(r) as coherence
  from g a join g b on a.community = b.community and a.feature <> b.feature
  join c on c.i = a.feature and c.j = b.feature
  group by 1
)
, s as (
  select feature,
    avg(x) filter (where row_idx < floor(n_rows * 0.75)) as m1, avg(x) filter (where row_idx >= floor(n_rows * 0.75)) as m2,
    var_pop(x) filter (where row_idx < floor(n_rows * 0.75)) as v1, var_pop(x) filter (where row_idx >= floor(n_rows * 0.75)) as v2, corr(x, y) as c
  from l group by 1
)
, t as (select feature, c, abs(m2 - m1) / (sqrt(v1) + 1e-9) + 0.5 * abs(ln((v2 + 1e-9) / (v1 + 1e-9))) as shift from s)
select community, count(*)::bigint as size, round(coalesce(any_value(coherence), 0), 6) + 0.0 as coherence, round(avg(abs(c)), 6) + 0.0 as mean_abs_corr,
  round(max(abs(c)), 6) + 0.0 as max_abs_corr, round(abs(avg(c)) / (avg(abs(c)) + 1e-9), 5) + 0.0 as consensus, round(avg(shift), 6) + 0.0 as mean_shift
from g join t using (feature) left join h using (community)
group by community
""")
def _(spark, d):
    e = events(spark, d)
    late = F.col("row_idx") >= F.floor(F.col("n_rows") * 0.75)
    out = to.feature_topology_report(e, to.feature_communities(e, FEATURES), fe.feature_shift(e.filter(~late), e.filter(late), FEATURES), "y")
    return rounded(rounded(out, "coherence", "mean_abs_corr", "max_abs_corr", "mean_shift"), "consensus", to=5)


@query("feature_clusters", CTE + """
, p as (select a.feature as i, b.feature as j, case when a.feature = b.feature then 1.0 else corr(a.x, b.x) end as r from l a join l b using (row_idx) group by 1, 2)
, f as (select distinct feature, pos from l)
, far as (select p.j as feature from p join f on f.feature = p.j where p.i = 'f_user' and p.j <> 'f_user' order by r, pos limit 1)
, start0 as (
  select f.feature, case when f.feature = far.feature then 1 when f.feature = 'f_user' or a.r >= b.r then 0 else 1 end as cluster
  from f, far, p a, p b
  where a.i = 'f_user' and a.j = f.feature and b.i = far.feature and b.j = f.feature
)
""" + "".join(f"""
, near{k} as (
  select f.feature, g.cluster, round(min(within) - 2 * avg(p.r), 12) as d
  from f, start{k} g join p on p.j = g.feature
  join (select a.cluster, avg(r) as within from start{k} a join start{k} b on a.cluster = b.cluster join p on p.i = a.feature and p.j = b.feature group by 1) w on w.cluster = g.cluster
  where p.i = f.feature
  group by 1, 2
)
, start{k + 1} as (select feature, arg_min(cluster, (d, cluster)) as cluster from near{k} group by 1)
""" for k in range(6)) + "select f.feature, f.pos, s.cluster::int as cluster from start6 s join f using (feature)")
def _(spark, d):
    return to.feature_clusters(raw_events(spark, d), FEATURES)


@query("rank_medoid", "with recursive " + CTE[5:] + _CORR.replace("var_pop(x) desc", "abs(corr(x, y)) desc") + _LEADERS + """
, g as (select v.feature, v.rk, w.community from w join v using (rk))
, s as (
  select a.community, a.feature, a.rk, round(sum(case when a.feature = b.feature then 1.0 else r end), 12) as total
  from g a join g b on a.community = b.community join c on c.i = a.feature and c.j = b.feature
  group by all
)
, k as (select community, arg_min(feature, (-total, rk)) as feature, arg_min(rk, (-total, rk)) as rk from s group by 1)
select feature, row_number() over (order by rk)::int as place from k
""")
def _(spark, d):
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(to.rank_medoid(raw_events(spark, d), FEATURES, "y"))], "feature string, place int")


#: Two columns have closed principal directions: (a, b) is the wider one, with its larger loading positive.
_PCA2 = """
, s as (select avg(f_k) as ma, avg(f_mod) as mb, var_pop(f_k) as va, var_pop(f_mod) as vb, covar_pop(f_k, f_mod) as c from e)
, k as (select *, (va + vb) / 2 + sqrt(((va - vb) / 2) ** 2 + c * c) as top from s)
, u as (select *, case when abs(c) > abs(top - va) then c else top - vb end as a0, case when abs(c) > abs(top - va) then top - va else c end as b0 from k)
, q as (select *, a0 / sqrt(a0 * a0 + b0 * b0) as a1, b0 / sqrt(a0 * a0 + b0 * b0) as b1 from u)
, w as (select ma, mb, case when abs(a1) >= abs(b1) then sign(a1) else sign(b1) end * a1 as a, case when abs(a1) >= abs(b1) then sign(a1) else sign(b1) end * b1 as b from q)
, p as (
  select event_id, f_k, f_mod, (f_k - ma) * a + (f_mod - mb) * b as pc_0,
    ((f_k - ma) * -b + (f_mod - mb) * a) * case when abs(a) >= abs(b) then sign(a) else sign(-b) end as pc_1
  from e, w
)
"""


@query("tf_pca", CTE + _PCA2 + "select event_id, round(pc_0, 4) + 0.0 as pc_0, round(pc_1, 4) + 0.0 as pc_1 from p")
def _(spark, d):
    return rounded(to.tf_pca(raw_events(spark, d), ["f_k", "f_mod"], 2), "pc_0", "pc_1", to=4).select("event_id", "pc_0", "pc_1")


@query("tf_pca_aug", CTE + _PCA2 + "select event_id, f_k, f_mod, round(pc_0, 4) + 0.0 as pc_0 from p")
def _(spark, d):
    return rounded(to.tf_pca_aug(raw_events(spark, d), ["f_k", "f_mod"], 1), "pc_0", to=4).select("event_id", "f_k", "f_mod", "pc_0")


@query("tf_foveated", CTE + _PCA2 + """
, o as (select quantile_cont(pc_0, 0.005) as lo, quantile_cont(pc_0, 0.995) as hi from p)
, t as (select corr(f_user, y) as cu, corr(f_mix, y) as cm, avg(f_user) as mu, avg(f_mix) as mm, stddev_pop(f_user) + 1e-6 as su, stddev_pop(f_mix) + 1e-6 as sm from e)
select e.event_id, f_day, round(greatest(0, least(255, round_even((pc_0 - lo) / greatest(hi - lo, 1e-6) * 255, 0))) / 255 * greatest(hi - lo, 1e-6) + lo, 3) + 0.0 as ring_0,
  round(((f_user - mu) / su * cu + (f_mix - mm) / sm * cm) / (abs(cu) + abs(cm)), 5) + 0.0 as rest
from e join p using (event_id), o, t
""")
def _(spark, d):
    out, _ = to.tf_foveated(raw_events(spark, d), ["f_day", "f_k", "f_mod", "f_user", "f_mix"], "y", sharp=1, ring=2, parts=1)
    return rounded(rounded(out, "ring_0", to=3), "rest", to=5).select("event_id", "f_day", "ring_0", "rest")


@query("rank_stabsel")
def _(spark, d):
    return rounded(to.rank_stabsel(raw_events(spark, d), FEATURES, "y", "event_id"), "score").select("feature", "score")
