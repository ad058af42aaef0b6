"""Queries on regimes: gauges, terrains, altitudes and landmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import regimes as rg
from tidemark.plans.queries import CTE, FEATURES, query, raw_events, rounded

COLUMNS = ["f_k", "f_day", "f_mod"]
ROUNDS, K, PEAKS = 5, 6, 2
RARE, TAIL = 0.17, 0.97


def lloyd_ctes(name: str, rows: str, k: int, rounds: int) -> str:
    """SQL: {name}0 to {name}{rounds} (cluster, a, b, c), the centres of the rows (event_id, a, b, c), and {name} the last."""
    out = f"""
, {name}0 as materialized (select (row_number() over (order by md5(event_id::varchar)) - 1)::int as cluster, a, b, c from {rows} order by md5(event_id::varchar) limit {k})
"""
    for r in range(rounds):
        out += f"""
, {name}_at{r} as (
  select event_id, arg_min(cluster, (round((z.a - m.a) ** 2 + (z.b - m.b) ** 2 + (z.c - m.c) ** 2, 9), cluster)) as cluster
  from {rows} z, {name}{r} m group by 1
)
, {name}{r + 1} as materialized (
  select m.cluster, coalesce(avg(z.a), any_value(m.a)) as a, coalesce(avg(z.b), any_value(m.b)) as b, coalesce(avg(z.c), any_value(m.c)) as c
  from {name}{r} m left join {name}_at{r} t using (cluster) left join {rows} z using (event_id) group by 1
)
"""
    return out + f", {name} as (select * from {name}{rounds})"


_Z = """
, mm as (select avg(f_k) as ma, stddev_pop(f_k) + 1e-6 as sa, avg(f_day) as mb, stddev_pop(f_day) + 1e-6 as sb, avg(f_mod) as mc, stddev_pop(f_mod) + 1e-6 as sc from e)
, z as materialized (select event_id, y, (f_k - ma) / sa as a, (f_day - mb) / sb as b, (f_mod - mc) / sc as c from e, mm)
"""
_TERRAIN = CTE + _Z + lloyd_ctes("t", "z", K, ROUNDS) + """
, d as (select event_id, cluster, round((z.a - m.a) ** 2 + (z.b - m.b) ** 2 + (z.c - m.c) ** 2, 9) as d from z, t m)
, w as materialized (select event_id, arg_min(cluster, (d, cluster)) as terrain, sqrt(min(d)) as altitude from d group by 1)
"""


def _space(e):
    return rg.terrain_map(e, COLUMNS, "event_id", K, ROUNDS)


@query("pressure_state", CTE + """
, m as (select feature, avg(x) as m, stddev_pop(x) + 1e-6 as s from l group by 1)
, g as (select row_idx, avg(abs((x - m) / s)) as g from l join m using (feature) group by 1)
, q as (select quantile_cont(g, 1/3) as a, quantile_cont(g, 2/3) as b from g)
select event_id, (g > a)::int + (g > b)::int as pressure from e join g using (row_idx), q
""")
def _(spark, d):
    return rg.pressure_state(raw_events(spark, d), FEATURES).select("event_id", "pressure")


@query("terrain_cluster", _TERRAIN + "select event_id, terrain from w")
def _(spark, d):
    e = raw_events(spark, d)
    return rg.with_terrain(e, _space(e)).select("event_id", "terrain")


@query("terrain_altitude", _TERRAIN + "select event_id, round(altitude, 6) + 0.0 as altitude from w")
def _(spark, d):
    e = raw_events(spark, d)
    return rounded(rg.with_terrain(e, _space(e)).select("event_id", "altitude"), "altitude")


@query("terrain_report", _TERRAIN + """
select terrain, count(*)::bigint as n, round(count(*) / (sum(count(*)) over ())::double, 6) as share,
  round(avg(altitude), 6) as mean_altitude, round(max(altitude), 6) as max_altitude
from w group by terrain
""")
def _(spark, d):
    e = raw_events(spark, d)
    return rounded(rg.terrain_report(rg.with_terrain(e, _space(e))), "share", "mean_altitude", "max_altitude")


_BEACONS = _TERRAIN + f"""
, edge as (select quantile_cont(altitude, {TAIL}) as q from w)
, high as materialized (select z.* from z join w using (event_id), edge where altitude >= q)
""" + lloyd_ctes("p", "high", PEAKS, ROUNDS) + f"""
, r as (select terrain, count(*) as n, avg(a) as a, avg(b) as b, avg(c) as c from w join z using (event_id) group by 1)
, places as (
  select 0 as turn, terrain as cluster, 'rare' as kind, a, b, c from r where n < {RARE} * (select count(*) from z)
  union all select 1, cluster, 'novelty', a, b, c from p
)
, bs as materialized (select (row_number() over (order by turn, cluster) - 1)::int as beacon, kind, a, b, c from places)
, bd as materialized (select event_id, z.y, beacon, kind, round((z.a - s.a) ** 2 + (z.b - s.b) ** 2 + (z.c - s.c) ** 2, 9) as d from z, bs s)
, reach as (select beacon, greatest(1e-3, quantile_cont(sqrt(d), 0.5)) as reach from bd group by 1)
, f as materialized (select event_id, y, beacon, kind, reach, exp(-d / (2 * reach * reach)) as f from bd join reach using (beacon))
, basin as materialized (select event_id, arg_max(beacon, (round(f, 9), -beacon)) as basin from f group by 1)
"""


def _fit(e):
    return rg.beacon_fit(e, _space(e), "event_id", rare=RARE, peaks=PEAKS, tail=TAIL, rounds=ROUNDS)


@query("beacon_fit", _BEACONS + "select beacon, kind, round(a, 6) + 0.0 as a, round(b, 6) + 0.0 as b, round(c, 6) + 0.0 as c, round(reach, 6) as reach from bs join reach using (beacon)")
def _(spark, d):
    b = _fit(raw_events(spark, d))
    rows = [(i, k, *map(float, p), float(r)) for i, (k, p, r) in enumerate(zip(b.kinds, b.places, b.reach))]
    return rounded(spark.createDataFrame(rows, "beacon int, kind string, a double, b double, c double, reach double"), "a", "b", "c", "reach")


@query("beacon_field", _BEACONS + "select event_id, basin, beacon, round(f, 6) + 0.0 as field from f join basin using (event_id)")
def _(spark, d):
    e = raw_events(spark, d)
    b = _fit(e)
    long = F.array(*[F.struct(F.lit(i).alias("beacon"), F.col(n).alias("field")) for i, n in enumerate(b.names)])
    return rounded(rg.beacon_field(e, b).select("event_id", "basin", F.explode(long).alias("r")).select("event_id", "basin", "r.*"), "field")


@query("beacon_report", _BEACONS + """
select beacon, any_value(kind) as kind, round(any_value(reach), 6) as reach, count(*) filter (where basin = beacon)::bigint as basin_rows,
  round(avg(f), 6) + 0.0 as mean_field, round(corr(f, y), 6) + 0.0 as corr
from f join basin using (event_id) group by beacon
""")
def _(spark, d):
    e = raw_events(spark, d)
    b = _fit(e)
    return rounded(rg.beacon_report(rg.beacon_field(e, b), b, "y"), "reach", "mean_field", "corr")
