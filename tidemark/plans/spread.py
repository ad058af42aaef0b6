"""Queries on rankers that spread or agree, and on transforms that widen a view."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import families as fa
from tidemark.plans.queries import CTE, FEATURES, events, query, raw_events, rounded

_ORDER = ", c as (select feature, pos, abs(corr(x, y)) as c from l group by 1, 2), o as (select *, row_number() over (order by c desc, pos) - 1 as rk, count(*) over () as n from c)"


@query("rank_phyllotaxis", "with recursive " + CTE[5:] + _ORDER + f"""
, size as (select count(*)::int as n from c)
, w as (
  select 0 as i, []::int[] as taken, -1 as p
  union all
  select i + 1, list_append(taken, spot), spot
  from (
    select i, taken, list_filter(list_transform(generate_series(0, n - 1), lambda k: ((floor((i * {fa.GOLDEN}::double % 1.0) * n)::int + k) % n)::int), lambda q: not list_contains(taken, q))[1] as spot
    from w, size where i < n
  )
)
select feature, w.i::int as place from w join o on o.rk = w.p where w.i > 0
""")
def _(spark, d):
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(fa.rank_phyllotaxis(raw_events(spark, d), FEATURES, "y"))], "feature string, place int")


@query("rank_compass", CTE + _ORDER + """
, sun as (select feature, abs(avg(corr)) - stddev_pop(corr) as s from sc group by 1)
, q as (select *, row_idx * 7 % 5 as t from l)
, g as (select feature, t, count(*) as n, avg(x) as m, var_pop(x) as v from q group by all)
, h as (select *, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) as a from g)
, soil as (select feature, sum(n * (m - a) ** 2) / (sum(n * v) + 1e-12) as s from h group by 1)
, star as (select feature, min(c) as s from (select feature, state, abs(corr(x, y)) as c from l group by all having count(*) >= 300) group by 1)
, p as (
  select feature, row_number() over (order by s desc, c desc, pos) as p from sun join o using (feature)
  union all select feature, row_number() over (order by s desc, c desc, pos) from soil join o using (feature)
  union all select feature, row_number() over (order by s desc, c desc, pos) from star join o using (feature)
)
, m as (select feature, avg(p) as m from p group by 1)
select feature, (row_number() over (order by m, c desc, pos))::int as place from m join o using (feature)
""")
def _(spark, d):
    return fa.rank_compass(events(spark, d).withColumn("t", F.col("row_idx") * 7 % 5), FEATURES, "y", "t", "state")


_Z3 = """
, mm as (select avg(f_k) as ma, stddev_pop(f_k) + 1e-6 as sa, avg(f_day) as mb, stddev_pop(f_day) + 1e-6 as sb, avg(f_mod) as mc, stddev_pop(f_mod) + 1e-6 as sc from e)
, z as (select event_id, y, (f_k - ma) / sa as a, (f_day - mb) / sb as b, (f_mod - mc) / sc as c from e, mm)
"""
_PAIRS = [(x, y_) for i, x in enumerate(("a", "b", "c")) for y_ in ("a", "b", "c")[i + 1 :]]
_NAMES = {"a": "f_k", "b": "f_day", "c": "f_mod"}


@query("tf_pair_aug", CTE + _Z3 + f"""
, p as (
  select event_id, y,
    unnest([{", ".join(f"'{_NAMES[i]}_{op}_{_NAMES[j]}'" for i, j in _PAIRS for op in ("times", "minus", "plus", "over"))}]) as name,
    unnest([{", ".join(f"{i} * {j}, {i} - {j}, {i} + {j}, {i} / (abs({j}) + 1)" for i, j in _PAIRS)}]) as value
  from z
)
, best as (select name from (select name, abs(corr(value, y)) as c from p group by name) order by c desc limit 3)
select event_id, name, round(value, 5) + 0.0 as value from p join best using (name)
""")
def _(spark, d):
    out, names = fa.tf_pair_aug(raw_events(spark, d), ["f_k", "f_day", "f_mod"], "y", keep=3)
    long = out.select("event_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("r")).select("event_id", "r.*")
    return rounded(long, "value", to=5)


def _fourier(parts: int = 2, seed: int = 7) -> str:
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(3, parts)), rng.uniform(0, 2 * np.pi, size=parts)
    columns = [f"round(sqrt(2.0 / {parts}) * cos(g * ({float(w[0, i])!r}::double * a + {float(w[1, i])!r}::double * b + {float(w[2, i])!r}::double * c) + {float(b[i])!r}::double), 5) + 0.0 as rff_{i}" for i in range(parts)]
    return CTE + _Z3 + """
, k as (select sqrt(2 / (list_median([var_pop(a), var_pop(b), var_pop(c)]) * 3)) as g from z)
select event_id, """ + ", ".join(columns) + " from z, k"


@query("tf_random_fourier", _fourier())
def _(spark, d):
    out, names = fa.tf_random_fourier(raw_events(spark, d), ["f_k", "f_day", "f_mod"], parts=2)
    return rounded(out, *names, to=5).select("event_id", *names)
