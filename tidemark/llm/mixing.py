"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: the weights share all tokens; a source's target stops at `max_repeats` times what it has and
the excess is shared again by weight (one water level, found in closed form). Equal blocks of
`block_tokens` are then given to the sources by the highest quotients target / (2k + 1), shard after
shard, so that every prefix of shards is in proportion. A source's documents stand in a seeded order
on a line of tokens that is walked round and round; its blocks are the first ones of that walk, and each shard goes
on where the shard before it stopped, for as many blocks as its quota says.

Everything is DataFrame work: per-source tables hold one row per source (and shard); the positions of
documents come from sums per (source, slice of the seeded order), so a source with a third of all rows
is spread over `SLICES` groups and no task holds a whole source.

Cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
take nothing; ties in the seeded order go by doc_id; repeated rows are documents of their own;
sources without tokens get target 0; an empty table gives an empty table; other columns pass unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut

#: Slices of the seeded order: the first three hex digits of the hash.
SLICES = 4096


def by_code_point(col: str) -> list[Column]:
    """Ascending by code point, null last (Spark compares strings by UTF-8 bytes, which is code point order)."""
    return [F.col(col).isNull().cast("int").asc(), F.col(col).asc()]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, place, weight, source_size, total, target) from (source, size); one row per source.

    The level x solves sum(min(x * weight, max_repeats * source_size)) = total: with the sources in
    order of max_repeats * size / weight, the first whose capped predecessors leave it uncapped sets x.
    """
    one = W.orderBy(*by_code_point("source"))
    every = W.partitionBy(F.lit(1))
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("place", F.row_number().over(one) - 1)
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    own = own.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeats)
    own = own.withColumn("total", F.sum("source_size").over(every))
    in_order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place").asc())
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("turn", F.row_number().over(in_order))
    own = own.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    own = own.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    own = own.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    first = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("turn"))
    own = own.withColumn("at", F.min_by("level", first).over(every))
    target = F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight"))
    return own.select("source", "place", "weight", "source_size", "total", target.alias("target"))


def block_quotas(targets: DataFrame, block_tokens: int, n_shards: int) -> DataFrame:
    """(place, shard, quota, quota_before): Sainte-Laguë quotas of blocks, for every shard of the mix.

    With n sources, the first N blocks in order of target / (2k + 1) give source i at least
    round(target_i * (N - n/2) / total) and at most round(target_i * (N + n/2) / total) blocks, so only
    the few quotients between these need ranking, whatever N is. The quotas of a shard are the difference
    between the quotas of two prefixes; the method is house monotone, so none is negative.
    """
    every = W.partitionBy(F.lit(1))
    t = targets.withColumn("n", F.count("*").over(every)).withColumn("blocks", F.floor(F.col("total") / block_tokens))
    t = t.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    t = t.withColumn("first", F.floor(F.col("blocks") * (F.col("shard") + 1) / n_shards))
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.floor(share * (F.col("first") - F.col("n") / 2) + 0.5) - 1)
    high = F.greatest(F.lit(0), F.floor(share * (F.col("first") + F.col("n") / 2) + 0.5) + 1)
    t = t.withColumn("low", low).withColumn("k", F.explode(F.sequence(F.col("low"), high)))
    shard = W.partitionBy("shard")
    t = t.withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    t = t.withColumn("rank", F.row_number().over(shard.orderBy(F.col("quotient").desc(), F.col("place"), F.col("k"))))
    t = t.withColumn("sure", F.sum(F.when(F.col("k") == F.col("low"), F.col("low")).otherwise(0)).over(shard))
    t = t.groupBy("place", "shard").agg(
        (F.first("low") + F.sum(F.when((F.col("rank") <= F.col("first") - F.col("sure")) & (F.col("target") > 0), 1).otherwise(0))).alias("upto")
    )
    seen = F.coalesce(F.lag("upto").over(W.partitionBy("place").orderBy("shard")), F.lit(0))
    return t.select("place", "shard", (F.col("upto") - seen).alias("quota"), seen.alias("quota_before"))


def mix_documents(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    block_tokens: int = 16,
    n_shards: int = 40,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    key: str | None = None,
) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, taken, start, shards).

    `taken` counts the words the mix takes of the document, repeats included; `start` is where the
    document begins on its source's seeded line. `shards` says which shard takes how many of them, as an array of
    (shard, words) in order of shards: a shard takes the tokens of the walk from quota_before * block_tokens on, quota *
    block_tokens of them (see block_quotas). A `key`, a column that is different in every row,
    is kept, breaks ties, and seeds rows with a null id.
    """
    size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("long")
    keys = [key] if key else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *keys)
    unnamed = F.concat(F.lit("row "), F.col(key).cast("string")) if key else F.lit("")
    rows = rows.withColumn("seeded", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), unnamed))))
    rows = cut(rows)
    sliced = rows.withColumn("slice", F.substring("seeded", 1, 3))
    targets = cut(source_targets(rows.select("source", "size"), weights, max_repeats))
    quotas = block_quotas(targets, block_tokens, n_shards)
    upto = F.sum("quota").over(W.partitionBy("place").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)) * block_tokens
    quotas = quotas.filter("quota > 0").withColumn("upto", upto).groupBy("place").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("stops"))
    limit = F.col("source_size") * max_repeats
    plan = targets.join(quotas, "place", "left").select(
        "source", "source_size", "target", F.least(F.coalesce(F.element_at("stops", -1)["upto"], F.lit(0)), limit).alias("quota_tokens"),
        F.transform("stops", lambda x: F.struct(F.least(x["upto"], limit).alias("upto"), x["shard"].alias("shard"))).alias("stops"),
    )
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)))
    sums = sums.join(plan, sums["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    a, b = sliced.alias("a"), sums.alias("b")
    placed = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.slice") == F.col("b.slice"))).select("a.*", "b.slice_start", "b.source_size", "b.target", "b.quota_tokens", "b.stops")
    inside = W.partitionBy("source", "slice").orderBy("seeded", F.col("doc_id").asc_nulls_first(), "size", *keys).rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("slice_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("quota_tokens") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("quota_tokens") - rounds * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    taken = (F.col("size") * rounds + part).cast("long")
    # Of the line's tokens up to a stop, those of this document: whole rounds, and its part of the last one.
    own = lambda x: F.when(F.col("source_size") > 0, F.floor(x / F.col("source_size")) * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), x % F.col("source_size") - F.col("start")))).otherwise(F.lit(0)).cast("long")
    upto = F.transform("stops", lambda x: F.struct(x["shard"].alias("shard"), own(x["upto"]).alias("n")))
    # `u` is bound once: an expression that stands in its own lambda is worked out again for every element.
    between = lambda u: F.transform(u, lambda x, i: F.struct(x["shard"].alias("shard"), (x["n"] - F.when(i > 0, F.get(u, i - 1)["n"]).otherwise(F.lit(0))).alias("words")))
    shards = F.transform(F.array(upto), lambda u: F.filter(between(u), lambda x: x["words"] > 0))[0]
    shards = F.coalesce(shards, F.array().cast("array<struct<shard:int,words:bigint>>"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "start", shards.alias("shards"), *keys)


def mixed_copies(docs: DataFrame, mix: DataFrame, *, id_col: str = "doc_id", key: str | None = None) -> DataFrame:
    """The documents as the mix takes them: each as often as it is taken, its last part if that is half of it or more.

    Rows meet by `key`, a column of both that differs in every row (see mix_documents); without one by their
    ids, which then must be distinct and not null.
    """
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    plan = mix.filter("size > 0").select(F.col(key or "doc_id").alias("_mix_id"), copies.alias("_mix_copies")).filter("_mix_copies > 0 and _mix_id is not null")
    out = docs.join(plan, docs[key or id_col] == plan["_mix_id"])
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))).alias("_mix_copy")).drop("_mix_copy")


def op2_query(spark, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import table

    shards = F.array_join(F.transform("shards", lambda x: F.concat_ws(":", x["shard"], x["words"])), ",")
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


OP2_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix-1' || coalesce(cast(doc_id as varchar), '')) as seeded
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, row_number() over (order by source nulls last) - 1 as place from s0),
s2 as (select *, [1, 2, 3][(place % 3 + 1)::int]::bigint as weight, source_size * 3 as cap, (sum(source_size) over ())::bigint as total from s1),
s3 as (select *, row_number() over (order by cap / weight, place) as turn, coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
         (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))::bigint as open_w from s2),
s4 as (select *, (total - capped)::double / open_w::double as level from s3),
s5 as (select *, arg_min(level, case when level * weight <= cap then turn end) over () as lvl, count(*) over () as n from s4),
t as (select source, place, source_size, total, n, least(cap::double, lvl * weight) as target, (total // 16) as blocks from s5),
k0 as (select *, unnest(range(40)) as shard, case when total > 0 then target / total else 0 end as share from t),
k1 as (select *, (blocks * (shard + 1)) // 40 as upto from k0),
k2 as (select *, greatest(0, floor(share * (upto - n / 2.0) + 0.5) - 1)::bigint as low,
         greatest(0, floor(share * (upto + n / 2.0) + 0.5) + 1)::bigint as high from k1),
k3 as (select *, unnest(generate_series(low, high)) as k from k2),
k4 as (select *, row_number() over (partition by shard order by target / (2 * k + 1) desc, place, k) as rk,
         sum(case when k = low then low else 0 end) over (partition by shard) as sure from k3),
u as (select place, shard, any_value(low) + sum(case when rk <= upto - sure and target > 0 then 1 else 0 end) as q from k4 group by place, shard),
q as (select place, max(q) as upto from u group by place),
p as (select t.source, t.source_size, t.target, least(q.upto * 16, t.source_size * 3)::bigint as quota from t join q using (place)),
l as (select d.*, p.source_size, p.target, p.quota,
         coalesce(sum(d.size) over (partition by d.source order by seeded, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from d join p on d.source is not distinct from p.source),
m as (select *, row_number() over () as r from l),
st as (select p.source, u.shard, least(u.q * 16, p.source_size * 3)::bigint as line from u join t using (place) join p on p.source is not distinct from t.source),
v as (select m.r, st.shard, (case when source_size > 0 then (line // source_size) * size + greatest(0, least(size, line % source_size - start)) else 0 end)::bigint as n
      from m join st on m.source is not distinct from st.source),
v1 as (select r, shard, n - coalesce(lag(n) over (partition by r order by shard), 0) as words from v),
sh as (select r, string_agg(shard || ':' || words, ',' order by shard) as shards from v1 where words > 0 group by r)
select doc_id, size, source_size, target,
  (case when source_size > 0 then size * (quota // source_size) + greatest(0, least(size, quota - (quota // source_size) * source_size - start)) else 0 end)::bigint as taken, coalesce(shards, '') as shards
from m left join sh using (r)
"""
