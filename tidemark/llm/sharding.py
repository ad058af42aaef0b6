"""Sharding by balanced label propagation.

Documents that share a link value (here: equal texts) want to stand in one shard. A shard has a quota
of rows. As the linked documents of a group are alike, the state is kept as counts per (group, shard):
a group of any size has at most one row per shard. Documents start at a hash of their id; in every
round each group looks where its neighbours are (its own documents, and those of linked groups if edges
are given), keeps as many of its fullest shards as it needs and asks to move the rest there; requests are
granted in order of gain while the quota has room. What is over a quota at the end, and all documents
without a link, fill the room that is left, group after group.

All steps are joins, aggregations and windows. Running sums go over hash slices first and inside a
slice second, and documents meet their group under (group, salt), so neither a shard nor a group with a
third of all rows comes to one task.

Cases: a null text links with nothing and weighs 16 bytes; empty texts are equal texts; repeated rows are
documents of their own (with equal texts); with fewer documents than shards some shards stay empty; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bucket, cut, table

SALTS = 256
SLICES = 1024


def running_before(rows: DataFrame, keys: list[str], order: list[Column], amount: Column, slice_col: Column, name: str) -> DataFrame:
    """`name`: the sum of `amount` over the rows ahead of this one within `keys`, in order of (slice, order).

    Two levels: sums per (keys, slice) run over at most SLICES rows per key; inside a slice a window
    does the rest. `slice_col` must rise with the wanted order or be a hash (then the order is by hash).
    """
    rows = rows.withColumn("_slice", slice_col).withColumn("_amount", amount.cast("long"))
    sums = rows.groupBy(*keys, "_slice").agg(F.sum("_amount").alias("_sum"))
    ahead = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    rows = rows.join(sums, [*keys, "_slice"])
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn(name, F.col("_ahead") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    return out.drop("_slice", "_amount", "_ahead")


def first_stop(stops: Column) -> Column:
    """The shard of the first stop beyond this row's `number`; null beyond the last."""
    return F.get(F.filter(stops, lambda x: x["upto"] > F.col("number")), F.lit(0))["shard"]


def propagate(state: DataFrame, quota: DataFrame, rounds: int, edges: DataFrame | None = None) -> DataFrame:
    """(grp, shard, n) after at most `rounds` rounds, fewer if one moves nothing; quota: (shard, quota). edges: (a, b) between groups, both ways."""
    seen = None
    for _ in range(rounds):
        votes = state.withColumn("votes", F.col("n"))
        if edges is not None:
            heard = edges.join(state, edges["b"] == state["grp"]).groupBy(F.col("a").alias("grp"), "shard").agg(F.sum("n").alias("heard"))
            votes = state.join(heard, ["grp", "shard"], "full").select("grp", "shard", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) + F.coalesce("heard", F.lit(0))).alias("votes"))
        load = state.groupBy("shard").agg(F.sum("n").alias("load"))
        room = quota.join(load, "shard", "left").select("shard", "quota", (F.col("quota") - F.coalesce("load", F.lit(0))).alias("room"))
        of_group = W.partitionBy("grp")
        ranked = votes.join(F.broadcast(room), "shard")
        # Shards with room, or already filled with this group alone, come first among equals.
        ranked = ranked.withColumn("rank", F.row_number().over(of_group.orderBy(F.col("votes").desc(), F.col("room").desc(), F.xxhash64("shard", "grp"), "shard")))
        ranked = ranked.withColumn("all", F.sum("n").over(of_group))
        ranked = ranked.withColumn("homes", F.ceil(F.col("all") / F.col("quota")).cast("int"))
        ranked = ranked.withColumn("homes", F.col("homes") + (F.col("homes") > 1).cast("int"))
        ranked = ranked.withColumn("goal", F.sort_array(F.collect_list(F.when(F.col("rank") <= F.col("homes"), F.struct("rank", "shard"))).over(of_group)))
        to = F.element_at(F.col("goal"), (F.pmod(F.col("rank"), F.size("goal")) + 1).cast("int"))["shard"]
        ranked = ranked.filter("n > 0").select("grp", "shard", "n", "votes", F.when(F.col("rank") <= F.col("homes"), F.col("shard")).otherwise(to).alias("to"))
        wish = ranked.filter("to <> shard").select("grp", "shard", "n", "to").withColumnRenamed("to", "goal")
        wish = running_before(wish, ["goal"], [F.col("n").desc(), "grp", "shard"], F.col("n"), bucket(SLICES, F.col("grp")), "ahead")
        open_at = room.select(F.col("shard").alias("goal"), F.greatest("room", F.lit(0)).alias("room"))
        wish = wish.join(F.broadcast(open_at), "goal")
        wish = wish.withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("ahead"))))
        moved = ranked.filter("to = shard").select("grp", "shard", "n")
        moved = moved.unionByName(wish.select("grp", F.col("goal").alias("shard"), F.col("go").alias("n")))
        moved = moved.unionByName(wish.select("grp", "shard", (F.col("n") - F.col("go")).alias("n")))
        state = cut(moved.filter("n > 0").groupBy("grp", "shard").agg(F.sum("n").alias("n")))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("grp", "shard", "n").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return state


def shard_documents(docs: DataFrame, *, n_shards: int = 40, rounds: int = 12, edges: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, grp, shard, slot): shards whose row counts are at most one apart.

    `edges` (a, b) may link groups of equal texts further, by the xxhash64 of their texts.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("grp"),
    )
    rows = rows.withColumn("h", F.xxhash64("doc_id", "grp"))
    rows = cut(rows.withColumn("salt", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(SALTS)).cast("int")).withColumn("at", F.pmod("h", F.lit(n_shards)).cast("int")))

    total = rows.agg(F.count("*").alias("rows"))
    quota = total.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "rows")
    quota = cut(quota.select("shard", (F.floor(F.col("rows") / n_shards) + (F.col("shard") < F.col("rows") % n_shards).cast("int")).alias("quota")))
    quota = quota.filter("quota > 0")

    counts = rows.filter("grp is not null").groupBy("grp", "salt", "at").agg(F.count("*").alias("n"))
    linked = cut(counts.groupBy("grp", F.col("at").alias("shard")).agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(W.partitionBy("grp"))).filter("all > 1"))
    linked = linked.join(F.broadcast(quota.select(F.col("shard").alias("has"))), F.col("shard") == F.col("has"), "left")
    state = linked.filter("has is not null").select("grp", "shard", "n")
    state = propagate(state, quota, rounds, edges)

    # What is over a quota goes back; the largest holdings stay.
    held = running_before(state, ["shard"], [F.col("n").desc(), "grp"], F.col("n"), bucket(SLICES, F.col("grp")), "ahead").join(F.broadcast(quota), "shard")
    held = held.withColumn("n", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("ahead")))).filter("n > 0").select("grp", "shard", "n")
    held = cut(held)
    upto = F.sum("n").over(W.partitionBy("grp").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow))
    stops = held.withColumn("upto", upto).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("stops"))

    # A document's number within its group, and the shard whose stop is the first beyond it.
    salted = rows.filter("grp is not null").groupBy("grp", "salt").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("grp").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    salted = salted.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").join(stops, "grp")
    placed = rows.join(salted, ["grp", "salt"], "left")
    number = F.col("base") + F.row_number().over(W.partitionBy("grp", "salt", F.when(F.col("grp").isNull(), F.col("h"))).orderBy("h", "doc_id")) - 1
    placed = placed.withColumn("number", F.when(F.col("base").isNotNull(), number))
    placed = placed.withColumn("shard", first_stop(F.col("stops")))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "grp", "h", "shard"))

    # The rest fills the room that is left, group after group.
    full = placed.filter("shard is not null").groupBy("shard").agg(F.count("*").alias("n"))
    room = quota.join(full, "shard", "left").select("shard", (F.col("quota") - F.coalesce("n", F.lit(0))).alias("room"))
    room = room.withColumn("upto", F.sum("room").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)))
    # One entry per shard at most.
    stops = F.array(*[F.struct(F.lit(r["upto"]).alias("upto"), F.lit(r["shard"]).alias("shard")) for r in room.filter("room > 0").orderBy("shard").collect()]).cast("array<struct<upto:bigint,shard:int>>")
    loose = placed.filter("shard is null").drop("shard")
    loose = running_before(loose, [], ["grp", "h", "doc_id"], F.lit(1), bucket(SLICES, F.coalesce("grp", "h")), "number")
    loose = loose.withColumn("shard", first_stop(stops))
    out = placed.filter("shard is not null").unionByName(loose.select("doc_id", "size", "text_crc32", "grp", "h", "shard"))
    out = running_before(out, ["shard"], ["h", "doc_id"], F.lit(1), bucket(SLICES, F.col("h")), "slot")
    return out.select("doc_id", "size", "text_crc32", "grp", "shard", F.col("slot").cast("long").alias("slot"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
