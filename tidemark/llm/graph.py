"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucket, stored

SALTS = 16
#: Rows of one key that one task joins; a key with more is dealt out to as many tasks as that takes.
HEAVY = 50_000


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], how: str = "inner", rows: str | None = None) -> DataFrame:
    """many ⋈ one on `keys`, where a key of `many` may hold a large share of its rows.

    `many` is split by a hash of its columns `spread`, `one` is repeated for each part. With `rows`, a column of `one` that
    says how many rows of `many` the key has, the number of parts follows it, one for each HEAVY rows. The keys with more
    than one part are broadcast; they are fewer than the rows of `many` divided by HEAVY.
    """
    if rows is None:
        left = many.withColumn("_salt", bucket(SALTS, *[F.col(c) for c in spread]))
        right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.join(right, [*keys, "_salt"], how).drop("_salt")
    parts = F.ceil(F.col(rows) / HEAVY).cast("int")
    heavy = one.select(*keys, parts.alias("_parts")).filter("_parts > 1").distinct()
    left = many.join(F.broadcast(heavy), keys, "left")
    left = left.withColumn("_salt", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"))).drop("_parts")
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), parts - 1)))).drop(rows)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): for every node of an edge (a, b), the smallest node it can reach.

    A large star ties a node's larger neighbours to its smallest one, a small star its smaller neighbours;
    together they need a logarithmic number of rounds. No round collects the neighbours of a node: minima are
    aggregations, and the joins are salted by the nodes' numbers of neighbours. Self-links and null ends are left out.
    Raises RuntimeError if the stars still change after `max_rounds`, rather than return groups that are not closed.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
        large = salted_join(both, least, ["u"], ["v"], rows="rows").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        small = salted_join(large, least, ["u"], ["v"], rows="rows").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components: not closed after {max_rounds} rounds")


def balanced_join(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], rows: str) -> DataFrame:
    """many ⋈ one (inner) on `keys`; a key with more rows than a task's even share is dealt out to as many tasks as it fills.

    `rows` is a column of `one`: how many rows of `many` the key has. The even share is their total divided by the number of
    shuffle partitions, so at most that many keys are broadcast. `spread` names columns of `many` that tell its rows apart.
    """
    parts = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, (one.agg(F.sum(rows)).first()[0] or 0) // parts)
    fills = F.ceil(F.col(rows) / share).cast("int")
    heavy = one.filter(F.col(rows) > share).select(*keys, fills.alias("_parts"))
    left = many.join(F.broadcast(heavy), keys, "left")
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), fills - 1))).drop(rows)
    return left.join(right, [*keys, "_salt"]).drop("_salt")
