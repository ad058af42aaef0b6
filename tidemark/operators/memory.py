"""Cross-run memory tables: unions, last-wins joins, shrunken groups and gates over tables of runs, paths and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import clip


def attention_view(t: DataFrame, kind: str, key: str, priority: str, n: int) -> DataFrame:
    """(kind, key, priority, place) of the top n of a memory table; ties by key."""
    top = t.orderBy(F.desc(priority), key).limit(n)
    place = F.row_number().over(W.orderBy(F.desc(priority), key))
    return top.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(priority).cast("double").alias("priority"), place.alias("place"))


def relation_edges(t: DataFrame, links: list[tuple[str, str, str]]) -> DataFrame:
    """(src, kind, dst) of every pair of linked columns: (column, kind of link, column)."""
    one = [F.struct(F.concat(F.lit(f"{a}:"), F.col(a).cast("string")).alias("src"), F.lit(k).alias("kind"), F.concat(F.lit(f"{b}:"), F.col(b).cast("string")).alias("dst")) for a, k, b in links]
    return t.select(F.explode(F.array(*one)).alias("e")).select("e.*").filter("src is not null and dst is not null").distinct()


def path_memory(paths: DataFrame, details: dict[str, DataFrame], keys: list[str], order: str) -> DataFrame:
    """Paths with the columns of each detail table by key; of repeated keys the last by `order` counts."""
    out = paths
    for name, d in details.items():
        last = d.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n", order)
        out = out.join(last.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in last.columns if c not in keys]), keys, "left")
    return out


def path_score(parts: list[Column], minus: list[Column]) -> Column:
    """The mean of the known parts, clamped to [-1, 1], less what counts against."""
    known = F.array_compact(F.array(*[clip(p, -1.0, 1.0) for p in parts]))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(F.lit(0.0))
    for m in minus:
        mean = mean - F.coalesce(m, F.lit(0.0))
    return mean
