"""Row numbers, segments, samples and splits. Order is always an explicit key; nothing sorts all rows in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder, which every executor and the driver can reach; a temporary one only in local mode, where the session names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty() and not sc.getConf().get("spark.checkpoint.dir", None):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the checkpoint folder: what follows does not compute them again."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def placed(df: DataFrame, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """Adds `name`, the 0-based place of a row by `order` (which must be unique), and the number of rows as `total`.

    Rows are range-partitioned and sorted inside partitions; a place is the offset of the partition (a running sum
    over as many rows as there are partitions) plus the place inside it.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: the place of a row must not depend on how often its partition is computed.
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).withColumn("_all", F.sum("_n").over(W.partitionBy(F.lit(1)))).drop("_n")
    out = dealt.join(F.broadcast(parts), "_part")
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before", "_all")


def row_index(df: DataFrame, *order: str) -> DataFrame:
    """Adds `row_idx` (0-based position by `order`, which must be unique) and `n_rows`."""
    return placed(df, list(order), "row_idx", "n_rows")


def running_sum(df: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `amount` over the rows before, by the unique column `order`; by ranges, like places."""
    dealt = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(amount).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before")


def segment_of(n_segments: int, row: str = "row_idx", n: str = "n_rows") -> Column:
    """floor(row * N / n): not ntile, whose larger groups come first."""
    return F.floor(F.col(row) * n_segments / F.col(n)).cast("int")


def assign_segments(df: DataFrame, n_segments: int = 12) -> DataFrame:
    return df.withColumn("seg", segment_of(n_segments))


def stride_sample(df: DataFrame, cap: int) -> DataFrame:
    """Every step-th row, the step being n // cap (1 at least)."""
    return df.filter(F.col("row_idx") % F.greatest(F.lit(1), F.floor(F.col("n_rows") / cap)) == 0)


def probe_rows(n: Column, m: int) -> Column:
    """m positions evenly spread over 0..n-1, halves rounded to even, as an array without repeats."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.bround(i * (n - 1) / F.lit(m - 1)).cast("long")))


def probe_sample(df: DataFrame, m: int) -> DataFrame:
    return df.filter(F.array_contains(probe_rows(F.col("n_rows"), m), F.col("row_idx")))


def permuted(df: DataFrame, key: str, seed: str) -> DataFrame:
    """A seeded order for tables without time: sort by it where random folds are wanted."""
    return df.withColumn("order_key", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))


def split_role(holdout: float = 0.15) -> Column:
    """`train` or `holdout`: the last share of rows."""
    first = F.greatest(F.lit(1), F.floor(F.col("n_rows") * (1 - holdout)))
    return F.when(F.col("row_idx") >= first, "holdout").otherwise("train")


def forward_role(cut: float = 0.75, embargo: int = 50) -> Column:
    """`past` before the cut less the embargo, `future` from the cut on, `gap` between."""
    at = F.floor(F.col("n_rows") * cut)
    return F.when(F.col("row_idx") >= at, "future").when(F.col("row_idx") < at - embargo, "past").otherwise("gap")


def fold_map(segments: DataFrame, n_folds: int) -> DataFrame:
    """(seg, fold): whole segments, the largest first, each to the lightest fold (ties: the lowest). segments: (seg, n)."""
    load, rows = [0] * n_folds, []
    for r in sorted(segments.collect(), key=lambda r: (-r["n"], r["seg"])):  # one row per segment
        fold = load.index(min(load))
        load[fold] += r["n"]
        rows.append((r["seg"], fold))
    return segments.sparkSession.createDataFrame(rows, "seg int, fold int")


def purged_folds(df: DataFrame, n_folds: int, embargo: int) -> DataFrame:
    """(fold, row_idx, role): valid rows of each fold, and train rows further than the embargo from every valid run.

    A run of neighbouring segments of one fold is one interval; a row is purged by a range test against its fold's
    few intervals, which are broadcast.
    """
    segs = df.groupBy("seg").agg(F.count("*").alias("n"), F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi"))
    folds = fold_map(segs.select("seg", "n"), n_folds)
    spans = segs.join(F.broadcast(folds), "seg").groupBy("fold").agg(F.collect_list(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"))).alias("spans"))
    rows = df.select("row_idx", "seg").join(F.broadcast(folds.withColumnRenamed("fold", "own")), "seg")
    grid = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).join(F.broadcast(spans), "fold")
    near = F.exists("spans", lambda s: (F.col("row_idx") >= s["lo"] - embargo) & (F.col("row_idx") <= s["hi"] + embargo))
    return grid.withColumn("role", F.when(F.col("own") == F.col("fold"), "valid").when(near, "purged").otherwise("train")).select("fold", "row_idx", "role")


def walk_forward_bounds(df: DataFrame, n_folds: int, embargo: int, least: int = 200) -> DataFrame:
    """(fold, train_end, start, stop): expanding training ranges before each of the last segments; short ones are left out."""
    segs = df.groupBy("seg").agg(F.min("row_idx").alias("start"), (F.max("row_idx") + 1).alias("stop"))
    every = W.partitionBy(F.lit(1))
    segs = segs.withColumn("place", F.row_number().over(W.orderBy("seg"))).withColumn("all", F.count("*").over(every))
    last = segs.filter(F.col("place") > F.col("all") - F.least(F.lit(n_folds), F.col("all") - 2))
    return last.withColumn("train_end", F.col("start") - embargo).filter(F.col("train_end") > least).select(F.col("seg").alias("fold"), "train_end", "start", "stop")


def lagged(df: DataFrame, columns: list[str], h: int = 1, suffix: str = "_lag") -> DataFrame:
    """The columns' values h rows before, by an equi-join on the row number: no window over all rows."""
    before = df.select((F.col("row_idx") + h).alias("row_idx"), *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    return df.join(before, "row_idx", "left")


def bands(df: DataFrame, column: str, shares: tuple[float, ...] = (1 / 3, 2 / 3), name: str = "band") -> DataFrame:
    """The number of quantile edges below the value (an edge itself belongs to the lower band)."""
    found = F.array(*[F.lit(e) for e in exact_quantiles(df, column, list(shares)) if e == e]).cast("array<double>")
    return df.withColumn(name, F.size(F.filter(found, lambda e: e < F.col(column))))


def worlds(df: DataFrame, states: list[str], least: int) -> DataFrame:
    """(kind, state, n): every state of every state column with at least `least` rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).cast("int").alias("state")) for s in states])).alias("w")).select("w.*")
    return long.groupBy("kind", "state").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
