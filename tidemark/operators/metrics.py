"""Scores of predictions against targets: pooled, by rank, by segment, by resampled segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import neg_rmse, pearson
from tidemark.operators.keys import placed, running_sum
from tidemark.operators.quantiles import exact_quantiles


def position_rank(df: DataFrame, column: str, tie: str, name: str) -> DataFrame:
    """Adds `name`: the 0-based rank by (column, tie), which together are unique; ranges of rows, never a window over all."""
    return placed(df, [column, tie], name)


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds `name`: the 1-based rank by the column, equal values at the mean of their places.

    Distinct values are counted first, and their counts summed up in order.
    """
    values = running_sum(df.groupBy(column).agg(F.count("*").alias("_n")), column, "_n", "_ahead")
    return df.join(values.select(column, (F.col("_ahead") + (F.col("_n") + 1) / 2).alias(name)), column)


def _rank_sums(label, rank) -> list:
    """Rank sum of the positives, their number and all rows, as doubles: products of counts outgrow 64 bits."""
    return [F.sum(F.when(label == 1, rank.cast("double"))).alias("s"), F.sum(label).cast("double").alias("p"), F.count("*").cast("double").alias("n")]


def auc_rank(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """(auc): rank-sum AUC with ties in row order."""
    r = position_rank(df, score, tie, "_rank").agg(*_rank_sums(F.col(label), F.col("_rank") + 1))
    return r.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def gini(df: DataFrame, score: str, y: str) -> DataFrame:
    """(gini): 2 AUC - 1 with tied scores shared; a target of more than two values is cut above its median."""
    many = df.select(y).filter(F.col(y).isNotNull()).distinct().limit(3).count() > 2
    label = (F.col(y) > exact_quantiles(df, y, [0.5])[0]).cast("int") if many else F.col(y).cast("int")
    r = average_rank(df.withColumn("_label", label), score, "_rank")
    r = r.agg(*_rank_sums(F.col("_label"), F.col("_rank")))
    auc = F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return r.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), 2 * auc - 1).otherwise(0.0).alias("gini"))


def spearman(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """(spearman): correlation of the ranks, ties in row order."""
    both = position_rank(position_rank(df.select(a, b, tie), a, tie, "_a"), b, tie, "_b")
    return both.agg(pearson("_a", "_b").alias("spearman"))


def score_metric(df: DataFrame, pred: str, y: str, metric: str, tie: str) -> DataFrame:
    """(score) by name: pearson, gini, spearman, rmse or neg_rmse (the same); an unknown name is an error."""
    if metric == "pearson":
        return df.agg(pearson(pred, y).alias("score"))
    if metric in ("rmse", "neg_rmse"):
        return df.agg(neg_rmse(pred, y).alias("score"))
    if metric == "gini":
        return gini(df, pred, y).withColumnRenamed("gini", "score")
    if metric == "spearman":
        return spearman(df, pred, y, tie).withColumnRenamed("spearman", "score")
    raise ValueError(f"no metric {metric!r}")


def segment_scores(df: DataFrame, pred: str, y: str, least: int = 50) -> DataFrame:
    """(seg, n, score) of the segments with at least `least` rows."""
    return df.groupBy("seg").agg(F.count("*").alias("n"), pearson(pred, y).alias("score")).filter(F.col("n") >= least)


def era_scores(df: DataFrame, pred: str, y: str) -> DataFrame:
    """(era_mean, late_mean, worst): over all segments, the latest third of them, and the worst one."""
    s = segment_scores(df, pred, y).select("seg", "score", F.lit(True).alias("scored"))
    segs = df.select("seg").distinct().withColumn("back", F.row_number().over(W.orderBy(F.desc("seg")))).withColumn("all", F.count("*").over(W.partitionBy(F.lit(1))))
    late = segs.withColumn("late", F.col("back") <= F.greatest(F.lit(2), F.floor(F.col("all") / 3))).join(s, "seg", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return late.agg(zero(F.avg("score")).alias("era_mean"), zero(F.avg(F.when(F.col("late"), F.col("score")))).alias("late_mean"), zero(F.min("score")).alias("worst"))


def block_bootstrap(df: DataFrame, pred: str, y: str, draws: DataFrame) -> DataFrame:
    """(rep, corr): the pooled correlation of resampled segments. draws: (rep, seg, times).

    Six sums per segment are all that is needed; rows are read once, whatever the number of replicates.
    """
    p, t = F.col(pred), F.col(y)
    sums = df.groupBy("seg").agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(t).alias("sy"), F.sum(p * p).alias("pp"), F.sum(t * t).alias("yy"), F.sum(p * t).alias("py"))
    total = draws.join(F.broadcast(sums), "seg").groupBy("rep").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n", "sp", "sy", "pp", "yy", "py")])
    cov = F.col("py") / F.col("n") - F.col("sp") * F.col("sy") / F.pow("n", F.lit(2))
    vp, vy = F.col("pp") / F.col("n") - F.pow(F.col("sp") / F.col("n"), 2), F.col("yy") / F.col("n") - F.pow(F.col("sy") / F.col("n"), 2)
    return total.select("rep", F.when((vp > 1e-24) & (vy > 1e-24), cov / F.sqrt(vp * vy)).otherwise(0.0).alias("corr"))


def softmax_weights(df: DataFrame, column: str, temperature: float) -> DataFrame:
    """Adds `weight`: exp(T * (x - max)) normalised over the table (of candidates, not of rows); null gets 0."""
    one = W.partitionBy(F.lit(1))
    e = F.coalesce(F.exp(F.greatest(F.lit(-80.0), (F.col(column) - F.max(column).over(one)) * temperature)), F.lit(0.0))
    return df.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(one)).drop("_e")


def normalize01(df: DataFrame, column: str) -> DataFrame:
    """Adds `unit`: min-max over the table; a constant column is 1 if positive and 0 if not."""
    one = W.partitionBy(F.lit(1))
    low, high = F.min(column).over(one), F.max(column).over(one)
    flat = F.when(F.col(column) > 0, 1.0).otherwise(0.0)
    return df.withColumn("unit", F.coalesce(F.when(high - low > 1e-12, (F.col(column) - low) / (high - low)).otherwise(flat), F.lit(0.0)))


def bucket_weights(df: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, weight): sums per key (null and empty keys left out), floored at 0, normalised, rounded to 6."""
    sums = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.greatest(F.lit(0.0), F.sum(weight)).alias("w"))
    return sums.select(F.col(key).alias("key"), F.round(F.col("w") / F.sum("w").over(W.partitionBy(F.lit(1))), 6).alias("weight"))
