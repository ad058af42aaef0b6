"""Per-feature statistics in one scan, and the Gram cells that linear work rests on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import pearson
from tidemark.operators.moments import moment_rows, moments


def per_feature(df: DataFrame, features: list[str], stats: dict[str, Callable[[str], Column]], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature, pos, one column per statistic): all features in one aggregation, then turned to rows."""
    wide = df.groupBy(*keys).agg(*[F.struct(*[make(f).alias(name) for name, make in stats.items()]).alias(f"_{i}") for i, f in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("pos"), *[F.col(f"_{i}")[name].alias(name) for name in stats]) for i, f in enumerate(features)])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def corr_vector(df: DataFrame, features: list[str], y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return per_feature(df, features, {"corr": lambda f: pearson(f, y)}, keys)


def segment_corrs(df: DataFrame, features: list[str], y: str, least: int = 50) -> DataFrame:
    """(seg, feature, pos, corr): 0 for segments with fewer than `least` rows."""
    out = per_feature(df, features, {"c": lambda f: pearson(f, y), "n": lambda f: F.count("*")}, ("seg",))
    return out.select("seg", "feature", "pos", F.when(F.col("n") >= least, F.col("c")).otherwise(0.0).alias("corr"))


def gram_cells(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, n, sum_i, sum_j, sum_ij): sums over each cell for every pair i <= j of columns, in one scan.

    Plain sums by one expression per pair, for a few columns. Many columns, and covariances of columns far from zero, are for `moment_rows`.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(columns)]
    cross = [F.sum(F.col(columns[i]).cast("double") * F.col(columns[j])).alias(f"_x{i}_{j}") for i, j in pairs]
    wide = df.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *cross)
    cell = F.array(*[F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"_s{i}").alias("sum_i"), F.col(f"_s{j}").alias("sum_j"), F.col(f"_x{i}_{j}").alias("sum_ij")) for i, j in pairs])
    return wide.select(*keys, "n", F.explode(cell).alias("_c")).select(*keys, "_c.i", "_c.j", "n", "_c.sum_i", "_c.sum_j", "_c.sum_ij")


def correlations(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, corr) of the pairs of a table of `moment_rows`."""
    own = rows.filter("i = j").select(*keys, F.col("i").alias("c"), F.col("cov").alias("var"))
    a, b = own.select(*keys, F.col("c").alias("i"), F.col("var").alias("vi")), own.select(*keys, F.col("c").alias("j"), F.col("var").alias("vj"))
    out = rows.filter("i <> j").join(a, [*keys, "i"]).join(b, [*keys, "j"])
    return out.select(*keys, "i", "j", F.when((F.col("vi") > 1e-24) & (F.col("vj") > 1e-24), F.col("cov") / F.sqrt(F.col("vi") * F.col("vj"))).otherwise(0.0).alias("corr"))


def information_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, value): Z'Z / (n - 1) of columns standardised with the population deviation, nulls at the mean."""
    m = moments(df, columns)
    value = m.corr() * m.n / (m.n - 1)
    rows = [(columns[i], columns[j], float(value[i, j])) for i in range(len(columns)) for j in range(i, len(columns))]
    return df.sparkSession.createDataFrame(rows, "i string, j string, value double")


def ranked(scores: DataFrame, score: str = "score") -> DataFrame:
    """Adds `rank` from 1: highest score first, ties by column position."""
    return scores.withColumn("rank", F.row_number().over(W.orderBy(F.col(score).desc(), "pos")))


# --- rankers: every one returns (feature, pos, score)


def rank_top(df: DataFrame, features: list[str], y: str) -> DataFrame:
    return corr_vector(df, features, y).select("feature", "pos", F.abs("corr").alias("score"))


def rank_stable(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """|mean| - sd of the correlations by segment."""
    return segment_corrs(df, features, y).groupBy("feature", "pos").agg((F.abs(F.avg("corr")) - F.stddev_pop("corr")).alias("score"))


def rank_two_clocks(df: DataFrame, features: list[str], y: str, mode: str = "both") -> DataFrame:
    """`both`: the smaller of the full and the recent (last quarter) |corr|; `dawn`: the recent one, less 1 unless it rises."""
    recent = F.col("row_idx") >= F.floor(F.col("n_rows") * 0.75)
    part = lambda f: F.when(recent, F.col(f))
    out = per_feature(df, features, {"full": lambda f: F.abs(pearson(f, y)), "late": lambda f: F.abs(pearson(part(f), y))})
    score = F.least("full", "late") if mode == "both" else F.when(F.col("late") > F.col("full"), F.col("late")).otherwise(F.col("late") - 1)
    return out.select("feature", "pos", score.alias("score"))


def rank_shadow(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Features of at least median variance by least |corr| first, all others behind."""
    out = per_feature(df, features, {"corr": lambda f: F.abs(pearson(f, y)), "var": lambda f: F.var_pop(f)})
    middle = F.percentile("var", 0.5).over(W.partitionBy(F.lit(1)))
    return out.withColumn("middle", middle).select("feature", "pos", F.when(F.col("var") >= F.col("middle"), -F.col("corr")).otherwise(-10 - F.col("corr")).alias("score"))


def rank_fault(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """The largest jump of the correlation between neighbouring segments."""
    c = segment_corrs(df, features, y).withColumn("jump", F.abs(F.col("corr") - F.lag("corr").over(W.partitionBy("feature").orderBy("seg"))))
    return c.groupBy("feature", "pos").agg(F.coalesce(F.max("jump"), F.lit(0.0)).alias("score"))


def rank_sign_stability(df: DataFrame, features: list[str], y: str, share: float = 0.25) -> DataFrame:
    """|corr|, less 1 where more than `share` of the segments have the other sign."""
    whole = corr_vector(df, features, y).withColumnRenamed("corr", "pooled")
    c = segment_corrs(df, features, y).join(F.broadcast(whole), ["feature", "pos"])
    other = F.avg(F.when(F.signum("corr") != F.signum("pooled"), 1.0).otherwise(0.0))
    out = c.groupBy("feature", "pos", "pooled").agg(other.alias("other"))
    return out.select("feature", "pos", F.when(F.col("other") > share, F.abs("pooled") - 1).otherwise(F.abs("pooled")).alias("score"))


def rank_springs(df: DataFrame, lagged: DataFrame, features: list[str], y: str) -> DataFrame:
    """max(0, autocorrelation at lag 1) times |corr|; `lagged` holds the columns one row before as <name>_lag."""
    auto = per_feature(lagged, features, {"auto": lambda f: pearson(f, f"{f}_lag"), "corr": lambda f: F.abs(pearson(f, y))})
    return auto.select("feature", "pos", (F.greatest(F.lit(0.0), "auto") * F.col("corr")).alias("score"))


def rank_echo(lagged: DataFrame, features: list[str], y: str) -> DataFrame:
    """|corr| with the target one row before."""
    return per_feature(lagged, features, {"score": lambda f: F.abs(pearson(f, f"{y}_lag"))})


def rank_by_state(df: DataFrame, features: list[str], y: str, state: str, least: int = 300, pick: str = "min") -> DataFrame:
    """The smallest |corr| over the states of a regime with enough rows (`min`), or the best one less the pooled (`lift`)."""
    c = per_feature(df, features, {"c": lambda f: F.abs(pearson(f, y)), "n": lambda f: F.count("*")}, (state,)).filter(F.col("n") >= least)
    if pick == "min":
        return c.groupBy("feature", "pos").agg(F.min("c").alias("score"))
    pooled = corr_vector(df, features, y).select("feature", F.abs("corr").alias("pooled"))
    return c.groupBy("feature", "pos").agg(F.max("c").alias("best")).join(F.broadcast(pooled), "feature").select("feature", "pos", (F.col("best") - F.col("pooled")).alias("score"))


def rank_invariant(df: DataFrame, features: list[str], y: str, states: list[str], least: int = 80) -> DataFrame:
    """|mean| - sd of the correlations over all worlds: every state of every state column with enough rows."""
    parts = [per_feature(df, features, {"c": lambda f: pearson(f, y), "n": lambda f: F.count("*")}, (s,)).filter(F.col("n") >= least).select("feature", "pos", "c") for s in states]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("feature", "pos").agg((F.abs(F.avg("c")) - F.stddev_pop("c")).alias("score"))


def rank_irm(df: DataFrame, features: list[str], y: str, environments: list[str], penalty: float = 0.5, least: int = 80) -> DataFrame:
    """|mean slope| - sd - penalty * flip share * |mean slope| over environments: all states of the columns given (segments are one) with enough rows.

    Slopes are per deviation of the feature. With fewer than three environments |corr| decides.
    """
    slope = lambda f: F.covar_pop(f, y) / (F.stddev_pop(f) + 1e-9)
    parts = [per_feature(df, features, {"s": slope, "n": lambda f: F.count("*")}, (e,)).filter(F.col("n") >= least).select("feature", "s") for e in environments]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("m", F.avg("s").over(W.partitionBy("feature")))
    flips = F.avg(F.when(F.signum("s") != F.signum("m"), 1.0).otherwise(0.0))
    size = F.abs(F.avg("s"))
    held = every.groupBy("feature").agg(F.when(F.count("*") >= 3, size - F.stddev_pop("s") - penalty * flips * size).alias("score"))
    return corr_vector(df, features, y).join(held, "feature", "left").select("feature", "pos", F.coalesce("score", F.abs("corr")).alias("score"))


def rank_periphery(df: DataFrame, features: list[str], y: str, credit: DataFrame) -> DataFrame:
    """|late - early |corr|| / (1 + 10 * credit), cut at three quarters of the rows; credit: (feature, credit)."""
    late = F.col("row_idx") >= F.floor(F.col("n_rows") * 0.75)
    part = lambda cond: lambda f: F.abs(pearson(F.when(cond, F.col(f)), y))
    out = per_feature(df, features, {"late": part(late), "early": part(~late)}).join(F.broadcast(credit), "feature", "left")
    return out.select("feature", "pos", (F.abs(F.col("late") - F.col("early")) / (1 + 10 * F.coalesce("credit", F.lit(0.0)))).alias("score"))


def anova_f(df: DataFrame, features: list[str], state: str, least: int = 20) -> DataFrame:
    """(feature, pos, score): between-group over within-group sum of squares."""
    g = per_feature(df, features, {"n": lambda f: F.count(f), "m": lambda f: F.avg(f), "v": lambda f: F.var_pop(f)}, (state,)).filter(F.col("n") >= least)
    of = W.partitionBy("feature")
    g = g.withColumn("all", F.sum(F.col("n") * F.col("m")).over(of) / F.sum("n").over(of))
    between, within = F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), 2)), F.sum(F.col("n") * F.col("v"))
    return g.groupBy("feature", "pos").agg((between / (within + 1e-12)).alias("score"))


def feature_shift(a: DataFrame, b: DataFrame, features: list[str]) -> DataFrame:
    """(feature, pos, shift): |difference of means| / sd of a, and half the |log ratio| of the variances."""
    stats = {"m": lambda f: F.avg(f), "v": lambda f: F.var_pop(f)}
    x = per_feature(a, features, stats)
    z = per_feature(b, features, stats).select("feature", F.col("m").alias("m2"), F.col("v").alias("v2"))
    shift = F.abs(F.col("m2") - F.col("m")) / (F.sqrt("v") + 1e-9) + 0.5 * F.abs(F.log((F.col("v2") + 1e-9) / (F.col("v") + 1e-9)))
    return x.join(z, "feature").select("feature", "pos", shift.alias("shift"))
