"""Tables of outside scores, and small decisions on candidates and blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_rows(raw: DataFrame) -> DataFrame:
    """(filename, private, public, description) from rows of strings with alternate names; without a file name a row is no score, bad numbers are null."""
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    number = lambda n: F.expr(f"try_cast({n} as double)") if n in raw.columns else F.lit(None).cast("double")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    name = first("filename", "file", "submission")
    out = raw.select(F.substring_index(name, "/", -1).alias("filename"), finite(number("private")).alias("private"), finite(number("public")).alias("public"), F.coalesce(first("description", "message"), F.lit("")).alias("description"))
    return out.filter("filename is not null")


def is_external(markers: tuple[str, ...] = ("external reference",)) -> Column:
    text = F.lower(F.concat_ws(" ", "filename", "description"))
    return F.greatest(F.lit(False), *[F.contains(text, F.lit(m)) for m in markers])


def classify_scores(scores: DataFrame, private: float, public: float) -> DataFrame:
    """Adds `action` by the distance to the champion's private and public scores."""
    p, gap = F.col("private"), lambda d: private - d
    action = (
        F.when(is_external(), "external_reference_only").when(p.isNull(), "missing_score").when(p >= gap(0.00008), "promote_as_teacher").when(p >= gap(0.0006), "near_champion_neighbor")
        .when((F.col("public") > public) & (p < private), "public_stabilizer_private_lag").when(p < gap(0.006), "negative_witness_or_demote").when(p < gap(0.002), "weak_route_rehabilitate_only").otherwise("useful_witness")
    )
    return scores.withColumn("action", action)


def match_runs(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """(filename, run) by the `s<seed>` tokens of a description: an equi-join on the seed. runs: (run, seed)."""
    seeds = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"\bs([0-9]+)\b"), F.lit(1)))).alias("seed")
    return scores.select("filename", seeds).join(runs.select("run", F.col("seed").cast("string").alias("seed")), "seed").select("filename", "run").distinct()


def complexity(c: DataFrame, tiers: DataFrame, steps: DataFrame, k_max: float, overfit_max: float) -> DataFrame:
    """Adds `complexity`: 0.4 of the model's tier (0.5 if unknown), 0.3 of the share of k, 0.15 of the transform's tier (0.3), 0.15 of the share of overfit.

    tiers: (skill, tier), steps: (transform, step); c has skill, transform, k and overfit.
    """
    j = c.join(F.broadcast(tiers), "skill", "left").join(F.broadcast(steps), "transform", "left")
    fit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("overfit") - 1) / max(1e-6, overfit_max - 1)))
    value = 0.4 * F.coalesce("tier", F.lit(0.5)) + 0.3 * F.least(F.lit(1.0), F.col("k") / k_max) + 0.15 * F.coalesce("step", F.lit(0.3)) + 0.15 * fit
    return j.withColumn("complexity", value).drop("tier", "step")


def beats_selection(gain: Column, configs: Column) -> Column:
    """Whether a gain is more than what choosing the best of so many would give by chance."""
    return gain > 0.0015 + 0.001 * F.log(configs)


def apply_weights(preds: DataFrame, weights: DataFrame, row: str) -> DataFrame:
    """(row, blend): weighted mean of the members' predictions. preds: (member, row, pred), weights: (member, weight)."""
    return preds.join(F.broadcast(weights), "member").groupBy(row).agg((F.sum(F.col("pred") * F.col("weight")) / F.sum("weight")).alias("blend"))


def blend_simple(df: DataFrame, members: list[str], weights: dict[str, float]) -> DataFrame:
    """Adds equal, weighted and middle: mean, mean by weights, and median of a row's member columns."""
    cols, total = [F.col(m) for m in members], sum(weights.values())
    ordered, n = F.array_sort(F.array(*cols)), len(members)
    middle = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    return df.withColumns({"equal": sum(cols, F.lit(0.0)) / n, "weighted": sum((F.col(m) * weights[m] for m in members), F.lit(0.0)) / total, "middle": middle})


def train_cv_gap(c: DataFrame, limit: float = 6.0) -> DataFrame:
    """Adds gap, decay and alarm: fit less oof, oof less forward, and whether overfit is beyond `limit` or the forward score is not positive."""
    return c.withColumn("gap", F.col("fit") - F.col("oof")).withColumn("decay", F.col("oof") - F.col("wf")).withColumn("alarm", (F.col("overfit") > limit) | (F.col("wf") <= 0))


def overfit_ratio(fit: Column, oof: Column) -> Column:
    """fit / oof, 999 where oof is not positive or the ratio is larger."""
    return F.when(oof > 0, F.least(F.lit(999.0), fit / F.greatest(oof, F.lit(1e-6)))).otherwise(999.0)
