"""Tables of candidates: gates, archives, reports and the memory of runs. Small against the rows, but plain DataFrames too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import pearson, shrunk_mean
from tidemark.operators.keys import placed

AXES = ("skill", "family", "transform")


def gate_decision(c: DataFrame) -> DataFrame:
    """Adds decision and reasons from oof, width, wf_width and overfit."""
    reasons = F.array_compact(F.array(
        F.when(F.col("oof") <= 0, "oof<=0"), F.when(F.col("width") <= 0, "width<=0"), F.when(F.col("wf_width") <= 0, "wf_width<=0"), F.when(F.col("overfit") > 6, "overfit>6"),
    ))
    decision = F.when(F.size(reasons) == 0, "promote").when(F.col("oof") > 0, "expand").otherwise("reject")
    return c.withColumn("decision", decision).withColumn("reasons", F.array_join(reasons, "|"))


def draft_gate(c: DataFrame, order: str, group: str, floor: float = 0.06, free: int = 5) -> DataFrame:
    """Adds `passes`: the first few of a group, those from the floor on, and those not under the median of earlier ones."""
    of = W.partitionBy(group).orderBy(order)
    earlier = F.percentile("width", 0.5).over(of.rowsBetween(W.unboundedPreceding, -1))
    return c.withColumn("_m", earlier).withColumn("passes", (F.row_number().over(of) <= free) | (F.col("width") >= floor) | (F.col("width") >= F.col("_m"))).drop("_m")


def fitness(c: DataFrame, ordinal: str, start: float = 0.8, target: float = 0.5, half_life: float = 60.0) -> DataFrame:
    """Adds `fitness`: from wide to narrow, the share of width falls from `start` to `target`."""
    w = target + (start - target) * F.pow(F.lit(0.5), F.col(ordinal) / half_life)
    return c.withColumn("fitness", (1 - w) * F.col("oof") + w * F.least("width", "wf_width"))


def archive_best(c: DataFrame, cell: list[str], key: str) -> DataFrame:
    """The best candidate of every cell with a positive score; ties by key."""
    of = W.partitionBy(*cell).orderBy(F.desc("oof"), key)
    return c.filter("oof > 0").withColumn("_n", F.row_number().over(of)).filter("_n = 1").drop("_n")


def learning_curve(c: DataFrame, group: str, order: str, cost: str) -> DataFrame:
    run = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = c.withColumn("total_cost", F.sum(cost).over(run)).withColumn("best_width", F.max("width").over(run))
    return out.withColumn("best_per_cost", F.col("best_width") / F.col("total_cost"))


def quorum_report(c: DataFrame, voter: str, quorum: int = 3) -> DataFrame:
    n = F.count_distinct(voter)
    return c.groupBy("family").agg(n.alias("voters"), (n >= quorum).alias("quorum"), F.array_join(F.array_sort(F.collect_set(voter)), ",").alias("names"))


def species_report(c: DataFrame, explorer: str, order: str) -> DataFrame:
    return c.groupBy(explorer).agg(F.count("*").alias("lessons"), F.sum(F.col("promoted").cast("int")).alias("promoted"), F.max("oof").alias("best_oof"), F.max_by("stage", order).alias("last_stage"))


def study_reports(c: DataFrame) -> DataFrame:
    """(axis, value, n, mean_oof, max_oof, mean_width, promote_rate): one aggregation with grouping sets."""
    axis = F.when(F.grouping("skill") == 0, "skill").when(F.grouping("family") == 0, "family").otherwise("transform")
    sets = [[F.col(a)] for a in AXES]
    out = c.groupingSets(sets, *AXES).agg(axis.alias("axis"), F.count("*").alias("n"), F.avg("oof").alias("mean_oof"), F.max("oof").alias("max_oof"), F.avg("width").alias("mean_width"), F.avg(F.col("promoted").cast("int")).alias("promote_rate"))
    return out.select("axis", F.coalesce(*AXES).alias("value"), "n", "mean_oof", "max_oof", "mean_width", "promote_rate")


def typology_memory(c: DataFrame, strength: float = 4.0) -> DataFrame:
    """(skill, family, transform, n, mean_oof, shrunk, best_key): cells shrunk to the mean of all candidates."""
    mean = c.agg(F.avg("oof")).first()[0]
    return c.groupBy(*AXES).agg(F.count("*").alias("n"), F.avg("oof").alias("mean_oof"), shrunk_mean("oof", F.lit(float(mean or 0.0)), strength).alias("shrunk"), F.max_by("key", F.struct("oof", "key")).alias("best_key"))


def typology_gradients(t: DataFrame) -> DataFrame:
    """(from_id, to_id, axis, delta): ordered pairs of cells that differ in exactly one axis.

    One equi-join per axis on the other two, not a join of all pairs.
    """
    out = None
    for axis in AXES:
        same = [a for a in AXES if a != axis]
        a = t.select(*same, F.col("cell").alias("from_id"), F.col(axis).alias("_a"), F.col("shrunk").alias("_x"))
        b = t.select(*same, F.col("cell").alias("to_id"), F.col(axis).alias("_b"), F.col("shrunk").alias("_y"))
        part = a.join(b, same).filter("_a <> _b").select("from_id", "to_id", F.lit(axis).alias("axis"), (F.col("_y") - F.col("_x")).alias("delta"))
        out = part if out is None else out.unionByName(part)
    return out


def ledger_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, n, mean): two ledgers of (key, n, mean) as one, by evidence."""
    x, y = a.select("key", F.col("n").alias("n1"), F.col("mean").alias("m1")), b.select("key", F.col("n").alias("n2"), F.col("mean").alias("m2"))
    n1, n2 = F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0))
    mean = (n1 * F.coalesce("m1", F.lit(0.0)) + n2 * F.coalesce("m2", F.lit(0.0))) / (n1 + n2)
    return x.join(y, "key", "full").select("key", (n1 + n2).alias("n"), mean.alias("mean"))


def attack_subperiod(segment_scores: DataFrame, key: str) -> DataFrame:
    """(key, worst_run, last_two): the worst mean of three segments in a row, and the mean of the last two."""
    of = W.partitionBy(key).orderBy("seg")
    s = segment_scores.withColumn("m", F.avg("score").over(of.rowsBetween(-2, 0))).withColumn("k", F.row_number().over(of)).withColumn("back", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seg"))))
    return s.groupBy(key).agg(F.min(F.when(F.col("k") >= 3, F.col("m"))).alias("worst_run"), F.avg(F.when(F.col("back") <= 2, F.col("score"))).alias("last_two"))


def segment_senate(segment_scores: DataFrame, key: str) -> DataFrame:
    return segment_scores.groupBy(key).agg(F.count_if(F.col("score") > 0.01).alias("yes"), F.count_if(F.col("score") < -0.02).alias("veto"), F.count("*").alias("segments"))


def rank_average_blend(preds: DataFrame, member: str, row: str, weights: dict[str, float] | None = None, z: bool = False) -> DataFrame:
    """(row, blend): the weighted mean of the members' centred ranks, or with `z` of their z-scores; preds: (member, row, pred).

    All members are put in one order (member, prediction, row), by ranges of rows; a rank is the place less that of the member's first row.
    Without weights all members count alike; members without a weight are left out.
    """
    some = preds if weights is None else preds.filter(F.col(member).isin(list(weights)))
    w = F.lit(1.0) if weights is None else F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col(member)]
    if z:
        facts = some.groupBy(member).agg(F.avg("pred").alias("_m"), F.stddev_pop("pred").alias("_s"))
        value = (F.col("pred") - F.col("_m")) / (F.col("_s") + 1e-12)
    else:
        some = placed(some.select(member, row, "pred"), [member, "pred", row], "_r")
        facts = some.groupBy(member).agg(F.min("_r").alias("_m"), F.count("*").alias("_s"))
        value = F.col("_r") - F.col("_m") - (F.col("_s") - 1) / 2
    return some.join(F.broadcast(facts), member).groupBy(row).agg((F.sum(value * w) / F.sum(w)).alias("blend"))


def governor(c: DataFrame) -> DataFrame:
    """(beta, strength, width_decay): slope of decay on complexity, the strength it sets, and how width goes with decay."""
    return c.agg((F.covar_pop("complexity", "decay") / F.var_pop("complexity")).alias("beta"), pearson("width", "decay").alias("width_decay")).select("beta", F.greatest(F.lit(0.0), F.least(F.lit(0.04), F.col("beta") / 2)).alias("strength"), "width_decay")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last by order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
