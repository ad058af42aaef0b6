"""Blends of members (columns of predictions), judged on a target. Weights are small tables; rows are read once per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pearson
from tidemark.operators.metrics import average_rank
from tidemark.operators.moments import moments as all_moments
from tidemark.operators.transforms import moments, quantiles, z


def standardised(df: DataFrame, members: list[str]) -> DataFrame:
    """The members as z-scores under their own names."""
    m = moments(df, members)
    return df.withColumns({c: z(c, *m[c]) for c in members})


def member_corrs(df: DataFrame, members: list[str], y: str) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """(corr with y, corr between members) from one Gram scan: members squared numbers."""
    columns = [*members, y]
    c = all_moments(df, columns).corr()
    return {m: float(c[i, -1]) for i, m in enumerate(members)}, {(a, b): float(c[i, j]) for i, a in enumerate(members) for j, b in enumerate(members) if i != j}


def weights_by_corr(own: dict[str, float]) -> dict[str, float]:
    """Proportional to the positive part of the correlation; equal if none is positive."""
    up = {m: max(0.0, c) for m, c in own.items()}
    total = sum(up.values())
    return {m: (c / total if total > 0 else 1 / len(up)) for m, c in up.items()}


def weights_by_agreement(own: dict[str, float], pairs: dict[tuple[str, str], float]) -> dict[str, float]:
    """Proportional to corr times the mean |corr| with the other members."""
    mean = {m: sum(abs(pairs[m, o]) for o in own if o != m) / max(1, len(own) - 1) for m in own}
    return weights_by_corr({m: own[m] * mean[m] for m in own})


def blended(weights: dict[str, float]) -> Column:
    return sum((F.col(m) * float(w) for m, w in weights.items()), F.lit(0.0))


def row_median(members: list[str]) -> Column:
    s = F.sort_array(F.array(*members))
    n = len(members)
    return (F.element_at(s, (n + 1) // 2) + F.element_at(s, n // 2 + 1)) / 2


def dominance(df: DataFrame, weights: dict[str, float], y: str) -> DataFrame:
    """(member, weight, own, without, marginal): the blend's correlation with and without each member, in one scan."""
    all_of = blended(weights)
    wide = df.agg(
        pearson(all_of, y).alias("blend"),
        *[F.struct(pearson(F.col(m), y).alias("own"), pearson(blended({k: v for k, v in weights.items() if k != m}), y).alias("without")).alias(f"_{i}") for i, m in enumerate(weights)],
    )
    rows = F.array(*[F.struct(F.lit(m).alias("member"), F.lit(float(w)).alias("weight"), F.col(f"_{i}")["own"].alias("own"), F.col(f"_{i}")["without"].alias("without"), (F.col("blend") - F.col(f"_{i}")["without"]).alias("marginal")) for i, (m, w) in enumerate(weights.items())])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def chorus(df: DataFrame, members: list[str], beta: float) -> DataFrame:
    """Adds `chorus`: the mean member, damped by exp(-beta * spread of the row / mean spread)."""
    mean = sum((F.col(m) for m in members), F.lit(0.0)) / len(members)
    spread = F.sqrt(sum((F.pow(F.col(m) - mean, 2) for m in members), F.lit(0.0)) / len(members))
    level = df.agg(F.avg(spread)).first()[0] or 0.0
    return df.withColumn("chorus", mean * F.exp(-beta * spread / (level + 1e-12)))


def shapes(x: Column) -> dict[str, Column]:
    return {"raw": x, "sqrt": F.signum(x) * F.sqrt(F.abs(x)), "pow15": F.signum(x) * F.pow(F.abs(x), 1.5), "tanh": F.tanh(x)}


def shape_scores(df: DataFrame, pred: str, y: str) -> DataFrame:
    """(shape, corr) of a z-scored prediction under each shape."""
    made = shapes(F.col(pred))
    wide = df.agg(*[pearson(e, y).alias(k) for k, e in made.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), F.col(k).alias("corr")) for k in made])).alias("r")).select("r.*")


def winsorize_audit(df: DataFrame, pred: str, y: str, cuts: tuple[float, ...] = (0.0, 0.001, 0.005)) -> DataFrame:
    """(q, corr) of the prediction clipped at its q and 1 - q quantiles."""
    edges = quantiles(df, pred, [s for q in cuts for s in (q, 1 - q)])
    clipped = {q: F.greatest(F.lit(edges[2 * i]), F.least(F.lit(edges[2 * i + 1]), F.col(pred))) for i, q in enumerate(cuts)}
    wide = df.agg(*[pearson(e, y).alias(f"_{i}") for i, e in enumerate(clipped.values())])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"_{i}").alias("corr")) for i, q in enumerate(clipped)])).alias("r")).select("r.*")


def carve_lenses(df: DataFrame, pred: str, q: float = 0.01) -> DataFrame:
    """Adds six z-scored re-expressions: raw, rank (ties shared), sqrt, tanh, clip, pow15."""
    base = df.withColumn("raw", z(pred, *moments(df, [pred])[pred]))
    low, high = quantiles(base, "raw", [q, 1 - q])
    made = shapes(F.col("raw"))
    base = base.withColumns({k: made[k] for k in ("sqrt", "tanh", "pow15")} | {"clip": F.greatest(F.lit(low), F.least(F.lit(high), F.col("raw")))})
    base = average_rank(base, pred, "rank")
    names = ["rank", "sqrt", "tanh", "clip", "pow15"]
    m = moments(base, names)
    return base.withColumns({c: z(c, *m[c]) for c in names})


def attack_null(df: DataFrame, pred: str, y: str, rounds: int) -> DataFrame:
    """(tax, oof, deflated): the 95% quantile of |corr| after the target is shuffled inside segments, and what is left.

    A shuffle is the join of two numberings of a segment: by row, and by a hash of (round, row).
    """
    from pyspark.sql import Window as W

    by_row = W.partitionBy("seg", "round").orderBy("row_idx")
    by_hash = W.partitionBy("seg", "round").orderBy(F.md5(F.concat_ws("-", "round", "row_idx")))
    rows = df.select("seg", "row_idx", pred, y).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    a = rows.select("seg", "round", pred, F.row_number().over(by_row).alias("_at"))
    b = rows.select("seg", "round", y, F.row_number().over(by_hash).alias("_at"))
    null = a.join(b, ["seg", "round", "_at"]).groupBy("round").agg(F.abs(pearson(pred, y)).alias("c"))
    tax = null.agg(F.percentile("c", 0.95)).first()[0] or 0.0
    return df.agg(pearson(pred, y).alias("oof")).select(F.lit(float(tax)).alias("tax"), "oof", (F.col("oof") - float(tax)).alias("deflated"))
