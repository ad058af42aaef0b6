"""Models made of several ridges: bagged over strides of rows, one per terrain beside a global one, a direction scaled by its expected size; and suspect rows.

Every ridge picks its own penalty by leave-one-out errors. Two scans serve all of them: moments by cell, then the errors of all
(cell, target, penalty) at once. The driver holds columns squared numbers for every cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pearson
from tidemark.operators.arrow import arrow_map, matrix
from tidemark.operators.bayes import Fitted, inner_valid
from tidemark.operators.moments import Moments, collect_moments, total
from tidemark.operators.quantiles import exact_quantiles

ALPHAS = tuple(float(a) for a in np.logspace(-2, 5, 8))
EXPERT_ALPHAS = tuple(float(a) for a in np.logspace(-2, 5, 6))


class Ridge:
    """Ridge on the standardised columns of a cell, for any penalty: the eigenvalues of Z'Z and the targets in its axes."""

    def __init__(self, m: Moments, k: int, alphas: tuple[float, ...]):
        cov = m.cov
        self.n, self.mean, self.sd, self.alphas = m.n, m.mean, np.where(m.sd > 1e-12, m.sd, 1.0)[:k], np.array(alphas)
        values, self.axes = np.linalg.eigh(m.n * cov[:k, :k] / np.outer(self.sd, self.sd))
        self.values = np.maximum(values, 0)
        self.turned = self.axes.T @ (m.n * cov[:k, k:] / self.sd[:, None])

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Sums of squared left-out residuals, targets x penalties; a row's residual is divided by 1 less its own weight in its prediction."""
        k = len(self.sd)
        z = (x[:, :k] - self.mean[:k]) / self.sd @ self.axes
        out = np.empty((x.shape[1] - k, len(self.alphas)))
        for i, a in enumerate(self.alphas):
            left = x[:, k:] - self.mean[k:] - z @ (self.turned / (self.values + a)[:, None])
            out[:, i] = ((left / np.maximum(1 - 1 / self.n - (z**2 / (self.values + a)).sum(axis=1), 1e-12)[:, None]) ** 2).sum(axis=0)
        return out

    def fitted(self, features: list[str], target: int, alpha: float) -> Fitted:
        k = len(self.sd)
        beta = self.axes @ (self.turned[:, target] / (self.values + alpha)) / self.sd
        return Fitted(features, beta, float(self.mean[k + target] - beta @ self.mean[:k]), {"alpha": alpha, "n": self.n})


def ridges(df: DataFrame, features: list[str], targets: list[str], cell: str | None = None, *, least: int = 1, whole: bool = True, alphas: tuple[float, ...] = ALPHAS, cell_alphas: tuple[float, ...] = ALPHAS) -> tuple[dict, Moments | None]:
    """({(cell value or None for all rows, target): Fitted}, moments of all rows).

    Cells with fewer than `least` rows, and rows whose cell is null, have no ridge of their own. `whole` asks for the ridge of all rows;
    it is also made if no cell is large enough. Nulls and NaN in columns stand at the overall mean. An empty table gives ({}, None).
    """
    columns, k = [*features, *targets], len(features)
    cells = collect_moments(df, columns, (cell,) if cell else ())
    if not cells:
        return {}, None
    every = total(cells.values())
    models = {c[0]: Ridge(m, k, cell_alphas) for c, m in cells.items() if cell and c[0] is not None and m.n >= least}
    if whole or not models:
        models[None] = Ridge(every, k, alphas)
    names, held, shift = list(models), list(models.values()), every.shift
    at = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(targets), len(m.alphas))) for m in held]
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b, columns)
            x = np.where(np.isnan(x), shift, x)
            if None in at:
                sums[at[None]] += held[at[None]].errors(x)
            if cell:
                own = np.array([-1 if c is None else at.get(c, -1) for c in b.column(b.schema.get_field_index(cell)).to_pylist()])
                for i in np.unique(own[own >= 0]).tolist():
                    sums[i] += held[i].errors(x[own == i])
        rows = [(i, t, a, float(s[t, a])) for i, s in enumerate(sums) for t in range(s.shape[0]) for a in range(s.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["model", "target", "alpha", "error"])

    some = df.select(*columns, *([cell] if cell and cell not in columns else []))
    got = arrow_map(some, run, "model int, target int, alpha int, error double").groupBy("model", "target", "alpha").agg(F.sum("error").alias("error"))
    best = got.groupBy("model", "target").agg(F.min_by("alpha", F.struct("error", "alpha")).alias("alpha")).collect()  # one row a model and target
    out = {(names[r["model"]], targets[r["target"]]): held[r["model"]].fitted(features, r["target"], float(held[r["model"]].alphas[r["alpha"]])) for r in best}
    return out, every


def fit_bagged_ridge(df: DataFrame, features: list[str], y: str, bags: int = 8, least: int = 100) -> Fitted | None:
    """The mean of ridges on every `bags`-th row; bags with fewer than `least` rows are left out, and without any it is one ridge on all rows. None for no rows."""
    fits, _ = ridges(df.withColumn("_bag", F.col("row_idx") % bags), features, [y], "_bag", least=least, whole=False)
    if not fits:
        return None
    return Fitted(list(features), np.mean([f.beta for f in fits.values()], axis=0), float(np.mean([f.intercept for f in fits.values()])), {"bags": float(len(fits))})


def fit_terrain_router(df: DataFrame, features: list[str], y: str, terrain: str, least: int = 500, shrink: float = 2000.0) -> Column:
    """The prediction of a ridge on all rows; in a terrain of n >= `least` rows it is mixed with the terrain's own by n / (n + shrink)."""
    fits, _ = ridges(df, features, [y], terrain, least=least, cell_alphas=EXPERT_ALPHAS)
    if not fits:
        return F.lit(None).cast("double")
    base = fits.pop((None, y))
    out = base.predict()
    for (c, _), own in sorted(fits.items()):
        w = own.facts["n"] / (own.facts["n"] + shrink)
        both = Fitted(list(features), (1 - w) * base.beta + w * own.beta, (1 - w) * base.intercept + w * own.intercept, {})
        out = F.when(F.col(terrain) == c, both.predict()).otherwise(out)
    return out


def fit_steepness(df: DataFrame, features: list[str], y: str, swing: float = 0.5, most: float = 1.5) -> Column:
    """A ridge on y, times 1 + swing * s: s is the z-scored prediction of a ridge on |y|, clipped to +-most. Both come from the same two scans."""
    fits, every = ridges(df.withColumn("_size", F.abs(y)), features, [y, "_size"])
    if not fits:
        return F.lit(None).cast("double")
    way, size = fits[None, y], fits[None, "_size"]
    m = every.pick(features)
    sd = float(np.sqrt(max(size.beta @ m.cov @ size.beta, 0))) + 1e-9
    s = (size.predict() - float(size.beta @ m.mean + size.intercept)) / sd
    return way.predict() * (1 + swing * F.least(F.greatest(s, F.lit(-most)), F.lit(most)))


def fit_terrace(df: DataFrame, features: list[str], y: str, steps: int = 16, shrink: float = 25.0) -> Column:
    """Half a ridge's z-scored prediction, half the z-scored mean target of its quantile step, drawn to the mean by `shrink` rows; an edge belongs to the upper step."""
    fits, every = ridges(df, features, [y])
    if not fits:
        return F.lit(None).cast("double")
    fit, m = fits[None, y], every.pick(features)
    score, sd = fit.predict(), float(np.sqrt(max(fit.beta @ m.cov @ fit.beta, 0))) + 1e-9
    scored = df.select(score.alias("_score"), F.col(y).cast("double").alias("_y")).filter("_score is not null and _y is not null")
    edges = sorted({e for e in exact_quantiles(scored, "_score", [i / steps for i in range(1, steps)]) if not np.isnan(e)})
    step = lambda c: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= c)) if edges else F.lit(0)
    found = {r["step"]: (r["n"], r["s"]) for r in scored.groupBy(step(F.col("_score")).alias("step")).agg(F.count("*").alias("n"), F.sum("_y").alias("s")).collect()}  # `steps` rows at most
    rows = sum(n for n, _ in found.values())
    mean = sum(s for _, s in found.values()) / max(rows, 1)
    means = np.array([(found[i][1] + shrink * mean) / (found[i][0] + shrink) if i in found else mean for i in range(len(edges) + 1)])
    counts = np.array([found[i][0] if i in found else 0 for i in range(len(edges) + 1)]) / max(rows, 1)
    middle = float(counts @ means)
    spread = float(np.sqrt(counts @ (means - middle) ** 2)) + 1e-9
    own = F.element_at(F.array(*[F.lit(float((v - middle) / spread)) for v in means]), step(score) + 1)
    return 0.5 * (score - float(fit.beta @ m.mean + fit.intercept)) / sd + F.when(score.isNotNull(), 0.5 * own)


def fit_rapids(df: DataFrame, features: list[str], y: str, roughest: float = 0.3, weights: tuple[float, ...] = (0.0, 0.25, 0.5), least: int = 200) -> Fitted | None:
    """A ridge, and a second one on its residuals in the roughest rows; it enters by the weight that serves the inner validation rows best.

    The weight is 0 with fewer than `least` rough rows or fewer than 50 validation rows. df has row_idx and seg. None for no rows.
    """
    fits, _ = ridges(df, features, [y])
    if not fits:
        return None
    first = fits[None, y]
    left = df.withColumn("_left", F.col(y) - first.predict()).withColumn("_rough", F.abs("_left"))
    rough = left.filter(F.col("_rough") >= exact_quantiles(left, "_rough", [1 - roughest])[0])
    second, weight = None, 0.0
    if rough.count() >= least:
        second = ridges(rough, features, ["_left"], alphas=EXPERT_ALPHAS)[0][None, "_left"]
        sizes = {r["seg"]: r["n"] for r in df.groupBy("seg").agg(F.count("*").alias("n")).collect()}
        valid = df.filter(inner_valid(df, max(sizes), sizes[max(sizes)], sum(sizes.values())))
        got = valid.agg(F.count("*").alias("n"), *[pearson(first.predict() + w * second.predict(), y).alias(f"s{i}") for i, w in enumerate(weights)]).first()
        if got["n"] >= 50:
            weight = weights[max(range(len(weights)), key=lambda i: (got[f"s{i}"], -i))]
    if not weight:
        return Fitted(list(features), first.beta, first.intercept, {"weight": 0.0})
    return Fitted(list(features), first.beta + weight * second.beta, first.intercept + weight * second.intercept, {"weight": weight})


def row_court(df: DataFrame, key: str, pred: str, y: str, cell: list[str], share: float = 0.99, top: int = 200) -> DataFrame:
    """(key, studentized_resid, cell_dev, bad_data_score): the `top` rows of largest residual at or beyond its `share` quantile; ties by key.

    The residual is that of y less the z-scored prediction times their covariance, in deviations; cell_dev is the distance of y from the mean of its cell (at most 3
    count). Rows with a null or NaN prediction or target are left out.
    """
    good = df.filter(F.col(pred).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(pred).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    g = good.agg(F.avg(pred).alias("mp"), F.stddev_pop(pred).alias("sp"), F.stddev_pop(y).alias("sy"), F.covar_pop(pred, y).alias("c")).first()
    cells = good.groupBy(*cell).agg(F.avg(y).alias("_mean"))
    if g["c"] is None:
        return good.select(key, *[F.lit(0.0).alias(c) for c in ("studentized_resid", "cell_dev", "bad_data_score")]).limit(0)
    sd = g["sp"] + 1e-12
    left = F.col(y) - (F.col(pred) - g["mp"]) / sd * (g["c"] / sd)
    spread = good.agg(F.stddev_pop(left)).first()[0] + 1e-12
    scored = good.withColumn("studentized_resid", F.abs(left) / spread)
    edge = exact_quantiles(scored, "studentized_resid", [share])[0]
    some = scored.filter(F.col("studentized_resid") >= edge).orderBy(F.desc("studentized_resid"), key).limit(top)
    met = some.alias("s").join(cells.alias("c"), [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in cell])
    dev = F.abs(F.col(f"s.{y}") - F.col("c._mean")) / (g["sy"] + 1e-9)
    return met.select(F.col(f"s.{key}").alias(key), "studentized_resid", dev.alias("cell_dev"), (F.col("studentized_resid") * (0.5 + 0.5 * F.least(dev, F.lit(3.0)))).alias("bad_data_score"))


def terrain_trails(df: DataFrame, paths: list[str], y: str, terrain: str, least: int) -> DataFrame:
    """(path, terrain, rows, corr) of every prediction column in every terrain of `least` rows or more; one scan. 0 for a constant."""
    sums = df.filter(F.col(terrain).isNotNull()).groupBy(F.col(terrain).alias("terrain")).agg(
        F.count("*").alias("rows"), *[pearson(p, y).alias(f"_{i}") for i, p in enumerate(paths)]
    )
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"_{i}").alias("corr")) for i, p in enumerate(paths)])).alias("r")
    return sums.filter(F.col("rows") >= least).select("terrain", "rows", each).select("r.path", "terrain", "rows", "r.corr")
