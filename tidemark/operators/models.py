"""Models as Spark jobs: one scan gives the sums, the driver solves small systems, predictions are expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pearson
from tidemark.operators.features import per_feature
from tidemark.operators.moments import moments
from tidemark.operators.transforms import quantiles


def linear(coef: dict[str, float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for c, w in coef.items():
        out = out + F.col(c) * float(w)
    return out


def fit_ridge(df: DataFrame, features: list[str], y: str, alpha: float) -> tuple[dict[str, float], float]:
    """Ridge on standardised features (population deviation); coefficients in the features' own units."""
    m, k = moments(df, [*features, y]), len(features)
    n, mean, cov = m.n, m.mean, m.cov
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0)) + 1e-12
    corr = cov[:k, :k] / np.outer(sd, sd)
    beta = np.linalg.solve(n * corr + alpha * np.eye(k), n * cov[:k, k] / sd) / sd
    return dict(zip(features, beta.tolist())), float(mean[k] - beta @ mean[:k])


def pls1(df: DataFrame, features: list[str], y: str, parts: int) -> dict[str, float]:
    """Partial least squares from the cross products alone: coefficients of the standardised features."""
    m, k = moments(df, [*features, y]), len(features)
    n, mean, cov = m.n, m.mean, m.cov
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0)) + 1e-12
    xx, xy = cov[:k, :k] / np.outer(sd, sd), cov[:k, k] / sd
    basis, v = [], xy.copy()  # the Krylov space of (xx, xy): PLS is least squares in it
    for _ in range(min(parts, k)):
        for b in basis:
            v = v - (b @ xx @ v) * b
        size = np.sqrt(max(v @ xx @ v, 0))
        if size < 1e-12:
            break
        basis.append(v / size)
        v = xx @ basis[-1]
    beta = sum(((b @ xy) * b for b in basis), np.zeros(k))
    return dict(zip(features, beta.tolist()))


def fit_majority_vote(df: DataFrame, features: list[str], y: str) -> Column:
    """The mean over features of sign(corr) * sign(x - median)."""
    row = per_feature(df, features, {"c": lambda f: pearson(f, y), "m": lambda f: F.percentile(f, 0.5)}).collect()
    return sum((F.signum(F.col(r["feature"]) - r["m"]) * float(np.sign(r["c"])) for r in row), F.lit(0.0)) / len(features)


def fit_bin_means(df: DataFrame, feature: str, y: str, bins: int = 16) -> DataFrame:
    """(bin, n, mean) over quantile bins; an edge belongs to the upper bin."""
    edges = quantiles(df, feature, [i / bins for i in range(1, bins)])
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(feature)))
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def fit_ols(df: DataFrame, feature: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, slope, intercept, r2) of a one-feature line per cell."""
    return df.groupBy(*keys).agg(F.regr_slope(y, feature).alias("slope"), F.regr_intercept(y, feature).alias("intercept"), F.regr_r2(y, feature).alias("r2"))
