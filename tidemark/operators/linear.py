"""Linear models from sums: rows are read for Gram cells (and once more for leave-one-out errors), the driver solves small systems."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pearson
from tidemark.operators.moments import Moments, collect_moments, moments

ALPHAS = tuple(float(a) for a in np.logspace(-2, 5, 10))


def standardised(df: DataFrame, features: list[str], y: str) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(n, means, deviations, correlations, correlations with y times its deviation, mean of y)."""
    m, k = moments(df, [*features, y]), len(features)
    n, mean, cov = m.n, m.mean, m.cov
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0)) + 1e-12
    return n, mean[:k], sd, cov[:k, :k] / np.outer(sd, sd), cov[:k, k] / sd, float(mean[k])


def ridge_cv(df: DataFrame, features: list[str], y: str, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(alpha, loo, chosen): leave-one-out root mean squared error of ridge for every alpha, all in one scan.

    A row's left-out residual is its residual by 1 - h, h its own weight in its prediction.
    """
    n, mean, sd, c, cy, my = standardised(df, features, y)
    z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(features, mean, sd)]
    errors = []
    for i, a in enumerate(alphas):
        inv = np.linalg.inv(n * c + a * np.eye(len(features)))
        beta = inv @ (n * cy)
        h = F.lit(1 / n)
        for p in range(len(z)):
            for q in range(len(z)):
                h = h + z[p] * z[q] * float(inv[p, q])
        r = F.col(y) - my - sum((x * float(b) for x, b in zip(z, beta)), F.lit(0.0))
        errors.append(F.sqrt(F.avg(F.pow(r / (1 - h), 2))).alias(f"e{i}"))
    rows = df.agg(*errors).select(F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"e{i}").alias("loo")) for i, a in enumerate(alphas)])).alias("r")).select("r.*")
    best = rows.agg(F.min_by("alpha", F.struct("loo", "alpha")).alias("best"))
    return rows.join(F.broadcast(best)).select("alpha", "loo", (F.col("alpha") == F.col("best")).alias("chosen"))


def pca_components(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, variance, share, loadings): principal components of the standardised columns, widest first, from one Gram table.

    Each has its largest loading positive.
    """
    cov = moments(df, columns).cov
    sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-12
    c = cov / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(c)
    rows = []
    for k, i in enumerate(np.argsort(-values, kind="stable")):
        v = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
        rows.append((k + 1, float(values[i]), float(values[i] / len(columns)), v.tolist()))
    return df.sparkSession.createDataFrame(rows, "component int, variance double, share double, loadings array<double>")


def ridge_of(m: Moments, y: str, alpha: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of ridge on features standardised by the moments' own deviations."""
    k = m.columns.index(y)
    at = [i for i in range(len(m.columns)) if i != k]
    cov, mean = m.cov, m.mean
    sd = np.sqrt(np.maximum(np.diag(cov)[at], 0)) + 1e-12
    beta = np.linalg.solve(m.n * cov[np.ix_(at, at)] / np.outer(sd, sd) + alpha * np.eye(len(at)), m.n * cov[at, k] / sd) / sd
    return beta, float(mean[k] - beta @ mean[at])


def scored_on(df: DataFrame, features: list[str], y: str, fits: list[tuple[float, np.ndarray, float]], name: str) -> DataFrame:
    """(name, score): the correlation with y, over the rows of df, of every (value, coefficients, intercept)."""
    preds = [pearson(sum((F.col(f) * float(b) for f, b in zip(features, beta)), F.lit(b0)), y).alias(f"s{i}") for i, (_, beta, b0) in enumerate(fits)]
    rows = F.array(*[F.struct(F.lit(v).alias(name), F.col(f"s{i}").alias("score")) for i, (v, _, _) in enumerate(fits)])
    return df.agg(*preds).select(F.explode(rows).alias("r")).select("r.*")


def recency_weighted(df: DataFrame, features: list[str], y: str, lambdas: tuple[float, ...] = (0.0, 1.0, 3.0, 8.0), alpha: float = 10.0) -> DataFrame:
    """(lam, score): ridge weighted by exp(-lam * age), age being the share of rows that are newer, fitted before the last segment and scored on it.

    All weightings are draws of one scan.
    """
    last = df.agg(F.max("seg")).first()[0]
    age = (F.col("n_rows") - 1 - F.col("row_idx")) / F.greatest(F.lit(1), F.col("n_rows") - 1)
    train = df.filter(F.col("seg") < last).withColumn("_w", F.array(*[F.exp(-lam * age) for lam in lambdas]))
    cells = collect_moments(train, [*features, y], weights="_w")
    fits = [(lam, *ridge_of(cells[(i,)], y, alpha)) for i, lam in enumerate(lambdas)]
    return scored_on(df.filter(F.col("seg") == last), features, y, fits, "lam")


def recency_ridge(df: DataFrame, features: list[str], y: str, shares: tuple[float, ...] = (0.15, 0.3, 0.5, 1.0), alpha: float = 10.0) -> DataFrame:
    """(share, score): ridge on the last share of the rows before the last segment, scored on that; all shares are draws of one scan."""
    last = df.agg(F.max("seg").alias("seg"), F.max("n_rows").alias("n")).first()
    upto = df.filter(F.col("seg") < last["seg"]).agg(F.max("row_idx")).first()[0] + 1
    train = df.filter(F.col("seg") < last["seg"]).withColumn("_w", F.array(*[(F.col("row_idx") >= int(np.floor(upto * (1 - s)))).cast("double") for s in shares]))
    cells = collect_moments(train, [*features, y], weights="_w")
    fits = [(s, *ridge_of(cells[(i,)], y, alpha)) for i, s in enumerate(shares)]
    return scored_on(df.filter(F.col("seg") == last["seg"]), features, y, fits, "share")


def inner_cells(df: DataFrame, features: list[str], y: str) -> tuple[Moments | None, Moments | None]:
    """(training, validation) moments of the inner split; one scan. df has row_idx and seg."""
    sizes = {r["seg"]: r["n"] for r in df.groupBy("seg").agg(F.count("*").alias("n")).collect()}
    last = max(sizes)
    valid = F.col("seg") == last if 50 <= sizes[last] <= 0.6 * sum(sizes.values()) else F.col("row_idx") % 4 == 0
    cells = collect_moments(df.withColumn("_valid", valid), [*features, y], ("_valid",))
    return cells.get((False,)), cells.get((True,))


def ladder_steps(m: Moments, mean: np.ndarray, sd: np.ndarray, rounds: int, shrink: float) -> list[np.ndarray]:
    """Weights after 0, 1, ... rounds of forward stagewise steps on the rows of m: each moves the column most in line with the residual by a share of its own fit.

    Columns are standardised by the means and deviations given, the last one is the target, about its own mean.
    """
    k = len(mean)
    x = m.about(np.append(mean, m.mean[-1]))
    zz, zy = x[:k, :k] / np.outer(sd, sd), x[:k, k] / sd
    beta, out = np.zeros(k), [np.zeros(k)]
    for _ in range(rounds):
        left = zy - zz @ beta
        j = int(np.argmax(np.abs(left)))
        beta = beta.copy()
        beta[j] += shrink * left[j] / (zz[j, j] + 1e-9)
        out.append(beta)
    return out


def residual_ladder(df: DataFrame, features: list[str], y: str, rounds: int = 80, shrink: float = 0.2, patience: int = 15) -> tuple[dict[str, float], int]:
    """(weights of the standardised columns, rounds): stagewise steps, as many as serve the inner validation rows best.

    The climb on the training rows stops `patience` rounds after its best correlation on the others; then as many rounds are made on all
    rows. With fewer than 50 validation rows it is half of `rounds`.
    """
    train, valid = inner_cells(df, features, y)
    whole = train if valid is None else valid if train is None else train + valid
    mean, sd = whole.mean[:-1], whole.sd[:-1] + 1e-6
    best, score = rounds // 2, -1e9
    if train is not None and valid is not None and valid.n >= 50:
        target = np.append(np.zeros(len(features)), 1.0)
        best = 0
        for at, beta in enumerate(ladder_steps(train, mean, sd, rounds, shrink)[1:], 1):
            now = valid.linear_corr(np.append(beta / sd, 0.0), target)
            if now > score:
                best, score = at, now
            if at - best > patience:
                break
        best = best or rounds // 2
    beta = ladder_steps(whole, mean, sd, best, shrink)[best]
    return dict(zip(features, beta.tolist())), best


def greedy_ols(df: DataFrame, features: list[str], y: str, gain: float = 1e-4, most: int = 48, fallback: int = 30) -> tuple[dict[str, float], float]:
    """(coefficients, intercept) of least squares on the features that, in the order given, each raise the correlation on the inner validation rows by more than `gain`.

    The first `most` are tried. Without 50 validation rows the first `fallback` are taken. The final fit is on all rows.
    """
    train, valid = inner_cells(df, features, y)
    kept, best = [], -1e9
    if train is not None and valid is not None and valid.n >= 50:
        for f in features[:most]:
            some = [*kept, f]
            beta, _ = ridge_of(train.pick([*some, y]), y, 1e-9)
            now = valid.pick([*some, y]).linear_corr(np.append(beta, 0.0), np.append(np.zeros(len(some)), 1.0))
            if now > best + gain:
                kept, best = some, now
    kept = kept or features[:fallback]
    whole = train if valid is None else valid if train is None else train + valid
    beta, intercept = ridge_of(whole.pick([*kept, y]), y, 1e-9)
    return dict(zip(kept, beta.tolist())), intercept


def nnls_of(c: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Non-negative least squares from correlations of the columns and with the target: active sets, the largest slope enters first."""
    active: list[int] = []
    w = np.zeros(len(cy))
    for _ in range(10 * len(cy)):
        slope = cy - c @ w
        free = [i for i in range(len(cy)) if i not in active and slope[i] > 1e-12]
        if not free:
            break
        active.append(max(free, key=lambda i: (slope[i], -i)))
        while True:
            fit = np.linalg.lstsq(c[np.ix_(active, active)], cy[active], rcond=None)[0]
            if (fit > 0).all():
                w = np.zeros(len(cy))
                w[active] = fit
                break
            step = min(w[i] / (w[i] - f) for i, f in zip(active, fit) if f <= 0)
            for i, f in zip(active, fit):
                w[i] += step * (f - w[i])
            active = [i for i in active if w[i] > 1e-12]
    return w


def nnls_weights(df: DataFrame, members: list[str], y: str) -> dict[str, float]:
    """Non-negative least squares of the scaled target on the scaled members, summing to 1; those of 1e-9 or less go."""
    _, _, _, c, cy, _ = standardised(df, members, y)
    w = nnls_of(c, cy)
    total = w.sum()
    return {m: float(x / total) for m, x in zip(members, w) if total > 0 and x / total > 1e-9}


def theil_sen(df: DataFrame, feature: str, y: str, step: int) -> DataFrame:
    """(pairs, slope): the median slope between every row and the one `step` rows on, by an equi-join on the row number."""
    other = df.select((F.col("row_idx") - step).alias("row_idx"), F.col(feature).alias("_x"), F.col(y).alias("_y"))
    both = df.join(other, "row_idx").filter(F.col("_x") != F.col(feature))
    return both.agg(F.count("*").alias("pairs"), F.percentile((F.col("_y") - F.col(y)) / (F.col("_x") - F.col(feature)), 0.5).alias("slope"))


def single_factor(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(feature, slope, intercept): the feature whose line, fitted before the last segment, does best on it, fitted again on all rows; ties by order."""
    last = df.agg(F.max("seg")).first()[0]
    old = F.col("seg") < last
    part = lambda f, cond: F.when(cond, F.col(f))
    stats = [x for i, f in enumerate(features) for x in (
        F.regr_slope(part(y, old), part(f, old)).alias(f"o{i}"), pearson(part(f, ~old), part(y, ~old)).alias(f"c{i}"), F.regr_slope(y, f).alias(f"s{i}"), F.regr_intercept(y, f).alias(f"b{i}"),
    )]
    rows = F.array(*[F.struct((F.signum(f"o{i}") * F.col(f"c{i}")).alias("score"), F.lit(-i).alias("turn"), F.lit(f).alias("feature"), F.col(f"s{i}").alias("slope"), F.col(f"b{i}").alias("intercept")) for i, f in enumerate(features)])
    return df.agg(*stats).select(F.array_max(rows).alias("r")).select("r.feature", "r.slope", "r.intercept")
