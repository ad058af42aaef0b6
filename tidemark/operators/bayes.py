"""Linear models whose penalties the data choose, and a chain of ridges through time: rows are read once for moments, the rest is algebra of the columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.moments import Moments, collect_moments, moments, total

#: Parameters of the vague gamma priors over the precisions.
VAGUE = 1e-6


@dataclass
class Fitted:
    """Coefficients in the columns' own units; `facts` are what the fit chose."""

    features: list[str]
    beta: np.ndarray
    intercept: float
    facts: dict[str, float]

    def predict(self):
        return sum((F.col(f) * float(b) for f, b in zip(self.features, self.beta)), F.lit(float(self.intercept)))


def scaled(m: Moments, y: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(features, deviations, Z'Z, Z'y, y'y, mean of y) of columns standardised and the target centred."""
    at = [i for i, c in enumerate(m.columns) if c != y]
    k = m.columns.index(y)
    cov = m.cov
    sd = np.sqrt(np.maximum(np.diag(cov)[at], 0))
    sd = np.where(sd > 1e-12, sd, 1.0)  # a constant column stays a column of zeros
    return [m.columns[i] for i in at], sd, m.n * cov[np.ix_(at, at)] / np.outer(sd, sd), m.n * cov[at, k] / sd, float(m.n * cov[k, k]), float(m.mean[k])


def own_units(m: Moments, y: str, features: list[str], sd: np.ndarray, w: np.ndarray, facts: dict[str, float]) -> Fitted:
    beta = w / sd
    mean = np.array([m.mean[m.columns.index(f)] for f in features])
    return Fitted(features, beta, float(m.mean[m.columns.index(y)] - beta @ mean), facts)


def bayes_ridge(m: Moments, y: str, rounds: int = 300, close: float = 1e-3) -> Fitted:
    """Ridge whose noise and weight precisions maximise the evidence, by fixed-point steps on the eigenvalues of Z'Z.

    Stops when the coefficients move by less than `close` in sum.
    """
    features, sd, zz, zy, yy, _ = scaled(m, y)
    values, axes = np.linalg.eigh(zz)
    values, turned = np.maximum(values, 0), axes.T @ zy
    noise, weight, w = 1 / (yy / m.n + 1e-300), 1.0, np.zeros(len(features))
    at = lambda noise, weight: axes @ (turned / (values + weight / noise))
    steps = 0
    for steps in range(1, rounds + 1):
        new = at(noise, weight)
        left = max(yy - 2 * new @ zy + new @ zz @ new, 0.0)
        gamma = float((noise * values / (weight + noise * values)).sum())
        weight = (gamma + 2 * VAGUE) / (float(new @ new) + 2 * VAGUE)
        noise = (m.n - gamma + 2 * VAGUE) / (left + 2 * VAGUE)
        moved, w = float(np.abs(new - w).sum()), new
        if steps > 1 and moved < close:
            break
    w = at(noise, weight)
    return own_units(m, y, features, sd, w, {"noise": float(noise), "weight": float(weight), "steps": float(steps)})


def ard(m: Moments, y: str, rounds: int = 300, close: float = 1e-3, prune: float = 1e4) -> Fitted:
    """Sparse Bayesian regression: a precision for every column; columns whose precision reaches `prune` are dropped for good."""
    features, sd, zz, zy, yy, _ = scaled(m, y)
    noise, own, w = 1 / (yy / m.n + 1e-300), np.ones(len(features)), np.zeros(len(features))
    keep = np.ones(len(features), bool)

    def solved() -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(keep)
        spread = np.linalg.inv(np.diag(own[at]) + noise * zz[np.ix_(at, at)])
        new = np.zeros(len(features))
        new[at] = noise * spread @ zy[at]
        return new, np.diag(spread)

    for _ in range(rounds):
        if not keep.any():
            break
        new, spread = solved()
        left = max(yy - 2 * new @ zy + new @ zz @ new, 0.0)
        gamma = 1 - own[keep] * spread
        own[keep] = (gamma + 2 * VAGUE) / (new[keep] ** 2 + 2 * VAGUE)
        noise = (m.n - gamma.sum() + 2 * VAGUE) / (left + 2 * VAGUE)
        keep &= own < prune
        new[~keep] = 0.0
        moved, w = float(np.abs(new - w).sum()), new
        if moved < close:
            break
    w = solved()[0] if keep.any() else np.zeros(len(features))
    return own_units(m, y, features, sd, w, {"kept": float(keep.sum()), "noise": float(noise)})


def fit_bayes_ridge(df: DataFrame, features: list[str], y: str) -> Fitted:
    return bayes_ridge(moments(df, [*features, y]), y)


def fit_ard(df: DataFrame, features: list[str], y: str) -> Fitted:
    """On all rows: the moments are all it needs."""
    return ard(moments(df, [*features, y]), y)


def inner_valid(df: DataFrame, last: int, on_last: int, n: int):
    """The inner validation rows: the last segment if it holds 50 rows and no more than 0.6 of all, else every fourth row."""
    return F.col("seg") == last if 50 <= on_last <= 0.6 * n else F.col("row_idx") % 4 == 0


def fit_relay(df: DataFrame, features: list[str], y: str, taus: tuple[float, ...] = (0.25, 1.0, 4.0), least: int = 50) -> Fitted:
    """A ridge per segment, each drawn to the one before; the last one predicts.

    A segment of n rows has penalty n / 2, and the pull to the segment before is that times tau, chosen by the inner validation rows.
    Columns are standardised over all rows, the target is not centred; segments with fewer than `least` rows are passed over.
    """
    sizes = {r["seg"]: r["n"] for r in df.groupBy("seg").agg(F.count("*").alias("n")).collect()}
    last = max(sizes)
    cells = collect_moments(df.withColumn("_valid", inner_valid(df, last, sizes[last], sum(sizes.values()))), [*features, y], ("seg", "_valid"))
    every = total(cells.values())
    k = len(features)
    mean, sd = every.mean[:k], every.sd[:k] + 1e-6

    def about(m: Moments) -> tuple[np.ndarray, np.ndarray]:
        """(Z'Z, Z'y): columns about their overall mean and in deviations, y as it is."""
        x = m.about(np.append(mean, 0.0))
        return x[:k, :k] / np.outer(sd, sd), x[:k, k] / sd

    def chain(parts: dict[int, Moments], tau: float) -> np.ndarray:
        w, first = np.zeros(k), True
        for s in sorted(parts):
            m = parts[s]
            if m.n < least:
                continue
            zz, zy = about(m)
            own = 0.5 * m.n
            pull = 0.0 if first else tau * own
            w, first = np.linalg.solve(zz + (own + pull) * np.eye(k), zy + pull * w), False
        return w

    by_seg = lambda rows: {s: total(m for c, m in rows.items() if c[0] == s) for s in {c[0] for c in rows}}
    valid = total(m for c, m in cells.items() if c[1])
    train = by_seg({c: m for c, m in cells.items() if not c[1]})
    tau, best = taus[0], -1e9
    if valid is not None and valid.n >= 50:
        for t in taus:
            form = np.append(chain(train, t) / sd, 0.0)
            score = valid.linear_corr(form, np.append(np.zeros(k), 1.0))
            if score > best:
                tau, best = t, score
    w = chain(by_seg(cells), tau)
    return Fitted(list(features), w / sd, float(-(w / sd) @ mean), {"tau": float(tau)})


def support_sheaf(df: DataFrame, features: list[str], y: str, terrain: str, *, top: int = 40, least: int = 300, alpha: float = 10.0) -> DataFrame:
    """(home, applied, own_corr, foreign_corr, defect): how a terrain's own ridge fares on its rows, and the ridge of another terrain.

    Ridges on the `top` columns by |corr|, standardised inside the terrain they are fitted on and over all rows where they are applied. The correlation of a linear form with the target inside a
    terrain follows from that terrain's moments, so no prediction is made. Terrains with fewer than `least` rows are left out.
    """
    cells = {c[0]: m for c, m in collect_moments(df, [*features, y], (terrain,)).items() if c[0] is not None}
    rows = []
    if cells:
        every = total(cells.values())
        own = np.abs(every.corr()[:-1, -1])
        some = [features[i] for i in sorted(range(len(features)), key=lambda i: (-own[i], i))[:top]]
        sd = every.pick(some).sd + 1e-9
        target = np.append(np.zeros(len(some)), 1.0)
        big = {t: m.pick([*some, y]) for t, m in sorted(cells.items()) if m.n >= least}
        forms = {}
        for t, m in big.items():
            c, home = m.cov, m.sd[:-1] + 1e-9
            forms[t] = np.append(np.linalg.solve(m.n * c[:-1, :-1] / np.outer(home, home) + alpha * np.eye(len(some)), m.n * c[:-1, -1] / home) / sd, 0.0)
        rows = [(int(a), int(b), m.linear_corr(forms[a], target), m.linear_corr(forms[b], target)) for a, m in big.items() for b in big if a != b]
    out = df.sparkSession.createDataFrame([(a, b, float(o), float(f), float(o - f)) for a, b, o, f in rows], "home int, applied int, own_corr double, foreign_corr double, defect double")
    return out.orderBy(F.desc("defect"), "home", "applied")
