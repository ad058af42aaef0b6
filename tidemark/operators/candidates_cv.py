"""Candidates (a ranker, a transform and a linear model) judged on folds, without fitting on a row twice.

Everything a candidate learns on a fold - which columns, which projection, which coefficients - comes from the moments of that fold's training cells,
and what it scores on held-out cells follows from theirs. One scan serves all candidates and all folds of both geometries: leave-segments-out and
walk-forward. Predictions are made in one more scan, for those who want them, as rows (candidate, row).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.assess import ERA, Cells, fold_cells
from tidemark.operators.bayes import ard, bayes_ridge
from tidemark.operators.linear import ridge_of
from tidemark.operators.moments import Moments, total
from tidemark.operators.topology import components, leaders

# The noise of the stability probe, what is charged for more than is tolerated, and the overfit that is too much.
NOISE, TOLERATED, CHARGE, OVERFIT = 0.05, 0.35, 0.05, 6.0
RANKERS = ("top", "stable", "sign_stability", "decor", "medoid")
TRANSFORMS = ("identity", "pca", "rand_proj")
MODELS = ("ols", "ridge", "bayes_ridge", "ard")


@dataclass(frozen=True)
class Candidate:
    ranker: str = "top"
    k: int = 32
    transform: str = "identity"
    model: str = "ridge"
    alpha: float = 10.0
    parts: int = 8
    seed: int = 7

    @property
    def name(self) -> str:
        return f"{self.model}|{self.ranker}{self.k}|{self.transform}"


def own_corrs(m: Moments, y: str) -> np.ndarray:
    """Correlations of the features with y."""
    at = m.columns.index(y)
    return np.delete(m.corr()[:, at], at)


def by_segment(cells: dict[tuple, Moments], y: str) -> np.ndarray:
    """(segments, features): correlations with y, 0 in segments with few rows."""
    out = []
    for s in sorted({k[0] for k in cells}):
        m = total(v for k, v in cells.items() if k[0] == s)
        out.append(own_corrs(m, y) if m.n >= ERA else np.zeros(len(m.columns) - 1))
    return np.array(out)


def ranked_columns(ranker: str, cells: dict[tuple, Moments], features: list[str], y: str, k: int) -> list[str]:
    """The k best columns by a ranker that sees the cells only; ties by order."""
    m = total(cells.values())
    own = np.abs(own_corrs(m, y))
    score = own
    if ranker in ("stable", "sign_stability"):
        per = by_segment(cells, y)
        if ranker == "stable" and len(per) > 1:
            score = np.abs(per.mean(axis=0)) - per.std(axis=0)
        elif ranker == "sign_stability":
            other = (np.sign(per) != np.sign(own_corrs(m, y))[None]).mean(axis=0)
            score = own - (other > 0.25)
    elif ranker not in RANKERS:
        raise ValueError(f"no ranker {ranker!r}")
    order = sorted(range(len(features)), key=lambda i: (-score[i], i))
    if ranker in ("decor", "medoid"):
        corr = np.abs(m.pick(features).corr())
        np.fill_diagonal(corr, 1.0)
        if ranker == "decor":
            kept: list[int] = []
            for i in order:
                if all(corr[i, j] < 0.9 for j in kept):
                    kept.append(i)
            order = kept
        else:
            order = sorted((max(g, key=lambda i: corr[i, g].sum()) for g in leaders(corr, order, 0.6)), key=order.index)
    return [features[i] for i in order[:k]]


def build_viewport(c: Candidate, cells: dict[tuple, Moments], features: list[str], y: str) -> tuple[list[str], np.ndarray]:
    """(columns, weights (views, columns)): what the candidate looks at, learnt from the cells only. Views are weighted sums of the columns."""
    some = ranked_columns(c.ranker, cells, features, y, c.k)
    if c.transform == "identity" or len(some) < 2:
        return some, np.eye(len(some))
    parts = min(c.parts, len(some))
    if c.transform == "pca":
        return some, components(total(cells.values()).pick(some), parts)
    if c.transform == "rand_proj":
        return some, np.random.default_rng(c.seed).normal(size=(len(some), parts)).T / np.sqrt(parts)
    raise ValueError(f"no transform {c.transform!r}")


def seen_through(m: Moments, some: list[str], weights: np.ndarray, y: str) -> Moments:
    """The moments of the views and y."""
    own = m.pick([*some, y])
    w = np.zeros((len(weights) + 1, len(some) + 1))
    w[:-1, :-1], w[-1, -1] = weights, 1.0
    names = [f"view_{i}" for i in range(len(weights))] + [y]
    return Moments(names, w @ own.shift, own.n, w @ own.s, w @ own.x @ w.T)


def fit(c: Candidate, cells: dict[tuple, Moments], features: list[str], y: str) -> tuple[np.ndarray, float, list[str]]:
    """(weights of the features and y, intercept, columns used): the candidate fitted on the cells."""
    some, weights = build_viewport(c, cells, features, y)
    m = seen_through(total(cells.values()), some, weights, y)
    if c.model in ("ridge", "ols"):
        beta, intercept = ridge_of(m, y, c.alpha if c.model == "ridge" else 1e-9)
    elif c.model in ("bayes_ridge", "ard"):
        found = (bayes_ridge if c.model == "bayes_ridge" else ard)(m, y)
        beta, intercept = found.beta, found.intercept
    else:
        raise ValueError(f"no model {c.model!r}")
    form = np.zeros(len(features) + 1)
    form[[features.index(f) for f in some]] = beta @ weights
    return form, intercept, some


def pooled(parts: list[tuple[Moments, np.ndarray, float, np.ndarray, float]]) -> float:
    """The correlation of two predictions over several sets of rows, each set with its own linear forms (a, its intercept, b, its intercept)."""
    n = sa = sb = saa = sab = sbb = 0.0
    for m, a, a0, b, b0 in parts:
        a0, b0 = a0 + float(a @ m.shift), b0 + float(b @ m.shift)
        pa, pb = float(a @ m.s), float(b @ m.s)
        n, sa, sb = n + m.n, sa + pa + m.n * a0, sb + pb + m.n * b0
        saa += float(a @ m.x @ a) + 2 * a0 * pa + m.n * a0 * a0
        sbb += float(b @ m.x @ b) + 2 * b0 * pb + m.n * b0 * b0
        sab += float(a @ m.x @ b) + a0 * pb + b0 * pa + m.n * a0 * b0
    if n < 3:
        return 0.0
    va, vb = saa / n - (sa / n) ** 2, sbb / n - (sb / n) ** 2
    return float((sab / n - sa / n * sb / n) / np.sqrt(va * vb)) if va > 1e-24 and vb > 1e-24 else 0.0


def width_of(scores: list[float], charge: float = 0.0) -> float:
    return float(np.mean(scores) - np.std(scores) + min(0.0, min(scores)) - charge) if scores else 0.0


def forward_folds(c: Cells, folds: int, least: int = 200) -> list[tuple[int, dict, dict]]:
    """(segment, training cells, its cells) for the last segments: all rows whose reach ends before it, if they are more than `least`."""
    segs = sorted(c.folds)
    out = []
    for s in segs[-min(folds, max(0, len(segs) - 2)) :] if len(segs) > 2 else []:
        train = {k: m for k, m in c.cells.items() if k[2] < s}
        if train and sum(m.n for m in train.values()) > least:
            out.append((s, train, {k: m for k, m in c.cells.items() if k[0] == s}))
    return out


REPORT = (
    "candidate string, oof_corr double, era_corr double, width double, wf_corr double, wf_width double, stability double, fit_corr double, overfit_ratio double, uniqueness double, "
    "fold_corrs array<double>, wf_fold_corrs array<double>, used array<string>, decision string, reasons string"
)


def evaluate_candidates(df: DataFrame, candidates: list[Candidate], features: list[str], y: str, *, n_segments: int = 12, n_folds: int = 5, wf_folds: int = 4, embargo: int = 720) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(report with a row per candidate (see REPORT), a function that makes the out-of-fold predictions (candidate, row_idx, pred)).

    df has row_idx, n_rows and seg (of n_segments). Uniqueness is 1 less the largest |correlation| with the out-of-fold predictions of the candidates before. The
    stability is what noise of 5 % of each column's deviation would move predictions by, on average over the folds, in deviations of those.
    """
    c = fold_cells(df, features, y, n_segments=n_segments, n_folds=n_folds, embargo=embargo)
    target = np.append(np.zeros(len(features)), 1.0)
    folds = sorted(set(c.folds.values()))
    every = total(c.cells.values())
    library: list[dict[int, tuple[np.ndarray, float]]] = []
    rows = []
    for cand in candidates:
        fits, scores, moved = {}, [], []
        for f in folds:
            train, held = c.train(f), c.valid(f)
            form, intercept, _ = fit(cand, train, features, y) if train else (np.zeros(len(features) + 1), 0.0, [])
            fits[f] = (form, intercept)
            m = total(held.values())
            scores.append(m.linear_corr(form, target))
            spread = float(np.sqrt(max(form @ m.cov @ form, 0.0)))
            moved.append(float(np.sqrt(((NOISE * m.sd * form) ** 2).sum())) / (spread + 1e-12))
        oof = lambda some: [(m, *fits[c.folds[k[0]]], target, 0.0) for k, m in some.items()]  # noqa: B023, E731
        oof_corr = pooled(oof(c.cells))
        eras = [pooled(oof({k: m for k, m in c.cells.items() if k[0] == s})) for s in sorted(c.folds) if sum(m.n for k, m in c.cells.items() if k[0] == s) >= ERA]
        wf, ahead = [], []
        for _, train, held in forward_folds(c, wf_folds):
            form, intercept, _ = fit(cand, train, features, y)
            m = total(held.values())
            wf.append(m.linear_corr(form, target))
            ahead.append((m, form, intercept, target, 0.0))
        covered = sum(p[0].n for p in ahead)
        wf_corr = (pooled(ahead) if covered >= 100 else float(np.mean(wf))) if wf else oof_corr
        stability = float(np.mean(moved))
        width = width_of(scores, CHARGE * max(0.0, stability - TOLERATED))
        wf_width = width_of(wf) if wf else width_of(scores)
        form, _, used = fit(cand, c.cells, features, y)
        fit_corr = every.linear_corr(form, target)
        overfit = fit_corr / max(oof_corr, 1e-6) if oof_corr > 0 else float("inf")
        like = [abs(pooled([(m, *fits[c.folds[k[0]]], *other[c.folds[k[0]]]) for k, m in c.cells.items()])) for other in library]
        library.append(fits)
        reasons = [r for r, bad in (("no_honest_correlation", oof_corr <= 0), ("narrow_or_negative_width", width <= 0), ("negative_walk_forward_width", bool(wf) and wf_width <= 0), ("overpowering_fit_vs_cv", overfit > OVERFIT)) if bad]
        decision = "promote" if not reasons else "expand" if oof_corr > 0 else "reject"
        rows.append((cand.name, oof_corr, float(np.mean(eras)) if eras else 0.0, width, wf_corr, wf_width, stability, fit_corr, min(overfit, 999.0), max(0.0, 1 - max(like, default=0.0)), scores, wf, used, decision, "|".join(reasons)))

    def predictions() -> DataFrame:
        fold = F.create_map(*[F.lit(int(x)) for s, f in c.folds.items() for x in (s, f)])[F.col("seg")]
        made = []
        for cand, fits in zip(candidates, library):
            value = F.lit(None).cast("double")
            for f, (form, intercept) in fits.items():
                on = [(n, w) for n, w in zip(features, form) if w]
                value = F.when(fold == f, sum((F.col(n) * float(w) for n, w in on), F.lit(float(intercept)))).otherwise(value)
            made.append(F.struct(F.lit(cand.name).alias("candidate"), value.alias("pred")))
        return df.select("row_idx", F.explode(F.array(*made)).alias("r")).select("r.candidate", "row_idx", "r.pred")

    return df.sparkSession.createDataFrame(rows, REPORT), predictions


def final_refit(df: DataFrame, candidate: Candidate, features: list[str], y: str, new: DataFrame, key: str) -> DataFrame:
    """(key, pred) of the rows of `new`: the candidate fitted on all rows of df."""
    from tidemark.operators.moments import moments

    form, intercept, used = fit(candidate, {(0, 0, 0, None): moments(df, [*features, y])}, features, y)
    return new.select(key, sum((F.col(f) * float(form[features.index(f)]) for f in used), F.lit(float(intercept))).alias("pred"))
