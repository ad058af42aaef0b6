"""How columns relate to each other: communities, clusters, medoids and projections, all from one table of moments.

One scan gives the columns' moments (columns squared numbers); what follows is order-dependent or iterative over those and
runs on the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import pearson
from tidemark.operators.arrow import arrow_map, matrix
from tidemark.operators.features import per_feature
from tidemark.operators.moments import Moments, collect_moments, moments


def leaders(corr: np.ndarray, order: list[int], threshold: float) -> list[list[int]]:
    """Groups in one pass over `order`: a column joins the first group whose first member it matches with |corr| >= threshold, or founds one."""
    groups: list[list[int]] = []
    for i in order:
        home = next((g for g in groups if abs(corr[i, g[0]]) >= threshold), None)
        if home is None:
            groups.append([i])
        else:
            home.append(i)
    return groups


def coherence(corr: np.ndarray, group: list[int]) -> float:
    """The mean |corr| between different members; 0 for a single one."""
    n = len(group)
    return float((np.abs(corr[np.ix_(group, group)]).sum() - np.abs(corr[group, group]).sum()) / (n * (n - 1))) if n > 1 else 0.0


def feature_communities(df: DataFrame, columns: list[str], threshold: float = 0.6, most: int = 400) -> DataFrame:
    """(feature, pos, community, coherence): leader groups of the `most` columns with the largest variance, widest first; -1 and null for the rest."""
    m = moments(df, columns)
    var, corr = np.diag(m.cov), m.corr()
    order = sorted(range(len(columns)), key=lambda i: (-var[i], i))[:most]
    groups = leaders(corr, order, threshold)
    home = {i: (c, coherence(corr, g)) for c, g in enumerate(groups) for i in g}
    rows = [(f, i, *home.get(i, (-1, None))) for i, f in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, pos int, community int, coherence double")


def feature_clusters(df: DataFrame, columns: list[str], k: int = 8, rounds: int = 100) -> DataFrame:
    """(feature, pos, cluster): k-means with the columns as points, each standardised and seen as the vector of its rows.

    Squared distances between columns are 2n(1 - corr), and those to a mean of columns follow from the correlations among its members,
    so no row is read for them. At most max(2, columns / 4) clusters; they start at the first column and then at the one
    farthest from all starts. Ties: the smaller number.
    """
    corr = moments(df, columns).corr()
    np.fill_diagonal(corr, 1.0)
    d = len(columns)
    k = min(k, max(2, d // 4), d)
    starts = [0]
    while len(starts) < k:
        near = corr[:, starts].max(axis=1)
        near[starts] = np.inf
        starts.append(int(near.argmin()))
    cluster = corr[:, starts].argmax(axis=1)
    cluster[starts] = range(k)
    for _ in range(rounds):
        far = np.full((d, k), np.inf)
        for c in range(k):
            mine = np.flatnonzero(cluster == c)
            if len(mine):
                far[:, c] = corr[np.ix_(mine, mine)].mean() - 2 * corr[:, mine].mean(axis=1)
        new = far.round(12).argmin(axis=1)
        if (new == cluster).all():
            break
        cluster = new
    return df.sparkSession.createDataFrame([(f, i, int(cluster[i])) for i, f in enumerate(columns)], "feature string, pos int, cluster int")


def rank_medoid(df: DataFrame, columns: list[str], y: str, threshold: float = 0.6, most: int = 300) -> list[str]:
    """Leader groups over the `most` columns with the largest |corr| with y, in that order; of each group the member with the largest sum of |corr| with its group.

    With fewer than three columns all stay.
    """
    c = moments(df, [*columns, y]).corr()
    own, corr = np.abs(c[:-1, -1]), c[:-1, :-1].copy()
    np.fill_diagonal(corr, 1.0)
    order = sorted(range(len(columns)), key=lambda i: (-own[i], i))[:most]
    if len(order) < 3:
        return [columns[i] for i in order]
    place = {f: p for p, f in enumerate(order)}
    best = [max(g, key=lambda i: (round(float(np.abs(corr[i, g]).sum()), 12), -place[i])) for g in leaders(corr, order, threshold)]
    return [columns[i] for i in sorted(best, key=place.get)]


def feature_topology_report(df: DataFrame, communities: DataFrame, shift: DataFrame, y: str) -> DataFrame:
    """One row per community: (community, size, coherence, mean_abs_corr, max_abs_corr, consensus, mean_shift).

    consensus: |mean corr with y| over the mean |corr|, 1 where all members point the same way. communities: (feature, community,
    coherence); shift: (feature, shift); columns of no community are left out.
    """
    some = communities.filter("community >= 0")
    features = [r["feature"] for r in some.select("feature").orderBy("feature").collect()]
    c = per_feature(df, features, {"c": lambda f: pearson(f, y)}).select("feature", "c")
    size = F.abs(F.avg("c")) / (F.avg(F.abs("c")) + 1e-9)
    return some.join(c, "feature").join(shift.select("feature", "shift"), "feature", "left").groupBy("community").agg(
        F.count("*").alias("size"), F.first("coherence").alias("coherence"), F.avg(F.abs("c")).alias("mean_abs_corr"), F.max(F.abs("c")).alias("max_abs_corr"), size.alias("consensus"), F.avg("shift").alias("mean_shift")
    )


# --- projections


def components(m: Moments, parts: int) -> np.ndarray:
    """(parts, columns): the principal directions of the moments, widest first, each with its largest loading positive."""
    values, axes = np.linalg.eigh(m.cov)
    top = axes[:, np.argsort(-values, kind="stable")[:parts]].T
    return top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]


def projected(df: DataFrame, columns: list[str], mean: np.ndarray, weights: np.ndarray, names: list[str]) -> DataFrame:
    """Adds (x - mean) times each row of `weights`, as columns: by Arrow batches, as wide sums are too long for expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = (matrix(b, columns) - mean) @ weights.T
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(out[:, i]) for i in range(len(names))]], [*b.schema.names, *names])

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return arrow_map(df, run, schema)


def tf_pca(df: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Adds `pc_0`, `pc_1`, ...: the rows on the columns' principal directions (of their covariance, without scaling)."""
    m = moments(df, columns)
    w = components(m, min(parts, len(columns)))
    return projected(df, columns, m.mean, w, [f"pc_{i}" for i in range(len(w))])


def tf_pca_aug(df: DataFrame, columns: list[str], parts: int = 8) -> DataFrame:
    """The columns stay, with the first `parts` components beside them."""
    return tf_pca(df, columns, parts)


def tf_foveated(df: DataFrame, columns: list[str], y: str, sharp: int = 8, ring: int = 64, parts: int = 4, levels: int = 255) -> tuple[DataFrame, list[str]]:
    """(rows, new columns): the first `sharp` columns as they are, the next `ring` as `parts` components in `levels` + 1 steps between their
    0.5 % and 99.5 % quantiles, and what is left as one column `rest`, z-scores weighted by their correlation with y.

    With no more than `sharp` columns, or fewer than two in the ring, there is nothing to blur and no new column.
    """
    near, far = columns[sharp : sharp + ring], columns[sharp + ring :]
    if len(near) < 2:
        return df, []
    m = moments(df, [*near, *far, y])
    own = m.pick(near)
    names = [f"ring_{i}" for i in range(min(parts, len(near)))]
    out = projected(df, near, own.mean, components(own, len(names)), names)
    edges = out.agg(*[F.percentile(n, F.array(F.lit(0.005), F.lit(0.995))).alias(n) for n in names]).first()
    for n in names:
        low, high = edges[n]
        span = max(high - low, 1e-6)
        code = F.greatest(F.lit(0.0), F.least(F.lit(float(levels)), F.bround((F.col(n) - low) / span * levels)))
        out = out.withColumn(n, code / levels * span + low)
    if far:
        at = [m.columns.index(c) for c in far]
        weights = m.corr()[at, -1]
        if np.abs(weights).sum() > 1e-12:
            weights = weights / np.abs(weights).sum()
            out = projected(out, far, m.mean[at], (weights / (m.sd[at] + 1e-6))[None, :], ["rest"])
            names.append("rest")
    return out, names


# --- stability selection


def lasso(corr: np.ndarray, with_y: np.ndarray, alpha: float, rounds: int = 300, close: float = 1e-9) -> np.ndarray:
    """Coordinate descent for 1/2 b'Cb - c'b + alpha |b|_1: the lasso, from second moments alone."""
    b = np.zeros(len(with_y))
    for _ in range(rounds):
        most = 0.0
        for j in range(len(b)):
            if corr[j, j] <= 0:
                continue
            left = with_y[j] - corr[j] @ b + corr[j, j] * b[j]
            new = np.sign(left) * max(abs(left) - alpha, 0.0) / corr[j, j]
            most, b[j] = max(most, abs(new - b[j])), new
        if most < close:
            break
    return b


def poisson_draws(key: str, draws: int, seed: int):
    """An array column of `draws` Poisson(1) counts, drawn by a hash of the key: the resampling weights of a row, the same on every run."""
    steps = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(9)])
    unit = lambda b: (F.xxhash64(F.col(key), F.lit(seed), F.lit(b)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52))
    count = lambda u: sum((F.when(u >= float(s), 1.0).otherwise(0.0) for s in steps), F.lit(0.0))
    return F.array(*[count(unit(b)) for b in range(draws)])


def half_of(columns: int, draw: int, seed: int) -> list[int]:
    """The columns of a draw: half of them (two at least), seeded."""
    return sorted(np.random.default_rng([seed, draw]).choice(columns, size=min(columns, max(2, columns // 2)), replace=False).tolist())


def rank_stabsel(df: DataFrame, columns: list[str], y: str, key: str, draws: int = 12, pool: int = 256, alpha: float = 0.001, seed: int = 7) -> DataFrame:
    """(feature, pos, score): how often a column survives the lasso over `draws` resamples with half the columns each.

    The `pool` columns with the largest |corr| take part; the others follow by |corr|, less 1. All resamples are draws of one scan:
    a row's weights are Poisson counts by a hash of `key`. Columns are standardised and y is centred over all rows, as the penalty expects.
    """
    every = moments(df, [*columns, y])
    own = np.abs(every.corr()[:-1, -1])
    order = sorted(range(len(columns)), key=lambda i: (-own[i], i))
    some = [columns[i] for i in order[:pool]]
    cells = collect_moments(df.withColumn("_draws", poisson_draws(key, draws, seed)), [*some, y], weights="_draws")
    sd = every.pick(some).sd + 1e-9
    times = np.zeros(len(some))
    for b in range(draws):
        m, at = cells.get((b,)), half_of(len(some), b, seed)
        if m is None:
            continue
        c, cy = m.cov[:-1, :-1] / np.outer(sd, sd), m.cov[:-1, -1] / sd
        times[at] += np.abs(lasso(c[np.ix_(at, at)], cy[at], alpha)) > 1e-8
    score = {f: float(t / draws) for f, t in zip(some, times)}
    return df.sparkSession.createDataFrame([(f, i, score.get(f, float(own[i]) - 1)) for i, f in enumerate(columns)], "feature string, pos int, score double")
