"""Blocked moments, communities, clusters, projections and stability selection against numpy on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import moments as mo
from tidemark.operators import topology as to


def wide(spark, n: int, d: int, seed: int = 0, parts: int = 5):
    """(frame, matrix): columns in families of four that move together, far from zero, with nulls and NaN."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, -(-d // 4)))
    x = np.repeat(base, 4, axis=1)[:, :d] * rng.uniform(0.5, 2, d) + rng.normal(size=(n, d)) * 0.4 + 1e6 * (np.arange(d) % 3)
    rows = [(i, int(i % 3), *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_idx long, seg int, " + ", ".join(f"c{j} double" for j in range(d))).repartition(parts), x, [f"c{j}" for j in range(d)]


def test_moments_equal_numpy_by_cell(spark):
    df, x, cols = wide(spark, 600, 70)  # two blocks
    cells = mo.collect_moments(df, cols, ("seg",))
    for s in range(3):
        part = x[s::3]
        m = cells[(s,)]
        assert m.n == len(part) and np.allclose(m.mean, part.mean(0), rtol=1e-12) and np.allclose(m.cov, np.cov(part.T, bias=True), rtol=1e-8, atol=1e-9)
    whole = mo.total(cells.values())
    assert np.allclose(whole.corr(), np.corrcoef(x.T), atol=1e-9)
    a, b = np.arange(70.0), np.cos(np.arange(70.0))
    assert np.isclose(whole.linear_corr(a, b), np.corrcoef(x @ a, x @ b)[0, 1], atol=1e-6)


def test_moments_far_from_zero_keep_their_digits(spark):
    x = 1e9 + np.random.default_rng(1).normal(size=(500, 2))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double")
    assert np.allclose(mo.moments(df, ["a", "b"]).cov, np.cov((x - 1e9).T, bias=True), rtol=1e-6)
    row = mo.moment_rows(df, ["a", "b"]).filter("i = 'a' and j = 'b'").first()
    assert np.isclose(row["cov"], np.cov((x - 1e9).T, bias=True)[0, 1], rtol=1e-5)


def test_moments_with_weights_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, [1.0, 0.0], "u"), (3.0, None, [2.0, 1.0], None), (5.0, float("nan"), [0.0, 3.0], None)], "a double, b double, w array<double>, k string")
    m = mo.collect_moments(df, ["a", "b"], weights="w")
    assert m[(0,)].n == 3 and np.isclose(m[(0,)].mean[0], 7 / 3) and m[(1,)].n == 4 and np.isclose(m[(1,)].mean[0], 4.5)
    assert set(mo.collect_moments(df, ["a"], ("k",))) == {("u",), (None,)} and {r["n"] for r in mo.moment_rows(df, ["a"], ("k",)).collect()} == {1.0, 2.0}
    assert mo.moments(df, ["b"]).mean[0] == 2.0  # nulls stand at the mean
    none = mo.moments(df.filter("a > 9"), ["a", "b"])
    assert none.n == 0 and (none.corr() == 0).all()


def test_eight_hundred_columns(spark):
    df, x, cols = wide(spark, 300, 800, parts=3)
    m = mo.moments(df, cols)
    assert np.allclose(m.corr(), np.corrcoef(x.T), atol=1e-8)
    got = {r["feature"]: r["community"] for r in to.feature_communities(df, cols, most=800).collect()}
    families = {}
    for f, c in got.items():
        families.setdefault(c, set()).add(int(f[1:]) // 4)
    assert len(families) >= 190 and sum(len(v) == 1 for v in families.values()) >= 180


def plain_leaders(x, order, threshold):
    c, groups = np.abs(np.corrcoef(x.T)), []
    for i in order:
        for g in groups:
            if c[i, g[0]] >= threshold:
                g.append(i)
                break
        else:
            groups.append([i])
    return groups, c


def test_communities_and_medoids_equal_a_plain_pass(spark):
    df, x, cols = wide(spark, 400, 24)
    groups, c = plain_leaders(x, np.argsort(-x.var(0))[:20], 0.6)
    rows = {r["feature"]: (r["community"], r["coherence"]) for r in to.feature_communities(df, cols, most=20).collect()}
    for k, g in enumerate(groups):
        inner = [c[i, j] for i in g for j in g if i != j]
        for i in g:
            assert rows[cols[i]][0] == k and np.isclose(rows[cols[i]][1], np.mean(inner) if inner else 0, atol=1e-9)
    assert sum(v == (-1, None) for v in rows.values()) == 4
    y = x[:, 2] + x[:, 9] - 1e6
    out = df.withColumn("y", F.col("c2") + F.col("c9") - 1e6)
    own = np.abs([np.corrcoef(x[:, i], y)[0, 1] for i in range(24)])
    order = np.argsort(-own)
    groups, c = plain_leaders(x, order, 0.6)
    best = [max(g, key=lambda i: c[i, g].sum()) for g in groups]
    assert to.rank_medoid(out, cols, "y") == [cols[i] for i in order if i in best]


def test_feature_clusters_are_k_means_on_rows(spark):
    df, x, cols = wide(spark, 300, 32)
    z = ((x - x.mean(0)) / x.std(0)).T
    starts = [0]
    while len(starts) < 8:
        starts.append(int(np.argmax(np.min([((z - z[s]) ** 2).sum(1) for s in starts], axis=0))))
    centres = z[starts]
    for _ in range(100):
        home = ((z[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([z[home == k].mean(0) if (home == k).any() else np.full(z.shape[1], np.inf) for k in range(8)])
    assert [r["cluster"] for r in to.feature_clusters(df, cols).orderBy("pos").collect()] == home.tolist()


def test_projections_equal_svd(spark):
    df, x, cols = wide(spark, 500, 12)
    x = x - x.mean(0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    out = np.array([[r[f"pc_{i}"] for i in range(3)] for r in to.tf_pca(df, cols, 3).orderBy("row_idx").collect()])
    assert np.allclose(np.abs(out), np.abs(x @ vt[:3].T), atol=1e-5)
    same, names = to.tf_foveated(df.withColumn("y", F.col("c0")), cols[:8], "y")
    assert names == [] and same.columns == [*df.columns, "y"]
    blurred, names = to.tf_foveated(df.withColumn("y", F.col("c11")), cols, "y", sharp=2, ring=6, parts=2)
    assert names == ["ring_0", "ring_1", "rest"] and blurred.select("ring_0").distinct().count() <= 256
    w = np.array([np.corrcoef(x[:, i], x[:, 11])[0, 1] for i in range(8, 12)])
    want = (x[:, 8:] / (x[:, 8:].std(0) + 1e-6)) @ (w / np.abs(w).sum())
    assert np.allclose([r["rest"] for r in blurred.orderBy("row_idx").collect()], want, atol=1e-4)


@pytest.mark.parametrize("alpha", [0.001, 0.05, 0.5])
def test_lasso_satisfies_its_optimality_conditions(alpha):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 15)) @ rng.normal(size=(15, 15))
    x = (x - x.mean(0)) / x.std(0)
    y = x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=400)
    c, cy = x.T @ x / 400, x.T @ (y - y.mean()) / 400
    b = to.lasso(c, cy, alpha, rounds=5000)
    slope = cy - c @ b
    on = np.abs(b) > 1e-8
    assert np.allclose(slope[on], alpha * np.sign(b[on]), atol=1e-6) and (np.abs(slope[~on]) <= alpha + 1e-6).all()


def test_stability_selection_equals_resampled_rows(spark):
    df, x, cols = wide(spark, 400, 10)
    y = x[:, 1] + 0.3 * np.random.default_rng(3).normal(size=400)
    df = df.join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row_idx long, y double"), "row_idx")
    w = np.array([r["w"] for r in df.withColumn("w", to.poisson_draws("row_idx", 4, 7)).orderBy("row_idx").collect()])
    assert abs(w.mean() - 1) < 0.1 and abs(w.var() - 1) < 0.25 and w.max() >= 3
    own = np.abs([np.corrcoef(x[:, i], y)[0, 1] for i in range(10)])
    some = np.argsort(-own, kind="stable")[:6]
    z, times = (x - x.mean(0)) / (x.std(0) + 1e-9), np.zeros(6)
    for b in range(4):
        rows = np.repeat(np.arange(400), w[:, b].astype(int))
        at = to.half_of(6, b, 7)
        part, target = z[np.ix_(rows, some[at])], y[rows]
        part, target = part - part.mean(0), target - target.mean()
        times[at] += np.abs(to.lasso(part.T @ part / len(rows), part.T @ target / len(rows), 0.001)) > 1e-8
    got = {r["feature"]: r["score"] for r in to.rank_stabsel(df, cols, "y", "row_idx", draws=4, pool=6).collect()}
    for i, t in zip(some, times):
        assert got[cols[i]] == t / 4
    rest = [i for i in range(10) if i not in some]
    assert all(np.isclose(got[cols[i]], own[i] - 1, atol=1e-9) for i in rest)
