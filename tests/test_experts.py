"""Models of several ridges and suspect rows against plain numpy on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import experts as ex

N, COLS = 900, ["a", "b", "c"]
SCHEMA = "id long, row_idx long, t int, a double, b double, c double, y double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, 3)) + np.array([0, 1e6, 2])
    t = np.where(np.arange(N) < 30, 2, np.arange(N) % 2)
    y = x[:, 0] * np.where(t == 1, 2, -1) + 0.3 * (x[:, 1] - 1e6) * rng.normal(size=N) + rng.normal(size=N)
    return x, t, y


@pytest.fixture(scope="module")
def df(spark, rows):
    x, t, y = rows
    return spark.createDataFrame([(i, i, int(t[i]), *map(float, x[i]), float(y[i])) for i in range(N)], SCHEMA).repartition(3).cache()


def ridge(x, y, alphas=ex.ALPHAS):
    """The penalty of the smallest leave-one-out error, by leaving every row out, and its prediction function."""
    sd, mean, my = x.std(axis=0), x.mean(axis=0), y.mean()
    z, best = (x - mean) / sd, None
    for a in alphas:
        inv = np.linalg.inv(z.T @ z + a * np.eye(x.shape[1]))
        h = 1 / len(x) + np.einsum("ij,jk,ik->i", z, inv, z)
        w = inv @ z.T @ (y - my)
        error = (((y - my - z @ w) / (1 - h)) ** 2).mean()
        if best is None or error < best[0]:
            best = error, a, w
    return best[1], lambda q: my + (q - mean) / sd @ best[2]


def predicted(df, pred):
    return np.array([r[0] for r in df.select("id", pred.alias("p")).orderBy("id").select("p").collect()])


def test_left_out_errors_are_those_of_leaving_a_row_out(rows):
    from tidemark.operators.moments import Moments

    x, _, y = rows
    every = np.column_stack([x[:40], y[:40]])
    m = Moments([*COLS, "y"], every.mean(axis=0), 40.0, np.zeros(4), (every - every.mean(axis=0)).T @ (every - every.mean(axis=0)))
    got = ex.Ridge(m, 3, (5.0,)).errors(every)[0, 0]
    z, errors = (x[:40] - x[:40].mean(axis=0)) / x[:40].std(axis=0), 0.0
    for i in range(40):
        keep = np.arange(40) != i
        design = np.column_stack([np.ones(39), z[keep]])
        w = np.linalg.solve(design.T @ design + np.diag([0, 5.0, 5.0, 5.0]), design.T @ y[:40][keep])
        errors += (y[i] - w @ np.append(1, z[i])) ** 2
    assert got == pytest.approx(errors, rel=1e-9)


def test_bagged_ridge(df, rows):
    x, _, y = rows
    got = ex.fit_bagged_ridge(df, COLS, "y")
    assert got.facts["bags"] == 8
    assert predicted(df, got.predict()) == pytest.approx(np.mean([ridge(x[b::8], y[b::8])[1](x) for b in range(8)], axis=0), abs=1e-6)
    one = ex.fit_bagged_ridge(df, COLS, "y", bags=20)  # 45 rows a bag: one ridge on all rows
    assert one.facts["bags"] == 1 and predicted(df, one.predict()) == pytest.approx(ridge(x, y)[1](x), abs=1e-6)


def test_terrain_router(df, rows):
    x, t, y = rows
    base = ridge(x, y)[1](x)
    want = base.copy()
    for c in (0, 1):
        at = t == c
        w = at.sum() / (at.sum() + 300)
        want[at] = (1 - w) * base[at] + w * ridge(x[at], y[at], ex.EXPERT_ALPHAS)[1](x[at])
    assert predicted(df, ex.fit_terrain_router(df, COLS, "y", "t", least=100, shrink=300)) == pytest.approx(want, abs=1e-6)
    gone = df.withColumn("t", F.lit(None).cast("int"))  # rows without a terrain keep the global ridge
    assert predicted(gone, ex.fit_terrain_router(gone, COLS, "y", "t", least=100)) == pytest.approx(base, abs=1e-6)


def test_steepness(df, rows):
    x, _, y = rows
    s = ridge(x, np.abs(y))[1](x)
    want = ridge(x, y)[1](x) * (1 + 0.5 * np.clip((s - s.mean()) / (s.std() + 1e-9), -1.5, 1.5))
    assert predicted(df, ex.fit_steepness(df, COLS, "y")) == pytest.approx(want, abs=1e-6)


def test_terrace(df, rows):
    x, _, y = rows
    s = ridge(x, y)[1](x)
    codes = np.searchsorted(np.unique(np.quantile(s, np.arange(1, 8) / 8)), s, side="right")
    level = np.array([(y[codes == c].sum() + 25 * y.mean()) / ((codes == c).sum() + 25) for c in range(8)])[codes]
    want = 0.5 * (s - s.mean()) / s.std() + 0.5 * (level - level.mean()) / level.std()
    assert predicted(df, ex.fit_terrace(df, COLS, "y", steps=8)) == pytest.approx(want, abs=1e-5)


def test_rapids(df, rows):
    x, _, y = rows
    first = ridge(x, y)[1](x)
    left = y - first
    at = np.abs(left) >= np.quantile(np.abs(left), 0.7)
    second = ridge(x[at], left[at], ex.EXPERT_ALPHAS)[1](x)
    seg = np.arange(N) // 100
    scores = [np.corrcoef((first + w * second)[seg == 8], y[seg == 8])[0, 1] for w in (0, 0.25, 0.5)]
    w = (0, 0.25, 0.5)[int(np.argmax(scores))]
    cut = df.withColumn("seg", F.floor(F.col("row_idx") / 100).cast("int"))
    got = ex.fit_rapids(cut, COLS, "y")
    assert got.facts["weight"] == w and predicted(df, got.predict()) == pytest.approx(first + w * second, abs=1e-6)
    calm = ex.fit_rapids(cut, COLS, "y", least=400)  # too few rough rows: one stage
    assert calm.facts["weight"] == 0 and predicted(df, calm.predict()) == pytest.approx(first, abs=1e-6)


def test_row_court_and_trails(df, rows):
    x, t, y = rows
    p = (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()
    left = y - (p * (y - y.mean())).mean() * p
    r = np.abs(left) / left.std()
    cell = np.array([y[t == c].mean() for c in range(3)])[t]
    want = {i: (r[i], abs(y[i] - cell[i]) / y.std()) for i in np.flatnonzero(r >= np.quantile(r, 0.95))}
    got = ex.row_court(df, "id", "a", "y", ["t"], share=0.95).collect()
    assert {g["id"] for g in got} == set(want) and len(got) == 45
    for g in got:
        size, dev = want[g["id"]]
        assert (g["studentized_resid"], g["cell_dev"], g["bad_data_score"]) == pytest.approx((size, dev, size * (0.5 + 0.5 * min(dev, 3))), rel=1e-6)
    assert ex.row_court(df, "id", "a", "y", ["t"], share=0.5, top=7).count() == 7
    trails = {(g["path"], g["terrain"]): (g["rows"], g["corr"]) for g in ex.terrain_trails(df.withColumn("still", F.lit(1.0)), ["a", "still"], "y", "t", 100).collect()}
    assert set(trails) == {(p, c) for p in ("a", "still") for c in (0, 1)} and trails["still", 0][1] == 0
    assert trails["a", 1] == (int((t == 1).sum()), pytest.approx(np.corrcoef(x[t == 1, 0], y[t == 1])[0, 1]))


def test_empty_tables_and_nulls(spark, df):
    none = spark.createDataFrame([], SCHEMA)
    assert ex.fit_bagged_ridge(none, COLS, "y") is None and ex.ridges(none, COLS, ["y"]) == ({}, None)
    assert ex.fit_rapids(none.withColumn("seg", F.lit(1)), COLS, "y") is None
    assert none.select(ex.fit_terrace(none, COLS, "y"), ex.fit_steepness(none, COLS, "y"), ex.fit_terrain_router(none, COLS, "y", "t")).count() == 0
    assert ex.row_court(none, "id", "a", "y", ["t"]).count() == 0 and ex.terrain_trails(none, ["a"], "y", "t", 1).count() == 0
    holes = df.withColumn("a", F.when(F.col("id") % 7 > 0, F.col("a"))).withColumn("y", F.when(F.col("id") % 11 > 0, F.col("y")))
    fit = ex.ridges(holes, COLS, ["y"], "t", least=100)[0]
    assert set(fit) == {(None, "y"), (0, "y"), (1, "y")} and all(np.isfinite(f.beta).all() for f in fit.values())
