"""Properties that SQL does not show: splits, recurrences, ranks, models, sinks."""

import numpy as np
import pytest

from tidemark import functions as fn
from tidemark import sources
from tidemark.operators import candidates, features, keys, metrics, models, transforms


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    y = x @ [1.0, -0.5, 0.0] + rng.normal(size=900)
    data = [(int(i), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = keys.assign_segments(keys.row_index(spark.createDataFrame(data, "id long, a double, b double, c double, y double"), "id"), 7).cache()
    return df, x, y


def test_row_index_and_segments(rows):
    df, x, _ = rows
    out = df.select("id", "row_idx", "n_rows", "seg").collect()
    assert all(r["id"] == r["row_idx"] and r["seg"] == r["row_idx"] * 7 // 900 for r in out)


@pytest.mark.parametrize("embargo", [0, 5, 40])
def test_purged_folds(rows, embargo):
    df, _, _ = rows
    seg = np.arange(900) * 7 // 900
    out = keys.purged_folds(df, 3, embargo).collect()
    valid = {f: {r["row_idx"] for r in out if r["fold"] == f and r["role"] == "valid"} for f in range(3)}
    assert sorted(i for v in valid.values() for i in v) == list(range(900))
    for f, v in valid.items():
        assert all((np.flatnonzero(seg == s)[0] in v) == (i in v) for s in range(7) for i in np.flatnonzero(seg == s))
        near = {j for i in v for j in range(i - embargo, i + embargo + 1)}
        assert {r["row_idx"] for r in out if r["fold"] == f and r["role"] == "train"} == set(range(900)) - near


@pytest.mark.parametrize("span", [4, 32, 64])
def test_ema_is_the_recurrence(rows, span):
    df, x, _ = rows
    got = [r["ema"] for r in transforms.ema(df, "a", span).orderBy("row_idx").collect()]
    e, out = x[0, 0], []
    for v in x[:, 0]:
        e = e + 2 / (span + 1) * (v - e)
        out.append(e)
    assert np.allclose(got, out, atol=1e-9)


def test_ranks(spark):
    values = [3.0, 1.0, 2.0, 2.0, 2.0, 9.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    place = {r["id"]: r["r"] for r in metrics.position_rank(df, "v", "id", "r").collect()}
    order = sorted(range(7), key=lambda i: (values[i], i))
    assert [place[i] for i in order] == list(range(7))
    mean = {r["id"]: r["r"] for r in metrics.average_rank(df, "v", "r").collect()}
    assert [mean[i] for i in range(7)] == [6, 1.5, 4, 4, 4, 7, 1.5]


def test_ridge_and_pls_against_numpy(rows):
    df, x, y = rows
    coef, intercept = models.fit_ridge(df, ["a", "b", "c"], "y", 3.0)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 3 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(list(coef.values()), beta) and intercept == pytest.approx(y.mean() - beta @ x.mean(0))
    full = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
    assert np.allclose(list(models.pls1(df, ["a", "b", "c"], "y", 3).values()), full, atol=1e-8)
    one = z.T @ (y - y.mean())
    got = np.array(list(models.pls1(df, ["a", "b", "c"], "y", 1).values()))
    assert np.allclose(got / np.linalg.norm(got), one / np.linalg.norm(one))


def test_sign_flipper(spark):
    """A strong column that flips its sign in some segments falls behind a weak stable one."""
    rng = np.random.default_rng(6)
    seg = np.arange(1200) // 150
    strong, weak = rng.normal(size=1200), rng.normal(size=1200)
    y = np.where(np.isin(seg, [1, 4, 6]), -1, 1) * strong + 0.15 * weak + 0.3 * rng.normal(size=1200)
    df = keys.assign_segments(keys.row_index(spark.createDataFrame([(i, float(a), float(b), float(t)) for i, (a, b, t) in enumerate(zip(strong, weak, y))], "id long, s double, w double, y double"), "id"), 8)
    first = lambda r: features.ranked(r).filter("rank = 1").first()["feature"]
    assert first(features.rank_top(df, ["s", "w"], "y")) == "s"
    assert first(features.rank_sign_stability(df, ["s", "w"], "y")) == "w"


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "x double, y double")
    assert df.agg(fn.pearson("x", "y").alias("c")).first()["c"] == 0
    assert df.limit(2).agg(fn.pearson("y", "y").alias("c")).first()["c"] == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, a double, b double, y double")
    indexed = keys.assign_segments(keys.row_index(df, "id"))
    assert indexed.count() == 0
    assert features.corr_vector(indexed, ["a", "b"], "y").select("corr").distinct().collect()[0][0] == 0
    assert transforms.ema(indexed, "a", 4).count() == 0


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, 3.5, "y")], "id long, feature double, t string")
    df.write.csv(str(tmp_path / "a.csv"), header=True)
    df.write.json(str(tmp_path / "a.jsonl"))
    df.write.parquet(str(tmp_path / "a"))
    for n in ("a.csv", "a.jsonl", "a"):
        assert sources.read_table(spark, str(tmp_path / n)).count() == 2
    with pytest.raises(ValueError):
        sources.read_table(spark, "x.feather")
    assert sources.select_features(df, df.drop("id")) == ["feature"]
    sample = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id long, target double")
    facts = sources.write_predictions(spark.createDataFrame([(1, 0.5), (2, 1.5)], "id long, pred double"), sample, "id", "target", str(tmp_path / "out"))
    assert tuple(facts.first()) == (2, 1.0, 0.5)
    with pytest.raises(ValueError):  # one prediction for two sample rows
        sources.write_predictions(spark.createDataFrame([(1, 0.5)], "id long, pred double"), sample, "id", "target", str(tmp_path / "out2"))
    with pytest.raises(ValueError):
        sources.write_predictions(spark.createDataFrame([(1, 0.5), (2, float("nan"))], "id long, pred double"), sample, "id", "target", str(tmp_path / "out3"))
    assert sources.union_reports(df, sample).columns == ["id", "feature", "t", "target"]


def test_joint_codes(spark):
    a, b = spark.createDataFrame([("b",), (None,)], "v string"), spark.createDataFrame([("a",), ("b",)], "v string")
    assert {r["value"]: r["code"] for r in transforms.joint_codes(a, b, "v").collect()} == {"None": 0, "a": 1, "b": 2}


def test_last_wins_and_gates(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k string, o int, v int")
    assert {(r["k"], r["v"]) for r in candidates.last_wins(df, ["k"], "o").collect()} == {("a", 6), ("b", 7)}
    c = spark.createDataFrame([("x", 0.1, 0.1, 0.1, 3), ("y", 0.1, -0.1, 0.1, 9), ("z", -0.1, 0.1, 0.1, 3)], "key string, oof double, width double, wf_width double, overfit int")
    assert {r["key"]: (r["decision"], r["reasons"]) for r in candidates.gate_decision(c).collect()} == {"x": ("promote", ""), "y": ("expand", "width<=0|overfit>6"), "z": ("reject", "oof<=0")}


def test_scores_with_alternate_names(spark):
    from tidemark.operators import scores as sc

    raw = spark.createDataFrame([("a/b.csv", "0.09", "nan", None), ("", "1", "2", "x"), ("c.csv", "bad", None, "External Reference run")], "file string, private string, public string, message string")
    rows = {r["filename"]: r for r in sc.classify_scores(sc.score_rows(raw), 0.09, 0.05).collect()}
    assert set(rows) == {"b.csv", "c.csv"} and rows["b.csv"]["public"] is None and rows["c.csv"]["private"] is None
    assert rows["b.csv"]["action"] == "promote_as_teacher" and rows["c.csv"]["action"] == "external_reference_only"


def test_targets_and_groups(spark):
    from tidemark.operators import profile as pr

    train = spark.createDataFrame([(i, i % 3, float(i)) for i in range(9)], "a int, Era int, goal double")
    assert pr.detect_target(train, train.drop("goal")) == "goal" and pr.detect_target(train.withColumn("label", train["a"])) == "label"
    assert pr.detect_group(train) == "Era" and pr.detect_group(train.withColumnRenamed("Era", "user_id")) is None
    with pytest.raises(ValueError):
        pr.detect_target(train, target="none")


def test_sign_flipper_loses(spark):
    """A feature whose slope flips its sign between segments has no invariant score."""
    from tidemark.operators import features as fe

    rows = [(i, i * 8 // 1600, float((i * 37) % 101), float((i * 53) % 97)) for i in range(1600)]
    df = spark.createDataFrame(rows, "row_idx long, seg int, a double, b double").selectExpr("*", "0.2 * b + case when seg % 2 = 0 then a else -a end as y")
    score = {r["feature"]: r["score"] for r in fe.rank_irm(df, ["a", "b"], "y", ["seg"]).collect()}
    assert score["b"] > 0 > score["a"]


def test_learned_models_find_planted_truth(spark):
    from tidemark.operators import regimes as rg
    from tidemark.operators import learned as ml

    rows = [(i, float((i * 37) % 101), float((i * 53) % 97), float((i * 71) % 89)) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double").selectExpr("*", "3 * a - 2 * b + case when event_id % 50 = 0 then 9000 else 0 end as wild", "3 * a - 2 * b as y", "case when a > 50 then 1.0 else 0.0 end as step")
    net = ml.fit_elastic_net(df, ["a", "b", "c"], "y").coefficients
    assert abs(net[0] - 3) < 0.1 and abs(net[1] + 2) < 0.1 and abs(net[2]) < 0.05
    huber = ml.fit_huber(df, ["a", "b"], "wild").coefficients
    assert abs(huber[0] - 3) < 0.2 and abs(huber[1] + 2) < 0.2
    trees = ml.fit_boosted_trees(df, ["a", "b", "c"], "step").transform(ml.assembled(df, ["a", "b", "c"]))
    assert trees.selectExpr("avg(abs(prediction - step)) as e").first()["e"] < 0.02
    like = ml.testlike_scores(df.filter("a < 60"), df.filter("a >= 50"), ["a", "b"], "event_id").join(df, "event_id")
    assert like.selectExpr("corr(testlike, a) as c").first()["c"] > 0.8
    far = df.selectExpr("*", "step * 100 as far")
    ground = rg.with_terrain(far, rg.terrain_map(far, ["far"], "event_id", 2)).groupBy("terrain").agg({"step": "min", "a": "count"}).collect()
    assert sorted(r["min(step)"] for r in ground) == [0.0, 1.0]


def test_linear_models_against_numpy(spark):
    import numpy as np
    from tidemark.operators import linear as li

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, 0.5, 0.0] + rng.normal(size=300)
    df = spark.createDataFrame([(int(i), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row_idx long, a double, b double, c double, y double")
    w = li.nnls_weights(df, ["a", "b", "c"], "y")
    z, t = (x - x.mean(0)) / x.std(0), y - y.mean()
    best = min(((t - z @ (np.array([i, j, k]) / 20)) ** 2).sum() for i in range(0, 30) for j in range(0, 30) for k in range(0, 4))
    raw = np.array([w.get(m, 0.0) for m in "abc"])
    scale = (z @ raw) @ t / ((z @ raw) @ (z @ raw))
    assert ((t - scale * (z @ raw)) ** 2).sum() <= best * 1.01 and abs(sum(w.values()) - 1) < 1e-9
    loo = {r["alpha"]: r["loo"] for r in li.ridge_cv(df, ["a", "b", "c"], "y", (1.0, 100.0)).collect()}
    for alpha, got in loo.items():
        inv = np.linalg.inv(z.T @ z + alpha * np.eye(3))
        h = 1 / 300 + np.einsum("ij,jk,ik->i", z, inv, z)
        r = t - z @ (inv @ (z.T @ t))
        assert abs(got - np.sqrt(np.mean((r / (1 - h)) ** 2))) < 1e-6
    cut = df.selectExpr("*", "cast(row_idx div 50 as int) as seg")
    kept, intercept = li.greedy_ols(cut, ["a", "b", "c"], "y")
    assert list(kept)[:2] == ["a", "b"]
    some = [list("abc").index(f) for f in kept]
    full = np.linalg.lstsq(np.column_stack([x[:, some], np.ones(300)]), y, rcond=None)[0]
    assert np.allclose([*kept.values(), intercept], full, atol=1e-6)
    zs, train = (x - x.mean(0)) / (x.std(0) + 1e-6), np.arange(300) < 250

    def climb(rows, rounds):
        beta, pred = np.zeros(3), np.full(rows.sum(), y[rows].mean())
        for _ in range(rounds):
            left = zs[rows].T @ (y[rows] - pred)
            j = int(np.argmax(np.abs(left)))
            step = 0.2 * left[j] / (zs[rows][:, j] @ zs[rows][:, j] + 1e-9)
            beta[j] += step
            pred = pred + step * zs[rows][:, j]
        return beta

    scores = [np.corrcoef(zs[~train] @ climb(train, k), y[~train])[0, 1] for k in range(1, 81)]
    best, top = 0, -1e9
    for k, s in enumerate(scores, 1):
        best, top = (k, s) if s > top else (best, top)
        if k - best > 15:
            break
    weights, rounds = li.residual_ladder(cut, ["a", "b", "c"], "y")
    assert rounds == best and np.allclose([weights[f] for f in "abc"], climb(np.ones(300, bool), best), atol=1e-6)
