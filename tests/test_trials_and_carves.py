"""Candidates refitted on rows, and carved predictions made row by row, against what the moments say."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates as ca
from tidemark.operators import candidates_cv as cc
from tidemark.operators import carve as cv
from tidemark.operators.bayes import bayes_ridge
from tidemark.operators.moments import moments

N, SEGS, COLS = 900, 9, ["a", "b", "c", "d", "e"]


def corr(p, y):
    return float(np.corrcoef(p, y)[0, 1]) if np.std(p) > 1e-12 and np.std(y) > 1e-12 else 0.0


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(N, 5)) + np.arange(5) * 50
    x[:, 4] = x[:, 0] + 0.1 * rng.normal(size=N)
    y = 0.6 * x[:, 0] - 0.4 * x[:, 2] + rng.normal(size=N) * 1.5
    seg = np.arange(N) * SEGS // N
    df = spark.createDataFrame([(i, N, int(seg[i]), *map(float, x[i]), float(y[i])) for i in range(N)], "row_idx long, n_rows long, seg int, " + ", ".join(f"{c} double" for c in COLS) + ", y double").repartition(3).cache()
    yield df, x, y, seg
    df.unpersist()


def picked(ranker, x, y, seg, k):
    own = np.array([abs(corr(x[:, i], y)) for i in range(5)])
    if ranker == "stable":
        per = np.array([[corr(x[seg == s, i], y[seg == s]) if (seg == s).sum() >= 50 else 0.0 for i in range(5)] for s in np.unique(seg)])
        return list(np.argsort(-(np.abs(per.mean(0)) - per.std(0)), kind="stable")[:k])
    order = list(np.argsort(-own, kind="stable"))
    if ranker == "decor":
        kept = []
        for i in order:
            if all(abs(corr(x[:, i], x[:, j])) < 0.9 for j in kept):
                kept.append(i)
        order = kept
    return order[:k]


def fitted(c, x, y, seg):
    """A function that predicts, and the columns it uses, by a plain fit on rows."""
    some = picked(c.ranker, x, y, seg, c.k)
    if c.transform == "pca":
        _, _, vt = np.linalg.svd(x[:, some] - x[:, some].mean(0), full_matrices=False)
        w = vt[: c.parts].T
    else:
        w = np.eye(len(some))
    z = x[:, some] @ w
    sd = z.std(0) + 1e-12
    s = (z - z.mean(0)) / sd
    beta = np.linalg.solve(s.T @ s + (c.alpha if c.model == "ridge" else 1e-9) * np.eye(s.shape[1]), s.T @ (y - y.mean())) / sd
    return (lambda v: y.mean() + (v[:, some] @ w - z.mean(0)) @ beta), some


def width(s, charge=0.0):
    return np.mean(s) - np.std(s) + min(0, min(s)) - charge


@pytest.mark.parametrize("c", [cc.Candidate("top", 3), cc.Candidate("stable", 2, model="ols"), cc.Candidate("decor", 3, alpha=100.0), cc.Candidate("top", 4, "pca", parts=2)])
def test_a_candidate_equals_refits_on_rows(table, c):
    df, x, y, seg = table
    report, predictions = cc.evaluate_candidates(df, [c], COLS, "y", n_segments=SEGS, n_folds=3, wf_folds=2, embargo=20)
    r = report.first()
    fold, oof, scores = seg % 3, np.zeros(N), []  # nine equal segments are dealt in turn
    for f in range(3):
        held = np.flatnonzero(fold == f)
        near = np.zeros(N, bool)
        for i in held:
            near[max(0, i - 20) : i + 21] = True
        p, _ = fitted(c, x[~near], y[~near], seg[~near])
        oof[held] = p(x[held])
        scores.append(corr(oof[held], y[held]))
    assert np.allclose(r["fold_corrs"], scores, atol=1e-6) and abs(r["oof_corr"] - corr(oof, y)) < 1e-6
    assert abs(r["era_corr"] - np.mean([corr(oof[seg == s], y[seg == s]) for s in range(SEGS)])) < 1e-6
    wf, ahead, rows = [], [], []
    for s in (7, 8):
        train, test = np.arange(N) < s * 100 - 20, seg == s
        p, _ = fitted(c, x[train], y[train], seg[train])
        wf.append(corr(p(x[test]), y[test]))
        ahead.append(p(x[test]))
        rows.append(y[test])
    assert np.allclose(r["wf_fold_corrs"], wf, atol=1e-6) and abs(r["wf_corr"] - corr(np.concatenate(ahead), np.concatenate(rows))) < 1e-6 and abs(r["wf_width"] - width(wf)) < 1e-6
    p, some = fitted(c, x, y, seg)
    assert r["used"] == [COLS[i] for i in some] and abs(r["fit_corr"] - corr(p(x), y)) < 1e-6 and r["uniqueness"] == 1.0
    got = {q["row_idx"]: q["pred"] for q in predictions().collect()}
    assert np.allclose([got[i] for i in range(N)], oof, atol=1e-5)
    assert abs(r["width"] - width(scores, 0.05 * max(0, r["stability"] - 0.35))) < 1e-6


def test_stability_is_what_noise_does_on_average(table):
    df, x, y, seg = table
    r = cc.evaluate_candidates(df, [cc.Candidate("top", 5)], COLS, "y", n_segments=SEGS, n_folds=3, embargo=0)[0].first()
    rng, moved = np.random.default_rng(0), []
    for f in range(3):
        held = seg % 3 == f
        p, _ = fitted(cc.Candidate("top", 5), x[~held], y[~held], seg[~held])
        base = p(x[held])
        moved.append(np.mean([np.sqrt(np.mean((p(x[held] + rng.normal(size=x[held].shape) * 0.05 * x[held].std(0)) - base) ** 2)) for _ in range(200)]) / base.std())
    assert abs(r["stability"] / np.mean(moved) - 1) < 0.02


def test_twins_are_not_unique_and_noise_is_not_promoted(table):
    df, *_ = table
    report, _ = cc.evaluate_candidates(df.withColumn("z", F.rand(4)), [cc.Candidate("top", 2), cc.Candidate("top", 2, model="bayes_ridge"), cc.Candidate("medoid", 2)], COLS, "y", n_segments=SEGS, n_folds=3, embargo=20)
    rows = report.collect()
    assert rows[0]["uniqueness"] == 1.0 and rows[1]["uniqueness"] < 0.01 and rows[0]["decision"] == "promote" and rows[0]["reasons"] == ""
    noise = cc.evaluate_candidates(df.withColumn("y", F.rand(5)), [cc.Candidate("top", 1)], COLS, "y", n_segments=SEGS, n_folds=3, embargo=20)[0].first()
    assert noise["decision"] != "promote" and noise["reasons"]


def test_final_refit_predicts_new_rows(table):
    df, x, y, seg = table
    got = [r["pred"] for r in cc.final_refit(df, cc.Candidate("top", 3), COLS, "y", df.filter("seg > 6"), "row_idx").orderBy("row_idx").collect()]
    p, _ = fitted(cc.Candidate("top", 3), x, y, seg)
    assert np.allclose(got, p(x[seg > 6]), atol=1e-6)
    assert np.allclose(bayes_ridge(moments(df, [*COLS, "y"]), "y").beta[1], 0, atol=0.3)


def z(v):
    return (v - v.mean()) / (v.std() + 1e-12)


def test_carves_equal_predictions_made_row_by_row(spark):
    rng = np.random.default_rng(9)
    champion, route = rng.normal(size=700), rng.normal(size=700)
    route = np.round(0.5 * champion + route, 1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(champion, route))], "id long, champ double, other double")
    manifest, weights = cv.carve_candidates(df, "champ", ["other"], kept=1000)
    rows = {r["candidate"]: r for r in manifest.collect()}
    assert len(rows) == 6 * 7 * 4
    made = {}
    for r in cv.carve_predictions(df, "id", "champ", {k: v for k, v in weights.items() if k.endswith("_a0.08")}).collect():
        made.setdefault(r["candidate"], np.zeros(700))[r["id"]] = r["prediction"]
    c, zr = z(champion), z(route)
    ranks = np.array([(route < v).sum() + ((route == v).sum() + 1) / 2 for v in route])
    lenses = {"raw": zr, "rank": z(ranks), "sqrt": z(np.sign(zr) * np.sqrt(np.abs(zr))), "tanh": z(np.tanh(zr)), "clip": z(np.clip(zr, *np.quantile(zr, [0.025, 0.975]))), "pow15": z(np.sign(zr) * np.abs(zr) ** 1.5)}
    for lens, r in lenses.items():
        rho = corr(c, r)
        rest, conflict, agree, tail = z(r - rho * c), np.abs(c - r) >= np.quantile(np.abs(c - r), 0.95), c * r >= np.quantile(c * r, 0.95), np.abs(r) >= np.quantile(np.abs(r), 0.95)
        plain = {
            "reduce": 0.92 * c + 0.08 * r, "resid_add": c + 0.08 * rest, "resid_sub": c - 0.08 * rest, "agree_add": c + 0.08 * rest * agree, "conflict_sub": c - 0.08 * rest * conflict,
            "tail_blend": np.where(tail, 0.92 * c + 0.08 * r, c), "conflict_damp": np.where(conflict, 0.92 * c, c),
        }
        for edit, pred in plain.items():
            name = f"other_{lens}_{edit}_a0.08"
            row = rows[name]
            assert np.allclose(made[name], z(pred), atol=1e-6), name
            assert abs(row["corr_candidate_champion"] - corr(pred, c)) < 1e-8 and abs(row["corr_candidate_route"] - corr(pred, r)) < 1e-8 and abs(row["agree_tail_frac"] - agree.mean()) < 1e-9
    few, kept = cv.carve_candidates(df.withColumn("third", F.col("other") * F.col("champ")), "champ", ["other", "third"], kept=5)
    scores = [r["review_score"] for r in few.collect()]
    assert len(scores) == 5 == len(kept) and scores == sorted(scores, reverse=True) and scores[0] >= max(r["review_score"] for r in rows.values()) - 1e-12
    assert cv.carve_candidates(df.withColumn("same", F.col("champ")), "champ", ["same"])[0].filter("lens = 'raw' and rehab_stage = 'reduce'").count() == 0  # nothing new


def test_blends_of_ranks_and_scores(spark):
    rng = np.random.default_rng(10)
    a, b = rng.normal(size=50), np.round(rng.normal(size=50) * 9)
    preds = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(a)] + [("b", i, float(v)) for i, v in enumerate(b)] + [("c", i, 1.0) for i in range(50)], "member string, row long, pred double")
    rank = lambda v: np.lexsort((np.arange(50), v)).argsort() - 24.5
    got = lambda **k: [r["blend"] for r in ca.rank_average_blend(preds, "member", "row", **k).orderBy("row").collect()]
    assert np.allclose(got(weights={"a": 1.0, "b": 3.0}), (rank(a) + 3 * rank(b)) / 4)
    assert np.allclose(got(weights={"a": 2.0, "b": 1.0}, z=True), (2 * z(a) + z(b)) / 3, atol=1e-6)
    assert np.allclose(got(), (rank(a) + rank(b) + rank(np.ones(50))) / 3)
