"""Careful edits of one prediction by another, scored without being made.

A route is seen through six lenses. Per lens, seven edits of the champion at several strengths are linear forms of eight columns: champion and
lens, whole and on the rows of three tails. So one scan for the moments of those columns scores every candidate; rows are read again
only for the candidates that are kept. The table of candidates has lenses times edits times strengths rows for each route.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ensemble import carve_lenses
from tidemark.operators.keys import written
from tidemark.operators.moments import Moments, moments
from tidemark.operators.quantiles import exact_quantiles_of

# Lenses, strengths, the tails' quantile, and how many candidates are kept.
LENSES = ("raw", "rank", "sqrt", "tanh", "clip", "pow15")
ALPHAS = (0.03, 0.05, 0.08, 0.12)
TAIL = 0.95
KEPT = 80
# Fixed values of the review: weights of the route's correlation, of the gain over it and of the novelty's fit, and the novelty aimed at.
ROUTE, GAIN, FIT, NOVELTY = 0.08, 0.03, 0.015, 0.0018
CLIP = 0.025

MANIFEST = (
    "candidate string, route string, rehab_stage string, lens string, alpha double, corr_champion_route double, corr_candidate_champion double, corr_candidate_route double, novelty_from_champion double, "
    "route_information_gain double, conflict_tail_frac double, agree_tail_frac double, route_tail_frac double, review_score double"
)


def carve_basis(df: DataFrame, champion: str, route: str) -> DataFrame:
    """Adds the champion's z-score `_c`, the route's lenses, and per lens its parts on the rows where both agree, conflict, or the route is far out.

    A tail is where |c - r|, c * r or |r| reaches its own 95 % quantile.
    """
    m = moments(df, [champion])
    out = carve_lenses(df, route, CLIP).withColumn("_c", (F.col(champion) - float(m.mean[0])) / float(m.sd[0] + 1e-12))
    values = {f"_{lens}_{k}": v for lens in LENSES for k, v in (("conflict", F.abs(F.col("_c") - F.col(lens))), ("agree", F.col("_c") * F.col(lens)), ("tail", F.abs(F.col(lens))))}
    out = written(out.withColumns(values))  # lenses need ranks over all rows, and the passes below are many
    edges = exact_quantiles_of(out, {v: [TAIL] for v in values})
    tails = {v[1:]: (F.col(v) >= edges[v][0]).cast("double") for v in values}
    parts = {f"{k}_{p}": F.col(c) * inside for k, inside in tails.items() for p, c in (("c", "_c"), ("r", k.split("_")[0]))}
    return out.withColumns(tails | parts).drop(*values)


def edits(lens: str, rho: float, spread: float, alpha: float) -> dict[str, tuple[str, dict[str, float]]]:
    """{edit: (stage, weights of the basis columns)}; the residual of the route is (r - rho c) / spread."""
    rest = lambda c, r, k: {c: -k * rho / spread, r: k / spread}
    plus = lambda a, b: {n: a.get(n, 0.0) + b.get(n, 0.0) for n in {**a, **b}}
    own = {"_c": 1.0}
    part = lambda name: (f"{lens}_{name}_c", f"{lens}_{name}_r")
    return {
        "reduce": ("reduce", {"_c": 1 - alpha, lens: alpha}),
        "resid_add": ("residual_add", plus(own, rest("_c", lens, alpha))),
        "resid_sub": ("residual_subtract", plus(own, rest("_c", lens, -alpha))),
        "agree_add": ("agreement_carve", plus(own, rest(*part("agree"), alpha))),
        "conflict_sub": ("conflict_carve", plus(own, rest(*part("conflict"), -alpha))),
        "tail_blend": ("tail_terraform", plus(own, {f"{lens}_tail_c": -alpha, f"{lens}_tail_r": alpha})),
        "conflict_damp": ("conflict_dampen", plus(own, {f"{lens}_conflict_c": -alpha})),
    }


def carve_grid(m: Moments, route: str, alphas: tuple[float, ...] = ALPHAS) -> Iterator[tuple[dict, dict[str, float]]]:
    """(manifest row, weights of the basis columns) of every candidate that differs from the champion."""
    form = lambda w: np.array([w.get(c, 0.0) for c in m.columns])
    champion = form({"_c": 1.0})
    for lens in LENSES:
        seen = form({lens: 1.0})
        rho = m.linear_corr(champion, seen)
        left = seen - rho * champion
        spread = float(np.sqrt(max(left @ m.cov @ left, 0.0))) + 1e-12
        share = {k: float(m.mean[m.columns.index(f"{lens}_{k}")]) for k in ("conflict", "agree", "tail")}
        for alpha in alphas:
            for edit, (stage, weights) in edits(lens, rho, spread, alpha).items():
                own = form(weights)
                to_champion, to_route = m.linear_corr(own, champion), m.linear_corr(own, seen)
                if abs(to_champion - 1) < 1e-10:
                    continue
                novelty, gain = 1 - to_champion, to_route - rho
                fit = -abs(np.log10(max(0.0, novelty) + 1e-9) - np.log10(NOVELTY))
                score = to_champion + ROUTE * to_route + GAIN * gain + FIT * fit
                yield {
                    "candidate": f"{route}_{lens}_{edit}_a{alpha:g}", "route": route, "rehab_stage": stage, "lens": lens, "alpha": float(alpha), "corr_champion_route": rho, "corr_candidate_champion": to_champion, "corr_candidate_route": to_route,
                    "novelty_from_champion": novelty, "route_information_gain": gain, "conflict_tail_frac": share["conflict"], "agree_tail_frac": share["agree"], "route_tail_frac": share["tail"], "review_score": float(score),
                }, weights


def basis_columns() -> list[str]:
    return ["_c", *LENSES, *[f"{lens}_{k}{part}" for lens in LENSES for k in ("conflict", "agree", "tail") for part in ("", "_c", "_r")]]


def carve_candidates(df: DataFrame, champion: str, routes: list[str], alphas: tuple[float, ...] = ALPHAS, kept: int = KEPT) -> tuple[DataFrame, dict[str, tuple[str, dict[str, float]]]]:
    """(manifest of the best candidates by review score, their weights by name): champion and routes are columns of one table.

    Candidates are offered one by one to a heap of `kept`, so however many routes there are, no more are held. Best first; equal scores by the
    correlation with the route, then by name.
    """
    heap: list = []
    for route in routes:
        some = carve_basis(df.select(F.col(champion).cast("double").alias("_champion"), F.col(route).cast("double").alias("_route")), "_champion", "_route")
        for row, weights in carve_grid(moments(some, basis_columns()), route, alphas):
            item = (row["review_score"], row["corr_candidate_route"], row["candidate"], row, weights)
            if len(heap) < kept:
                heapq.heappush(heap, item)
            elif item[:3] > heap[0][:3]:
                heapq.heapreplace(heap, item)
    best = sorted(heap, key=lambda i: (-i[0], -i[1], i[2]))
    rows = [tuple(i[3][c.split(" ")[0]] for c in MANIFEST.split(", ")) for i in best]
    return df.sparkSession.createDataFrame(rows, MANIFEST), {i[2]: (i[3]["route"], i[4]) for i in best}


def carve_predictions(df: DataFrame, key: str, champion: str, weights: dict[str, tuple[str, dict[str, float]]]) -> DataFrame:
    """(key, candidate, prediction): the z-scored predictions of the candidates given, one scan for each route among them."""
    out = None
    for route in dict.fromkeys(r for r, _ in weights.values()):
        some = carve_basis(df.select(key, F.col(champion).cast("double").alias("_champion"), F.col(route).cast("double").alias("_route")), "_champion", "_route")
        m = moments(some, basis_columns())
        made = []
        for name, (of, w) in weights.items():
            if of == route:
                form = np.array([w.get(c, 0.0) for c in m.columns])
                mean, sd = float(form @ m.mean), float(np.sqrt(max(form @ m.cov @ form, 0.0))) + 1e-12
                value = (sum((F.col(c) * float(v) for c, v in w.items()), F.lit(0.0)) - mean) / sd
                made.append(F.struct(F.lit(name).alias("candidate"), value.alias("prediction")))
        one = some.select(key, F.explode(F.array(*made)).alias("r")).select(key, "r.*")
        out = one if out is None else out.unionByName(one)
    return out
