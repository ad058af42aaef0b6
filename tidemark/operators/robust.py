"""Partitions of the rows into train and test of many makes, and the choice among blends that holds up in all of them.

Rows fall into cells (segment, terrain, weather, band of test-likeness). A partition gives every cell a role, so its training
and test moments are sums of cells' moments: members (ridges on their own columns) are fitted, their blends scored and segments
resampled on matrices of columns squared numbers. Rows are read once, for all partitions, members, blends and resamples.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.linear import ridge_of
from tidemark.operators.moments import Moments, collect_moments, total

CELL = ("seg", "terrain", "weather", "band")
#: The best blend is mixed with the second where they are this close.
TIE = 0.004


def testlike_bands(df: DataFrame, score: str, shares: tuple[float, ...] = (0.25, 0.40)) -> DataFrame:
    """Adds `band`: how many of the shares of most test-like rows the row belongs to (a score at the edge belongs)."""
    edges = df.agg(F.percentile(score, F.array(*[F.lit(1 - s) for s in shares]))).first()[0] or [None] * len(shares)
    return df.withColumn("band", sum((F.when(F.col(score) >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)))


def partitions(cells: Iterable[tuple], *, bands: int = 0, groups: int = 6, test_groups: int = 2, most_paths: int = 12) -> list[tuple[str, set, set]]:
    """(name, training cells, test cells) over cells (seg, terrain, weather, band):

    expanding walk-forward, the last three segments before a segment, late to early, an interior block between its ends, the most
    test-like bands, each terrain and each weather left out, and pairs of segment groups with their neighbours purged.
    """
    cells = set(cells)
    segs = sorted({c[0] for c in cells})
    n = len(segs)

    def of(some: Iterable) -> set:
        some = set(some)
        return {c for c in cells if c[0] in some}

    out = [(f"wf{i}", of(segs[:i]), of([segs[i]])) for i in range(n // 2, n)]
    out += [(f"slide{i}", of(segs[max(0, i - 3) : i]), of([segs[i]])) for i in range(2, n)]
    out += [(f"rev{i}", of(segs[i + 1 :]), of([segs[i]])) for i in range(n // 2)]
    for j, (low, high) in enumerate(((n // 3, 2 * n // 3), (n // 4, 3 * n // 4))):
        if low > 0 and low < high < n:
            middle = of(segs[low:high])
            out.append((f"interior{j}", cells - middle, middle))
    for j in range(bands):
        test = {c for c in cells if c[3] >= bands - j}
        out.append((f"testlike{j}", cells - test, test))
    for name, at in (("terr", 1), ("wx", 2)):
        for v in sorted({c[at] for c in cells if c[at] is not None}):
            test = {c for c in cells if c[at] == v}
            out.append((f"{name}{v}", cells - test, test))
    blocks = [list(b) for b in np.array_split(segs, min(groups, n)) if len(b)]
    for i, some in enumerate(combinations(range(len(blocks)), min(test_groups, len(blocks)))):
        if i == most_paths:
            break
        near = {g for t in some for g in (t - 1, t, t + 1)}
        out.append((f"cpcv{i}", of(s for g, b in enumerate(blocks) if g not in near for s in b), of(s for t in some for s in blocks[t])))
    return out


def robust_partitions(df: DataFrame, *, bands: int = 0, least_train: int = 3000, least_test: int = 500) -> DataFrame:
    """(partition, seg, terrain, weather, band, role) of the partitions with enough rows on both sides; none if fewer than three, or than five segments.

    df has the columns of a cell. Joined to a table of cells' statistics, the roles select what a partition trains and tests on.
    """
    sizes = {tuple(r[k] for k in CELL): r["n"] for r in df.groupBy(*CELL).agg(F.count("*").alias("n")).collect()}  # one row per cell
    kept = enough(partitions(sizes, bands=bands), lambda some: sum(sizes[c] for c in some), least_train, least_test)
    if len({c[0] for c in sizes}) < 5:
        kept = []
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in CELL)
    return df.sparkSession.createDataFrame([(name, *c, role) for name, train, test in kept for role, some in (("train", train), ("test", test)) for c in sorted(some, key=str)], f"partition string, {kinds}, role string")


def enough(parts: list, size, least_train: int, least_test: int) -> list:
    kept = [p for p in parts if size(p[1]) >= least_train and size(p[2]) >= least_test]
    return kept if len(kept) >= 3 else []


def resamples(blocks: int, times: int, seed: int) -> np.ndarray:
    """(times, blocks): how often each block is drawn, with replacement."""
    picks = np.random.default_rng([seed, blocks]).integers(0, blocks, (times, blocks))
    return np.stack([np.bincount(p, minlength=blocks) for p in picks])


def partition_score(test: dict[tuple, Moments], form: np.ndarray, target: np.ndarray, times: int = 200, share: float = 0.25, seed: int = 11) -> float:
    """The lower quartile of a linear form's correlation over resampled segments; the plain one with fewer than three segments."""
    segs = sorted({c[0] for c in test})
    own = [total(m for c, m in test.items() if c[0] == s) for s in segs]
    if len(segs) < 3:
        return total(own).linear_corr(form, target)
    # Only five numbers of a segment matter for two forms.
    facts = np.array([[m.n, form @ m.s, target @ m.s, form @ m.x @ form, form @ m.x @ target, target @ m.x @ target] for m in own])
    n, a, b, aa, ab, bb = (resamples(len(segs), times, seed) @ facts).T
    va, vb = aa / n - (a / n) ** 2, bb / n - (b / n) ** 2
    good = (va > 1e-24) & (vb > 1e-24)
    corr = np.where(good, (ab / n - a / n * b / n) / np.sqrt(np.where(good, va * vb, 1)), 0.0)
    return float(np.quantile(corr, share))


def robust_select(df: DataFrame, members: dict[str, list[str]], blends: dict[str, dict[str, float]], y: str, *, alpha: float = 10.0, bands: int = 0, least_train: int = 3000, least_test: int = 500, complexity: dict[str, float] | None = None, charge: float = 0.0) -> list[dict]:
    """The blends, best first: {config, weights, score, raw, mean, sd, partitions, hedged}.

    members: the columns that each one's ridge is fitted on, again in every partition, on its training cells; its predictions are
    standardised over the test cells. A blend's score is the mean less the deviation of its partition scores, less
    `charge` times its members' mean complexity. Where the best two are within TIE, their half-and-half mix is tried and leads if it is no worse. With fewer than three
    partitions or five segments there is nothing to go by, and the list is empty.
    """
    columns = list(dict.fromkeys(c for cols in members.values() for c in cols))
    cells = collect_moments(df, [*columns, y], CELL)
    if len({c[0] for c in cells}) < 5:
        return []
    parts = enough(partitions(cells, bands=bands), lambda some: sum(cells[c].n for c in some), least_train, least_test)
    target = np.array([0.0] * len(columns) + [1.0])
    forms: list[dict[str, np.ndarray]] = []
    for _, train, test in parts:
        seen, held, found = total(cells[c] for c in train), total(cells[c] for c in test), {}
        for name, cols in members.items():
            beta, _ = ridge_of(seen.pick([*cols, y]), y, alpha)
            form = np.zeros(len(columns) + 1)
            form[[columns.index(c) for c in cols]] = beta
            found[name] = form / (np.sqrt(max(form @ held.cov @ form, 0.0)) + 1e-12)
        forms.append(found)

    def judged(name: str, w: dict[str, float], hedged: bool = False) -> dict:
        size = sum(w.values()) or 1.0
        per = np.array([partition_score({c: cells[c] for c in test}, sum(v / size * found[m] for m, v in w.items()), target) for (_, _, test), found in zip(parts, forms)])
        raw = float(per.mean() - per.std())
        load = sum(v / size * (complexity or {}).get(m, 0.0) for m, v in w.items())
        return {"config": name, "weights": w, "score": raw - charge * load, "raw": raw, "mean": float(per.mean()), "sd": float(per.std()), "partitions": len(parts), "hedged": hedged}

    if not parts or not blends:
        return []
    out = sorted((judged(name, w) for name, w in blends.items()), key=lambda r: -r["score"])
    if len(out) > 1 and out[0]["score"] - out[1]["score"] <= TIE:
        a, b = ({m: v / (sum(r["weights"].values()) or 1.0) for m, v in r["weights"].items()} for r in out[:2])
        mixed = judged(f"hedge({out[0]['config']}+{out[1]['config']})", {m: 0.5 * a.get(m, 0.0) + 0.5 * b.get(m, 0.0) for m in [*a, *(m for m in b if m not in a)]}, True)
        if mixed["score"] >= out[0]["score"] - 1e-9:
            out.insert(0, mixed)
    return out
