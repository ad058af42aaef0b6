"""Exact quantiles without all distinct values in one place.

Approximate quantiles bracket the wanted ranks; a count below the bracket and the values inside it, some thousands of rows, settle them
exactly. A bracket that holds more than `HELD` values is narrowed by another approximate pass over itself first; one that holds a
single value, however often, is settled at once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a bracket that are collected at most.
HELD = 20_000
#: The accuracy of an approximate quantile: ranks are off by n / ACCURACY at most.
ACCURACY = 2000


def cut_at(span: tuple, edges: list[float]) -> list[tuple[float, float]]:
    """Closed intervals that make up a bracket, in order: the edges as single values, and what lies between them."""
    out, low = [], span[0]
    for e in edges:
        if low < e:
            out.append((low, math.nextafter(e, -math.inf)))
        out.append((e, e))
        low = math.nextafter(e, math.inf)
    return [*out, (low, span[1])] if not edges or edges[-1] < span[1] else out


def exact_quantiles(df: DataFrame, column: str, shares: list[float], held: int = HELD) -> list[float]:
    """Linear quantiles of the known values of a column; NaN for none."""
    return exact_quantiles_of(df, {column: shares}, held)[column]


def exact_quantiles_of(df: DataFrame, wanted: dict[str, list[float]], held: int = HELD) -> dict[str, list[float]]:
    """The same for several columns: two or a few passes for all of them together."""
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in wanted}
    counts = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(value.values())]).first()
    n = {c: counts[f"n{i}"] for i, c in enumerate(value)}
    # (column, rank) -> (column, low, high, how many lie below low, how many lie inside)
    spans = {(c, r): (c, -math.inf, math.inf, 0, n[c]) for c, shares in wanted.items() if n[c] for s in shares for r in (math.floor(s * (n[c] - 1)), math.ceil(s * (n[c] - 1)))}
    found: dict[tuple[str, int], float] = {}
    inside = lambda c, low, high: F.when(value[c].between(low, high), value[c])
    while len(found) < len(spans):
        open_ = {k: b for k, b in spans.items() if k not in found}
        wide = sorted({b for b in open_.values() if b[4] > held})
        if wide:
            asked = {b: sorted({min(1.0, max(0.0, (k[1] - b[3]) / b[4] + e / ACCURACY)) for k, o in open_.items() if o == b for e in (-2, 2)}) for b in wide}
            edges = df.agg(*[F.percentile_approx(inside(*b[:3]), F.array(*[F.lit(s) for s in asked[b]]), ACCURACY).alias(f"e{i}") for i, b in enumerate(wide)]).first()
            parts = [(b, low, high) for b, own in zip(wide, edges) for low, high in cut_at(b[1:3], sorted(set(own)))]
            sizes = df.agg(*[F.count(inside(b[0], low, high)).alias(f"n{i}") for i, (b, low, high) in enumerate(parts)]).first()
            before = {b: b[3] for b in wide}
            for (b, low, high), size in zip(parts, sizes):
                for k, own in open_.items():
                    if own == b and before[b] <= k[1] < before[b] + size:
                        spans[k] = (b[0], low, high, before[b], size)
                        if low == high:
                            found[k] = low
                before[b] += size
        else:
            spots = sorted({b[:3] for b in open_.values()})
            lists = df.agg(*[F.sort_array(F.collect_list(inside(*spot))).alias(f"v{i}") for i, spot in enumerate(spots)]).first()
            for k, b in open_.items():
                found[k] = lists[spots.index(b[:3])][k[1] - b[3]]
    return {c: [between_ranks(found, c, s * (n[c] - 1)) if n[c] else math.nan for s in shares] for c, shares in wanted.items()}


def between_ranks(found: dict[tuple[str, int], float], column: str, at: float) -> float:
    low, high = found[column, math.floor(at)], found[column, math.ceil(at)]
    return low if low == high or at == math.floor(at) else low + (high - low) * (at - math.floor(at))
