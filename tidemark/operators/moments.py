"""Second moments of many columns, by cell and by column blocks, in one scan.

A task multiplies its batches as matrices and keeps one partial matrix per cell; what leaves it are the blocks of the upper triangle
(`BLOCK` columns square), which are added up per (cell, block pair). Values are taken relative to a first-pass mean, so
columns far from zero lose no digits, and sums of cells stay sums: folds, segments, regimes and resamples are added and
subtracted without another pass over rows. Nulls and NaN stand at the overall mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.arrow import arrow_map, matrix

BLOCK = 64
#: Bytes of partial matrices that a task holds before it hands them on.
HELD = 256 << 20


@dataclass
class Moments:
    """Weighted count, sums and cross products of columns about `shift`; of a cell, or of any sum or difference of cells."""

    columns: list[str]
    shift: np.ndarray
    n: float
    s: np.ndarray
    x: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.columns, self.shift, self.n + other.n, self.s + other.s, self.x + other.x)

    def __mul__(self, times: float) -> Moments:
        return Moments(self.columns, self.shift, self.n * times, self.s * times, self.x * times)

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.s / max(self.n, 1e-300)

    @property
    def cov(self) -> np.ndarray:
        """Population covariances."""
        m = self.s / max(self.n, 1e-300)
        return self.x / max(self.n, 1e-300) - np.outer(m, m)

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0))

    def corr(self) -> np.ndarray:
        """Correlations; 0 with a constant column."""
        sd = self.sd
        good = sd > 1e-12
        return np.where(np.outer(good, good), self.cov / np.where(np.outer(good, good), np.outer(sd, sd), 1), 0.0)

    def about(self, centre: np.ndarray) -> np.ndarray:
        """Sums of products of the columns about a point."""
        c = centre - self.shift
        return self.x - np.outer(self.s, c) - np.outer(c, self.s) + self.n * np.outer(c, c)

    def pick(self, columns: list[str]) -> Moments:
        at = [self.columns.index(c) for c in columns]
        return Moments(list(columns), self.shift[at], self.n, self.s[at], self.x[np.ix_(at, at)])

    def linear_corr(self, a: np.ndarray, b: np.ndarray) -> float:
        """The correlation of two linear forms of the columns; 0 with fewer than 3 rows or a constant form."""
        c = self.cov
        va, vb = float(a @ c @ a), float(b @ c @ b)
        return float(a @ c @ b / np.sqrt(va * vb)) if self.n >= 3 and va > 1e-24 and vb > 1e-24 else 0.0


def total(cells) -> Moments:
    """The sum of one or more cells."""
    out = None
    for c in cells:
        out = c if out is None else out + c
    return out


def first_means(df: DataFrame, columns: list[str]) -> np.ndarray:
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    got = df.agg(*[F.avg(known(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return np.array([got[i] or 0.0 for i in range(len(columns))])


def moment_blocks(df: DataFrame, columns: list[str], keys: tuple[str, ...], shift: np.ndarray, weights: str | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, draw, bi, bj, n, sums, sums_j, cross): per cell and pair of column blocks bi <= bj, the sums of either block and the cross products.

    weights: an array column of doubles; every place of it is a draw, a cell of its own.
    """
    d = len(columns)
    spans = [(a, min(a + block, d)) for a in range(0, d, block)]
    kinds = [df.schema[k].dataType for k in keys]
    head = ", ".join(f"`{k}` {t.simpleString()}" for k, t in zip(keys, kinds))
    schema = (head + ", " if head else "") + "draw int, bi int, bj int, n double, sums array<double>, sums_j array<double>, cross binary"

    def batch_of(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        kinds = [*types, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*keys, "draw", "bi", "bj", "n", "sums", "sums_j", "cross"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, list] = {}
        types: list[pa.DataType] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for cell, (n, s, x) in cells.items():
                yield batch_of([(*cell, bi, bj, n, s[a:b].tolist(), s[p:q].tolist(), np.ascontiguousarray(x[a:b, p:q]).tobytes()) for bi, (a, b) in enumerate(spans) for bj, (p, q) in enumerate(spans) if bi <= bj], types)
            cells.clear()

        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            x = matrix(b, columns) - shift
            x[np.isnan(x)] = 0.0
            w = None if weights is None else np.array(b.column(b.schema.get_field_index(weights)).to_pylist(), np.float64).reshape(b.num_rows, -1)
            if keys:
                groups: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys))):
                    groups.setdefault(k, []).append(i)
            else:
                groups = {(): slice(None)}
            for key, at in groups.items():
                part = x[at]
                for draw in range(1 if w is None else w.shape[1]):
                    own = None if w is None else w[at, draw]
                    if own is not None and not own.any():
                        continue
                    cell = cells.setdefault((*key, draw), [0.0, np.zeros(d), np.zeros((d, d))])
                    scaled = part if own is None else part * own[:, None]
                    cell[0] += float(len(part) if own is None else own.sum())
                    cell[1] += scaled.sum(axis=0)
                    cell[2] += scaled.T @ part
                    if len(cells) * 8 * d * d > HELD:
                        yield from flush()
        yield from flush()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = None, []

        def made() -> pa.RecordBatch:
            cell, n, si, sj, x = held
            return batch_of([(*cell, n, si.tolist(), sj.tolist(), x.tobytes())], types)

        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                cell, own = row[: len(keys) + 3], (row[-4], np.array(row[-3]), np.array(row[-2]), np.frombuffer(row[-1]))
                if held is not None and held[0] == cell:
                    held = (cell, *(p + q for p, q in zip(held[1:], own)))
                else:
                    if held is not None:
                        yield made()
                    held = (cell, *own)
        if held is not None:
            yield made()

    some = df.select(*keys, *[c for c in dict.fromkeys(columns) if c not in keys], *([weights] if weights else []))
    names = [*keys, "draw", "bi", "bj"]
    parts = arrow_map(some, partial, schema)
    return arrow_map(parts.repartition(*names).sortWithinPartitions(*names), added, schema)


def collect_moments(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), weights: str | None = None) -> dict[tuple, Moments]:
    """{(key values, draw if there are weights): Moments}: columns squared numbers for every cell on the driver."""
    shift, d = first_means(df, columns), len(columns)
    out: dict[tuple, Moments] = {}
    for r in moment_blocks(df, columns, keys, shift, weights).toLocalIterator():
        key = tuple(r[k] for k in keys) + ((r["draw"],) if weights else ())
        m = out.setdefault(key, Moments(list(columns), shift, r["n"], np.zeros(d), np.zeros((d, d))))
        a, p = r["bi"] * BLOCK, r["bj"] * BLOCK
        h = len(r["sums"])
        x = np.frombuffer(r["cross"]).reshape(h, -1)
        if r["bi"] == r["bj"]:
            m.s[a : a + h] = r["sums"]
        m.x[a : a + h, p : p + x.shape[1]] = x
        m.x[p : p + x.shape[1], a : a + h] = x.T
    return out


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Of all rows."""
    d = len(columns)
    return collect_moments(df, columns).get((), Moments(list(columns), np.zeros(d), 0.0, np.zeros(d), np.zeros((d, d))))


def moment_rows(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, j, n, mean_i, mean_j, cov) for every pair i <= j of columns: the blocks as rows, without the driver."""
    shift = first_means(df, columns)
    blocks = moment_blocks(df, columns, keys, shift)
    kinds = [df.schema[k].dataType.simpleString() for k in keys]
    schema = "".join(f"`{k}` {t}, " for k, t in zip(keys, kinds)) + "i string, j string, n double, mean_i double, mean_j double, cov double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            for row in b.to_pylist():
                a, p, n = row["bi"] * BLOCK, row["bj"] * BLOCK, row["n"]
                si, sj = np.array(row["sums"]), np.array(row["sums_j"])
                x = np.frombuffer(row["cross"]).reshape(len(si), len(sj))
                i, j = np.nonzero(np.arange(a, a + len(si))[:, None] <= np.arange(p, p + len(sj))[None, :])
                cov = x[i, j] / n - si[i] / n * (sj[j] / n)
                columns_ = [pa.array([row[k]] * len(i), t) for k, t in zip(keys, types)]
                names = np.array(columns, object)
                yield pa.RecordBatch.from_arrays([*columns_, pa.array(names[a + i]), pa.array(names[p + j]), pa.array(np.full(len(i), n)), pa.array(shift[a + i] + si[i] / n), pa.array(shift[p + j] + sj[j] / n), pa.array(cov)], [*keys, "i", "j", "n", "mean_i", "mean_j", "cov"])

    return arrow_map(blocks, run, schema)
