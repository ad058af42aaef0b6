"""Nearest neighbours against a bank of rows.

The bank goes to the tasks in blocks of bounded size. A task meets its rows with one block at a time and keeps, for every row, the k nearest
so far; so there is never a table of rows times bank, and a bank of many blocks costs a written pass for each.
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
from tidemark.operators.bayes import inner_valid
from tidemark.operators.keys import written
from tidemark.operators.moments import moments

#: Bytes of a block of the bank.
BLOCK_BYTES = 8 << 20
#: Rows of a batch that meet the bank at once.
ROWS = 256
#: Squared distances are compared after rounding, ties by the place in the bank.
DIGITS = 9


def bank_rows(df: DataFrame, most: int) -> DataFrame:
    """Every step-th row of those in row order, the step being n // most (one at least)."""
    n = df.count()
    return df.filter(F.col("row_idx") % max(1, n // most) == 0)


def nearest(rows: DataFrame, bank: DataFrame, features: list[str], y: str, k: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with `_d` (squared distances, rounded, nearest first), `_y` (the bank's targets) and `_at` (its row numbers), k of each at most.

    bank: row_idx, the features and y; it is read block by block in the order of row_idx.
    """
    size = max(1, block_bytes // (8 * (len(features) + 2)))
    count = bank.count()
    kept = [T.StructField("_d", T.ArrayType(T.DoubleType())), T.StructField("_y", T.ArrayType(T.DoubleType())), T.StructField("_at", T.ArrayType(T.LongType()))]
    schema = T.StructType([*rows.schema.fields, *kept])
    out = rows.withColumns({"_d": F.array().cast("array<double>"), "_y": F.array().cast("array<double>"), "_at": F.array().cast("array<long>")})
    last = None
    for at in range(0, count, size):
        some = bank if last is None else bank.filter(F.col("row_idx") > last)
        block = some.select("row_idx", *[F.col(f).cast("double") for f in features], F.col(y).cast("double").alias("_target")).orderBy("row_idx").limit(size).collect()  # block_bytes at most
        places, values = np.array([r[0] for r in block], np.int64), np.array([r[1:] for r in block], np.float64)
        last = int(places[-1])
        told = rows.sparkSession.sparkContext.broadcast((places, values))

        def meet(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            places, values = told.value
            points, targets = values[:, :-1], values[:, -1]
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    b = whole.slice(start, ROWS)
                    x = matrix(b, features)
                    d = np.round(((x[:, None, :] - points[None]) ** 2).sum(axis=2), DIGITS) if len(features) * len(points) * ROWS < 1 << 24 else np.stack([np.round(((points - v) ** 2).sum(axis=1), DIGITS) for v in x])
                    dist, target, seen = [], [], []
                    old = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_d", "_y", "_at")]
                    for i in range(b.num_rows):
                        own = d[i]
                        few = np.argpartition(own, k - 1)[:k] if len(own) > k else np.arange(len(own))
                        few = np.flatnonzero(own <= own[few].max()) if len(few) else few  # with all ties of the last one
                        dd, yy, aa = np.append(old[0][i], own[few]), np.append(old[1][i], targets[few]), np.append(np.array(old[2][i], np.int64), places[few])
                        best = np.lexsort((aa, dd))[:k]
                        dist.append(dd[best].tolist())
                        target.append(yy[best].tolist())
                        seen.append(aa[best].tolist())
                    names = [n for n in b.schema.names if n not in ("_d", "_y", "_at")]
                    arrays = [b.column(b.schema.get_field_index(n)) for n in names]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(dist, pa.list_(pa.float64())), pa.array(target, pa.list_(pa.float64())), pa.array(seen, pa.list_(pa.int64()))], [*names, "_d", "_y", "_at"])

        out = arrow_map(out, meet, schema)
        if at + size < count:
            out = written(out)
    return out


def weighted(k: int):
    """The mean of the first k targets weighted by 1 / distance; where a distance is 0, the mean of those at 0."""
    d, y = F.slice("_d", 1, k), F.slice("_y", 1, k)
    w = F.transform(d, lambda v: 1 / F.sqrt(v))
    at0 = F.filter(F.arrays_zip(d.alias("d"), y.alias("y")), lambda p: p["d"] == 0)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean0 = add(F.transform(at0, lambda p: p["y"])) / F.size(at0)
    return F.when(F.size("_d") == 0, None).when(F.size(at0) > 0, mean0).otherwise(add(F.zip_with(w, y, lambda a, b: a * b)) / add(w))


def fit_knn(df: DataFrame, features: list[str], y: str, *, bank: int = 25_000, columns: int = 24, ks: tuple[int, ...] = (15, 50, 150)) -> tuple[DataFrame, dict[str, float]]:
    """(rows with `pred`, what was chosen): distance-weighted mean of the k nearest rows of a strided bank, in standardised columns.

    The first `columns` features take part, in deviations of the bank. Of `ks`, the one whose predictions of the inner validation rows correlate
    best with y is taken (the first of equals; fewer than 50 such rows: all are equal). One search serves every k.
    """
    some = features[:columns]
    rows = bank_rows(df, bank)
    m = moments(rows, some)
    sd = np.where(m.sd > 1e-12, m.sd, 1.0)
    scale = {f"_s{i}": (F.col(c) - float(a)) / float(s) for i, (c, a, s) in enumerate(zip(some, m.mean, sd))}
    n, held = rows.count(), list(scale)
    sizes = {r["seg"]: r["n"] for r in df.groupBy("seg").agg(F.count("*").alias("n")).collect()}
    tried = [min(k, max(2, n - 1)) for k in ks]
    found = nearest(df.withColumns(scale), rows.withColumns(scale).select("row_idx", *held, y), held, y, max(tried))
    out = found.withColumns({f"_p{i}": weighted(k) for i, k in enumerate(tried)}).drop(*held, "_d", "_y", "_at")
    last = max(sizes)
    valid = inner_valid(df, last, sizes[last], sum(sizes.values()))
    got = out.filter(valid).agg(F.count("*").alias("n"), *[pearson(f"_p{i}", y).alias(f"s{i}") for i in range(len(ks))]).first()
    scores = [got[f"s{i}"] if got["n"] >= 50 else 0.0 for i in range(len(ks))]
    best = max(range(len(ks)), key=lambda i: (scores[i], -i))
    return out.withColumn("pred", F.col(f"_p{best}")).drop(*[f"_p{i}" for i in range(len(ks))]), {"k": float(tried[best]), "score": float(scores[best])}
