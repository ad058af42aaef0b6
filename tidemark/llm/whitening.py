"""Embedding whitening by distributed block matrices.

Entries become whole numbers; each distinct vector counts once. Their exact sums give the mean; the centred vectors are indexed
into the row blocks of an MLlib BlockMatrix A, and A'A, by a transpose and a multiplication over blocks, is the scatter. The
driver takes its eigenvectors (a square matrix of the dimension, whatever the number of vectors). A second multiplication,
of A and the whitening matrix, projects the vectors, and a third one checks that what came out has the identity as covariance.

A multiplication of BlockMatrix holds the blocks of one of its partitions at a time, so their number follows the number of
blocks: the scatter splits its middle dimension (every split sums its own blocks, the small products are added), and for the
projection the row blocks are laid out as a square grid over a block-diagonal whitening matrix, because a grid is what
BlockMatrix deals out evenly. Block numbers are collected by MLlib on the driver: one for each `block_bytes` of vectors.

Cases: null vectors and those with null or non-finite entries are left out, and so are those with an entry of 2**40 or more. Vectors of
different lengths have no covariance: each length is fitted and whitened by itself, one after the other. An empty vector
has no components. Components whose eigenvalue is zero (below 1e-12 of the largest, as with fewer distinct vectors than
dimensions) have no whitened value and give no rows; so a single distinct vector gives none. Rows of repeated or
null ids are rows of their own. A deviation beyond a long is null. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, cut, ship, table
from tidemark.llm.graph import balanced_join

LIMIT = 1 << 40
#: Bytes of a block of doubles.
BLOCK_BYTES = 1 << 20
#: Blocks that a task of a multiplication holds, about.
HELD = 16
#: An eigenvalue below this share of the largest is zero.
ZERO = 1e-12


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, at, dim, key, x): the rows that remain; `key` is the SHA-256 of the whole numbers and `at` tells rows apart."""
    good = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LIMIT))  # false for NaN: it is larger than any number
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.col("vector").isNotNull() & good)
    v = v.select("id", F.monotonically_increasing_id().alias("at"), F.transform("vector", lambda c: F.floor(c.cast("double") * scale).cast("long") + shift).alias("x"))
    return v.select("id", "at", F.size("x").alias("dim"), F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256).alias("key"), "x")


def row_blocks(fit: DataFrame, n: int, sums: list[int], height: int) -> DataFrame:
    """(block, keys, deviations, data): the centred vectors, `height` to a block (the rest are rows of zeros), column by column."""
    dim = len(sums)
    total = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, keys, held = TaskContext.get().partitionId(), 0, [], []

        def made() -> pa.RecordBatch:
            x = np.concatenate(held)
            far = max(abs(int(x.max()) * n), abs(int(x.min()) * n)) + int(abs(total).max())
            d = x * n - total.astype(np.int64) if far * far * dim < 1 << 63 else x.astype(object) * n - total
            away = [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]
            a = np.zeros((height, dim))
            a[: len(x)] = d / n
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([keys], pa.list_(pa.string())), pa.array([away], pa.list_(pa.int64())), pa.array([a.tobytes("F")], pa.binary())], ["part", "chunk", "keys", "deviations", "data"])

        for b in batches:
            while b.num_rows:
                some, b = b.slice(0, height - len(keys)), b.slice(height - len(keys))
                keys += some.column(0).to_pylist()
                held.append(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                if len(keys) == height:
                    yield made()
                    chunk, keys, held = chunk + 1, [], []
        if keys:
            yield made()

    few = fit.select("key", "x").coalesce(max(1, -(-n // (2 * height))))  # the last block of a partition is padded: no partition of much less than a block
    made = cut(arrow_map(few, run, "part int, chunk int, keys array<string>, deviations array<long>, data binary"))
    before, at = {}, 0
    for r in made.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row per partition
        before[r["part"]], at = at, at + r["n"]
    offsets = made.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    return made.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("chunk")).alias("block"), "keys", "deviations", "data")


def block_matrix(blocks: DataFrame, height: int, width: int, count: int, across: int = 1) -> BlockMatrix:
    """The blocks one below the other, or in a grid `across` blocks wide."""
    parts = max(1, -(-count // HELD))
    laid = blocks.select("block", "data").repartition(parts).rdd.map(lambda r: ((r[0] // across, r[0] % across), DenseMatrix(height, width, np.frombuffer(r[1], "<f8"))))
    return BlockMatrix(laid, height, width, -(-count // across) * height, across * width)


def scatter(a: BlockMatrix, count: int) -> np.ndarray:
    """A'A of blocks that lie one below the other; the sum over blocks is split, which the Python call has no parameter for."""
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, max(1, -(-count // HELD)))
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def projected(blocks: DataFrame, count: int, height: int, weights: np.ndarray) -> DataFrame:
    """(block, data): every block times `weights`."""
    spark, (dim, k), across = blocks.sparkSession, weights.shape, int(np.ceil(np.sqrt(count)))
    ship(spark)
    a = block_matrix(blocks, height, dim, count, across)
    one = DenseMatrix(dim, k, weights.ravel("F"))
    diagonal = BlockMatrix(spark.sparkContext.parallelize(range(across), max(1, -(-across // HELD))).map(lambda g: ((g, g), one)), dim, k, across * dim, across * k)
    out = a.multiply(diagonal).blocks.map(lambda b: (int(b[0][0]) * across + int(b[0][1]), bytearray(b[1].toArray().tobytes("F"))))
    return cut(spark.createDataFrame(out, "block long, data binary"))


def whiten(vectors: DataFrame, *, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    rows = whole_vectors(vectors, id_col, vector_col, scale, shift)
    fit = cut(rows.groupBy("dim", "key").agg(F.count("*").alias("rows"), F.first("x").alias("x")))
    slim = cut(rows.select("id", "at", "key"))
    out = []
    for r in fit.filter("dim > 0").groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        part = whitened_length(fit.filter(F.col("dim") == r["dim"]), int(r["n"]), r["dim"], components, block_bytes)
        if part is not None:
            out.append(part)
    if not out:
        return slim.filter(F.lit(False)).select(F.col("id").alias("vec_id"), F.lit(0).alias("component"), *[F.lit(0).cast("long").alias(c) for c in ("n", "deviation")], *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    all_rows = balanced_join(slim, reduce(DataFrame.unionByName, out), ["key"], ["at"], "rows")
    return all_rows.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("c", "v")).select(
        F.col("id").alias("vec_id"), (F.col("c") + 1).alias("component"), "n", "deviation", "v.whitened", "v.explained", "identity_error"
    )


def whitened_length(fit: DataFrame, n: int, dim: int, components: int, block_bytes: int) -> DataFrame | None:
    """(key, rows, n, deviation, whitened, explained, identity_error) of the distinct vectors of one length; None where no component has a spread."""
    sums = {r["d"]: int(r["s"]) for r in fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}
    height = max(1, block_bytes // (8 * dim))
    height = min(height, -(-n // 2) + 1)
    blocks = cut(row_blocks(fit, n, [sums[d] for d in range(dim)], height))
    count = blocks.count()
    values, axes = np.linalg.eigh(scatter(block_matrix(blocks, height, dim, count), count) / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:components] > ZERO * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if not k:
        return None
    z = projected(blocks, count, height, axes[:, :k] / np.sqrt(values[:k]))
    mean = np.array(z.select("data").rdd.map(lambda r: np.frombuffer(r[0], "<f8").reshape(height, k, order="F").sum(axis=0)).treeAggregate(np.zeros(k), np.add, np.add)) / n
    error = float(np.abs(scatter(block_matrix(z, height, k, count), count) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = (values[:k] / values.sum()).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, away, data in zip(*(b.column(c).to_pylist() for c in range(3))):
                w = np.frombuffer(data, "<f8").reshape(height, k, order="F")[: len(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(away, pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))], ["key", "deviation", "whitened"])

    parts = max(1, -(-count // HELD))
    both = blocks.select("block", "keys", "deviations").join(z, "block").repartition(parts).select("keys", "deviations", "data")
    found = arrow_map(both, run, "key string, deviation long, whitened array<double>").join(fit.select("key", "rows"), "key")
    return cut(found.select("key", "rows", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*[F.lit(e) for e in explained]).alias("explained"), F.lit(error).alias("identity_error")))


def op12_query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
