"""Exact integer k-means with heap-ordered bounds.

Vectors are packed once into blocks: a task writes its blocks of whole numbers to a file of its own in the shared folder
and hands over one row per block. A block keeps, for each cluster, a heap of its vectors by gap, the distance to the
second-nearest centroid less that to the nearest. When centroids move, a cluster's offset grows by its own drift and the
largest drift of any other; a gap above its offset proves that the assignment still holds. A round pops the vectors
whose gap has expired, and only those, reads them, measures them exactly and pushes them where they belong. A block
in which nothing expires is not read at all.

Sums per cluster are kept by differences: a block returns what its moved vectors add and take, Spark adds these up, and
the driver holds k centroids (k times the dimension numbers) and nothing else. Every round is written to the shared
checkpoint folder; block files carry names of their own, so a repeated task leaves unused files at most.

Distances are whole numbers, exact in 64 bits. Gaps are lowered by more than their rounding error, so ties and near-ties
are always measured, and the smaller number wins a tie as it would in a full scan.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out, and so are those with a
component of 2**27 / scale or more (131,072 for the default), whose distances need more than 64 bits. With fewer kept vectors
than k there are as many centroids as vectors. Rows of a repeated id are rows of their own; the starting order breaks ties of
an id by the vector, null ids come last. Equal centroids: the smaller number takes all. An empty table gives an empty table;
other columns are not read. An inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, cut, fresh_folder, table
from tidemark.llm.tokenfile import file_system

#: Vectors of a block.
BLOCK = 8192
#: What a block is between rounds: `at` and `n` say where in its file; `clusters` and `heaps` are raw arrays; the rest is what the last round changed.
STATE = "file string, at long, n int, kind string, clusters binary, sizes array<int>, gaps binary, places binary, sums array<long>, counts array<long>, popped long"
LIMIT = 1 << 27


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, vector) of the rows that take part."""
    good = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LIMIT / scale))  # false for NaN: it is larger than any number
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter((F.size("vector") == dim) & good)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale).astype(np.int64)


def flat(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pack(kept: DataFrame, folder: str, dim: int, scale: int, k: int, block: int) -> DataFrame:
    """The blocks (see STATE), unassigned: ids (with a byte that tells nulls) and whole numbers, in the smallest kind that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        name, out, at, held, n = f"vectors-{uuid.uuid4().hex}", None, 0, [], 0

        def written() -> pa.RecordBatch:
            nonlocal out, at, held, n
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}")
            ids = pa.chunked_array([h[0] for h in held])
            x = np.concatenate([h[1] for h in held])
            most = max(-int(x.min()), int(x.max()) + 1) if x.size else 1
            kind = "<i2" if most <= 1 << 15 else "<i4"
            raw = ids.fill_null(0).to_numpy().astype("<i8").tobytes() + ids.is_null().to_numpy().astype("u1").tobytes() + x.astype(kind).tobytes()
            row = [[f"{folder}/{name}"], [at], [n], [kind], [np.full(n, -1, "<i4").tobytes()], [[0] * k], [b""], [b""], [[0] * (k * dim)], [[0] * k], [0]]
            out.write(raw)
            at, held, n = at + len(raw), [], 0
            return state_batch(row)

        for b in batches:
            for lo in range(0, b.num_rows, block):
                some = b.slice(lo, block)
                while some.num_rows:
                    part = some.slice(0, block - n)
                    held.append((part.column(0), whole(flat(part, "vector", dim), scale)))
                    n, some = n + part.num_rows, some.slice(part.num_rows)
                    if n == block:
                        yield written()
        if n:
            yield written()
        if out is not None:
            out.close()

    return cut(arrow_map(kept, run, STATE))


def state_batch(row: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names = [c.split(" ") for c in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(row, names)], [c for c, _ in names])


class BlockFile:
    """The blocks of one file at a time."""

    def __init__(self, dim: int):
        self.dim, self.name, self.file = dim, None, None

    def open(self, name: str):
        if name != self.name:
            store, path = file_system(name)
            self.name, self.file = name, store.open_input_file(path)
        return self.file

    def vectors(self, name: str, at: int, n: int, kind: str, places: np.ndarray | None = None) -> np.ndarray:
        """The vectors at `places` (rising) of a block, or all: few are read one by one, many with all between them."""
        width = np.dtype(kind).itemsize * self.dim
        start, file = at + 9 * n, self.open(name)
        if places is not None and len(places) * 16 < n:
            raw = b"".join(file.read_at(width, start + int(p) * width) for p in places)
            return np.frombuffer(raw, kind).reshape(-1, self.dim)
        x = np.frombuffer(file.read_at(n * width, start), kind).reshape(-1, self.dim)
        return x if places is None else x[places]

    def ids(self, name: str, at: int, n: int) -> pa.Array:
        raw = self.open(name).read_at(9 * n, at)
        return pa.array(np.frombuffer(raw, "<i8", n), mask=np.frombuffer(raw, "u1", n, 8 * n).astype(bool))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, (rows, k): by floats where every sum stays below 2**53, else in 64-bit integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    a = x.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(blocks: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """The blocks after a round: expired vectors popped, measured and pushed; `sums` and `counts` hold what that changed."""
    k, dim = centroids.shape

    def step(files: BlockFile, file, at, n, kind, clusters, sizes, gaps, places) -> list:
        cluster = np.frombuffer(clusters, "<i4").copy()
        gaps, places = np.frombuffer(gaps, "<f8"), np.frombuffer(places, "<i4")
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        heaps: list = [(gaps[a:b], places[a:b]) for a, b in zip(cuts, cuts[1:])]
        popped: list[int] = list(range(n)) if n and cluster[0] < 0 else []
        for j in range(k):
            if sizes[j] and heaps[j][0][0] <= offsets[j]:
                heap = list(zip(*(a.tolist() for a in heaps[j])))
                while heap and heap[0][0] <= offsets[j]:
                    popped.append(heapq.heappop(heap)[1])
                heaps[j] = heap
        if not popped:
            return [file, at, n, kind, clusters, sizes, gaps.tobytes(), places.tobytes(), [0] * (k * dim), [0] * k, 0]
        rows = np.sort(np.array(popped))
        x = files.vectors(file, at, n, kind, rows)
        d = squared(x, centroids)
        new = d.argmin(axis=1)
        best = np.sqrt(d[np.arange(len(d)), new].astype(np.float64))
        if k > 1:
            d[np.arange(len(d)), new] = np.iinfo(np.int64).max
            second = np.sqrt(d.min(axis=1).astype(np.float64))
        else:
            second = np.full(len(d), np.inf)
        key = second - best + offsets[new]
        key -= 1e-9 * (1 + best + np.where(np.isfinite(second), second, 0) + offsets[new])
        for j in range(k):
            mine = new == j
            if mine.any():
                if isinstance(heaps[j], tuple):
                    heaps[j] = list(zip(*(a.tolist() for a in heaps[j])))
                fresh = list(zip(key[mine].tolist(), rows[mine].tolist()))
                if len(fresh) * 8 > len(heaps[j]):
                    heaps[j] += fresh
                    heapq.heapify(heaps[j])
                else:
                    for item in fresh:
                        heapq.heappush(heaps[j], item)
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        old = cluster[rows]
        for j in range(k):
            for sign, hit in ((1, (new == j) & (old != j)), (-1, (old == j) & (new != j))):
                sums[j] += sign * x[hit].astype(np.int64).sum(axis=0)
                counts[j] += sign * int(hit.sum())
        cluster[rows] = new
        arrays = [h if isinstance(h, tuple) else (np.array([g for g, _ in h], "<f8"), np.array([p for _, p in h], "<i4")) for h in heaps]
        return [file, at, n, kind, cluster.astype("<i4").tobytes(), [len(a[0]) for a in arrays], np.concatenate([a[0] for a in arrays]).astype("<f8").tobytes(), np.concatenate([a[1] for a in arrays]).astype("<i4").tobytes(), sums.ravel().tolist(), counts.tolist(), len(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = BlockFile(dim)
        for b in batches:
            for row in b.to_pylist():
                yield state_batch([[v] for v in step(files, *(row[c] for c in ("file", "at", "n", "kind", "clusters", "sizes", "gaps", "places")))])

    return cut(arrow_map(blocks, run, STATE))


def changes(blocks: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What a round added to the sums (k, dim) and counts (k) as Python integers, and how many vectors were popped."""
    sums, counts = np.zeros((k, dim), object), np.zeros(k, object)
    both = blocks.select(F.posexplode(F.concat("sums", "counts", F.array("popped"))).alias("at", "v"))
    found = {r["at"]: int(r["v"]) for r in both.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    for i in range(k * dim):
        sums[divmod(i, dim)] = found.get(i, 0)
    for j in range(k):
        counts[j] = found.get(k * dim + j, 0)
    return sums, counts, found.get(k * dim + k, 0)


def starting(kept: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k kept vectors with the smallest hashes of `seed:id`, as whole numbers."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(order.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([whole(np.array(r["vector"], np.float64), scale) for r in rows], np.int64)


def heap_kmeans(vectors: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", trace: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that takes part.

    trace: a list that gets, per round, how many vectors were measured.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, dim, scale)
    centroids = starting(kept, k, seed, scale)
    k = len(centroids)
    if not k:
        none: list[Column] = [F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")]
        return kept.filter(F.lit(False)).select(*none)
    blocks = pack(kept, fresh_folder(spark, "vector-blocks"), dim, scale, k, block)
    offsets, sums, counts = np.zeros(k), np.zeros((k, dim), object), np.zeros(k, object)
    for at in range(rounds + 1):
        blocks = assign(blocks, centroids, offsets)
        added, moved, popped = changes(blocks, k, dim)
        sums, counts = sums + added, counts + moved
        if trace is not None:
            trace.append(popped)
        if at == rounds:
            break
        new = np.array([[int(s) // int(c) for s in sums[j]] if (c := counts[j]) else centroids[j].tolist() for j in range(k)], np.int64)
        drift = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
        if not drift.any():
            break  # all further rounds would find the same
        others = np.array([max([drift[i] for i in range(k) if i != j], default=0.0) for j in range(k)])
        offsets, centroids = offsets + drift + others, new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = BlockFile(dim)
        for b in batches:
            for r in b.select(["file", "at", "n", "kind", "clusters"]).to_pylist():
                cluster = np.frombuffer(r["clusters"], "<i4")
                x = files.vectors(r["file"], r["at"], r["n"], r["kind"])
                d = squared(x, centroids)[np.arange(len(x)), cluster]
                yield pa.RecordBatch.from_arrays([files.ids(r["file"], r["at"], r["n"]), pa.array(cluster, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    out = cut(arrow_map(blocks, run, "vec_id long, cluster int, distance long"))
    total = F.expr("try_cast(sum(cast(distance as decimal(38,0))) as long)")
    names = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    found = out.groupBy("cluster").agg(total.alias("cluster_inertia")).join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    return out.join(F.broadcast(found), "cluster").join(F.broadcast(out.agg(total.alias("inertia")))).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_query(spark, sf_dir: str) -> DataFrame:
    return heap_kmeans(table(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Plain k-means: every round measures every vector against every centroid, in doubles that hold whole numbers."""
    parts = [
        f"with v0 as (select vec_id, embedding as e from embeddings where len(embedding) = {dim})",
        "v as materialized (select vec_id, list_transform(e, lambda c: floor(1024 * c::double)) as x from v0 where len(list_filter(e, lambda c: c is not null and isfinite(c::double))) = len(e))",
        f"c0 as materialized (select (row_number() over (order by sha256('3:' || vec_id)) - 1)::int as cluster, x as c from v order by sha256('3:' || vec_id) limit {k})",
    ]
    for r in range(rounds + 1):
        parts += [
            f"d{r} as (select vec_id, x, cluster, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) as d from v, c{r})",
            f"a{r} as materialized (select vec_id, any_value(x) as x, min(struct_pack(d := d, cluster := cluster)) as best from d{r} group by vec_id)",
            f"m{r} as (select cluster, pos, floor(sum(x) / count(*)) as m from (select best.cluster as cluster, unnest(generate_series(1, {dim})) as pos, unnest(x) as x from a{r}) group by cluster, pos)",
            f"c{r + 1} as materialized (select c.cluster, coalesce(g.c, c.c) as c from c{r} c left join (select cluster, list(m order by pos) as c from m{r} group by cluster) g on g.cluster = c.cluster)",
        ]
    parts.append(f"h as (select cluster, sha256(array_to_string(list_transform(c, lambda i: i::bigint), ',')) as centroid_sha256 from c{rounds})")
    return ", ".join(parts) + f""" select vec_id, best.cluster as cluster, best.d::bigint as distance, (sum(best.d) over (partition by best.cluster))::bigint as cluster_inertia, (sum(best.d) over ())::bigint as inertia, centroid_sha256
from a{rounds} join h on h.cluster = best.cluster"""


OP11_SQL = _op11_sql()
