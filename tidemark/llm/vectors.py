"""Embedding near-duplicates by cross-polytope hashing.

A vector is scaled to length one and turned by three rounds of random signs and a fast Walsh-Hadamard
transform; its hash is the axis it is nearest to, with its sign. A table joins `hashes` such hashes; there are
`tables` of them. Multiprobe: besides its own bucket, a vector also looks into the buckets reached by
taking the second-nearest axis instead. Vectors that meet in a bucket, with equal labels, are candidates;
their cosine is then computed in double precision and kept from `threshold` on.

Equal vectors (same label and components) are one class and are compared once. Buckets larger than `BLOCK`
rows are dealt out as pairs of hash blocks, each a matrix product in one task. A pair counts in the first table
where the two meet only, so counts of links can be added up without a list of all pairs; what leaves a task is
a number per vector and a spanning forest of its links.

Cases: a null, zero or empty vector, or one with null or non-finite components, and vectors without a label
link with nothing; vectors of different lengths have no cosine and do not link; rows with the same id are one
node; a null id has no links and a null component; an empty table gives an empty table; other columns
are not read. Vectors in the same direction but not equal link like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, column, cut, sliced, table
from tidemark.llm.graph import components, salted_join

BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows (their length a power of two), by butterflies."""
    x, h = x.copy(), 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x / np.sqrt(x.shape[1])


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and transform: close to a random rotation, in n log n steps."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size))
    return x


def bucket_codes(x: np.ndarray, tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(own, probes): own (rows, tables) codes, and (rows, tables, hashes) codes of the neighbouring buckets."""
    own, probes = [], []
    for t in range(tables):
        first, second = [], []
        for h in range(hashes):
            y = rotated(x, 1000 * t + h)
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
            if order.shape[1] < 2:
                order = np.repeat(order, 2, axis=1)
            sign = np.take_along_axis(y, order, axis=1) < 0
            axis = (2 * order + sign).astype(np.int64)
            first.append(axis[:, 0])
            second.append(axis[:, 1])
        width = 2 * (1 << max(0, (x.shape[1] - 1).bit_length()))
        code = lambda parts: sum(p * width**i for i, p in enumerate(parts))
        own.append(code(first))
        probes.append(np.stack([code([*first[:h], second[h], *first[h + 1 :]]) for h in range(hashes)], axis=1))
    return np.stack(own, axis=1), np.stack(probes, axis=1)


def unit_rows(vectors: list) -> tuple[np.ndarray, list[int]]:
    """Rows of length one, and which they are, of the valid vectors (all of one length)."""
    keep, rows = [], []
    for i, v in enumerate(vectors):
        if not v or any(x is None for x in v):
            continue
        a = np.array(v, np.float64)
        size = np.sqrt((a * a).sum())
        if np.isfinite(a).all() and np.isfinite(size) and size > 0:
            keep.append(i)
            rows.append(a)
    return rows, keep


def hashed(classes: DataFrame, tables: int, hashes: int) -> DataFrame:
    """(id, label, dim, mult, vector, own, probes): the valid vectors with their codes."""

    kind = classes.schema["vector"].dataType.elementType.simpleString()
    arrow_kind = {"float": pa.float32()}.get(kind, pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2048):
            rows, keep = unit_rows(column(b, "vector"))
            dims = sorted({len(r) for r in rows})
            for dim in dims:
                at = [j for j, r in enumerate(rows) if len(r) == dim]
                x = np.array([rows[j] for j in at])
                own, probes = bucket_codes(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), tables, hashes)
                part = b.take(pa.array([keep[j] for j in at]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1).cast(pa.int64()), pa.array(np.full(len(at), dim), pa.int32()), part.column(2),
                        pa.array(x.tolist(), pa.list_(arrow_kind)), pa.array(own.tolist(), pa.list_(pa.int64())), pa.array(probes.reshape(len(at), -1).tolist(), pa.list_(pa.int64())),
                    ],
                    ["id", "label", "dim", "mult", "vector", "own", "probes"],
                )

    return arrow_map(classes.select("id", "label", "mult", "vector"), run, f"id long, label long, dim int, mult long, vector array<{'float' if kind == 'float' else 'double'}>, own array<long>, probes array<long>")


def linked_in_buckets(rows: DataFrame, tables: int, hashes: int, threshold: float) -> DataFrame:
    """(a, b, n): per vector a the weight n of its links found in a bucket, and links (a, b) of a spanning forest (n = 0).

    rows: (label, dim, tab, code, part, side, probe, id, mult, vector), one bucket part after the other. Codes are computed
    again for the rows that have a link: most rows of most buckets have none, and vectors are all that is sent.
    """

    def meet(own1: np.ndarray, pro1: np.ndarray, own2: np.ndarray, pro2: np.ndarray) -> np.ndarray:
        """Per row pair and table, whether the two meet: equal buckets, or one probes the other's."""
        hit = own1 == own2
        for h in range(hashes):
            hit |= (pro1[:, h::hashes] == own2) | (own1 == pro2[:, h::hashes])
        return hit

    def joined(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tab, code = t.column("tab")[0].as_py(), t.column("code")[0].as_py()
        ids, side, probe, mult = (t.column(c).to_numpy() for c in ("id", "side", "probe", "mult"))
        x = np.stack(t.column("vector").to_numpy()).astype(np.float64)
        size = np.sqrt((x * x).sum(axis=1))
        cos = (x @ x.T) / size[:, None] / size[None, :]
        i, j = np.nonzero(np.triu(cos >= threshold - 1e-9, 1))
        if not len(i):
            return
        exact = (x[i] * x[j]).sum(axis=1) / (size[i] * size[j]) >= threshold
        i, j = i[exact & (ids[i] != ids[j])], j[exact & (ids[i] != ids[j])]
        ok = ~(probe[i] & probe[j])  # one of the two lives here
        if side.any():
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        if not len(i):
            return
        some = np.unique(np.concatenate([i, j]))
        codes = bucket_codes(x[some] / size[some, None], tables, hashes)
        own, pro = np.zeros((len(x), tables), np.int64), np.zeros((len(x), tables * hashes), np.int64)
        own[some], pro[some] = codes[0], codes[1].reshape(len(some), -1)
        for at in range(0, len(i), 200_000):
            a, b = i[at : at + 200_000], j[at : at + 200_000]
            hit = meet(own[a], pro[a], own[b], pro[b])
            # The first table where they meet; there, own bucket of the first vector in id order that is met in.
            here = hit.argmax(axis=1) == tab
            a, b = a[here], b[here]
            low, high = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
            # A pair may meet in both its own buckets of a table: it counts where the smaller id lives, if the other comes there.
            comes = (own[high, tab] == own[low, tab]) | (pro[high][:, tab * hashes : (tab + 1) * hashes] == own[low, tab][:, None]).any(axis=1)
            there = np.where(comes, own[low, tab], own[high, tab]) == code
            low, high = low[there], high[there]
            if not len(low):
                continue
            n = np.bincount(low, mult[high], len(ids)) + np.bincount(high, mult[low], len(ids))
            hit_ids = np.flatnonzero(n)
            forest, root = [], list(range(len(ids)))

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for u, v in zip(low.tolist(), high.tolist()):
                ru, rv = find(u), find(v)
                if ru != rv:
                    root[rv] = ru
                    forest.append((u, v))
            f = np.array(forest)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit_ids]), pa.nulls(len(hit_ids), pa.int64()), pa.array(n[hit_ids].astype(np.int64))], ["a", "b", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[f[:, 0]]), pa.array(ids[f[:, 1]]), pa.array(np.zeros(len(f), np.int64))], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        names = ["label", "dim", "tab", "code", "part"]
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in names], axis=1)
            cuts = (np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1).tolist()
            for at, end in zip([0, *cuts], [*cuts, b.num_rows]):
                k = tuple(cols[at])
                if held and k != key:
                    if sum(p.num_rows for p in held) > 1:
                        yield from joined(pa.Table.from_batches(held))
                    held = []
                key = k
                held.append(b.slice(at, end - at))
        if held and sum(p.num_rows for p in held) > 1:
            yield from joined(pa.Table.from_batches(held))

    return arrow_map(rows, run, "a long, b long, n long")


def embedding_links(vectors: DataFrame, *, threshold: float = 0.93, tables: int = 10, hashes: int = 2, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    v = v.withColumn("key", F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), F.sha2(F.to_json(F.struct("vector")), 256)))
    some = v.filter("key is not null").dropDuplicates(["id", "label", "key"])
    classes = cut(some.groupBy("label", "key").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("vector").alias("vector")))
    rows = cut(hashed(classes, tables, hashes))

    # A row in its own bucket and in those it probes; only buckets with two rows or more go on.
    own = F.transform("own", lambda c, t: F.struct(t.cast("int").alias("tab"), c.alias("code"), F.lit(False).alias("probe")))
    probes = F.transform("probes", lambda c, t: F.struct(F.floor(t / hashes).cast("int").alias("tab"), c.alias("code"), F.lit(True).alias("probe")))
    spots = rows.select("id", "label", "dim", F.explode(F.concat(own, probes)).alias("s")).select("id", "label", "dim", "s.*")
    spot = ["label", "dim", "tab", "code"]
    spots = spots.groupBy("id", *spot).agg(F.min("probe").alias("probe"))
    counts = spots.groupBy(*spot).agg(F.count("*").alias("n"), F.sum((~F.col("probe")).cast("int")).alias("homes")).filter("n > 1 and homes > 0")
    counts = counts.select(*spot, F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / block)).cast("int").alias("blocks"))
    counts = counts.withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    spots = salted_join(spots, counts, spot, ["id"])
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int")
    spots = spots.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    spots = spots.withColumn("side", side).withColumn("part", F.least("mine", "other").cast("long") * 1_000_000 + F.greatest("mine", "other"))
    data = rows.select("id", "label", "mult", "vector")
    full = spots.select("id", *spot, "part", "side", "probe").join(data, ["id", "label"])
    full = full.repartition(*spot, "part").sortWithinPartitions(*spot, "part", "id")
    found = cut(linked_in_buckets(full, tables, hashes, threshold))

    # Copies of one vector link with each other, and with whatever their class links with.
    members = salted_join(some.select("label", "key", "id"), classes.select("label", "key", F.col("id").alias("rep"), "mult"), ["label", "key"], ["id"])
    good = rows.select(F.col("id").alias("rep"), "label").distinct()
    members = cut(members.join(good, ["rep", "label"]).select("id", "rep", "mult"))
    weight = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    edges = found.filter("b is not null").select("a", "b").unionByName(members.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    comps = components(edges)
    degree = salted_join(members, weight, ["rep"], ["id"], "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = v.select("id").join(degree, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
    comp = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"))


def op3_query(spark, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
