"""Exact Jaccard join of word-shingle sets: pivots, windows, recursion.

Jaccard distance is a metric on sets; two documents link when theirs is at most r = 1 - percent / 100. Most documents of a
corpus share nothing: their distance to each other, and to almost any pivot, is 1, so pivot documents alone cannot
divide it. What lies within reach of anything at all is therefore found by shingles first, and pivots work where distances differ:

1. sets that are equal (distance 0) meet in one class, by a 128-bit hash of the set;
2. documents that share a min-hash form a region with the smallest id as its pivot document, and are compared with that: a
   group of near copies of any size becomes one component by one comparison a document;
3. every set goes to the regions of its first shingles in one order of all (very common shingles last, then by hash): a
   partner within r shares one of the first n - ceil((1 - r) * n) + 1, so any linked pair meets in a region. Documents
   of different components are compared there, if sizes, places in the order and sketches (the parities of the shingles in
   128 to 2048 places: unlike parities are a lower bound of the shingles in one set only) allow a link;
4. a group of near copies of which no one links with all is thinned: in a region of more than `SMALL` rows a row is first paired with a few
   others only, and the region's rows are kept. Once those pairs are verified, most of the group is one component, and the next round, with twice
   as many partners, finds the rest. After `ROUNDS`, or a round without a link, what is kept is joined pair by pair;
5. a region with more than `REGION` rows is then divided by a pivot document, taken from its largest component. Exact distances to
   the pivot are computed; by the triangle inequality linked documents differ by r at most in them, so a document goes to the ring of
   width r that it lies in and is replicated to the next. Rings that hold one component (those around the pivot's
   copies) are done. What lies at 4 r or more from the pivot is divided again by a pivot of its own, `LEVELS` times; what is
   left after that is cut by windows of set size and pairs of hash blocks. Each part is joined in the same way, so no
   task holds an unbounded region.

Candidate pairs are verified on the full shingle sets, rebuilt from the texts. Components are then closed over all links.
Shingles are compared by 64-bit hashes (polynomials over bytes, mixed by word): the result is exact but for collisions of those.

Cases: a null text and a text without words have an empty set and link with nothing; fewer words than the
shingle length are one shingle; rows with the same id are one node with the links of all its rows; a null id
links with nothing and has a null component; very long texts are read whole; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, column, cut, release, sliced, table
from tidemark.llm.graph import components, salted_join
from tidemark.llm.quality import word_bounds

#: Levels of pivots in a large region.
LEVELS = 3
#: Documents that are compared with one pivot in one task.
PARTNERS = 4096
#: At most this many common shingles are sent to the tasks (8 bytes each).
FREQUENT = 1 << 18
#: Rows of a region, or part of one, that are joined in one piece.
REGION = 4096
#: Rows of a region of which all pairs are written at once, partners that a row of a larger one gets in the first round, rounds.
SMALL, EACH, ROUNDS = 8, 2, 4
#: Rows of a region of more than REGION rows among which a row's partners of one round are sought.
STEPS = 256
BANDS = 3
#: Bits of a set's sketch at most.
SKETCH_BITS = 2048
#: Bits of the filter that spares texts of documents without a candidate pair the shuffle (1 MB).
FILTER_BITS = 23
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M[1]
    h = (h ^ (h >> np.uint64(27))) * _M[2]
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    got = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        got.append(np.cumprod(steps))
    if n <= 1 << 21:  # those of a very long text are not kept
        _powers[:] = got
    return got[0], got[1]


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Per text the distinct shingles as sorted 64-bit hashes; A-Z count as a-z. All texts are hashed in one go."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends = word_bounds(data)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    # A word's polynomial in its own places: the sum between its ends, shifted back to place 0.
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    # Which words belong to which text: texts begin one byte behind the end of the last one.
    limits = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    acc = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k if len(acc) else 0):
        acc = (acc ^ words[i : len(words) - k + 1 + i]) * _M[i % len(_M)] + np.uint64(k)
    acc, out = mixed(acc), []
    for at, end in zip(limits[:-1].tolist(), limits[1:].tolist()):
        if end - at >= k:
            own = acc[at : end - k + 1]
        else:
            one = np.zeros(1, np.uint64)
            for w in words[at:end]:
                one = (one ^ w) * _M[0] + np.uint64(end - at)
            own = mixed(one)[: end > at]
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
    return out


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    return shingle_sets([text], k)[0]


def set_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of some documents at a time, about a megabyte of text each."""
    for b in sliced(batches):
        ids, texts = column(b, "doc_id"), column(b, "text")
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > 1_000_000 or i == len(texts) - 1:
                yield ids[at : i + 1], shingle_sets(texts[at : i + 1], k)
                at, size = i + 1, 0


def compare(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, int]:
    """Of non-empty sorted sets: whether 100 * intersection >= percent * union, and their distance in whole steps of r."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return 100 * both >= percent * union, 100 * (union - both) // ((100 - percent) * union) if percent < 100 else int(both < union)


def set_hash(s: np.ndarray) -> tuple[int, int, int]:
    """(size, 128-bit hash) of a set."""
    return len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s * _M[6]).sum(dtype=np.uint64).view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """The parity of a set's shingles in each of 128 to 2048 places, about one place a shingle; half of it folded on the other is a sketch of half the size."""
    bits = min(SKETCH_BITS, max(128, 1 << (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches of some rows (None: unknown), as one matrix for each size that is asked for."""

    def __init__(self, held: list[bytes | None]):
        self.held, self.sizes, self.made = held, np.array([len(h or b"") // 8 for h in held], np.int64), {}

    def folded(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of every row in the matrix, matrix): all sketches of `words` words or more, folded to that size."""
        if words not in self.made:
            spot, rows = np.full(len(self.held), -1), []
            for size in np.unique(self.sizes[self.sizes >= words]).tolist():
                at = np.flatnonzero(self.sizes == size)
                x = np.frombuffer(b"".join(self.held[i] for i in at.tolist()), np.uint64).reshape(len(at), size)
                while x.shape[1] > words:
                    half = x.shape[1] // 2
                    x = x[:, :half] ^ x[:, half:]
                spot[at] = np.arange(len(at)) + sum(map(len, rows))
                rows.append(x)
            self.made[words] = spot, np.concatenate(rows)
        return self.made[words]

    def may_link(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the sets of rows a and b may differ in at most `most` shingles: places of unlike parity hold one such shingle at least."""
        out = np.ones(len(a), bool)
        least = np.minimum(self.sizes[a], self.sizes[b])
        for words in np.unique(least[least > 0]).tolist():
            spot, x = self.folded(words)
            for at in np.array_split(np.flatnonzero(least == words), 1 + int((least == words).sum()) * words // 1_000_000):
                out[at] = np.bitwise_count(x[spot[a[at]]] ^ x[spot[b[at]]]).sum(axis=1, dtype=np.int64) <= most[at]
        return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, s1, s2, bands, sketch) of every document: set size, 128-bit set hash, min-hashes, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in set_batches(batches, k):
            rows = []
            for s in sets:
                bands = [int((s * m).min().view(np.int64)) for m in _M[3 : 3 + BANDS]] if len(s) else []
                rows.append((*set_hash(s), bands, sketch(s) if len(s) else None))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.binary())], ["doc_id", "n", "s1", "s2", "bands", "sketch"])

    return arrow_map(docs, run, "doc_id long, n long, s1 long, s2 long, bands array<long>, sketch binary")


#: (sorted hashes, order class of each): shingles that come behind all others, by class.
Common = tuple[np.ndarray, np.ndarray]
NONE: Common = (np.zeros(0, np.uint64), np.zeros(0, np.int8))


def places(common: Common, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the shingles are common, their places in the table)."""
    if not len(common[0]):
        return np.zeros(len(s), bool), np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
    return common[0][at] == s, at


def counted_shingles(docs: DataFrame, k: int, low: float, high: float, crowded: Common | None = None, least: int = 8) -> Common:
    """The shingles of at least `least` documents with hashes in [low, high) of their range, the FREQUENT most common if there are more.

    Some thousands of documents are counted at a time, and what only one of them holds is not handed on: a count is a lower
    bound, and close to the truth for what is common. With `crowded`, only documents count of which more than three tenths of the shingles below `low` are common in it.
    """
    bounds = [np.uint64(min(x, 1.0) * float(2**64 - 2049)) for x in (low, high)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(held), return_counts=True)
            g, n = g[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int32))], ["g", "n"])

        for _, sets in set_batches(batches, k):
            for s in sets:
                at, end = np.searchsorted(s, bounds)
                if crowded is None or 10 * int(places(crowded, s[:at])[0].sum()) > 3 * at:
                    held.append(s[at : end if high < 1 else len(s)])
            if sum(map(len, held)) > 1_000_000:
                yield counted()
                held = []
        if held:
            yield counted()

    counts = arrow_map(docs, run, "g long, n int").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = list(counts.orderBy(F.desc("n"), "g").limit(FREQUENT).toLocalIterator())
    g = np.array([r["g"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(g)
    return g[order], np.log2(np.array([r["n"] for r in rows], float) + 1)[order].astype(np.int8)


def common_shingles(docs: DataFrame, k: int, percent: int) -> Common:
    """Shingles that many documents hold; they come last in the order, the most common at the very end.

    Windows are made of a set's first (1 - t) shingles by hash, so half as much again of the hash range is counted for all
    documents. Where more than a third of those are common, windows reach further, and such documents (copies, and texts
    that are mostly shared passages) are counted over the rest of the range too. Which shingles are found never changes
    a result, as any one order for all sets is right.
    """
    low = 1.5 * (1 - percent / 100)
    first = counted_shingles(docs, k, 0.0, low)
    if low >= 1 or not len(first[0]):
        return first
    rest = counted_shingles(docs, k, low, 1.0, first)
    return np.concatenate([first[0], rest[0]]), np.concatenate([first[1], rest[1]])


def region_rows(docs: DataFrame, common: Common, k: int, percent: int) -> DataFrame:
    """(g, doc_id, n, pos): every set in the regions of its window; of equal sets that a task reads, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for ids, sets in set_batches(batches, k):
            g, doc, n, pos = [], [], [], []
            if len(seen) > 200_000:
                seen.clear()
            for d, s in zip(ids, sets):
                if not len(s) or d is None:
                    continue
                size = len(s)
                if (own := set_hash(s)) in seen:
                    continue
                seen.add(own)
                keep = size - -(-percent * size // 100) + 1
                late, at = places(common, s)
                if late.any():
                    behind = s[late]
                    s = np.concatenate([s[~late], behind[np.argsort(common[1][at[late]], kind="stable")]])
                g.append(s[:keep])
                doc.append(np.full(keep, d))
                n.append(np.full(keep, size))
                pos.append(np.arange(keep))
            if g:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g).view(np.int64)), pa.array(np.concatenate(doc).astype(np.int64)), pa.array(np.concatenate(n).astype(np.int32)), pa.array(np.concatenate(pos).astype(np.int32))], ["g", "doc_id", "n", "pos"])

    return arrow_map(docs, run, "g long, doc_id long, n int, pos int")


def shared_regions(rows: DataFrame) -> DataFrame:
    """The rows of regions with two rows or more: a stream over sorted partitions that holds one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_out = None, True
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            same = g[1:] == g[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if last is not None and last.column(0)[0].as_py() == g[0]:
                keep[0] = True
                if not last_out:
                    yield last
            if keep.any():
                yield b.filter(pa.array(keep))
            last, last_out = b.slice(b.num_rows - 1), bool(keep[-1])

    return arrow_map(rows.repartition("g").sortWithinPartitions("g"), run, "g long, doc_id long, n int, pos int")


def pairs_of(key: np.ndarray, t: dict[str, np.ndarray], percent: int, sketches: Sketches, each: int | None = None, limit: int = REGION) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, keys): pairs (smaller id, larger id) within equal keys that may be similar: other component, sizes, places and sketches within bounds.

    key: sorted. Rows are compared with the next row, the next but one and so on, for all regions at once. With `each`, a row of
    a region of more than SMALL rows ends with that many partners behind it, and the keys of regions where a row did are returned.
    """
    doc, n, pos, comp, block = (t[c].astype(np.int64) for c in ("doc_id", "n", "pos", "comp", "block"))
    out, at, step = [], np.arange(len(key)), 0
    room, ended = None, np.zeros(len(key), bool)
    if each:
        _, own, size = np.unique(key, return_inverse=True, return_counts=True)
        room, over = np.where(size > min(SMALL, limit), each, len(key))[own], (size > limit)[own]
    while True:
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        if room is not None:
            stop = (room[at] == 0) | (over[at] & (step > STEPS))
            ended[at[stop]] = True
            at = at[~stop]
        if not len(at):
            break
        a, b = at, at + step
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        need = -(-percent * (small + large) // (100 + percent))
        may = np.minimum(n[a] - pos[a], n[b] - pos[b])  # this shingle, if it is the first common one, and all behind it
        ok = (comp[a] != comp[b]) & (may >= need) & (100 * small >= percent * large) & ((block[a] == 0) | (block[a] != block[b]))
        ok[ok] = sketches.may_link(a[ok], b[ok], (small + large - 2 * need)[ok])
        if ok.any():
            x, y = doc[a[ok]], doc[b[ok]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if room is not None:
                room[a[ok]] -= 1
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64), np.unique(key[ended])


def region_pairs(rows: DataFrame, percent: int, limit: int | None = REGION, each: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows left): the candidate pairs of regions of at most `limit` rows, and the rows of the larger ones.

    rows: (g, part, doc_id, n, pos, comp, block, sketch); a region is (g, part). With block 1 and 2 in a part, only pairs across count.
    With `each`, regions of any size give some of their pairs, at most that many for a row or, up to SMALL rows, all; left are the rows of
    those that may have more. Rows stand in an order by hash of the id, the same in all regions and another for each `each`.
    """
    schema = "a long, b long, g long, part long, doc_id long, n int, pos int, comp long, block int, sketch binary"

    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def leave(b: pa.Table) -> list[pa.RecordBatch]:
            filled = [pa.nulls(b.num_rows, pa.int64())] * 2 + [b.column(i).cast(t) for i, t in enumerate(kinds[2:])]
            return pa.table(filled, names=names).to_batches()

        def joined(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Rows of whole regions: regions of one component are done, those over the limit are left, the others joined."""
            g, part, comp = (t.column(i).to_numpy() for i in (0, 1, 5))
            first = np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])])
            key = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            mixed_up = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
            size = np.diff(np.append(starts, len(g)))
            large = mixed_up & (size > limit) if limit and not each else np.zeros(len(size), bool)
            if large.any():
                yield from leave(t.filter(pa.array(large[key])))
            now = (mixed_up & ~large)[key]
            if not now.any():
                return
            made, more = written(t, key, np.flatnonzero(now))
            yield from made
            if len(more):
                yield from leave(t.filter(pa.array(np.isin(key, more))))

        def written(t: pa.Table, key: np.ndarray, at: np.ndarray) -> tuple[list[pa.RecordBatch], np.ndarray]:
            if each:
                order = mixed(t.column("doc_id").to_numpy()[at].view(np.uint64) * _M[6] + np.uint64(each))
                at = at[np.lexsort((order, key[at]))]
            held = t.column("sketch").take(pa.array(at)).to_pylist()
            p, more = pairs_of(key[at], {c: t.column(c).to_numpy()[at] for c in ("doc_id", "n", "pos", "comp", "block")}, percent, Sketches(held), each, limit or REGION)
            return [pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])] + [pa.nulls(len(p), k) for k in kinds[2:]], names)] if len(p) else [], more

        def piece(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A piece of a region far over the limit: its rows are left, whatever the other pieces hold."""
            t = pa.Table.from_batches(batches)
            yield from leave(t)
            if each:
                yield from written(t, np.zeros(t.num_rows, np.int64), np.arange(t.num_rows))[0]

        held: list[pa.RecordBatch] = []
        passing = None  # a region far over the limit, handed on as it comes
        for b in batches:
            if not b.num_rows:
                continue
            g, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            last = int(np.flatnonzero((g != g[-1]) | (part != part[-1]))[-1]) + 1 if (g[0], part[0]) != (g[-1], part[-1]) else 0
            if passing is not None:
                same = int(((g == passing[0]) & (part == passing[1])).sum())
                if same:
                    yield from piece([b.slice(0, same)])
                if same == b.num_rows:
                    continue
                b, last, passing = b.slice(same), max(0, last - same), None
            if last:
                yield from joined(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
            if limit and sum(x.num_rows for x in held) > 4 * limit + 100_000:
                passing = (g[-1], part[-1])
                yield from piece(held)
                held = []
        if held:
            yield from joined(pa.Table.from_batches(held))

    cols = ["g", "part", "doc_id", "n", "pos", "comp", "block", "sketch"]
    got = cut(arrow_map(rows.select(*cols).repartition("g", "part").sortWithinPartitions("g", "part"), run, schema))
    return got.filter("a is not null").select("a", "b").distinct(), got.filter("a is null").select(*cols)


def mixed_regions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the regions that hold more than one component."""
    sizes = rows.groupBy(*keys).agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("rows")).filter("least <> most")
    return salted_join(rows, sizes.select(*keys, "rows"), keys, ["doc_id"], rows="rows")


def block_pairs(rows: DataFrame, percent: int, region: int) -> DataFrame:
    """The candidate pairs of regions (g, part) of any size: windows of set size, then pairs of hash blocks.

    Documents of a part's largest component need no comparison with each other: the others are
    compared with each of its blocks, and among themselves.
    """
    # Partners differ by one step at most, so a row goes to its own window and the next.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent * 1.0001))).cast("long")
    rows = rows.withColumn("window", F.explode(F.array(step, step + 1))).withColumn("part", F.xxhash64("part", "window")).drop("window")
    pairs, large = region_pairs(rows, percent, region)
    if large.isEmpty():
        return pairs
    keys = ["g", "part"]
    large = cut(mixed_regions(large.distinct(), keys))
    half = max(1, region // 4)
    comps = large.groupBy(*keys, "comp").agg(F.count("*").alias("c"))
    top = comps.groupBy(*keys).agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("most"), F.sum("c").alias("rows"))
    top = top.select(*keys, "top", F.ceil(F.col("most") / half).cast("int").alias("n_top"), F.greatest(F.lit(1), F.ceil((F.col("rows") - F.col("most")) / half)).cast("int").alias("n_rest"), "rows")
    dealt = salted_join(large.withColumnRenamed("block", "half"), top, keys, ["doc_id"], rows="rows")
    main = F.col("comp") == F.col("top")
    own = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.when(main, F.col("n_top")).otherwise(F.col("n_rest"))).cast("int")
    dealt = dealt.withColumn("main", main).withColumn("own", own)
    # Blocks of the largest component are met by every block of the rest; blocks of the rest meet each other.
    rest = lambda f, n: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    spot = lambda kind, a, b, side: F.struct(F.xxhash64(F.col("part"), F.lit(kind), a, b).alias("to"), side.alias("block"))
    side = lambda o: F.when(F.col("own") == o, 0).when(F.col("own") < o, 1).otherwise(2)
    with_rest = rest(lambda o: spot("main", F.col("own"), o, F.lit(1)), "n_rest")
    with_main = rest(lambda o: spot("main", o, F.col("own"), F.lit(2)), "n_top")
    among = rest(lambda o: spot("rest", F.least("own", o), F.greatest("own", o), side(o)), "n_rest")
    dealt = dealt.withColumn("spots", F.when(F.col("main"), with_rest).otherwise(F.concat(with_main, among)))
    dealt = dealt.select("g", "doc_id", "n", "pos", "comp", "sketch", F.explode("spots").alias("s"))
    dealt = dealt.select("g", F.col("s.to").alias("part"), "doc_id", "n", "pos", "comp", F.col("s.block").alias("block"), "sketch")
    return pairs.unionByName(region_pairs(dealt, percent, None)[0])


def ring_pairs(rows: DataFrame, docs: DataFrame, k: int, percent: int, region: int, levels: int) -> DataFrame:
    """The candidate pairs of large regions (g, doc_id, n, pos, comp, sketch if known), by pivot documents and rings around them."""
    rows = rows if "sketch" in rows.columns else rows.withColumn("sketch", F.lit(None).cast("binary"))
    plain = lambda df: df.select("g", F.lit(0).cast("long").alias("part"), "doc_id", "n", "pos", "comp", F.lit(0).alias("block"), "sketch")
    found, left = rows.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0), rows
    for _ in range(levels):
        live = cut(mixed_regions(left.distinct(), ["g"]))
        if live.isEmpty():
            return found
        comps = live.groupBy("g", "comp").agg(F.count("*").alias("c"), F.min("doc_id").alias("p"))
        pivots = comps.groupBy("g").agg(F.max_by("p", F.struct("c", "comp")).alias("p"), F.sum("c").alias("rows"))
        asked = salted_join(live, pivots, ["g"], ["doc_id"], rows="rows")
        far = compared(cut(asked.select(F.col("p").alias("a"), F.col("doc_id").alias("b")).distinct()), docs, k, percent)
        far = far.select(F.col("a").alias("p"), F.col("b").alias("doc_id"), "near", "far")
        placed = cut(asked.join(far, ["p", "doc_id"]))
        # Rings 0 to 3 are home; ring 4 meets ring 3 only, and goes on with the rest.
        home = F.col("near") <= 3
        rings = placed.withColumn("part", F.explode(F.sequence("near", F.col("far") + 1))).filter(F.col("part") <= 4)
        rings = rings.select("g", F.col("part").cast("long").alias("part"), "doc_id", "n", "pos", "comp", F.when(F.col("part") < 4, 0).when(home, 1).otherwise(2).alias("block"), "sketch")
        pairs, large = region_pairs(rings, percent, region)
        found = found.unionByName(pairs)
        if not large.isEmpty():
            found = found.unionByName(block_pairs(cut(mixed_regions(large.distinct(), ["g", "part"])), percent, region))
        left = placed.filter("far >= 4").select("g", "doc_id", "n", "pos", "comp", "sketch")
        pairs, large = region_pairs(plain(left), percent, region)
        found, left = found.unionByName(pairs), large.select("g", "doc_id", "n", "pos", "comp", "sketch")
    live = cut(mixed_regions(left.distinct(), ["g"]))
    return found if live.isEmpty() else found.unionByName(block_pairs(plain(live), percent, region))


def candidate_pairs(rows: DataFrame, docs: DataFrame, k: int, percent: int, region: int = REGION, levels: int = LEVELS) -> DataFrame:
    """All candidate pairs of (g, doc_id, n, pos, comp, sketch), regions divided until each part fits a task."""
    plain = rows.select("g", F.lit(0).cast("long").alias("part"), "doc_id", "n", "pos", "comp", F.lit(0).alias("block"), "sketch")
    pairs, large = region_pairs(plain, percent, region)
    if large.isEmpty():
        return pairs
    large = large.select("g", "doc_id", "n", "pos", "comp", "sketch")
    more = ring_pairs(large, docs, k, percent, region, levels)
    return pairs.unionByName(more).distinct()


def only_needed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that stand in a pair, and a few others: a fixed-size bit filter, so texts are not shuffled for nothing."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("bit"))
    words = ids.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in words.collect():  # 2^(FILTER_BITS - 6) rows at most
        bits[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            hit = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            if hit.any():
                yield b.filter(pa.array(hit.astype(bool))).select([0, 1])

    rows = docs.filter("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("bit"))
    return arrow_map(rows, run, "doc_id long, text string")


def compared(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked, near, far) of every pair whose documents have shingles: whether full sets of the two are similar, and their least and
    greatest distance in steps of r (an id with several rows has several sets).

    A text is sent once per pair and once per part of its pivot's pairs; the number of parts follows the number of pairs.
    """
    texts = cut(only_needed(docs, pairs))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts")).filter("parts > 1")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    keyed = pairs.join(F.broadcast(parts), "a", "left").select("a", "b", part.alias("part"))
    right = keyed.join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
    left = keyed.select("a", "part").distinct().join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    rows = left.select("a", "part", F.lit(None).cast("long").alias("b"), "text").unionByName(right.select("a", "part", "b", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets = None, []
        for b in sliced(batches):
            found = []
            texts = column(b, "text")
            for a, p, other, s in zip(*(column(b, c) for c in ("a", "part", "b")), shingle_sets(texts, k)):
                if (a, p) != key:
                    key, sets = (a, p), []
                if not len(s):
                    continue
                if other is None:
                    sets.append(s)
                elif sets:
                    got = [compare(x, s, percent) for x in sets]
                    found.append((a, other, any(g[0] for g in got), min(g[1] for g in got), max(g[1] for g in got)))
            if found:
                a, other, linked, near, far = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(other, pa.int64()), pa.array(linked), pa.array(near, pa.int32()), pa.array(far, pa.int32())], ["a", "b", "linked", "near", "far"])

    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    got = arrow_map(dealt, run, "a long, b long, linked boolean, near int, far int")
    return got.groupBy("a", "b").agg(F.max("linked").alias("linked"), F.min("near").alias("near"), F.max("far").alias("far"))


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar."""
    return compared(pairs, docs, k, percent).filter("linked").select("a", "b")


def joined_components(rows: DataFrame, comps: DataFrame, docs: DataFrame, k: int, percent: int, region: int = REGION, levels: int = LEVELS) -> DataFrame:
    """(node, component) of all links: those of `comps` and those between rows (g, doc_id, n, pos, comp, sketch) of a region.

    Rounds of thinned regions first, each with the components of the one before, so that pairs within a component that has
    been found are never written; then every pair that is left.
    """

    def grown(pairs: DataFrame) -> tuple[DataFrame, bool]:
        pairs = cut(pairs)
        if pairs.isEmpty() or (far := cut(verified(pairs, docs, k, percent))).isEmpty():
            return comps, False
        return components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(far)), True

    left = rows.select("g", F.lit(0).cast("long").alias("part"), "doc_id", "n", "pos", "comp", F.lit(0).alias("block"), "sketch")
    for i in range(ROUNDS):
        pairs, left = region_pairs(left, percent, region, EACH << i)
        comps, found = grown(pairs)
        if left.isEmpty():
            return comps
        left = left.join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("comp", F.coalesce("component", "comp")).drop("component")
        if not found:
            break
    return grown(candidate_pairs(left, docs, k, percent, region, levels))[0]


def jaccard_components(docs: DataFrame, *, k: int = 5, percent: int = 80, region: int = REGION, levels: int = LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = cut(signatures(docs, k))
    common = common_shingles(docs, k, percent)
    some = sets.filter("n > 0 and doc_id is not null")

    # Equal sets.
    classes = some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("a"), F.count("*").alias("rows")).filter("rows > 1").select("s1", "s2", "n", "a")
    equal = salted_join(some.select("s1", "s2", "n", F.col("doc_id").alias("b")), classes, ["s1", "s2", "n"], ["b"]).filter("a <> b").select("a", "b")

    # Documents with a common min-hash, against the smallest id of those.
    keys = some.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "s1", "s2", F.posexplode("bands").alias("band", "key"))
    pivots = keys.groupBy("band", "key").agg(F.min(F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))).alias("p"), F.max("b").alias("z"))
    pivots = pivots.filter("z <> p.a").select("band", "key", "p.*")
    near = salted_join(keys, pivots, ["band", "key"], ["b"])
    near = near.filter("a <> b and not (s1 = p1 and s2 = p2 and na = nb)").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    # Copies of one text need one comparison with a pivot.
    near = near.groupBy("a", "s1", "s2", "nb").agg(F.min("b").alias("b")).select("a", "b").distinct()
    equal = cut(equal.distinct())
    close = cut(verified(cut(near), docs, k, percent))
    linked = equal.unionByName(close)
    comps = components(linked)
    release(docs.sparkSession)

    # Regions: documents of different components only, and of equal sets the first (if each of the ids has one row).
    several = some.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    copies = equal.select(F.col("b").alias("doc_id")).distinct().join(several, "doc_id", "left_anti").withColumn("copy", F.lit(True))
    known = comps.select(F.col("node").alias("doc_id"), F.col("component").alias("comp")).join(copies, "doc_id", "left")
    rows = shared_regions(region_rows(docs, common, k, percent))
    # An id with several rows has several sets: no sketch speaks for all of them.
    sketches = some.groupBy("doc_id").agg(F.when(F.count("*") == 1, F.first("sketch")).alias("sketch"))
    known = sketches.join(known, "doc_id", "left")
    rows = rows.join(known, "doc_id", "left").filter("copy is null").withColumn("comp", F.coalesce("comp", "doc_id"))
    final = joined_components(rows, comps, docs, k, percent, region, levels)
    out = sets.join(final, sets["doc_id"] == final["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
