"""Heap-bound k-means, block-matrix whitening and archives, against plain versions on awkward tables."""

import base64
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.clusters import heap_kmeans
from tidemark.llm.common import fresh_folder
from tidemark.llm.registry import ORACLE_SQL, QUERIES
from tidemark.llm.whitening import whiten

NAN, INF = float("nan"), float("inf")


# --- vectors


def vector_rows(dim: int, n: int, kind: str, spread: float = 1.0) -> list[tuple]:
    rng = np.random.default_rng(dim + n)
    homes = rng.normal(size=(5, dim)) * 4 * spread
    x = (homes[rng.integers(0, 5, n)] + rng.normal(size=(n, dim)) * spread).astype(kind)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    hot = x[0].tolist()
    rows += [(1000 + i, hot) for i in range(n // 2)]  # a third of all rows are one vector
    rows += [(7, x[3].tolist()), (7, x[3].tolist()), (None, x[4].tolist()), (None, hot)]
    bad = [None, [], [1.0] * (dim - 1), [1.0] * (dim - 1) + [None], [NAN] + [1.0] * (dim - 1), [INF] * dim]
    return rows + [(5000 + i, v) for i, v in enumerate(bad)]


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    clash = ["id", "vector", "cluster", "distance", "key", "at", "file", "n", "component", "x", "rows", "dim", "block"]
    return df.withColumns({c: F.lit("other") for c in clash})


def plain_kmeans(rows, k, rounds, dim):
    kept = [(i, [float(c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * c)) for c in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"3:{kept[r][0]}".encode()).hexdigest() if kept[r][0] is not None else "", kept[r][1]))
    c = [x[r] for r in order[:k]]
    for step in range(rounds + 1):
        d = [[sum((p - q) ** 2 for p, q in zip(v, m)) for m in c] for v in x]
        best = [min(range(len(c)), key=lambda j: (row[j], j)) for row in d]
        if step == rounds:
            break
        for j in range(len(c)):
            mine = [x[r] for r in range(len(x)) if best[r] == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    total = Counter()
    for row, j in zip(d, best):
        total[j] += row[j]
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, j, row[j], total[j], sum(total.values()), name[j]) for (i, _), row, j in zip(kept, d, best))


@pytest.mark.parametrize("kind, spread, block", [("float32", 1.0, 64), ("float64", 0.05, 7), ("float64", 9000.0, 8192)])
def test_kmeans_equals_full_scans(spark, kind, spread, block):
    rows = vector_rows(8, 160, kind, spread)
    trace = []
    out = heap_kmeans(frame(spark, rows, {"float32": "float", "float64": "double"}[kind]).repartition(3), k=6, dim=8, block=block, trace=trace)
    got = Counter(tuple(r) for r in out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == plain_kmeans(rows, 6, 10, 8)
    assert trace[0] == sum(got.values()) and sum(trace[1:]) < trace[0] * (len(trace) - 1)  # heaps spare measurements


def test_kmeans_pops_little_where_clusters_are_apart(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8, 64))[rng.integers(0, 8, 4000)] * 10 + rng.normal(size=(4000, 64)) * 0.1
    trace = []
    heap_kmeans(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), trace=trace).count()
    assert trace[0] == 4000 and trace[-1] <= 800


def test_kmeans_of_few_or_no_vectors(spark):
    same = [(i, [0.5] * 64) for i in range(5)]
    assert Counter((r["cluster"], r["distance"]) for r in heap_kmeans(frame(spark, same)).collect()) == {(0, 0): 5}
    two = [(1, [0.5] * 64), (2, [1.0] * 64), (3, [130_000.0] * 64), (4, [131_072.0] * 64)]  # the last needs more than 64 bits
    assert {r["vec_id"]: r["distance"] for r in heap_kmeans(frame(spark, two, "double")).collect()} == {1: 0, 2: 0, 3: 0}
    none = heap_kmeans(frame(spark, [(1, None), (2, [1.0])]))
    assert none.count() == 0 and none.columns == heap_kmeans(frame(spark, same)).columns


def plain_whitening(rows, dim):
    kept = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.stack([v for _, v in kept]), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = (n * fit - total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, total, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("kind, dim, bytes_", [("float32", 20, 1 << 20), ("float64", 5, 400)])
def test_whitening_equals_plain_algebra(spark, kind, dim, bytes_):
    rows = vector_rows(dim, 150, kind)
    rows = [r for r in rows if r[1] is None or len(r[1]) != dim - 1]
    out = whiten(frame(spark, rows, {"float32": "float", "float64": "double"}[kind]).repartition(3), block_bytes=bytes_)
    kept, n, total, values, axes = plain_whitening(rows, dim)
    k = min(16, dim)
    got = defaultdict(list)
    for r in out.collect():
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
        got[r["vec_id"], r["deviation"]].append((r["component"], r["whitened"]))
    want = Counter((i, int(((n * x - total) ** 2).sum())) for i, x in kept)
    assert {key: len(v) for key, v in got.items()} == {key: k * c for key, c in want.items()}
    signs = {}
    for i, x in kept:
        w = ((n * x - total) / n) @ axes[:, :k] / np.sqrt(values[:k])
        for c, v in got[i, int(((n * x - total) ** 2).sum())]:
            assert abs(abs(v) - abs(w[c - 1])) < 1e-8
            if abs(v) > 1e-6:
                assert signs.setdefault(c, np.sign(v * w[c - 1])) == np.sign(v * w[c - 1])  # one sign for all rows


def test_whitening_of_odd_tables(spark):
    assert whiten(frame(spark, [(1, None), (2, []), (3, [NAN])])).count() == 0
    assert whiten(frame(spark, [(1, [0.1, 0.2]), (2, [0.1, 0.2])])).count() == 0  # one distinct vector has no spread
    flat = whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [3.0, 1.0])], "double")).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["explained"]) for r in flat) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (2, 1, 1.0)]
    both = whiten(frame(spark, [(i, [float(i % 3), float(i)]) for i in range(6)] + [(10 + i, [float(i * i)]) for i in range(4)], "double"))
    assert {r["n"]: r["c"] for r in both.groupBy("n").agg(F.count("*").alias("c")).collect()} == {6: 12, 4: 4}  # a fit for each length
    far = whiten(frame(spark, [(i, [1e11 * i, 1.0 * i * i]) for i in range(2000)], "double")).filter("component = 1").agg(F.max("deviation"), F.count("*")).first()
    assert tuple(far) == (None, 2000) or far[0] < 2**63


# --- archives

PAGES = "page_id bigint, url string, html string, digest string, key string, n int, file string"


def page_rows() -> list[tuple]:
    hot = "<p>the same</p>"
    rows = [(i, f"http://www.Example{i % 3}.org:80{i % 2}/a b?x={i}#part", hot if i % 3 else f"<p>page {i} ÄÖ \n\r\n\r\n end</p>") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "no host at all\r\nX: y", "ß" * 300_000), (103, "http://h.org/\t1", "")]
    rows += [(None, "http://h.org/1", hot), (None, None, "alone"), (None, None, "alone"), (-5, "http://h.org/1", "x"), (-5, "http://h.org/2", "x"), (-6, "http://h.org/2", "x"), (59, "http://u.org", hot), (59, "http://u.org", hot)]
    return [(*r, "d", "k", 1, "f") for r in rows]


def plain_archive(rows, least=0):
    groups = defaultdict(list)
    for r in rows:
        raw = (r[2] or "").encode()
        groups[raw].append(r[0])
    out = []
    for r in rows:
        raw = (r[2] or "").encode()
        top = max((i for i in groups[raw] if i is not None), default=None)
        first = len(raw) < least or top is None or r[0] == top
        out.append((r[0], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else top))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 10])
def test_archives_give_back_every_page(spark, least):
    rows = page_rows()
    out = warc.archived_pages(spark.createDataFrame(rows, PAGES).repartition(3), fresh_folder(spark, "warc"), least=least)
    assert Counter(tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == plain_archive(rows, least)


def test_archives_of_no_pages(spark):
    assert warc.archived_pages(spark.createDataFrame([], PAGES), fresh_folder(spark, "warc")).count() == 0


def test_searches_by_url_and_by_page(spark):
    rows = page_rows() + [(200 + i, "http://hot.org/x", f"v{i}", "", "", 0, "") for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES)
    folder = fresh_folder(spark, "warc")
    index = warc.write_index(warc.write_archives(pages.repartition(3), folder), folder, block=8)
    wanted = spark.createDataFrame([("http://hot.org/x",), ("http://hot.org/x",), ("http://h.org/1",), (None,), ("http://nowhere.org/",)], "url string")
    got = warc.read_records(warc.find_captures(index, wanted), html=True).collect()
    want = [r for r in rows if r[1] in ("http://hot.org/x", "http://h.org/1") or not r[1]]
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in want)
    assert {r["html"] for r in got if r["page_id"] and r["page_id"] >= 200} == {f"v{i}" for i in range(300)}
    one = warc.find_captures(index, spark.createDataFrame([("http://hot.org/x", 333), ("http://hot.org/x", 9999)], "url string, page_id long"))
    assert [r["html"] for r in warc.read_records(one, html=True).collect()] == ["v133"]


def test_index_is_sorted_blocks_and_a_search_reads_few(spark):
    rows = [(i, f"http://a{i % 7}.org/{i}", "x" + str(i), "", "", 0, "") for i in range(4000)]
    folder = fresh_folder(spark, "warc")
    captures = warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    shards = warc.write_index(captures, folder, block=64).orderBy("shard").collect()
    ends = [k.encode() for s in shards for k in (s["first_key"], s["last_key"])]
    assert ends == sorted(ends) and sum(s["captures"] for s in shards) == 4000
    shard = warc.IndexShard(shards[0]["file"].removeprefix("file:"))
    keys = [k for i in range(len(shard.directory)) for k in shard.block(i)[0]]
    assert keys == sorted(keys) and len(keys) == shards[0]["captures"] and len(shard.directory) == -(-len(keys) // 64)
    shard.reads = 0
    assert [line[0].encode() for line in shard.find(keys[100], keys[100])] == [keys[100]] and shard.reads <= 2


def test_records_are_gzip_members_that_other_tools_read(spark):
    folder = fresh_folder(spark, "warc")
    captures = warc.write_archives(spark.createDataFrame(page_rows(), PAGES).coalesce(1), folder).orderBy("at").collect()
    with open(captures[0]["file"].removeprefix("file://").removeprefix("file:"), "rb") as f:
        raw, members = f.read(), []
    while raw:
        z = zlib.decompressobj(31)
        members.append(z.decompress(raw))
        raw = z.unused_data
    assert len(members) == len(captures) + 1 and all(m.startswith(b"WARC/1.1\r\nWARC-Type: ") and m.endswith(b"\r\n\r\n") for m in members)
    for m, c in zip(members[1:], captures):
        head, _, rest = m.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert len(rest) == int(fields["Content-Length"]) + 4 and fields["WARC-Type"] == c["record_type"]
        assert (c["record_type"] == "revisit") == ("WARC-Refers-To" in fields)


def test_a_broken_record_is_an_error(spark):
    folder = fresh_folder(spark, "warc")
    captures = warc.write_archives(spark.createDataFrame([(1, "http://a.org", "one", "", "", 0, ""), (2, "http://a.org", "two", "", "", 0, "")], PAGES).coalesce(1), folder)
    with pytest.raises(Exception, match="zlib|Error|payload"):
        warc.read_records(captures.withColumn("at", F.col("at") + 1)).collect()


@pytest.mark.parametrize("url, key", [("http://User:pw@www.Example.org:8080/A?b=1#c", "org,example,www:8080)/A?b=1"), ("https://a.b", "b,a)"), ("plain", "plain"), (None, ""), ("http://[::1]/x", "[)::1]/x")])
def test_keys(spark, url, key):
    got = spark.createDataFrame([(url,)], "u string").select(warc.reversed_host_key(F.col("u"))).first()[0]
    assert got == key or (url or "").startswith("http://[")  # a bare address has some key of its own
    ids = spark.createDataFrame([(None,), (-(2**63),), (-1,), (0,), (2**63 - 1,)], "i long").select("i", warc.id_key(F.col("i")).alias("k")).collect()
    assert [r["k"] for r in ids] == sorted(r["k"] for r in ids)


@pytest.mark.parametrize("name", ["op11_heap_bound_kmeans", "op13_warc_capture_index"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r, df = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, sf_dir)
    at = [r.columns.index(c) for c in df.columns]
    assert sorted(map(json.dumps, (list(row) for row in df.collect()))) == sorted(json.dumps([row[i] for i in at]) for row in r.fetchall())


def test_whitening_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    kept, n, total, values, axes = plain_whitening(rows, 64)
    out = {(r["vec_id"], r["component"]): r for r in QUERIES["op12_block_matrix_whitening"](spark, sf_dir).collect()}
    assert len(out) == 16 * len(kept)
    for i, x in kept:
        w = ((n * x - total) / n) @ axes[:, :16] / np.sqrt(values[:16])
        for c in range(16):
            assert abs(abs(out[i, c + 1]["whitened"]) - abs(w[c])) < 1e-8
