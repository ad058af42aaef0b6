"""WARC archives of pages, with a two-level capture index.

Every task writes its pages to a WARC file of its own, a gzip member per record. Of pages with equal payloads, the one with
the largest id is a response, the others are revisit records that name it and hold no payload. The captures are then
sorted by key (the URL with its host reversed, and the page id) over all files: a range partition per index shard. A shard is
a file of compressed blocks of sorted captures and a sparse directory that has the first key of each block and where it lies.

A read goes the other way. A key is searched in the shards' first and last keys (two per shard), then, in the shard, by
binary search in the directory; one block is read and unpacked for it, in which it is searched again; what is found
says where the record lies, and that range of the archive is read. Keys are dealt to shards and sorted first, so neighbours share a block.

Files are written in the shared folder under names of their own, and handed over in rows when complete: a repeated task leaves
unused files at most. Texts go from the table to the archive, and through a shuffle only if Spark decides for one in the join with the
payloads that occur more than once; captures are some hundred bytes each.

Cases: a null html is an empty payload; a null URL is the key of an empty one; null page ids come before all numbers; the pages of an
id and payload that occur repeatedly are all responses if that is the largest id of the payload. With `least` bytes, smaller payloads are all
responses. In the archive, spaces and control characters of a URL are percent-encoded. Very long pages are one record, held by one
task. An empty table gives no files and no rows; other columns are not read. A record that doesn't fit its digest or length raises ValueError.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, column, cut, fresh_folder, sliced, table
from tidemark.llm.tokenfile import file_system

#: Captures in a block of the index.
BLOCK = 512
CAPTURE = "key string, file string, at long, size long, page_id long, record_type string, digest string"
SHARD = "shard int, file string, first_key string, last_key string, captures long"
PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Bytes read at once from an archive where records follow each other.
RANGE = 1 << 20


def reversed_host_key(url: Column) -> Column:
    """`org,example,www:8080)/path?query` of `http://www.example.org:8080/path?query#part`; what has no host stays as it is, null is empty."""
    host = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]+)?([^#]*)"
    name = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, host, 1)), r"\.")), ",")
    key = F.concat(name, F.regexp_extract(url, host, 2), F.lit(")"), F.regexp_extract(url, host, 3))
    return F.coalesce(F.when(F.regexp_extract(url, host, 1) != "", key).otherwise(url), F.lit(""))


def id_key(page_id: Column) -> Column:
    """A page id as 20 characters that sort like the numbers; null sorts first."""
    return F.coalesce(F.lpad((page_id.cast("decimal(20,0)") + F.expr("9223372036854775808BD").cast("decimal(20,0)")).cast("string"), 20, "0"), F.lpad(F.lit(""), 20, " "))


def capture_key(url: Column, page_id: Column) -> Column:
    return F.concat(reversed_host_key(url), F.lit("\t"), id_key(page_id))


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def packed(head: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def unpacked(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record fields, HTTP fields, payload) of a gzip member."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    fields = lambda lines: dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
    record = fields(head)
    http, _, payload = rest[: int(record["Content-Length"])].partition(b"\r\n\r\n")
    return record, fields(http), payload


def write_archives(pages: DataFrame, folder: str, *, least: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The captures (see CAPTURE): one row per page, which says in which archive its record lies, and where."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    same = p.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("response"))
    same = cut(same.filter("n > 1 and response is not null").select("digest", "response"))
    p = p.join(same, "digest", "left").withColumn("key", capture_key(F.col("url"), F.col("page_id"))).select("page_id", "url", "html", "response", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(folder)
        name, out, at = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in sliced(batches):
            if out is None and b.num_rows:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}", compression=None)
                raw = packed([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                out.write(raw)
                at = len(raw)
            rows: list[list] = [[] for _ in range(7)]
            for page, url, html, response, key in zip(*(column(b, c) for c in ("page_id", "url", "html", "response", "key"))):
                payload = html.encode()
                digest = base32_sha1(payload)
                revisit = response is not None and page != response
                kind = "revisit" if revisit else "response"
                head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", quote(url or "", safe="".join(map(chr, range(33, 127))))), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if page is not None:
                    head.append(("Page-ID", str(page)))
                if revisit:
                    head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(response, digest)), ("Refers-To-Page-ID", str(response))]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                raw = packed(head, http if revisit else http + payload)
                out.write(raw)
                for to, v in zip(rows, (key, f"{folder}/{name}", at, len(raw), page, kind, digest)):
                    to.append(v)
                at += len(raw)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)], [c.split(" ")[0] for c in CAPTURE.split(", ")])
        if out is not None:
            out.close()

    return cut(arrow_map(p, run, CAPTURE))


def write_index(captures: DataFrame, folder: str, *, block: int = BLOCK) -> DataFrame:
    """The index's shards (see SHARD), in order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, top = file_system(folder)
        shard, name = TaskContext.get().partitionId(), f"index-{uuid.uuid4().hex}"
        out, at, n, lines, first, last, directory = None, 0, 0, [], None, None, []

        def flush() -> None:
            nonlocal at, lines
            raw = zlib.compress(json.dumps(lines, ensure_ascii=False).encode(), 6)
            out.write(raw)
            directory.append([lines[0][0], at, len(raw)])
            at, lines = at + len(raw), []

        for b in batches:
            for line in zip(*(column(b, c) for c in ("key", "file", "at", "size"))):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out, first = store.open_output_stream(f"{top}/{name}.captures"), line[0]
                lines.append(line)
                last, n = line[0], n + 1
                if len(lines) == block:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with store.open_output_stream(f"{top}/{name}.directory") as f:
            f.write(zlib.compress(json.dumps(directory, ensure_ascii=False).encode(), 6))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([first]), pa.array([last]), pa.array([n], pa.int64())], [c.split(" ")[0] for c in SHARD.split(", ")])

    dealt = captures.select("key", "file", "at", "size").repartitionByRange("key", "file", "at").sortWithinPartitions("key", "file", "at")
    return cut(arrow_map(dealt, run, SHARD))


class IndexShard:
    """A shard of the index: its directory is held, its blocks are read when they are asked for."""

    def __init__(self, file: str):
        store, path = file_system(file)
        with store.open_input_stream(f"{path}.directory") as f:
            self.directory = json.loads(zlib.decompress(f.read()))
        self.firsts = [d[0].encode() for d in self.directory]
        self.blocks, self.held, self.reads = store.open_input_file(f"{path}.captures"), (None, [], []), 0

    def block(self, i: int) -> tuple[list[bytes], list[list]]:
        if self.held[0] != i:
            lines = json.loads(zlib.decompress(self.blocks.read_at(self.directory[i][2], self.directory[i][1])))
            self.held, self.reads = (i, [line[0].encode() for line in lines], lines), self.reads + 1
        return self.held[1], self.held[2]

    def find(self, low: bytes, high: bytes) -> Iterator[list]:
        """The captures with low <= key <= high."""
        at = max(0, bisect.bisect_left(self.firsts, low) - 1)  # a key may begin in the block before
        while at < len(self.firsts) and self.firsts[at] <= high:
            keys, lines = self.block(at)
            for i in range(bisect.bisect_left(keys, low), bisect.bisect_right(keys, high)):
                yield lines[i]
            at += 1


def find_captures(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, at, size, key) of the captures of the keys in `wanted`: (url) gives all of a URL, (url, page_id) those of the page.

    A wanted key that occurs repeatedly counts once; one without a capture gives no row. A URL whose captures fill several shards is
    searched in each of them by a task of its own.
    """
    shards = [(r["file"], r["first_key"].encode(), r["last_key"].encode()) for r in index.orderBy("shard").collect()]  # two keys per partition of the index
    lasts = [s[2] for s in shards]
    one = "page_id" in wanted.columns
    if one:
        asked = wanted.select(capture_key(F.col("url"), F.col("page_id")).alias("low")).distinct().withColumn("high", F.col("low"))
    else:
        key = reversed_host_key(F.col("url"))
        asked = wanted.select(F.concat(key, F.lit("\t")).alias("low"), F.concat(key, F.lit("\t~")).alias("high")).distinct()

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for low, high in zip(column(b, "low"), column(b, "high")):
                at = bisect.bisect_left(lasts, low.encode())
                while at < len(shards) and shards[at][1] <= high.encode():
                    out.append((at, low, high))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], ["shard", "low", "high"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for b in sliced(batches):
            found = []
            for shard, low, high in zip(*(column(b, c) for c in ("shard", "low", "high"))):
                if shard != held[0]:
                    held = (shard, IndexShard(shards[shard][0]))
                for line in held[1].find(low.encode(), high.encode()):
                    found.append(line)
                    if len(found) == 10_000:
                        yield batch_of(found)
                        found = []
            yield batch_of(found)

    def batch_of(found: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["key", "file", "at", "size"])

    dealt = arrow_map(asked, spots, "shard int, low string, high string").repartition(max(1, min(10_000, len(shards))), "shard").sortWithinPartitions("shard", "low")
    return arrow_map(dealt, search, "key string, file string, at long, size long")


def read_records(captures: DataFrame, html: bool = False) -> DataFrame:
    """The pages (see PAGE) whose records lie where `captures` (file, at, size) says, with column `html` if asked for; null for revisits.

    Captures are sorted by place, so records that follow each other are read as one range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, buffer, start = None, None, b"", 0
        for b in sliced(batches):
            rows: list[list] = [[] for _ in range(7)]
            places = list(zip(*(column(b, c) for c in ("file", "at", "size"))))
            for i, (path, at, size) in enumerate(places):
                if path != name:
                    store, inner = file_system(path)
                    name, file, buffer, start = path, store.open_input_file(inner), b"", 0
                if at < start or at + size > start + len(buffer):
                    end, j = at + size, i + 1
                    while j < len(places) and places[j][:2] == (path, end) and end - at < RANGE:
                        end, j = end + places[j][2], j + 1
                    buffer, start = file.read_at(end - at, at), at
                record, http, payload = unpacked(buffer[at - start : at - start + size])
                digest, kind, length = record["WARC-Payload-Digest"].removeprefix("sha1:"), record["WARC-Type"], int(http["Content-Length"])
                if kind == "response" and (base32_sha1(payload) != digest or len(payload) != length):
                    raise ValueError(f"{path} at {at}: the payload is not the one recorded")
                whole = lambda k: int(record[k]) if k in record else None
                for to, v in zip(rows, (whole("Page-ID"), record["WARC-Target-URI"], length, digest, kind, whole("Refers-To-Page-ID"), payload.decode() if html and kind == "response" else None)):
                    to.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = [*(c.split(" ")[0] for c in PAGE.split(", ")), "html"]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)][: 6 + html], names[: 6 + html])

    dealt = captures.select("file", "at", "size").repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return arrow_map(dealt, run, PAGE + ", html string" * html)


def archived_pages(pages: DataFrame, folder: str, *, least: int = 0) -> DataFrame:
    """Every page, written to archives in `folder`, and read back by a search for its key in the index."""
    index = write_index(write_archives(pages, folder, least=least), folder)
    return read_records(find_captures(index, pages.select("url", "page_id")))


def op13_query(spark, sf_dir: str) -> DataFrame:
    found = archived_pages(table(spark, sf_dir, "pages"), fresh_folder(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: The digest's 160 bits, twenty at a time (five hex digits), as four base32 digits each.
_B32 = "array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (i // 4) * 5, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '')"
OP13_SQL = f"""with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
m as (select *, max(page_id) over (partition by h) as top, octet_length(encode(html)) as n from p)
select page_id, n::bigint as payload_bytes, {_B32} as payload_digest, case when top is null or page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from top then top end as refers_to, coalesce(url, '') as url from m"""
