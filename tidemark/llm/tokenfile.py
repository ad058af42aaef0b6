"""Token-id files with a minimal perfect hash index.

Documents are range-partitioned by id, so that the shards' order is the ids' order; a text is encoded, the end
id put behind it, and the ids written one after the other to the shard's raw payload file, as little-endian
unsigned 16-bit integers if the vocabulary has at most 65,536 entries, else 32-bit. The index file
next to it maps a document key (id, occurrence) to its slot: level by level, keys that are alone at their hash
position set a bit there, the others go to the next level; the slot is the number of bits set before. A slot
holds a 32-bit fingerprint, the offset and the number of ids, so a keyed read costs a few hash steps and one
ranged read, whatever the size of the shard.

Tasks write under names of their own and hand over the names when both files are complete, so a repeated task
leaves unused files at most. Files go to the shared folder through pyarrow's file systems.

Cases: a null text counts as empty and has the end id only; null ids sort first and are told apart from every number,
the smallest too; repeated ids are told apart by their occurrence within the shard, in order of a hash of the text; an empty table
gives no files and no rows; very long texts are encoded whole; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.charclass import stand_ins
from tidemark.llm.common import arrow_map, column, cut, fresh_folder, held, sliced, table

#: Words and pre-tokens kept before a memo starts anew.
MEMO = 400_000
#: Bytes of text whose words are brought together in one go.
TOGETHER = 4 << 20
#: Longer ones are not kept.
KEPT = 64
#: Words that the library gets as one string.
JOINED = 500
LEVELS = 48
#: A shard row, and the columns of a manifest.
MANIFEST = "shard int, file string, kind string, docs long, nulls long, ids long, first_id long, last_id long"


class BatchEncoder:
    """The tokenizers library over words: each distinct one of a batch is encoded once, and kept.

    In a text whose white space is single spaces and line ends between words, a new pre-token begins at every space and on
    both sides of every line end; its words are encoded apart, and Arrow cuts whole batches of such texts, numbers their distinct words and
    puts the ids together. Letters and the marks behind them are pre-tokens of their own, so a word of both is put together from the two. Other texts are cut to pre-tokens, by the
    library's own character classes. Words behind a space go to the library many at a time, as one string: their ids begin
    at those whose bytes begin with the space.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads for short words cost more than the work
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.kind = "<u2" if max(self.lib.get_vocab_size(), 1 + max([0, *self.special.values()])) <= 1 << 16 else "<u4"
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.kinds = stand_ins(self.lib.pre_tokenizer)
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
        vocab = self.lib.get_vocab()
        self.opens = np.zeros(1 + max(vocab.values(), default=0), bool)
        if not any(" " in t for t in self.special):
            self.opens[[i for t, i in vocab.items() if t.startswith("Ġ") and t not in self.special]] = True
        self.odd = "[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\\x00]|[ \n][ \n]|^[ \n]|[ \n]\\z" + "".join("|" + re.escape(s) for s in self.special)
        self.marked = re.compile("( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([-.,;:!?#*$%&|<>()\"]+)").fullmatch
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.memo = memo

    def parts(self, text: str) -> list[str]:
        """Strings that are encoded apart: one after the other they are the text."""
        pieces = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        out = []
        for p in pieces:
            if p in self.special:
                out.append(p)
            elif p.split() == p.replace("\n", " ").split(" "):  # white space is a space or line end between two words each time
                out += p.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00") if "\x00" not in p else self.pre_tokens(p)
            elif p:
                out += self.pre_tokens(p)
        return out

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(text.translate(self.kinds))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text, as raw bytes."""
        parts = [self.parts(t) if t else [] for t in texts]
        fresh = list(set().union(*parts))
        known = dict(zip(fresh, self.raw_words(fresh)))
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The same for a column."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", "\x00\n\x00"), " ", "\x00 ")
        words = pc.split_pattern(cut, "\x00")
        numbered = words.flatten().dictionary_encode()
        raw = pa.array(self.raw_words(numbered.dictionary.to_pylist()), pa.binary())
        joined = pc.binary_join(pa.ListArray.from_arrays(words.offsets, raw.take(numbered.indices)), b"").to_pylist()
        if not odd.any():
            return joined
        plain, others = iter(joined), iter(self.encode(texts.filter(pa.array(odd)).to_pylist()))
        return [next(others) if o else next(plain) for o in odd.tolist()]

    def raw_words(self, words: list[str]) -> list[bytes]:
        """The ids of strings that are encoded apart, as raw bytes; those of short ones are kept for two generations."""
        known, older = self.known, self.older
        out = list(map(known.get, words))
        gaps = [i for i, got in enumerate(out) if got is None]
        if not gaps:
            return out
        own, todo, tails = {}, [], []
        for i in gaps:
            w = words[i]
            if (got := older.get(w)) is not None:
                own[w] = got
            elif m := self.marked(w):
                tails.append((w, *m.groups()))
                todo += m.groups()
            else:
                todo.append(w)
        fresh = []
        for w in dict.fromkeys(todo):
            if (got := known.get(w) or older.get(w)) is None:
                fresh.append(w)
            else:
                own[w] = got
        alone = self.learn_joined(fresh, own)
        for at in range(0, len(alone), 10_000):
            some = alone[at : at + 10_000]
            own.update(zip(some, [self.raw(e.ids) for e in self.lib.encode_batch_fast(some, add_special_tokens=False)]))
        for w, stem, marks in tails:
            own[w] = own[stem] + own[marks]
        for i in gaps:
            out[i] = own[words[i]]
        if len(known) + len(own) > self.memo:
            self.older, self.known = known, {}
        self.known.update(own if max(map(len, own)) < KEPT else {w: got for w, got in own.items() if len(w) < KEPT})
        return out

    def learn_joined(self, todo: list[str], known: dict[str, bytes]) -> list[str]:
        """Takes up the words behind a space; those that have to be encoded alone are given back."""
        spaced, alone, width = [], [], np.dtype(self.kind).itemsize
        for w in todo:
            (spaced if w[:1] == " " and len(w) > 1 and not w[1].isspace() else alone).append(w)
        for at in range(0, len(spaced), 10_000):
            groups = [spaced[k : k + JOINED] for k in range(at, min(at + 10_000, len(spaced)), JOINED)]
            for words, e in zip(groups, self.lib.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, self.kind)
                firsts = np.flatnonzero(self.opens[ids])
                if len(firsts) != len(words):  # a vocabulary without bytes
                    alone += words
                    continue
                raw, cuts = ids.tobytes(), [*(firsts * width).tolist(), len(ids) * width]
                known.update(zip(words, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        return alone

    def raw(self, ids: list[int]) -> bytes:
        out = array("H" if self.kind == "<u2" else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


def encoder_at(path: str) -> BatchEncoder:
    return held(("byte bpe", path), lambda: BatchEncoder(path))


def key_hash(ids: np.ndarray, occurrence: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of keys, another for every seed. Occurrences of the null id are counted -1, -2 and so on."""
    h = ids.astype(np.int64).view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    for add in (np.uint64(seed), occurrence.astype(np.int64).view(np.uint64)):  # ids are mixed before occurrences are added
        h = (h + add) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


class PerfectIndex:
    """Minimal perfect hash of distinct (id, occurrence) keys to slots 0..n-1, with fingerprints, offsets and lengths."""

    def __init__(self, sizes: list[int], bits: np.ndarray, fingerprints: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.fingerprints, self.offsets, self.lengths = fingerprints, offsets, lengths
        self.flags = np.unpackbits(bits, bitorder="little").astype(bool)
        self.ranks = np.concatenate([[0], np.cumsum(self.flags)])

    @classmethod
    def build(cls, ids: np.ndarray, occurrence: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> PerfectIndex:
        left, sizes, levels, slots = np.arange(len(ids)), [], [], np.full(len(ids), -1, np.int64)
        before = 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-2 * len(left) // 8) * 8
            at = (key_hash(ids[left], occurrence[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            own = alone[at]
            slots[left[own]] = before + np.cumsum(alone)[at[own]] - 1
            before += int(alone.sum())
            sizes.append(size)
            levels.append(alone)
            left = left[~own]
        if len(left):
            raise ValueError("keys of a shard are not distinct")
        bits = np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool), bitorder="little")
        put = lambda a, kind: (out := np.zeros(len(ids), kind), out.__setitem__(slots, a))[0]
        prints = (key_hash(ids, occurrence, 1000) >> np.uint64(32)).astype(np.uint32)
        return cls(sizes, bits, put(prints, np.uint32), put(offsets, np.uint64), put(lengths, np.uint32))

    def find(self, ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 for keys that the fingerprints show not to be there."""
        slots, left, start = np.full(len(ids), -1, np.int64), np.arange(len(ids)), 0
        for level, size in enumerate(self.sizes):
            at = start + (key_hash(ids[left], occurrence[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.flags[at]
            slots[left[hit]] = self.ranks[at[hit]]
            left, start = left[~hit], start + size
        prints = (key_hash(ids, occurrence, 1000) >> np.uint64(32)).astype(np.uint32)
        found = slots >= 0
        found[found] = self.fingerprints[slots[found]] == prints[found]
        return np.where(found, slots, -1)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.fingerprints), len(self.sizes), *self.sizes], "<u8").tobytes()
        return head + self.bits.tobytes() + self.fingerprints.astype("<u4").tobytes() + self.offsets.astype("<u8").tobytes() + self.lengths.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectIndex:
        n, levels = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        sizes = [int(x) for x in np.frombuffer(raw, "<u8", levels, 16)]
        at = 16 + 8 * levels
        bits = np.frombuffer(raw, np.uint8, sum(sizes) // 8, at)
        at += len(bits)
        return cls(sizes, bits, np.frombuffer(raw, "<u4", n, at), np.frombuffer(raw, "<u8", n, at + 4 * n), np.frombuffer(raw, "<u4", n, at + 12 * n))


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file://" + "/" + uri.removeprefix("file:").lstrip("/")
    elif uri.startswith("/"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def occurrences(keys: np.ndarray, nulls: int) -> np.ndarray:
    """The occurrence of every key of a shard: 0, 1 and so on from the first of the same id, -1, -2 and so on for the first `nulls` keys, which are null."""
    rest = keys[nulls:]
    first = np.concatenate([[True], rest[1:] != rest[:-1]])[: len(rest)]
    return np.concatenate([-1 - np.arange(nulls), np.arange(len(rest)) - np.flatnonzero(first)[np.cumsum(first) - 1]])


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest (see MANIFEST): one row per shard, in order of the documents' ids; null ids, as 0 and counted in `nulls`, come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_at(tokenizer_path)
        width = np.dtype(encoder.kind).itemsize
        end = np.array([end_id], encoder.kind).tobytes()
        store, top = file_system(folder)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        ids, lengths, out, nulls = [], [], None, 0
        for b in sliced(batches, 8192, TOGETHER):
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(f"{top}/{name}.ids")
            own = column(b, "doc_id")
            nulls += own.count(None)
            ids += [i or 0 for i in own]
            encoded = encoder.encode_column(b.column(1))
            lengths += [len(e) // width + 1 for e in encoded]
            out.write(end.join(encoded) + end)
        if out is None:
            return
        out.close()
        keys, n = np.array(ids, np.int64), np.array(lengths, np.int64)
        index = PerfectIndex.build(keys, occurrences(keys, nulls), np.cumsum(n) - n, n)
        with store.open_output_stream(f"{top}/{name}.mph") as f:
            f.write(index.to_bytes())
        with store.open_output_stream(f"{top}/{name}.keys") as f:
            f.write(keys.astype("<i8").tobytes())
        row = [[TaskContext.get().partitionId()], [f"{folder}/{name}"], [encoder.kind], [len(keys)], [nulls], [int(n.sum())], [ids[nulls] if nulls < len(ids) else None], [ids[-1] if nulls < len(ids) else None]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2]), *(pa.array(r, pa.int64()) for r in row[3:])], [c.split()[0] for c in MANIFEST.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text")
    return cut(arrow_map(rows, run, MANIFEST, model=True))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, by keyed reads through the index of its shard."""
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("ids").over(ahead), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, kind, base, nulls in zip(*(column(b, c) for c in ("file", "kind", "base", "nulls"))):
                store, path = file_system(file)
                with store.open_input_stream(f"{path}.mph") as f:
                    index = PerfectIndex.from_bytes(f.read())
                with store.open_input_stream(f"{path}.keys") as f:
                    keys = np.frombuffer(f.read(), "<i8")
                width = np.dtype(kind).itemsize
                slots = index.find(keys, occurrences(keys, nulls))
                if (slots < 0).any():
                    raise ValueError(f"{file}: a key is not in the index")
                offsets, lengths = index.offsets[slots].astype(np.int64), index.lengths[slots].astype(np.int64)
                with store.open_input_file(f"{path}.ids") as payload:
                    for at in range(0, len(keys), 4096):
                        part = slice(at, at + 4096)
                        crcs = [zlib.crc32(np.frombuffer(payload.read_at(int(n) * width, int(o) * width), kind).astype("<u4").tobytes()) for o, n in zip(offsets[part], lengths[part])]
                        yield pa.RecordBatch.from_arrays([pa.array(keys[part], mask=np.arange(at, min(at + 4096, len(keys))) < nulls), pa.array(offsets[part] + base), pa.array(lengths[part]), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A shard is much work in one row: dealt out by number, not by size.
    return arrow_map(shards.repartition(max(1, min(10_000, manifest.count())), "shard"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids): one row for every document whose id is in `keys` (doc_id), by the index of the shards that may hold it.

    A key's shards come from an equi-join on blocks of the ids' range (as many blocks as shards, so a shard is listed
    under two blocks on average). In a shard, occurrences are asked for until the fingerprints say that there
    is none: all documents of a repeated id are found, also if they lie in several shards. A null in `keys` finds the documents
    without an id. Repeated keys count once; keys of no document give no row.
    """
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ends = manifest.agg(F.min("first_id").alias("low"), F.max("last_id").alias("high"), F.count("*").alias("n")).first()
    low, high = (int(ends["low"] or 0), int(ends["high"] or 0)) if ends["n"] else (0, 0)
    width = (high - low) // max(1, ends["n"]) + 1
    block = lambda c: F.expr(f"cast(floor((cast({c} as decimal(20,0)) - {low}) / {width}) as long)")
    shards = manifest.filter("first_id is not null").select("file", "kind", "first_id", "last_id", F.explode(F.sequence(block("first_id"), block("last_id"))).alias("block"))
    spots = wanted.filter(F.col("doc_id").between(low, high)).withColumn("block", block("doc_id")).join(shards, "block")
    spots = spots.filter("doc_id between first_id and last_id").select("file", "kind", "doc_id")
    unnamed = wanted.filter("doc_id is null").limit(1).select(F.lit(True).alias("asked")).join(manifest.filter("nulls > 0").select("file", "kind", F.lit(True).alias("asked")), "asked")
    spots = spots.unionByName(unnamed.select("file", "kind", F.lit(None).cast("long").alias("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_now: tuple = (None, None, None)
        for b in batches:
            for file, kind, doc in zip(column(b, "file"), column(b, "kind"), column(b, "doc_id")):
                if file != open_now[0]:
                    store, path = file_system(file)
                    with store.open_input_stream(f"{path}.mph") as f:
                        open_now = (file, PerfectIndex.from_bytes(f.read()), store.open_input_file(f"{path}.ids"))
                _, index, payload = open_now
                at, step, width = (0, 1, np.dtype(kind).itemsize) if doc is not None else (-1, -1, np.dtype(kind).itemsize)
                while (slot := int(index.find(np.array([doc or 0]), np.array([at]))[0])) >= 0:
                    raw = payload.read_at(int(index.lengths[slot]) * width, int(index.offsets[slot]) * width)
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([np.frombuffer(raw, kind).astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])
                    at += step

    return arrow_map(spots.repartition("file").sortWithinPartitions("file"), run, "doc_id long, ids array<int>")


def op7_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_folder(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder))
