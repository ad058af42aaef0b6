"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring byte symbols that never stand side by side inside any vocabulary token can never be
merged across, so a pre-token may be cut there, the fragments encoded on their own and their ids put
one after the other. Words (between white space) and fragments repeat; both are kept in bounded memos, so most of a
text costs one look-up a word. A fragment's merges come from a heap over a linked list: n log n steps, however long it is.

Lower case and normal form of texts beyond Latin, and the class of every character, are the tokenizers library's.

Cases: a null text encodes as an empty one (no ids, empty decoded text); the special tokens' strings
in a text become their ids, as in the tokenizers library; texts of any length are encoded whole;
repeated rows each give a row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.charclass import stand_ins
from tidemark.llm.common import arrow_map, column, held, sliced

#: Entries of a memo's generation: bounds a worker's memory whatever the vocabulary. Words have two strings each, pre-tokens short tuples.
MEMO, WORD_MEMO = 200_000, 150_000
#: Bytes of text whose words are brought together in one go.
TOGETHER = 4 << 20
#: Up to so many symbols, a fragment's best pair is found by looking through all.
SHORT = 48
#: Longer words and fragments are not kept.
KEPT = 64


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if printable, else 256 + its place."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo:
    """A bounded memo of two generations: a full one becomes the old one, so what is often asked for stays."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, key):
        if (got := self.new.get(key)) is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        self.new[key] = value


class ForcedBoundaryBpe:
    """A byte-level BPE model with an end-of-word suffix, read from a tokenizers JSON file."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.inside: set[str] = set()
        for t in self.vocab:
            body = t.removesuffix(self.suffix) if self.suffix else t
            self.inside.update(body[i : i + 2] for i in range(len(body) - 1))
        self.symbols = {chr(b): s for b, s in byte_symbols().items()}
        self.to_symbols = str.maketrans(self.symbols)
        self.fragments, self.tokens, self.words = Memo(memo), Memo(memo), Memo(min(memo, WORD_MEMO))
        self.id_text = {i: str(i) for i in self.token}
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        self.normalised, self.kinds = lib.normalizer.normalize_str, stand_ins(lib.pre_tokenizer)
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
        self.beyond_latin = re.compile("[^\x00-\u024f]").search
        self.odd_space = re.compile("[\x1c-\x1f]").search
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def fragments_of(self, symbols: str) -> list[str]:
        """The parts between the certain cuts."""
        inside = self.inside
        cuts = [i for i, pair in enumerate(map("".join, zip(symbols, symbols[1:])), 1) if pair not in inside]
        return [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]

    def merged(self, fragment: str, last: bool) -> tuple[int, ...]:
        """Ids of one fragment: the best-ranked neighbouring pair merges first, the leftmost of equals."""
        parts: list[str | None] = list(fragment)
        if last:
            parts[-1] += self.suffix
        if len(parts) <= SHORT:
            return tuple(self.vocab[p] for p in self.merged_short(parts))
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or rank((parts[i], parts[j])) != r:
                continue  # an older pair of this place
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return tuple(self.vocab[p] for p in parts if p is not None)

    def merged_short(self, parts: list[str]) -> list[str]:
        """The same for a few symbols."""
        rank, worst = self.rank.get, len(self.rank)
        ranks = [rank(p, worst) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < worst:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), worst)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), worst)
        return parts

    def ids_of(self, token: str) -> tuple[int, ...]:
        """The ids of a pre-token."""
        if (got := self.tokens.get(token)) is not None:
            return got
        symbols = token.translate(self.to_symbols) if token.isascii() else token.encode().decode("latin-1").translate(self.to_symbols)
        parts = self.fragments_of(symbols)
        ids: list[int] = []
        for i, part in enumerate(parts):
            key = (part, i == len(parts) - 1)
            if (one := self.fragments.get(key)) is None:
                one = self.merged(*key)
                if len(parts) > 1 and len(part) < KEPT:
                    self.fragments.put(key, one)
            ids += one
        got = tuple(ids)
        if len(token) < KEPT:
            self.tokens.put(token, got)
        return got

    def entry(self, word: str) -> tuple[int, str, str]:
        """(number of ids, the ids as text, the tokens as text) of a word without white space, in lower case."""
        if (got := self.words.get(word)) is None:
            if word.isascii():
                tokens = self.split.findall(word)
            else:
                tokens = [word[m.start() : m.end()] for m in self.split.finditer(word.translate(self.kinds))]
            ids = [i for t in tokens for i in self.ids_of(t)]
            got = (len(ids), " ".join([self.id_text[i] for i in ids]), " ".join([self.token[i] for i in ids]))
            if len(word) < KEPT:
                self.words.put(word, got)
        return got

    def words_of(self, text: str) -> list[str]:
        """Lower-cased words; white space is dropped."""
        if self.beyond_latin(text):
            return [w for w in self.normalised(text).split(" ") if w]
        low = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        return re.split("[\t-\r \x85\xa0]+", low) if self.odd_space(low) else low.split()

    def entries(self, text: str) -> list[tuple[int, str, str]]:
        if self.split_special is None or "<|" not in text:
            pieces = [text]
        else:
            pieces = self.split_special.split(text)
        out = []
        for piece in pieces:
            if piece in self.special:
                out.append((1, str(self.special[piece]), piece))
            elif piece:
                words, entry = self.words.new, self.entry
                out += [e for w in self.words_of(piece) if (e := words.get(w) or entry(w))[0]]
        return out

    def lowered(self, text: str) -> str | None:
        """The text in lower case with ASCII white space between its words; None for texts that need more than that."""
        if self.beyond_latin(text) or (self.split_special is not None and "<|" in text):
            return None
        low = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        return low if text.isascii() else low.replace("\x85", " ").replace("\xa0", " ")

    def columns(self, texts: list[str | None]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, the ids as text, the tokens as text) of every text: Arrow cuts the texts to words and numbers the distinct ones, whose entries are put together."""
        low = [self.lowered(t or "") for t in texts]
        words = pc.ascii_split_whitespace(pa.array([w or "" for w in low], pa.large_string()))
        numbered = words.flatten().dictionary_encode()
        entries = [self.entry(w) for w in numbered.dictionary.to_pylist()]
        sizes, index = np.array([e[0] for e in entries], np.int64), numbered.indices.to_numpy()
        has = sizes[index] > 0  # no id, no place in the text
        upto = np.concatenate([[0], np.cumsum(has)])[words.offsets.to_numpy()]
        n = np.diff(np.concatenate([[0], np.cumsum(sizes[index])])[words.offsets.to_numpy()])
        index, upto = pa.array(index[has]), pa.array(upto, pa.int32())
        out = [pc.binary_join(pa.ListArray.from_arrays(upto, pa.array([e[i] for e in entries], pa.large_string()).take(index)), pa.scalar(" ", pa.large_string())) for i in (1, 2)]
        if None in low:
            whole = [self.entries(t) if w is None else None for t, w in zip(texts, low)]
            n = np.array([k if e is None else sum(x[0] for x in e) for k, e in zip(n.tolist(), whole)], np.int64)
            out = [pa.array([k if e is None else " ".join([x[i] for x in e]) for k, e in zip(o.to_pylist(), whole)], pa.large_string()) for i, o in zip((1, 2), out)]
        return n, *out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by a space."""
        return " ".join(map(self.token.__getitem__, ids))


def model_at(path: str) -> ForcedBoundaryBpe:
    """One model for all tasks of a worker."""
    return held(("bpe", path), lambda: ForcedBoundaryBpe(path))


def bpe_encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text and the text they decode to. A narrow pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(tokenizer_path)
        for b in sliced(batches, 8192, TOGETHER):
            _, ids, decoded = model.columns(column(b, "text"))
            ids = [np.fromstring(i, np.int32, sep=" ") for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), decoded.cast(pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, ids array<int>, decoded string", model=True)


def bpe_digest(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of what bpe_encode gives, without its long columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sha = model_at(tokenizer_path), hashlib.sha256
        for b in sliced(batches, 8192, TOGETHER):
            n, ids, decoded = model.columns(column(b, "text"))
            ids, decoded = ([sha(x.as_buffer()).hexdigest() for x in c] for c in (ids, decoded))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", model=True)
