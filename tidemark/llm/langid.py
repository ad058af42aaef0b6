"""Language identification with unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word
in a language is the sum over all ways to cut it into pieces of the product of their probabilities,
which a forward pass computes for all languages at once; a text's log-likelihood is the sum over its
words of letters, and its score the posterior of the best language.

The probabilities are fitted by expectation-maximisation on words of at most `per_language` different training
documents of each language (300 in the query; those with the smallest hashes of id and text): the words of those are counted per language
in Spark, the expected piece counts of each step are computed in Arrow batches and summed by Spark, and
the driver holds one number per (language, vocabulary piece). Scoring reads every whole text.

`per_letter` is the best language's log-likelihood for each letter: a text of an unknown script or of
random letters has a low one, whatever the posterior says.

Cases: a null text, or one without a letter, is `und` with score 0; words of any length are
scored whole, with rescaled sums; rows with a null id count as training rows; a language is any value of `lang` that
training rows have (null is none); without any training row every text is `und`; ties go to the language
first in order; repeated rows each give a row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, column, cut, hashed_sample, held, sliced, table

START = "▁"
#: Words of so many letters are not kept, and are fitted in logarithms.
LONG = 24
#: Words whose sums a worker keeps before it starts anew.
MEMO = 250_000
#: Characters of words that are summed at once.
AT_ONCE = 40_000
#: Sums are rescaled after so many characters.
RESCALE = 8
#: Probability of a character that no piece covers, in every language.
UNKNOWN = 1e-9
_LETTERS = regex.compile(r"\p{L}+")


def pieces_at(path: str) -> list[str]:
    """The vocabulary's normal pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = (r for r in range(sp.get_piece_size()) if not (sp.is_control(r) or sp.is_unknown(r) or sp.is_byte(r)))
    return [sp.id_to_piece(r) for r in keep]


def prefixes_of(pieces: Iterable[str]) -> set[str]:
    """Every beginning of a piece: a search from one place goes on only while it stands in these."""
    return {p[:k] for p in pieces for k in range(1, len(p) + 1)}


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


class Trie:
    """The beginnings of pieces as numbered nodes (0: the empty one), for many searches at once."""

    #: A node's number stands above the bits of a character.
    CHAR_BITS = 21

    def __init__(self, pieces: list[str]):
        nodes = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.piece = np.full(len(nodes), -1, np.int32)  # the piece that ends at a node
        for i, p in enumerate(pieces):
            self.piece[nodes[p]] = i
        bits = max(4, (4 * len(nodes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        # Steps (node, character) -> node, in a table of hashes where the next free place is taken.
        self.steps, self.nodes, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), 1
        own = list(nodes.items())[1:]
        keys = np.array([nodes[p[:-1]] << self.CHAR_BITS | ord(p[-1]) for p, _ in own], np.int64)
        for key, at, (_, node) in zip(keys.tolist(), self.place(keys).tolist(), own):
            probes = 1
            while self.steps[at] >= 0:
                at, probes = (at + 1) & self.mask, probes + 1
            self.steps[at], self.nodes[at], self.probes = key, node, max(self.probes, probes)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node behind each node by its character, -1 where no piece goes on so."""
        keys = nodes << self.CHAR_BITS | chars
        at = self.place(keys)
        seen = self.steps[at]
        out = np.where(seen == keys, self.nodes[at], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        for _ in range(1, self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
            seen = self.steps[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.nodes[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


class Segmenter:
    """Sums over all segmentations. probs: (languages, pieces)."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.trie = Trie(pieces)
        self.probs = np.vstack([probs.T, np.full((1, probs.shape[0]), UNKNOWN)])  # the last row: a character without a piece
        self.longest = max(map(len, pieces), default=1)
        self.memo: dict[str, int] = {}  # the row of each word in `sums`
        self.sums = np.zeros((MEMO, probs.shape[0]))

    def forward(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods (texts, languages) of texts of one length: position by position, for all texts at once."""
        n, ring, probs = len(texts[0]), self.longest + 1, self.probs
        chars = np.ascontiguousarray(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(len(texts), n).T.astype(np.int64))
        at = np.zeros((ring, len(texts), probs.shape[1]))  # the sums of this position and of those its pieces reach
        at[0] = 1
        scale = np.zeros(at.shape[1:])
        for start in range(n):
            here, rows, nodes = at[start % ring], np.arange(len(texts)), np.zeros(len(texts), np.int64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                nodes = self.trie.step(nodes, chars[end - 1, rows]).astype(np.int64)
                on = nodes >= 0
                ids = np.where(on, self.trie.piece[nodes], -1)
                if end == start + 1:
                    at[end % ring] += here * probs[ids]
                else:
                    whole = ids >= 0
                    some = rows[whole]
                    at[end % ring, some] += here[some] * probs[ids[whole]]
                rows, nodes = rows[on], nodes[on]
                if not len(rows):
                    break
            here[:] = 0
            if start % RESCALE == RESCALE - 1:
                most = at.max(axis=0)
                at /= most
                scale += np.log(most)
        return np.log(at[n % ring]) + scale

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """(words, languages), for words of one length together, some tens of thousands of characters at a time."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        out = np.zeros((len(words), self.probs.shape[1]))
        for n, rows in by_length.items():
            step = max(1, AT_ONCE // n)
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                out[some] = self.forward([START + words[i] for i in some])
        return out

    def of_texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log-likelihoods by language, None where a text has no letter; words are kept, MEMO of them at most."""
        parts = [words_of(t) for t in texts]
        words = list(set().union(*parts))
        fresh = [w for w in words if w not in self.memo]
        kept = [w for w in fresh if len(w) < LONG]
        if len(self.memo) + len(kept) > MEMO:
            self.memo, fresh = {}, words
            kept = [w for w in fresh if len(w) < LONG][:MEMO]
        got = self.log_likelihoods(fresh)
        place = {w: i for i, w in enumerate(fresh)}
        if kept:
            first = len(self.memo)
            self.sums[first : first + len(kept)] = got[[place[w] for w in kept]]
            self.memo.update(zip(kept, range(first, first + len(kept))))
            for w in kept:
                del place[w]
        out: list[np.ndarray | None] = []
        for p in parts:
            if not p:
                out.append(None)
                continue
            rest = [place[w] for w in p if w in place] if place else []
            total = self.sums[list(map(self.memo.__getitem__, p if not rest else (w for w in p if w not in place)))].sum(axis=0)
            out.append(total + got[rest].sum(axis=0) if rest else total)
        return out


def add_expected(text: str, weight: float, index: dict[str, int], p: list[float], into: list[float], prefixes: set[str] | None = None) -> None:
    """Adds a word's expected piece counts in one language: forward and backward sums over its pieces."""
    n, prefixes, hits = len(text), prefixes_of(index) if prefixes is None else prefixes, []
    for start in range(n):
        if text[start] not in index:
            hits.append((start, start + 1, -1))
        for end in range(start + 1, n + 1):
            piece = text[start:end]
            if piece not in prefixes:
                break
            if (i := index.get(piece)) is not None:
                hits.append((start, end, i))
    if n > LONG:
        add_logarithmic(n, hits, weight, p, into)
        return
    front, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for start, end, i in hits:
        front[end] += front[start] * (p[i] if i >= 0 else UNKNOWN)
    if front[n] <= 0:
        return
    scale = weight / front[n]
    for start, end, i in reversed(hits):
        if i < 0:
            back[start] += UNKNOWN * back[end]
        else:
            mass = p[i] * back[end]
            back[start] += mass
            into[i] += front[start] * mass * scale


def add_logarithmic(n: int, hits: list[tuple[int, int, int]], weight: float, p: list[float], into: list[float]) -> None:
    """What add_expected adds, by sums of logarithms: those of long words would vanish."""

    def plus(a: float, b: float) -> float:
        a, b = max(a, b), min(a, b)
        return a if b == -math.inf else a + math.log1p(math.exp(b - a))

    hits = [(start, end, i, math.log(p[i] if i >= 0 else UNKNOWN)) for start, end, i in hits]
    front, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for start, end, _, log_p in hits:
        front[end] = plus(front[end], front[start] + log_p)
    for start, end, i, log_p in reversed(hits):
        back[start] = plus(back[start], log_p + back[end])
        if i >= 0:
            into[i] += weight * math.exp(front[start] + log_p + back[end] - front[n])


def fit_languages(train: DataFrame, piece_path: str, *, per_language: int = 300, steps: int = 2) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities by language and piece) from (doc_id, text, lang) of at most `per_language` documents each."""
    rows = train.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))
    some = hashed_sample(rows, "lang", "key", per_language)
    words = some.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    # Few bytes but much work each: dealt out by number, not by size.
    words = cut(words.groupBy("lang", "word").agg(F.count("*").alias("n")).repartition(24, "lang", "word"))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    pieces = pieces_at(piece_path)
    size = len(pieces)
    probs = np.tile(np.full(size, 1 / size), (len(langs), 1))
    for _ in range(steps if langs else 0):

        def expect(batches: Iterator[pa.RecordBatch], probs: np.ndarray = probs) -> Iterator[pa.RecordBatch]:
            index, p, into = {x: i for i, x in enumerate(pieces)}, probs.tolist(), np.zeros(probs.shape).tolist()
            place, prefixes = {lang: k for k, lang in enumerate(langs)}, prefixes_of(pieces)
            for b in batches:
                for lang, word, n in zip(column(b, "lang"), column(b, "word"), column(b, "n")):
                    add_expected(START + word, n, index, p[k := place[lang]], into[k], prefixes)
            into = np.array(into)
            k, i = np.nonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(into[k, i])], ["k", "piece", "n"])

        sums = np.zeros(probs.shape)
        # One number per (language, piece) of the fixed vocabulary at most.
        for r in arrow_map(words, expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            sums[r["k"], r["piece"]] = round(r["n"], 6)
        probs = (sums + 0.05) / (sums + 0.05).sum(axis=1, keepdims=True)
    return langs, probs


def identify_languages(docs: DataFrame, langs: list[str], probs: np.ndarray, piece_path: str, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score and per_letter for every row of docs."""
    probs = probs.astype(np.float32)
    name = ("languages", piece_path, hashlib.sha256(probs.tobytes()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = held(name, lambda: Segmenter(pieces_at(piece_path), probs.astype(np.float64))) if langs else None
        for b in sliced(batches):
            pred, score, letters = [], [], []
            texts = column(b, "text")
            for text, sums in zip(texts, seg.of_texts(texts) if langs else [None] * len(texts)):
                at = 0 if sums is None else int(sums.argmax())
                pred.append("und" if sums is None else langs[at])
                score.append(0.0 if sums is None else float(1 / np.exp(sums - sums[at]).sum()))
                letters.append(None if sums is None else float(sums[at]) / sum(map(len, words_of(text))))
            own = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.float64())], [*keep, "lang_pred", "score", "per_letter"])

    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(rows, run, f"{kinds}, lang_pred string, score double, per_letter double", model=True)


def held_out_part(doc_id) -> "F.Column":
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_id(docs: DataFrame, piece_path: str, *, per_language: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on the rows that are not held out, applied to all."""
    rows = docs.select("doc_id", "text", "lang")
    langs, probs = fit_languages(rows.filter(~held_out_part(F.col("doc_id"))), piece_path, per_language=per_language)
    out = identify_languages(rows, langs, probs, piece_path)
    return out.select("doc_id", held_out_part(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return language_id(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
