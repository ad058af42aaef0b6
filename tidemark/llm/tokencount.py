"""Token counts by trie-shared dynamic programming over a fixed public vocabulary of pieces.

A pre-token is a word behind a word-start sign. Its tokens are the pieces of its best segmentation under
a unigram model: the highest sum of piece scores, then the fewest pieces. Distinct pre-tokens are put into a trie, whose
nodes hold the best score and count of their prefix: these are computed once for all pre-tokens that share it.
The new pre-tokens of some megabytes of text make one trie, which grows by a level at a time, all nodes of a level at once; the count at
the end of each pre-token is stored for all texts that a worker reads, and added up per document. Counts of MEMO pre-tokens make a generation, of which two are
kept, so memory is bounded; that changes how often a prefix is computed, never a count. Single pre-tokens (`count`) go down a trie that is kept, up to NODES nodes. Pre-tokens are not brought together over the table: there are as many (document, word) pairs as
words, and shuffling them would cost more than computing again what several workers have each seen.

Piece scores follow from the vocabulary alone: log(1 / (rank + 1)) less the log of their sum, the rank
being the piece's place in the file (a fixed Zipf law; tokenizers are never trained here). A character
without a piece counts as its UTF-8 bytes, each at the score of the last rank.

Cases: a null or empty text has no tokens; a pre-token may be of any length; repeated rows each give a
row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, arrow_map, held, sliced, table

#: The sign before a word in the vocabulary file.
START = "▁"
#: Nodes of a trie, and pre-tokens with stored counts, before both start anew.
NODES = 400_000
MEMO = 300_000
#: Bytes of text whose words are brought together in one go, and new pre-tokens whose trie is built in one go.
TOGETHER, GROWN = 4 << 20, 50_000
#: Longer pre-tokens are walked through a trie of their own.
KEPT = 64
_WORDS = re.compile(WORD)


def zipf_pieces(path: str) -> tuple[dict[str, float], float]:
    """(score of every normal piece, score of a byte) from a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    total = math.log(math.fsum(1 / (r + 1) for r in range(n)))
    keep = (r for r in range(n) if not (sp.is_control(r) or sp.is_unknown(r) or sp.is_byte(r) or sp.is_unused(r)))
    return {sp.id_to_piece(r): -math.log(r + 1) - total for r in keep}, -math.log(n) - total


class TrieCounter:
    def __init__(self, scores: dict[str, float], byte_score: float, *, memo: int = MEMO, nodes: int = NODES):
        self.scores, self.byte_score, self.memo, self.limit = scores, byte_score, memo, nodes
        # Ends of pieces: a search backwards from a place goes on only while it stands in these.
        self.ends = {p[k:] for p in scores for k in range(len(p))}
        self.start_anew()
        self.recent: dict[str, int] = {}
        self.earlier: dict[str, int] = {}
        self.longest = max(map(len, scores), default=1)
        self.slots = PieceTable({e: scores.get(e, -math.inf) for e in self.ends})

    def start_anew(self) -> None:
        self.counts: dict[str, int] = {}  # of whole pre-tokens
        self.children: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # of every node: score, -tokens

    def count(self, word: str) -> int:
        """The tokens of one pre-token: down the trie as far as it is known, then node by node."""
        text, children, best = START + word, self.children, self.best
        path, node, at = [0], 0, 0
        for at, char in enumerate(text):  # noqa: B007
            if (after := children.get((node, char))) is None:
                break
            node = after
            path.append(node)
        scores, ends = self.scores, self.ends
        for end in range(len(path), len(text) + 1):
            char = text[end - 1]
            top = (-math.inf, 0)
            for start in range(end - 1, -1, -1):
                piece = text[start:end]
                if piece not in ends:
                    break
                if (s := scores.get(piece)) is not None:
                    before, n = best[path[start]]
                    if (got := (before + s, n - 1)) > top:
                        top = got
            if char not in scores:
                size = len(char.encode())
                before, n = best[path[end - 1]]
                top = max(top, (before + size * self.byte_score, n - size))
            children[node, char] = node = len(best)
            best.append(top)
            path.append(node)
        return -best[node][1]

    def of_texts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(words, tokens) of every text."""
        out = []
        for t in texts:
            words, n = _WORDS.findall(t or ""), 0
            known = self.counts.get
            for w in words:
                if (c := known(w)) is None:
                    if len(w) >= KEPT:
                        c = TrieCounter.count(_Alone(self), w)
                    else:
                        if len(self.best) > self.limit or len(self.counts) > self.memo:
                            self.start_anew()
                            known = self.counts.get
                        c = self.counts[w] = self.count(w)
                n += c
            out.append((len(words), n))
        return out


    def of_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, tokens) of every text: Arrow cuts the texts to words and numbers the distinct ones."""
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        counts, index, ends = self.counts_of(distinct), numbered.indices.to_numpy(), words.offsets.to_numpy()
        upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[index])])[ends])
        return upto(np.array([len(w) > 0 for w in distinct], np.int64)), upto(counts)

    def counts_of(self, words: list[str]) -> np.ndarray:
        """The tokens of distinct words; an empty one has none."""
        out = list(map(self.recent.get, words))
        gaps = [i for i, c in enumerate(out) if c is None]
        fresh = []
        for i in gaps:
            w = words[i]
            if (c := self.earlier.get(w)) is None and not 0 < len(w) < KEPT:
                c = TrieCounter.count(_Alone(self), w) if w else 0
            out[i] = c
            if c is None:
                fresh.append(i)
        for at in range(0, len(fresh), GROWN):
            some = fresh[at : at + GROWN]
            for i, c in zip(some, self.grown([words[i] for i in some]).tolist()):
                out[i] = c
        if len(self.recent) + len(gaps) > self.memo:
            self.earlier, self.recent = self.recent, {}
        self.recent.update((words[i], out[i]) for i in gaps if len(words[i]) < KEPT)
        return np.array(out, np.int64)

    def grown(self, words: list[str]) -> np.ndarray:
        """The tokens of distinct, not empty words, by a trie over all of them: level by level, each node from the nodes above it."""
        order = sorted(range(len(words)), key=words.__getitem__)
        sizes = np.array([len(words[i]) + 1 for i in order])
        chars = np.zeros((len(words), int(sizes.max())), np.uint64)
        chars[np.arange(chars.shape[1]) < sizes[:, None]] = np.frombuffer("".join([START + words[i] for i in order]).encode("utf-32-le"), "<u4") + np.uint64(1)  # 0 is behind a word's end
        unlike = chars[1:] != chars[:-1]
        shared = np.concatenate([[0], np.where(unlike.any(axis=1), unlike.argmax(axis=1), chars.shape[1])])  # characters that a word has in common with the one before
        node = [np.zeros(len(words), np.int64)]  # of each level and word
        best, least = [np.zeros(1)], [np.zeros(1, np.int64)]  # of each level and node: score, -tokens
        out = np.zeros(len(words), np.int64)
        for d in range(1, chars.shape[1] + 1):
            reach = sizes >= d
            # A word begins a node unless the last word before it that shares its first d characters has done so.
            first = reach & (shared < d)
            node.append(np.cumsum(first) - 1)
            at = np.flatnonzero(first)
            top, n = np.full(len(at), -np.inf), np.zeros(len(at), np.int64)
            live, h = np.arange(len(at)), np.zeros(len(at), np.uint64)
            for size in range(1, min(d, self.longest) + 1):
                h = h * PieceTable.BASE + chars[at[live], d - size]
                there, score = self.slots.find(h)
                live, h, score = live[there], h[there], score[there]
                if not len(live):
                    break
                above = node[d - size][at[live]]
                s, k = best[d - size][above] + score, least[d - size][above] - 1
                better = (score > -np.inf) & ((s > top[live]) | (s == top[live]) & (k > n[live]))
                top[live[better]], n[live[better]] = s[better], k[better]
            there, score = self.slots.find(chars[at, d - 1])
            bare = np.flatnonzero(~there | (score == -np.inf))
            if len(bare):  # characters without a piece
                c = chars[at[bare], d - 1] - np.uint64(1)
                size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
                above = node[d - 1][at[bare]]
                s, k = best[d - 1][above] + size * self.byte_score, least[d - 1][above] - size
                better = (s > top[bare]) | (s == top[bare]) & (k > n[bare])
                top[bare[better]], n[bare[better]] = s[better], k[better]
            best.append(top)
            least.append(n)
            done = sizes == d
            out[done] = -n[node[d][done]]
        back = np.empty(len(words), np.int64)
        back[order] = out
        return back


class PieceTable:
    """Scores by a 64-bit hash of a string, read backwards: open addressing in two arrays."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, scores: dict[str, float]):
        self.bits = max(4, (4 * len(scores)).bit_length())
        self.keys, self.scores = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -np.inf)
        self.full = np.zeros(1 << self.bits, bool)
        for text, score in scores.items():
            h = 0
            for c in reversed(text):
                h = (h * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            at = self.spot(np.array([h], np.uint64)).item()
            while self.full[at]:
                if self.keys[at] == h:
                    raise ValueError("two pieces have one hash")
                at = (at + 1) % len(self.keys)
            self.keys[at], self.scores[at], self.full[at] = h, score, True

    def spot(self, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) * self.BASE >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a string with this hash is there, its score)."""
        at = self.spot(h)
        while len(on := np.flatnonzero(self.full[at] & (self.keys[at] != h))):
            at[on] = (at[on] + 1) % len(self.keys)
        return self.full[at], self.scores[at]


class _Alone:
    """The trie of one long pre-token, which is not kept."""

    def __init__(self, of: TrieCounter):
        self.scores, self.byte_score, self.ends = of.scores, of.byte_score, of.ends
        self.children, self.best = {}, [(0.0, 0)]


def counter_at(path: str) -> TrieCounter:
    return held(("pieces", path), lambda: TrieCounter(*zipf_pieces(path)))


def token_counts(docs: DataFrame, piece_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens): a narrow pass; a worker shares prefixes over all texts it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_at(piece_path)
        for b in sliced(batches, 8192, TOGETHER):
            words, tokens = counter.of_column(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n_words long, n_tokens long", model=True)


def op4_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
