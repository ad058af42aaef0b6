"""Quality rules: hashed n-gram logistic regression with calibrated probabilities and fixed thresholds.

Features of a text: its runs of one to three characters, its words and its pairs of neighbouring words, each
hashed to one of 2^16 places; the square roots of their counts, scaled to length one. A logistic model is
fitted on at most `per_class` labelled rows of each class (those with the smallest hash of their id), three
quarters for the weights and one for the calibration (a logistic curve over the raw score). Every whole text
is then scored in Arrow batches: kept unless a base rule fails or its probability is under `threshold`.

Cases: a null or empty text has no words and fails the base rules; without labelled rows of both classes
only the base rules decide; a null label or id is no label; several different labels of a document each count, the
same one repeated counts once, and of several texts under one labelled id the one with the smallest hash is read;
texts of any length are read whole; repeated rows each give a row; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, column, cut, hashed_sample, sliced, table

BITS = 16
SYMBOLS = b"#*$%&|<>"
_POWERS = np.random.default_rng(20240229).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes; white space is never part of a longer character."""
    inside = np.concatenate([[False], ~_IS_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: its bytes times random odd numbers by place, then its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    terms = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095] * ((place >> 12).astype(np.uint64) * _MIX[0] | np.uint64(1))
    terms[_IS_SPACE[data]] = 0
    sums = np.add.reduceat(terms, starts) + (ends - starts).astype(np.uint64) * _MIX[1]
    sums ^= sums >> np.uint64(29)
    return sums * _MIX[2]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data)
    n = len(starts)
    if not n:
        return 0, 0, 0, 0, 0
    chars = int((((data & 0xC0) != 0x80) & ~_IS_SPACE[data]).sum())
    symbols = int(_IS_SYMBOL[data].sum())
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    repeated = 0
    if n >= 3:
        h = word_hashes(data, starts, ends)
        windows = h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        hit = np.concatenate([count[back] >= 2, [False, False]])
        repeated = int((hit | np.roll(hit, 1) | np.roll(hit, 2)).sum())
    return n, chars, symbols, dup, repeated


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text, of length one; empty for an empty text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0)
    chars = data if len(data) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    wide, parts = chars.astype(np.uint64) + np.uint64(1), []
    shift = np.uint64(64 - BITS)
    for n in (1, 2, 3):
        if len(wide) >= n:
            h = wide[: len(wide) - n + 1] * _MIX[0]
            for i in range(1, n):
                h = (h + wide[i : len(wide) - n + 1 + i]) * _MIX[i]
            parts.append((h * _POWERS[n]) >> shift)
    words = word_hashes(data, *word_bounds(data))
    parts.append(words >> shift)
    if len(words) > 1:
        parts.append((words[:-1] * _MIX[1] + words[1:] * _MIX[2]) >> shift)
    counts = np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at])
    return at, values / np.sqrt((values**2).sum())


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad over single rows, in a fixed shuffled order."""
    w, seen, bias, order = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3), 0.0, np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            g = 1 / (1 + np.exp(-np.clip(w[at] @ x + bias, -30, 30))) - y[i]
            step = g * x
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at]) * 0.5
            bias -= 0.05 * g
    return w, bias


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that turns raw scores to probabilities (smoothed targets, Newton steps)."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g, v = np.array([((p - goal) * raw).sum(), (p - goal).sum()]), np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(v * raw * raw).sum() + 1e-3, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, g)
    return float(a), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = 750) -> tuple[np.ndarray, float] | None:
    """(weights, bias) with the calibration folded in, from at most `per_class` labelled rows of each class.

    The bounded sample is fitted in one task of an executor; the driver gets 2^16 weights.
    """
    known = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.xxhash64("doc_id").alias("key"))
    known = hashed_sample(known, "y", "key", per_class).drop("key")
    some = docs.filter("text is not null").join(F.broadcast(known), docs["doc_id"] == known["id"])
    # One text of each labelled id, however many rows it has.
    some = some.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = [features(t) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32()))], ["id", "y", "at", "x"]
            )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(column(b, "id"), column(b, "y"), map(np.array, column(b, "at")), map(np.array, column(b, "x")))
        rows.sort(key=lambda r: (r[0] * 2654435761 % 2**32, r[0]))
        y = np.array([r[1] for r in rows], float)
        if len(set(y.tolist())) < 2:
            return
        x = [(r[2], r[3]) for r in rows]
        aside = np.arange(len(x)) % 4 == 3
        w, bias = fit_logistic([v for v, o in zip(x, aside) if not o], y[~aside])
        a, b = 1.0, 0.0
        if len(set(y[aside].tolist())) == 2:
            a, b = calibrate(np.array([w[at] @ v + bias for (at, v), o in zip(x, aside) if o]), y[aside])
        yield pa.RecordBatch.from_arrays([pa.array([(a * w).tolist()], pa.list_(pa.float64())), pa.array([a * bias + b])], ["w", "bias"])

    kind = some.schema["id"].dataType.simpleString()
    y_kind = some.schema["y"].dataType.simpleString()
    sample = cut(arrow_map(some, featured, f"id {kind}, y {y_kind}, at array<int>, x array<float>"))
    got = arrow_map(sample.coalesce(1), fitted, "w array<double>, bias double").collect()
    return (np.array(got[0]["w"]), got[0]["bias"]) if got else None


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float] | None, *, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept)."""
    small = None if model is None else (model[0].astype(np.float32), model[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = column(b, "text")
            base = [base_counts(t) for t in texts]
            failed = [n < 50 or 100 * rep > 50 * n for n, *_, rep in base]
            if small is None:
                prob = [None] * len(texts)
            else:
                raw = [float(small[0][at] @ x) + small[1] for at, x in map(features, texts)]
                prob = [float(1 / (1 + np.exp(-min(max(r, -30.0), 30.0)))) for r in raw]
            kept = [not f and (p is None or p >= threshold) for f, p in zip(failed, prob)]
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in zip(*base)), pa.array(failed), pa.array(prob, pa.float64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
