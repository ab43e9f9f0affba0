"""Quality grades by ordinal cumulative-link regression on hashed text.

All grades share one weight for each hashed feature of a text; ordered thresholds part the
grades: P(grade <= k) = logistic(threshold k - score). The model gives a text's expected
grade and the probability of a grade or better, by which texts are selected.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_bytes

BUCKETS = 1 << 16
#: Shapes of words: letters of either case, digits, other signs and bytes beyond ASCII, runs as one.
_SHAPE = bytes(ord("a") if chr(b).islower() and b < 128 else ord("A") if chr(b).isupper() and b < 128 else ord("0") if 48 <= b < 58 else ord("e") if b >= 128 else b for b in range(256))

_RUN = re.compile(rb"(.)\1+", re.S)


class Features:
    """Hashed features of texts; remembers the buckets of words that it has met, up to a bound."""

    def __init__(self, remembered: int = 300_000):
        self.remembered = remembered
        self.seen: dict[bytes, tuple[int, int]] = {}

    def _buckets(self, word: bytes) -> tuple[int, int]:
        return zlib.crc32(word.lower()) % BUCKETS, zlib.crc32(_RUN.sub(rb"\1", word.translate(_SHAPE)), 77) % BUCKETS

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, each once, and their values; a text without words has only what all texts have."""
        words = text.split()
        counts = Counter(words)
        seen = self.seen
        if len(seen) > self.remembered:
            seen.clear()
        pairs = []
        for w in counts:
            found = seen.get(w)
            if found is None:
                found = seen[w] = self._buckets(w)
            pairs.append(found)
        size = len(words)
        where = np.array(pairs, np.int64).reshape(-1, 2)
        number = np.fromiter(counts.values(), np.float64, len(counts))
        own = np.bincount(where[:, 0], np.log1p(number), BUCKETS) if size else np.zeros(BUCKETS)
        own /= max(1e-9, math.sqrt(float(own @ own)))
        # shares of shapes and what tells of repetition, case and signs
        own += np.bincount(where[:, 1], 2 * number / max(1, size), BUCKETS) if size else 0
        letters = text.translate(_SHAPE)
        upper, lower, digit, wide = (letters.count(c) for c in b"A a 0 e".split())
        space = len(text) - len(b"".join(words))
        signs = max(0, len(text) - space - upper - lower - digit - wide)
        shares = {b"distinct": len(counts) / max(1, size), b"most": max(number, default=0) / max(1, size), b"upper": upper / max(1, upper + lower), b"signs": signs / max(1, len(text) - space), b"digits": digit / max(1, len(text) - space), b"word": min(1.0, (len(text) - space) / max(1, size) / 20), b"short": 1 / (1 + math.log1p(size)), b"pairs": self._repeats(words), b"all": 1.0}
        for name, value in shares.items():
            own[zlib.crc32(name, 99) % BUCKETS] += 2 * value
            own[zlib.crc32(name + b"%d" % int(10 * value), 99) % BUCKETS] += 1.0
        at = np.flatnonzero(own)
        return at, own[at].astype(np.float32)

    @staticmethod
    def _repeats(words: list[bytes]) -> float:
        """Share of word pairs that stood before in the text."""
        if len(words) < 2:
            return 0.0
        return 1 - len(set(zip(words, words[1:], strict=False))) / (len(words) - 1)


@dataclass
class Model:
    """Shared weights and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 on, a row for each score."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - scores[:, None]))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, count: int, *, decay: float = 1e-4, rounds: int = 300, rate: float = 0.05) -> Model:
    """Maximum penalised likelihood by full-batch steps; equal input gives an equal model.

    Grades run from 0 to ``count`` - 1; those that no row has get a threshold beside their neighbours'.
    """
    n = len(rows)
    if not n:
        return Model(np.zeros(BUCKETS, np.float32), np.arange(count - 1, dtype=np.float64) - 8.0)
    owner = np.repeat(np.arange(n), [len(a) for a, _ in rows])
    at = np.concatenate([a for a, _ in rows])
    used, at = np.unique(at, return_inverse=True)
    value = np.concatenate([v for _, v in rows]).astype(np.float64)
    below = np.clip((np.searchsorted(np.sort(grades), np.arange(count - 1), "right") + 0.5) / (n + 1), 1e-3, 1 - 1e-3)
    first = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    w = np.zeros(len(used))
    params = [w, np.array(first[:1]), gaps]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, rounds + 1):
        thresholds = np.concatenate((params[1], params[1] + np.cumsum(np.exp(params[2]))))
        score = np.bincount(owner, value * params[0][at], n)
        high, low = np.append(thresholds, np.inf)[grades], np.append(-np.inf, thresholds)[grades]
        f, g = logistic(high - score), logistic(low - score)
        p = np.maximum(f - g, 1e-12)
        df, dg = f * (1 - f), g * (1 - g)
        d_score = (df - dg) / p / n  # of the mean negative log-likelihood
        d_t = np.zeros(count)
        np.add.at(d_t, grades, -df / p / n)
        lower = np.zeros(count)
        np.add.at(lower, grades, dg / p / n)
        d_thresholds = d_t[:-1] + lower[1:]
        grads = [np.bincount(at, value * d_score[owner], len(used)) + decay * params[0], np.array([d_thresholds.sum()]), np.cumsum(d_thresholds[::-1])[::-1][1:] * np.exp(params[2])]
        for k, grad in enumerate(grads):
            m[k] += 0.1 * (grad - m[k])
            v[k] += 0.001 * (grad * grad - v[k])
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    whole = np.zeros(BUCKETS, np.float32)
    whole[used] = params[0]
    return Model(whole, np.concatenate((params[1], params[1] + np.cumsum(np.exp(params[2])))))


def sample(docs: DataFrame, ratings: DataFrame, *, id_col: str, text_col: str, grade_col: str, most: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and grades of at most ``most`` rated ids, those of the least hashes; features are computed where the texts are.

    An id that several documents have counts once, with the least of its texts.
    """
    rated = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_key")).agg(F.max(F.col(grade_col).cast("int")).alias("_grade"))
    wanted = F.broadcast(rated.orderBy(F.xxhash64("_key"), "_key").limit(most))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(wanted, F.col("_id") == F.col("_key")).groupBy("_key", "_grade").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [features(t) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype("<u4").tobytes() for a, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["key", "grade", "at", "value"])

    found = texts.select(F.col("_key").cast("string"), "_grade", "_text").mapInArrow(run, "key string, grade int, at binary, value binary").collect()
    found.sort(key=lambda r: (zlib.crc32(r.key.encode()), r.key, bytes(r["at"]), bytes(r.value)))
    return [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r.value, np.float32)) for r in found], np.array([r.grade for r in found], np.int64)


def grade(docs: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds ``prefix``expected_grade and ``prefix``tails (P(grade >= k) for k from 1 on) to the frame's columns.

    Null and empty texts are graded as texts without words. Rows are kept as they are; a
    column of an added name raises an error. Empty input, empty result.
    """
    added = [f"{prefix}expected_grade", f"{prefix}tails"]
    if clash := [c for c in docs.columns if c in added]:
        raise ValueError(f"columns {clash} would be replaced")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{added[0]}` double, `{added[1]}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            where = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [features(t) for t in text_bytes(part.column(where))]
                tails = model.tails(np.array([float(v.astype(np.float64) @ model.weights[a]) for a, v in rows]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names=[*part.schema.names, *added])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", grades: int = 3, most: int = 4000) -> Model:
    """Fits the model to a bounded sample of rated rows; ratings outside 0 to ``grades`` - 1 are held at its ends."""
    rows, known = sample(docs, ratings, id_col=id_col, text_col=text_col, grade_col=grade_col, most=most)
    return fit(rows, np.clip(known, 0, grades - 1), grades)
