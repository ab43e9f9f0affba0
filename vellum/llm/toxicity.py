"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector, if it is in the vocabulary, beside the mean vector of its
character trigrams, so that unknown words are read too. Two gated recurrent passes run over
each window of words, attention pools their states, and a logistic unit scores the window.
A text's score is that of its worst window; windows overlap and cover the whole text. The
network is trained in numpy on document labels: of a toxic document the window that the
model finds worst is the example, of others windows drawn anew each round and the worst.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_bytes

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
TRIGRAMS = 1 << 12
F32 = np.float32


def tokens(text: bytes) -> list[bytes]:
    """Words: runs of letters and digits, ASCII letters in lower case."""
    return WORD.findall(text.lower())


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words, edges included, and how many each word has."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    ends = np.cumsum(counts + 2)
    keep = np.ones(len(code), bool)
    keep[(ends[:-1, None] + np.array([-2, -1])).ravel()] = False
    return ((code[keep] * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), counts


@dataclass
class Model:
    """Parameters by name, the vocabulary and the window."""

    p: dict[str, np.ndarray]
    vocabulary: dict[bytes, int]
    width: int
    stride: int

    @property
    def hidden(self) -> int:
        return len(self.p["Uf"])

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Vectors of words: of the word itself (0 where unknown), then of its characters."""
        own = self.p["W"][np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))]
        grams, counts = trigrams(words)
        chars = np.add.reduceat(self.p["C"][grams], np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) / counts[:, None].astype(F32)
        return np.concatenate((own, chars), axis=1)

    def gates(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """What words add to the gates of the forward and the backward pass."""
        x = self.inputs(words)
        return x @ self.p["Xf"] + self.p["bf"], x @ self.p["Xb"] + self.p["bb"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, F32(0.5), out=x)
    np.tanh(x, out=x)
    np.multiply(x, F32(0.5), out=x)
    np.add(x, F32(0.5), out=x)
    return x


def _run(gates: np.ndarray, u: np.ndarray, mask: np.ndarray | None, back: bool, tape: list | None = None) -> np.ndarray:
    """States of one pass over gates (steps, rows, 3 * hidden); (steps, rows, hidden)."""
    steps, rows, three = gates.shape
    n = three // 3
    out = np.empty((steps, rows, n), F32)
    h = np.zeros((rows, n), F32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        a = h @ u
        zr = _sigmoid(gates[t, :, : 2 * n] + a[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        un = a[:, 2 * n :]
        c = np.tanh(gates[t, :, 2 * n :] + r * un)
        new = c + z * (h - c)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if tape is not None:
            tape.append((t, h, z, r, un, c))
        out[t] = h = new
    return out


def _pool(p: dict[str, np.ndarray], states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Attention over states (steps, rows, 2 * hidden): logits and what the way back needs."""
    s = np.tanh(states @ p["A"] + p["a"])
    e = s @ p["q"]
    if mask is not None:
        e = np.where(mask, e, F32(-1e9))
    e = np.exp(e - e.max(axis=0))
    w = e / e.sum(axis=0)
    pooled = np.einsum("tr,trh->rh", w, states)
    return pooled @ p["v"] + p["c"][0], w, s, pooled


def logits(p: dict[str, np.ndarray], gf: np.ndarray, gb: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """Logits of windows from their gates (steps, rows, 3 * hidden)."""
    return _pool(p, np.concatenate((_run(gf, p["Uf"], mask, False), _run(gb, p["Ub"], mask, True)), axis=2), mask)[0]


def _back(grads: np.ndarray, gates: np.ndarray, u: np.ndarray, mask: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates and of ``u`` from those of the states."""
    n = len(u)
    d_gates, d_u = np.zeros_like(gates), np.zeros_like(u)
    carry = np.zeros_like(grads[0])
    for t, h, z, r, un, c in reversed(tape):
        total = grads[t] + carry
        dh = total * mask[t][:, None]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * un * r * (1 - r)
        da = np.concatenate((dz, dr, dc * r), axis=1)
        d_gates[t] = np.concatenate((dz, dr, dc), axis=1)
        d_u += h.T @ da
        carry = dh * z + da @ u.T + total * ~mask[t][:, None]
    assert d_gates.shape[2] == 3 * n
    return d_gates, d_u


def window_starts(n: int, width: int, stride: int) -> list[int]:
    """Starts of overlapping windows that cover ``n`` words, the last one flush with the end."""
    if n <= width:
        return [0] if n else []
    return [*range(0, n - width, stride), n - width]


def _vocabulary(docs: list[list[bytes]], labels: np.ndarray, most: int) -> tuple[dict[bytes, int], np.ndarray, dict[bytes, float]]:
    """Words of at least two documents, most telling first, and the smoothed log-odds of all."""
    seen = [Counter(), Counter()]
    for words, label in zip(docs, labels, strict=True):
        seen[int(label)].update(set(words))
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    total = seen[0] + seen[1]
    odds = {w: float(np.log((seen[1][w] + 0.5) / (n1 + 1)) - np.log((seen[0][w] + 0.5) / (n0 + 1))) for w in total}
    order = sorted((w for w in total if total[w] >= 2), key=lambda w: (-abs(odds[w]) * np.log1p(total[w]), w))[:most]
    return {w: i + 1 for i, w in enumerate(order)}, np.array([0.0] + [odds[w] for w in order], F32), odds


def fit(texts: list[bytes], labels: np.ndarray, *, hidden: int = 10, word_dim: int = 8, char_dim: int = 12, width: int = 32, stride: int = 16, vocabulary: int = 20_000, rounds: int = 10, negatives: int = 6_000, batch: int = 256, rate: float = 0.01, drop: float = 0.2, seed: int = 42) -> Model:
    """Trains on texts with labels 0 and 1; equal input gives an equal model.

    ``drop`` is the share of known words that training reads as unknown ones.
    """
    rng = np.random.default_rng(seed)
    docs = [tokens(t) for t in texts]
    vocab, odds, every = _vocabulary(docs, labels, vocabulary)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(F32)
    inner, n = word_dim + char_dim, hidden
    p = {"W": 0.1 * init(len(vocab) + 1, word_dim) * F32(np.sqrt(len(vocab) + 1)), "C": 0.1 * init(TRIGRAMS, char_dim) * F32(np.sqrt(TRIGRAMS)), "Xf": init(inner, 3 * n), "Xb": init(inner, 3 * n), "bf": np.zeros(3 * n, F32), "bb": np.zeros(3 * n, F32), "Uf": init(n, 3 * n), "Ub": init(n, 3 * n), "A": init(2 * n, n), "a": np.zeros(n, F32), "q": init(n), "v": init(2 * n), "c": np.zeros(1, F32)}
    p["W"][:, 0] = odds / 3
    model = Model(p, vocab, width, stride)
    starts = [window_starts(len(d), width, stride) for d in docs]
    positive = [i for i in range(len(docs)) if labels[i] == 1 and docs[i]]
    pool = [(i, s) for i in range(len(docs)) if labels[i] == 0 for s in starts[i]]
    negative = [i for i in range(len(docs)) if labels[i] == 0 and docs[i]]
    if not positive or not pool:
        p["c"][0] = 8.0 if positive else -8.0
        p["v"][:] = 0
        return model
    # the first choice: the window whose most telling word tells most
    chosen = {i: max(starts[i], key=lambda s: (max(every.get(w, 0.0) for w in docs[i][s : s + width]), -s)) for i in positive}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for turn in range(rounds):
        drawn = [pool[k] for k in rng.choice(len(pool), negatives, replace=len(pool) < negatives)]
        if turn >= 2:
            chosen = dict(zip(positive, _worst(model, [docs[i] for i in positive])[0].tolist(), strict=True))
            start, value = _worst(model, [docs[i] for i in negative])
            hardest = np.lexsort((start, -value))[: negatives // 4]
            drawn += [(negative[k], int(start[k])) for k in hardest.tolist()]
        repeat = max(1, len(drawn) // (2 * len(positive)))
        examples = [(i, chosen[i], 1) for i in positive for _ in range(repeat)] + [(i, s, 0) for i, s in drawn]
        weight = len(drawn) / (repeat * len(positive)) / 2
        order = rng.permutation(len(examples))
        for at in range(0, len(order), batch):
            some = [examples[k] for k in order[at : at + batch]]
            grads = _gradients(model, [docs[i][s : s + width] for i, s, _ in some], np.array([y for _, _, y in some], F32), weight, (rng, drop))
            step += 1
            speed = rate * 0.5 ** (3 * turn / rounds)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(F32)
    return model


def _padded(windows: list[list[bytes]], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, and (steps, rows) of their numbers with a mask of what is no padding."""
    index: dict[bytes, int] = {}
    at = np.zeros((len(windows), width), np.int64)
    mask = np.zeros((len(windows), width), bool)
    for k, w in enumerate(windows):
        at[k, : len(w)] = [index.setdefault(x, len(index)) for x in w]
        mask[k, : len(w)] = True
    return list(index), at.T, mask.T


def _gradients(model: Model, windows: list[list[bytes]], y: np.ndarray, positive_weight: float, drop: tuple[np.random.Generator, float]) -> dict[str, np.ndarray]:
    p = model.p
    words, at, mask = _padded(windows, model.width)
    x = model.inputs(words)
    known = np.array([model.vocabulary.get(t, 0) for t in words])
    if drop[1]:  # some known words are read as unknown, so that characters are learnt
        known[drop[0].random(len(known)) < drop[1]] = 0
        x[:, : p["W"].shape[1]] = p["W"][known]
    gf, gb = (x @ p["Xf"] + p["bf"])[at], (x @ p["Xb"] + p["bb"])[at]
    tf: list = []
    tb: list = []
    states = np.concatenate((_run(gf, p["Uf"], mask, False, tf), _run(gb, p["Ub"], mask, True, tb)), axis=2)
    out, w, s, pooled = _pool(p, states, mask)
    scale = np.where(y == 1, F32(positive_weight), F32(1)) / F32(len(y))
    d_out = (_sigmoid(out.copy()) - y) * scale
    d_pooled = d_out[:, None] * p["v"]
    d_states = w[:, :, None] * d_pooled
    d_w = np.einsum("trh,rh->tr", states, d_pooled)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    d_s = d_e[:, :, None] * p["q"] * (1 - s * s)
    d_states += d_s @ p["A"].T
    n = model.hidden
    d_gf, d_uf = _back(d_states[:, :, :n], gf, p["Uf"], mask, tf)
    d_gb, d_ub = _back(d_states[:, :, n:], gb, p["Ub"], mask, tb)
    flat = at.ravel()
    by_word = [np.zeros((len(words), d_gf.shape[2]), F32) for _ in range(2)]
    for total, d in zip(by_word, (d_gf, d_gb), strict=True):
        np.add.at(total, flat, d.reshape(len(flat), -1))
    d_x = by_word[0] @ p["Xf"].T + by_word[1] @ p["Xb"].T
    own = p["W"].shape[1]
    d_words, d_chars = np.zeros_like(p["W"]), np.zeros_like(p["C"])
    np.add.at(d_words, known, d_x[:, :own])
    grams, counts = trigrams(words)
    np.add.at(d_chars, grams, np.repeat(d_x[:, own:] / counts[:, None], counts, axis=0))
    return {"W": d_words, "C": d_chars, "Xf": x.T @ by_word[0], "Xb": x.T @ by_word[1], "bf": by_word[0].sum(axis=0), "bb": by_word[1].sum(axis=0), "Uf": d_uf, "Ub": d_ub, "A": np.einsum("trh,trn->hn", states, d_s), "a": d_s.sum(axis=(0, 1)), "q": np.einsum("trn,tr->n", s, d_e), "v": pooled.T @ d_out, "c": np.array([d_out.sum()], F32)}


class Scorer:
    """Scores texts in batches; keeps the gates of words that it has met, up to a bound."""

    def __init__(self, model: Model, rows: int = 2048, remembered: int = 200_000):
        self.model, self.rows, self.remembered = model, rows, remembered
        self._forget()

    def _forget(self) -> None:
        words = [b"?", *self.model.vocabulary]
        self.index = {w: i for i, w in enumerate(words)}
        f, b = self.model.gates(words)
        self.table = np.concatenate((f, b), axis=1)
        self.used = len(words)

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        at = np.array([get(w, -1) for w in words], np.int64)
        if len(at) and at.min() < 0:
            new = list(dict.fromkeys([words[i] for i in np.flatnonzero(at < 0).tolist()]))
            f, b = self.model.gates(new)
            if self.used + len(new) > len(self.table):
                bigger = np.empty((max(2 * len(self.table), self.used + len(new)), self.table.shape[1]), F32)
                bigger[: self.used] = self.table[: self.used]
                self.table = bigger
            self.table[self.used : self.used + len(new), : f.shape[1]] = f
            self.table[self.used : self.used + len(new), f.shape[1] :] = b
            self.index.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
            at = np.array([get(w, -1) for w in words], np.int64)
        return at

    def windows(self, texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, start, logit) arrays over all windows of the texts' words."""
        model = self.model
        width = model.width
        if self.used > self.remembered:
            self._forget()
        n = 3 * model.hidden
        flat = self._look_up([w for t in texts for w in t])
        begin = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        full = [(k, s) for k, t in enumerate(texts) if len(t) >= width for s in window_starts(len(t), width, model.stride)]
        short = [(k, 0) for k, t in enumerate(texts) if 0 < len(t) < width]
        for group, padded in ((full, False), (short, True)):
            for at in range(0, len(group), self.rows):
                part = np.array(group[at : at + self.rows], np.int64)
                where = begin[part[:, 0]] + part[:, 1]
                if padded:
                    lengths = (begin[part[:, 0] + 1] - begin[part[:, 0]])[None, :]
                    steps = np.arange(int(lengths.max()))[:, None]
                    mask = steps < lengths
                    rows = self.table[flat[np.minimum(where + steps, begin[part[:, 0] + 1] - 1)]]
                else:
                    mask, rows = None, self.table[flat[where + np.arange(width)[:, None]]]
                yield part[:, 0], part[:, 1], logits(model.p, rows[:, :, :n], rows[:, :, n:], mask)

    def scores(self, texts: list[bytes], most: int = 400_000) -> np.ndarray:
        """Score of each text: its worst window's; 0 where a text has no words."""
        out = np.full(len(texts), -np.inf, np.float64)
        at, size, begin = [], 0, 0

        def flush() -> None:
            for text, _, value in self.windows(at):
                np.maximum.at(out, begin + text, value)

        for k, t in enumerate(texts):
            words = tokens(t)
            if at and size + len(words) > most:
                flush()
                at, size, begin = [], 0, k
            at.append(words)
            size += len(words)
        if at:
            flush()
        return 1 / (1 + np.exp(-out))


def _worst(model: Model, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Start and logit of the worst window of each document."""
    best, start = np.full(len(docs), -np.inf), np.zeros(len(docs), np.int64)
    for text, at, value in Scorer(model).windows(docs):
        for k, s, v in zip(text.tolist(), at.tolist(), value.tolist(), strict=True):
            if v > best[k]:
                best[k], start[k] = v, s
    return start, best


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learnt from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, most: tuple[int, int]) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of at most ``most`` ids of labels 0 and 1, those of the least hashes, held-out ids left out.

    An id that several documents have counts once, with the least of its texts.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_key")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    drawn = [rows.where(F.col("_label") == k).orderBy(F.xxhash64("_key"), "_key").limit(n) for k, n in enumerate(most)]
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(drawn[0].union(drawn[1])), F.col("_id") == F.col("_key")).groupBy("_key", "_label").agg(F.min("_text").alias("_text")).select("_key", "_text", "_label").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1]))
    return [r[1].encode() for r in found], np.array([r[2] for r in found], np.int64)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, score (0 to 1) and predicted (1 from 0.5 on).

    Null, empty and wordless texts score 0. Ids may be null or repeat; other columns are
    ignored; equal texts score equally up to rounding; empty input, empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values = scorer.scores(text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values), pa.array((values >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: tuple[int, int] = (3000, 1500), **training: object) -> DataFrame:
    """Trains on a bounded sample of labelled rows that are not held out and scores all rows.

    ``most`` bounds the training rows of labels 0 and 1. Returns ``id_col``, held_out, score
    and predicted, as `score` defines them. With labels of one kind only, all scores are
    near that label.
    """
    texts, known = sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, most=most)
    scored = score(docs, fit(texts, known, **training), id_col=id_col, text_col=text_col)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")
