"""Packing token sequences with little padding, in input order.

Documents are laid end to end as tokens. A monotone-queue dynamic program chooses the
window cuts among document ends, sentence ends and, at a higher cost, every so many
tokens. A window costs its padding plus a penalty for what its right cut
truncates. Every task packs its own rows in blocks and hands the last, open window of a
block to the next, so nothing is shuffled and memory does not grow with the input.
"""

from __future__ import annotations

import base64
import functools
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_bytes

#: Tokens that are packed at once.
BLOCK = 1 << 19
#: Bits of a sequence id that number the sequences of a task.
SERIAL_BITS = 40


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _ranked(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(str(x.content) for x in _tokenizer(path).get_added_tokens_decoder().values())


@functools.lru_cache(maxsize=4)
def _sentence_ends(path: str) -> np.ndarray:
    """For each id, whether a sentence may end after it: a full stop, mark or line end closes it."""
    tokenizer = _tokenizer(path)
    size = tokenizer.get_vocab_size()
    ends = np.zeros(size, bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.rstrip("\"')»”’").endswith((".", "!", "?", "…", "Ċ"))  # U+010A stands for a line feed in byte-level vocabularies
    return ends


def encode(text: str, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None) -> np.ndarray:
    """Ids of ``text`` as the tokenizer file gives them without added special tokens.

    ``ranks_path`` may name the same vocabulary as byte ranks; it is used, being faster,
    for texts without special strings and without very long runs that its matcher refuses.
    """
    if ranks_path and not any(x in text for x in _specials(tokenizer_path)):
        try:
            return _ranked(ranks_path, pattern).encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its regular expression engine gave up on this text
            pass
    return np.array(_tokenizer(tokenizer_path).encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(places: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """Indexes into ``places`` where windows begin, the first and the open last one included.

    ``places`` are ascending cut positions from 0 to the end, no two neighbours more than
    ``size`` apart; ``costs`` the penalty of a cut at each. With p the place and f the best
    cost up to it, f(j) = cost(j) + size - p(j) + min over p(i) >= p(j) - size of f(i) + p(i);
    a monotone queue holds the candidates of that minimum. The open window costs nothing.
    """
    p, c = places.tolist(), costs.tolist()
    before = [0] * len(p)
    queue: deque[tuple[int, int, int]] = deque([(0, p[0], 0)])  # f + p, p, index
    push, pop, drop = queue.append, queue.pop, queue.popleft
    best, last = [0] * len(p), p[-1]
    for j in range(1, len(p)):
        at = p[j]
        low = at - size
        while queue[0][1] < low:
            drop()
        value, _, i = queue[0]
        before[j] = i
        if at == last:
            break
        best[j] = f = c[j] + size - at + value
        f += at
        while queue and queue[-1][0] >= f:
            pop()
        push((f, at, j))
    end = min((x for x in queue if x[1] >= last - size), key=lambda x: (x[0] - x[1], -x[1]))[2]
    found = [end]
    while end:
        end = before[end]
        found.append(end)
    return found[::-1]


def tail(length: int, size: int, cost: int) -> list[int]:
    """Lengths of the last sequences: powers of two need no padding, so cut where padding costs more."""
    found = []
    while length:
        whole = 1 << (length.bit_length() - 1)
        if whole == length or size - length <= cost:
            return [*found, length]
        found.append(whole)
        length -= whole
    return found


class _Packer:
    """The state of one task: documents whose tokens are not yet in a closed window."""

    def __init__(self, size: int, end_id: int, ends: np.ndarray, sentence_cost: int, cut_cost: int, step: int, first: int):
        self.size, self.end_id, self.ends, self.sentence_cost, self.cut_cost, self.step, self.next = size, end_id, ends, sentence_cost, cut_cost, step, first
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # id, tokens of it that went before, all its tokens
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        ids = np.append(ids, np.uint32(self.end_id)).astype("<u4")
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.held += len(ids)

    def close(self, last: bool) -> Iterator[tuple]:
        """Pieces of the closed windows; on ``last`` of all."""
        if not self.held:
            return
        ids = np.concatenate(self.ids)
        lengths = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        doc_at = np.concatenate(([0], np.cumsum(lengths)))
        cost = np.full(len(ids) + 1, -1, np.int32)
        cost[:: self.step] = self.cut_cost
        cost[1:][self.ends[ids]] = self.sentence_cost
        cost[doc_at] = 0
        places = np.flatnonzero(cost >= 0)
        starts = places[cuts(places, cost[places], self.size)]
        stop = len(ids)
        if last:
            starts = np.concatenate((starts, starts[-1] + np.cumsum(tail(stop - int(starts[-1]), self.size, self.cut_cost))[:-1])).astype(np.int64)
        else:
            stop = int(starts[-1])
        at = np.union1d(doc_at[doc_at < stop], starts[starts < stop])
        owner = np.searchsorted(doc_at, at, "right") - 1
        window = np.searchsorted(starts, at, "right") - 1
        until = np.append(at[1:], stop)
        for a, b, k, w in zip(at.tolist(), until.tolist(), owner.tolist(), window.tolist(), strict=True):
            name, gone, total = self.docs[k]
            yield name, a - int(doc_at[k]) + gone, b - a, ids[a:b].tobytes(), total, self.next + w, a - int(starts[w])
        self.next += len(starts) - (not last)
        keep = int(np.searchsorted(doc_at, stop, "right") - 1)
        if stop == len(ids):
            self.ids, self.docs, self.held = [], [], 0
            return
        name, gone, total = self.docs[keep]
        self.docs = [(name, gone + stop - int(doc_at[keep]), total), *self.docs[keep + 1 :]]
        self.ids = [ids[stop : doc_at[keep + 1]].copy(), *self.ids[keep + 1 :]]
        self.held = len(ids) - stop


def pack(docs: DataFrame, *, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, sentence_cost: int = 4, cut_cost: int = 24, cut_step: int = 64) -> DataFrame:
    """Packs every row's tokens, followed by ``end_id``, into sequences of at most ``size``.

    Returns one row per piece: ``id_col``, start (the document's tokens before it), length,
    tokens (binary, little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset.
    Order is that of the input's partitions. Null and empty texts are one token, ``end_id``.
    Ids may be null or repeat; each row is a document of its own. Other columns are ignored.
    ``sentence_cost`` and ``cut_cost`` are what a cut at a sentence end and at a plain
    place, every ``cut_step`` tokens, counts in tokens of padding; a cut at a document's
    end is free. Empty input, empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if not 1 <= cut_step <= size:
        raise ValueError("cut_step must lie between 1 and size")
    rows_out = 4096

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, end_id, _sentence_ends(tokenizer_path), sentence_cost, cut_cost, cut_step, TaskContext.get().partitionId() << SERIAL_BITS)
        arrow = None

        def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held = []
            for row in rows:
                held.append(row)
                if len(held) == rows_out:
                    yield to_batch(held)
                    held = []
            if held:
                yield to_batch(held)

        def to_batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [arrow, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "start", "length", "tokens", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            arrow = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                packer.add(name, encode(text.decode("utf-8", "replace"), tokenizer_path, ranks_path, pattern))
                if packer.held >= BLOCK:
                    yield from batches_of(packer.close(last=False))
        yield from batches_of(packer.close(last=True))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(scan, f"id {kind}, start bigint, length bigint, tokens binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
