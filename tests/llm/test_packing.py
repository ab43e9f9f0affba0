from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import packing

PATHS = dict(tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def rebuilt(rows):
    """Tokens of each document from its pieces; checks that pieces lie gaplessly in documents and sequences."""
    docs, places = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r.tokens), "<u4")
        assert len(ids) == r.length > 0
        docs.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {}
    for name, parts in docs.items():
        parts.sort(key=lambda x: x[0])
        at = 0
        for start, ids, total in parts:
            assert start == at
            at += len(ids)
        assert at == total
        whole[name] = np.concatenate([p[1] for p in parts]).tolist()
    return whole, [max(o + n for o, n in s) for s in places.values()]


def test_round_trip_and_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATHS["tokenizer_path"])
    whole, lengths = rebuilt(packing.pack(docs, **PATHS).collect())
    for r in docs.collect():
        assert whole[r.doc_id] == [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert padding < 0.01 * sum(lengths)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, " " * 50_000), (5, "word. " * 40_000), (6, "x" * 30_000), (None, "é\U0001f600"), (7, "same"), (8, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(1)).withColumn("id", F.lit("x")).coalesce(1)
    tokenizer = Tokenizer.from_file(PATHS["tokenizer_path"])
    whole, _ = rebuilt(packing.pack(docs, **PATHS).collect())
    assert whole == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert packing.pack(docs.limit(0), **PATHS).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    size = 20
    places = [0]
    for _ in range(60):
        places.append(places[-1] + rng.randint(1, 12))
    costs = [rng.choice((0, 2, 7)) for _ in places]
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            if places[j] - places[i] <= size:
                best[j] = min(best[j], best[i] + costs[j] + size - places[j] + places[i])
    want = min(best[i] for i in range(len(places)) if places[-1] - places[i] <= size)
    got = packing.cuts(np.array(places), np.array(costs), size)
    total = sum(costs[b] + size - places[b] + places[a] for a, b in zip(got, got[1:], strict=False))
    assert got[0] == 0 and places[-1] - places[got[-1]] <= size and total == want


def test_tail_lengths():
    for n in range(1, 2049):
        parts = packing.tail(n, 2048, 48)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts[:-1])
        assert parts[-1] & (parts[-1] - 1) == 0 or 2048 - parts[-1] <= 48
