from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from vellum.llm import queries, topk


def test_matches_the_oracle(spark, sf_dir):
    assert_same(spark, f"{sf_dir}/../sf0.01", queries.op4_topk, queries.oracle_sql()["op4_topk"])


def brute(rows, k, every):
    codes = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in codes if i % every == 0}):
        code = min(c for i, c in codes if i == q)
        best = sorted((-sum(a * b for a, b in zip(code, c, strict=True)), i) for i, c in codes if i != q and len(c) == len(code))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_small_buckets_and_edge_cases(spark, spread):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * math.exp(rng.gauss(0, spread)) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)] + [(500, None), (501, []), (502, [1.0] * 7 + [None]), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(520, [0.0] * 8), (540, [1.0, 2.0]), (541, [3.0, 1.0]), (542, [3.0, 1.0]), (542, [3.0, 1.0]), (560, [1e9] * 8), (561, [-1e9] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted(map(tuple, topk.top_k(frame, k=10, bucket=64, block=8).collect()))
    assert got == sorted(brute(rows, 10, 20))
    assert topk.top_k(frame.limit(0)).collect() == []


def test_pruning_keeps_what_reaches_the_floor():
    rng = np.random.default_rng(5)
    c = rng.integers(-40, 40, (500, 16))
    c[:50] = c[0] + rng.integers(-2, 3, (50, 16))
    c = c[np.argsort(-(c**2).sum(axis=1))]
    q = c[::7] + rng.integers(-3, 4, (len(c[::7]), 16))
    scores = q @ c.T
    least = np.sort(scores, axis=1)[:, -20].astype(float)
    got = {i: sorted(s.tolist()) for i, _, s in topk.search(np.full(len(q), -1), q, least, np.arange(len(c)), c, 20)}
    assert got == {i: np.sort(scores[i])[-20:].tolist() for i in range(len(q))}


def test_pairs_out_of_reach_are_not_made(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) * math.exp(rng.gauss(0, 1.5)) for _ in range(6)]) for i in range(2000)]
    rows += [(i, [0.5, 0.25, 0.5, 0.5, 0.5, 0.5]) for i in range(2000, 3000)]  # equal vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    made = topk.pairs(frame, id_col="vec_id", vector_col="embedding", k=10, every=20, scale=64.0, bucket=64, block=8)
    blocks, buckets = made.select("q_ids").distinct().count(), made.select("ids").distinct().count()
    assert blocks == 19 and made.count() < 0.6 * blocks * math.ceil(3000 / 64) and buckets > 1
    assert sorted(map(tuple, topk.top_k(frame, k=10, bucket=64, block=8).collect())) == sorted(brute(rows, 10, 20))
    hits = made.mapInArrow(topk._hits(10), "query_id bigint, vec_id bigint, score bigint").count()
    assert hits < 150 * 10 * 8  # not ten from each bucket of equal vectors
