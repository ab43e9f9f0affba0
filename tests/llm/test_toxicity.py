from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import queries, toxicity


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    texts = [b"one bad word here now", b"all fine", b"bad bad thing", b"quite good text that is long enough"] * 3
    model = toxicity.fit(texts, np.array([1, 0, 1, 0] * 3), hidden=3, word_dim=3, char_dim=2, width=6, stride=4, rounds=1, negatives=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    windows = [toxicity.tokens(t)[:6] for t in texts[:4]]
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        words, at, mask = toxicity._padded(windows, 6)
        f, b = model.gates(words)
        z = toxicity.logits(model.p, f[at], b[at], mask).astype(np.float64)
        return float(np.mean(np.where(y == 1, 2.0, 1.0) * (np.logaddexp(0, z) - y * z)))

    grads = toxicity._gradients(model, windows, y, 2.0, (rng, 0.0))
    for name, g in grads.items():
        flat = model.p[name].reshape(-1)
        spots = np.argsort(-np.abs(g).reshape(-1))[:3]
        for k in spots:
            old, eps = flat[k], 1e-2
            flat[k] = old + eps
            up = loss()
            flat[k] = old - eps
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[k]) < 2e-3 + 0.05 * abs(g.reshape(-1)[k]), name


def test_windows_cover_the_text():
    for stride in (8, 16, 24):
        for n in range(0, 200):
            starts = toxicity.window_starts(n, 32, stride)
            assert set().union(*(range(s, min(n, s + 32)) for s in starts)) == set(range(n))
            assert all(b - a <= stride for a, b in zip(starts, starts[1:], strict=False))


def test_a_passage_of_17_words_is_whole_in_a_window():
    model = toxicity.fit([b"one bad word", b"all fine"] * 4, np.array([1, 0] * 4), rounds=1, negatives=4)
    for n in range(17, 200):
        starts = toxicity.window_starts(n, model.width, model.stride)
        assert all(any(s <= at and at + 17 <= s + model.width for s in starts) for at in range(n - 16))


def test_held_out_quality(spark, sf_dir):
    at = f"{sf_dir}/../sf0.1"
    docs = spark.read.parquet(f"{at}/documents.parquet").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    rows = toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic")).join(docs.select("doc_id", "toxic"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    y, s = np.array([r.toxic for r in rows if r.held_out]), np.array([r.score for r in rows if r.held_out])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93 and ((s >= 0.5) == y).mean() > 0.96


def test_edge_cases(spark):
    rows = [(i, "nice words in a row " * 3 + ("rotten" if i % 2 else "")) for i in range(40)] + [(100, None), (101, ""), (102, " .,! "), (103, "fine " * 100_000 + "rotten"), (103, "fine"), (None, "rotten")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("_label", F.lit(0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("y"))
    got = toxicity.toxicity(docs, labels, rounds=4).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, k): r.score for k, r in enumerate(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score)))}
    assert sorted(v for (i, _), v in by.items() if i in (100, 101, 102)) == [0.0] * 3
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id < 40)
    assert max(r.score for r in got if r.doc_id == 103) >= 0.5 and [r.held_out for r in got if r.doc_id is None] == [False]
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r.predicted == 0 for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(1, f"copy {n} of a text") for n in range(500)] + [(2, None), (2, "x")], "doc_id long, text string")
    texts, known = toxicity.sample(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int"), id_col="doc_id", text_col="text", label_col="toxic", most=(10, 10))
    assert sorted(zip(texts, known.tolist(), strict=True)) == [(b"", 1), (b"copy 0 of a text", 0)]


def test_query_on_the_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op5_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
