from __future__ import annotations

import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.compare import TABLES, assert_same
from vellum.llm import mixing, queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_the_oracle(spark, sf_dir, sf):
    assert_same(spark, f"{sf_dir}/../{sf}", queries.op9_mixing, queries.oracle_sql()["op9_mixing"])


def test_shards_match_the_oracle(spark, sf_dir, tmp_path):
    how = {**queries.MIX, "shard_rows": 20}
    mixed = lambda sp, at: mixing.mix(sp.read.parquet(f"{at}/documents.parquet"), **how).select("doc_id", "size", "source_size", "target", "taken")
    assert_same(spark, f"{sf_dir}/../sf0.01", mixed, mixing.oracle(**how))
    for name in set(TABLES) - {"documents"}:
        os.symlink(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hot = docs.limit(1).crossJoin(spark.range(700)).drop("id")  # a row that repeats, and null ids of many texts
    docs.union(hot).union(docs.select(F.lit(None).cast("long"), *docs.columns[1:])).write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(spark, str(tmp_path), mixed, mixing.oracle(**how))


def test_repeats_and_null_ids_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 64)
    docs = spark.createDataFrame([(None, "a", f"text {n}") for n in range(600)] + [(7, "a", "the same text")] * 600, "doc_id long, source string, text string")
    groups = docs.select(F.col("doc_id").alias("_id"), "source", F.lit(3).cast("long").alias("size"), F.md5("text").alias("_text")).groupBy("_id", "source", "size", "_text").agg(F.count("*").alias("times"))
    rows = mixing.numbered(groups).collect()
    assert sorted(r["copy"] for r in rows if r["_id"] == 7) == list(range(600)) and len(rows) == 1200
    got = mixing.mix(docs, shard_rows=100)
    assert got.count() == 1200 and got.agg(F.sum("taken")).first()[0] > 0


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, limit=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = budget * sum(sizes.values()), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > limit * sizes[s] + 1e-9}
        if not over:
            return target | share
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(rows, got, block):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {i: s for i, s, _ in rows}
    for i, s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[s]
        assert r.taken == r.copies * r.size + sum(r.span)
        assert all(0 <= a and a + n <= r.size and n > 0 for a, n in zip(r["from"], r.span, strict=True)) and sum(r.span) <= r.size
    want = brute_targets(sizes)
    assert target == pytest.approx(want)
    return {s: taken[s] - want[s] for s in want}


def test_edge_cases_and_shards(spark):
    rows = [(i, f"s{i % 7}" if i % 3 else "hot", "w " * (i % 50)) for i in range(3000)]
    rows += [(9001, None, "a b c"), (9002, "empty", None), (9003, "empty", ""), (9004, "long", "x " * 100_000), (None, "s1", "n n"), (9005, "é", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x")).withColumn("shard", F.lit(1))
    first = mixing.mix(docs, shard_rows=200).collect()
    off = check(rows, first, 8)
    assert all(abs(v) <= 8 * 16 for v in off.values()), off
    again = mixing.mix(docs.repartition(7), shard_rows=200).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
    assert mixing.mix(docs.limit(0)).collect() == []


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x y z")] * 5 + [(2, "b", "p q")], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 6


def test_apportionment_by_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 7.5}
    for seats in (1, 2, 5, 7, 23, 100):
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max(votes, key=lambda v: votes[v] / (2 * want[v] + 1))
            want[best] += 1
        units = spark.createDataFrame([(k, v, seats, 1000) for k, v in votes.items()], "k string, v double, seats long, most long")
        got = {r.k: r.quota for r in mixing.apportion(units, group=[], key=["k"], claim="v", seats="seats", most="most").collect()}
        assert got == want
