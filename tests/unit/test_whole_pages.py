from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vellum import catalog
from vellum.operators import layout


def test_layout_of_pages_of_any_number(spark, tmp_path):
    rows = [(order, k, 10 * k, 3 * k, 20.0) for order in (5, 70_000) for k in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    pitch = {r.page_id: r.pitch for r in catalog.queries()["p02_pitch"](spark, str(tmp_path)).collect()}
    assert pitch == {5: 40.0, 70_000: 40.0}
    groups = catalog.queries()["p04_collinear_groups"](spark, str(tmp_path)).collect()
    assert {r.page_id for r in groups} == {5, 70_000} and len(groups) == 10


def joined(pairs):
    """Groups of one page by the definition, from rows l, r, cost, apart."""
    group, apart = {}, {frozenset((p.l, p.r)) for p in pairs if p.apart}
    for p in sorted((p for p in pairs if p.cost is not None), key=lambda p: (p.cost, p.l, p.r)):
        a, b = group.setdefault(p.l, {p.l}), group.setdefault(p.r, {p.r})
        if a is not b and not any(frozenset((x, y)) in apart for x in a for y in b):
            a |= b
            group |= dict.fromkeys(b, a)
    return {k: min(g) for k, g in group.items()}


@pytest.mark.parametrize("most", [1, 7, 500_000])
def test_groups_equal_those_of_single_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(layout, "_PAIRS", most, raising=False)
    rng, rows = random.Random(2), []
    for page in range(60):
        for k in range(rng.randrange(1, 14)):
            x, y = rng.randrange(300), rng.randrange(4) * 40 + rng.randrange(9)
            points = [[float(x + 30 * i), float(y + rng.randrange(6))] for i in range(rng.choice((0, 1, 2, 2, 2, 3, 5)))]
            rows.append((page, k if rng.random() < 0.95 else 0, rng.choice((points, points, points, [p[::-1] for p in points], None)) if k % 5 == 4 else points, 20.0))
    lines = spark.createDataFrame([*rows, (None, 1, [[0.0, 0.0], [9.0, 0.0]], 20.0), (2, None, [[0.0, 0.0], [9.0, 0.0]], 20.0)], "page_id long, line_id int, baseline array<array<double>>, height double")
    pitches = spark.createDataFrame([(p, None if p % 11 == 3 else 0.0 if p % 11 == 4 else 40.0) for p in range(60) if p % 11 != 5], "page_id long, pitch double")
    a = lines.where(F.size("baseline") >= 2).join(pitches.where("pitch > 0"), "page_id")
    both = a.select("page_id", "pitch", F.col("line_id").alias("l"), F.col("baseline").alias("lb")).join(a.select("page_id", F.col("line_id").alias("r"), F.col("baseline").alias("rb")), "page_id").where("l < r")
    facts = both.select("page_id", "l", "r", layout.continuation_cost(F.col("lb"), F.col("rb"), F.col("pitch")).alias("cost"), layout.stacked(F.col("lb"), F.col("rb"), F.col("pitch")).alias("apart")).collect()
    want = {p: joined([f for f in facts if f.page_id == p]) for p in range(60)}
    found = layout.collinear_groups(lines, pitches)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted([(p, k, want[p].get(k, k)) for p, k, *_ in rows] + [(None, 1, 1), (2, None, None)], key=key)
    assert sum(w != k for g in want.values() for k, w in g.items()) > 20


def test_pitch_and_groups_share_one_exchange_and_keep_lines_of_no_page(spark, tmp_path):
    rows = [(order, k, 10 * k, 3 * k, 20.0) for order in (5, None) for k in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.queries()["p04_collinear_groups"](spark, str(tmp_path))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page_id or 0, r.line_id == r.group) for r in found.collect()) == [(0, True)] * 5 + [(5, True)] * 5


def test_pitch_is_the_median_gap_of_text_lines(spark):
    line = lambda *ys: [[10.0 * k, float(y)] for k, y in enumerate(ys)]
    pages = {1: [line(0, 2), line(4, 4), line(40, 42), line(90, 90)], 2: [line(5, 5)] * 4, 3: [line(0, 0), line(1, 1), line(2, 2), line(9, 9)], 4: [line(0, 0), line(50, 50)], 5: [line(0, 0), line(40, 40), line(80, 80), line(160, 160), line(3)]}
    rows = [(p, x, 10.0 if p != 3 else 40.0) for p, lines in pages.items() for x in lines] + [(6, line(k, k), None) for k in (0, 30, 60, 90)]
    got = {r.page_id: r.pitch for r in layout.pitch(spark.createDataFrame(rows, "page_id long, baseline array<array<double>>, height double")).collect()}
    assert got == {1: (38.5 + 49.0) / 2, 2: None, 3: 3.0, 4: None, 5: 40.0, 6: 30.0}
