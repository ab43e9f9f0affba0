from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vellum import catalog
from vellum.operators import edges as E
from vellum.operators import graph as G
from vellum.plans import tables as D

LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double"


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    """Suppliers 1 to 40 and 400 line items: kinds, confidences and sources of all sorts."""
    at, rng = str(tmp_path_factory.mktemp("graphs")), random.Random(5)
    rows = [(k, rng.randrange(1, 8), rng.randrange(1, 60), rng.randrange(1, 41), rng.choice("ANR"), float(rng.randrange(50)), rng.randrange(11) / 100) for k in range(400)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(k, f"name {k}") for k in range(1, 41)], "s_suppkey long, s_name string").write.parquet(f"{at}/supplier.parquet")
    return at


def test_path_labels_of_all_subjects_over_all_edges(spark, archive):
    steps = {}
    for r in D.edges(spark, archive).collect():
        if r.from_id != r.to_id:
            steps.setdefault(r.from_id, []).append((r.relation_type, r.id, r.to_id))
    want = {}
    for subject in range(1, 41):
        here, seen = {subject: ((), (subject,))}, {subject}
        for depth in (1, 2, 3):
            ahead = sorted((order + ((t, i),), (*chain, to)) for order, chain in here.values() for t, i, to in steps.get(chain[-1], []))
            here = {}
            for order, chain in ahead:
                if chain[-1] not in seen:
                    here.setdefault(chain[-1], (order, chain))
            seen |= set(here)
            if depth > 1:
                want |= {(subject, k): " → ".join(f"name {x}" if 1 <= x <= 40 else "?" for x in chain[::-1]) for k, (_, chain) in here.items()}
    got = {(r.subject, r.target): r.label for r in catalog.queries()["g05_path_labels"](spark, archive).collect()}
    assert got == want and {s for s, _ in got} - set(range(20))


def test_levels_and_units_of_all_users_over_all_relations(spark, archive):
    canonical = E.canonicalize(D.edges(spark, archive)).collect()
    run = lambda name: catalog.queries()[name](spark, archive).collect()
    got = {(r.user_id, r.node): (r.component, r.level) for r in run("g07_levels")}
    want = {}
    for user in range(5):
        # the forest of the best edges by brute force: relabel whole parts
        rows = sorted((r for r in canonical if r.user_id == user and r.delta is not None and r.from_id != r.to_id), key=lambda r: (-(r.confidence or 0), -r.n_sources, r.id, r.from_id, r.to_id))
        part = {x: {x: 0} for r in rows for x in (r.from_id, r.to_id)}
        for r in rows:
            a, b = part[r.from_id], part[r.to_id]
            if a is not b:
                shift = a[r.from_id] + r.delta - b[r.to_id]
                a |= {x: v + shift for x, v in b.items()}
                part |= dict.fromkeys(b, a)
        want |= {(user, x): (min(p), p[x] - min(p.values())) for x, p in part.items()}
    assert got == want and {u for u, _ in got} == set(range(5))
    assert {(r.user_id, r.node): r.level for r in run("g12_graph_payload") if r.level is not None}.keys() <= got.keys()
    assert {r.user_id for r in run("g12_graph_payload")} == {r.user_id for r in run("g15_default_root")} == set(range(5))
    wrong = {(r.user_id, r.id) for r in canonical if r.delta is not None and (r.user_id, r.from_id) in got and (r.user_id, r.to_id) in got and got[r.user_id, r.to_id][1] - got[r.user_id, r.from_id][1] != r.delta}
    assert {(r.user_id, r.id) for r in run("g08_level_mismatches")} == wrong
    nodes = {(r.user_id, x) for r in D.edges(spark, archive).collect() for x in (r.from_id, r.to_id)}
    assert {(r.user_id, r.node) for r in run("g10_unplaced")} == nodes - got.keys()
    unit = {k: {k} for k in range(1, 41)}
    for r in canonical:
        if r.canon_key == "pair:spouse":
            both = unit.setdefault(r.from_id, {r.from_id}) | unit.setdefault(r.to_id, {r.to_id})
            unit |= dict.fromkeys(both, both)
    assert {r.node: r.unit for r in run("g13_spouse_units")} == {k: min(unit[k]) for k in range(1, 41)}


def test_shards_of_a_family_keep_its_forest():
    rng = random.Random(3)
    rows = pd.DataFrame([(7, 7, 1, k, rng.randrange(30), rng.randrange(30), rng.randrange(-2, 3), -rng.randrange(3) / 2, -rng.randrange(1, 3)) for k in range(600)], columns=["user_id", "_root", "component", "id", "from_id", "to_id", "delta", "rank_confidence", "rank_sources"])
    parts = pd.concat([G._forest(rows[rows.id % 16 == k]) for k in range(16)])
    assert len(parts) <= 16 * 29 and G._levels_of(parts).equals(G._levels_of(rows))


@pytest.mark.parametrize("few", [0, 200_000])
def test_entities_of_any_number_are_merged(spark, tmp_path, monkeypatch, few):
    from vellum.plans import kinship

    monkeypatch.setattr(kinship, "FEW", few, raising=False)
    rows = [(k, 7, to, supplier, "A", 1.0, 0.01) for k, (supplier, to) in enumerate([(1009, 5), (1008, 5), (999, 5), (60_019, 60), (60_018, 59), (1_000_000_009, 19), (19, 18)])]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.user_id, r.canon_from, r.canon_to, r.n_sources) for r in catalog.queries()["g20_merge_entities"](spark, str(tmp_path)).collect()}
    assert got == {(4, 1008, 5, 1), (3, 1008, 5, 1), (4, 998, 5, 1), (4, 60_018, 60, 1), (3, 60_018, 58, 1), (4, 1_000_000_008, 18, 1)}
