from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from vellum.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_matches_brute_force_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got.values())
    assert {i: r.component_id for i, r in got.items()} == brute_components(want)


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (4, " \t\n"), (8, "one"), (9, "ONE"), (9, "ONE"), (None, "one"), (7, "x " * 200_000), (6, "Ünï   a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert len(got) == len(rows)
    by = {k[1]: (f, c) for k, f, c in got if not k[0]}
    assert by[3] == by[4] == by[5] == ("0" * 16, 3)
    assert by[8][1] == by[9][1] == 8 and [c for k, _, c in got if k[0]] == [8]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2, 3):
        tables = [m & (1 << 64) - 1 for m in simhash.masks(radius)]
        rng = random.Random(radius)
        for _ in range(2000):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(flips & m == 0 for m in tables)


def test_links_have_the_closure_of_all_pairs_in_crowded_buckets(spark):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    seen = {base}
    for _ in range(400):
        x = rng.choice(sorted(seen)) ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3))))
        seen.add(x)
    seen |= {rng.getrandbits(64) for _ in range(100)}
    for radius in (1, 2, 3):
        frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in seen], "fp long")
        got = {(r.node, r.root) for r in simhash.connected(simhash.links(frame, radius=radius)).collect()}
        signed = sorted(x - (1 << 64) if x >> 63 else x for x in seen)
        parent = {x: x for x in signed}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for n, a in enumerate(signed):
            for b in signed[:n]:
                if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        assert got == {(x, find(x)) for x in signed if find(x) != x}
