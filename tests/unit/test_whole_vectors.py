from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellum import catalog
from vellum.operators import search as S


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))


def test_the_index_finds_nine_of_ten_neighbours_of_every_hundredth_vector(spark, sf_dir, rows):
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    want = {(r.query_id, r.id) for r in S.top_k(rows, asked, 4).collect()}
    got = {(r.query_id, r.id) for r in catalog.queries()["k04_lsh_recall"](spark, sf_dir).collect()}
    assert {q for q, _ in got} == {r.id for r in rows.where("id % 100 = 0").collect()}
    print("recall", len(got & want) / len(want))
    assert len(got & want) >= 0.9 * len(want)


def test_prompt_quality_of_all_pairs(spark, sf_dir, rows):
    found = rows.collect()
    norm = lambda v: sum(x * x for x in v) ** 0.5
    pairs = [(sum(x * y for x, y in zip(a.embedding, b.embedding, strict=True)) / norm(a.embedding) / norm(b.embedding), a.label == b.label) for b in found if b.id % 100 == 0 for a in found if a.id != b.id]
    near, far = [s for s, r in pairs if r], [s for s, r in pairs if not r]
    won = sum((x > y) + (x == y) / 2 for x in near for y in far) / len(near) / len(far)
    got = catalog.queries()["k07_prompt_quality"](spark, sf_dir).first()
    assert (got.related_mean, got.unrelated_mean, got.auc) == pytest.approx((sum(near) / len(near), sum(far) / len(far), won), abs=1e-6)
