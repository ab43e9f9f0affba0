from __future__ import annotations

import random

import pytest

from vellum import catalog
from vellum.operators import lm as N


def test_log_probabilities_of_texts_of_any_length(spark, tmp_path):
    spark.createDataFrame([(1, "a b a c b c " * 20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "a b", 3), (2, "a b " * 500, 2000)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.logprob for r in catalog.queries()["n03_text_logprobs"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2} and got[2] < got[1] < 0


def test_log_probabilities_with_a_held_model_equal_those_by_joins(spark, monkeypatch):
    rng = random.Random(11)
    corpus = spark.createDataFrame([("".join(rng.choices("abc é", k=60)),) for _ in range(6)], "text string")
    texts = [(k, "".join(rng.choices("abc éxж𝒳", k=rng.randrange(12)))) for k in range(60)] + [(60, None), (3, "again abc"), (61, "")]
    frame = spark.createDataFrame(texts, "id long, text string")
    for order, made in ((1, 1), (2, 2), (4, 4), (4, 3), (3, 4), (6, 6)):
        table = N.model(N.char_ngrams(corpus, made), 2)
        found = N.text_logprobs(frame, table, order)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as patch:
            patch.setattr(N, "HELD", 0)
            want = {r.id: r.logprob for r in N.text_logprobs(frame, table, order).collect()}
        got = {r.id: r.logprob for r in found.collect()}
        assert got == pytest.approx(want, rel=1e-12) and len(got) == 62
    none = table.where("n > 9")
    assert {r.id: r.logprob for r in N.text_logprobs(frame, none, 4).collect()}[1] == pytest.approx(-12.0 * len(texts[1][1]))
