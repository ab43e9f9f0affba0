from __future__ import annotations

import bz2
import datetime as dt
import gzip

from pyspark.sql import functions as F

from vellum import catalog
from vellum.functions import text as T
from vellum.operators import lm as N
from vellum.sources import texts as X
from vellum.streaming import archive as A


def test_word_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("# c\nДом/AB\nновый\tx\n12\nа\nкто-то 5к\n".encode())
    (tmp_path / "b.txt").write_bytes("Лес\nполе".encode("cp1251"))
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("река\n")
    with bz2.open(tmp_path / "d.txt.bz2", "wt") as f:
        f.write("гора\n")
    words = lambda *names: {r.word for r in X.word_forms(spark, [str(tmp_path / n) for n in names]).collect()}
    assert words("a.txt", "b.txt") == {"дом", "новый", "кто-то", "лес", "поле"} and words("c.txt.gz") == {"река"} and words("d.txt.bz2") == {"гора"}


def test_books_and_sentences(spark, tmp_path):
    (tmp_path / "book.txt").write_text(f"head\n{X.BOOK_START} X ***\nline one\nline two\n{X.BOOK_END} X ***\ntail")
    (tmp_path / "plain.txt").write_text("no marks")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in X.book_texts(spark, str(tmp_path)).collect()}
    assert got == {"book.txt": "line one\nline two\n", "plain.txt": "no marks"}
    (tmp_path / "s.tsv").write_text("1\tПервая фраза.\n2\tВторая.\n\nТретья")
    assert [r.sentence for r in X.sentences(spark, str(tmp_path / "s.tsv")).orderBy("n").collect()] == ["Первая фраза.", "Вторая.", "Третья"]
    assert X.sentences(spark, str(tmp_path / "s.tsv"), budget=5).count() == 1


def test_artifacts(spark, tmp_path):
    table = N.model(N.char_ngrams(spark.createDataFrame([("ababab",)], "text string"), 2), 1)
    X.save_model(table, str(tmp_path / "lm"), running_text_chars=6)
    again, meta = X.load_model(spark, str(tmp_path / "lm"))
    assert meta == {"running_text_chars": 6} and sorted((r.n, r.context, r.next) for r in again.collect()) == sorted((r.n, r.context, r.next) for r in table.collect())
    X.save_words(spark.createDataFrame([("б",), ("а",), ("а",)], "word string"), str(tmp_path / "words"))
    assert sorted(r.word for r in X.load_words(spark, str(tmp_path / "words")).collect()) == ["а", "б"] and X.load_words(spark, str(tmp_path / "none")) is None
    events = spark.createDataFrame([(1, "dismissed", dt.datetime(2026, 1, 2, 3))], "id long, action string, created_at timestamp")
    X.append_events(events, str(tmp_path / "log"))
    X.append_events(events, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("day = '2026-01-02'").count() == 2


def test_recognition_results(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"page_id": 1, "lines": [{"order_index": 0, "text": "да", "words": [{"text": "да", "confidence": 0.5}]}, {"order_index": 1, "text": null, "words": []}]}\n')
    lines, words = X.recognition_results(spark, str(tmp_path / "r.json"))
    assert sorted((r.order_index, r.predicted) for r in lines.collect()) == [(0, "да"), (1, None)] and [(r.position, r.text, r.confidence) for r in words.collect()] == [(0, "да", 0.5)]


def test_strict_schemas():
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"b": {}}}}}, "anyOf": [{"properties": {"c": {}}}]}
    out = X.strict_schema(schema)
    assert out["required"] == ["a"] and out["additionalProperties"] is False and out["properties"]["a"]["items"]["required"] == ["b"] and out["anyOf"][0]["required"] == ["c"]


def test_manuscripts_need_confirmation(spark):
    pages = spark.createDataFrame([(1, 10, "CONFIRMED", None), (1, 11, "EDITING", "x.png")], "user_id long, page_id long, status string, file_name string")
    lines = spark.createDataFrame([(10, 5, 1, "", "низ"), (10, 4, 0, "верх", "верт"), (11, 6, 0, None, "x")], "page_id long, line_id long, order_index int, corrected string, predicted string")
    row = X.manuscript_sources(pages, lines).collect()
    assert [(r.ref_id, r.text, r.title) for r in row] == [(10, "верх\nниз", "Стр. #10")]
    entry = X.manuscript_sources(pages, lines).select(T.line_for_offset(T.parse_line_map(F.col("line_map")), F.lit(5)).alias("l")).first()
    assert entry.l == 5


EVENT = "id long, action string, in_lexicon boolean, created_at timestamp"


def test_decision_stream_equals_batch(spark, tmp_path):
    rows = [(i, "accepted" if i % 3 else "dismissed", i % 2 == 0, dt.datetime(2026, 1, 1 + i % 3, i % 24)) for i in range(60)]
    frame = spark.createDataFrame(rows, EVENT)
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = A.decision_counts(A.source_stream(spark, str(tmp_path / "in"), EVENT, 2))
    got = A.run_once(stream, "decisions", "complete", str(tmp_path / "cp"))
    want = frame.groupBy(F.window("created_at", "1 day").alias("w"), "action", "in_lexicon").count()
    assert sorted((r.window_start, r.action, r.in_lexicon, r.n) for r in got.collect()) == sorted((r.w.start, r.action, r.in_lexicon, r["count"]) for r in want.collect())


def test_goal_stream_and_queue(spark, tmp_path):
    marks = spark.createDataFrame([(1, 1, "started"), (1, 2, "completed"), (1, 3, "mentioned"), (2, 1, "abandoned"), (2, 2, "progress"), (3, 1, "mentioned")], "goal_id long, seq long, progress_kind string")
    marks.write.parquet(str(tmp_path / "g"))
    got = A.run_once(A.goal_states(A.source_stream(spark, str(tmp_path / "g"), "goal_id long, seq long, progress_kind string")), "goals", "complete", str(tmp_path / "cp"))
    assert {r.goal_id: r.status for r in got.collect()} == {1: "completed", 2: "active", 3: "active"}
    work = spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 1))], "page_id long, created_at timestamp")
    work.write.parquet(str(tmp_path / "w"))
    got = A.run_once(A.queue_stream(A.source_stream(spark, str(tmp_path / "w"), "page_id long, created_at timestamp")), "work", "append", str(tmp_path / "cp2"))
    assert sorted(r.page_id for r in got.collect()) == [1, 2]


SOURCE = "user_id long, source_type string, ref_id long, text string, created_at timestamp"


def test_source_stream_upserts_once(spark, tmp_path):
    rows = [(1, "diary", 1, "a", dt.datetime(2026, 1, 1, 1)), (1, "diary", 1, "a", dt.datetime(2026, 1, 1, 1, 5)), (1, "diary", 2, "b", dt.datetime(2026, 1, 1, 2))]
    spark.createDataFrame(rows, SOURCE).write.parquet(str(tmp_path / "in"))
    changed = A.changed_sources(A.source_stream(spark, str(tmp_path / "in"), SOURCE))
    A.upsert_into(changed, str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id", "source_type", "ref_id"], "created_at").awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))
    assert sorted((r.ref_id, r.text) for r in spark.read.parquet(str(last)).collect()) == [(1, "a"), (2, "b")]


def test_changed_sources_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    at = dt.datetime(2026, 1, 1)
    rows = [(k, at + dt.timedelta(hours=k), k % 40, "view", 1.0, f"p{k % 3}") for k in range(600)] + [(600, at, None, "view", 1.0, None)]
    run = lambda: catalog.queries()["t01_changed_sources"](spark, str(tmp_path)).collect()
    monkeypatch.setattr(A, "run_once", None)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "events.parquet"))
    assert [r.n for r in run()] == [0]
    spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert [r.n for r in run()] == [121]


def test_edge_state_stream(spark, tmp_path):
    schema = "user_id long, canon_from long, canon_to long, canon_key string, source_id long, confidence double, relation_kind string"
    rows = [(1, 1, 2, "k", 1, 0.5, "uncle"), (1, 1, 2, "k", 2, 0.9, "aunt"), (1, 3, 4, "k", 1, 0.2, "x")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = A.run_once(A.edge_states(A.source_stream(spark, str(tmp_path / "in"), schema)), "edges_state", "update", str(tmp_path / "cp")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r.canon_from, r.confidence, r.n_sources, r.relation_kind) for r in got) == [(1, 0.9, 2, "aunt"), (3, 0.2, 1, "x")]
