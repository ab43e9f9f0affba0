"""Queries on facts, entities, goals and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import register
from vellum.functions import text as T
from vellum.operators import facts as O
from vellum.operators import relational as R
from vellum.operators import resolve as S
from vellum.plans import tables as D


@register("b06_events", f"WITH {D.FACTS} SELECT user_id, count(*) FILTER (importance >= 0.4) AS n_events, count(*) FILTER (importance IS NULL OR importance < 0.4) AS n_facts FROM facts GROUP BY user_id")
def events(spark, sf):
    a, b = O.split_events(D.facts(spark, sf))
    counts = a.select("user_id", F.lit(1).alias("e")).unionByName(b.select("user_id", F.lit(0).alias("e")))
    return counts.groupBy("user_id").agg(F.sum("e").alias("n_events"), F.sum(1 - F.col("e")).alias("n_facts"))


def _valued(spark, sf):
    rows = D.facts(spark, sf)
    value = T.fact_value(F.col("predicate_kind"), F.col("time_text"), F.col("object_text"), F.col("object_name"), F.col("time_iso"))
    return rows.withColumn("value", value)


_VALUED = f"{D.FACTS}, v AS (SELECT *, CASE WHEN predicate_kind = 'birth' THEN CASE WHEN time_iso IS NOT NULL THEN 'iso:' || time_iso ELSE 'text:' END ELSE lower(object_text) END AS value FROM facts)"


@register("h05_fact_values", f"WITH {_VALUED} SELECT id, value FROM v")
def fact_values(spark, sf):
    return _valued(spark, sf).select("id", "value")


@register(
    "h11_functional_conflicts",
    f"""WITH {_VALUED}, p AS (SELECT b.user_id, b.subject_id, b.predicate_kind, b.id, a.id AS first_id, a.value AS first_value, b.value FROM v a JOIN v b USING (user_id, subject_id, predicate_kind)
WHERE a.id < b.id AND a.value <> '' AND b.value <> '' AND CASE WHEN predicate_kind = 'birth' THEN starts_with(a.value, 'iso:') AND starts_with(b.value, 'iso:') AND NOT (starts_with(a.value, b.value) OR starts_with(b.value, a.value)) ELSE a.value <> b.value END)
SELECT user_id, subject_id, predicate_kind, id, min(first_id) AS existing_id, arg_min(first_value, first_id) AS existing_value, any_value(value) AS incoming_value FROM p GROUP BY ALL""",
)
def conflicts(spark, sf):
    return O.functional_conflicts(_valued(spark, sf))


def _items(spark, sf):
    rows = D.facts(spark, sf)
    return rows.select("user_id", F.col("id").alias("item_id"), F.col("id").alias("source_id"), "subject_id", F.col("predicate_kind").alias("predicate"), "predicate_kind", F.lit(None).cast("long").alias("object_id"), "object_name", "object_text", "time_text", "time_iso", "importance", F.lit(None).cast("string").alias("recurrence"), F.lit(0.5).alias("confidence"), F.lit("q").alias("quote"))


@register("h09_decisions")
def decisions(spark, sf):
    return O.decide(O.prepared(_items(spark, sf))).groupBy("user_id", "action").agg(F.count("*").alias("n"))


@register("h10_merged_facts")
def merged(spark, sf):
    return O.merged_facts(O.decide(O.prepared(_items(spark, sf)))).select("user_id", "fact_id", "subject_id", "importance", "confidence")


@register("h13_fact_sources")
def fact_sources(spark, sf):
    return O.fact_sources(O.decide(O.prepared(_items(spark, sf))))


@register(
    "h04_date_digits",
    "SELECT o_orderkey, array_to_string(list_sort(list_transform(list_distinct(regexp_extract_all(strftime(o_orderdate, '%d.%m.%Y') || ' 7 123', '\\d{2,4}')), lambda x: x::INT)), ' ') AS digits FROM orders",
)
def digits(spark, sf):
    text = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" 7 123"))
    return D.table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(T.date_digits(text), lambda x: x.cast("int").cast("string")), " ").alias("digits"))


@register(
    "h06_dates_differ",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN false ELSE NOT starts_with(strftime(o_orderdate, '%Y-%m-%d'), '199' || (o_orderkey % 10)::VARCHAR) END AS differ FROM orders",
)
def dates_differ(spark, sf):
    year = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("199"), (F.col("o_orderkey") % 10).cast("string")))
    none = F.lit(None).cast("string")
    return D.table(spark, sf, "orders").select("o_orderkey", T.dates_differ(none, F.date_format("o_orderdate", "yyyy-MM-dd"), none, year).alias("differ"))


def _spans(spark, sf, part):
    return D.table(spark, sf, "lineitem").where(F.col("l_linenumber") % 2 == part).select((F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("source_id"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("end")).dropDuplicates(["source_id", "id"])


_SPANS = """s AS (SELECT DISTINCT ON (l_orderkey, id) * FROM (SELECT l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id, l_orderkey, l_linenumber % 2 AS part, l_quantity::INT AS start, l_quantity::INT + l_linenumber AS stop FROM lineitem))"""


@register("c10_interval_overlaps", f"WITH {_SPANS} SELECT a.l_orderkey AS source_id, a.id AS l_id, b.id AS r_id FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.part = 0 AND b.part = 1 AND a.start < b.stop AND b.start < a.stop")
def overlaps(spark, sf):
    return R.interval_overlaps(_spans(spark, sf, 0), _spans(spark, sf, 1), "source_id", bucket=16)


@register("c11_containing_texts", "SELECT n_nationkey AS name_id, item_id AS text_id FROM nation, benchmark WHERE contains(lower(text), lower(substr(n_name, 1, 3)))")
def containing(spark, sf):
    names = D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.substring("n_name", 1, 3).alias("name"))
    return R.containing_texts(names, D.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))


@register(
    "c12_match_reasons",
    """WITH f AS (SELECT o_custkey % 7 AS user_id, o_orderkey AS id, o_custkey % 50 AS subject_id, o_orderkey % 50 AS object_id FROM orders),
r AS (SELECT user_id, subject_id AS entity_id, id, 0 AS k FROM f UNION SELECT user_id, object_id, id, 1 FROM f)
SELECT user_id, entity_id, id, string_agg(CASE k WHEN 0 THEN 'subject' ELSE 'object' END, ',' ORDER BY k) AS reasons FROM r GROUP BY ALL""",
)
def reasons(spark, sf):
    none = F.lit(None)
    f = D.table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("user_id"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("subject_id"), (F.col("o_orderkey") % 50).alias("object_id"), none.cast("long").alias("source_id"), none.cast("int").alias("start"), none.cast("int").alias("end"), none.cast("string").alias("source_text"), none.cast("string").alias("object_text"))
    who = f.select("user_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id")).distinct().withColumn("name", F.lit("no such name"))
    mentions = spark.createDataFrame([], "entity_id long, id long, source_id long, start int, end int")
    return O.match_reasons(f, who, mentions).withColumn("reasons", F.array_join("reasons", ","))


@register(
    "d19_knowledge_stats",
    f"""WITH {D.FACTS}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM facts), g AS (SELECT c_custkey % 7 AS user_id, count(*) AS n FROM customer GROUP BY 1)
SELECT s.user_id, count(*) FILTER (importance >= 0.4) AS n_events, count(*) FILTER (importance < 0.4) AS n_facts, any_value(g.n) AS n_goals FROM s JOIN g USING (user_id) WHERE r <= 200 GROUP BY s.user_id""",
)
def stats(spark, sf):
    return O.knowledge_stats(D.facts(spark, sf), D.table(spark, sf, "customer").select((F.col("c_custkey") % 7).alias("user_id")))


_MARK = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'abandoned' WHEN 'signup' THEN 'started' ELSE 'mentioned' END"


@register("h23_goal_status", f"WITH e AS (SELECT user_id AS goal_id, event_id, {_MARK} AS k FROM events) SELECT goal_id, coalesce(arg_max(CASE k WHEN 'started' THEN 'active' ELSE k END, event_id) FILTER (k <> 'mentioned'), 'active') AS status, count(*) AS n_marks FROM e GROUP BY goal_id")
def goal_status(spark, sf):
    mark = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "abandoned").when(F.col("event_type") == "signup", "started").otherwise("view")
    rows = D.table(spark, sf, "events").select(F.col("user_id").alias("goal_id"), F.col("event_id").alias("seq"), O.progress_kind(mark).alias("progress_kind"))
    return O.goal_status(rows)


@register(
    "h27_validated_insights",
    """WITH i AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'habits' ELSE 'facts' END AS section, c_custkey AS item FROM customer),
e AS (SELECT section, item, o_orderkey AS id, o_orderstatus AS source_id FROM i JOIN orders ON o_custkey = item)
SELECT section, item, count(DISTINCT id)::INT AS n_evidence, count(DISTINCT source_id) AS n_sources FROM e GROUP BY ALL HAVING section <> 'habits' OR count(DISTINCT source_id) >= 2""",
)
def insights(spark, sf):
    orders = D.table(spark, sf, "orders")
    rows = orders.groupBy(F.col("o_custkey").alias("item")).agg(F.collect_list(F.struct(F.lit("fact").alias("kind"), F.col("o_orderkey").alias("id"))).alias("evidence")).withColumn("section", F.when(F.col("item") % 2 == 0, "habits").otherwise("facts")).withColumn("text", F.lit("t"))
    rows = rows.join(D.table(spark, sf, "customer").select(F.col("c_custkey").alias("item")), "item")
    known = orders.select(F.lit("fact").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source_id"), F.lit(False).alias("recurrent"))
    return O.validated_insights(rows, known).select("section", "item", F.size("evidence").alias("n_evidence"), "n_sources")


@register(
    "h28_digest",
    """WITH a AS (SELECT c_custkey % 5 AS user_id, c_custkey AS id, c_name AS label, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey DESC) AS position FROM customer),
b AS (SELECT o_custkey % 5, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey DESC) AS p FROM orders)
SELECT user_id, id, label, position::INT AS position, 'person' AS kind FROM a WHERE position <= 50 UNION ALL SELECT *, 'fact' FROM (SELECT * REPLACE (p::INT AS p) FROM b WHERE p <= 200)""",
)
def digest(spark, sf):
    c = D.table(spark, sf, "customer").select((F.col("c_custkey") % 5).alias("user_id"), F.col("c_custkey").alias("id"), "c_name")
    o = D.table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("user_id"), F.col("o_orderkey").alias("id"), "o_orderpriority")
    return O.digest({"person": (c, "c_name", 50), "fact": (o, "o_orderpriority", 200)})


@register("h26_forget_source", f"WITH {D.EDGES}, {D.CANONICAL.replace('FROM edges)', 'FROM edges WHERE source_id <> 7)')}, {D.MERGED} SELECT user_id, canon_key, count(*) AS n, sum(n_sources)::BIGINT AS n_sources FROM merged GROUP BY ALL")
def forget(spark, sf):
    from vellum.operators import edges as E

    _, _, left = O.forget_source({}, D.facts(spark, sf).withColumn("source_id", F.col("id")), D.edges(spark, sf), 7)
    return E.canonicalize(left).groupBy("user_id", "canon_key").agg(F.count("*").alias("n"), F.sum("n_sources").alias("n_sources"))


# --- entities -------------------------------------------------------------------------


@register(
    "c17_get_or_create",
    """WITH have AS (SELECT n_name, lower(n_name) AS k, n_nationkey AS id FROM nation WHERE n_nationkey < 10),
ask AS (SELECT lower(n_name) AS normalized_name, min(upper(n_name)) AS name FROM nation GROUP BY 1)
SELECT 1 AS user_id, 'place' AS entity_type, normalized_name, name, coalesce(id, 100 + row_number() OVER (PARTITION BY id IS NULL ORDER BY normalized_name) - 1)::BIGINT AS id, id IS NULL AS created FROM ask LEFT JOIN have ON k = normalized_name""",
)
def get_or_create(spark, sf):
    n = D.table(spark, sf, "nation")
    names = n.select(F.lit(1).alias("user_id"), F.lit("place").alias("entity_type"), F.upper("n_name").alias("name"))
    have = n.where("n_nationkey < 10").select(F.lit(1).alias("user_id"), F.lit("place").alias("entity_type"), F.lower("n_name").alias("normalized_name"), F.col("n_nationkey").cast("long").alias("id"))
    return S.get_or_create(names, have, F.lit(100).cast("long"))


@register("c16_repoint", "SELECT o_orderkey, CASE WHEN o_custkey % 10 = 9 THEN o_custkey - 9 ELSE o_custkey END AS o_custkey FROM orders")
def repoint(spark, sf):
    from vellum.operators import edges as E

    mapping = D.table(spark, sf, "customer").where("c_custkey % 10 = 9").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") - 9).alias("new_id"))
    return E.repoint(D.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), mapping, ["o_custkey"])


@register("c18_role_candidates", f"WITH {D.EDGES} SELECT DISTINCT user_id, from_id AS anchor_id, relation_kind AS kind, to_id AS entity_id FROM edges")
def role_candidates(spark, sf):
    rows = D.edges(spark, sf)
    anchors = rows.where("confidence > 0.5").select("user_id", F.col("from_id").alias("anchor_id"), F.col("relation_kind").alias("kind"), F.col("to_id").alias("entity_id"))
    return S.role_candidates(anchors, rows)


@register(
    "h18_grouped_relatives",
    f"""WITH {D.EDGES}, c AS (SELECT user_id, relation_kind AS kind, count(DISTINCT to_id) AS n_candidates, min(to_id) AS only_id FROM edges WHERE confidence >= 0.99 GROUP BY ALL),
m AS (SELECT user_id, relation_kind AS kind, relation_type AS label, count(*) AS n_mentions FROM edges GROUP BY ALL)
SELECT m.*, coalesce(n_candidates, 0) AS n_candidates, CASE WHEN n_candidates = 1 THEN only_id END AS accepted_id, coalesce(n_candidates, 0) > 1 AS ask FROM m LEFT JOIN c USING (user_id, kind)""",
)
def grouped_relatives(spark, sf):
    rows = D.edges(spark, sf)
    mentions = rows.select("user_id", F.col("relation_kind").alias("kind"), F.col("relation_type").alias("label"))
    some = rows.where("confidence >= 0.99").select("user_id", F.col("relation_kind").alias("kind"), F.col("to_id").alias("entity_id"))
    return S.grouped_relatives(mentions, some)


@register("h19_name_matches", "SELECT s_suppkey, true AS same, false AS other FROM supplier")
def name_matches(spark, sf):
    return D.table(spark, sf, "supplier").select("s_suppkey", T.name_matches(F.lower("s_name"), F.col("s_name")).alias("same"), T.name_matches(F.lit("Лена"), F.concat(F.lit("Елена "), F.col("s_name"))).alias("other"))


@register("h24_known_people", "SELECT * FROM (SELECT c_custkey % 5 AS user_id, c_custkey AS id, (row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey DESC))::INT AS position FROM customer) WHERE position <= 20")
def known_people(spark, sf):
    rows = D.table(spark, sf, "customer").select((F.col("c_custkey") % 5).alias("user_id"), F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("last_seen_at"), F.lit(None).cast("long").alias("anchor_entity_id"))
    return S.known_people(rows, 20).select("user_id", "id", "position")


@register("h15_embedding_candidates", "WITH p AS (SELECT a.vec_id AS new_id, b.vec_id AS id, round(list_cosine_similarity(a.embedding, b.embedding), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY similarity DESC, id) AS rank FROM p) SELECT new_id, count(*) AS n FROM r WHERE rank <= 5 AND similarity >= 0.3 GROUP BY new_id")
def embedding_candidates(spark, sf):
    e = D.table(spark, sf, "embeddings").select(F.col("label").alias("user_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = S.embedding_candidates(e.where("id % 50 = 0").withColumnRenamed("id", "new_id"), e.where("id % 50 <> 0"), 5, 0.3)
    return found.groupBy("new_id").agg(F.count("*").alias("n"))


@register("b08_nameless", "SELECT s_suppkey, s_suppkey % 4 IN (0, 1) AS nameless FROM supplier")
def nameless(spark, sf):
    name = F.when(F.col("s_suppkey") % 4 == 0, "Мой отец").when(F.col("s_suppkey") % 4 == 1, "ОНИ").when(F.col("s_suppkey") % 4 == 2, "мой отец Сергей").otherwise(F.col("s_name"))
    return D.table(spark, sf, "supplier").select("s_suppkey", T.is_nameless_person(name).alias("nameless"))


@register("b09_common_nouns", "SELECT s_suppkey, s_suppkey % 3 = 0 AS common FROM supplier")
def common_nouns(spark, sf):
    name = F.when(F.col("s_suppkey") % 3 == 0, "дом").when(F.col("s_suppkey") % 3 == 1, "Дом").otherwise("дом Петра")
    return D.table(spark, sf, "supplier").select("s_suppkey", T.is_common_noun(name).alias("common"))
