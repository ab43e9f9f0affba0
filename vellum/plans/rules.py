"""Queries on single rules: flags, labels, lookups, proposals, evidence, geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.catalog import register
from vellum.functions import kin
from vellum.functions import text as T
from vellum.functions import udfs as U
from vellum.operators import edges as E
from vellum.operators import facts as O
from vellum.operators import layout
from vellum.operators import lexicon as L
from vellum.operators import lm as N
from vellum.operators import relational as R
from vellum.operators import resolve as S
from vellum.operators import search as V
from vellum.operators import training as M
from vellum.plans import language
from vellum.plans import tables as D
from vellum.sources import texts as X


@register("a03_exists", "SELECT count(*) > 0 AS found FROM events WHERE event_type = 'error'")
def exists(spark, sf):
    return spark.range(1).select(F.lit(R.exists(D.table(spark, sf, "events"), F.col("event_type") == "error")).alias("found"))


def _pages(spark, sf):
    """Lines with states: every third page is confirmed, every second line corrected."""
    rows = D.lines(spark, sf)
    return rows.select("page_id", "author_id", "order_index", F.when(F.col("page_id") % 3 == 0, "CONFIRMED").otherwise("EDITING").alias("status"), F.col("text").alias("predicted"), F.when(F.col("order_index") % 2 == 0, F.replace("text", F.lit("e"), F.lit("E"))).alias("corrected"))


_STATES = f"{D.LINES}, s AS (SELECT page_id, author_id, order_index, CASE WHEN page_id % 3 = 0 THEN 'CONFIRMED' ELSE 'EDITING' END AS status, text AS predicted, CASE WHEN order_index % 2 = 0 THEN replace(text, 'e', 'E') END AS corrected FROM lines)"


@register("a07_manuscript_sources", f"WITH {_STATES} SELECT page_id AS ref_id, sha256(string_agg(coalesce(nullif(corrected, ''), predicted), chr(10) ORDER BY order_index)) AS text_hash FROM s WHERE status = 'CONFIRMED' GROUP BY 1")
def manuscripts(spark, sf):
    lines = _pages(spark, sf).withColumn("line_id", F.col("order_index").cast("long"))
    pages = lines.select("page_id", F.lit(1).alias("user_id"), "status", F.lit("").alias("file_name")).distinct()
    return X.manuscript_sources(pages, lines).select("ref_id", T.text_hash(F.col("text")).alias("text_hash"))


@register("a15_author_lines", f"WITH {_STATES} SELECT page_id, order_index::INT AS order_index FROM s WHERE author_id = 'src1' AND status = 'CONFIRMED' AND page_id <> 21")
def author_lines(spark, sf):
    out = spark.createDataFrame([(21,)], "page_id long")
    return X.author_lines(_pages(spark, sf), "src1", out).select("page_id", "order_index")


@register("a18_model_answers", "SELECT event_id AS source_id, event_type AS name FROM events")
def answers(spark, sf):
    body = F.concat(F.lit('note {"entities": [{"name": "'), "event_type", F.lit('", "aliases": []}, null]}'))
    rows = D.table(spark, sf, "events").select(F.col("event_id").alias("source_id"), F.lit("entities").alias("kind"), body.alias("json"))
    return X.parse_answers(rows, "entities").select("source_id", "name")


@register("a25_evaluation_pages", f"WITH {_STATES} SELECT page_id, order_index::INT AS order_index, corrected AS reference FROM s WHERE status IN ('EDITING') AND trim(corrected) <> ''")
def evaluation(spark, sf):
    return X.evaluation_pages(_pages(spark, sf), ["EDITING"]).select("page_id", "order_index", "reference")


@register("b11_open_conflicts", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN c_name END AS subject FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 200")
def open_conflicts(spark, sf):
    rows = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"), F.lit(None).cast("long").alias("existing_fact_id"), F.when(F.col("o_orderstatus") != "O", 1).alias("resolved_at"))
    people = D.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return R.open_conflicts(rows, spark.createDataFrame([], "id long, predicate string"), people).select("id", "subject")


@register("b12_recognized", "SELECT c_nationkey AS source_id, lower(c_mktsegment) AS normalized_name, max(c_acctbal) AS score, count(*) AS n_mentions FROM customer WHERE c_acctbal >= 5000 GROUP BY ALL")
def recognized(spark, sf):
    rows = D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("source_id"), F.lit("x").alias("entity_type"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("score"))
    return S.recognized_entities(rows, 5000).drop("entity_type")


@register("b14_stale_insights", "WITH v AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n % 2 = 1 AS stale FROM v")
def stale(spark, sf):
    now = D.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("version"))
    return R.stale_versions(now.withColumn("version", F.col("version") - F.col("version") % 2), now, ["user_id"]).select("user_id", "stale")


@register(
    "c20_evidence_report",
    f"""WITH {D.EDGES}, r AS (SELECT from_id, to_id, min(id) AS id, min(relation_kind) AS relation_kind FROM edges GROUP BY 1, 2)
SELECT r.id, a.s_name AS from_name, r.relation_kind, b.s_name AS to_name, e.source_id FROM r JOIN supplier a ON a.s_suppkey = from_id JOIN supplier b ON b.s_suppkey = to_id LEFT JOIN edges e ON e.from_id = r.from_id AND e.to_id = r.to_id AND e.source_id % 2 = 0""",
)
def evidence_report(spark, sf):
    rows = D.edges(spark, sf)
    heads = rows.groupBy("from_id", "to_id").agg(F.min("id").alias("id"), F.min("relation_kind").alias("relation_kind"))
    said = rows.where("source_id % 2 = 0").join(heads.select("from_id", "to_id", F.col("id").alias("relation_id")), ["from_id", "to_id"]).select("relation_id", "source_id", "confidence")
    sources = rows.select(F.col("source_id").alias("id"), F.lit("t").alias("title")).distinct()
    people = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.evidence_report(heads, said, sources, people).select("id", "from_name", "relation_kind", "to_name", "source_id")


@register("b15_folder_names", "SELECT s_suppkey, s_name || ' x' AS name FROM supplier")
def folder_names(spark, sf):
    return D.table(spark, sf, "supplier").select("s_suppkey", T.folder_name(F.concat(F.lit("  "), "s_name", F.lit("   x "))).alias("name"))


@register("b18_verified", "SELECT l_orderkey, min(CASE WHEN l_linenumber = 7 THEN false ELSE l_discount < 0.08 END) AS verified FROM lineitem GROUP BY 1")
def verified(spark, sf):
    rows = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.when(F.col("l_linenumber") != 7, F.col("l_discount") < 0.08).alias("in_lexicon"))).alias("c"))
    return rows.select("l_orderkey", T.suggestion_verified(F.col("c")).alias("verified"))


@register("c03_page_union", "SELECT doc_id AS id, 'diary' AS kind FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT page_id, 'manuscript' FROM pages")
def page_union(spark, sf):
    a = D.table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.lit(0).alias("created_at"))
    b = D.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.lit(0).alias("created_at"))
    return R.page_union(a, b).select("id", "kind")


@register("c05_page_lines", f"WITH {D.LINES} SELECT d.doc_id AS page_id, order_index::INT AS order_index FROM documents d LEFT JOIN lines l ON l.page_id = d.doc_id AND l.text <> ''")
def page_lines(spark, sf):
    pages = D.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"))
    return R.page_lines(pages, D.lines(spark, sf).where("text <> ''")).select("page_id", "order_index")


@register(
    "c14_page_knowledge",
    """WITH f AS (SELECT o_custkey % 50 AS source_id, o_orderkey AS fact_id, (o_orderkey % 40)::INT AS start FROM orders), c AS (SELECT (o_custkey + 1) % 50 AS source_id, o_orderkey AS fact_id, 99 AS start FROM orders WHERE o_orderkey % 3 = 0),
u AS (SELECT source_id, fact_id, start, 0 AS o FROM f UNION ALL SELECT *, 1 FROM c) SELECT source_id, fact_id, CASE WHEN arg_min(start, o) < 11 THEN 1 WHEN arg_min(start, o) < 21 THEN 2 ELSE 3 END::BIGINT AS line_id FROM u GROUP BY ALL""",
)
def page_knowledge(spark, sf):
    o = D.table(spark, sf, "orders")
    facts = o.select((F.col("o_custkey") % 50).alias("source_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 40).cast("int").alias("start"), F.lit("x").alias("predicate_kind"))
    more = o.where("o_orderkey % 3 = 0").select(((F.col("o_custkey") + 1) % 50).alias("source_id"), F.col("o_orderkey").alias("fact_id"), F.lit(99).alias("start"))
    line_map = F.from_json(F.lit('[{"line_id":1,"start":0,"end":10},{"line_id":2,"start":11,"end":20},{"line_id":3,"start":21,"end":30}]'), T.LINE_MAP)
    return O.page_knowledge(facts, more, spark.range(50).select("id", line_map.alias("line_map"))).select("source_id", "fact_id", "line_id")


@register("c23_backfill_evidence", "SELECT o_orderkey AS fact_id, o_custkey AS source_id FROM orders")
def backfill(spark, sf):
    facts = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("source_text"), F.col("o_totalprice").alias("confidence"))
    have = facts.where("id % 4 = 0").select(F.col("id").alias("fact_id"), "source_id", F.col("source_text").alias("quote"), "confidence")
    return R.backfill_evidence(facts, have).select("fact_id", "source_id")


@register("d10_affected_relations", "SELECT DISTINCT l_partkey % 500 AS relation_id FROM lineitem WHERE l_orderkey = 7 OR l_orderkey = 8")
def affected(spark, sf):
    rows = D.table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("relation_id"), F.col("l_orderkey").alias("source_id"))
    return R.affected_relations(rows, spark.createDataFrame([(7,), (8,)], "source_id long"))


@register("d20_run_counters", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def counters(spark, sf):
    return R.run_counters(D.table(spark, sf, "events"), "event_type")


@register("e09_line_seams", f"WITH {D.LINES}, t AS (SELECT page_id, order_index, regexp_extract_all(text, '\\S+') AS w FROM lines), a AS (SELECT page_id, order_index, w[-1] AS tail, lead(w[1]) OVER (PARTITION BY page_id ORDER BY order_index) AS head FROM t WHERE len(w) > 0) SELECT page_id, order_index::INT AS order_index, tail, head FROM a WHERE head IS NOT NULL")
def line_seams(spark, sf):
    return R.line_seams(D.lines(spark, sf))


@register("f02_kin_places", f"WITH {D.EDGES} SELECT relation_kind, CASE relation_kind WHEN 'father' THEN 4 WHEN 'mother' THEN 4 WHEN 'brother' THEN 1 WHEN 'wife' THEN 0 WHEN 'uncle' THEN 2 END AS up, count(*) AS n FROM edges GROUP BY 1, 2")
def kin_places(spark, sf):
    rows = D.edges(spark, sf).select("relation_kind", kin.kin(F.col("relation_kind"), F.lit(4))["up"].alias("up"))
    return rows.groupBy("relation_kind", "up").agg(F.count("*").alias("n"))


@register("f09_predicates", f"WITH {D.EDGES} SELECT DISTINCT relation_kind, relation_kind IN ('father', 'mother', 'brother', 'wife', 'uncle') AS is_kin, relation_kind IN ('father', 'mother', 'wife') AS is_functional, CASE WHEN relation_kind IN ('father', 'mother') THEN relation_kind END AS slot FROM edges")
def predicates(spark, sf):
    k = F.col("relation_kind")
    return D.edges(spark, sf).select(k).distinct().select(k, kin.is_kin(k).alias("is_kin"), kin.is_functional(k).alias("is_functional"), kin.parent_slot(k).alias("slot"))


@register("f10_labels", f"WITH {D.EDGES} SELECT DISTINCT relation_kind, CASE relation_kind WHEN 'father' THEN 'отец' WHEN 'mother' THEN 'мать' WHEN 'brother' THEN 'брат' WHEN 'wife' THEN 'жена' WHEN 'uncle' THEN 'дядя' WHEN 'boss' THEN 'начальник' ELSE 'друг' END AS label FROM edges")
def labels(spark, sf):
    k = F.col("relation_kind")
    return D.edges(spark, sf).select(k).distinct().select(k, kin.relation_label(k).alias("label"))


@register("f11_layout_links", f"WITH {D.EDGES}, {D.CANONICAL}, {D.MERGED} SELECT id, CASE WHEN down - up < 0 THEN to_id WHEN down - up > 0 THEN from_id END AS parent, canon_key = 'pair:spouse' AS spouses FROM merged")
def layout_links(spark, sf):
    rows = E.canonicalize(D.edges(spark, sf))
    return rows.select("id", kin.layout_parent_child(F.col("delta"), F.col("from_id"), F.col("to_id"))["parent"].alias("parent"), kin.is_spouse_link(F.col("canon_key")).alias("spouses"))


@register("h02_located_items", "SELECT item_id, 5 AS start FROM benchmark WHERE length(text) > 40 AND strpos(text, substr(text, 6, 20)) = 6")
def located(spark, sf):
    sources = D.table(spark, sf, "benchmark").where("length(text) > 40 AND instr(text, substr(text, 6, 20)) = 6").select(F.col("item_id").alias("id"), "text")
    items = sources.select(F.col("id").alias("source_id"), F.substring("text", 6, 20).alias("quote")).union(sources.select("id", F.lit("no such quote")))
    return O.located(items, sources).select(F.col("source_id").alias("item_id"), "start")


@register("h07_value_conflicts", f"WITH {D.FACTS} SELECT id, CASE WHEN predicate_kind = 'birth' THEN time_iso IS NOT NULL AND substr(time_iso, 1, 4) <> '1995' ELSE lower(object_text) <> '1-urgent' END AS conflict FROM facts")
def value_conflicts(spark, sf):
    rows = D.facts(spark, sf)
    value = T.fact_value(F.col("predicate_kind"), F.col("time_text"), F.col("object_text"), F.col("object_name"), F.col("time_iso"))
    other = F.when(F.col("predicate_kind") == "birth", "iso:1995").otherwise("1-urgent")
    return rows.select("id", F.coalesce(T.values_conflict(F.col("predicate_kind"), other, value), F.lit(False)).alias("conflict"))


@register("h08_predicate_kinds", "SELECT o_orderkey, (['birth', 'death_place', 'other', 'education'])[o_orderkey % 4 + 1] AS kind FROM orders")
def predicate_kinds(spark, sf):
    k = F.element_at(F.array(*[F.lit(x) for x in ("born", "", "other", "?")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    p = F.element_at(F.array(*[F.lit(x) for x in ("умер", "место смерти", "умер", "он учился")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return D.table(spark, sf, "orders").select("o_orderkey", kin.normalize_predicate(k, p).alias("kind"))


@register("h14_upsert_confirmations", f"WITH {D.EDGES} SELECT source_id, count(*) AS n FROM (SELECT source_id, from_id FROM edges WHERE source_id % 10 <> 3 UNION ALL SELECT source_id, from_id FROM edges WHERE source_id % 10 = 3 AND confidence > 0.5 UNION ALL SELECT source_id, from_id FROM edges e WHERE source_id % 10 = 3 AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.confidence > 0.5 AND x.source_id = e.source_id AND x.from_id = e.from_id)) GROUP BY 1")
def upsert_confirmations(spark, sf):
    rows = D.edges(spark, sf)
    return E.upsert_confirmations(rows, rows.where("source_id % 10 = 3 AND confidence > 0.5"), ["from_id"]).groupBy("source_id").agg(F.count("*").alias("n"))


@register("h16_fallback_candidates", "WITH k AS (SELECT n_regionkey AS user_id, n_nationkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS rank FROM nation) SELECT r_regionkey AS user_id, r_regionkey AS new_id, id, 1.0::DOUBLE AS similarity, rank FROM region JOIN k ON k.user_id = r_regionkey WHERE rank <= 3")
def fallback(spark, sf):
    new = D.table(spark, sf, "region").select(F.col("r_regionkey").alias("user_id"), F.col("r_regionkey").alias("new_id"))
    return S.fallback_candidates(new, D.table(spark, sf, "nation").select(F.col("n_regionkey").alias("user_id"), F.col("n_nationkey").alias("id")), 3)


@register("h20_subjects", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'graph' WHEN 1 THEN 'self' WHEN 2 THEN 'named' END AS subject_source FROM customer WHERE c_custkey % 4 < 3")
def subjects(spark, sf):
    m = F.col("c_custkey") % 4
    rows = D.table(spark, sf, "customer").select("c_custkey", F.when(m == 0, 1).alias("graph_id"), (m == 1).alias("is_self"), F.lit(2).alias("self_id"), F.when(m == 2, 3).alias("named_id"), F.lit(None).cast("int").alias("relative_id"))
    return S.resolve_subjects(rows).select("c_custkey", "subject_source")


@register("h22_resolved_names", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS entity_id FROM nation")
def resolved(spark, sf):
    n = D.table(spark, sf, "nation")
    known = n.where("n_nationkey % 2 = 0").select(F.lit(1).alias("user_id"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("canonical_name"), F.lower("n_name").alias("normalized_name"))
    names = n.select(F.lit(1).alias("user_id"), F.when(F.col("n_nationkey") % 3 == 0, F.upper("n_name")).otherwise(F.col("n_name")).alias("name"), "n_nationkey")
    return S.resolved_names(names, known).select("n_nationkey", "entity_id")


@register("h25_alias_union", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS aliases FROM orders GROUP BY 1")
def alias_union(spark, sf):
    rows = D.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority"))).alias("b"))
    return rows.select("o_custkey", F.array_join(S.manual_aliases(F.col("a"), F.col("b")), ",").alias("aliases"))


@register("h29_keep_confident", "SELECT o_custkey, max(o_totalprice) AS confidence FROM orders GROUP BY 1")
def keep_confident(spark, sf):
    rows = D.table(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("confidence"), "o_orderkey")
    return O.merge_goal_rows(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), ["o_custkey"]).select("o_custkey", "confidence")


@register("j05_line_spans", f"WITH {D.LINES}, o AS (SELECT page_id, order_index, sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY order_index) - length(text) - 1 AS start, length(text) AS n FROM lines) SELECT page_id, start::INT AS start, (start + n)::INT AS stop FROM o WHERE order_index = 1")
def line_spans(spark, sf):
    rows = D.lines(spark, sf).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("order_index").alias("line_id"), "text"))).alias("l"))
    found = rows.select("page_id", T.line_span(T.assemble(F.col("l"))["line_map"], F.lit(1)).alias("s")).where("s IS NOT NULL")
    return found.select("page_id", "s.start", F.col("s.end").alias("stop"))


@register("j11_word_variants", "SELECT s_suppkey, (['дом|домъ', 'новаго|нового', 'все|всѣ', 'table'])[s_suppkey % 4 + 1] AS forms FROM supplier")
def variants(spark, sf):
    w = F.element_at(F.array(*[F.lit(x) for x in ("домъ", "новаго", "всѣ", "Table")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return D.table(spark, sf, "supplier").select("s_suppkey", F.array_join(T.word_variants(w), "|").alias("forms"))


@register("j13_unicode_forms", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def unicode_forms(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", U.nfc(U.nfd(F.col("text"))).alias("text"))


@register("j14_confusions", "SELECT s_suppkey, (['аб|об|ав', 'дом|том|дам', 'x'])[s_suppkey % 3 + 1] AS forms FROM supplier")
def confusion(spark, sf):
    w = F.element_at(F.array(*[F.lit(x) for x in ("аб", "дом", "x")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return D.table(spark, sf, "supplier").select("s_suppkey", F.array_join(T.confusion_variants(w), "|").alias("forms"))


@register("k01_embeddings", "SELECT DISTINCT c_mktsegment AS text, 1.0::DOUBLE AS length FROM customer")
def embeddings(spark, sf):
    rows = D.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("text"))
    from vellum.functions import vectors

    found = V.embed(rows, lambda ts: [[float(len(t)), 1.0, 0.0] for t in ts], dimension=3)
    return found.select("text", F.round(vectors.norm(F.col("vector")), 9).alias("length"))


@register("l08_apply_changes", "SELECT s_suppkey, 'a ' || s_name || ' c' AS text FROM supplier")
def apply_changes(spark, sf):
    return D.table(spark, sf, "supplier").select("s_suppkey", U.apply_change(F.lit("a  b  c"), F.lit(3), F.lit(4), F.col("s_name")).alias("text"))


@register("l10_alternatives", "SELECT s_suppkey, s_name || 'x' AS word, -1.0::DOUBLE AS score FROM supplier")
def alternatives(spark, sf):
    chosen = F.array(F.lit("a"), F.col("s_name"))
    others = F.array(F.struct(F.array(F.lit("a"), F.concat("s_name", F.lit("x"))).alias("words"), F.lit(-1.0).alias("score")))
    rows = D.table(spark, sf, "supplier").select("s_suppkey", F.explode(U.word_alternatives(chosen, others)).alias("a"))
    return rows.select("s_suppkey", "a.word", "a.score")


@register("m09_dataset", f"WITH {_STATES} SELECT page_id, count(*) AS n FROM s WHERE status = 'CONFIRMED' AND trim(coalesce(corrected, predicted)) <> '' GROUP BY 1")
def dataset(spark, sf):
    lines = _pages(spark, sf).withColumn("line_id", F.col("order_index")).drop("status", "author_id")
    pages = _pages(spark, sf).select("author_id", "page_id", "status").distinct()
    return M.dataset(pages, lines)[0].groupBy("page_id").agg(F.count("*").alias("n"))


@register("m12_run_outcomes", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_totalprice < 100000 THEN 'activated' ELSE 'rejected' END AS outcome FROM orders")
def outcomes(spark, sf):
    rows = D.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "e").alias("error"), F.col("o_totalprice").alias("candidate_cer"), F.lit(100000.0).alias("baseline_cer"))
    return M.run_outcome(rows).select("o_orderkey", "outcome")


@register("m15_replace_recognition", "SELECT l_orderkey AS page_id, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber < 3 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_orderkey % 4 = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 3)) GROUP BY 1")
def replaced(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), "l_linenumber")
    return M.replace_recognition(rows, rows.where("page_id % 4 = 0 AND l_linenumber < 3")).groupBy("page_id").agg(F.count("*").alias("n"))


@register("m16_claims", "SELECT o_orderkey AS source_id, 'running' AS status FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 3 = 0")
def claims(spark, sf):
    rows = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.lit("h").alias("text_hash"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("pending").alias("status"))
    return M.claim(rows, rows.where("source_id % 3 = 0").union(rows.where("source_id % 6 = 0"))).select("source_id", "status")


@register("n04_corpus_mix", "SELECT weight, count(*) AS n FROM (SELECT 30 AS weight FROM benchmark UNION ALL SELECT 1 FROM conversations UNION ALL SELECT 1 FROM nation) GROUP BY 1")
def corpus_mix(spark, sf):
    a, b, c = D.table(spark, sf, "benchmark").select("text"), D.table(spark, sf, "conversations").select("text"), D.table(spark, sf, "nation").select(F.col("n_name").alias("text"))
    return N.corpus_mix(a, b, c).groupBy("weight").agg(F.count("*").alias("n"))


@register("n11_interpolated", "SELECT event_id, 0.7 * value + 0.3 * CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END AS score FROM events")
def interpolated(spark, sf):
    return D.table(spark, sf, "events").select("event_id", N.interpolate(F.col("value"), F.when(F.col("user_id") % 2 == 0, F.col("value")), 0.7, 0.3).alias("score"))


@register("o04_annotated_lines")
def annotated(spark, sf):
    lines = D.table(spark, sf, "benchmark").select(F.col("item_id").alias("line_id"), "text", F.lit(False).alias("words_stale"))
    boxes = lines.select("line_id", F.posexplode(T.words(F.col("text"))).alias("position", "text"))
    verdict = L.verdicts(boxes.select(F.col("text").alias("word")), language._base(spark, sf))
    return L.annotate(lines, boxes, verdict)[0]


@register("o05_author_terms")
def author_terms(spark, sf):
    rows = D.lines(spark, sf).select("page_id", "order_index", F.posexplode(T.words(F.col("text"))).alias("position", "word"))
    verdict = L.verdicts(rows, language._base(spark, sf), author=rows.where("page_id % 2 = 0").select(F.lower("word").alias("word")).distinct())
    counts = rows.groupBy("word").agg(F.count("*").alias("n"))
    return L.author_terms(counts, verdict, L.occurrences(rows, verdict)).select("word", "n", F.size("places").alias("n_places"))


def _lines(spark, sf):
    x, y = F.col("l_partkey") % 500, F.col("l_linenumber") * 40
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.array(F.array(x.cast("double"), y.cast("double")), F.array((x + 60).cast("double"), y.cast("double"))).alias("a"), F.array(F.array((x + 70).cast("double"), (y + F.col("l_suppkey") % 3 * 4).cast("double")), F.array((x + 130).cast("double"), (y + F.col("l_suppkey") % 3 * 4).cast("double"))).alias("b"))


@register("p03_continuation", "SELECT l_orderkey, l_partkey, (2 * (l_suppkey % 3 * 4) + 10) / 40.0 AS cost FROM lineitem")
def continuation(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_partkey", layout.continuation_cost(F.col("a"), F.col("b"), F.lit(40.0)).alias("cost"))


@register("p07_overlap_share", "SELECT l_orderkey, l_partkey, greatest(0, 60 - l_suppkey % 8 * 10) / 60.0 AS apart, 1.0::DOUBLE AS same, true AS stacked FROM lineitem")
def overlap_share(spark, sf):
    x, shift = F.col("l_partkey") % 500, F.col("l_suppkey") % 8 * 10
    level = lambda at: F.array(F.array(at.cast("double"), F.lit(0.0)), F.array((at + 60).cast("double"), F.lit(0.0)))
    rows = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", level(x).alias("a"), level(x + shift).alias("b"))
    return rows.select("l_orderkey", "l_partkey", layout.overlap_share(F.col("a"), F.col("b")).alias("apart"), layout.overlap_share(F.col("a"), F.col("a")).alias("same"), layout.stacked(F.col("a"), F.col("a"), F.lit(20.0)).alias("stacked"))


@register("p08_row_bands", "WITH r AS (SELECT DISTINCT l_orderkey AS page_id, l_linenumber AS y FROM lineitem), g AS (SELECT page_id, y, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS run FROM r), b AS (SELECT page_id, min(y) AS top, max(y) + 1 AS bottom, count(*) AS n FROM g GROUP BY page_id, run) SELECT page_id, top::INT AS top, bottom::INT AS bottom FROM b WHERE n >= 3")
def row_bands(spark, sf):
    ink = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("y"), F.lit(1.0).alias("ink")).distinct()
    all_rows = ink.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("y")).join(ink, ["page_id", "y"], "left").withColumn("ink", F.coalesce("ink", F.lit(0.0)))
    return layout.row_bands(all_rows).select("page_id", "top", "bottom")


@register("p09_word_confidence", "SELECT vec_id, list_avg(list_transform(embedding[3:6], lambda x: x::DOUBLE)) AS confidence FROM embeddings")
def word_confidence(spark, sf):
    return D.table(spark, sf, "embeddings").select("vec_id", layout.word_confidence(F.transform("embedding", lambda x: x.cast("double")), F.lit(2), F.lit(6)).alias("confidence"))
