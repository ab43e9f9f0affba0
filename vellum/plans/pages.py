"""Queries on sources, pages, lists, upserts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import register
from vellum.functions import text as T
from vellum.operators import relational as R
from vellum.operators import training as M
from vellum.plans import tables as D
from vellum.sources import texts as X


@register("a01_tenant_scan", "SELECT event_id, event_type FROM events WHERE user_id = 3")
def tenant(spark, sf):
    return R.owned(D.table(spark, sf, "events"), 3).select("event_id", "event_type")


@register("a02_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def lookup(spark, sf):
    return R.lookup(D.table(spark, sf, "orders"), {"o_orderkey": 77}).select("o_orderkey", "o_custkey")


@register("a04_newest_first", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC NULLS LAST LIMIT 20 OFFSET 10")
def newest(spark, sf):
    return R.newest_first(D.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 20, 10)


@register("a05_last_turns", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS position FROM r WHERE b <= 3")
def last_turns(spark, sf):
    return R.last_turns(D.table(spark, sf, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "role", "position")


def _sources(spark, sf):
    return X.diary_sources(D.table(spark, sf, "documents").select(F.lit(1).alias("user_id"), F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("text").alias("content")))


_UPSERT = """WITH old AS (SELECT doc_id AS ref_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 3 <> 0),
new AS (SELECT doc_id AS ref_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(old.ref_id, new.ref_id) AS ref_id, CASE WHEN new.ref_id IS NULL THEN 'kept' WHEN old.ref_id IS NULL THEN 'created' WHEN h <> sha256(new.text) THEN 'changed' ELSE 'unchanged' END AS action, coalesce(sha256(new.text), h) AS text_hash FROM old FULL JOIN new USING (ref_id)"""


def _upserted(spark, sf):
    rows = _sources(spark, sf)
    old = rows.where("ref_id % 3 <> 0").select("*", T.text_hash(F.col("text")).alias("text_hash"), F.lit("done").alias("status"))
    new = rows.where("ref_id % 7 <> 0").withColumn("text", F.when(F.col("ref_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.upsert_sources(old, new)


@register("a08_upsert_sources", _UPSERT)
def upsert(spark, sf):
    return _upserted(spark, sf).select("ref_id", "action", "text_hash")


@register("a09_backfill_counts", f"SELECT action, count(*) AS n FROM ({_UPSERT}) WHERE action <> 'kept' GROUP BY action")
def backfill(spark, sf):
    return R.backfill_counts(_upserted(spark, sf))


@register(
    "a10_rebuild_plan",
    """SELECT doc_id AS source_id, 'manuscript' AS part, (row_number() OVER (ORDER BY source, n_chars NULLS LAST, doc_id))::INT AS position, doc_id % 4 <> 0 AS run FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'diary', (row_number() OVER (ORDER BY n_chars NULLS LAST, doc_id))::INT, true FROM documents WHERE doc_id % 2 = 1""",
)
def rebuild(spark, sf):
    d = D.table(spark, sf, "documents").withColumn("status", F.when(F.col("doc_id") % 4 == 0, "done").otherwise("pending")).withColumnRenamed("doc_id", "source_id")
    a = d.where("source_id % 2 = 0").select("source_id", "status", F.col("source").alias("author_id"), F.col("n_chars").alias("order_index"))
    return R.rebuild_plan(a, d.where("source_id % 2 = 1").select("source_id", "status", F.col("n_chars").alias("created_at")))


@register("a13_budget", "WITH s AS (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) SELECT doc_id FROM s WHERE b < 100000")
def budget(spark, sf):
    return X.budgeted(D.table(spark, sf, "documents").select("doc_id", "text"), 100000, "doc_id").select("doc_id")


@register("a16_uploads", "WITH n AS (SELECT lower(substr(url, 1, 200)) AS k, min(url) AS raw_path FROM pages GROUP BY 1) SELECT raw_path, split_part(raw_path, '/', -1) AS file_name FROM n WHERE k NOT IN (SELECT lower(substr(url, 1, 200)) FROM pages WHERE page_id % 2 = 0)")
def uploads(spark, sf):
    p = D.table(spark, sf, "pages").select(F.lit(1).alias("author_id"), F.col("url").alias("raw_path"), "page_id")
    have = p.where("page_id % 2 = 0").select("author_id", T.path_name(F.col("raw_path")).alias("file_name"), T.path_folder(F.col("raw_path")).alias("path"))
    return X.uploads(have, p)[0].select("raw_path", "file_name")


@register("a17_pdf_pages", "SELECT s_suppkey AS file_id, unnest(generate_series(1, s_suppkey % 4 + 1))::INT AS page_no FROM supplier WHERE s_suppkey % 5 <> 0")
def pdf_pages(spark, sf):
    files = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), F.col("s_name").alias("file_name"), (F.col("s_suppkey") % 4 + 1).cast("int").alias("n_pages"))
    have = files.where("file_id % 5 = 0").select(F.concat(F.lower("file_name"), F.lit("#1")).alias("page_key"))
    return X.pdf_pages(files, have).select("file_id", "page_no")


@register("a22_upsert_latest", "SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id")
def upsert_latest(spark, sf):
    c = D.table(spark, sf, "conversations").select("conv_id", "turn")
    return R.upsert_latest(c.where("turn % 2 = 0"), c.groupBy("conv_id").agg(F.max("turn").alias("turn")), ["conv_id"], "turn")


@register("a24_ensure_folders", "WITH w AS (SELECT lower(c_mktsegment) AS k, min(c_mktsegment) AS name FROM customer GROUP BY 1) SELECT name, CASE WHEN k = 'building' THEN 5 ELSE 100 + row_number() OVER (PARTITION BY k = 'building' ORDER BY name) - 1 END::BIGINT AS id, k <> 'building' AS created FROM w")
def folders(spark, sf):
    have = spark.createDataFrame([(5, 1, None, "Building")], "id long, user_id int, parent_id long, name string")
    want = D.table(spark, sf, "customer").select(F.lit(1).alias("user_id"), F.lit(None).cast("long").alias("parent_id"), F.col("c_mktsegment").alias("name"))
    return R.ensure_folders(have, want, F.lit(100).cast("long")).select("name", "id", "created")


@register("a26_pending", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
def pending(spark, sf):
    rows = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    return R.pending(rows, "O", "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey")


@register("a27_clear_graph", "SELECT 'orders' AS table_name, count(*) AS removed FROM orders WHERE o_custkey % 5 = 2 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 5 = 2")
def clear(spark, sf):
    t = {"orders": D.table(spark, sf, "orders").withColumn("user_id", F.col("o_custkey") % 5), "customer": D.table(spark, sf, "customer").withColumn("user_id", F.col("c_custkey") % 5)}
    return R.clear_graph(t, 2)[1]


@register("b01_effective_text", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END, source) AS plain, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END, ''), source) AS falsy, (doc_id % 3 <> 2 OR trim(coalesce(source, '')) <> '') AS valid FROM documents")
def effective(spark, sf):
    c = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return D.table(spark, sf, "documents").select("doc_id", T.effective_text(c, F.col("source")).alias("plain"), T.effective_text_falsy(c, F.col("source")).alias("falsy"), T.has_valid_transcription(c, F.col("source")).alias("valid"))


@register("b04_clamp", "SELECT event_id, least(greatest(value / 50, 0.0), 1.0) AS clamped, 0.5::DOUBLE AS fallback FROM events")
def clamp(spark, sf):
    return D.table(spark, sf, "events").select("event_id", T.clamp(F.col("value") / 50).alias("clamped"), T.clamp(F.col("event_type"), 0.5).alias("fallback"))


@register("b05_normalize", "SELECT c_custkey, lower(trim(regexp_replace('  ' || c_name || '   X ', '\\s+', ' ', 'g'))) AS name FROM customer")
def normalized(spark, sf):
    return D.table(spark, sf, "customer").select("c_custkey", T.normalize(F.concat(F.lit("  "), "c_name", F.lit("   X "))).alias("name"))


@register("b07_goals", "SELECT doc_id, lang <> 'en' AND source <> '' AS is_goal FROM documents")
def goals(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.is_goal(F.col("source"), F.when(F.col("lang") == "en", " NONE ").otherwise(F.col("lang"))).alias("is_goal"))


@register("b10_confidence", "SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'normal' WHEN value / 100 >= 0.7 THEN 'warning' ELSE 'critical' END AS level FROM events")
def confidence(spark, sf):
    return D.table(spark, sf, "events").select("event_id", T.confidence_level(F.col("value") / 100).alias("level"))


@register("b13_sanitize", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE s_name END AS cleaned FROM supplier")
def sanitize(spark, sf):
    name = F.col("s_name")
    raw = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("```\n- "), name, F.lit("\n```"))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("Answer: «"), name, F.lit("»"))).when(F.col("s_suppkey") % 4 == 2, name).otherwise(F.concat(name, F.lit("\nand more")))
    return D.table(spark, sf, "supplier").select("s_suppkey", T.sanitize_correction(raw, name, ["answer:", "ответ:"], (0.5, 2.0)).alias("cleaned"))


@register("b16_paths", "SELECT page_id, split_part(url, '/', -1) AS name, url AS folder FROM pages")
def paths(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", T.path_name(F.col("url")).alias("name"), T.path_folder(F.col("url")).alias("folder"))


@register("b17_alignment", "SELECT item_id, true AS kept, item_id % 2 = 0 AS other FROM benchmark")
def alignment(spark, sf):
    n = F.size(T.space_tokens(F.col("text")))
    return D.table(spark, sf, "benchmark").select("item_id", T.alignment_preserved(n, F.col("text")).alias("kept"), T.alignment_preserved(F.when(F.col("item_id") % 2 == 0, 0).otherwise(n + 1), F.col("text")).alias("other"))


@register("c04_page_summaries", f"WITH {D.LINES} SELECT d.doc_id AS page_id, count(l.page_id) AS n_lines FROM documents d LEFT JOIN lines l ON l.page_id = d.doc_id AND l.text <> '' GROUP BY 1")
def summaries(spark, sf):
    return R.page_summaries(D.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id")), D.lines(spark, sf).where("text <> ''"))


@register("c01_relatives", f"WITH {D.EDGES}, r AS (SELECT from_id, to_id, e.id, s_name AS name, row_number() OVER (PARTITION BY from_id ORDER BY e.id) AS position FROM edges e JOIN supplier ON s_suppkey = to_id) SELECT from_id, to_id, id, name, position::INT AS position FROM r WHERE position <= 50")
def relatives(spark, sf):
    people = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.relatives(D.edges(spark, sf), people).select("from_id", "to_id", "id", "name", "position")


@register("c02_self_first", "SELECT s_suppkey AS id, (row_number() OVER (ORDER BY CASE WHEN s_suppkey = 7 THEN 0 ELSE 1 END, CASE WHEN s_acctbal > 0 THEN s_acctbal END DESC NULLS LAST, s_suppkey))::INT AS place FROM supplier ORDER BY place LIMIT 10")
def self_first(spark, sf):
    rows = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("last_seen_at"))
    top = R.self_first(rows, F.lit(7)).limit(10)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.when(F.col("id") == 7, 0).otherwise(1), F.col("last_seen_at").desc_nulls_last(), "id"))
    return top.select("id", place.alias("place"))


@register("c06_without_children", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def childless(spark, sf):
    return R.without(D.table(spark, sf, "customer").select("c_custkey"), D.table(spark, sf, "orders"), "c_custkey", "o_custkey")


@register("c07_orphans", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL) AND p_partkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def orphans(spark, sf):
    return R.orphans(D.table(spark, sf, "part").select(F.col("p_partkey").alias("id")), [(D.table(spark, sf, "lineitem"), "l_partkey"), (D.table(spark, sf, "orders"), "o_custkey")])


def _ordered(spark, sf):
    return D.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("author_id"), (F.col("doc_id") % 17).alias("order_index"), F.when(F.col("doc_id") % 3 != 0, "CONFIRMED").otherwise("EDITING").alias("status"))


@register(
    "c13_neighbours",
    """WITH p AS (SELECT doc_id AS page_id, source AS author_id, doc_id % 17 AS o, doc_id % 3 <> 0 AS ok FROM documents)
SELECT page_id, (SELECT arg_max(q.page_id, q.o * 1000000 + q.page_id) FROM p q WHERE q.ok AND q.author_id = p.author_id AND q.o < p.o) AS previous_page,
(SELECT arg_min(q.page_id, q.o * 1000000 + q.page_id) FROM p q WHERE q.ok AND q.author_id = p.author_id AND q.o > p.o) AS next_page FROM p""",
)
def neighbours(spark, sf):
    return R.neighbours(_ordered(spark, sf)).select("page_id", "previous_page", "next_page")


@register("c19_line_context", f"WITH {D.LINES} SELECT page_id, order_index::INT AS order_index, len(list(text) FILTER (trim(text) <> '') OVER (PARTITION BY page_id ORDER BY order_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)) AS n FROM lines".replace("len(list(text)", "coalesce(len(list(text)").replace("1 PRECEDING)) AS n", "1 PRECEDING)), 0)::INT AS n"))
def context(spark, sf):
    return R.line_context(D.lines(spark, sf), 2).select("page_id", "order_index", F.size("before").alias("n"))


@register("c21_folds", "SELECT doc_id AS page_id, (SELECT count(*) FROM documents o WHERE o.source = d.source AND o.doc_id < d.doc_id) AS readable FROM documents d")
def folds(spark, sf):
    return R.hidden_by_fold(_ordered(spark, sf)).select("page_id", "readable")


@register("c22_redirect", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 AND o_custkey < 100 THEN o_custkey + 5000 END AS source_id FROM orders")
def redirect(spark, sf):
    kids = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("page_id"), F.lit(None).cast("long").alias("source_id"))
    sources = spark.range(0, 100, 2).select(F.lit("manuscript").alias("source_type"), F.col("id").alias("ref_id"), (F.col("id") + 5000).alias("id"))
    return R.redirect_children(kids, sources).select("id", "source_id")


@register("c24_absorb_events", "SELECT event_type AS predicate, count(*) AS n, sum(CASE WHEN value > 50 THEN value / 100 ELSE 0.5 END) AS importance FROM events GROUP BY 1")
def absorb(spark, sf):
    e = D.table(spark, sf, "events").select("user_id", F.lit(None).cast("long").alias("entity_id"), F.col("event_type").alias("title"), F.when(F.col("value") > 50, F.col("value") / 100).alias("importance"), F.lit("").alias("quote"))
    none = spark.createDataFrame([], "user_id long, subject_entity_id long, predicate string, importance double, source_text string")
    return R.absorb_events(none, e).groupBy("predicate").agg(F.count("*").alias("n"), F.sum("importance").alias("importance"))


@register("c25_self_entity", "SELECT n_regionkey AS user_id, min(n_nationkey) AS entity_id FROM nation GROUP BY 1")
def self_entity(spark, sf):
    n = D.table(spark, sf, "nation")
    who = n.select(F.col("n_regionkey").alias("user_id"), F.upper("n_name").alias("name"), F.col("n_nationkey").alias("priority")).union(n.select("n_regionkey", F.lit("я"), F.lit(-1)))
    return R.self_entity(who, n.select(F.col("n_regionkey").alias("user_id"), F.lower("n_name").alias("normalized_name"), F.col("n_nationkey").alias("id")))


@register("c27_audit", "SELECT 'orders' AS table_name, count(*) FILTER (o_orderkey % 9 = 0) AS orphans FROM orders")
def audit(spark, sf):
    return R.audit_sources({"orders": D.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey")).alias("source_id"))})


@register("d02_next_ordinal", "SELECT c_nationkey, coalesce(max(c_custkey), -1) + 1 AS next_ordinal FROM customer GROUP BY 1")
def ordinal(spark, sf):
    return R.next_ordinal(D.table(spark, sf, "customer"), ["c_nationkey"], "c_custkey")


@register("d03_in_degrees", f"WITH {D.EDGES} SELECT s_suppkey AS id, count(e.id) AS n_edges FROM supplier LEFT JOIN edges e ON to_id = s_suppkey GROUP BY 1")
def in_degrees(spark, sf):
    return R.in_degrees(D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), D.edges(spark, sf))


@register("d25_content_hash", "SELECT l_orderkey, sha256(string_agg(l_linenumber::VARCHAR || '|' || l_partkey::VARCHAR || '|' || l_suppkey::VARCHAR, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey)) AS content_hash, count(*) AS n_rows FROM lineitem GROUP BY 1")
def content_hash(spark, sf):
    return R.content_hash(D.table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


@register("d27_decision_log", "SELECT event_type AS action, value > 50 AS in_lexicon, count(*) AS n FROM events GROUP BY ALL")
def decision_log(spark, sf):
    return R.decision_log(D.table(spark, sf, "events").select(F.col("event_type").alias("action"), (F.col("value") > 50).alias("in_lexicon")))


@register("e03_ordinals", "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1)::INT AS ordinal FROM customer")
def ordinals(spark, sf):
    return R.ordinals(D.table(spark, sf, "customer"), ["c_nationkey"], [F.col("c_custkey").desc()]).select("c_custkey", "ordinal")


@register("e04_reorder", "SELECT c_custkey AS id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 10 = 0 THEN -c_custkey END NULLS LAST, c_custkey) - 1)::INT AS order_index FROM customer")
def reorder(spark, sf):
    rows = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_custkey").alias("order_index"))
    given = rows.where("id % 10 = 0").select("id", (-F.col("id")).alias("rank"))
    return R.reorder(rows, given, ["c_nationkey"]).select("id", "order_index")


@register("e06_line_offsets", f"WITH {D.LINES} SELECT page_id, order_index::INT AS order_index, coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS start FROM lines WINDOW w AS (PARTITION BY page_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def offsets(spark, sf):
    return R.line_offsets(D.lines(spark, sf)).select("page_id", "order_index", F.col("start").cast("long").alias("start"))


@register("e08_latest_run", "SELECT user_id AS source_id, max(event_id) AS id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def latest_run(spark, sf):
    runs = D.table(spark, sf, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.col("props").alias("stats"))
    return R.latest_run(runs).select("source_id", "id")


@register("j01_assemble", f"WITH {D.LINES} SELECT page_id AS ref_id, string_agg(text, chr(10) ORDER BY order_index) AS text FROM lines GROUP BY 1")
def assemble(spark, sf):
    rows = D.lines(spark, sf).select("page_id", "order_index", F.col("order_index").alias("line_id"), F.col("text").alias("predicted"), F.lit("").alias("corrected"))
    pages = rows.select("page_id").distinct().select("page_id", F.lit(1).alias("user_id"), F.lit("CONFIRMED").alias("status"), F.lit(None).cast("string").alias("file_name"))
    return X.manuscript_sources(pages, rows).select("ref_id", "text")


@register("j04_line_of_offset", f"WITH {D.LINES}, o AS (SELECT page_id, order_index, sum(length(text) + 1) OVER (PARTITION BY page_id ORDER BY order_index) - length(text) - 1 AS start FROM lines) SELECT page_id, max(order_index)::BIGINT AS line_id FROM o WHERE start <= 100 GROUP BY 1")
def line_of_offset(spark, sf):
    rows = D.lines(spark, sf).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(F.col("order_index").alias("line_id"), "text"))).alias("l"))
    return rows.select("page_id", T.line_for_offset(T.assemble(F.col("l"))["line_map"], F.lit(100)).alias("line_id"))


@register("m08_split", "WITH n AS (SELECT source AS author_id, count(*) AS n FROM documents GROUP BY 1) SELECT author_id, least(greatest(floor(n * 0.1), 1), n - 1)::BIGINT AS validation, (n - least(greatest(floor(n * 0.1), 1), n - 1))::BIGINT AS train FROM n")
def split(spark, sf):
    rows = D.table(spark, sf, "documents").select(F.col("source").alias("author_id"), F.col("doc_id").alias("line_id"))
    return M.split(rows).groupBy("author_id").agg(F.count_if(F.col("part") == "validation").alias("validation"), F.count_if(F.col("part") == "train").alias("train"))


@register("m13_token_reuse", "WITH u AS (SELECT user_id AS family_id, event_id AS token_id, ts, event_type = 'error' AND ts > TIMESTAMP '1995-01-01' AS late FROM events) SELECT family_id, min(ts) FILTER (late) AS family_revoked_at, count(*) FILTER (late) AS n FROM u GROUP BY 1")
def token_reuse(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("family_id"), F.col("event_id").alias("token_id"), F.col("ts").alias("used_at"), F.when(F.col("event_type") == "error", F.lit("1995-01-01").cast("timestamp")).alias("rotated_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    return M.token_reuse(e).groupBy("family_id").agg(F.max("family_revoked_at").alias("family_revoked_at"), F.count_if("reused").alias("n"))


@register("m14_page_moves", "SELECT o_orderkey AS page_id, CASE o_orderstatus WHEN 'O' THEN 'CONFIRMED' WHEN 'F' THEN 'CONFIRMED' ELSE 'UPLOADED' END AS status, o_orderstatus = 'P' OR o_orderstatus = 'F' AS refused FROM orders")
def page_moves(spark, sf):
    rows = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "O", "EDITING").when(F.col("o_orderstatus") == "F", "CONFIRMED").otherwise("UPLOADED").alias("status"))
    return M.move_pages(rows, rows.select("page_id", F.lit("confirm").alias("action"))).select("page_id", "status", "refused")


@register("b19_readiness", f"WITH {D.LINES} SELECT author_id, count(*) AS lines, count(*) >= 30 AS ready FROM lines WHERE text <> '' GROUP BY 1")
def readiness(spark, sf):
    return M.readiness(D.lines(spark, sf).where("text <> ''"), 30).select("author_id", "lines", "ready")


@register("m11_activate", "SELECT s_nationkey AS author_id, s_suppkey AS version, CASE WHEN s_suppkey = max(s_suppkey) OVER (PARTITION BY s_nationkey) THEN 'ACTIVE' ELSE 'READY' END AS status FROM supplier")
def activate(spark, sf):
    v = D.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("author_id"), F.col("s_suppkey").alias("version"), F.lit("ACTIVE").alias("status"))
    return M.activate(v, v.groupBy("author_id").agg(F.max("version").alias("version")))
