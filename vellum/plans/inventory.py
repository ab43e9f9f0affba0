"""Queries on single entries of the inventory that no other query shows by itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.catalog import register
from vellum.functions import kin
from vellum.functions import text as T
from vellum.operators import edges as E
from vellum.operators import facts as K
from vellum.operators import graph as G
from vellum.operators import lexicon as L
from vellum.operators import lm
from vellum.operators import measures as Q
from vellum.operators import relational as R
from vellum.operators import resolve as S
from vellum.operators import search
from vellum.operators.components import checkpoint_folder
from vellum.plans import tables as D
from vellum.sources import texts as X

# --- texts ----------------------------------------------------------------------------

_CORRECTED = "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END"
_PREDICTED = "CASE o_orderkey % 2 WHEN 0 THEN ' ' ELSE o_orderstatus END"


def _readings(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", F.expr(_CORRECTED).alias("corrected"), F.expr(_PREDICTED).alias("predicted"))


@register("b02_effective_falsy", f"SELECT o_orderkey, coalesce(nullif({_CORRECTED}, ''), {_PREDICTED}) AS text FROM orders")
def effective_falsy(spark, sf):
    return _readings(spark, sf).select("o_orderkey", T.effective_text_falsy(F.col("corrected"), F.col("predicted")).alias("text"))


@register("b03_valid_transcription", f"SELECT o_orderkey, {_CORRECTED} IS NOT NULL OR trim({_PREDICTED}) <> '' AS valid FROM orders")
def valid_transcription(spark, sf):
    return _readings(spark, sf).select("o_orderkey", T.has_valid_transcription(F.col("corrected"), F.col("predicted")).alias("valid"))


@register("j03_line_maps", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN c_custkey % 5 <> 0 THEN length(c_name) + 1 + length(c_mktsegment) END AS stop FROM customer")
def line_maps(spark, sf):
    lines = F.array(F.struct(F.lit(1).cast("long").alias("line_id"), F.col("c_name").alias("text")), F.struct(F.lit(2).cast("long").alias("line_id"), F.col("c_mktsegment").alias("text")))
    stored = F.when(F.col("c_custkey") % 5 == 0, "[{broken").otherwise(F.to_json(T.assemble(lines)["line_map"]))
    rows = D.table(spark, sf, "customer").select("c_custkey", T.parse_line_map(stored).alias("m"))
    return rows.select("c_custkey", F.size("m").alias("n"), F.get("m", F.lit(1))["end"].alias("stop"))


@register("j12_words_of", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))), ',') AS words FROM part")
def words_of(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", F.array_join(T.words_of(F.concat_ws(" ", "p_name", "p_type")), ",").alias("words"))


@register(
    "d26_assembled_offsets",
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM t)
SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_hash, string_agg(turn || ':' || start || ':' || (start + length(text)), ',' ORDER BY turn) AS lines FROM o GROUP BY conv_id""",
)
def assembled_offsets(spark, sf):
    rows = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"))
    made = rows.select("conv_id", T.assemble(F.transform("l", lambda x: F.struct(x["turn"].cast("long").alias("line_id"), x["text"].alias("text")))).alias("a"))
    return made.select("conv_id", T.text_hash(F.col("a.text")).alias("text_hash"), F.array_join(F.transform("a.line_map", lambda x: F.concat_ws(":", x["line_id"].cast("string"), x["start"].cast("string"), x["end"].cast("string"))), ",").alias("lines"))


# --- joins and orders -----------------------------------------------------------------


@register("c08_without_child", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def without_child(spark, sf):
    children = D.table(spark, sf, "orders").where("o_totalprice > 250000")
    return R.without(D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), children, "id", "o_custkey")


_COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@register(
    "c09_filtered_search",
    f"""WITH p AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_COSINE} AS similarity FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND c.label IN (0, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p) SELECT query_id, id, similarity, rank::INT AS rank FROM r WHERE rank <= 4""",
)
def filtered_search(spark, sf):
    rows = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("source_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    sources = rows.select("id", F.col("label").alias("author_entity_id"), F.lit("t").alias("title"))
    seen = search.visible_to(rows, sources, F.lit(1), F.lit(0))
    return search.top_k(seen, rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), 4)


@register("c15_decorated_chains", "SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, a.s_name || ' > ' || coalesce(b.s_name, '?') AS names FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey LEFT JOIN supplier b ON b.s_suppkey = l_partkey % 1200")
def decorated_chains(spark, sf):
    people = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    rows = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array(F.col("l_suppkey").cast("long"), (F.col("l_partkey") % 1200).cast("long")).alias("chain")).distinct()
    rows = rows.withColumn("subject", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).withColumn("target", F.lit(0).cast("long"))
    return G.decorate(rows, people).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.transform("names", lambda n: F.coalesce(n, F.lit("?"))), " > ").alias("names"))


@register("c26_object_list", "SELECT c_custkey AS id, (row_number() OVER (ORDER BY CASE WHEN c_custkey = 7 THEN 0 ELSE 1 END, CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey))::BIGINT AS position FROM customer QUALIFY position <= 200")
def object_list(spark, sf):
    people = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("last_seen_at"))
    first = R.self_first(people, F.lit(7)).limit(200)  # a page of the list
    return first.select("id", (F.monotonically_increasing_id() + 1).alias("position"))


@register("d01_order_counts", "SELECT c_custkey AS page_id, count(o_orderkey) AS n_lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def order_counts(spark, sf):
    return R.page_summaries(D.table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id")), D.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("page_id")))


@register("e05_renumbered", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal FROM orders WHERE o_orderstatus <> 'F'")
def renumbered(spark, sf):
    left = D.table(spark, sf, "orders").where("o_orderstatus <> 'F'")
    return R.ordinals(left, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", F.col("ordinal").cast("long").alias("ordinal"))


_BLANK = "CASE WHEN turn % 4 <> 2 THEN text ELSE ' ' END"


@register(
    "e07_neighbour_lines",
    f"""WITH t AS (SELECT conv_id, turn, {_BLANK} AS text FROM conversations) SELECT conv_id AS page_id, turn AS order_index,
  sha256(coalesce(array_to_string(list(text) FILTER (trim(text) <> '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '')) AS before,
  sha256(coalesce(array_to_string(list(text) FILTER (trim(text) <> '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '|'), '')) AS after FROM t""",
)
def neighbour_lines(spark, sf):
    lines = D.table(spark, sf, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("order_index"), F.expr(_BLANK).alias("text"))
    hashed = lambda c: F.sha2(F.array_join(c, "|"), 256)
    return R.line_context(lines, 2).select("page_id", "order_index", hashed("before").alias("before"), hashed("after").alias("after"))


@register("e10_keepers", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def keepers(spark, sf):
    return E.keep_first(D.table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("c_nationkey", "c_custkey")


# --- kinship, one function each -------------------------------------------------------


def _placed(spark, sf):
    return D.edges(spark, sf).withColumn("k", kin.kin(F.col("relation_kind"), F.col("generations"), F.col("via_marriage")))


_PLACED = f"WITH {D.EDGES}, {D.CANONICAL}"


@register("f03_orientations", f"{_PLACED} SELECT id, CASE WHEN relation_kind IN ('father', 'mother', 'uncle', 'boss') THEN 'to_senior' WHEN relation_kind IN ('brother', 'wife') THEN 'sym' ELSE 'as_is' END AS side FROM canonical")
def orientations(spark, sf):
    return _placed(spark, sf).select("id", kin.orientation(F.col("relation_kind"), F.col("k")).alias("side"))


@register("f04_canonical_pairs", f"{_PLACED} SELECT id, canon_from, canon_to FROM canonical")
def canonical_pairs(spark, sf):
    return _placed(spark, sf).select("id", kin.canon_pair(F.col("relation_kind"), F.col("k"), F.col("from_id"), F.col("to_id")).alias("p")).select("id", "p.canon_from", "p.canon_to")


@register("f05_canonical_tokens", f"{_PLACED} SELECT id, canon_key FROM canonical")
def canonical_tokens(spark, sf):
    return _placed(spark, sf).select("id", kin.canon_token(F.col("relation_kind"), F.col("k"), F.col("relation_type")).alias("canon_key"))


@register("f06_steps", f"{_PLACED} SELECT id, down - up AS step FROM canonical")
def steps(spark, sf):
    return _placed(spark, sf).select("id", kin.delta(F.col("k")).alias("step"))


@register("f07_parents", f"{_PLACED} SELECT id, to_id AS parent, from_id AS child FROM canonical WHERE relation_kind IN ('father', 'mother') AND NOT marriage")
def parents(spark, sf):
    return _placed(spark, sf).select("id", kin.blood_parent_child(F.col("k"), F.col("from_id"), F.col("to_id")).alias("p")).where("p IS NOT NULL").select("id", "p.parent", "p.child")


# --- entities and facts ---------------------------------------------------------------


@register(
    "g21_resolved_relatives",
    """WITH a AS (SELECT o_orderkey AS item_id, o_custkey % 5 AS user_id, o_custkey % 40 AS anchor_id, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 40 ELSE 0 END AS preferred_id FROM orders),
n AS (SELECT o_orderkey AS item_id, 500 + o_custkey % 9 AS named FROM orders WHERE o_orderkey % 7 = 0),
u AS (SELECT c_custkey % 5 AS user_id, c_custkey % 40 AS anchor_id, count(DISTINCT c_custkey) AS na, min(c_custkey) AS own FROM customer WHERE c_acctbal < -950 GROUP BY ALL),
e AS (SELECT s_suppkey % 5 AS user_id, s_suppkey % 40 AS anchor_id, count(*) AS ne, min(s_suppkey + 1) AS edge FROM supplier GROUP BY ALL),
j AS (SELECT a.*, CASE WHEN preferred_id > 0 AND preferred_id <> anchor_id THEN preferred_id END AS preferred, named, CASE WHEN na = 1 THEN own END AS only_one, CASE WHEN na IS NULL AND ne = 1 AND edge <> anchor_id THEN edge END AS by_edge, coalesce(na, 0) > 1 AS ambiguous
  FROM a LEFT JOIN n USING (item_id) LEFT JOIN u USING (user_id, anchor_id) LEFT JOIN e USING (user_id, anchor_id))
SELECT item_id, coalesce(preferred, named, only_one, by_edge) AS entity_id, CASE WHEN preferred IS NOT NULL THEN 'resolver' WHEN named IS NOT NULL THEN 'name' WHEN only_one IS NOT NULL THEN 'anchor' WHEN by_edge IS NOT NULL THEN 'edge' ELSE 'create' END AS rule, ambiguous FROM j""",
)
def resolved_relatives(spark, sf):
    o, c, s = (D.table(spark, sf, t) for t in ("orders", "customer", "supplier"))
    kind = F.lit("uncle").alias("kind")
    asked = o.select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 5).alias("user_id"), (F.col("o_custkey") % 40).alias("anchor_id"), kind, F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") % 40).otherwise(0).alias("preferred_id"))
    named = o.select(F.col("o_orderkey").alias("item_id"), (500 + F.col("o_custkey") % 9).alias("entity_id"), (F.col("o_orderkey") % 7 == 0).alias("consistent"))
    anchors = c.where("c_acctbal < -950").select((F.col("c_custkey") % 5).alias("user_id"), (F.col("c_custkey") % 40).alias("anchor_id"), kind, F.col("c_custkey").alias("entity_id"))
    links = s.select((F.col("s_suppkey") % 5).alias("user_id"), (F.col("s_suppkey") % 40).alias("from_id"), F.lit("uncle").alias("relation_kind"), (F.col("s_suppkey") + 1).alias("to_id"))
    return S.resolve_relatives(asked, named, anchors, links).select("item_id", "entity_id", "rule", "ambiguous")


@register(
    "g22_kin_consistent",
    f"""{_PLACED}, related AS (SELECT DISTINCT user_id, canon_from, canon_to FROM canonical WHERE canon_key = 'shape:1:1:0:blood'),
c AS (SELECT c_custkey, c_custkey % 5 AS user_id, c_custkey % 40 AS anchor_id, c_custkey % 97 AS entity_id FROM customer),
recorded AS (SELECT DISTINCT user_id, anchor_id, entity_id FROM c WHERE c_custkey % 6 = 0)
SELECT c_custkey, r.user_id IS NOT NULL OR d.user_id IS NOT NULL OR c_custkey % 13 = 0 AS consistent FROM c LEFT JOIN recorded d USING (user_id, anchor_id, entity_id)
  LEFT JOIN related r ON r.user_id = c.user_id AND canon_from = least(anchor_id, entity_id) AND canon_to = greatest(anchor_id, entity_id)""",
)
def kin_consistent(spark, sf):
    hint = F.when(F.col("c_custkey") % 13 == 0, F.upper("c_name")).otherwise("x")
    c = D.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("user_id"), (F.col("c_custkey") % 40).alias("anchor_id"), (F.col("c_custkey") % 97).alias("entity_id"), F.lit("brother").alias("kind"), hint.alias("hint"), F.col("c_name").alias("name"))
    recorded = c.where("c_custkey % 6 = 0").select("user_id", "anchor_id", "kind", "entity_id")
    return S.kin_consistent(c, recorded, E.with_canonical(D.edges(spark, sf))).select("c_custkey", "consistent")


@register("h17_applied_answers", "SELECT o_orderkey AS candidate_index, o_custkey AS matched_id FROM orders WHERE o_orderkey % 2 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def applied_answers(spark, sf):
    answers = D.table(spark, sf, "orders").select(F.lit("person").alias("kind"), F.col("o_orderkey").alias("candidate_index"), F.col("o_custkey").alias("matched_id"))
    visible = D.table(spark, sf, "customer").where("c_acctbal > 0").select(F.lit("person").alias("kind"), F.col("c_custkey").alias("id"))
    return S.applied_answers(answers, answers.where("candidate_index % 2 = 0"), visible).select("candidate_index", "matched_id")


@register("h21_writable_entities", "SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 5 IN (0, 3) OR c_custkey % 5 = 1 AND c_custkey % 2 = 0")
def writable_entities(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("Анна", "мой отец", " ", "Пётр", "он")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    kind = F.when((F.col("c_custkey") % 5 == 1) & (F.col("c_custkey") % 2 == 0), "place").otherwise("person")
    items = D.table(spark, sf, "customer").select("c_custkey", name.alias("name"), kind.alias("entity_type"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey")).alias("match_id"))
    return S.writable_entities(items).select("c_custkey")


@register("h30_recognized_mentions", "SELECT o_custkey AS source_id, lower(o_orderpriority) AS normalized_name, max(o_totalprice / 500000) AS score, count(*) AS n_mentions FROM orders WHERE o_totalprice / 500000 >= 0.5 GROUP BY ALL")
def recognized_mentions(spark, sf):
    found = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), F.lit("person").alias("entity_type"), F.concat(F.lit(" "), "o_orderpriority").alias("name"), (F.col("o_totalprice") / 500000).alias("score"))
    return S.recognized_entities(found).select("source_id", "normalized_name", "score", "n_mentions")


# --- measures, lexicons, models -------------------------------------------------------


@register("d24_model_effect", "SELECT c_mktsegment AS source, sum(levenshtein(c_name, replace(c_name, '00', 'O'))) / sum(length(c_name)) AS cer, count(*) AS lines FROM customer GROUP BY 1")
def model_effect(spark, sf):
    rows = D.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_name").alias("reference"), F.replace("c_name", F.lit("00"), F.lit("O")).alias("hypothesis"))
    return Q.rates(Q.pair_counts(rows, words=False), ["source"])


@register("l09_accepted_lines", "SELECT o_orderkey AS line_id, CASE WHEN ok THEN o_orderstatus ELSE o_orderpriority END AS text, coalesce(ok, false) AS accepted FROM orders LEFT JOIN (SELECT l_orderkey, min(coalesce(CASE WHEN l_linenumber <> 7 THEN l_discount < 0.08 END, false)) AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def accepted_lines(spark, sf):
    lines = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_id"), F.col("o_orderpriority").alias("before"), F.col("o_orderstatus").alias("after"))
    changes = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("line_id"), F.when(F.col("l_linenumber") != 7, F.col("l_discount") < 0.08).alias("in_lexicon"))
    return Q.accept_verified(lines, changes).select("line_id", "text", "accepted")


_BENCH_GRAMS = """g AS (SELECT n, substr(text, i, n - 1) AS context, substr(text, i + n - 1, 1) AS next, count(*) AS c FROM benchmark, generate_series(1, 3) s(n), generate_series(1, 100000) p(i) WHERE i + n - 1 <= length(text) GROUP BY ALL)"""


@register("d18_pruned_model", f"WITH {_BENCH_GRAMS}, k AS (SELECT * FROM g WHERE n = 1 OR c >= 3) SELECT n::INT AS n, context, next, log10(c / sum(c) OVER (PARTITION BY n, context)) AS logprob FROM k")
def pruned_model(spark, sf):
    return lm.model(lm.char_ngrams(D.table(spark, sf, "benchmark"), 3), 3)


@register("n05_usable_models", "SELECT source, min(CASE WHEN strpos(text, ' ') > 0 THEN 1 ELSE 0 END) = 1 AND sum(n_chars) >= 1000 AS usable FROM documents WHERE text IS NOT NULL GROUP BY source")
def usable_models(spark, sf):
    meta = D.table(spark, sf, "documents").where("text IS NOT NULL").groupBy("source").agg(F.min(F.instr("text", F.lit(" ")) > 0).alias("knows_space"), F.sum("n_chars").alias("running_text_chars"))
    return meta.select("source", lm.usable(meta).alias("usable"))


@register("o02_bloom_probe", "SELECT DISTINCT c_name AS word, true AS may_contain FROM customer WHERE c_custkey % 2 = 0")
def bloom_probe(spark, sf):
    words = D.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("word"))  # what went in is always found
    size, hashes = L.bloom_size(words.count(), 0.01)
    return L.bloom_probe(words, bytes(L.bloom_build(words, size, hashes).first()["bits"]), hashes)


@register("o06_confirmation_preview", "SELECT DISTINCT o_clerk AS word FROM (SELECT 'w' || o_custkey AS o_clerk, o_orderstatus FROM orders) a WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM orders b WHERE 'w' || b.o_custkey = a.o_clerk AND b.o_orderstatus <> 'P')")
def confirmation_preview(spark, sf):
    words = D.table(spark, sf, "orders").select(F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("word"), "o_orderstatus")
    return L.dictionary_delta(words.where("o_orderstatus <> 'P'"), words, words.where("o_orderstatus = 'P'"))


@register(
    "h12_enriching_facts",
    """WITH i AS (SELECT o_custkey AS subject_id, o_orderkey AS item_id, o_orderkey % 2 = 0 AS valued FROM orders),
f AS (SELECT *, min(item_id) OVER (PARTITION BY subject_id) AS first_item, min(item_id) FILTER (valued) OVER (PARTITION BY subject_id) AS first_valued FROM i)
SELECT item_id, CASE WHEN item_id = CASE WHEN valued THEN first_valued ELSE first_item END THEN 'created' ELSE 'merged' END AS action, CASE WHEN valued THEN first_valued ELSE first_item END AS fact_id FROM f""",
)
def enriching_facts(spark, sf):
    none = F.lit(None).cast("string")
    items = D.table(spark, sf, "orders").select(F.lit(1).cast("long").alias("user_id"), F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("subject_id"), F.lit("родился").alias("predicate"), F.lit("birth_place").alias("predicate_kind"), F.lit(None).cast("long").alias("object_id"), F.when(F.col("o_orderkey") % 2 == 0, "город").alias("object_text"), none.alias("time_iso"), none.alias("time_text"), F.when(F.col("o_orderkey") % 2 == 0, "город").otherwise("").alias("value"))
    return K.decide(items).select("item_id", "action", "fact_id")


# --- sources and sinks ----------------------------------------------------------------


def _folder(spark, name):
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("a06_diary_sources", "SELECT length(source) % 3 AS user_id, doc_id AS ref_id, lang AS title, sha256(coalesce(text, '')) AS text_hash FROM documents")
def diary_sources(spark, sf):
    pages = D.table(spark, sf, "documents").select((F.length("source") % 3).cast("long").alias("user_id"), F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("text").alias("content"))
    path = _folder(spark, "sources")
    X.save_sources(X.diary_sources(pages), path)
    return spark.read.parquet(path).where("source_type = 'diary'").select("user_id", "ref_id", "title", T.text_hash(F.col("text")).alias("text_hash"))


@register("a11_word_forms", "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part")
def word_forms(spark, sf):
    path = _folder(spark, "words")
    D.table(spark, sf, "part").select(F.concat("p_name", F.lit("/flags\t7")).alias("value")).write.text(path)
    return X.word_forms(spark, path)


@register("a21_decision_log", "SELECT event_id, ts::DATE AS day FROM events")
def decision_log(spark, sf):
    path = _folder(spark, "log")
    events = D.table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"))
    X.append_events(events.where("event_id % 2 = 0"), path)
    X.append_events(events.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path).select("event_id", "day")
