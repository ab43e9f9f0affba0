"""Queries on words, vocabularies and language models."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import register
from vellum.functions import text as T
from vellum.functions import udfs as U
from vellum.operators import lexicon as L
from vellum.operators import lm as N
from vellum.plans import tables as D

WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}\p{{Mn}}_''’-]+')"


def _tokens(spark, sf, name="documents", key="doc_id"):
    return D.table(spark, sf, name).select(key, F.posexplode(T.words(F.col("text"))).alias("position", "word"))


_DOC_WORDS = f"w AS (SELECT doc_id, source, unnest({WORDS.format('text')}) AS word FROM documents)"
_BASE = f"base AS (SELECT DISTINCT lower(word) AS word FROM (SELECT unnest({WORDS.format('text')}) AS word FROM benchmark))"


@register("j02_text_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents")
def text_hash(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.text_hash(F.col("text")).alias("text_hash"))


@register("j08_word_counts", f"SELECT doc_id, len({WORDS.format('text')})::INT AS n_words FROM documents")
def word_counts(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"))


@register("j08_word_spans", f"WITH s AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark) SELECT item_id, len(w)::INT AS n, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS letters, true AS placed FROM s")
def word_spans(spark, sf):
    rows = D.table(spark, sf, "benchmark").select("item_id", "text", T.spans(F.col("text")).alias("s"))
    placed = F.forall("s", lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]) == x["word"])
    return rows.select("item_id", F.size("s").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("letters"), placed.alias("placed"))


@register("j09_space_tokens", "SELECT item_id, len(string_split_regex(trim(text), '\\s+'))::INT AS n FROM benchmark")
def space_tokens(spark, sf):
    return D.table(spark, sf, "benchmark").select("item_id", F.size(T.space_tokens(F.col("text"))).alias("n"))


@register("j10_normalize_words", f"WITH {_DOC_WORDS} SELECT word, regexp_replace(translate(lower(word), 'ѣіѳѵ', 'еифи'), 'ъ$', '') AS form FROM (SELECT DISTINCT word FROM w)")
def normalize_words(spark, sf):
    return _tokens(spark, sf).select("word").distinct().select("word", T.normalize_word(F.col("word")).alias("form"))


@register(
    "j06_chunks",
    r"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS size FROM documents WHERE NOT regexp_full_match(text, '\s*')),
w AS (SELECT doc_id, 0 AS chunk_index, 0::BIGINT AS start FROM t UNION ALL SELECT doc_id, chunk_index + 1, greatest(stop - 200, start + 1) FROM (SELECT w.*, size, CASE WHEN start + 1200 >= size THEN size
    WHEN strpos(reverse(substr(text, start + 2, 1199)), ' ') > 0 THEN start + 1200 - strpos(reverse(substr(text, start + 2, 1199)), ' ') ELSE start + 1200 END AS stop FROM w JOIN t USING (doc_id)) WHERE stop < size),
e AS (SELECT w.*, text, CASE WHEN start + 1200 >= size THEN size WHEN strpos(reverse(substr(text, start + 2, 1199)), ' ') > 0 THEN start + 1200 - strpos(reverse(substr(text, start + 2, 1199)), ' ') ELSE start + 1200 END AS stop FROM w JOIN t USING (doc_id))
SELECT doc_id, chunk_index, start::INT AS start, stop::INT AS "end", substr(text, start + 1, stop - start) AS text FROM e""",
)
def chunks(spark, sf):
    rows = D.table(spark, sf, "documents").select("doc_id", "text", F.posexplode(U.chunks(F.col("text"), 1200, 200)).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", "c.start", "c.end", F.substring(F.col("text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("text"))


@register("j07_neighbor_context", "WITH d AS (SELECT doc_id, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS b, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS a FROM documents) SELECT doc_id, concat_ws(chr(10), CASE WHEN trim(coalesce(b, '')) <> '' THEN '…' || right(b, 50) END, CASE WHEN trim(coalesce(a, '')) <> '' THEN left(a, 50) || '…' END) AS context FROM d")
def neighbor_context(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    rows = D.table(spark, sf, "documents").select("doc_id", F.lag("text").over(w).alias("b"), F.lead("text").over(w).alias("a"))
    return rows.select("doc_id", T.neighbor_context(F.col("b"), F.col("a"), 50).alias("context"))


@register("h01_locate_quote", "SELECT item_id, 10 AS start, 10 + length(substr(text, 11, 30)) AS stop FROM benchmark WHERE length(text) > 60 AND strpos(text, substr(text, 11, 30)) = 11")
def locate(spark, sf):
    rows = D.table(spark, sf, "benchmark").where("length(text) > 60").select("item_id", "text", F.substring("text", 11, 30).alias("quote"))
    rows = rows.where("instr(text, quote) = 11")
    return rows.select("item_id", T.locate_quote(F.col("text"), F.col("quote")).alias("q")).select("item_id", "q.start", F.col("q.end").cast("long").alias("stop"))


@register("h03_sentences")
def sentence(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", T.sentence_around(F.col("text"), F.lit(40), F.lit(45)).alias("sentence"))


@register("d11_top_words", f"WITH {_DOC_WORDS} SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 200")
def top_words(spark, sf):
    return L.top_words(_tokens(spark, sf), 200)


@register("d12_common_words", f"WITH w AS (SELECT word, (doc_id * 1000000 + i) AS position FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS word, unnest(generate_series(0, len({WORDS.format('text')}) - 1)) AS i FROM documents)) SELECT word, count(*) AS n, min(position)::BIGINT AS first_position FROM w GROUP BY word ORDER BY n DESC, first_position, word LIMIT 100")
def common_words(spark, sf):
    rows = _tokens(spark, sf).select("word", (F.col("doc_id") * 1_000_000 + F.col("position")).alias("position"))
    return L.common_words(rows, 100)


def _base(spark, sf):
    return _tokens(spark, sf, "benchmark", "item_id").select(T.normalize_word(F.col("word")).alias("word")).distinct()


_VERDICT = f"""{_DOC_WORDS}, {_BASE}, p AS (SELECT DISTINCT word, unnest(list_filter(string_split(word, '-'), lambda x: x <> '')) AS piece FROM w),
ok AS (SELECT word, bool_and(NOT regexp_matches(piece, '\\p{{L}}') OR regexp_matches(piece, '\\p{{N}}') OR length(piece) = 1 OR lower(piece) IN (SELECT word FROM base)) AS parts FROM p GROUP BY word),
v AS (SELECT DISTINCT w.word, (NOT regexp_matches(w.word, '\\p{{L}}') OR regexp_matches(w.word, '\\p{{N}}') OR length(w.word) = 1 OR lower(w.word) IN (SELECT word FROM base) OR (contains(w.word, '-') AND coalesce(parts, false))) AS known FROM w LEFT JOIN ok ON ok.word = w.word)"""


@register("o03_verdicts", f"WITH {_VERDICT} SELECT word, CASE WHEN known THEN 'known' ELSE 'unknown' END AS verdict FROM v")
def verdicts(spark, sf):
    return L.verdicts(_tokens(spark, sf), _base(spark, sf))


@register("d16_oov_by_page", f"WITH {_VERDICT} SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT known) AS n_unknown FROM w JOIN v USING (word) GROUP BY doc_id")
def oov(spark, sf):
    rows = _tokens(spark, sf)
    return L.oov_counts(rows, L.verdicts(rows, _base(spark, sf)), ("doc_id",)).select("doc_id", "n_words", "n_unknown")


@register("o07_oov_rate", f"WITH {_VERDICT} SELECT source, count(*) FILTER (NOT known) / count(*) AS oov_rate FROM w JOIN v USING (word) GROUP BY source")
def oov_rate(spark, sf):
    rows = D.table(spark, sf, "documents").select("source", F.explode(T.words(F.col("text"))).alias("word"))
    return L.oov_counts(rows, L.verdicts(rows, _base(spark, sf)), ("source",)).select("source", "oov_rate")


@register("d17_leave_one_out", f"WITH {_DOC_WORDS}, d AS (SELECT DISTINCT doc_id, word FROM w), c AS (SELECT word, count(*) AS n FROM d GROUP BY word) SELECT doc_id AS page_id, count(*) AS n_words, count(*) FILTER (n = 1) AS n_unknown FROM w JOIN c USING (word) GROUP BY doc_id")
def leave_one_out(spark, sf):
    return L.leave_one_out(_tokens(spark, sf).withColumnRenamed("doc_id", "page_id")).select("page_id", "n_words", "n_unknown")


@register("d17_percentiles", "SELECT list_sort(list(n_chars))[greatest(1, ceil(count(*) * 0.5))::INT] AS p50, list_sort(list(n_chars))[greatest(1, ceil(count(*) * 0.9))::INT] AS p90 FROM documents")
def percentiles(spark, sf):
    return L.nearest_rank(D.table(spark, sf, "documents"), "n_chars", (0.5, 0.9))


@register("d21_dictionary_delta", f"WITH {_DOC_WORDS} SELECT DISTINCT word FROM w WHERE doc_id = 3 AND word NOT IN (SELECT word FROM w WHERE doc_id <> 3)")
def delta(spark, sf):
    rows = _tokens(spark, sf)
    return L.dictionary_delta(rows.where("doc_id <> 3"), rows, rows.where("doc_id = 3"))


@register("j15_line_breaks")
def line_breaks(spark, sf):
    known = _tokens(spark, sf).select(T.normalize_word(F.col("word")).alias("word")).distinct()
    return L.line_breaks(D.lines(spark, sf), known, interior=_base(spark, sf))[0]


@register("j16_author_vocabulary")
def author_vocabulary(spark, sf):
    return L.author_vocabulary(D.lines(spark, sf), _base(spark, sf))[1]


@register("j17_occurrences")
def occurrences(spark, sf):
    rows = D.lines(spark, sf).select("page_id", "order_index", F.posexplode(T.words(F.col("text"))).alias("position", "word"))
    return L.occurrences(rows, L.verdicts(rows, _base(spark, sf)))


@register("o01_bloom", f"WITH {_BASE} SELECT count(*) AS n, true AS all_found FROM base WHERE word <> ''")
def bloom(spark, sf):
    words = _base(spark, sf).where("word <> ''")
    size, hashes = L.bloom_size(20_000, 0.01)
    bits = L.bloom_build(words, size, hashes).first()
    return L.bloom_probe(words, bytes(bits.bits), hashes).agg(F.count("*").alias("n"), F.min("may_contain").alias("all_found"))


@register("o08_knowledge_terms", "WITH e AS (SELECT c_custkey % 3 AS user_id, c_mktsegment AS term, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC) AS r FROM customer) SELECT user_id, count(DISTINCT lower(term)) AS n FROM e WHERE r <= 200 GROUP BY 1")
def knowledge_terms(spark, sf):
    e = D.table(spark, sf, "customer").select((F.col("c_custkey") % 3).alias("user_id"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("canonical_name"), F.col("c_acctbal").alias("last_seen_at"))
    none = spark.createDataFrame([], "user_id long, id long, title string")
    return L.knowledge_terms(e, none).groupBy("user_id").agg(F.count("*").alias("n"))


_GRAMS = "g AS (SELECT n, substr(text, i, n - 1) AS context, substr(text, i + n - 1, 1) AS next FROM benchmark, generate_series(1, 3) a(n), generate_series(1, 5000) b(i) WHERE i + n - 1 <= length(text)), c AS (SELECT n, context, next, count(*) AS count FROM g GROUP BY ALL)"


@register("n01_char_ngrams", f"WITH {_GRAMS} SELECT n::INT AS n, context, next, count FROM c")
def char_ngrams(spark, sf):
    return N.char_ngrams(D.table(spark, sf, "benchmark"), 3)


@register("n01_char_model", f"WITH {_GRAMS} SELECT n::INT AS n, context, next, log10(count / sum(count) OVER (PARTITION BY n, context)) AS logprob FROM c WHERE n = 1 OR count >= 3")
def char_model(spark, sf):
    return N.model(N.char_ngrams(D.table(spark, sf, "benchmark"), 3), 3)


@register("n03_text_logprobs")
def text_logprobs(spark, sf):
    table = N.model(N.char_ngrams(D.table(spark, sf, "benchmark"), 4), 2)
    texts = D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return N.text_logprobs(texts, table, 4)


@register("n13_word_ngrams", f"WITH w AS (SELECT list_concat(['<s>'], {WORDS.format('text')}, ['</s>']) AS w FROM benchmark), g AS (SELECT 2 AS n, w[i] AS context, w[i + 1] AS next FROM w, generate_series(1, 5000) a(i) WHERE i < len(w)) SELECT n, context, next, count(*) AS count FROM g GROUP BY ALL")
def word_ngrams(spark, sf):
    rows = D.table(spark, sf, "benchmark").select(T.words(F.col("text")).alias("words"))
    return N.word_ngrams(rows, 2).where("n = 2")


@register("n10_rescore", "WITH c AS (SELECT l_orderkey AS line_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank, l_discount - l_tax * 0.5 AS f FROM lineitem) SELECT line_id, count(*) AS n, CASE WHEN count(*) > 1 THEN max(f) END AS rescored FROM c GROUP BY 1")
def rescore(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("line_id"), rank.alias("rank"), F.col("l_partkey").cast("string").alias("text"), F.col("l_discount").alias("score"), F.lit(-99.0).alias("acoustic"), (-F.col("l_tax")).alias("lm_score"), F.lit(1).alias("n_words"), F.lit(True).alias("all_known"))
    counts = rows.groupBy("line_id").agg(F.count("*").alias("n"))
    return N.rescore(rows, guard=False).join(counts, "line_id").select("line_id", "n", "rescored")


@register("n12_unique_hypotheses", "SELECT l_partkey::VARCHAR AS text, min(l_orderkey) AS page_id FROM lineitem GROUP BY 1")
def unique_hypotheses(spark, sf):
    return N.unique_hypotheses(D.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("text"), F.col("l_orderkey").alias("page_id")))


@register("j18_json_objects", "SELECT event_id, props AS body FROM events")
def json_objects(spark, sf):
    noisy = F.concat(F.lit("<think>{\"a\": 1}</think> so: "), F.col("props"), F.lit(" done"))
    return D.table(spark, sf, "events").select("event_id", T.first_json_object(noisy).alias("body"))


@register("j19_context_blocks", "SELECT conv_id, string_agg('[' || r || '] ' || text, chr(10) ORDER BY r) AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1")
def context_blocks(spark, sf):
    rows = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("p"))
    return rows.select("conv_id", T.numbered(F.col("p")).alias("block"))
