"""Queries on recognition quality, proposals and page layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.catalog import register
from vellum.functions import udfs as U
from vellum.operators import decode, layout
from vellum.operators import measures as Q
from vellum.plans import tables as D


def _pairs(spark, sf):
    """Pairs of short lines: the description of each part and that of the next of its brand."""
    line = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = D.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("source"), line.alias("reference"), F.lead(line).over(w).alias("hypothesis"))
    return rows.where("hypothesis IS NOT NULL")


_PAIRS = """p AS (SELECT * FROM (SELECT p_partkey AS doc_id, p_brand AS source, concat_ws(' ', p_name, p_brand, p_type) AS reference,
  lead(concat_ws(' ', p_name, p_brand, p_type)) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS hypothesis FROM part) WHERE hypothesis IS NOT NULL)"""


def _whole(spark, sf):
    """Pairs of whole texts, each document and the next of its source and language, in all languages."""
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    rows = D.table(spark, sf, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("reference"), F.lead(F.coalesce("text", F.lit(""))).over(w).alias("hypothesis"))
    return rows.where("hypothesis IS NOT NULL").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")  # few bytes, much work


@register("l01_levenshtein", f"WITH {_PAIRS} SELECT doc_id, levenshtein(reference, hypothesis)::INT AS char_distance, length(reference)::INT AS char_reference FROM p")
def levenshtein(spark, sf):
    return Q.pair_counts(_pairs(spark, sf), words=False).select("doc_id", "char_distance", "char_reference")


@register("l02_word_distance")
def word_distance(spark, sf):
    return Q.row_rates(Q.pair_counts(_whole(spark, sf), long=True)).select("doc_id", "word_distance", "word_reference", "cer", "wer")


@register("l03_cer", f"WITH {_PAIRS} SELECT doc_id, CASE WHEN length(reference) = 0 THEN CASE WHEN length(hypothesis) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(reference, hypothesis) / length(reference) END::DOUBLE AS cer FROM p")
def cer(spark, sf):
    rows = Q.pair_counts(_pairs(spark, sf), words=False)
    return rows.select("doc_id", Q.rate(F.col("char_distance"), F.col("char_reference"), F.col("char_hypothesis")).alias("cer"))


@register("d15_error_rates", f"WITH {_PAIRS} SELECT source, sum(levenshtein(reference, hypothesis)) / sum(length(reference)) AS cer, count(*) AS lines FROM p GROUP BY source")
def error_rates(spark, sf):
    return Q.rates(Q.pair_counts(_pairs(spark, sf), words=False), ["source"])


@register("d15_word_rates")
def word_rates(spark, sf):
    return Q.rates(Q.pair_counts(_whole(spark, sf), long=True), ["source"])


@register("l04_accuracy_gate", f"WITH {_PAIRS} SELECT count(*) FILTER (reference = hypothesis) AS equal_lines, 0::BIGINT AS extra_lines, sum(levenshtein(reference, hypothesis)) / sum(length(reference)) AS cer, sum(levenshtein(reference, hypothesis)) / sum(length(reference)) <= 0.05 AS passed FROM p")
def gate(spark, sf):
    rows = _pairs(spark, sf).select(F.lit(1).alias("page_id"), F.col("doc_id").alias("order_index"), "reference", "hypothesis")
    a, b = rows.withColumnRenamed("reference", "text"), rows.withColumnRenamed("hypothesis", "text")
    return Q.accuracy_gate(a, b).select("equal_lines", "extra_lines", "cer", "passed")


def _configs(spark, sf):
    """Three settings a page: the setting k keeps the first k thirds of the hypothesis."""
    cut = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("config")
    kept = F.ceil(F.length("hypothesis") * F.col("config") / 3).cast("int")
    rows = _whole(spark, sf).select("*", cut).withColumn("hypothesis", F.substring(F.col("hypothesis"), F.lit(1), kept)).withColumn("page_id", F.col("doc_id") % 5)
    return Q.pair_counts(rows, long=True)


@register("d22_best_config")
def best_config(spark, sf):
    return Q.best_config(_configs(spark, sf))


@register("d23_leave_one_page_out")
def leave_one_page_out(spark, sf):
    return Q.leave_one_page_out(_configs(spark, sf))


@register("d13_confusions")
def confusions(spark, sf):
    return Q.confusions(_whole(spark, sf).select(F.col("hypothesis").alias("predicted"), F.col("reference").alias("corrected")))


@register("d14_examples", f"WITH {_PAIRS}, f AS (SELECT reference AS corrected, arg_min(hypothesis, doc_id) AS predicted, min(doc_id) AS d FROM p GROUP BY 1) SELECT predicted, corrected FROM f ORDER BY abs(length(predicted) - length(corrected)), length(corrected), d LIMIT 5")
def examples(spark, sf):
    return Q.examples(_pairs(spark, sf).select(F.col("hypothesis").alias("predicted"), F.col("reference").alias("corrected"), F.col("doc_id").alias("position")))


@register("l05_substitutions")
def substitutions(spark, sf):
    return U.substitution_counts(_whole(spark, sf), "hypothesis", "reference")


@register("l06_word_changes")
def word_changes(spark, sf):
    return U.change_rows(_whole(spark, sf).select("doc_id", F.col("reference").alias("before"), F.col("hypothesis").alias("after")), "doc_id", "before", "after")


@register("l07_verified_changes")
def verified(spark, sf):
    from vellum.operators import lexicon as L
    from vellum.plans import language

    lines = _whole(spark, sf).select(F.col("doc_id").alias("line_id"), F.col("reference").alias("before"), F.col("hypothesis").alias("after"))
    words = lines.select(F.explode(F.split("after", " ")).alias("word"))
    return Q.verified_changes(lines, L.verdicts(words, language._base(spark, sf)))


@register("l12_rebuilt_lines", "SELECT l_orderkey AS line_id, string_agg(l_shipdate::DATE::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS text FROM lineitem GROUP BY 1")
def rebuilt(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("line_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.lit(None).cast("string").alias("corrected"), F.col("l_shipdate").cast("date").cast("string").alias("predicted"))
    return Q.rebuilt_lines(rows)


@register("b20_quality_gate", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END < 100000, false) AS accepted FROM orders")
def quality_gate(spark, sf):
    rows = D.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("candidate_cer"), F.lit(100000.0).alias("baseline_cer"))
    return Q.quality_gate(rows).select("o_orderkey", "accepted")


# --- decoding and layout --------------------------------------------------------------


def _frames(spark, sf):
    """Frames of four classes from the first components of vectors, as probabilities."""
    part = F.slice("embedding", 1, 40)
    power = F.transform(part, lambda x: F.exp(8 * x.cast("double")))
    frames = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda t: F.slice(power, t * 4 + 1, F.lit(4)))
    scaled = F.transform(frames, lambda f: F.transform(f, lambda x: x / F.aggregate(f, F.lit(0.0), lambda a, y: a + y)))
    return D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("line_id"), scaled.alias("frames"))


@register(
    "n09_greedy",
    """WITH f AS (SELECT vec_id, t, list_transform(embedding[t * 4 + 1 : t * 4 + 4], lambda x: x::DOUBLE) AS p FROM embeddings, generate_series(0, 9) g(t)),
l AS (SELECT vec_id, t, list_position(p, list_max(p)) - 1 AS label FROM f), d AS (SELECT *, lag(label) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM l)
SELECT vec_id AS line_id, coalesce(string_agg(['', 'a', 'b', ' '][label + 1], '' ORDER BY t) FILTER (label <> 0 AND (before IS NULL OR before <> label)), '') AS text FROM d GROUP BY 1""",
)
def greedy(spark, sf):
    return _frames(spark, sf).select("line_id", decode.greedy(F.col("frames"), ["", "a", "b", " "]).alias("text"))


@register("n06_frame_candidates")
def candidates(spark, sf):
    return _frames(spark, sf).select("line_id", F.size(decode.frame_candidates(F.get("frames", F.lit(0)), 3, 0.05)).alias("n"))


@register("n07_beam_search")
def beam(spark, sf):
    return decode.decode_lines(_frames(spark, sf), ["", "a", "b", " "], settings=decode.Beam(width=12, top_k=4), n=3)


def _baselines(spark, sf, by_page=False):
    """Baselines of pages from line items: two points each; ``by_page`` brings a page's lines together once for all steps."""
    x, y = F.col("l_partkey") % 500, F.col("l_linenumber") * 40 + F.col("l_suppkey") % 3
    line = F.array(F.array(x.cast("double"), y.cast("double")), F.array((x + 60 + F.col("l_quantity")).cast("double"), y.cast("double")))
    items = D.table(spark, sf, "lineitem")
    if by_page:
        items = items.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").repartition("l_orderkey")
    return items.select(F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("line_id"), line.alias("baseline"), F.lit(20.0).alias("height")).groupBy("page_id", "line_id", "height").agg(F.min("baseline").alias("baseline"))


@register("p01_boxes", "SELECT DISTINCT l_orderkey AS page_id, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS line_id, (l_partkey % 500)::DOUBLE AS x0, (l_partkey % 500 + 60 + l_quantity)::DOUBLE AS x1 FROM lineitem QUALIFY row_number() OVER (PARTITION BY page_id, line_id ORDER BY x1) = 1")
def boxes(spark, sf):
    rows = _baselines(spark, sf).select("page_id", "line_id", layout.bbox(F.col("baseline")).alias("b"))
    return rows.select("page_id", "line_id", "b.x0", "b.x1")


@register("p02_pitch")
def pitch(spark, sf):
    return layout.pitch(_baselines(spark, sf))


@register("p04_collinear_groups")
def groups(spark, sf):
    # lines of no page stand alone; without them both steps read one exchange
    alone = _baselines(spark, sf).where("page_id IS NULL").select("page_id", "line_id", F.col("line_id").alias("group"))
    rows = _baselines(spark, sf, by_page=True).where("page_id IS NOT NULL")
    return layout.collinear_groups(rows, layout.pitch(rows)).union(alone)


@register("p06_reading_order", "WITH b AS (SELECT DISTINCT ON (l_orderkey, line_id) l_orderkey AS page_id, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS line_id, l_linenumber * 40 + l_suppkey % 3 AS y, l_partkey % 500 AS x FROM lineitem) SELECT page_id, line_id, (row_number() OVER (PARTITION BY page_id ORDER BY y, x, line_id) - 1)::INT AS order_index FROM b")
def order(spark, sf):
    return layout.reading_order(_baselines(spark, sf)).select("page_id", "line_id", "order_index")


@register("p05_bands", "WITH l AS (SELECT DISTINCT ON (l_orderkey, line_id) l_orderkey AS page_id, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS line_id, l_linenumber * 40 + l_suppkey % 3 AS y FROM lineitem), o AS (SELECT page_id, line_id, b AS band, least(b * 40 + 15, y + 5) - greatest(b * 40 - 15, y - 15) AS overlap FROM l, generate_series(1, 7) g(b)) SELECT page_id, line_id, band::INT AS band FROM o WHERE overlap > 0")
def bands(spark, sf):
    rows = _baselines(spark, sf).select("page_id", "line_id", F.get(F.get("baseline", F.lit(0)), F.lit(1)).alias("y")).select("page_id", "line_id", (F.col("y") - 15).alias("top"), (F.col("y") + 5).alias("bottom"))
    known = rows.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("band")).select("page_id", "band", (F.col("band") * 40 - 15).cast("double").alias("top"), (F.col("band") * 40 + 15).cast("double").alias("bottom"))
    return layout.bands_of(rows, known).select("page_id", "line_id", "band")
