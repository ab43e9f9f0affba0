"""Registered queries of this subpackage over the driver tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import html_text, licences, mixing, mpeg, packing, quality, secrets, simhash, topk, toxicity

TOKENIZER = {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3, radius=2)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 2048 tokens."""
    pieces = packing.pack(_read(spark, sf_dir, "documents"), size=2048, end_id=1, **TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, through a ledger that is kept and read back."""
    docs = _read(spark, sf_dir, "documents")
    return secrets.digest(secrets.report(docs, secrets.update(docs)))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector."""
    return topk.top_k(_read(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), most=(3000, 1500))


def op6_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as MPEG audio and read back, with the offsets of all frames."""
    rows = mpeg.inspect(mpeg.media(_read(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", *[F.concat_ws("=", F.lit(c), F.col(c).cast("string")) for c in ("frames", "samples", "seconds_exact", "checked", "damaged", "skipped", "tags", "vbr")], F.concat(F.lit("last="), F.element_at("offsets", -1).cast("string")))
    return rows.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "offsets")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings from the labels: 0 for low quality, 1 for good but toxic, 2 for good texts."""
    good = F.col("quality") == 1
    return _read(spark, sf_dir, "labels").select("doc_id", F.when(good & (F.coalesce("toxic", F.lit(0)) == 0), 2).when(good, 1).when(F.col("quality") == 0, 0).alias("grade"))


#: Lowest probability of grade 1 or better with which a document stays.
KEEP_FROM = 0.5


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, and whether it stays."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, grades(spark, sf_dir), grades=3, most=4000)
    rows = quality.grade(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_acceptable"), F.col("tails")[1].alias("p_good"), (F.col("tails")[0] >= KEEP_FROM).alias("keep"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(_read(spark, sf_dir, "pages"), carry=("url",))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, as text."""
    found = licences.scan(_read(spark, sf_dir, "documents"))
    spots = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["sentence"].cast("string"), m["licence"], m["rule"].cast("string"))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join("licences", ",").alias("licences"), spots.alias("matches"))


MIX = {"weights": (3, 1, 2), "budget": 1.5, "limit": 2, "block": 8, "shard_rows": 2_000, "seed": 42}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives to the mix of all sources."""
    return mixing.mix(_read(spark, sf_dir, "documents"), **MIX).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {"op1_simhash": op1_simhash, "op2_packing": op2_packing, "op3_secrets": op3_secrets, "op4_topk": op4_topk, "op5_toxicity": op5_toxicity, "op6_mpeg_media": op6_mpeg_media, "op7_quality": op7_quality, "op8_main_text": op8_main_text, "op9_mixing": op9_mixing, "op10_licences": op10_licences, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name, where SQL can express the query."""
    return {"op4_topk": topk.oracle(k=20, every=20, scale=64.0), "op9_mixing": mixing.oracle(**MIX)}
