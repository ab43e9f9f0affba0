"""Streaming queries over the driver's event table; each runs over what is there and ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.catalog import register
from vellum.operators.components import checkpoint_folder
from vellum.plans import tables as D
from vellum.streaming import archive as A


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Result of a stream, through the checkpoint folder of the session."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    return A.run_once(stream, f"t_{uuid.uuid4().hex}", mode, folder)


def _run_stored(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Appended rows of a stream of any size, as files below the checkpoint folder."""
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    return A.run_into(stream, f"{folder}/rows", f"{folder}/state")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = D.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@register("t01_changed_sources", "SELECT count(DISTINCT (user_id, event_type, props)) AS n FROM events")
def changed(spark, sf):
    rows = _events(spark, sf).select("user_id", F.col("event_type").alias("source_type"), F.lit(1).alias("ref_id"), F.col("props").alias("text"), F.col("ts").alias("created_at"))
    return _run_stored(spark, A.changed_sources(rows, "400 days").select("user_id")).agg(F.count("*").alias("n"))


@register("t02_decision_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS action, value > 50 AS in_lexicon, count(*) AS n FROM events GROUP BY ALL")
def decisions(spark, sf):
    rows = _events(spark, sf).select(F.col("ts").alias("created_at"), F.col("event_type").alias("action"), (F.col("value") > 50).alias("in_lexicon"))
    return _run(spark, A.decision_counts(rows), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("t04_goal_states", "WITH e AS (SELECT user_id AS goal_id, event_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'abandoned' WHEN 'signup' THEN 'active' END AS s FROM events) SELECT goal_id, coalesce(arg_max(s, event_id) FILTER (s IS NOT NULL), 'active') AS status FROM e GROUP BY 1")
def goals(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "abandoned").when(F.col("event_type") == "signup", "started").otherwise("mentioned")
    rows = _events(spark, sf).select(F.col("user_id").alias("goal_id"), F.col("event_id").alias("seq"), kind.alias("progress_kind"))
    return _run(spark, A.goal_states(rows), "complete")


@register("t05_queue", "SELECT DISTINCT user_id AS page_id FROM events")
def queue(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("page_id"), F.col("ts").alias("created_at"))
    return _run(spark, A.queue_stream(rows, "400 days"), "append").select("page_id")
