"""Streams of the archive: sources, decisions on suggestions, confirmations, goals, the work queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vellum.functions import text as T


def source_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of new Parquet files of sources."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def changed_sources(stream: DataFrame, delay: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Sources whose text was not seen within the delay, by source and text hash."""
    rows = stream.withColumn("text_hash", T.text_hash(F.col("text"))).withWatermark(time, delay)
    return rows.dropDuplicatesWithinWatermark(["user_id", "source_type", "ref_id", "text_hash"])


def upsert_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keeps the last row of each key in a folder; every batch writes a new version, so that it can be repeated."""

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        from vellum.operators.relational import upsert_latest

        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        except AnalysisException:
            old = None
        empty = batch.limit(0) if old is None else old
        upsert_latest(empty, batch, keys, order).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Decisions on suggestions by window, action and verdict."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "action", "in_lexicon").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "action", "in_lexicon", "n")


class EdgeState(StatefulProcessor):
    """An edge from its confirmations: the largest confidence, the number of sources, the best kind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sources = handle.getMapState("sources", "source_id bigint", "confidence double, relation_kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for row in frame.itertuples():
                self.sources.updateValue((int(row.source_id),), (float(row.confidence), row.relation_kind))
        held = sorted((-v[0], k[0], v[1]) for k, v in self.sources.iterator())
        yield pd.DataFrame({"user_id": [key[0]], "canon_from": [key[1]], "canon_to": [key[2]], "canon_key": [key[3]], "confidence": [-held[0][0]], "n_sources": [len(held)], "relation_kind": [held[0][2]]})

    def close(self) -> None:
        pass


def edge_states(stream: DataFrame) -> DataFrame:
    """States of canonical edges after each batch of confirmations (user_id, canon_from, canon_to, canon_key, source_id, confidence, relation_kind)."""
    schema = "user_id bigint, canon_from bigint, canon_to bigint, canon_key string, confidence double, n_sources int, relation_kind string"
    return stream.groupBy("user_id", "canon_from", "canon_to", "canon_key").transformWithStateInPandas(EdgeState(), schema, "Update", "None")


def goal_states(stream: DataFrame) -> DataFrame:
    """State of each goal by its last telling mark (goal_id, seq, progress_kind)."""
    kind = F.col("progress_kind")
    state = F.when(kind.isin("completed", "abandoned"), kind).when(kind.isin("started", "progress"), "active")
    return stream.groupBy("goal_id").agg(F.coalesce(F.max_by(state, F.when(state.isNotNull(), F.col("seq"))), F.lit("active")).alias("status"))


def queue_stream(stream: DataFrame, delay: str = "1 hour", time: str = "created_at") -> DataFrame:
    """Work to do: a page that is queued, running or failed is not taken up again within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["page_id"])


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there into a table in memory: for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_into(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and appends its rows to Parquet files, which the driver does not hold."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
