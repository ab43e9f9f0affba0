"""Data sets, splits, model versions, sessions: bookkeeping of training and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T


def dataset(pages: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples (author_id, page_id, line_id, order_index, text) of confirmed pages, and invalid lines.

    Blank lines are left out; a line of a confirmed page that was never corrected and has
    no prediction is invalid.
    """
    rows = pages.where("status = 'CONFIRMED'").select("author_id", "page_id").join(lines, "page_id")
    valid = T.has_valid_transcription(F.col("corrected"), F.col("predicted"))
    text = T.effective_text(F.col("corrected"), F.col("predicted"))
    good = rows.where(valid).select("author_id", "page_id", "line_id", "order_index", text.alias("text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return good, rows.where(~valid).select("author_id", "page_id", "line_id")


def readiness(samples: DataFrame, min_lines: int = 0, min_words: int = 0) -> DataFrame:
    """Whether an author has enough samples; none at all never is."""
    out = samples.groupBy("author_id").agg(F.count("*").alias("lines"), F.sum(F.size(T.space_tokens(F.col("text")))).alias("words"))
    return out.withColumn("ready", (F.col("lines") >= max(1, min_lines)) & (F.col("words") >= min_words))


def split(samples: DataFrame, share: float = 0.1, seed: int = 42, key: str = "line_id") -> DataFrame:
    """Adds part (train or validation) by a seeded order: share of an author's samples, at least one, at most all but one."""
    w = Window.partitionBy("author_id")
    place = F.row_number().over(w.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    n = F.count("*").over(w)
    held = F.least(F.greatest(F.floor(n * share), F.lit(1 if share > 0 else 0)), n - 1)
    return samples.withColumn("part", F.when(place <= held, "validation").otherwise("train"))


def freeze_steps(lines: int, batch: int) -> int:
    """Steps in which the backbone stays frozen: one pass."""
    return -(-lines // max(1, batch))


def next_version(versions: DataFrame) -> DataFrame:
    """The next version number of each author."""
    return versions.groupBy("author_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def activate(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Versions after one of each author in ``chosen`` (author_id, version) became active; the former one is ready again."""
    c = chosen.select("author_id", F.col("version").alias("_v"))
    rows = versions.join(c, "author_id", "left")
    status = F.when(F.col("_v") == F.col("version"), "ACTIVE").when(F.col("_v").isNotNull() & (F.col("status") == "ACTIVE"), "READY").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("_v")


def active_conflicts(versions: DataFrame) -> DataFrame:
    """Authors with more than one active version."""
    return versions.groupBy("author_id").agg(F.count_if(F.col("status") == "ACTIVE").alias("n_active")).where("n_active > 1")


def stale_training(versions: DataFrame, now: str, hours: int) -> DataFrame:
    """Versions whose training began too long ago and counts as failed."""
    old = (F.col("status") == "TRAINING") & (F.col("started_at") < F.to_timestamp(F.lit(now)) - F.make_interval(hours=F.lit(hours)))
    return versions.withColumn("status", F.when(old, "FAILED").otherwise(F.col("status")))


def run_outcome(runs: DataFrame) -> DataFrame:
    """Outcome of training runs: failed, rejected (not better than the baseline) or activated."""
    better = F.coalesce(F.col("candidate_cer") < F.col("baseline_cer"), F.lit(False))
    return runs.withColumn("outcome", F.when(F.col("error").isNotNull(), "failed").when(better, "activated").otherwise("rejected"))


def token_reuse(uses: DataFrame) -> DataFrame:
    """Use of refresh tokens after they were rotated or revoked: the whole family is revoked from then on.

    ``uses``: family_id, token_id, used_at, rotated_at, revoked_at.
    """
    late = (F.col("used_at") > F.col("rotated_at")) | (F.col("used_at") >= F.col("revoked_at"))
    first = F.min(F.when(late, F.col("used_at"))).over(Window.partitionBy("family_id"))
    return uses.withColumn("reused", F.coalesce(late, F.lit(False))).withColumn("family_revoked_at", first)


# States of a page and what may follow.
PAGE_MOVES = {"recognize": ("UPLOADED RECOGNIZED EDITING", "RECOGNIZED"), "edit": ("RECOGNIZED EDITING", "EDITING"), "confirm": ("RECOGNIZED EDITING", "CONFIRMED"), "reopen": ("CONFIRMED", "EDITING")}


def move_pages(pages: DataFrame, actions: DataFrame) -> DataFrame:
    """Pages after one action each (page_id, action); one that its state forbids changes nothing and is refused."""
    rows = pages.join(actions, "page_id", "left")
    state, allowed = F.col("status"), F.lit(False)
    for name, (before, after) in PAGE_MOVES.items():
        ok = (F.col("action") == name) & F.col("status").isin(before.split())
        state, allowed = F.when(ok, after).otherwise(state), allowed | F.coalesce(ok, F.lit(False))
    return rows.withColumn("refused", F.col("action").isNotNull() & ~allowed).withColumn("status", state)


def replace_recognition(lines: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of pages that were recognized again are the new ones; metrics of the old are gone with them."""
    again = new.select("page_id").distinct()
    return lines.join(again, "page_id", "left_anti").unionByName(new, allowMissingColumns=True)


def claim(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked sources that nobody runs: each becomes running once, for its text's hash."""
    free = sources.where("status <> 'running'").join(asked.select("source_id").distinct(), "source_id")
    return free.select("source_id", "text_hash", F.lit("running").alias("status"))
