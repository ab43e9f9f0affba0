"""Character and word n-gram models as tables, and their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.arrays import let
from vellum.operators.components import durable

BACKOFF, FLOOR = 0.4, -12.0


def char_ngrams(texts: DataFrame, order: int = 6, *, text: str = "text", weight: str | None = None) -> DataFrame:
    """Counts (n, context, next, count) of character n-grams up to ``order``.

    A text's n-grams do not cross its bounds. ``weight`` multiplies a text's counts (N04),
    so that a favoured corpus need not be repeated.
    """
    size = F.length(F.col(text))
    rows = texts.select(F.col(text).alias("_t"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"), size.alias("_n")).where("_n > 0")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.col("_n"))), lambda n: F.transform(F.sequence(F.lit(1), F.col("_n") - n + 1), lambda i: F.struct(n.alias("n"), F.substring("_t", i, n - 1).alias("context"), F.substring("_t", i + n - 1, F.lit(1)).alias("next")))))
    return rows.select("_w", F.explode(grams).alias("g")).groupBy("g.n", "g.context", "g.next").agg(F.sum("_w").alias("count"))


def word_ngrams(sentences: DataFrame, order: int = 3, *, words: str = "words") -> DataFrame:
    """Counts (n, context, next, count) of word n-grams with marks of begin and end."""
    line = F.concat(F.array(F.lit("<s>")), F.col(words), F.array(F.lit("</s>")))
    rows = sentences.select(line.alias("_t")).withColumn("_n", F.size("_t"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(order), F.col("_n"))), lambda n: F.transform(F.sequence(F.lit(1), F.col("_n") - n + 1), lambda i: F.struct(n.alias("n"), F.array_join(F.slice("_t", i, n - 1), " ").alias("context"), F.element_at("_t", i + n - 1).alias("next")))))
    return rows.select(F.explode(grams).alias("g")).groupBy("g.n", "g.context", "g.next").agg(F.count("*").alias("count"))


def model(counts: DataFrame, min_count: int = 3) -> DataFrame:
    """Rows (n, context, next, logprob): rare n-grams are dropped, unigrams never, then log10 within what is left of a context."""
    kept = counts.where((F.col("n") == 1) | (F.col("count") >= min_count))
    total = F.sum("count").over(Window.partitionBy("n", "context"))
    return kept.select("n", "context", "next", F.log10(F.col("count") / total).alias("logprob"))


def positions(texts: DataFrame, order: int, *, key: str = "id", text: str = "text") -> DataFrame:
    """Characters of texts with their longest context: key, position, context, next."""
    # letters as an array: a substring of a long text would walk to its place each time
    letters = F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0))

    def places(c: Column) -> Column:
        first = lambda i: F.greatest(i - order + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.struct(F.array_join(F.slice(c, first(i), i - first(i)), "").alias("context"), F.get(c, i - 1).alias("next")))

    rows = texts.where(F.length(F.col(text)) > 0).select(key, F.posexplode(let(letters, places)).alias("position", "c"))
    return rows.select(key, "position", "c.context", "c.next")


def logprobs(places: DataFrame, table: DataFrame, order: int, *, key: str = "id", backoff: float = BACKOFF, floor: float = FLOOR) -> DataFrame:
    """log10 probability at each place: the longest known context, each step back times ``backoff``.

    A character that the model has never seen costs ``floor`` and no steps.
    """
    longest = F.length("context")
    tries = F.transform(F.sequence(F.lit(0), longest), lambda s: F.struct(s.alias("steps"), F.substring(F.col("context"), s + 1, longest - s).alias("context")))
    rows = places.select(key, "position", "next", F.explode(tries).alias("t")).select(key, "position", "next", "t.steps", "t.context", (F.length("t.context") + 1).alias("n"))
    scored = rows.join(table, ["n", "context", "next"], "left")
    known = F.col("logprob").isNotNull()
    best = F.min_by(F.col("logprob") + F.col("steps") * F.log10(F.lit(backoff)), F.when(known, F.col("steps")))
    return scored.groupBy(key, "position").agg(F.coalesce(best, F.lit(floor)).alias("logprob"))


#: Rows of a model that the driver and every task may hold.
HELD = 500_000


class _Tries:
    """A model's rows as arrays: what is known of n - 1 letters, by the next letter, leads to what is known of n."""

    def __init__(self, rows: pd.DataFrame, order: int) -> None:
        rows = rows[(rows.n <= order) & rows.next.notna() & rows.logprob.notna()]
        keyed = {c + x: p for c, x, p in zip(rows.context, rows.next, rows.logprob, strict=True)}
        self.letters = np.array(sorted({ord(x) for gram in keyed for x in gram}), np.uint32)
        heads = {gram[:k] for gram in keyed for k in range(1, len(gram) + 1)}
        self.places, self.scores = [], []
        before = {"": 0}
        for n in range(1, order + 1):
            grams = sorted(g for g in heads if len(g) == n)
            code = np.array([before[g[:-1]] * len(self.letters) + np.searchsorted(self.letters, ord(g[-1])) for g in grams], np.int64)
            rank = np.argsort(code)
            self.places.append(code[rank])
            self.scores.append(np.array([keyed.get(grams[k], np.nan) for k in rank]))
            before = {grams[k]: i for i, k in enumerate(rank)}

    def score(self, text: str, backoff: float, floor: float) -> float:
        """Sum over the letters of `logprobs`."""
        if not text:
            return 0.0
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(self.letters):
            return floor * len(codes)
        letter = np.searchsorted(self.letters, codes).clip(max=len(self.letters) - 1)
        letter = np.where(self.letters[letter] == codes, letter, -1)
        size, order = len(letter), len(self.places)
        longest = np.minimum(np.arange(size), order - 1)
        out = np.full(size, np.nan)
        known = np.zeros(size, np.int64)  # the entry of the n - 1 letters that begin at each place, -1 if none
        for n in range(1, min(order, size) + 1):
            known, last = known[: size - n + 1], letter[n - 1 :]
            code = np.where((known >= 0) & (last >= 0), known * len(self.letters) + last, -1)
            places = self.places[n - 1]
            if not len(places):
                break
            spot = np.searchsorted(places, code).clip(max=len(places) - 1)
            known = np.where(places[spot] == code, spot, -1)
            found = np.where(known >= 0, self.scores[n - 1][spot], np.nan) + (longest[n - 1 :] - n + 1) * np.log10(backoff)
            out[n - 1 :] = np.where(np.isnan(found), out[n - 1 :], found)
        return float(np.where(np.isnan(out), floor, out).sum())


def text_logprobs(texts: DataFrame, table: DataFrame, order: int, *, key: str = "id", text: str = "text") -> DataFrame:
    """log10 probability of each text; an empty one has 0.

    A model of at most ``HELD`` rows goes to the texts, which then need no shuffle of their
    letters. Of a larger one a text's equal places are counted before they travel, and each
    distinct place is scored once.
    """
    if (held := table.limit(HELD + 1).toPandas()).shape[0] <= HELD:
        tries, kind = _Tries(held, order), texts.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [tries.score(x.as_py() or "", BACKOFF, FLOOR) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["key", "logprob"])

        summed = texts.select(F.col(key).alias("key"), text).mapInArrow(run, f"key {kind}, logprob double").groupBy("key").agg(F.sum("logprob").alias("logprob"))
        return summed.select(F.col("key").alias(key), "logprob")
    counted = durable(positions(texts, order, key=key, text=text).groupBy(key, F.struct("context", "next").alias("gram")).agg(F.count("*").alias("times")))
    grams = counted.select("gram").distinct().select("gram", F.lit(0).alias("position"), "gram.context", "gram.next")
    scores = logprobs(grams, table, order, key="gram").select("gram", "logprob")
    summed = counted.join(scores, "gram").groupBy(key).agg(F.sum(F.col("times") * F.col("logprob")).alias("logprob"))
    return texts.select(key).distinct().join(summed, key, "left").select(key, F.coalesce("logprob", F.lit(0.0)).alias("logprob"))


def usable(meta: DataFrame, least_chars: int = 1000) -> Column:
    """Whether a model may judge spacing: it knows the space and enough running text."""
    return F.col("knows_space") & (F.col("running_text_chars") >= least_chars)


def corpus_mix(author: DataFrame, prose: DataFrame, forms: DataFrame, times: int = 30) -> DataFrame:
    """Texts of three corpora with weights; the author's count ``times`` over."""
    return author.select("text", F.lit(times).alias("weight")).union(prose.select("text", F.lit(1))).union(forms.select(F.concat("text", F.lit("\n")), F.lit(1)))


# --- second pass ----------------------------------------------------------------------


def interpolate(general: Column, author: Column, general_weight: float, author_weight: float) -> Column:
    """Weighted sum of two models' scores; a missing one counts as 0."""
    return general_weight * F.coalesce(general, F.lit(0.0)) + author_weight * F.coalesce(author, F.lit(0.0))


def unique_hypotheses(candidates: DataFrame) -> DataFrame:
    """Each hypothesis once, the first page's."""
    return candidates.groupBy("text").agg(F.min("page_id").alias("page_id"))


def rescore(candidates: DataFrame, *, weight: float = 0.5, normalize: bool = True, guard: bool = True, min_mean_acoustic: float = -0.30) -> DataFrame:
    """Winner of each line after the second pass.

    ``candidates``: line_id, rank (from 1, best first), text, score, acoustic, lm_score,
    n_words, all_known. The first one stays unless it is unsure, with a low acoustic score
    a character or an unknown word, or ``guard`` is off; then score + weight * lm_score
    (by word if ``normalize``) decides, ties to the better rank.
    """
    blank = F.trim("text") == ""
    lm = F.when(blank, 0.0).otherwise(F.col("lm_score") / (F.greatest("n_words", F.lit(1)) if normalize else F.lit(1)))
    final = F.col("score") + weight * lm
    unsure = F.lit(True) if not guard else (F.col("acoustic") / F.greatest(F.length("text"), F.lit(1)) < min_mean_acoustic) | ~F.coalesce("all_known", F.lit(True))
    first = F.min_by(F.struct("text", unsure.alias("unsure")), "rank")
    best = F.max_by("text", F.struct(final.alias("f"), (-F.col("rank")).alias("r")))
    rows = candidates.groupBy("line_id").agg(first.alias("first"), best.alias("best"), F.max(final).alias("best_score"), F.count("*").alias("n"))
    allowed = F.col("first.unsure") & (F.col("n") > 1)
    text = F.when(allowed, F.col("best")).otherwise(F.col("first.text"))
    return rows.select("line_id", text.alias("text"), F.col("first.text").alias("first_text"), (text != F.col("first.text")).alias("changed"), F.when(allowed, F.col("best_score")).alias("rescored"))
