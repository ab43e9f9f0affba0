"""Vocabularies: verdicts on words, author words, line-break joins, Bloom filters.

Word lists are frames of one column ``word`` in dictionary form. Membership is an exact
semi-join; the Bloom filter is for handing a list to external tools.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T


def tokens(lines: DataFrame, text: str = "text", *, keys: tuple[str, ...] = ("page_id", "line_id")) -> DataFrame:
    """Words of lines with their place: the key columns, position (from 0), word."""
    return lines.select(*keys, F.posexplode(T.words(F.col(text))).alias("position", "word"))


def lettered(word: Column) -> Column:
    """Whether a word holds a letter."""
    return word.rlike(r"\p{L}")


def needs_no_check(word: Column) -> Column:
    """Numbers, abbreviations and single letters are always known."""
    return (F.coalesce(word, F.lit("")) == "") | ~lettered(word) | word.rlike(r"\p{N}") | (F.length(word) == 1)


def verdicts(words: DataFrame, base: DataFrame, *, extra: DataFrame | None = None, author: DataFrame | None = None) -> DataFrame:
    """Verdict (known, author or unknown) on each distinct ``word``.

    A word is known by any of its variants in the base or extra list, by the author's if
    only that list has one. A compound with hyphens is known when all its parts are, and
    the author's when one of them is; else it is looked up as a whole.
    """
    distinct = words.select("word").distinct()
    parts = F.filter(F.split("word", "-"), lambda p: p != "")
    pieces = distinct.select("word", F.when(F.contains("word", F.lit("-")), F.concat(parts, F.array("word"))).otherwise(F.array("word")).alias("p")).select("word", F.posexplode("p").alias("k", "piece"), F.size("p").alias("n"))
    unique = pieces.select("piece").distinct()
    forms = unique.where(~needs_no_check(F.col("piece"))).select("piece", F.explode(T.word_variants(F.col("piece"))).alias("form"))
    strong = base.select("word") if extra is None else base.select("word").union(extra.select("word"))
    strong = strong.distinct().select(F.col("word").alias("form"), F.lit(0).alias("rank"))
    lists = strong if author is None else strong.union(author.select("word").distinct().select(F.col("word").alias("form"), F.lit(1).alias("rank")))
    found = forms.join(lists, "form").groupBy("piece").agg(F.min("rank").alias("rank"))
    ranked = unique.join(found, "piece", "left").select("piece", F.when(needs_no_check(F.col("piece")), 0).otherwise(F.coalesce("rank", F.lit(2))).alias("rank"))
    joined = pieces.join(ranked, "piece")
    compound = (F.col("n") > 1) & (F.col("k") < F.col("n") - 1)
    by_word = joined.groupBy("word").agg(F.max(F.when(compound, F.col("rank"))).alias("parts"), F.max(F.when(~compound, F.col("rank"))).alias("whole"))
    rank = F.when(needs_no_check(F.col("word")), 0).when(F.col("parts") < 2, F.col("parts")).otherwise(F.col("whole"))
    return by_word.select("word", F.when(rank == 0, "known").when(rank == 1, "author").otherwise("unknown").alias("verdict"))


def annotate(lines: DataFrame, words: DataFrame, verdict: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts on word boxes, and unknown words of lines.

    ``lines``: line_id, text, words_stale; ``words``: line_id, position (from 0), text.
    A box takes the verdict of the line's word at its place where their numbers agree and
    the line is not stale, else that of its own words (null where it has none).
    """
    own = lines.select("line_id", "words_stale", T.words(F.col("text")).alias("tokens"))
    listed = own.select("line_id", F.posexplode("tokens").alias("position", "word")).join(verdict, "word")
    unknown = listed.where("verdict = 'unknown'").groupBy("line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "word"))), lambda x: x["word"]).alias("oov_words"))
    by_line = own.select("line_id").join(unknown, "line_id", "left").select("line_id", F.coalesce("oov_words", F.array().cast("array<string>")).alias("oov_words")).withColumn("oov_count", F.size("oov_words"))
    counts = words.groupBy("line_id").agg(F.count("*").alias("_n"))
    boxes = words.join(own, "line_id").join(counts, "line_id")
    aligned = ~F.coalesce("words_stale", F.lit(False)) & (F.size("tokens") == F.col("_n"))
    checked = boxes.select("line_id", "position", F.explode_outer(F.when(aligned, F.array(F.get("tokens", F.col("position")))).otherwise(T.words(F.col("text")))).alias("word")).join(verdict, "word", "left")
    by_box = checked.groupBy("line_id", "position").agg(F.min(F.when(F.col("word").isNotNull(), F.col("verdict") != "unknown")).alias("in_lexicon"), F.coalesce(F.max(F.col("verdict") == "author"), F.lit(False)).alias("author_only"))
    return by_box.withColumn("author_only", F.col("author_only") & F.coalesce("in_lexicon", F.lit(False))), by_line


def oov_counts(words: DataFrame, verdict: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Number and share of unknown words by key."""
    rows = words.join(verdict, "word")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_words"), F.count_if(F.col("verdict") == "unknown").alias("n_unknown"))
    return out.withColumn("oov_rate", F.col("n_unknown") / F.col("n_words"))


def line_breaks(lines: DataFrame, known: DataFrame, *, interior: DataFrame | None = None, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Words broken over line ends, and the halves that are no words.

    ``lines``: page_id, order_index, text; ``known``: dictionary forms; ``interior``:
    words that count as words of their own, the dictionary if not given. A hyphen at the
    end joins by an exact dictionary word; without one neither half may be a word, and one
    confusion at the start or the seam is allowed (fuzzy). Returns joins (page_id,
    order_index, fragment, head, word, hyphenated, fuzzy) and distinct fragments.
    """
    w = Window.partitionBy("page_id").orderBy("order_index")
    lettered_words = F.filter(T.words(F.col("text")), lambda x: x.rlike(r"\p{L}"))
    rows = lines.select("page_id", "order_index", lettered_words.alias("w")).withColumn("raw_tail", F.try_element_at("w", F.lit(-1))).withColumn("raw_head", F.lead(F.get("w", F.lit(0))).over(w))
    rows = rows.where("raw_tail IS NOT NULL AND raw_head IS NOT NULL").select("page_id", "order_index", T.normalize_word(F.col("raw_tail")).alias("tail"), T.normalize_word(F.col("raw_head")).alias("head"), F.col("raw_tail").rlike("[-‐–]$").alias("hyphenated"))
    rows = rows.where((F.length("tail") >= least) & (F.length("head") >= least)).withColumn("stem", F.regexp_replace("tail", "[-‐–]+$", ""))
    words = known.select(F.col("word").alias("form")).distinct()
    inside = words if interior is None else interior.select(F.col("word").alias("form")).distinct()
    ours = inside.select(F.col("form").alias("_w"), F.lit(True).alias("_in"))
    rows = rows.join(ours.select(F.col("_w").alias("tail"), F.col("_in").alias("tail_in")), "tail", "left").join(ours.select(F.col("_w").alias("head"), F.col("_in").alias("head_in")), "head", "left")
    rows = rows.where(F.col("hyphenated") | (F.col("tail_in").isNull() & F.col("head_in").isNull()))  # before variants are made: most ends are words
    exact, whole = F.concat("stem", "head"), F.concat("tail", "head")
    seam = F.length("stem")
    near = T.confusion_variants(exact, F.array(F.lit(0), seam - 1, seam))
    tries = F.when(F.col("hyphenated"), F.array(F.struct(F.lit(0).alias("rank"), exact.alias("form"), exact.alias("word")), F.struct(F.lit(1).alias("rank"), whole.alias("form"), whole.alias("word")))).otherwise(F.transform(near, lambda v: F.struct(F.when(v == exact, 0).otherwise(2).alias("rank"), v.alias("form"), exact.alias("word"))))
    forms = rows.select("page_id", "order_index", F.explode(tries).alias("t")).select("page_id", "order_index", F.col("t.rank").alias("rank"), F.explode(T.word_variants(F.col("t.form"))).alias("form"), F.col("t.word").alias("joined"))
    hits = forms.join(words, "form").groupBy("page_id", "order_index").agg(F.min(F.struct("rank", "joined")).alias("h"))
    broken = rows.join(hits, ["page_id", "order_index"])
    joins = broken.select("page_id", "order_index", F.col("tail").alias("fragment"), "head", F.col("h.joined").alias("word"), "hyphenated", (F.col("h.rank") == 2).alias("fuzzy"))
    tails = broken.where("tail_in IS NULL").select(F.col("tail").alias("word"))
    heads = broken.where("head_in IS NULL").select(F.col("head").alias("word")).join(words.withColumnRenamed("form", "word"), "word", "left_anti")
    return joins, tails.union(heads).distinct()


def author_vocabulary(lines: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The author's dictionary forms, and counts of their words; broken words are joined.

    ``lines``: page_id, order_index, text of confirmed pages.
    """
    listed = lines.select(T.words(F.col("text")).alias("w")).select(F.posexplode("w").alias("position", "raw"), F.size("w").alias("n"))
    interior = listed.where("position > 0 AND position < n - 1").select(T.normalize_word(F.col("raw")).alias("word")).distinct()
    joins, fragments = line_breaks(lines, known, interior=interior)
    good = joins.where("NOT fuzzy")
    forms = listed.where(lettered(F.col("raw"))).select("raw").distinct().select(F.explode(T.word_variants(F.col("raw"))).alias("word")).distinct()
    gone = fragments.select(F.explode(T.word_variants(F.col("word"))).alias("word")).distinct()
    forms = forms.join(gone, "word", "left_anti").union(good.select(F.explode(T.word_variants(F.col("word"))).alias("word"))).distinct()
    counts = listed.where(lettered(F.col("raw"))).select(T.normalize_word(F.col("raw")).alias("word")).where("word <> ''").join(fragments, "word", "left_anti").union(good.select("word").distinct())
    return forms, counts.groupBy("word").agg(F.count("*").alias("n"))


def top_words(words: DataFrame, most: int = 20_000) -> DataFrame:
    """The most frequent words, ties by word."""
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(most)


def common_words(words: DataFrame, most: int, order: str = "position") -> DataFrame:
    """The most frequent words, ties by first occurrence."""
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min(order).alias("first_position")).orderBy(F.col("n").desc(), "first_position", "word").limit(most)


def occurrences(words: DataFrame, verdict: DataFrame, each: int = 8, most: int = 30_000) -> DataFrame:
    """Places of words that are not known, up to ``each`` a word, for the first ``most`` words.

    ``words``: word, page_id, order_index, position.
    """
    rows = words.join(verdict.where("verdict <> 'known'").select("word"), "word")
    place = Window.partitionBy("word").orderBy("page_id", "order_index", "position")
    kept = rows.withColumn("occurrence", F.row_number().over(place)).where(F.col("occurrence") <= each)
    first = rows.groupBy("word").agg(F.min(F.struct("page_id", "order_index", "position")).alias("at")).orderBy("at").limit(most)
    return kept.join(first.select("word"), "word", "left_semi")


def author_terms(counts: DataFrame, verdict: DataFrame, places: DataFrame) -> DataFrame:
    """Words that only the author's pages vouch for, with counts and places."""
    listed = places.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("page_id", "order_index", "position"))).alias("places"))
    return counts.join(verdict.where("verdict = 'author'").select("word"), "word").join(listed, "word", "left")


def dictionary_delta(before: DataFrame, after: DataFrame, page_words: DataFrame) -> DataFrame:
    """Words that confirming a page adds, as far as they stand on it."""
    return after.select("word").distinct().join(before.select("word"), "word", "left_anti").join(page_words.select("word"), "word", "left_semi")


def leave_one_out(words: DataFrame) -> DataFrame:
    """Unknown words of each page, read by the vocabulary of all other pages.

    ``words``: page_id, word. A word is known to a page if another page has it.
    """
    spread = words.select("page_id", "word").distinct().groupBy("word").agg(F.count("*").alias("pages"))
    rows = words.join(spread, "word")
    return rows.groupBy("page_id").agg(F.count("*").alias("n_words"), F.count_if(F.col("pages") == 1).alias("n_unknown")).withColumn("oov_rate", F.col("n_unknown") / F.col("n_words"))


def nearest_rank(values: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """Percentiles by nearest rank."""
    ranked = F.sort_array(F.collect_list(column))
    picks = [F.element_at("v", F.greatest(F.lit(1), F.ceil(F.size("v") * s)).cast("int")).alias(f"p{round(100 * s)}") for s in shares]
    return values.agg(ranked.alias("v")).where("size(v) > 0").select(*picks)


def knowledge_terms(entities: DataFrame, goals: DataFrame, most: int = 200) -> DataFrame:
    """Names of the last seen entities, then goals, each once without regard to case."""
    rank = Window.partitionBy("user_id").orderBy(F.col("last_seen_at").desc_nulls_last(), F.col("id").desc())
    a = entities.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= most).select("user_id", F.col("canonical_name").alias("term"), F.lit(0).alias("_part"), "_r")
    b = goals.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("id").desc()))).where(F.col("_r") <= most).select("user_id", F.col("title").alias("term"), F.lit(1).alias("_part"), "_r")
    rows = a.union(b).withColumn("term", F.trim("term")).where(F.length("term") >= 2)
    return rows.groupBy("user_id", F.lower("term").alias("_k")).agg(F.min_by("term", F.struct("_part", "_r")).alias("term"), F.min(F.struct("_part", "_r")).alias("at")).select("user_id", "term", F.row_number().over(Window.partitionBy("user_id").orderBy("at")).alias("position"))


# --- Bloom filters --------------------------------------------------------------------


def bloom_size(count: int, rate: float) -> tuple[int, int]:
    """Bytes and number of hashes of a filter for ``count`` words at a false-positive ``rate``."""
    bits = max(8, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
    return (bits + 7) // 8, max(1, min(16, round(bits / max(1, count) * math.log(2))))


def _places(words: pd.Series, size: int, hashes: int) -> np.ndarray:
    raw = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in words)
    pair = np.frombuffer(raw, "<u8").reshape(-1, 2)
    first, second = pair[:, 0].astype(object), (pair[:, 1] | np.uint64(1)).astype(object)
    return np.stack([((first + k * second) % (8 * size)).astype(np.int64) for k in range(hashes)], axis=1) if len(words) else np.zeros((0, hashes), np.int64)


def bloom_build(words: DataFrame, size: int, hashes: int) -> DataFrame:
    """One row with the filter's bits (binary) and its number of words; partial filters are joined by or."""

    def partial(frames):
        bits, n = np.zeros(size, np.uint8), 0
        for frame in frames:
            spots = _places(frame["word"], size, hashes).ravel()
            np.bitwise_or.at(bits, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
            n += len(frame)
        yield pd.DataFrame({"bits": [bits.tobytes()], "n": [n]})

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, np.uint8)
        for b in frame["bits"]:
            bits |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"bits": [bits.tobytes()], "n": [int(frame["n"].sum())]})

    parts = words.select("word").where("word IS NOT NULL").distinct().mapInPandas(partial, "bits binary, n bigint")
    return parts.groupBy().applyInPandas(join, "bits binary, n bigint")


def bloom_probe(words: DataFrame, bits: bytes, hashes: int) -> DataFrame:
    """Adds may_contain to rows with ``word``; the filter travels with the task and has its given size."""
    table = np.frombuffer(bits, np.uint8)

    @F.pandas_udf("boolean")
    def probe(column: pd.Series) -> pd.Series:
        known = column.notna()
        out = pd.Series(False, index=column.index)
        spots = _places(column[known], len(table), hashes)
        out[known] = ((table[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(axis=1) if len(spots) else False
        return out

    return words.withColumn("may_contain", probe("word"))
