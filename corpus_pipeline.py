"""A corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as
the next one's docs. All but the last return the columns that they were given. Null ids,
texts and sources, empty texts, repeated rows and further columns pass; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import mixing, packing, quality, secrets, simhash
from vellum.llm.common import WORD, row_key, stored
from vellum.llm.queries import KEEP_FROM, MIX, TOKENIZER, grades

#: SQL cannot express the classifier, the fingerprints or the tokens; tests hold every stage against brute force.
ORACLE_SQL = None


def _row(docs: DataFrame) -> Column:
    """All cells of a row as a struct of numbered fields, out of reach of the stages' own names."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])


def _cell(docs: DataFrame, name: str) -> Column:
    return F.col(f"row.c{docs.columns.index(name)}")


def _with(frame: DataFrame, docs: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` from the frame's ``row``, those in ``changed`` replaced and of their old types."""
    return frame.select(*[(changed[c].cast(docs.schema[c].dataType) if c in changed else _cell(docs, c)).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose probability of an acceptable grade is low."""
    model = quality.train(docs, grades(spark, sf_dir), grades=3, most=4000)
    graded = quality.grade(docs.select(_row(docs).alias("row"), "text"), model)
    return _with(graded.where(F.col("tails")[0] >= KEEP_FROM), docs, {})


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of texts of similar shingles the document of the smallest id, once."""
    return simhash.deduplicate(docs, width=5, similarity=0.8)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; texts without any stay as they are."""
    rows = docs.select(_row(docs).alias("row"), F.col("text"))
    found = secrets.report(rows, secrets.update(rows), id_col="row")
    clean = secrets.redact(_cell(docs, "text"), F.col("findings"))
    size = F.when(F.size("findings") > 0, F.length(clean)).otherwise(_cell(docs, "n_chars"))
    return _with(found, docs, {"text": clean, "n_chars": size})


#: Takes of one repeated row that one task joins with it.
CROWD = 10_000


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and drops documents so that sources reach their targets.

    A document comes whole as often as its whole copies say; of a further copy that is
    taken in part, a row holds each run of its words, joined by spaces.
    """
    rows = docs.select(row_key(docs).alias("key"), _row(docs).alias("row"))
    takes = mixing.mix(docs.select("doc_id", "text", "source", row_key(docs).alias("key")), carry=["key"], **MIX)
    runs = F.arrays_zip("from", "span")
    whole = F.size(F.filter("span", lambda n: n == F.col("size")))
    part = F.filter(runs, lambda x: x["span"] < F.col("size"))
    takes = takes.select("key", (F.col("copies") + whole).alias("copies"), part.alias("parts")).where("copies > 0 OR size(parts) > 0")
    takes = stored(takes)
    # a row that repeats often is met by its takes in several places
    busy = stored(takes.groupBy("key").count().where(F.col("count") > CROWD).select("key", F.ceil(F.col("count") / CROWD).alias("places")))
    takes = takes.withColumn("n", F.monotonically_increasing_id()).join(busy, "key", "left")
    once = rows.groupBy("key").agg(F.first("row").alias("row"))  # equal rows meet on each task before they are sent
    few = once.join(takes.where("places IS NULL").hint("merge"), "key").select("row", "copies", "parts")
    spread = once.join(busy, "key").withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("places") - 1))).drop("places")
    many = spread.join(takes.where("places IS NOT NULL").withColumn("place", F.col("n") % F.col("places")), ["key", "place"]).select("row", "copies", "parts")
    none = F.struct(F.lit(None).cast("bigint").alias("from"), F.lit(None).cast("bigint").alias("span"))
    pieces = F.concat(F.array_repeat(none, F.col("copies").cast("int")), F.col("parts"))
    out = few.union(many).select("row", F.explode(pieces).alias("piece"))
    cut = F.array_join(F.slice(F.regexp_extract_all(_cell(docs, "text"), F.lit(WORD), F.lit(0)), (F.col("piece.from") + 1).cast("int"), F.col("piece.span").cast("int")), " ")
    out = out.select("row", F.when(F.col("piece.from").isNull(), _cell(docs, "text")).otherwise(cut).alias("text"), F.col("piece.from").isNotNull().alias("cut"))
    size = F.when(F.col("cut"), F.length("text")).otherwise(_cell(docs, "n_chars"))
    return _with(out, docs, {"text": F.col("text"), "n_chars": size})


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix packed into sequences of at most 2048 tokens, with the tokens."""
    return packing.pack(docs, size=2048, end_id=1, **TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
