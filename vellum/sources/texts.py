"""Readers and writers of the archive's text files and artifacts.

All paths go through Spark's readers, so any file system and compressed files work.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

#: Marks of the licence text around books of a public library.
BOOK_START, BOOK_END = "*** START OF THE PROJECT GUTENBERG EBOOK", "*** END OF THE PROJECT GUTENBERG EBOOK"


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files as rows (path, text), one a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def word_forms(spark: SparkSession, path: str | list[str], encoding: str = "auto", least: int = 2) -> DataFrame:
    """Distinct dictionary forms (word) of word lists.

    UTF-8 or, where a plain file is not that, cp1251; gzip or bzip2 in UTF-8; lines may carry
    flags after a slash or columns after a tab, and comments after a number sign. Words need a letter,
    no digit, and ``least`` characters.
    """
    if not _compressed(path):
        content = F.col("content")
        text = F.when(F.is_valid_utf8(content.cast("string")), F.decode("content", "UTF-8")).otherwise(cyrillic(content))
        if encoding != "auto":
            text = cyrillic(content) if encoding in ("cp1251", "windows-1251") else F.decode("content", encoding)
        lines = spark.read.format("binaryFile").load(path).select(F.explode(F.split(text, r"\R")).alias("line"))
    else:  # compressed files are unpacked by the reader
        lines = spark.read.text(path).select(F.col("value").alias("line"))
    return _forms(lines, least)


def cyrillic(content: Column) -> Column:
    """Text of bytes in cp1251: read byte by byte, then the upper half is mapped."""
    upper = bytes(range(128, 256))
    return F.translate(F.decode(content, "ISO-8859-1"), upper.decode("latin-1"), upper.decode("cp1251", errors="replace"))


def _compressed(path: str | list[str]) -> bool:
    return any(p.endswith((".gz", ".bz2")) for p in ([path] if isinstance(path, str) else path))


def _forms(lines: DataFrame, least: int) -> DataFrame:
    line = F.trim("line")
    head = F.substring_index(F.substring_index(line, "\t", 1), "/", 1)
    words = lines.where((line != "") & ~F.startswith(line, F.lit("#"))).select(F.explode(T.space_tokens(head)).alias("w")).select(T.normalize_word(F.col("w")).alias("word"))
    return words.where((F.length("word") >= least) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"\p{N}")).distinct()


def book_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Books (path, text) without the library's header and footer."""
    rows = whole_files(spark, path)
    start = F.instr("text", F.lit(BOOK_START))
    after = F.expr(f"locate('\\n', text, instr(text, '{BOOK_START}'))")
    body = F.when(start > 0, F.substring(F.col("text"), after + 1, F.length("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", body)
    end = F.instr("text", F.lit(BOOK_END))
    return rows.withColumn("text", F.when(end > 0, F.substring(F.col("text"), F.lit(1), end - 1)).otherwise(F.col("text")))


def budgeted(texts: DataFrame, budget: int, order: str = "path") -> DataFrame:
    """Texts in order until a budget of characters is crossed; the one that crosses it is kept.

    The running sum needs only names and lengths in one place.
    """
    sizes = texts.select(F.col(order).alias("_o"), F.length("text").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sizes.withColumn("_b", before).where(F.col("_b") < budget).select("_o")
    return texts.join(kept, F.col(order) == F.col("_o"), "left_semi")


def sentences(spark: SparkSession, path: str | list[str], budget: int | None = None) -> DataFrame:
    """Sentences (n, sentence) of plain files or files of numbered lines, up to a budget of characters."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.trim(F.substring_index("value", "\t", -1)).alias("sentence")).where("sentence <> ''")
    if budget is None:
        return rows
    before = F.coalesce(F.sum(F.length("sentence")).over(Window.partitionBy(F.lit(0)).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_b", before).where(F.col("_b") < budget).drop("_b")


def author_lines(lines: DataFrame, author_id: object, exclude: DataFrame | None = None) -> DataFrame:
    """An author's confirmed lines in order, without excluded pages."""
    rows = lines.where((F.col("author_id") == F.lit(author_id)) & (F.col("status") == "CONFIRMED"))
    return rows if exclude is None else rows.join(exclude.select("page_id"), "page_id", "left_anti")


def evaluation_pages(lines: DataFrame, statuses: Sequence[str], corrected_only: bool = True) -> DataFrame:
    """Lines of pages in some states with the text that counts as true; without one a line is left out."""
    truth = F.col("corrected") if corrected_only else T.effective_text_falsy(F.col("corrected"), F.col("predicted"))
    return lines.where(F.col("status").isin(list(statuses))).withColumn("reference", truth).where("reference IS NOT NULL AND trim(reference) <> ''")


def uploads(current: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New files (author_id, raw_path) that no page has yet, and duplicates; a file counts once."""
    named = new.select("author_id", "raw_path", T.path_name(F.col("raw_path")).alias("file_name"), T.path_folder(F.col("raw_path")).alias("path")).withColumn("_key", T.upload_key(F.col("file_name"), F.col("path")))
    have = current.select("author_id", T.upload_key(F.col("file_name"), F.col("path")).alias("_key")).distinct()
    fresh = named.join(have, ["author_id", "_key"], "left_anti").groupBy("author_id", "_key").agg(F.min_by(F.struct("raw_path", "file_name", "path"), "raw_path").alias("f")).select("author_id", "f.*")
    return fresh, named.join(have, ["author_id", "_key"], "left_semi").drop("_key")


def pdf_pages(files: DataFrame, current: DataFrame) -> DataFrame:
    """Pages (file_id, page_no from 1) of files with n_pages; a file with any known page is refused as a whole."""
    pages = files.select("file_id", "file_name", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page_no")).withColumn("page_key", F.concat_ws("#", F.lower("file_name"), F.col("page_no").cast("string")))
    refused = pages.join(current.select("page_key").distinct(), "page_key", "left_semi").select("file_id").distinct()
    return pages.join(refused, "file_id", "left_anti")


RECOGNITION = "page_id bigint, lines array<struct<order_index:int,text:string,words:array<struct<text:string,confidence:double>>>>"


def recognition_results(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines and words of recognition results in JSON, one page a line; lines without text are kept."""
    rows = spark.read.schema(RECOGNITION).json(path).select("page_id", F.explode("lines").alias("l"))
    lines = rows.select("page_id", "l.order_index", F.col("l.text").alias("predicted"))
    words = rows.select("page_id", "l.order_index", F.posexplode("l.words").alias("position", "w")).select("page_id", "order_index", "position", "w.text", "w.confidence")
    return lines, words


def save_model(table: DataFrame, path: str, **meta: object) -> None:
    """Writes a language model's table and what it was built from."""
    table.write.mode("overwrite").partitionBy("n").parquet(f"{path}/table")
    table.sparkSession.createDataFrame([(1, json.dumps(meta, sort_keys=True, ensure_ascii=False))], "version int, meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A stored language model and its description; another format version is an error."""
    row = spark.read.parquet(f"{path}/meta").first()
    if row.version != 1:
        raise ValueError(f"unsupported model format {row.version}")
    return spark.read.parquet(f"{path}/table"), json.loads(row.meta)


def save_words(words: DataFrame, path: str) -> None:
    """Writes a word list, sorted, so that readers can skip."""
    words.select("word").distinct().repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def load_words(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored word list; None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("word string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def append_events(events: DataFrame, path: str) -> None:
    """Appends to the log of decisions on suggestions, a folder for each day."""
    events.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def save_sources(sources: DataFrame, path: str) -> None:
    """Writes sources by user, so that a user's are found without reading the others'."""
    sources.repartition("user_id").sortWithinPartitions("user_id", "source_type", "ref_id").write.mode("overwrite").partitionBy("source_type").parquet(path)


def diary_sources(pages: DataFrame) -> DataFrame:
    """Diary pages as sources (user_id, source_type, ref_id, title, text)."""
    return pages.select("user_id", F.lit("diary").alias("source_type"), F.col("id").alias("ref_id"), "title", F.coalesce("content", F.lit("")).alias("text"))


def manuscript_sources(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Confirmed manuscript pages as sources, their lines joined in order, with the line map.

    The text of a line is its correction unless that is empty, else the prediction.
    """
    text = T.effective_text_falsy(F.col("corrected"), F.col("predicted"))
    listed = lines.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "line_id", text.alias("text")))), lambda x: F.struct(x["line_id"].alias("line_id"), x["text"].alias("text"))).alias("lines"))
    rows = pages.where("status = 'CONFIRMED'").join(listed, "page_id").withColumn("_a", T.assemble(F.col("lines")))
    title = F.when(F.trim(F.coalesce("file_name", F.lit(""))) != "", F.trim("file_name")).otherwise(F.concat(F.lit("Стр. #"), F.col("page_id").cast("string")))
    return rows.select("user_id", F.lit("manuscript").alias("source_type"), F.col("page_id").alias("ref_id"), title.alias("title"), F.col("_a.text").alias("text"), F.to_json("_a.line_map").alias("line_map"))


# --- model answers in JSON ------------------------------------------------------------

#: Fields of what a model extracts, by kind.
ANSWERS = {
    "entities": "name string, entity_type string, description string, aliases array<string>",
    "mentions": "entity_name string, mention_text string, sentence_text string, confidence string",
    "facts": "subject_name string, subject_relation string, predicate string, predicate_kind string, object_name string, object_text string, source_text string, time_text string, time_iso string, importance string, recurrence string, confidence string, goal_title string, goal_status string",
    "relations": "person_name string, relation_kind string, relation_label string, via_marriage boolean, generations int, source_text string, confidence string",
    "matches": "candidate_index int, matched_id bigint",
}


def parse_answers(answers: DataFrame, kind: str, json_col: str = "json") -> DataFrame:
    """Rows of one kind from answers (source_id, kind, json): noise around the object is cut, what is no object is dropped."""
    fields = ", ".join(f.replace(" ", ":", 1) for f in ANSWERS[kind].split(", "))
    body = F.from_json(T.first_json_object(F.col(json_col)), f"struct<{kind}:array<struct<{fields}>>>")
    rows = answers.where(F.col("kind") == kind).select("source_id", F.posexplode(body[kind]).alias("item", "r"))
    return rows.where("r IS NOT NULL").select("source_id", "item", "r.*")


def strict_schema(schema: dict) -> dict:
    """A JSON schema in which every object names all its properties as required and allows no others."""
    out = {k: strict_schema(v) if isinstance(v, dict) else [strict_schema(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in schema.items()}
    if isinstance(out.get("properties"), dict):
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out
