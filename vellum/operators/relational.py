"""Relational building blocks of the archive: pages, lists, upserts, joins, counts, orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

# --- scans and lists ------------------------------------------------------------------


def owned(rows: DataFrame, user_id: object, column: str = "user_id") -> DataFrame:
    """Rows of one user; the filter reaches the scan."""
    return rows.where(F.col(column) == F.lit(user_id))


def lookup(rows: DataFrame, key: dict[str, object]) -> DataFrame:
    """The row of a key, for its owner."""
    for c, v in key.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows.limit(1)


def exists(rows: DataFrame, condition: Column) -> bool:
    """Whether any row fits; stops at the first."""
    return not rows.where(condition).limit(1).isEmpty()


def newest_first(rows: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """One screen of a list, newest first."""
    return rows.orderBy(F.col(order).desc_nulls_last()).offset(offset).limit(limit)


def last_turns(rows: DataFrame, keys: Sequence[str], order: str, limit: int) -> DataFrame:
    """The last ``limit`` rows of each key; position numbers them in their own order."""
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    kept = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= limit)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_back").desc()))).drop("_back")


def pending(rows: DataFrame, status: str, *order: str) -> DataFrame:
    """Work that waits, with its place in the queue."""
    return rows.where(F.col("status") == status).orderBy(*[F.col(c).asc_nulls_first() for c in order])


# --- upserts --------------------------------------------------------------------------


def upsert_sources(current: DataFrame, new: DataFrame) -> DataFrame:
    """Sources after new texts came in; only a changed text resets the extraction.

    Both have user_id, source_type, ref_id and text; ``current`` also text_hash and status.
    Returns all sources with text, text_hash, status and action (created, changed,
    unchanged, kept for those that nothing came in for).
    """
    key = ["user_id", "source_type", "ref_id"]
    a = current.select(*key, F.col("text").alias("_old"), F.col("text_hash").alias("_hash"), F.col("status").alias("_status"))
    b = new.select(*key, F.coalesce("text", F.lit("")).alias("_new"), T.text_hash(F.col("text")).alias("_new_hash"))
    action = F.when(F.col("_new_hash").isNull(), "kept").when(F.col("_hash").isNull(), "created").when(F.col("_hash") != F.col("_new_hash"), "changed").otherwise("unchanged")
    both = a.join(b, key, "full_outer").withColumn("action", action)
    fresh = F.col("action").isin("created", "changed")
    return both.select(*key, F.when(fresh, F.col("_new")).otherwise(F.col("_old")).alias("text"), F.when(fresh, F.col("_new_hash")).otherwise(F.col("_hash")).alias("text_hash"), F.when(fresh, "pending").otherwise(F.col("_status")).alias("status"), "action")


def backfill_counts(upserted: DataFrame) -> DataFrame:
    """How many sources were created, changed and left."""
    return upserted.where("action <> 'kept'").groupBy("action").agg(F.count("*").alias("n"))


def upsert_latest(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key, the new one where there is one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(order).desc_nulls_last())
    return both.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r", "_new")


def ensure_folders(folders: DataFrame, wanted: DataFrame, next_id: Column) -> DataFrame:
    """Ids of wanted folders (user_id, parent_id, name): those that exist by name without case, else new ones.

    New ids follow ``next_id`` in order of user, parent and name.
    """
    have = folders.groupBy("user_id", "parent_id", F.lower(T.folder_name(F.col("name"))).alias("_key")).agg(F.min("id").alias("_id"))
    ask = wanted.select("user_id", "parent_id", T.folder_name(F.col("name")).alias("name")).withColumn("_key", F.lower("name")).groupBy("user_id", "parent_id", "_key").agg(F.min("name").alias("name"))
    same = ask["user_id"].eqNullSafe(have["user_id"]) & ask["parent_id"].eqNullSafe(have["parent_id"]) & (ask["_key"] == have["_key"])
    found = ask.join(have, same, "left").select(ask["user_id"], ask["parent_id"], ask["name"], "_id")
    number = F.row_number().over(Window.partitionBy(F.col("_id").isNull()).orderBy("user_id", F.col("parent_id").asc_nulls_first(), "name"))
    return found.select("user_id", "parent_id", "name", F.coalesce("_id", next_id + number - 1).alias("id"), F.col("_id").isNull().alias("created"))


def rebuild_plan(manuscripts: DataFrame, diaries: DataFrame) -> DataFrame:
    """A10: sources in the order of a rebuild: manuscripts by author and place, then diaries by date.

    Both have source_id and status; manuscripts author_id and order_index, diaries
    created_at. Returns source_id, part, position and whether it runs (done ones are skipped).
    """
    run = (F.col("status") != "done").alias("run")
    a = manuscripts.select("source_id", F.lit("manuscript").alias("part"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("author_id", F.col("order_index").asc_nulls_last(), "source_id")).alias("position"), run)
    b = diaries.select("source_id", F.lit("diary").alias("part"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("created_at").asc_nulls_last(), "source_id")).alias("position"), run)
    return a.unionByName(b)


def clear_graph(tables: dict[str, DataFrame], user_id: object) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without one user's rows, and how many went from each."""
    left = {n: t.where(~F.col("user_id").eqNullSafe(F.lit(user_id))) for n, t in tables.items()}
    counts = None
    for n, t in tables.items():
        c = t.where(F.col("user_id") == F.lit(user_id)).agg(F.count("*").alias("removed")).select(F.lit(n).alias("table_name"), "removed")
        counts = c if counts is None else counts.unionByName(c)
    return left, counts


# --- joins ----------------------------------------------------------------------------


def relatives(edges: DataFrame, people: DataFrame, most: int = 50) -> DataFrame:
    """People that an author has edges to, the first ``most`` by edge id."""
    rows = edges.join(people.select(F.col("id").alias("to_id"), "name"), "to_id")
    rank = Window.partitionBy("from_id").orderBy("id")
    return rows.withColumn("position", F.row_number().over(rank)).where(F.col("position") <= most)


def self_first(people: DataFrame, self_id: Column, last_seen: str = "last_seen_at") -> DataFrame:
    """Objects of a list, oneself first, then the last seen, nulls last, then by id."""
    return people.dropDuplicates(["id"]).orderBy(F.when(F.col("id") == self_id, 0).otherwise(1), F.col(last_seen).desc_nulls_last(), "id")


def page_union(diaries: DataFrame, manuscripts: DataFrame) -> DataFrame:
    """Pages of an object: diaries and manuscripts in one list."""
    return diaries.select("id", "title", "created_at", F.lit("diary").alias("kind")).unionByName(manuscripts.select("id", "title", "created_at", F.lit("manuscript").alias("kind")))


def page_summaries(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages with their number of lines, 0 where they have none."""
    counted = lines.groupBy("page_id").agg(F.count("*").alias("n_lines"))
    return pages.join(counted, "page_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def page_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages with their lines in order; a page without lines stays."""
    return pages.join(lines, "page_id", "left").orderBy("page_id", F.col("order_index").asc_nulls_last())


def without(rows: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Rows that no child refers to."""
    return rows.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def orphans(entities: DataFrame, references: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Entities that nothing refers to: all references become one column of ids first."""
    used = None
    for frame, column in references:
        ids = frame.select(F.col(column).alias("id")).where("id IS NOT NULL")
        used = ids if used is None else used.union(ids)
    return entities.join(used.distinct(), "id", "left_anti")


def neighbours(pages: DataFrame) -> DataFrame:
    """The previous and next confirmed page of each page of an author by order, ties skipped."""
    done = pages.where("status = 'CONFIRMED'").groupBy("author_id", "order_index").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_first"))
    marks = pages.select("author_id", "order_index").distinct().join(done, ["author_id", "order_index"], "left")
    w = Window.partitionBy("author_id").orderBy("order_index")
    before = F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return pages.join(marks.select("author_id", "order_index", before.alias("previous_page"), after.alias("next_page")), ["author_id", "order_index"], "left")


def line_context(lines: DataFrame, k: int = 2, text: str = "text") -> DataFrame:
    """Texts of up to ``k`` lines on each side, blank ones left out."""
    w = Window.partitionBy("page_id").orderBy("order_index")
    shown = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.col(text))
    return lines.withColumn("before", F.collect_list(shown).over(w.rowsBetween(-k, -1))).withColumn("after", F.collect_list(shown).over(w.rowsBetween(1, k)))


def hidden_by_fold(pages: DataFrame, chronological: bool = True) -> DataFrame:
    """For each page how many pages of its author a model for it may have read: earlier ones, or all others."""
    if chronological:
        w = Window.partitionBy("author_id").orderBy("page_id").rangeBetween(Window.unboundedPreceding, -1)
        return pages.withColumn("readable", F.count("*").over(w))
    return pages.withColumn("readable", F.count("*").over(Window.partitionBy("author_id")) - 1)


def redirect_children(children: DataFrame, sources: DataFrame, ref: str = "page_id", source_type: str = "manuscript") -> DataFrame:
    """Children that referred to a page refer to its source."""
    map_ = sources.where(F.col("source_type") == source_type).select(F.col("ref_id").alias(ref), F.col("id").alias("_s"))
    return children.join(map_, ref, "left").withColumn("source_id", F.coalesce("_s", "source_id")).drop("_s")


def backfill_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every fact with a source has a confirmation by it."""
    own = facts.where("source_id IS NOT NULL").select(F.col("id").alias("fact_id"), "source_id", F.col("source_text").alias("quote"), "confidence")
    return evidence.unionByName(own.join(evidence, ["fact_id", "source_id"], "left_anti").select(evidence.columns))


def absorb_events(facts: DataFrame, events: DataFrame, default_importance: float = 0.5) -> DataFrame:
    """Facts with events added: a missing importance is ``default_importance``, a missing quote the title."""
    rows = events.select("user_id", F.col("entity_id").alias("subject_entity_id"), F.col("title").alias("predicate"), F.coalesce("importance", F.lit(default_importance)).alias("importance"), F.coalesce(F.nullif("quote", F.lit("")), "title").alias("source_text"))
    return facts.unionByName(rows, allowMissingColumns=True)


def self_entity(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """For each user the first existing entity among candidate names (user_id, name, priority)."""
    known = entities.select("user_id", F.col("normalized_name").alias("_n"), F.col("id").alias("_id"))
    rows = candidates.withColumn("_n", T.normalize(F.col("name"))).join(known, ["user_id", "_n"], "left")
    return rows.groupBy("user_id").agg(F.min_by("_id", F.when(F.col("_id").isNotNull(), F.struct("priority", "_id"))).alias("entity_id"))


def audit_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows without a source in each child table."""
    out = None
    for n, t in tables.items():
        c = t.agg(F.count_if(F.col("source_id").isNull()).alias("orphans")).select(F.lit(n).alias("table_name"), "orphans")
        out = c if out is None else out.unionByName(c)
    return out


def interval_overlaps(left: DataFrame, right: DataFrame, key: str, bucket: int = 1024) -> DataFrame:
    """Pairs of left and right rows (l_id, r_id) of a key whose spans overlap; spans with a null end none.

    Both have id, the key, start and end. Spans are dealt to buckets of offsets, so that a
    key with very many spans is not one task; a pair is taken from its first common bucket.
    """

    def dealt(rows: DataFrame, p: str) -> DataFrame:
        good = rows.where("start IS NOT NULL AND `end` IS NOT NULL AND start < `end`")
        spread = F.explode(F.sequence(F.floor(F.col("start") / bucket).cast("long"), F.floor((F.col("end") - 1) / bucket).cast("long")))
        return good.select(F.col("id").alias(f"{p}_id"), F.col(key), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), spread.alias("_bucket"))

    rows = dealt(left, "l").join(dealt(right, "r"), [key, "_bucket"]).where("l_start < r_end AND r_start < l_end")
    return rows.where(F.col("_bucket") == F.floor(F.greatest("l_start", "r_start") / bucket)).select(key, "l_id", "r_id")


def containing_texts(names: DataFrame, texts: DataFrame, least: int = 3) -> DataFrame:
    """C11: pairs (name_id, text_id) where a text holds a name without regard to case.

    Names are found by their first word: texts are split to word pieces that the names'
    first words can begin in, so that only likely pairs are compared; names with fewer
    than ``least`` characters are left out.
    """
    n = names.select(F.col("id").alias("name_id"), F.lower(F.trim(F.regexp_replace("name", r"(?U)\s+", " "))).alias("_name")).where(F.length("_name") >= least).withColumn("_gram", F.substring("_name", 1, least))
    body = F.lower("text")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(body) - least + 1, F.lit(1))), lambda i: F.substring(body, i, F.lit(least))))
    t = texts.select(F.col("id").alias("text_id"), body.alias("_text"), F.explode(grams).alias("_gram"))
    return t.join(n, "_gram").where(F.contains("_text", F.col("_name"))).select("name_id", "text_id").distinct()


# --- orders and numbers ---------------------------------------------------------------


def next_ordinal(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The number that the next row of each key gets."""
    return rows.groupBy(*keys).agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_ordinal"))


def in_degrees(people: DataFrame, edges: DataFrame) -> DataFrame:
    """People with how many edges point at them, 0 included."""
    counted = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n_edges"))
    return people.join(counted, "id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def ordinals(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Gapless numbers from 0 within each key."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def reorder(rows: DataFrame, given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Given ids (id, rank) first, the rest as before, renumbered from 0."""
    ranked = rows.join(given.select("id", F.col("rank").alias("_rank")), "id", "left")
    order = Window.partitionBy(*keys).orderBy(F.col("_rank").asc_nulls_last(), F.col("order_index").asc_nulls_last(), "id")
    return ranked.withColumn("order_index", F.row_number().over(order) - 1).drop("_rank")


def line_offsets(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """Where each line starts and ends in its page's text."""
    before = Window.partitionBy(key).orderBy("order_index").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit("")))
    start = F.coalesce(F.sum(size + 1).over(before), F.lit(0))
    return lines.withColumn("start", start).withColumn("end", start + size)


def latest_run(runs: DataFrame, key: str = "source_id") -> DataFrame:
    """The last run of each source, with its counters read from the stored text."""
    rank = Window.partitionBy(key).orderBy(F.col("started_at").desc_nulls_last(), F.col("id").desc())
    last = runs.withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")
    return last.withColumn("counters", F.coalesce(F.from_json("stats", "map<string,double>"), F.create_map().cast("map<string,double>")))


def content_hash(rows: DataFrame, keys: Sequence[str], order: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """SHA-256 over a key's rows in order, fields joined by bars, rows by line feeds."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(*keys).agg(F.sha2(listed, 256).alias("content_hash"), F.count("*").alias("n_rows"))


def running_budget(files: DataFrame, budget: int, order: str = "path", size: str = "size") -> DataFrame:
    """Files in order as long as what came before is within the budget; the one that crosses it is the last."""
    before = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("_before") < budget).drop("_before")


# --- reports --------------------------------------------------------------------------


def open_conflicts(conflicts: DataFrame, facts: DataFrame, people: DataFrame, most: int = 200) -> DataFrame:
    """Conflicts without a resolution, the newest ``most``, with their fact and subject where these are known."""
    rows = conflicts.where("resolved_at IS NULL").orderBy(F.col("id").desc()).limit(most)
    rows = rows.join(facts.select(F.col("id").alias("existing_fact_id"), F.col("predicate")), "existing_fact_id", "left")
    return rows.join(people.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id", "left")


def stale_versions(stored: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored results with whether a newer version exists; without a current version they are not stale."""
    now = current.select(*keys, F.col("version").alias("_now"))
    return stored.join(now, list(keys), "left").withColumn("stale", F.coalesce(F.col("version") != F.col("_now"), F.lit(False))).drop("_now")


def evidence_report(edges: DataFrame, confirmations: DataFrame, sources: DataFrame, people: DataFrame) -> DataFrame:
    """C20: relations with the names of their ends and the sources that say so; one without a confirmation stays."""
    names = people.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    rows = edges.join(names.withColumnsRenamed({"_id": "from_id", "_name": "from_name"}), "from_id").join(names.withColumnsRenamed({"_id": "to_id", "_name": "to_name"}), "to_id")
    said = confirmations.join(sources.select(F.col("id").alias("source_id"), "title"), "source_id").select("relation_id", "source_id", "title", "confidence")
    return rows.join(said, F.col("id") == F.col("relation_id"), "left").select("id", "from_name", "relation_kind", "to_name", "source_id", "title", "confidence")


def affected_relations(confirmations: DataFrame, sources: DataFrame) -> DataFrame:
    """Relations that any of the sources confirms."""
    return confirmations.join(sources.select("source_id").distinct(), "source_id", "left_semi").select("relation_id").distinct()


def run_counters(items: DataFrame, kind: str = "kind") -> DataFrame:
    """How many items of each kind a run has."""
    return items.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def decision_log(events: DataFrame) -> DataFrame:
    """Decisions on suggestions by action and dictionary verdict."""
    return events.groupBy("action", "in_lexicon").agg(F.count("*").alias("n"))


def line_seams(lines: DataFrame) -> DataFrame:
    """The last word of each line beside the first word of the next one with words on its page."""
    words = T.space_tokens(F.col("text"))
    rows = lines.withColumn("_w", words).where(F.size("_w") > 0)
    head = F.lead(F.get("_w", F.lit(0))).over(Window.partitionBy("page_id").orderBy("order_index"))
    return rows.select("page_id", "order_index", F.element_at("_w", -1).alias("tail"), head.alias("head")).where("head IS NOT NULL")
