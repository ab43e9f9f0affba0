"""Relation edges: canonical form, confirmations, diagnostics, merging.

Edges have user_id, id, from_id, to_id, relation_kind, relation_type, generations,
via_marriage, confidence, and source_id (one row for each confirmation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import kin

EDGE = ("user_id", "id", "from_id", "to_id", "relation_kind", "relation_type", "generations", "via_marriage", "confidence", "source_id")


def with_canonical(edges: DataFrame) -> DataFrame:
    """F08 on every edge: canon_from, canon_to, canon_key, up, down, via_marriage, bond, delta.

    The same values as `kin.canonical_fields`, by a join with the small table of kinds.
    """
    dim = F.broadcast(kin.dimension(edges.sparkSession).select(*[F.col(c).alias(f"_{c}") for c in ("kind", "up", "down", "marriage", "bond", "token", "side", "deep")]))
    key = kin.kind_of(F.col("relation_kind"))
    rows = edges.withColumn("_key", key).join(dim, F.col("_key") == F.col("_kind"), "left")
    depth = F.when(F.col("generations").between(*kin.GENERATIONS), F.col("generations"))
    up = F.when(depth.isNotNull() & F.col("_deep").isin("up", "both"), depth).when(depth.isNotNull() & (F.col("_deep") == "down"), 0).otherwise(F.col("_up")).cast("int")
    down = F.when(depth.isNotNull() & F.col("_deep").isin("down", "both"), depth).when(depth.isNotNull() & (F.col("_deep") == "up"), 0).otherwise(F.col("_down")).cast("int")
    given = F.coalesce("via_marriage", F.lit(False))
    rows = rows.withColumn("up", up).withColumn("down", down).withColumn("via_marriage", F.coalesce(F.col("_marriage") | given, given)).withColumn("bond", F.coalesce("_bond", F.lit("blood")))
    senior, same = F.col("_side") == "to_senior", F.col("_side") == "sym"
    first = F.when(senior, F.col("to_id")).when(same, F.least("from_id", "to_id")).otherwise(F.col("from_id"))
    second = F.when(senior, F.col("from_id")).when(same, F.greatest("from_id", "to_id")).otherwise(F.col("to_id"))
    shape = F.concat_ws(":", F.lit("shape"), F.least("up", "down").cast("string"), F.greatest("up", "down").cast("string"), F.col("via_marriage").cast("int").cast("string"), F.col("bond"))
    plain = F.when(F.col("_key").isin("", "other"), F.concat(F.lit("kind:other:"), kin.label_hash(F.col("relation_type")))).otherwise(F.concat(F.lit("kind:"), F.col("_key")))
    token = F.coalesce("_token", F.when(F.col("up").isNotNull(), shape), plain)
    rows = rows.withColumn("canon_from", first).withColumn("canon_to", second).withColumn("canon_key", token).withColumn("delta", F.col("down") - F.col("up"))
    names = ("canon_from", "canon_to", "canon_key", "up", "down", "via_marriage", "bond")
    return rows.select(*[c for c in edges.columns if c not in names], *names, "delta")


def priority(confidence: Column, sources: Column, *ties: Column) -> Column:
    """Order of edges, the best first: confidence, number of sources, then ids; null counts as 0."""
    return F.struct((-F.coalesce(confidence, F.lit(0.0))).alias("a"), (-sources).alias("b"), *[F.coalesce(t, F.lit(0)).alias(f"t{i}") for i, t in enumerate(ties)])


def aggregate_confirmations(rows: DataFrame, keys: Sequence[str], *, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each key from its confirmations.

    The best confirmation gives relation_kind, relation_type, primary_source and the
    ``carry`` columns; confidence is the largest (0 becomes null), n_sources counts
    distinct sources, kinds lists distinct kinds in order of their first source.
    """
    key = kin.kind_of(F.col("relation_kind"))
    order = priority(F.col("confidence"), F.lit(1), F.col("source_id"))
    best = F.min_by(F.struct(F.nullif(key, F.lit("")).alias("relation_kind"), "relation_type", F.col("source_id").alias("primary_source"), *carry), order)
    firsts = rows.where(key != "").groupBy(*keys, key.alias("_kind")).agg(F.min("source_id").alias("_first"))
    kinds = firsts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "_kind"))), lambda x: x["_kind"]).alias("kinds"))
    out = rows.groupBy(*keys).agg(best.alias("_b"), F.nullif(F.max(F.coalesce("confidence", F.lit(0.0))), F.lit(0.0)).alias("confidence"), F.count_distinct("source_id").alias("n_sources"))
    return out.join(kinds, list(keys), "left").select(*keys, "_b.*", "confidence", "n_sources", "kinds")


def canonicalize(edges: DataFrame) -> DataFrame:
    """One row for each canonical relation of a user.

    The best edge (confidence, then its ids) stays with its direction and kind; confidence
    is the largest, n_sources counts sources, kinds is sorted and tells of disagreement.
    """
    wide = with_canonical(edges)
    key = kin.kind_of(F.col("relation_kind"))
    wide = wide.withColumn("kind", F.when(key == "", "other").otherwise(key))
    # a relation has few confirmations, so combining before the shuffle saves nothing: one shuffle and windows over it
    whole = Window.partitionBy("user_id", "canon_from", "canon_to", "canon_key")
    best = whole.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), *[F.coalesce(c, F.lit(0)) for c in ("id", "from_id", "to_id")])
    rows = wide.withColumn("_rank", F.row_number().over(best)).withColumn("n_sources", F.size(F.collect_set("source_id").over(whole)).cast("long")).withColumn("kinds", F.sort_array(F.collect_set("kind").over(whole)))
    confidence = F.nullif(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)).alias("confidence")  # the best edge's is the largest
    return rows.where("_rank = 1").select("user_id", "canon_from", "canon_to", "canon_key", "id", "from_id", "to_id", "kind", "relation_type", "via_marriage", "bond", "up", "down", "delta", confidence, "n_sources", "kinds")


def kin_edges(canonical: DataFrame) -> DataFrame:
    """Canonical relations whose generation is defined."""
    return canonical.where(F.col("delta").isNotNull())


def kind_disagreements(canonical: DataFrame) -> DataFrame:
    """Relations that sources named by different kinds."""
    return canonical.where(F.size("kinds") > 1).select("user_id", "from_id", "to_id", "kinds", F.col("kind").alias("kept"))


def parent_conflicts(canonical: DataFrame) -> DataFrame:
    """Children with more than one person in a parent's slot.

    A parent without sex claims both slots. Returns user_id, child, slot, occupants
    (sorted) and parents, all recorded blood parents.
    """
    pair = kin.blood_parent_child(F.struct("up", "down", "via_marriage", "bond"), F.col("from_id"), F.col("to_id"))
    rows = canonical.select("user_id", pair.alias("p"), kin.parent_slot(F.col("kind")).alias("slot")).where("p IS NOT NULL AND slot IS NOT NULL")
    claims = F.when(F.col("slot") == "parent", F.array(F.lit("father"), F.lit("mother"))).otherwise(F.array("slot"))
    rows = rows.select("user_id", F.col("p.child").alias("child"), F.col("p.parent").alias("parent"), F.explode(claims).alias("slot"))
    by_slot = rows.groupBy("user_id", "child", "slot").agg(F.sort_array(F.collect_set("parent")).alias("occupants"))
    whole = F.sort_array(F.array_distinct(F.flatten(F.collect_list("occupants").over(Window.partitionBy("user_id", "child")))))
    return by_slot.withColumn("parents", whole).where(F.size("occupants") > 1)


def anchor_pairs(conflicts: DataFrame, anchors: DataFrame) -> DataFrame:
    """An unnamed and a named person in one crowded slot: candidates for a merge."""
    known = anchors.select("user_id", F.col("entity_id").alias("parent"), F.lit(True).alias("is_anchor")).distinct()
    rows = conflicts.select("user_id", "child", "slot", F.explode("occupants").alias("parent")).join(known, ["user_id", "parent"], "left")
    split = rows.groupBy("user_id", "child", "slot").agg(F.min(F.when(F.col("is_anchor"), F.col("parent"))).alias("anchor"), F.min(F.when(F.col("is_anchor").isNull(), F.col("parent"))).alias("named"))
    return split.where("anchor IS NOT NULL AND named IS NOT NULL")


def upsert_confirmations(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confirmations after a source was read again: what it said before is replaced."""
    again = new.select(*keys, "source_id").distinct()
    return stored.join(again, [*keys, "source_id"], "left_anti").unionByName(new)


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Maps every edge to the keeper of its canonical key: confidence, then id."""
    order = Window.partitionBy("user_id", "canon_from", "canon_to", "canon_key").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), F.col("id"))
    return edges.select("user_id", "id", F.first("id").over(order).alias("keeper"), F.row_number().over(order).alias("rank"))


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def repoint(rows: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replaces ids in ``columns`` by what ``mapping`` (old_id, new_id) says; others stay."""
    out = rows
    for c in columns:
        m = mapping.select(F.col("old_id").alias(f"_old_{c}"), F.col("new_id").alias(f"_new_{c}"))
        out = out.join(m, F.col(c) == F.col(f"_old_{c}"), "left").withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_old_{c}", f"_new_{c}")
    return out.select(*rows.columns)


def merge_entities_edges(confirmations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after entities were merged: ends re-pointed, loops dropped, equal relations joined.

    The keeper has the highest confidence, null last, then the least id; confirmations of
    all joined edges count.
    """
    moved = repoint(confirmations, mapping, ["from_id", "to_id"]).where("from_id <> to_id")
    return canonicalize(moved)
