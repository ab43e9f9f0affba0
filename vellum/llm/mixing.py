"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets are shares of a budget of words, held at a multiple of each source's size. Blocks
of equally many words are allotted to sources, and within a source to its shards, by the
highest quotients target / (2 seats + 1). A shard lays its documents end to end in seeded
order, cuts them into blocks and takes its quota from a seeded block on, as often round
as the quota asks. What a document gives follows from its place by arithmetic.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import WORD, durable


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """A seeded number of 32 bits that any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, *, weights: Sequence[float], budget: float, limit: float) -> DataFrame:
    """Rows (source, source_size, n, target) from rows (source, size), each of which stands for as many as its column ``times`` says, if it has one.

    Sources by code point, null last, take ``weights`` in turn. Targets share ``budget``
    times all sizes; none exceeds ``limit`` times its source's size, and the excess goes to
    the others by weight until none does: the level at which min(cap, level * weight) sums
    to the budget. In order of cap / weight, with those before a source held at their caps,
    it is the highest of the levels of the rest.
    """
    times = F.col("times") if "times" in sizes.columns else F.lit(1).cast("long")
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * times).alias("source_size"), F.sum(times).alias("n"))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(limit))
    filled = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(everything) * float(budget) - before) / rest)
    by = by.withColumn("level", F.max("level").over(everything))
    return by.select("source", "source_size", "n", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def apportion(units: DataFrame, *, group: Sequence[str], key: Sequence[str], claim: str, seats: str, most: str) -> DataFrame:
    """Adds ``quota``: Sainte-Lague seats of each unit within its group.

    ``claim`` is a unit's share, ``seats`` the group's number of seats, ``most`` a unit's
    largest quota. Seats start at the rounded proportional share; the few that then lack or
    exceed go by highest, or lowest, quotient, with ties by ``key``. No more candidates are
    made than a unit can still win or lose.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, count = F.sum(claim).over(whole), F.count("*").over(whole)
    base = F.when(F.col("_total") > 0, F.floor(F.col(claim).cast("double") * F.col(seats) / F.col("_total") + 0.5)).otherwise(0).cast("long")
    units = units.withColumn("_total", total).withColumn("_count", count).withColumn("_base", F.least(base, F.col(most)))
    units = units.withColumn("_lack", F.col(seats) - F.sum("_base").over(whole))
    reach = F.when(F.col("_total") > 0, F.ceil((F.abs("_lack") + F.col("_count")) * F.col(claim).cast("double") / F.col("_total")) + 1).otherwise(0)
    up = F.when(F.col("_lack") > 0, F.least(reach, F.col(most) - F.col("_base"))).otherwise(F.least(reach, F.col("_base"))).cast("int")
    steps = units.where((F.col("_lack") != 0) & (up > 0)).withColumn("_j", F.explode(F.sequence(F.lit(0), up - 1)))
    quotient = F.when(F.col("_lack") > 0, -F.col(claim) / (2 * (F.col("_base") + F.col("_j")) + 1)).otherwise(F.col(claim) / (2 * (F.col("_base") - F.col("_j")) - 1))
    ranked = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    steps = steps.withColumn("_rank", F.row_number().over(ranked.orderBy(quotient, *[F.col(k).asc_nulls_last() for k in key], "_j"))).where(F.col("_rank") <= F.abs("_lack"))
    moved = steps.groupBy(*[F.col(k).alias(f"_at_{k}") for k in key]).agg(F.sum(F.signum("_lack")).cast("long").alias("_move"))
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in key])
    names = [c for c in units.columns if not c.startswith("_")]
    return units.join(moved, same, "left").select(*names, (F.col("_base") + F.coalesce("_move", F.lit(0))).alias("quota"))


#: Equal rows that one task lays out by itself; larger groups are dealt to tasks by so many.
CHUNK = 4096


def numbered(groups: DataFrame) -> DataFrame:
    """Each row as often as its column ``times`` says, with its number among its equals in ``copy``."""
    names = [F.col(c) for c in groups.columns if c != "times"]
    few = groups.where(F.col("times") <= CHUNK).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
    runs = groups.where(F.col("times") > CHUNK).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(CHUNK).cast("long"))))
    last = F.least(F.col("_run") + CHUNK, F.col("times")) - 1
    many = runs.repartition("_run", "_id").select(*names, F.explode(F.sequence(F.col("_run"), last)).alias("copy"))
    return few.union(many)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, limit: int = 2, block: int = 8, shard_rows: int = 20_000, seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """What each document gives to the mix.

    One row per input row: ``id_col``, size, source_size, target (its source's), taken,
    copies (whole copies), and from and span, to which the part of a further copy is
    limited: arrays of the first word (from 0) and the number of words of at most two runs.
    taken = copies * size + the runs' lengths, at most ``limit`` sizes. Ids may be null or
    repeat, sources may be null; null texts have no words and give none. ``carry`` names
    further columns to keep. Equal input, whatever its order, gives equal output: a row's
    place is drawn from its id, its text and its number among its equals, so that neither
    a repeated id nor a repeated row gathers in one shard.
    """
    kept = [F.col(c) for c in carry]
    read = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_text"), *kept)
    groups = durable(read.groupBy(*read.columns).agg(F.count("*").alias("times")))  # equal rows meet on each task before they are sent
    draw = _draw(F.lit(str(seed)), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("_text"), F.col("copy").cast("string"))
    sizes = numbered(groups).withColumn("draw", draw).drop("_text", "copy")
    by = targets(groups, weights=weights, budget=budget, limit=limit)
    by = durable(by.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("long")))  # a plain side lets skewed joins split
    placed = sizes.join(by.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", F.col("draw") % F.col("shards"))
    units = sizes.join(by.select(F.col("source").alias("_source"), "shards"), F.col("source").eqNullSafe(F.col("_source"))).select("source", (F.col("draw") % F.col("shards")).alias("shard"), "size")
    units = units.groupBy("source", "shard").agg(F.sum("size").alias("unit_size"))
    units = units.withColumn("blocks", F.ceil(F.col("unit_size") / block).cast("long")).withColumn("unit_most", F.col("blocks") * limit)
    most = units.groupBy("source").agg(F.sum("unit_most").alias("most"))
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    sources = by.join(most.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("seats", F.floor(total / block + 0.5).cast("long"))
    sources = apportion(sources, group=[], key=["source"], claim="target", seats="seats", most="most").select(F.col("source").alias("_source"), F.col("quota").alias("source_quota"))
    units = units.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    units = apportion(units, group=["source"], key=["source", "shard"], claim="unit_size", seats="source_quota", most="unit_most")
    start = _draw(F.lit(f"{seed}:start"), F.coalesce("source", F.lit("null")), F.col("shard").cast("string"))
    whole = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long")
    units = durable(units.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "unit_size", "blocks", whole.alias("copies"), (F.col("quota") - whole * F.col("blocks")).alias("rest"), F.when(F.col("blocks") > 0, start % F.col("blocks")).otherwise(0).alias("first")))
    laid = Window.partitionBy("source", "shard").orderBy("draw", F.col("_id").asc_nulls_last(), "size", *[F.col(c).asc_nulls_last() for c in carry]).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("until", F.sum("size").over(laid)).withColumn("since", F.col("until") - F.col("size"))
    rows = rows.join(units, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    end = F.col("first") + F.col("rest")
    runs = [(F.col("first") * block, F.least(F.least(end, F.col("blocks")) * block, F.col("unit_size"))), (F.lit(0), F.greatest(end - F.col("blocks"), F.lit(0)) * block)]
    clipped = [(F.greatest(a, F.col("since")), F.least(b, F.col("until"))) for a, b in runs]
    froms = F.array(*[(a - F.col("since")) for a, b in clipped])
    spans = F.array(*[F.greatest(b - a, F.lit(0)) for a, b in clipped])
    pairs = F.array_sort(F.filter(F.arrays_zip(froms.alias("from"), spans.alias("span")), lambda x: x["span"] > 0))
    rows = rows.withColumn("runs", pairs)
    taken = F.col("copies") * F.col("size") + F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["span"])
    return rows.select(F.col("_id").alias(id_col), *kept, "size", "source_size", "target", taken.alias("taken"), "copies", F.col("runs.from").alias("from"), F.col("runs.span").alias("span"))


def oracle(*, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, limit: int = 2, block: int = 8, shard_rows: int = 20_000, seed: int = 42) -> str:
    """DuckDB SQL for doc_id, size, source_size, target and taken of `mix` over documents."""
    turn = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1)), 1, 8))::BIGINT AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sizes GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {turn} END AS weight, source_size * {float(limit)} AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) * {float(budget)} - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, least(cap, (max(lv) OVER ()) * weight) AS target, ceil(n / {float(shard_rows)})::BIGINT AS shards FROM l),
d AS (SELECT sizes.*, t.source_size, t.target, draw % shards AS shard FROM sizes JOIN t ON sizes.source IS NOT DISTINCT FROM t.source),
units AS (SELECT source, shard, sum(size)::BIGINT AS unit_size, ceil(sum(size) / {float(block)})::BIGINT AS blocks FROM d GROUP BY source, shard),
b AS (SELECT t.source, target, sum(blocks) * {limit} AS most FROM t JOIN units ON t.source IS NOT DISTINCT FROM units.source GROUP BY t.source, target),
c AS (SELECT *, floor((sum(target) OVER ()) / {block} + 0.5)::BIGINT AS seats,
  least(CASE WHEN sum(target) OVER () > 0 THEN floor(target * floor((sum(target) OVER ()) / {block} + 0.5) / (sum(target) OVER ()) + 0.5) ELSE 0 END, most)::BIGINT AS base FROM b),
e AS (SELECT *, seats - (sum(base) OVER ())::BIGINT AS lack FROM c),
q AS (SELECT source, lack, j, CASE WHEN lack > 0 THEN -target / (2 * (base + j) + 1) ELSE target / (2 * (base - j) - 1) END AS quotient
  FROM e, generate_series(0, abs(lack) + 1) g(j) WHERE lack <> 0 AND CASE WHEN lack > 0 THEN base + j < most ELSE j < base END),
m AS (SELECT source, sum(sign(lack))::BIGINT AS move FROM (SELECT *, row_number() OVER (ORDER BY quotient, source NULLS LAST, j) AS r FROM q) WHERE r <= abs(lack) GROUP BY source),
quotas AS (SELECT e.source, base + coalesce(move, 0) AS quota FROM e LEFT JOIN m ON e.source IS NOT DISTINCT FROM m.source),
ub AS (SELECT u.*, quota AS seats, blocks * {limit} AS most, sum(unit_size) OVER (PARTITION BY u.source) AS total FROM units u JOIN quotas ON u.source IS NOT DISTINCT FROM quotas.source),
uc AS (SELECT *, least(CASE WHEN total > 0 THEN floor(unit_size::DOUBLE * seats / total + 0.5) ELSE 0 END, most)::BIGINT AS base FROM ub),
ue AS (SELECT *, seats - (sum(base) OVER (PARTITION BY source))::BIGINT AS lack FROM uc),
uq AS (SELECT source, shard, lack, j, CASE WHEN lack > 0 THEN -unit_size / (2 * (base + j) + 1) ELSE unit_size / (2 * (base - j) - 1) END AS quotient
  FROM ue, generate_series(0, (SELECT max(abs(lack)) FROM ue)) g(j) WHERE j <= abs(lack) AND lack <> 0 AND unit_size > 0 AND CASE WHEN lack > 0 THEN base + j < most ELSE j < base END),
um AS (SELECT source, shard, sum(sign(lack))::BIGINT AS move FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient, shard, j) AS r FROM uq) WHERE r <= abs(lack) GROUP BY source, shard),
uu AS (SELECT ue.*, base + coalesce(move, 0) AS quota FROM ue LEFT JOIN um ON ue.source IS NOT DISTINCT FROM um.source AND ue.shard = um.shard),
v AS (SELECT *, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS copies, CASE WHEN blocks > 0 THEN quota % blocks ELSE 0 END AS rest,
  CASE WHEN blocks > 0 THEN ('0x' || substr(md5('{seed}:start:' || coalesce(source, 'null') || ':' || shard), 1, 8))::BIGINT % blocks ELSE 0 END AS first FROM uu),
laid AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY draw, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS until FROM d)
SELECT laid.doc_id, laid.size, laid.source_size, laid.target, (copies * size
  + greatest(least(least(least(first + rest, blocks) * {block}, unit_size), until) - greatest(first * {block}, until - size), 0)
  + greatest(least(greatest(first + rest - blocks, 0) * {block}, until) - (until - size), 0))::BIGINT AS taken
FROM laid JOIN v ON laid.source IS NOT DISTINCT FROM v.source AND laid.shard = v.shard
"""
