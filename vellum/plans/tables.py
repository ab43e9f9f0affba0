"""The archive's tables as they are derived from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("father", "mother", "brother", "wife", "uncle", "boss", "friend")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation edges, one row for each confirmation, from line items."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("l_linenumber"))
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("user_id"), number.alias("id"), F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") % 100).alias("to_id"), kind.alias("relation_kind"), F.col("l_returnflag").alias("relation_type"), F.lit(None).cast("int").alias("generations"), (F.col("l_quantity") > 45).alias("via_marriage"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_orderkey").alias("source_id"))


EDGES = f"""edges AS (SELECT l_suppkey % 5 AS user_id, (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey AS id, l_suppkey AS from_id,
  l_partkey % 100 AS to_id, ({list(KINDS)})[l_linenumber] AS relation_kind, l_returnflag AS relation_type, l_quantity > 45 AS via_marriage, l_discount * 10 AS confidence, l_orderkey AS source_id FROM lineitem)"""

#: Canonical fields of those kinds in SQL.
CANONICAL = """placed AS (SELECT *,
  CASE relation_kind WHEN 'father' THEN 1 WHEN 'mother' THEN 1 WHEN 'brother' THEN 1 WHEN 'wife' THEN 0 WHEN 'uncle' THEN 2 END AS up,
  CASE relation_kind WHEN 'father' THEN 0 WHEN 'mother' THEN 0 WHEN 'brother' THEN 1 WHEN 'wife' THEN 0 WHEN 'uncle' THEN 1 END AS down,
  relation_kind = 'wife' OR via_marriage AS marriage FROM edges),
canonical AS (SELECT *,
  CASE WHEN relation_kind IN ('father', 'mother', 'uncle', 'boss') THEN to_id WHEN relation_kind IN ('brother', 'wife') THEN least(from_id, to_id) ELSE from_id END AS canon_from,
  CASE WHEN relation_kind IN ('father', 'mother', 'uncle', 'boss') THEN from_id WHEN relation_kind IN ('brother', 'wife') THEN greatest(from_id, to_id) ELSE to_id END AS canon_to,
  CASE relation_kind WHEN 'wife' THEN 'pair:spouse' WHEN 'boss' THEN 'role:boss' WHEN 'friend' THEN 'kind:friend'
    ELSE 'shape:' || least(up, down) || ':' || greatest(up, down) || ':' || marriage::INT || ':blood' END AS canon_key FROM placed)"""

#: One row for each canonical relation in SQL.
MERGED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, canon_from, canon_to, canon_key ORDER BY coalesce(confidence, 0) DESC, id, from_id, to_id) AS rn,
  max(confidence) OVER (PARTITION BY user_id, canon_from, canon_to, canon_key) AS top FROM canonical),
kinds AS (SELECT user_id, canon_from, canon_to, canon_key, count(DISTINCT source_id) AS n_sources, string_agg(DISTINCT relation_kind, ',' ORDER BY relation_kind) AS kinds FROM canonical GROUP BY ALL),
merged AS (SELECT r.*, n_sources, kinds, nullif(top, 0) AS best FROM ranked r JOIN kinds USING (user_id, canon_from, canon_to, canon_key) WHERE rn = 1)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: page_id, order_index (from 0), text; a document is a confirmed page of author ``source``."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("author_id"), F.posexplode(F.split("text", "\n")).alias("order_index", "text"))


LINES = "lines AS (SELECT doc_id AS page_id, source AS author_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS order_index FROM documents)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from orders: births and places of customers, with importance."""
    birth = F.col("o_orderkey") % 2 == 0
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    iso = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.substring(day, 1, 4))
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("user_id"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 200).alias("subject_id"), F.when(birth, "birth").otherwise("birth_place").alias("predicate_kind"), F.lit(None).cast("string").alias("time_text"), F.when(birth, iso).alias("time_iso"), F.when(~birth, F.col("o_orderpriority")).alias("object_text"), F.lit(None).cast("string").alias("object_name"), (F.col("o_totalprice") / 500000).alias("importance"))


FACTS = """facts AS (SELECT o_custkey % 7 AS user_id, o_orderkey AS id, o_custkey % 200 AS subject_id, CASE WHEN o_orderkey % 2 = 0 THEN 'birth' ELSE 'birth_place' END AS predicate_kind,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') END END AS time_iso,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS object_text, o_totalprice / 500000 AS importance FROM orders)"""
