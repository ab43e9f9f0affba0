"""Queries on relations: canonical edges, diagnostics, paths, levels, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.catalog import register
from vellum.functions import kin
from vellum.operators import edges as E
from vellum.operators import graph as G
from vellum.operators.components import durable
from vellum.plans import tables as D

PAIR = "user_id, canon_from, canon_to, canon_key"

#: Merged entities, two numbers each, that every task may hold.
FEW = 200_000


def _canonical(spark, sf):
    return E.canonicalize(D.edges(spark, sf))


@register("d05_canonical_edges", f"WITH {D.EDGES}, {D.CANONICAL}, {D.MERGED} SELECT {PAIR}, id, from_id, to_id, relation_kind AS kind, marriage AS via_marriage, down - up AS delta, best AS confidence, n_sources, kinds FROM merged")
def canonical_edges(spark, sf):
    return _canonical(spark, sf).select("user_id", "canon_from", "canon_to", "canon_key", "id", "from_id", "to_id", "kind", "via_marriage", "delta", "confidence", "n_sources", F.array_join("kinds", ",").alias("kinds"))


@register("d06_kin_edges", f"WITH {D.EDGES}, {D.CANONICAL}, {D.MERGED} SELECT user_id, id, down - up AS delta FROM merged WHERE up IS NOT NULL")
def kin_edges(spark, sf):
    return E.kin_edges(_canonical(spark, sf)).select("user_id", "id", "delta")


@register("d07_kind_disagreements", f"WITH {D.EDGES}, {D.CANONICAL}, {D.MERGED} SELECT user_id, from_id, to_id, kinds, relation_kind AS kept FROM merged WHERE contains(kinds, ',')")
def disagreements(spark, sf):
    return E.kind_disagreements(_canonical(spark, sf)).withColumn("kinds", F.array_join("kinds", ","))


_SLOTS = f"""WITH {D.EDGES}, {D.CANONICAL}, {D.MERGED},
p AS (SELECT user_id, from_id AS child, to_id AS parent, relation_kind AS slot FROM merged WHERE relation_kind IN ('father', 'mother') AND NOT marriage),
s AS (SELECT user_id, child, slot, count(DISTINCT parent) AS n, string_agg(DISTINCT parent::VARCHAR, ',' ORDER BY parent::VARCHAR) AS occupants, min(CASE WHEN parent % 3 = 0 THEN parent END) AS anchor, min(CASE WHEN parent % 3 <> 0 THEN parent END) AS named FROM p GROUP BY ALL)"""


@register("d08_parent_conflicts", f"{_SLOTS} SELECT user_id, child, slot, occupants FROM s WHERE n > 1")
def parent_conflicts(spark, sf):
    found = E.parent_conflicts(_canonical(spark, sf))
    return found.select("user_id", "child", "slot", F.array_join(F.sort_array(F.transform("occupants", lambda x: x.cast("string"))), ",").alias("occupants"))


@register("d09_anchor_pairs", f"{_SLOTS} SELECT user_id, child, slot, anchor, named FROM s WHERE n > 1 AND anchor IS NOT NULL AND named IS NOT NULL")
def anchor_pairs(spark, sf):
    anchors = D.edges(spark, sf).select("user_id", F.col("to_id").alias("entity_id")).where("entity_id % 3 = 0")
    return E.anchor_pairs(E.parent_conflicts(_canonical(spark, sf)), anchors)


@register(
    "d04_confirmations",
    f"""WITH {D.EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id ORDER BY coalesce(confidence, 0) DESC, source_id) AS rn FROM edges WHERE relation_kind = 'uncle'),
a AS (SELECT from_id, to_id, nullif(max(coalesce(confidence, 0)), 0) AS confidence, count(DISTINCT source_id) AS n_sources FROM r GROUP BY ALL)
SELECT from_id, to_id, r.source_id AS primary_source, a.confidence, n_sources FROM a JOIN r USING (from_id, to_id) WHERE rn = 1""",
)
def confirmations(spark, sf):
    rows = D.edges(spark, sf).where("relation_kind = 'uncle'")
    return E.aggregate_confirmations(rows, ["from_id", "to_id"]).select("from_id", "to_id", "primary_source", "confidence", "n_sources")


@register(
    "e01_duplicate_edges",
    f"""WITH {D.EDGES}, {D.CANONICAL} SELECT user_id, id, first_value(id) OVER w AS keeper, (row_number() OVER w)::INT AS rank FROM canonical
WINDOW w AS (PARTITION BY {PAIR} ORDER BY coalesce(confidence, 0) DESC, id)""",
)
def duplicate_edges(spark, sf):
    return E.duplicate_edges(E.with_canonical(D.edges(spark, sf)))


@register("e02_keep_first", f"WITH {D.EDGES}, {D.CANONICAL}, r AS (SELECT *, row_number() OVER (PARTITION BY {PAIR} ORDER BY confidence DESC NULLS LAST, id) AS n FROM canonical) SELECT id, user_id, canon_key FROM r WHERE n = 1")
def keep_first(spark, sf):
    rows = E.with_canonical(D.edges(spark, sf))
    return E.keep_first(rows, ["user_id", "canon_from", "canon_to", "canon_key"], [F.col("confidence").desc_nulls_last(), F.col("id")]).select("id", "user_id", "canon_key")


@register("f01_relation_words", "SELECT r_regionkey, (['father', 'mother', 'neighbour', 'father', 'other'])[r_regionkey + 1] AS kind FROM region")
def relation_words(spark, sf):
    word = F.element_at(F.array(*[F.lit(x) for x in ("Мой  Батя", "MOTHER", "сосед-ка", "father-in-law", "")]), F.col("r_regionkey") + 1)
    return D.table(spark, sf, "region").select("r_regionkey", kin.normalize_relation(word).alias("kind"))


@register("f08_canonical_fields", f"WITH {D.EDGES}, {D.CANONICAL} SELECT id, canon_from, canon_to, canon_key, up, down, marriage AS via_marriage FROM canonical")
def canonical_fields(spark, sf):
    return E.with_canonical(D.edges(spark, sf)).select("id", "canon_from", "canon_to", "canon_key", "up", "down", "via_marriage")


@register(
    "g20_merge_entities",
    f"""WITH base AS (SELECT * FROM (WITH {D.EDGES} SELECT * FROM edges)),
edges AS (SELECT * REPLACE (CASE WHEN from_id % 10 = 9 THEN from_id - 1 ELSE from_id END AS from_id, CASE WHEN to_id % 10 = 9 THEN to_id - 1 ELSE to_id END AS to_id) FROM base
  WHERE (CASE WHEN from_id % 10 = 9 THEN from_id - 1 ELSE from_id END) <> (CASE WHEN to_id % 10 = 9 THEN to_id - 1 ELSE to_id END)),
{D.CANONICAL}, {D.MERGED} SELECT {PAIR}, id, relation_kind AS kind, best AS confidence, n_sources FROM merged""",
)
def merge_entities(spark, sf):
    rows = D.edges(spark, sf)
    ends = rows.select(F.explode(F.array("from_id", "to_id")).alias("old_id")).where("old_id % 10 = 9").distinct()
    old = durable(ends.withColumn("new_id", F.col("old_id") - 1))
    old = F.broadcast(old) if old.count() <= FEW else old
    return E.merge_entities_edges(rows, old).select("user_id", "canon_from", "canon_to", "canon_key", "id", "kind", "confidence", "n_sources")


# --- paths and trees ------------------------------------------------------------------


def _links(spark, sf):
    return D.edges(spark, sf).select("id", F.col("from_id").cast("long").alias("from_id"), F.col("to_id").cast("long").alias("to_id"), "relation_type")


def _subjects(spark, sf):
    return D.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("subject"))


_LINKS = f"{D.EDGES}, g AS (SELECT id, from_id, to_id, relation_type FROM edges)"


@register("g01_direct_edges", f"WITH {_LINKS} SELECT from_id, to_id, id, (row_number() OVER (PARTITION BY from_id ORDER BY relation_type NULLS FIRST, id))::INT AS position FROM g")
def direct_edges(spark, sf):
    return G.direct_edges(_links(spark, sf), _subjects(spark, sf)).select("from_id", "to_id", "id", "position")


_BFS = f"""WITH RECURSIVE {_LINKS}, e AS (SELECT DISTINCT from_id, to_id FROM g WHERE from_id <> to_id),
walk AS (SELECT from_id AS subject, to_id AS node, 1 AS depth FROM e
  UNION SELECT w.subject, e.to_id, w.depth + 1 FROM walk w JOIN e ON e.from_id = w.node WHERE w.depth < 3),
near AS (SELECT subject, node, min(depth) AS depth FROM walk WHERE node <> subject GROUP BY ALL)"""


@register("g02_paths", f"{_BFS} SELECT subject, node AS target, depth::INT AS depth, depth::INT + 1 AS chain_length FROM near WHERE depth > 1")
def paths(spark, sf):
    return G.paths(_links(spark, sf), _subjects(spark, sf)).select("subject", "target", "depth", F.size("chain").alias("chain_length"))


@register("g03_reachable", f"{_BFS} SELECT subject, node AS target, depth::INT AS depth FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY depth, node) AS r FROM near) WHERE r <= 200")
def reachable(spark, sf):
    return G.reachable(_links(spark, sf), _subjects(spark, sf))


@register("g04_people_mentioned", f"{_BFS} SELECT subject, node AS target, s_name AS name, depth::INT AS depth, (row_number() OVER (PARTITION BY subject ORDER BY s_name, node))::INT AS position FROM near JOIN supplier ON s_suppkey = node")
def people_mentioned(spark, sf):
    people = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return G.people_mentioned(G.reachable(_links(spark, sf), _subjects(spark, sf)), people)


@register("g05_path_labels")
def path_labels(spark, sf):
    people = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    found = G.decorate(G.paths(_links(spark, sf), people.select(F.col("id").cast("long").alias("subject"))), people)
    return found.select("subject", "target", G.path_label(F.col("names")).alias("label"))


@register(
    "g09_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS u, l_partkey % 100 AS v FROM lineitem),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS spot FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.spot)
SELECT s_suppkey::BIGINT AS node, coalesce(min(spot), s_suppkey)::BIGINT AS component FROM supplier LEFT JOIN r ON r.node = s_suppkey GROUP BY s_suppkey""",
)
def components(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("from_id"), (F.col("l_partkey") % 100).alias("to_id"))
    return G.components(rows, D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")))


def _kin(spark, sf):
    return _canonical(spark, sf)


@register("g07_levels")
def levels(spark, sf):
    return G.levels(_kin(spark, sf))


@register("g08_level_mismatches")
def mismatches(spark, sf):
    kept = _kin(spark, sf)
    return G.level_mismatches(kept, G.levels(kept))


@register("g10_unplaced")
def unplaced(spark, sf):
    nodes = D.edges(spark, sf).select("user_id", F.explode(F.array("from_id", "to_id")).alias("node"))
    return G.unplaced(nodes, D.edges(spark, sf), G.levels(_kin(spark, sf)))


@register("g11_dangling", f"WITH {D.EDGES} SELECT id, CASE WHEN from_id >= 50 AND to_id >= 50 AND from_id <> to_id THEN least(from_id, to_id) || ',' || greatest(from_id, to_id) WHEN from_id >= 50 THEN from_id::VARCHAR ELSE to_id::VARCHAR END AS missing FROM edges WHERE from_id >= 50 OR to_id >= 50")
def dangling(spark, sf):
    rows = G.dangling(D.edges(spark, sf), spark.range(50).select(F.col("id").alias("node")))
    return rows.select("id", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@register("g12_graph_payload")
def payload(spark, sf):
    nodes = D.edges(spark, sf).select("user_id", F.col("from_id").alias("node"))
    return G.graph_payload(nodes, _kin(spark, sf))[0]


@register("g13_spouse_units")
def spouse_units(spark, sf):
    nodes = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return G.spouse_units(_canonical(spark, sf), nodes)


@register("g14_rooted_tree")
def rooted_tree(spark, sf):
    return G.rooted_tree(_kin(spark, sf), G.levels(_kin(spark, sf)), 0)


@register("g15_default_root")
def default_root(spark, sf):
    return G.default_root(G.levels(_kin(spark, sf)))


def _folders(spark, sf):
    """Regions hold nations, nations hold customers."""
    r = D.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    n = D.table(spark, sf, "nation").select((F.col("n_nationkey") + 1000).cast("long"), F.col("n_regionkey").cast("long"), "n_name")
    c = D.table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).cast("long"), (F.col("c_nationkey") + 1000).cast("long"), "c_name")
    return r.union(n).union(c)


_FOLDERS = "folders AS (SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, r_name AS name FROM region UNION ALL SELECT n_nationkey + 1000, n_regionkey, n_name FROM nation UNION ALL SELECT c_custkey + 1000000, c_nationkey + 1000, c_name FROM customer)"


@register("g16_folder_paths", f"WITH RECURSIVE {_FOLDERS}, t AS (SELECT id, 0 AS depth, name AS path FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.id, t.depth + 1, t.path || '/' || f.name FROM folders f JOIN t ON f.parent_id = t.id) SELECT id, depth, path FROM t")
def folder_paths(spark, sf):
    return G.folder_paths(_folders(spark, sf)).select("id", "depth", F.array_join("path", "/").alias("path"))


@register("g17_cycles", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 10 < 3")
def cycles(spark, sf):
    step = F.when(F.col("s_suppkey") % 10 < 3, F.col("s_suppkey") - F.col("s_suppkey") % 10 + (F.col("s_suppkey") % 10 + 1) % 3).when(F.col("s_suppkey") % 10 == 3, F.lit(None)).otherwise(F.col("s_suppkey") - 1)
    return G.cycles(D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), step.cast("long").alias("parent_id")))


@register("g18_delete_folder", f"WITH {_FOLDERS} SELECT id, CASE WHEN parent_id = 1003 THEN (SELECT n_regionkey::BIGINT FROM nation WHERE n_nationkey = 3) ELSE parent_id END AS parent_id, name FROM folders WHERE id <> 1003")
def delete_folder(spark, sf):
    return G.delete_folder(_folders(spark, sf), 1003)


@register("g19_folder_chain", "WITH p AS (SELECT DISTINCT r_name, r_name || '/' || n_name AS full_path, n_name FROM region JOIN nation ON n_regionkey = r_regionkey) SELECT DISTINCT r_name AS path, r_name AS name, NULL::VARCHAR AS parent, 1 AS depth FROM p UNION ALL SELECT full_path, n_name, r_name, 2 FROM p")
def folder_chain(spark, sf):
    n, r = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    return G.folder_chain(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path")))
