"""Graphs of people and folders: paths, levels, components, trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import kin
from vellum.operators.components import connected, durable


def direct_edges(edges: DataFrame, subjects: DataFrame) -> DataFrame:
    """Edges that leave each subject, with their order by type, then id."""
    rows = edges.join(subjects.select(F.col("subject").alias("from_id")), "from_id", "left_semi")
    order = Window.partitionBy("from_id").orderBy(F.col("relation_type").asc_nulls_first(), "id")
    return rows.withColumn("position", F.row_number().over(order))


def paths(edges: DataFrame, subjects: DataFrame, depth: int = 3) -> DataFrame:
    """Shortest chains along out-edges from each subject, of two edges up to ``depth``.

    Columns subject, target, depth, chain (ids from the subject on) and types. The first
    visit wins: ties go to the chain whose edges come first by type, then id, from the
    start on. Neighbours one edge away are visited but not returned.
    """
    steps = edges.where("from_id <> to_id").select("from_id", "to_id", F.coalesce("relation_type", F.lit("")).alias("relation_type"), "id")
    # of parallel edges only the first by type, then id, can be on the chosen chain
    steps = steps.groupBy("from_id", "to_id").agg(F.min(F.struct("relation_type", "id")).alias("e")).select("from_id", "to_id", "e.*")
    here = subjects.select("subject", F.col("subject").alias("node"), F.array("subject").alias("chain"), F.array().cast("array<string>").alias("types"), F.array().cast("array<struct<t:string,i:bigint>>").alias("order"))
    seen, found = here.select("subject", "node"), None
    for d in range(1, depth + 1):
        ahead = here.join(steps, here["node"] == steps["from_id"]).select("subject", F.col("to_id").alias("node"), F.concat("chain", F.array("to_id")).alias("chain"), F.concat("types", F.array("relation_type")).alias("types"), F.concat("order", F.array(F.struct(F.col("relation_type").alias("t"), F.col("id").cast("bigint").alias("i")))).alias("order"))
        best = ahead.groupBy("subject", "node").agg(F.min_by(F.struct("chain", "types", "order"), "order").alias("b")).select("subject", "node", "b.*")
        here = best.join(seen, ["subject", "node"], "left_anti")
        seen = seen.union(here.select("subject", "node"))
        if d > 1:
            level = here.select("subject", F.col("node").alias("target"), F.lit(d).alias("depth"), "chain", "types")
            found = level if found is None else found.unionByName(level)
    return found


def path_label(names: Column) -> Column:
    """Names of a chain from the far end to the near one."""
    return F.array_join(F.reverse(names), " → ")


def decorate(chains: DataFrame, names: DataFrame) -> DataFrame:
    """Adds names to chains of ids; a missing name is a question mark."""
    rows = chains.select("subject", "target", F.posexplode("chain").alias("p", "id")).join(names.select(F.col("id").alias("id"), "name"), "id", "left")
    listed = rows.groupBy("subject", "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", F.coalesce("name", F.lit("?")).alias("n")))), lambda x: x["n"]).alias("names"))
    return chains.join(listed, ["subject", "target"])


def reachable(edges: DataFrame, subjects: DataFrame, depth: int = 3, most: int = 200) -> DataFrame:
    """Who can be reached, directly or by a path: subject, target, depth; the nearest ``most`` of each subject."""
    near = direct_edges(edges, subjects).where("from_id <> to_id").select(F.col("from_id").alias("subject"), F.col("to_id").alias("target"), F.lit(1).alias("depth")).distinct()
    both = near.unionByName(paths(edges, subjects, depth).select("subject", "target", "depth"))
    best = both.groupBy("subject", "target").agg(F.min("depth").alias("depth"))
    order = Window.partitionBy("subject").orderBy("depth", "target")
    return best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def people_mentioned(reached: DataFrame, people: DataFrame) -> DataFrame:
    """Reachable people with their names, by name."""
    order = Window.partitionBy("subject").orderBy("name", "target")
    return reached.join(people.select(F.col("id").alias("target"), "name"), "target").withColumn("position", F.row_number().over(order))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end outside the nodes, and which."""
    known = nodes.select(F.col("node").alias("_n")).distinct()
    rows = edges.join(known.withColumnRenamed("_n", "_f"), F.col("from_id") == F.col("_f"), "left").join(known.withColumnRenamed("_n", "_t"), F.col("to_id") == F.col("_t"), "left")
    missing = F.sort_array(F.array_distinct(F.array_compact(F.array(F.when(F.col("_f").isNull(), F.col("from_id")), F.when(F.col("_t").isNull(), F.col("to_id"))))))
    return rows.where("_f IS NULL OR _t IS NULL").select("id", "from_id", "to_id", missing.alias("missing"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component) for all nodes, the component's smallest node being its id."""
    roots = connected(edges.select(F.col("from_id").cast("long").alias("u"), F.col("to_id").cast("long").alias("v")))
    return nodes.select(F.col("node").cast("long").alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


#: Parts to which the edges of one family are dealt.
SHARDS = 16


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """The edges of the best spanning forest, in order of rank."""
    group = group.sort_values(["rank_confidence", "rank_sources", "id", "from_id", "to_id"], kind="stable")
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(group.from_id.tolist(), group.to_id.tolist(), strict=True):
        p, q = find(a), find(b)
        kept.append(p != q)
        parent[p] = q
    return group[kept]


def _levels_of(group: pd.DataFrame) -> pd.DataFrame:
    """Levels of one component: a forest of the best edges, walked from any node, shifted to least zero."""
    group = _forest(group)
    near: dict[int, list[tuple[int, int]]] = {}
    for a, b, step in zip(group.from_id.tolist(), group.to_id.tolist(), group.delta.tolist(), strict=True):
        near.setdefault(a, []).append((b, step))
        near.setdefault(b, []).append((a, -step))
    start = min(near) if near else None
    level = {} if start is None else {start: 0}
    ahead = list(level)
    while ahead:
        here = ahead.pop()
        for other, step in near[here]:
            if other not in level:
                level[other] = level[here] + step
                ahead.append(other)
    low = min(level.values(), default=0)
    rows = [(group.user_id.iloc[0], group.component.iloc[0], n, v - low) for n, v in sorted(level.items())]
    return pd.DataFrame(rows, columns=["user_id", "component", "node", "level"])


def levels(canonical: DataFrame) -> DataFrame:
    """Generation levels of people, 0 the lowest of each component.

    Each component's spanning forest prefers edges of higher confidence, then more
    sources, then ids; levels follow it. Edges without a generation step join nothing. A
    large family's edges are dealt to shards first: what a shard's own forest leaves out is
    in no forest of the whole, so that the last task holds a few edges a person.
    """
    rows = canonical.where("delta IS NOT NULL AND from_id <> to_id")
    # people of different users are different nodes: number them together
    ends = rows.select("user_id", F.col("from_id").alias("node")).union(rows.select("user_id", "to_id")).distinct()
    ends = durable(ends.select("user_id", "node", F.monotonically_increasing_id().alias("_u")))  # kept, so that the numbers stand
    keyed = rows.select("user_id", "from_id", "to_id").join(ends.select("user_id", F.col("node").alias("from_id"), F.col("_u").alias("u")), ["user_id", "from_id"]).join(ends.select("user_id", F.col("node").alias("to_id"), F.col("_u").alias("v")), ["user_id", "to_id"]).select("u", "v")
    roots = ends.join(connected(keyed).withColumnRenamed("node", "_u"), "_u", "left").select("user_id", F.col("node").alias("from_id"), F.coalesce("root", "_u").alias("_root"))
    first = roots.groupBy("_root").agg(F.min("from_id").alias("component"))
    placed = rows.join(roots, ["user_id", "from_id"]).join(first, "_root")
    table = placed.select("user_id", "_root", F.col("component").cast("long"), F.col("id").cast("long"), F.col("from_id").cast("long"), F.col("to_id").cast("long"), F.col("delta").cast("long"), (-F.coalesce("confidence", F.lit(0.0))).alias("rank_confidence"), (-F.col("n_sources")).cast("long").alias("rank_sources"))
    kind = canonical.schema["user_id"].dataType.simpleString()
    shard = F.pmod(F.xxhash64("id", "from_id", "to_id"), F.lit(SHARDS)).alias("_shard")
    table = table.groupBy("_root", shard).applyInPandas(_forest, table.schema)
    return table.groupBy("_root").applyInPandas(_levels_of, f"user_id {kind}, component long, node long, level long")


def level_mismatches(canonical: DataFrame, level: DataFrame) -> DataFrame:
    """Edges whose ends' levels differ by another step than the edge's."""
    ends = level.select("user_id", "node", "level")
    rows = canonical.where("delta IS NOT NULL").join(ends.select("user_id", F.col("node").alias("from_id"), F.col("level").alias("from_level")), ["user_id", "from_id"]).join(ends.select("user_id", F.col("node").alias("to_id"), F.col("level").alias("to_level")), ["user_id", "to_id"])
    return rows.where("to_level - from_level <> delta").select("user_id", "id", "from_id", "to_id", "kind", F.col("delta").alias("expected_delta"), (F.col("to_level") - F.col("from_level")).alias("actual_delta"))


def unplaced(nodes: DataFrame, edges: DataFrame, level: DataFrame) -> DataFrame:
    """People without a level and why: ritual or ambiguous by their last such edge, else isolated."""
    reason = F.when(kin.is_ritual(F.col("relation_kind")), "ritual").when(kin.is_ambiguous(F.col("relation_kind")), "ambiguous")
    told = edges.select("user_id", "id", "from_id", "to_id", reason.alias("reason")).where("reason IS NOT NULL")
    ends = told.select("user_id", F.explode(F.array("from_id", "to_id")).alias("node"), "id", "reason").groupBy("user_id", "node").agg(F.max_by("reason", "id").alias("reason"))
    return nodes.select("user_id", "node").distinct().join(level.select("user_id", "node"), ["user_id", "node"], "left_anti").join(ends, ["user_id", "node"], "left").select("user_id", "node", F.coalesce("reason", F.lit("isolated")).alias("reason"))


def graph_payload(nodes: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with level and component, canonical edges, and conflicts of levels."""
    level = levels(canonical)
    people = nodes.select("user_id", "node").distinct().join(level, ["user_id", "node"], "left")
    return people, canonical, level_mismatches(canonical, level)


def spouse_units(canonical: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, unit): people joined by marriage share the unit of their smallest id."""
    return components(canonical.where(kin.is_spouse_link(F.col("canon_key"))), nodes).withColumnRenamed("component", "unit")


def rooted_tree(canonical: DataFrame, level: DataFrame, root: int) -> DataFrame:
    """Relative levels of the root's component, and who lies outside it."""
    own = level.where(F.col("node") == root).select(F.col("component").alias("_c"), F.col("level").alias("_l"), F.col("user_id").alias("_u"))
    rows = level.join(F.broadcast(own), level["user_id"] == F.col("_u"))
    inside = F.col("component") == F.col("_c")
    return rows.select("user_id", "node", F.when(inside, F.col("level") - F.col("_l")).alias("relative_level"), F.when(~inside, F.lit("other component")).alias("reason"))


def default_root(level: DataFrame) -> DataFrame:
    """The person of the highest level of each user, the smallest id among equals."""
    return level.groupBy("user_id").agg(F.max_by("node", F.struct("level", (-F.col("node")).alias("n"))).alias("root"))


def folder_paths(folders: DataFrame, depth: int = 16) -> DataFrame:
    """Folders (id, parent_id, name) with depth, path of names and ids from the top.

    A folder below more than ``depth`` others, or in a cycle, is not returned.
    """
    here = folders.where("parent_id IS NULL").select("id", "parent_id", F.lit(0).alias("depth"), F.array("name").alias("path"), F.array("id").alias("ids"))
    out = here
    for d in range(1, depth + 1):
        here = folders.alias("f").join(here.select(F.col("id").alias("_p"), F.col("path").alias("_path"), F.col("ids").alias("_ids")), F.col("f.parent_id") == F.col("_p")).select("f.id", "f.parent_id", F.lit(d).alias("depth"), F.concat("_path", F.array("f.name")).alias("path"), F.concat("_ids", F.array("f.id")).alias("ids"))
        if d % 4 == 0 and here.isEmpty():
            break
        out = out.unionByName(here)
    return out


def cycles(folders: DataFrame, depth: int = 16) -> DataFrame:
    """Folders that come back to themselves along their parents within ``depth`` steps."""
    up = folders.where("parent_id IS NOT NULL").select(F.col("id").alias("_i"), F.col("parent_id").alias("_p"))
    here, out = folders.select("id", F.col("parent_id").alias("at")).where("at IS NOT NULL"), None
    for _ in range(depth):
        hit = here.where("at = id").select("id")
        out = hit if out is None else out.union(hit)
        here = here.where("at <> id").join(up, F.col("at") == F.col("_i")).select("id", F.col("_p").alias("at"))
    return out.distinct()


def delete_folder(folders: DataFrame, folder_id: int) -> DataFrame:
    """Removes a folder; its children move to its parent."""
    gone = folders.where(F.col("id") == folder_id).select(F.col("id").alias("_g"), F.col("parent_id").alias("_up"))
    rows = folders.where(F.col("id") != folder_id).join(F.broadcast(gone), F.col("parent_id") == F.col("_g"), "left")
    return rows.withColumn("parent_id", F.when(F.col("_g").isNotNull(), F.col("_up")).otherwise(F.col("parent_id"))).select(*folders.columns)


def folder_chain(paths_df: DataFrame, column: str = "path") -> DataFrame:
    """Distinct folders that paths such as a/b/c need: path, name, parent, depth."""
    parts = F.filter(F.split(F.col(column), "/"), lambda x: F.trim(x) != "")
    rows = paths_df.select(parts.alias("p")).where("size(p) > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice("p", F.lit(1), n))).alias("q")).distinct()
    parent = F.when(F.size("q") > 1, F.array_join(F.slice("q", F.lit(1), F.size("q") - 1), "/"))
    return rows.select(F.array_join("q", "/").alias("path"), F.element_at("q", -1).alias("name"), parent.alias("parent"), F.size("q").alias("depth"))
