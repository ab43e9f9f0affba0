"""Connected components at scale, and how lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder: that of the context, else spark.checkpoint.dir of the session.

    Where neither is set a single machine, as in tests, gets a temporary folder; a cluster
    has none that all of it shares, which is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vellum-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage through the checkpoint folder, so that lost executors lose nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of ``edges`` (u, v: long): rows (node, root), root the smallest node.

    Alternates large-star and small-star contraction; every round is aggregations that
    combine before the shuffle and equi-joins. Nodes that are their own root are not
    returned. Raises if ``rounds`` do not suffice.
    """
    pairs = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upper = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = upper.union(both.where("v < u").groupBy("u").agg(F.min("v").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        pairs = durable(small.where("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
