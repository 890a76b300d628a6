"""Graph operators on (section_id, node) keys: components, reachability, corridors, degrees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that driver and executors share; one of our own only in a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="waymark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/waymark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merging(df: DataFrame) -> DataFrame:
    """A table in the shared folder that is joined by merges: compressed files look small, and a broadcast would send a table that
    grows with the input through the driver."""
    return stored(df).hint("merge")


def components(links: DataFrame) -> DataFrame:
    """section_id, node, component (smallest node) from undirected links (section_id, a, b): star joins until stable.

    The joins are merges: compressed files look small, and a broadcast would send every round's links through the driver.
    """
    edges = stored(links.select("section_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    key, state = ["section_id", "u"], None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("section_id", "u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now.n == 0 or now == state:
            low = edges.select("section_id", F.col("v").alias("node"), F.col("v").alias("component"))
            return edges.select("section_id", F.col("u").alias("node"), F.col("v").alias("component")).unionByName(low).distinct()
        state = now
        both = edges.unionByName(edges.select("section_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*key).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(least.hint("merge"), key).select("section_id", F.col("v").alias("u"), F.col("m").alias("v"))
        least = edges.groupBy(*key).agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        edges = stored(edges.join(least.hint("merge"), key).select("section_id", pair).select("section_id", "e.u", "e.v").where("u <> v").distinct())


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """section_id, node of all nodes that directed edges (section_id, f, t) lead to, sources included."""
    found = stored(sources.select("section_id", "node").distinct())
    front = found
    while True:
        step = front.join(edges.withColumnRenamed("f", "node"), ["section_id", "node"]).select("section_id", F.col("t").alias("node")).distinct()
        front = stored(step.join(found, ["section_id", "node"], "left_anti"))
        if front.isEmpty():
            return found
        found = stored(found.unionByName(front))


def degrees(edges: DataFrame) -> DataFrame:
    """Trails and neighbours at each node."""
    ends = edges.select("section_id", F.col("f").alias("node"), F.col("t").alias("other"), "trail").unionByName(edges.select("section_id", F.col("t").alias("node"), F.col("f").alias("other"), "trail"))
    return ends.groupBy("section_id", "node").agg(F.countDistinct("trail").alias("trails"), F.countDistinct("other").alias("neighbours"))


def corridors(trails: DataFrame) -> DataFrame:
    """Contract chains: trails joined at nodes where exactly two trails meet get one corridor (its smallest trail)."""
    ends = trails.select("section_id", "trail", F.explode(F.array("a", "b")).alias("node"))
    through = ends.groupBy("section_id", "node").agg(F.count("*").alias("n"), F.min("trail").alias("x"), F.max("trail").alias("y")).where("n = 2 and x < y")
    found = components(through.select("section_id", F.col("x").alias("a"), F.col("y").alias("b")))
    named = trails.join(found.withColumnRenamed("node", "trail"), ["section_id", "trail"], "left")
    return named.select("section_id", "trail", F.coalesce("component", "trail").alias("corridor"), "dist")
