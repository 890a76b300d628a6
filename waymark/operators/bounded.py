"""Bounded discovery for large sections: shortest-path forests, the circuits their chords close, detours and stems.

Each step is a join on (section_id, node) and an aggregate; a round's table is stored, and rounds end when no node gets
nearer. Limits of length bound the rounds, so a section of any size is searched in a few joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jitter
from .graph import stored
from .walks import circuit_key


def passed(edges: DataFrame, identities: DataFrame, number: int) -> DataFrame:
    """Edges with the weight of a search pass: length, a factor on climb, one on roads, and a fixed jitter of 0.8 to 1.2.

    A trail has one weight, the least of its directions. identities: section_id, trail, identity.
    """
    uphill = (0.0, 2.0, 8.0, 0.0)[number % 4]
    road = 100.0 if number % 4 == 3 else 12.0
    own = F.col("dist") + uphill * F.col("gain") + F.when(F.col("connector"), road * F.col("dist")).otherwise(0.0)
    least = edges.groupBy("section_id", "trail").agg(F.min(own).alias("least")).join(identities, ["section_id", "trail"])
    return edges.join(least.select("section_id", "trail", (F.col("least") * jitter("identity", number)).alias("weight")), ["section_id", "trail"])


def forest(edges: DataFrame, roots: DataFrame, limit: float, weight: str = "dist") -> DataFrame:
    """section_id, root, node, d, path (trails from the root): the lightest way to each node within the limit.

    edges: section_id, f, t, trail and the weight. roots: section_id, root, node. Ties go to the smaller path.
    """
    e = edges.select("section_id", F.col("f").alias("node"), "t", "trail", F.col(weight).alias("w"))
    key = ["section_id", "root", "node"]
    best = stored(roots.select(*key, F.lit(0.0).alias("d"), F.array().cast("array<bigint>").alias("path")).dropDuplicates(key))
    front = best
    while True:
        step = front.join(e, ["section_id", "node"]).select("section_id", "root", F.col("t").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.concat("path", F.array("trail")).alias("path")).where(F.col("d") <= limit)
        step = step.groupBy(*key).agg(F.min(F.struct("d", "path")).alias("s")).select(*key, "s.d", "s.path")
        old = best.select(*key, F.struct("d", "path").alias("o"))
        front = stored(step.join(old, key, "left").where(F.col("o").isNull() | (F.struct("d", "path") < F.col("o"))).drop("o"))
        if front.isEmpty():
            return best
        best = stored(best.unionByName(front).groupBy(*key).agg(F.min(F.struct("d", "path")).alias("s")).select(*key, "s.d", "s.path"))


def common_start(a: str, b: str) -> Column:
    """How many first elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def fundamental_circuits(edges: DataFrame, trees: DataFrame) -> DataFrame:
    """The circuit that each trail outside a tree closes in it: section_id, root, chord, core_trails, circuit, distance."""
    chord = edges.where("not reverse").select("section_id", "f", "t", F.col("trail").alias("chord"), "dist")
    one = trees.select("section_id", "root", F.col("node").alias("f"), F.col("d").alias("df"), F.col("path").alias("pf"))
    two = trees.select("section_id", "root", F.col("node").alias("t"), F.col("d").alias("dt"), F.col("path").alias("pt"))
    both = chord.join(one, ["section_id", "f"]).join(two, ["section_id", "root", "t"]).where(~F.array_contains("pf", F.col("chord")) & ~F.array_contains("pt", F.col("chord")))
    both = both.withColumn("k", common_start("pf", "pt"))
    up = F.slice("pf", F.col("k") + 1, F.greatest(F.size("pf"), F.lit(1)))
    down = F.reverse(F.slice("pt", F.col("k") + 1, F.greatest(F.size("pt"), F.lit(1))))
    both = both.withColumn("core_trails", F.concat(up, F.array("chord"), down)).where(F.size(F.array_distinct("core_trails")) == F.size("core_trails"))
    return both.withColumn("circuit", circuit_key("core_trails")).select("section_id", "root", "chord", "core_trails", "circuit")


def interleaved(proposals: DataFrame, per: str = "section_id", bands: str = "band", score: str = "score") -> DataFrame:
    """Proposals in turns: the best of every band, then the second of every band, and so on."""
    turn = F.row_number().over(Window.partitionBy(per, bands).orderBy(score, "circuit"))
    return proposals.withColumn("turn", turn.cast("long")).withColumn("place", F.row_number().over(Window.partitionBy(per).orderBy("turn", bands, "circuit")).cast("long"))


def detours(trails: DataFrame) -> DataFrame:
    """Replacements of a trail by another one, or two in a row, between the same nodes: section_id, trail, by, dist."""
    ends = trails.select("section_id", "trail", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"), "dist").select("section_id", "trail", "e.u", "e.v", "dist")
    base = trails.select("section_id", F.col("trail"), F.col("a").alias("u"), F.col("b").alias("v"))
    single = base.join(ends.select("section_id", "u", "v", F.col("trail").alias("x"), "dist"), ["section_id", "u", "v"]).where("x <> trail").select("section_id", "trail", F.col("x").cast("string").alias("by"), "dist")
    first = ends.select("section_id", "u", F.col("v").alias("w"), F.col("trail").alias("x"), F.col("dist").alias("dx"))
    second = ends.select("section_id", F.col("u").alias("w"), "v", F.col("trail").alias("y"), F.col("dist").alias("dy"))
    double = base.where("u <> v").join(first, ["section_id", "u"]).where("x <> trail and w <> u and w <> v").join(second, ["section_id", "w", "v"]).where("y <> trail and y <> x")
    return single.unionByName(double.select("section_id", "trail", F.concat_ws(",", "x", "y").alias("by"), (F.col("dx") + F.col("dy")).alias("dist")))
