"""A compiled section: corridors in their order, with points, heights and climbs, as edges and starts that a search reads.

From segments, anchors, chains and entrances (plans/topology.py). A chain's order comes from list ranking: each segment has two
half-edges, one for each way along it, each half-edge points to the next one of its chain, and pointers double until all reach
their end, in log(length) joins. Points and climbs are made by segment; only sums go along a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import spatial
from ..operators.graph import merging as stored
from .topology import ring_anchors

#: Points of a profile lie at most so many metres apart.
STEP = 25.0


def every_stop(stops: DataFrame, chains: DataFrame) -> DataFrame:
    """section_id, key: the anchors, and one place for each ring that has none."""
    return stops.select("section_id", "key").unionByName(ring_anchors(chains)).distinct()


def traversed(segs: DataFrame, stops: DataFrame, chains: DataFrame) -> DataFrame:
    """section_id, corridor, pos, a, b, turned, tail, head: the segments of each corridor in order, `turned` if it leads from b to a.

    A corridor is walked from its least end; one that begins and ends there, along its least segment first. stops: all of them.
    """
    rows = chains.select("section_id", "a", "b", "corridor").join(segs.select("section_id", "a", "b"), ["section_id", "a", "b"])
    way = lambda tail, head, turned: F.struct(F.col(tail).alias("tail"), F.col(head).alias("head"), F.lit(turned).alias("turned"))
    half = rows.select("section_id", "corridor", "a", "b", F.explode(F.array(way("a", "b", False), way("b", "a", True))).alias("e")).select("section_id", "corridor", "a", "b", "e.*")
    half = stored(half)
    at_stop = stops.withColumn("stop", F.lit(True))
    name = lambda c="": F.struct(F.col(f"a{c}").alias("a"), F.col(f"b{c}").alias("b"), F.col(f"turned{c}").alias("turned"))
    ahead = half.select("section_id", "corridor", F.col("tail").alias("head"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("turned").alias("turned2"))
    open_end = half.join(at_stop.withColumnRenamed("key", "head"), ["section_id", "head"], "left_anti")
    follows = open_end.join(ahead, ["section_id", "corridor", "head"]).where("a <> a2 or b <> b2").select("section_id", name().alias("h"), name("2").alias("next"))
    rank = half.select("section_id", name().alias("h")).join(follows, ["section_id", "h"], "left")
    rank = stored(rank.select("section_id", "h", "next", F.when(F.col("next").isNull(), F.col("h")).alias("last"), F.lit(1).cast("long").alias("steps")))
    while not rank.where("next is not null").isEmpty():
        beyond = rank.select("section_id", F.col("h").alias("next"), F.col("next").alias("next2"), F.col("last").alias("last2"), F.col("steps").alias("steps2"))
        moved = rank.where("next is not null").join(beyond, ["section_id", "next"]).select("section_id", "h", F.col("next2").alias("next"), F.col("last2").alias("last"), (F.col("steps") + F.col("steps2")).alias("steps"))
        rank = stored(rank.where("next is null").unionByName(moved))
    ranked = half.withColumn("h", name()).join(rank.select("section_id", "h", "last", "steps"), ["section_id", "h"])
    tips = ranked.join(at_stop.withColumnRenamed("key", "tail"), ["section_id", "tail"], "left_semi")
    first = tips.groupBy("section_id", "corridor").agg(F.min_by(F.struct("last", "steps"), F.struct("tail", "a", "b", "turned")).alias("f"))
    along = ranked.join(first.select("section_id", "corridor", F.col("f.last").alias("last"), F.col("f.steps").alias("total")), ["section_id", "corridor", "last"])
    return along.select("section_id", "corridor", (F.col("total") - F.col("steps")).alias("pos"), "a", "b", "turned", "tail", "head")


def places(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """section_id, key, lon, lat of ends: nodes, and cuts between two of them. keys: section_id, key."""
    parts = F.split("key", ":")
    cut = F.col("key").startswith("frontier")
    number = lambda c: F.substring(c, 2, 32).cast("long")
    u = F.when(cut, number(F.get(parts, F.lit(1)))).otherwise(number(F.col("key")))
    v = F.when(cut, number(F.get(parts, F.lit(2)))).otherwise(u)
    rows = keys.select("section_id", "key", u.alias("u"), v.alias("v"), F.when(cut, F.get(parts, F.lit(3)).cast("double") / 1e9).otherwise(0.0).alias("f"))
    for k in ("u", "v"):
        rows = rows.join(nodes.select("section_id", F.col("node").alias(k), F.col("lon").alias(f"{k}x"), F.col("lat").alias(f"{k}y")), ["section_id", k])
    between = lambda axis: F.col(f"u{axis}") + (F.col(f"v{axis}") - F.col(f"u{axis}")) * F.col("f")
    return rows.select("section_id", "key", between("x").alias("lon"), between("y").alias("lat"))


def densified(segs: DataFrame, at: DataFrame, step: float = STEP) -> DataFrame:
    """section_id, a, b, i, lon, lat: points of each segment from a to b, both ends included, at most `step` metres apart."""
    rows = segs.select("section_id", "a", "b", "metres")
    for k in ("a", "b"):
        rows = rows.join(at.select("section_id", F.col("key").alias(k), F.col("lon").alias(f"{k}x"), F.col("lat").alias(f"{k}y")), ["section_id", k])
    n = F.greatest(F.lit(1), F.ceil(F.col("metres") / step)).cast("int")
    rows = rows.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    part = lambda axis: F.col(f"a{axis}") + (F.col(f"b{axis}") - F.col(f"a{axis}")) * (F.col("i") / F.col("n"))
    return rows.select("section_id", "a", "b", F.col("i").cast("long").alias("i"), part("x").alias("lon"), part("y").alias("lat"))


def climbs(points: DataFrame, pixels: DataFrame, row: Column, col: Column) -> DataFrame:
    """section_id, a, b, up, down: what each segment climbs from a to b and back. A point without a height fails the section."""
    heights = spatial.bilinear(points.select("section_id", "a", "b", "i", row.alias("r"), col.alias("c")), pixels, "section_id", "a", "b", "i")
    heights = heights.withColumn("height", F.when(F.col("height").isNull(), F.raise_error(F.lit("a point without a height"))).otherwise(F.col("height")))
    rise = F.col("height") - F.lag("height").over(Window.partitionBy("section_id", "a", "b").orderBy("i"))
    return heights.withColumn("rise", rise).groupBy("section_id", "a", "b").agg(F.coalesce(F.sum(F.greatest("rise", F.lit(0.0))), F.lit(0.0)).alias("up"), F.coalesce(F.sum(F.greatest(-F.col("rise"), F.lit(0.0))), F.lit(0.0)).alias("down"))


def trails(segs: DataFrame, order: DataFrame, climbed: DataFrame) -> DataFrame:
    """One row for each corridor: section_id, corridor, corridor_id (a hash of its places in order), trail (dense), one, two (its
    ends), out, back (permission ranks), dist, gain_out, gain_back, connector, pieces. Lengths to the millimetre,
    climbs to the micrometre.

    A corridor's places are listed to name it; a section's size is bounded when sections are cut.
    """
    rows = order.join(segs.select("section_id", "a", "b", "forward", "backward", "connector", "metres"), ["section_id", "a", "b"]).join(climbed, ["section_id", "a", "b"])
    pick = lambda if_turned, else_: F.when(F.col("turned"), F.col(if_turned)).otherwise(F.col(else_))
    found = rows.groupBy("section_id", "corridor").agg(
        F.min_by("tail", "pos").alias("one"), F.max_by("head", "pos").alias("two"),
        F.min_by(pick("backward", "forward"), "pos").alias("out"), F.min_by(pick("forward", "backward"), "pos").alias("back"),
        F.round(F.sum("metres"), 3).alias("dist"), F.round(F.sum(pick("down", "up")), 6).alias("gain_out"), F.round(F.sum(pick("up", "down")), 6).alias("gain_back"),
        F.bool_or("connector").alias("connector"), F.count("*").alias("pieces"),
        F.array_sort(F.collect_list(F.struct("pos", "head"))).alias("path"),
    )
    text = F.concat_ws("|", "one", F.array_join(F.transform("path", lambda x: x["head"]), "|"))
    found = found.withColumn("corridor_id", F.substring(F.sha2(text, 256), 1, 24)).drop("path")
    return found.withColumn("trail", (F.row_number().over(Window.partitionBy("section_id").orderBy("corridor_id", "corridor")) - 1).cast("long"))


def edges(found: DataFrame) -> DataFrame:
    """The corridors as a search reads them: section_id, trail, f, t (dense ids of ends), reverse, dist, gain, access, connector."""
    ids = end_ids(found)
    way = lambda f, t, gain, access, flag: F.struct(F.col(f).alias("kf"), F.col(t).alias("kt"), F.col(gain).alias("gain"), F.col(access).alias("rank"), F.lit(flag).alias("reverse"))
    rows = found.select("section_id", "trail", "dist", "connector", F.explode(F.array(way("one", "two", "gain_out", "out", False), way("two", "one", "gain_back", "back", True))).alias("e")).select("section_id", "trail", "dist", "connector", "e.*").where("rank < 2")
    for k in ("f", "t"):
        rows = rows.join(ids.select("section_id", F.col("key").alias(f"k{k}"), F.col("id").alias(k)), ["section_id", f"k{k}"])
    return rows.select("section_id", "trail", "f", "t", "reverse", "dist", "gain", F.when(F.col("rank") == 0, "public").otherwise("unknown").alias("access"), "connector")


def end_ids(found: DataFrame) -> DataFrame:
    """section_id, key, id: the ends of corridors, numbered from 0 in each section."""
    keys = found.select("section_id", F.explode(F.array("one", "two")).alias("key")).distinct()
    return keys.withColumn("id", (F.row_number().over(Window.partitionBy("section_id").orderBy("key")) - 1).cast("long"))


def starts(found: DataFrame, entrances: DataFrame) -> DataFrame:
    """section_id, start_id, node, access, kind_rank of the entrances that are ends of corridors; prohibited ones go."""
    rows = entrances.where("access < 2").select("section_id", F.concat(F.lit("n"), "node").alias("key"), F.col("node").alias("start_id"), F.when(F.col("access") == 0, "public").otherwise("unknown").alias("access"), (2 - F.col("rank")).alias("kind_rank"))
    return rows.join(end_ids(found), ["section_id", "key"]).select("section_id", "start_id", F.col("id").alias("node"), "access", "kind_rank")


def audit(found: DataFrame, entrances: DataFrame) -> DataFrame:
    """section_id, trails, roads, segments, metres, climb, rings, cuts, starts, content_id: what a compiled section holds."""
    cut = lambda c: F.col(c).startswith("frontier").cast("long")
    rows = found.groupBy("section_id").agg(
        F.count("*").alias("trails"), F.count_if("connector").alias("roads"), F.sum("pieces").alias("segments"), F.round(F.sum("dist"), 3).alias("metres"), F.round(F.sum(F.col("gain_out") + F.col("gain_back")), 6).alias("climb"),
        F.count_if(F.col("one") == F.col("two")).alias("rings"), F.sum(cut("one") + cut("two")).alias("cuts"),
        F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("corridor_id")), ","), 256), 1, 24).alias("content_id"),
    )
    doors = starts(found, entrances).groupBy("section_id").agg(F.count("*").alias("starts"))
    return rows.join(doors, "section_id", "left").withColumn("starts", F.coalesce("starts", F.lit(0)))
