"""A walking network from tagged ways and nodes: segments, what cars reach, entrances, corridors, edges.

ways: section_id, id, nodes (array), tags (map). nodes: section_id, node, lon, lat, tags. A footprint is a convex ring of
points, counter-clockwise. Everything is joined by (section_id, node); nothing is connected by nearness. Sections are bounded when
they are cut (1000 ways), so the connected parts of one are found in its own group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.discovery import parts
from ..operators.graph import merging as stored
from ..operators.spatial import haversine
from . import tags as rules

#: Metres of network that an entrance needs, and from a lot to an entrance beside it.
NETWORK, BESIDE = 500.0, 30.0
Ring = Sequence[tuple[float, float]]


def clipped(ring: Ring, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The part of a segment inside a convex ring, as fractions (from, to); it is empty unless from < to."""
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for (px, py), (qx, qy) in zip(ring, (*ring[1:], ring[0]), strict=True):
        a = (qx - px) * (ay - py) - (qy - py) * (ax - px)
        b = (qx - px) * (by - py) - (qy - py) * (bx - px)
        low.append(F.when((a < 0) & (b >= 0), a / (a - b)).otherwise(0.0))
        high.append(F.when((a < 0) & (b < 0), -1.0).when((a >= 0) & (b < 0), a / (a - b)).otherwise(1.0))
    return F.greatest(*low), F.least(*high)


def covers(ring: Ring, x: Column, y: Column) -> Column:
    inside = F.lit(True)
    for (px, py), (qx, qy) in zip(ring, (*ring[1:], ring[0]), strict=True):
        inside = inside & ((qx - px) * (y - py) - (qy - py) * (x - px) >= 0)
    return inside


def pairs(ways: DataFrame, *columns: str) -> DataFrame:
    """Neighbouring nodes of each way: section_id, id, ordinal, l, r and other columns."""
    next_to = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.element_at("nodes", i).alias("l"), F.element_at("nodes", i + 1).alias("r")))
    return ways.where(F.size("nodes") > 1).select("section_id", "id", *columns, F.posexplode(next_to).alias("ordinal", "p")).select("section_id", "id", *columns, "ordinal", "p.l", "p.r")


def segments(ways: DataFrame, nodes: DataFrame, ring: Ring) -> DataFrame:
    """section_id, a, b (ends as text, a <= b), forward, backward (ranks), connector, names, copies, unpaved, track, metres.

    Ways are cut at every node and at the footprint; pieces between the same ends are one segment with the strictest
    permissions, a road if any of them is one. What may be walked in neither direction goes.
    """
    t = F.col("tags")
    one, two = rules.directions(t)
    road = rules.connector(t) | F.coalesce(F.col("developed"), F.lit(False)) if "developed" in ways.columns else rules.connector(t)
    own = [one.alias("along"), two.alias("against"), road.alias("connector"), t["name"].alias("name"), (~rules.is_in(t["surface"], rules.PAVED)).alias("bare"), rules.is_in(t["highway"], ("track",)).alias("track")]
    rows = pairs(ways.where(rules.routable(t)).select("section_id", "id", "nodes", *own), "along", "against", "connector", "name", "bare", "track")
    rows = rows.where("l <> r").withColumn("u", F.least("l", "r")).withColumn("v", F.greatest("l", "r")).withColumn("turned", F.col("l") > F.col("r"))
    at = nodes.select("section_id", "node", "lon", "lat", rules.crossing(t).alias("pass"))
    for k in ("u", "v"):
        rows = rows.join(at.toDF("section_id", k, f"{k}x", f"{k}y", f"{k}pass"), ["section_id", k])
    low, high = clipped(ring, *(F.col(c) for c in ("ux", "uy", "vx", "vy")))
    # stored, so that later conditions are not traced back into these expressions
    rows = stored(rows.withColumn("low", low).withColumn("high", high)).where("low < high")
    end = lambda node, free, f: F.when(free, F.concat(F.lit("n"), node)).otherwise(F.concat_ws(":", F.lit("frontier"), F.concat(F.lit("n"), F.col("u")), F.concat(F.lit("n"), F.col("v")), F.floor(F.col(f) * 1e9 + 0.5)))
    rows = rows.withColumn("ku", end(F.col("u"), F.col("low") == 0, "low")).withColumn("kv", end(F.col("v"), F.col("high") == 1, "high"))
    part = lambda axis, f: F.col(f"u{axis}") + (F.col(f"v{axis}") - F.col(f"u{axis}")) * F.col(f)
    rows = rows.withColumn("metres", haversine(part("x", "low"), part("y", "low"), part("x", "high"), part("y", "high")))
    gate = F.greatest(F.when(F.col("low") == 0, F.col("upass")).otherwise(0), F.when(F.col("high") == 1, F.col("vpass")).otherwise(0))
    swap = F.col("turned") != (F.col("ku") > F.col("kv"))
    rows = rows.select("section_id", F.least("ku", "kv").alias("a"), F.greatest("ku", "kv").alias("b"), F.greatest(F.when(swap, F.col("against")).otherwise(F.col("along")), gate).alias("forward"), F.greatest(F.when(swap, F.col("along")).otherwise(F.col("against")), gate).alias("backward"), "connector", "name", "bare", "track", "metres")
    # a pair of ends has a bounded number of ways, so its names are a short list
    rows = stored(rows).where("metres >= 1e-7")
    out = rows.groupBy("section_id", "a", "b").agg(F.max("forward").alias("forward"), F.max("backward").alias("backward"), F.bool_or("connector").alias("connector"), F.array_sort(F.collect_set("name")).alias("names"), F.count("*").alias("copies"), F.bool_and("bare").alias("unpaved"), F.bool_or("track").alias("track"), F.min("metres").alias("metres"))
    return out.where("forward < 2 or backward < 2")


def labelled(links: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """section_id, node, component of links (section_id, a, b), whose nodes are text."""
    ends = links.select("section_id", F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = stored(ends.withColumn("k", F.xxhash64("section_id", "node")))
    numbered = links.join(ids.select("section_id", F.col("node").alias("a"), F.col("k").alias("ka")), ["section_id", "a"]).join(ids.select("section_id", F.col("node").alias("b"), F.col("k").alias("kb")), ["section_id", "b"])
    found = parts(numbered.select("section_id", F.col("ka").alias("a"), F.col("kb").alias("b")))
    return ids.join(found.withColumnRenamed("node", "k"), ["section_id", "k"], "left").select("section_id", "node", F.coalesce("component", "k").alias("component"))


def car_reach(ways: DataFrame, nodes: DataFrame, ring: Ring) -> DataFrame:
    """section_id, node, reach (open, closed, unknown), gate: every node of a drivable road.

    Open nodes are joined, one-way or not, to a public road or to what lies outside the section, without passing a barrier;
    closed ones only through a barrier or a closed road; the others are gaps of the map. A barrier is open if a neighbour is.
    No join sends a table through the driver.
    """
    t = F.col("tags")
    public = rules.is_in(t["highway"], tuple(x for x in rules.ROADS if x not in ("track", "service")))
    roads = ways.where(rules.is_in(t["highway"], rules.ROADS) & rules.routable(t)).select("section_id", "id", "nodes", rules.drivable(t).alias("drivable"), public.alias("public"))
    roads = stored(roads)
    at = nodes.select("section_id", "node", (~covers(ring, F.col("lon"), F.col("lat"))).alias("outside"), F.coalesce(rules.stops_cars(t), F.lit(False)).alias("gate"))
    ends = roads.select("section_id", "drivable", "public", F.explode("nodes").alias("node")).join(at.hint("merge"), ["section_id", "node"])
    ends = ends.groupBy("section_id", "node").agg(F.bool_or("drivable").alias("road"), F.bool_or(F.col("public") | F.col("outside")).alias("seed"), F.bool_or(F.col("gate")).alias("gate"))
    ends = stored(ends.withColumn("gate", F.col("gate") & F.col("road")))
    links = pairs(roads, "drivable").select("section_id", F.col("l").alias("a"), F.col("r").alias("b"), "drivable").where("a <> b")
    shut = ends.where("gate").select("section_id", "node")
    free = links.where("drivable")
    for k in ("a", "b"):
        free = free.join(shut.withColumnRenamed("node", k).hint("merge"), ["section_id", k], "left_anti")

    def reached(some: DataFrame, seeds: DataFrame) -> DataFrame:
        found = stored(parts(some.select("section_id", "a", "b")))
        alive = found.join(seeds.hint("merge"), ["section_id", "node"], "left_semi").select("section_id", "component").distinct()
        return found.join(alive.hint("merge"), ["section_id", "component"], "left_semi").select("section_id", "node").union(seeds).distinct()

    driving = stored(reached(free, ends.where("seed and road and not gate").select("section_id", "node")))
    walking = stored(reached(links, ends.where("seed").select("section_id", "node")))
    beside = links.where("drivable").select("section_id", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("section_id", "e.*")
    opened = beside.join(driving.withColumnRenamed("node", "other").hint("merge"), ["section_id", "other"], "left_semi").join(shut.hint("merge"), ["section_id", "node"], "left_semi").select("section_id", "node").distinct()
    mark = lambda some, name: some.select("section_id", "node").distinct().withColumn(name, F.lit(True)).hint("merge")
    rows = ends.where("road").join(mark(driving.union(opened), "open"), ["section_id", "node"], "left").join(mark(walking, "walk"), ["section_id", "node"], "left")
    return rows.select("section_id", "node", F.when(F.col("open"), "open").when(F.col("walk"), "closed").otherwise("unknown").alias("reach"), "gate")


def trail_nodes(segs: DataFrame) -> DataFrame:
    """section_id, node of the ends of segments that are no roads."""
    key = F.explode(F.array("a", "b")).alias("key")
    rows = segs.where("not connector").select("section_id", key).distinct()
    return rows.where("key like 'n%'").select("section_id", F.substring("key", 2, 32).cast("long").alias("node"))


def road_contacts(ways: DataFrame, nodes: DataFrame, segs: DataFrame, reach: DataFrame) -> DataFrame:
    """section_id, node, roads (ids in order): where a drivable road meets a trail and cars get there."""
    t = F.col("tags")
    at = ways.where(rules.drivable(t)).select("section_id", "id", F.explode("nodes").alias("node")).distinct()
    at = at.join(trail_nodes(segs), ["section_id", "node"], "left_semi").join(reach.where("reach = 'closed'"), ["section_id", "node"], "left_anti")
    barred = nodes.where(rules.crossing(t) == 2).select("section_id", "node")
    at = at.join(barred, ["section_id", "node"], "left_anti")
    return at.groupBy("section_id", "node").agg(F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("roads"))


def beyond(segs: DataFrame, reach: DataFrame) -> DataFrame:
    """section_id, key, metres: trail length that one walks to from a node without driving."""
    opened = reach.where("reach = 'open'").select("section_id", F.concat(F.lit("n"), "node").alias("key"))
    some = segs.select("section_id", "a", "b", "connector", "metres")
    for k in ("a", "b"):
        some = some.join(opened.select("section_id", F.col("key").alias(k), F.lit(True).alias(f"{k}_open")), ["section_id", k], "left")
    some = some.where("not connector or not (coalesce(a_open, false) and coalesce(b_open, false))")
    return network_lengths(some.withColumn("counts", ~F.col("connector")))


def supporting(segs: DataFrame) -> DataFrame:
    """section_id, key, metres: length of the trails and unpaved tracks that a node is joined to."""
    some = segs.where("not connector or (track and unpaved)").withColumn("counts", F.col("unpaved"))
    return network_lengths(some)


def network_lengths(some: DataFrame) -> DataFrame:
    """section_id, key, metres of the counting segments in the component of each end. some: section_id, a, b, metres, counts."""
    some = stored(some.select("section_id", "a", "b", "metres", "counts"))
    found = stored(labelled(some))
    total = some.join(found.withColumnRenamed("node", "a"), ["section_id", "a"]).groupBy("section_id", "component").agg(F.sum(F.when(F.col("counts"), F.col("metres")).otherwise(0.0)).alias("metres"))
    return found.join(total, ["section_id", "component"]).select("section_id", F.col("node").alias("key"), "metres")


def gated_starts(nodes: DataFrame, segs: DataFrame, reach: DataFrame, ways: DataFrame, contacts: DataFrame) -> DataFrame:
    """section_id, node: barriers and closures that a car reaches with `NETWORK` metres of trail beyond them."""
    t = F.col("tags")
    roads = ways.where(rules.is_in(t["highway"], rules.ROADS) & rules.routable(t) & ~rules.drivable(t))
    stops = roads.select("section_id", F.explode("nodes").alias("node")).union(reach.where("gate").select("section_id", "node")).distinct()
    stops = stops.join(reach.where("reach = 'open'"), ["section_id", "node"], "left_semi").join(contacts, ["section_id", "node"], "left_anti")
    stops = stops.join(nodes.where(rules.crossing(t) == 2), ["section_id", "node"], "left_anti")
    long = beyond(segs, reach).where(F.col("metres") >= NETWORK).select("section_id", F.col("key"))
    return stops.withColumn("key", F.concat(F.lit("n"), "node")).join(long, ["section_id", "key"], "left_semi").select("section_id", "node")


def poi_starts(nodes: DataFrame, segs: DataFrame) -> DataFrame:
    """section_id, node, kind, access (rank), name, joined: places for starts; joined if a node of the network is the same one.

    A trailhead may meet any segment, parking only a trail. Parking needs permission to walk and to drive there.
    """
    t = F.col("tags")
    kind = rules.poi_kind(t)
    access = F.greatest(rules.permission(t), F.when(kind == "parking", rules.permission(t, None, rules.DRIVER)).otherwise(0))
    pois = nodes.where(kind.isNotNull()).select("section_id", "node", kind.alias("kind"), access.alias("access"), t["name"].alias("name"))
    every = segs.select("section_id", F.explode(F.array("a", "b")).alias("key")).distinct().where("key like 'n%'").select("section_id", F.substring("key", 2, 32).cast("long").alias("node"), F.lit(True).alias("any"))
    met = trail_nodes(segs).withColumn("trail", F.lit(True))
    rows = pois.join(every, ["section_id", "node"], "left").join(met, ["section_id", "node"], "left")
    joined = (F.col("access") < 2) & F.coalesce(F.when(F.col("kind") == "trailhead", F.col("any")).otherwise(F.col("trail")), F.lit(False))
    return rows.select("section_id", "node", "kind", "access", "name", joined.alias("joined"))


def entrances(contacts: DataFrame, gates: DataFrame, pois: DataFrame, nodes: DataFrame, segs: DataFrame) -> DataFrame:
    """section_id, node, rank (2 trailhead, 1 parking, 0 road), access (rank): places where walks start.

    But for trailheads, an entrance needs `NETWORK` metres of supporting network.
    """
    bare = contacts.select("section_id", "node").union(gates.select("section_id", "node")).distinct()
    rows = bare.select("section_id", "node", F.lit(0).alias("rank"), F.lit(1).alias("access"))
    rows = rows.unionByName(pois.where("joined").select("section_id", "node", F.when(F.col("kind") == "trailhead", 2).otherwise(1).alias("rank"), "access"))
    # public evidence from any source holds; a name's rank says nothing about permission
    rows = rows.groupBy("section_id", "node").agg(F.max("rank").alias("rank"), F.min("access").alias("access"))
    gate = nodes.select("section_id", "node", rules.crossing(F.col("tags")).alias("pass"))
    rows = rows.join(gate, ["section_id", "node"]).withColumn("access", F.when(F.col("rank") > 0, F.greatest("access", "pass")).otherwise(F.lit(1))).drop("pass")
    long = supporting(segs).where(F.col("metres") >= NETWORK).select("section_id", "key").withColumn("long", F.lit(True))
    rows = rows.withColumn("key", F.concat(F.lit("n"), "node")).join(long, ["section_id", "key"], "left")
    return rows.where("rank = 2 or long").select("section_id", "node", "rank", "access")


def anchors(segs: DataFrame, starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """section_id, key: ends where corridors end: starts, cuts, barriers, ends of other degree than 2, changes of attributes."""
    side = lambda end, out, back: F.struct(F.col(end).alias("key"), F.col(out).alias("out"), F.col(back).alias("back"), F.col("connector").alias("road"))
    sides = segs.select("section_id", F.explode(F.array(side("a", "forward", "backward"), side("b", "backward", "forward"))).alias("e")).select("section_id", "e.*")
    per = sides.groupBy("section_id", "key").agg(F.count("*").alias("n"), F.min(F.struct("out", "back")).alias("x"), F.max(F.struct("out", "back")).alias("y"), F.countDistinct("road").alias("roads"))
    change = (F.col("n") != 2) | (F.col("roads") > 1) | (F.col("x.out") != F.col("y.back")) | (F.col("x.back") != F.col("y.out")) | F.col("key").startswith("frontier")
    found = per.where(change).select("section_id", "key")
    barred = nodes.where(F.col("tags")["barrier"].isNotNull()).select("section_id", F.concat(F.lit("n"), "node").alias("key"))
    own = starts.select("section_id", F.concat(F.lit("n"), "node").alias("key"))
    return found.union(per.select("section_id", "key").join(barred.union(own).distinct(), ["section_id", "key"], "left_semi")).distinct()


def corridors(segs: DataFrame, stops: DataFrame) -> DataFrame:
    """section_id, a, b, corridor, ring: each segment's chain between anchors, named by its least segment.

    Segments that meet at an end that is no anchor are of one chain; a chain without an anchor is a ring.
    """
    rows = stored(segs.select("section_id", "a", "b", F.xxhash64("section_id", "a", "b").alias("seg"), F.concat_ws("|", "a", "b").alias("text")))
    ends = rows.select("section_id", "seg", F.explode(F.array("a", "b")).alias("key"))
    through = ends.join(stops, ["section_id", "key"], "left_anti").groupBy("section_id", "key").agg(F.min("seg").alias("a"), F.max("seg").alias("b"))
    found = parts(through.where("a <> b").select("section_id", "a", "b"))
    named = rows.join(found.withColumnRenamed("node", "seg"), ["section_id", "seg"], "left").withColumn("component", F.coalesce("component", "seg"))
    held = ends.join(stops, ["section_id", "key"], "left_semi").select("section_id", "seg").distinct().withColumn("held", F.lit(True))
    named = named.join(held, ["section_id", "seg"], "left")
    each = named.groupBy("section_id", "component").agg(F.min("text").alias("corridor"), (~F.coalesce(F.bool_or("held"), F.lit(False))).alias("ring"))
    return named.select("section_id", "a", "b", "component").join(each, ["section_id", "component"]).select("section_id", "a", "b", "corridor", "ring")


def ring_anchors(chains: DataFrame) -> DataFrame:
    """section_id, key: the place where a ring without an anchor begins and ends, its least one."""
    keys = chains.where("ring").select("section_id", "corridor", F.explode(F.array("a", "b")).alias("key"))
    return keys.groupBy("section_id", "corridor").agg(F.min("key").alias("key")).select("section_id", "key")


def assembled(segs: DataFrame, stops: DataFrame, chains: DataFrame) -> DataFrame:
    """section_id, corridor, f, t (dense ids of ends), reverse, access, metres, connector: an edge for each direction that
    may be walked. Within a corridor permissions do not change, so those at its first end hold for all of it. A ring without an
    anchor leads from one of its places back to it."""
    stops = stops.select("section_id", "key").unionByName(ring_anchors(chains))
    text = F.concat_ws("|", "a", "b")
    side = lambda end, out, back: F.struct(F.col(end).alias("key"), F.col(out).alias("out"), F.col(back).alias("back"))
    rows = segs.join(chains.select("section_id", "a", "b", "corridor"), ["section_id", "a", "b"])
    total = rows.groupBy("section_id", "corridor").agg(F.sum("metres").alias("metres"), F.bool_or("connector").alias("connector"))
    sides = rows.select("section_id", "corridor", text.alias("text"), F.explode(F.array(side("a", "forward", "backward"), side("b", "backward", "forward"))).alias("e")).select("section_id", "corridor", "text", "e.*")
    first = F.concat_ws("|", "key", "text")
    tips = sides.join(stops, ["section_id", "key"], "left_semi").groupBy("section_id", "corridor").agg(F.min("key").alias("one"), F.max("key").alias("two"), F.min_by("out", first).alias("out"), F.min_by("back", first).alias("back"))
    tips = stored(tips)
    ids = tips.select("section_id", F.explode(F.array("one", "two")).alias("key")).distinct()
    ids = ids.withColumn("id", (F.dense_rank().over(Window.partitionBy("section_id").orderBy("key")) - 1).cast("long"))
    there = tips.where("out < 2").select("section_id", "corridor", F.col("one").alias("kf"), F.col("two").alias("kt"), F.lit(False).alias("reverse"), F.col("out").alias("access"))
    back = tips.where("back < 2").select("section_id", "corridor", F.col("two").alias("kf"), F.col("one").alias("kt"), F.lit(True).alias("reverse"), F.col("back").alias("access"))
    edges = there.unionByName(back).join(total, ["section_id", "corridor"])
    for k in ("f", "t"):
        edges = edges.join(ids.select("section_id", F.col("key").alias(f"k{k}"), F.col("id").alias(k)), ["section_id", f"k{k}"])
    return edges.select("section_id", "corridor", "f", "t", "reverse", "access", "metres", "connector")


def members(relations: DataFrame) -> DataFrame:
    """relation, way: the ways of each relation, also through relations in it; a cycle ends where it began.

    relations: relation, member (text: w or r, and an id).
    """
    rows = stored(relations.distinct())
    ways = rows.where("member like 'w%'").select("relation", F.substring("member", 2, 32).alias("way"))
    inner = rows.where("member like 'r%'").select("relation", F.substring("member", 2, 32).cast("long").alias("inner"))
    found = stored(rows.select("relation").distinct().select("relation", F.col("relation").alias("inner")))
    front = found
    while True:
        step = front.join(inner.toDF("inner", "next"), "inner").select("relation", F.col("next").alias("inner")).distinct()
        front = stored(step.join(found, ["relation", "inner"], "left_anti"))
        if front.isEmpty():
            break
        found = stored(found.unionByName(front))
    return found.join(ways.withColumnRenamed("relation", "inner"), "inner").select("relation", "way").distinct()


def developed(ways: DataFrame, nodes: DataFrame, areas: DataFrame, cell: float = 1e-2, share: float = 0.5) -> DataFrame:
    """section_id, id, inside, length, developed: walkways and the length of them, in degrees, in the union of the developed
    areas (boxes). Boxes meet segments by grid cell; a segment's parts are merged in their order."""
    t = F.col("tags")
    rows = pairs(ways.where(rules.is_in(t["highway"], rules.WALKWAYS) & rules.routable(t)).select("section_id", "id", "nodes"))
    at = nodes.select("section_id", "node", "lon", "lat")
    for k in ("l", "r"):
        rows = rows.join(at.toDF("section_id", k, f"{k}x", f"{k}y"), ["section_id", k])
    rows = rows.withColumn("length", F.hypot(F.col("rx") - F.col("lx"), F.col("ry") - F.col("ly")))
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    cells = rows.withColumn("cx", F.explode(span(F.least("lx", "rx"), F.greatest("lx", "rx")))).withColumn("cy", F.explode(span(F.least("ly", "ry"), F.greatest("ly", "ry"))))
    boxes = areas.withColumn("cx", F.explode(span(F.col("west"), F.col("east")))).withColumn("cy", F.explode(span(F.col("south"), F.col("north"))))
    hit = cells.join(boxes.select("cx", "cy", "west", "south", "east", "north"), ["cx", "cy"])
    low, high = F.lit(0.0), F.lit(1.0)
    for a, d, least, most in (("lx", F.col("rx") - F.col("lx"), "west", "east"), ("ly", F.col("ry") - F.col("ly"), "south", "north")):
        one, two = (F.col(least) - F.col(a)) / F.nullif(d, F.lit(0.0)), (F.col(most) - F.col(a)) / F.nullif(d, F.lit(0.0))
        still = (F.col(a) >= F.col(least)) & (F.col(a) <= F.col(most))
        low = F.greatest(low, F.when(d == 0, F.when(still, 0.0).otherwise(2.0)).otherwise(F.least(one, two)))
        high = F.least(high, F.when(d == 0, F.when(still, 1.0).otherwise(-1.0)).otherwise(F.greatest(one, two)))
    hit = hit.withColumn("low", low).withColumn("high", high).where("low < high").select("section_id", "id", "ordinal", "length", "low", "high").distinct()
    both = F.aggregate(F.array_sort(F.collect_list(F.struct("low", "high"))), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("end")), lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0.0), x.high - F.greatest(x.low, a.end))).alias("sum"), F.greatest(a.end, x.high).alias("end")), lambda a: a["sum"])
    part = hit.groupBy("section_id", "id", "ordinal", "length").agg(both.alias("share")).select("section_id", "id", "ordinal", (F.col("share") * F.col("length")).alias("part"))
    out = rows.join(part, ["section_id", "id", "ordinal"], "left").groupBy("section_id", "id").agg(F.sum(F.coalesce("part", F.lit(0.0))).alias("inside"), F.sum("length").alias("length"))
    return out.withColumn("developed", F.col("inside") >= share * F.col("length"))
