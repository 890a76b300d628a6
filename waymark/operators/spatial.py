"""Geometry as column expressions: distance, rings, boxes, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import stored

DIAMETER = 12_742_017.6
TOLERANCE = 1e-12


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on the sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * DIAMETER


def ring_edges(rings: DataFrame) -> DataFrame:
    """area, ring, hole, x1, y1, x2, y2 from rings (area, ring, hole, points: array<struct<x,y>>), open or closed."""
    after = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    rows = rings.select("area", "ring", "hole", F.explode(F.arrays_zip(F.col("points").alias("p"), after.alias("q"))).alias("e"))
    return rows.select("area", "ring", "hole", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))


def crossing(x: Column, y: Column) -> Column:
    """Whether a ray to the right from (x, y) crosses the edge."""
    above = (F.col("y1") > y) != (F.col("y2") > y)
    return above & (x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))


def on_edge(x: Column, y: Column) -> Column:
    """Whether (x, y) lies on the edge, within the tolerance."""
    cross = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    return (F.abs(cross) <= TOLERANCE) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))


def cells(low: str | Column, high: str | Column, cell: float) -> Column:
    """Numbers of the grid cells from low to high."""
    number = lambda x: F.floor((F.col(x) if isinstance(x, str) else x) / cell)
    return F.sequence(number(low), number(high))


def points_in_areas(points: DataFrame, rings: DataFrame, *keys: str, cell: float = 0.1) -> DataFrame:
    """keys, area for points (keys, lon, lat) in an outer ring and not strictly in a hole; edges, also of holes, are inside.

    The grid cell is the join key; points then meet only areas whose box holds them.
    """
    edges = ring_edges(rings)
    box = edges.where("not hole").groupBy("area").agg(F.min("x1").alias("w"), F.max("x1").alias("e"), F.min("y1").alias("s"), F.max("y1").alias("n"))
    box = box.withColumn("cx", F.explode(cells("w", "e", cell))).withColumn("cy", F.explode(cells("s", "n", cell)))
    at = points.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell))
    near = at.join(box, ["cx", "cy"]).where(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n"))).drop("cx", "cy")
    x, y = F.col("lon"), F.col("lat")
    held = near.join(edges, "area").groupBy(*keys, "area", "ring", "hole").agg((F.sum(F.when(crossing(x, y), 1).otherwise(0)) % 2 == 1).alias("odd"), F.max(on_edge(x, y)).alias("on"))
    verdict = held.groupBy(*keys, "area").agg(F.max(~F.col("hole") & (F.col("odd") | F.col("on"))).alias("inside"), F.max(F.col("hole") & F.col("odd") & ~F.col("on")).alias("cut"))
    return verdict.where("inside and not cut").select(*keys, "area")


def signed_area(points: str) -> Column:
    """Shoelace: positive for counter-clockwise rings."""
    p = F.col(points)
    after = F.concat(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, 1))
    return F.aggregate(F.arrays_zip(p.alias("p"), after.alias("q")), F.lit(0.0), lambda a, e: a + e.p.x * e.q.y - e.q.x * e.p.y) / 2


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Closed boxes (west, south, east, north) that share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def lerp_lon(a: Column, b: Column, t: Column) -> Column:
    """Between two longitudes the short way round, in [-180, 180)."""
    turn = F.pmod(b - a + 540, F.lit(360.0)) - 180
    return F.pmod(a + turn * t + 540, F.lit(360.0)) - 180


def bilinear(points: DataFrame, pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, height of points (keys, r, c: fractional row and column); null if a pixel with weight is missing or masked.

    Only pixels beside a point are joined: where many points share few of them, these are small enough to be sent to the points,
    and the rest of a raster goes nowhere.
    """
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("k")
    w = points.select("*", corner).withColumn("row", F.floor("r") + F.col("k.i")).withColumn("col", F.floor("c") + F.col("k.j"))
    share = lambda x, k: F.when(k == 1, x - F.floor(x)).otherwise(1 - (x - F.floor(x)))
    w = w.withColumn("weight", share(F.col("r"), F.col("k.i")) * share(F.col("c"), F.col("k.j"))).where(F.col("weight") > 1e-12)
    beside = points.select(F.floor("r").alias("row"), F.floor("c").alias("col")).distinct().select("row", "col", corner)
    beside = beside.select((F.col("row") + F.col("k.i")).alias("row"), (F.col("col") + F.col("k.j")).alias("col")).distinct()
    held = stored(pixels.join(beside.hint("merge"), ["row", "col"], "left_semi"))
    w = w.join(held, ["row", "col"], "left")
    return w.groupBy(*keys).agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("weight") * F.col("value"))).alias("height"))


def within(points: DataFrame, others: DataFrame, metres: float, cell: float, keys: list[str]) -> DataFrame:
    """points beside the others (lon2, lat2) within a distance. `cell`, in degrees, must be at least as wide as that distance."""
    grid = lambda df: df.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = grid(points).withColumn("k", F.explode(steps)).withColumn("cx", F.col("cx") + F.col("k.i")).withColumn("cy", F.col("cy") + F.col("k.j")).drop("k")
    held = grid(others).select(*keys, "cx", "cy", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return spread.join(held, [*keys, "cx", "cy"]).drop("cx", "cy").where(haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) <= metres)


def ring_errors(rings: DataFrame) -> DataFrame:
    """id, error of drawn rings (id, points): null for a sound one. A ring has 128 points at most, so its edges meet in pairs."""
    seq = rings.select(F.col("id").alias("area"), F.size("points").alias("n"))
    numbered = rings.where(F.size("points").between(3, 128)).select(F.col("id").alias("area"), F.posexplode(F.arrays_zip(F.col("points").alias("p"), F.concat(F.slice("points", 2, F.size("points")), F.slice("points", 1, 1)).alias("q"))).alias("i", "e"))
    e = numbered.join(seq, "area").select("area", "n", "i", *(F.col(f"e.{a}.{c}").alias(f"{c}{k}") for a, k in (("p", 1), ("q", 2)) for c in "xy"))
    f = e.select("area", *(F.col(c).alias(f"{c}_") for c in ("i", "x1", "y1", "x2", "y2")))
    side = lambda ax, ay, bx, by, px, py: F.signum((F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax)))
    cross = (side("x1", "y1", "x2", "y2", "x1_", "y1_") * side("x1", "y1", "x2", "y2", "x2_", "y2_") < 0) & (side("x1_", "y1_", "x2_", "y2_", "x1", "y1") * side("x1_", "y1_", "x2_", "y2_", "x2", "y2") < 0)
    crossed = e.join(f, "area").where("i_ > i").groupBy("area").agg(F.bool_or(cross).alias("crossed"))
    rows = rings.select(F.col("id").alias("area"), "points", F.size("points").alias("n"), F.size(F.array_distinct("points")).alias("u"), signed_area("points").alias("turn")).join(crossed, "area", "left")
    error = F.when(~F.col("n").between(3, 128), "needs 3 to 128 points").when(F.col("u") < F.col("n"), "repeats a point").when(F.col("crossed"), "crosses itself").when(F.abs("turn") <= TOLERANCE, "has no area")
    return rows.select(F.col("area").alias("id"), error.alias("error"))


def local_metres(lon: Column, lat: Column, at: Column) -> tuple[Column, Column]:
    """Differences in degrees as metres on a plane around a latitude."""
    return lon * 111320 * F.cos(F.radians(at)), lat * 110540


def beside(starts: DataFrame, lots: DataFrame, metres: float, cell: float = 0.1) -> DataFrame:
    """section_id, start_id, lot: other starts within some metres of lots, on the plane around each lot.

    Grid cells of `cell` degrees, which are wider than the distance, are the join key.
    """
    grid = lambda df: df.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell))
    near = F.sequence(F.lit(-1), F.lit(1))
    around = grid(lots).select("section_id", F.col("start_id").alias("lot"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.explode(near).alias("i"))
    around = around.withColumn("j", F.explode(near)).select("section_id", "lot", "x", "y", (F.col("ax") + F.col("i")).alias("cx"), (F.col("ay") + F.col("j")).alias("cy"))
    dx, dy = local_metres(F.col("x") - F.col("lon"), F.col("y") - F.col("lat"), F.col("y"))
    hit = grid(starts).join(around, ["section_id", "cx", "cy"]).where((F.col("lot") != F.col("start_id")) & (F.sqrt(dx * dx + dy * dy) <= metres))
    return hit.select("section_id", "start_id", "lot")
