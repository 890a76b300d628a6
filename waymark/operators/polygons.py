"""Segments inside polygons with holes and several parts, and outlines of united areas.

Areas are tables of rings (area, ring, hole, points), as in spatial.py; a place lies inside if a ray from it crosses an odd number of
the area's edges, so holes and parts need no case of their own. Segments meet areas by grid cell and box, then every edge of
these: rows, not arrays, so an area of many points is no burden for one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .spatial import cells, ring_edges

#: Fractions closer than this are one.
TINY = 1e-12


def _met(segments: DataFrame, edges: DataFrame, keys: tuple[str, ...], cell: float) -> DataFrame:
    """keys, area of segments and areas whose boxes overlap."""
    box = edges.groupBy("area").agg(F.min("x1").alias("w"), F.max("x1").alias("e"), F.min("y1").alias("s"), F.max("y1").alias("n"))
    box = box.withColumn("cx", F.explode(cells("w", "e", cell))).withColumn("cy", F.explode(cells("s", "n", cell)))
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    own = segments.withColumn("cx", F.explode(cells(low("ax", "bx"), high("ax", "bx"), cell))).withColumn("cy", F.explode(cells(low("ay", "by"), high("ay", "by"), cell)))
    near = own.join(box, ["cx", "cy"]).where((low("ax", "bx") <= F.col("e")) & (high("ax", "bx") >= F.col("w")) & (low("ay", "by") <= F.col("n")) & (high("ay", "by") >= F.col("s")))
    return near.select(*keys, "area", "ax", "ay", "bx", "by").distinct()


def inside(segments: DataFrame, rings: DataFrame, *keys: str, cell: float = 0.05) -> DataFrame:
    """keys, area, low, high: the parts of each segment (keys, ax, ay, bx, by) inside each area, as fractions from a to b.

    A segment is cut where it crosses or touches an edge; a piece is inside if its middle is, and pieces that meet are one.
    """
    edges = stored(ring_edges(rings).where("x1 <> x2 or y1 <> y2"))
    met = stored(_met(segments, edges, keys, cell))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    px, py = F.col("x1") - F.col("ax"), F.col("y1") - F.col("ay")
    across = dx * ey - dy * ex
    at_t = (px * ey - py * ex) / F.nullif(across, F.lit(0.0))
    at_s = (px * dy - py * dx) / F.nullif(across, F.lit(0.0))
    square = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    along = lambda qx, qy: (qx * dx + qy * dy) / square
    level = (across == 0) & (px * dy - py * dx == 0)  # the edge lies on the segment's line: its ends cut
    crossed = F.when(at_s.between(0.0, 1.0), F.array(at_t)).when(level, F.array(along(px, py), along(F.col("x2") - F.col("ax"), F.col("y2") - F.col("ay"))))
    cuts = met.join(edges, "area").select(*keys, "area", F.explode(crossed).alias("t")).where("t > 0 and t < 1")
    ends = met.select(*keys, "area", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    order = Window.partitionBy(*keys, "area").orderBy("t")
    pieces = cuts.unionByName(ends).distinct().withColumn("high", F.lead("t").over(order)).where(F.col("high") - F.col("t") > TINY).withColumnRenamed("t", "low")
    pieces = stored(pieces.join(met, [*keys, "area"]).withColumn("mx", F.col("ax") + dx * ((F.col("low") + F.col("high")) / 2)).withColumn("my", F.col("ay") + dy * ((F.col("low") + F.col("high")) / 2)))
    ray = ((F.col("y1") > F.col("my")) != (F.col("y2") > F.col("my"))) & (F.col("mx") < ex * (F.col("my") - F.col("y1")) / F.nullif(ey, F.lit(0.0)) + F.col("x1"))
    held = pieces.join(edges, "area").groupBy(*keys, "area", "low", "high").agg(F.sum(F.when(ray, 1).otherwise(0)).alias("n")).where("n % 2 = 1")
    again = Window.partitionBy(*keys, "area").orderBy("low")
    new = F.when(F.col("low") - F.lag("high").over(again) <= TINY, 0).otherwise(1)
    runs = held.withColumn("new", new).withColumn("run", F.sum("new").over(again))
    return runs.groupBy(*keys, "area", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def outline(rings: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, x1, y1, x2, y2: the edges around the union of each group's areas. Areas of a group share whole edges or none; a
    shared edge is in two of them and goes. rings: area, ring, hole, points. groups: area, group_id."""
    edges = ring_edges(rings).where("x1 <> x2 or y1 <> y2").join(groups, "area")
    one, two = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    pair = edges.withColumn("u", F.least(one, two)).withColumn("v", F.greatest(one, two))
    return pair.groupBy("group_id", "u", "v").agg(F.count("*").alias("n"), F.first("x1").alias("x1"), F.first("y1").alias("y1"), F.first("x2").alias("x2"), F.first("y2").alias("y2")).where("n % 2 = 1").select("group_id", "x1", "y1", "x2", "y2")


def stitched(edges: DataFrame) -> DataFrame:
    """group_id, ring (its least corner as text), edges, length, area: the rings of an outline; counter-clockwise ones, of positive
    area, lie around, the others are holes. Edges keep the direction they had in their area, so the area needs no order."""
    from ..plans.topology import labelled

    corner = lambda x, y: F.concat_ws(" ", F.col(x).cast("string"), F.col(y).cast("string"))
    rows = stored(edges.withColumn("a", corner("x1", "y1")).withColumn("b", corner("x2", "y2")))
    found = labelled(rows.select(F.col("group_id").alias("section_id"), "a", "b")).withColumnRenamed("section_id", "group_id")
    named = rows.join(found.select("group_id", F.col("node").alias("a"), "component"), ["group_id", "a"])
    turn = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    return named.groupBy("group_id", "component").agg(F.min("a").alias("ring"), F.count("*").alias("edges"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"), F.sum(turn).alias("area")).drop("component")
