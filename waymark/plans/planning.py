"""Plans of sections: which roads cut a region whose network is too large, with as few lesser roads as possible.

A region's segments are counted once by cell: the side of every candidate road on which they lie. All subsets of the lesser roads
(at most `LESSER`) are then tried at once, as a table of (region, subset) with the region's cells: one road after the other, in order, cuts every section that
is still too large and lies on both of its sides. The best subset is the least by (excess, lesser roads used, roads used in order).
The table has 2^LESSER rows for each region at most, whatever the number of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LESSER = 12


def dividers(road_points: DataFrame) -> DataFrame:
    """region, ref, x1, y1, x2, y2, axis: each road from its western to its eastern end, or from south to north if it is longer
    that way (axis 1). Ties of ends go to the smaller other coordinate. road_points: region, ref, x, y."""
    span = road_points.groupBy("region", "ref").agg(
        *(f(F.struct(a, b)).alias(n) for n, f, a, b in (("west", F.min, "x", "y"), ("east", F.max, "x", "y"), ("south", F.min, "y", "x"), ("north", F.max, "y", "x")))
    )
    flat = (F.col("east.x") - F.col("west.x")) >= (F.col("north.y") - F.col("south.y"))
    pick = lambda one, two, c: F.when(flat, F.col(f"{one}.{c}")).otherwise(F.col(f"{two}.{c}"))
    ends = span.select("region", "ref", pick("west", "south", "x").alias("x1"), pick("west", "south", "y").alias("y1"), pick("east", "north", "x").alias("x2"), pick("east", "north", "y").alias("y2"), F.when(flat, 0).otherwise(1).alias("axis"))
    return ends.where("x1 <> x2 or y1 <> y2")


def cells(points: DataFrame, lines: DataFrame) -> DataFrame:
    """region, refs (of all its roads, in order), sides (bit i: 0 left of refs[i], 1 right of it or on it), n: segments by the sides
    on which they begin.

    points: region, x, y. A region has a bounded number of candidate roads, so its cells are few and are counted before the shuffle;
    what is counted is a number for each cell, so that a task holds little of it.
    """
    roads = lines.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("ref", "x1", "y1", "x2", "y2"))).alias("roads"))
    right = F.transform("roads", lambda r, i: F.when((r.x2 - r.x1) * (F.col("y") - r.y1) - (r.y2 - r.y1) * (F.col("x") - r.x1) > 0, F.lit(0)).otherwise(F.pow(F.lit(2), i)).cast("long"))
    counted = points.join(roads, "region").select("region", F.aggregate(right, F.lit(0).cast("long"), lambda a, x: a + x).alias("sides")).groupBy("region", "sides").agg(F.count("*").alias("n"))
    return counted.join(roads.select("region", F.transform("roads", lambda r: r.ref).alias("refs")), "region").select("region", "refs", "sides", "n")


def subsets(lines: DataFrame, freeway: str = "^I") -> DataFrame:
    """region, chosen: the freeways with every subset of the other roads. More than LESSER of these fail the plan."""
    kinds = lines.groupBy("region").agg(F.array_sort(F.collect_list(F.when(F.col("ref").rlike(freeway), F.col("ref")))).alias("first"), F.array_sort(F.collect_list(F.when(~F.col("ref").rlike(freeway), F.col("ref")))).alias("rest"))
    some = kinds.withColumn("rest", F.when(F.size("rest") > LESSER, F.raise_error(F.lit(f"more than {LESSER} lesser roads: narrow the candidates"))).otherwise(F.col("rest")))
    rows = some.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.size("rest")).cast("long") - 1)))
    picked = F.transform(F.filter(F.transform("rest", lambda r, i: F.struct(r.alias("ref"), i.alias("i"))), lambda s: F.floor(F.col("k") / F.pow(F.lit(2), s.i)).cast("long") % 2 == 1), lambda s: s.ref)
    return rows.select("region", "k", "first", picked.alias("lesser"))


def cut(counted: DataFrame, chosen: DataFrame, order: list[str], cap: int) -> DataFrame:
    """region, k, sections (of each: label, the cuts in order as ref and side, and size): every subset applied.

    order: all refs of all regions, freeways first. A road cuts what it was chosen for, is too large, and lies on both its sides.
    A region's few cells are one row, which is cut by itself: nothing is sorted or shuffled for a road, and no task holds more
    than the rows that it passes on. Rows are dealt by number: they are small at first, and would meet in one task.
    """
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = counted.groupBy("region").agg(F.first("refs").alias("refs"), F.collect_list(F.struct("sides", "n")).alias("cells"))
    rows = chosen.select("region", "k", F.concat("first", "lesser").alias("roads")).repartition(parts, "region").join(held.hint("merge"), "region")
    whole = F.struct(F.array().cast("array<struct<ref:string,side:int>>").alias("label"), F.col("cells").alias("cells"))
    rows = rows.select("region", "k", "roads", "refs", F.array(whole).alias("sections"))
    for ref in order:
        rows = rows.withColumn("sections", F.flatten(F.transform("sections", lambda s: _parted(s, ref, cap))))  # noqa: B023
    return rows.select("region", "k", F.transform("sections", lambda s: F.struct(s.label.alias("label"), _held(s.cells).alias("size"))).alias("sections"))


def _held(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c.n)


def _parted(section: Column, ref: str, cap: int) -> Column:
    """A section's two parts beside a road, or itself alone."""
    bit = F.pow(F.lit(2), F.array_position("refs", ref) - 1).cast("long")
    side = lambda c: F.floor(c.sides / bit).cast("int") % 2
    label = lambda k: F.concat(section.label, F.array(F.struct(F.lit(ref).alias("ref"), F.lit(k).alias("side"))))
    part = lambda k: F.struct(label(k).alias("label"), F.filter(section.cells, lambda c: side(c) == k).alias("cells"))
    cuts = F.array_contains("roads", ref) & F.array_contains("refs", ref) & (_held(section.cells) > cap)
    cuts &= F.exists(section.cells, lambda c: side(c) == 0) & F.exists(section.cells, lambda c: side(c) == 1)
    return F.when(cuts, F.array(part(0), part(1))).otherwise(F.array(section))


def excess(cap: int) -> Column:
    """Segments beyond the cap in all `sections`."""
    return F.aggregate("sections", F.lit(0).cast("long"), lambda a, s: a + F.greatest(s["size"] - cap, F.lit(0)))


def planned(applied: DataFrame, cap: int, order: list[str], freeway: str = "^I") -> DataFrame:
    """The best subset's sections: region, k, label, size, excess, lesser_used, used. applied: as cut() gives it."""
    refs = F.flatten(F.transform("sections", lambda s: F.transform(s.label, lambda c: c.ref)))
    score = applied.select("region", "k", excess(cap).alias("excess"), refs.alias("refs"))
    score = score.withColumn("used", F.filter(F.array(*map(F.lit, order)), lambda r: F.array_contains("refs", r)))
    score = score.withColumn("lesser_used", F.size(F.filter("used", lambda r: ~r.rlike(freeway))))
    best = score.groupBy("region").agg(F.min(F.struct("excess", "lesser_used", "used", "k")).alias("m"))
    rows = applied.join(best.select("region", "m.*"), ["region", "k"]).withColumn("s", F.explode("sections"))
    return rows.select("region", "k", "s.label", "s.size", "excess", "lesser_used", "used")


def named(plan: DataFrame, lines: DataFrame, cap: int) -> DataFrame:
    """region, section_id, name, segments, status, roads: a section's name by its sides, its id by what it is (not by its place in
    the plan), and whether it is ready or still too large."""
    axis = lines.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("ref", "axis"))).alias("axes"))
    word = lambda c: F.when(F.col("axes")[c.ref] == 0, F.when(c.side == 0, "north").otherwise("south")).otherwise(F.when(c.side == 0, "west").otherwise("east"))
    text = F.array_join(F.transform("label", lambda c: F.concat_ws(" ", word(c), F.lit("of"), c.ref)), ", ")
    rows = plan.join(axis, "region").withColumn("name", F.when(F.size("label") > 0, text).otherwise("whole region"))
    ident = F.substring(F.sha2(F.concat_ws(":", F.col("region").cast("string"), "name"), 256), 1, 24)
    return rows.select("region", ident.alias("section_id"), "name", F.col("size").alias("segments"), F.when(F.col("size") <= cap, "ready").otherwise("unresolved").alias("status"), F.array_join("used", ",").alias("roads"))
