"""Preparation of a network: combined permissions, merged segments, counts by area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combined(access: str | Column) -> Column:
    """The strictest of several permissions, as a rank: public 0, unknown 1, prohibited 2."""
    access = F.col(access) if isinstance(access, str) else access
    return F.max(F.when(access == "prohibited", 2).when(access == "unknown", 1).otherwise(0))


def merged_segments(trails: DataFrame) -> DataFrame:
    """One row for each pair of nodes: the strictest access, a road if any is one, the shortest length."""
    return trails.groupBy("section_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(combined("access").alias("access_rank"), F.bool_or("connector").alias("connector"), F.min("dist").alias("dist"), F.count("*").alias("copies"))


def segment_counts(trails: DataFrame, nodes: DataFrame, areas: DataFrame, most: int = 700_000, cell: float = 4e-2) -> DataFrame:
    """Trails that begin in each area, and whether the area fits; a grid cell is the join key, the box the condition."""
    at = nodes.withColumn("cx", F.floor((F.col("lon") + 180) / cell)).withColumn("cy", F.floor((F.col("lat") + 90) / cell))
    span = lambda low, high, shift: F.sequence(F.floor((F.col(low) + shift) / cell), F.floor((F.col(high) + shift) / cell))
    cells = areas.withColumn("cx", F.explode(span("west", "east", 180))).withColumn("cy", F.explode(span("south", "north", 90)))
    held = at.join(cells.select("area_id", "west", "south", "east", "north", "cx", "cy"), ["cx", "cy"]).where("lon >= west and lon < east and lat >= south and lat < north")
    rows = held.select("area_id", "section_id", F.col("node").alias("a")).join(trails.select("section_id", "a"), ["section_id", "a"])
    return rows.groupBy("area_id").agg(F.count("*").alias("segments")).withColumn("fits", F.col("segments") <= most)


def access_name(rank: str | Column) -> Column:
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.when(rank == 0, "public").when(rank == 1, "unknown").otherwise("prohibited")


def start_kinds(starts: DataFrame) -> DataFrame:
    """One start for each node: the best kind, its name, and whether any of them is open."""
    kind = F.when(F.min("kind_rank") == 0, "trailhead").when(F.min("kind_rank") == 1, "parking").otherwise("road-contact")
    return starts.groupBy("section_id", "node").agg(kind.alias("kind"), F.min_by("name", F.struct("kind_rank", "start_id")).alias("name"), F.bool_or(F.col("access") == "public").alias("open"))
