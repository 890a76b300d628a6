"""Operator 4: a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into `SEGMENTS` equal segments. Every shard has virtual nodes on it; a document's
id is hashed to a segment, and the next virtual node clockwise owns it. No shard may hold more than
(1 + slack) times the mean load: what overflows a full shard continues clockwise to the next one
that has room, so the loads are near equal and only overflowing keys leave their place.

Only the segments' byte totals (at most SEGMENTS rows, whatever the input) reach the driver. The
result is a list of byte ranges within segments, at most SEGMENTS + shards * virtual nodes rows.

Null text counts 0 bytes, a null id hashes like any value, repeated rows are placed one by one.
Law `bytes`: sizes of shards near equal.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEGMENTS, VIRTUAL_NODES, SLACK = 16384, 256, 0.0005


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(segment, shard) of each virtual node, clockwise."""
    nodes = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            place = int.from_bytes(hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest(), "big") % segments
            nodes.setdefault(place, shard)
    return sorted(nodes.items())


def bounded(loads: dict[int, int], shards: int, nodes: list[tuple[int, int]], slack: float = SLACK) -> list[tuple[int, int, int, int]]:
    """(segment, from byte, to byte, shard) so that no shard holds more than (1 + slack) of the mean."""
    room = [-(-int(sum(loads.values()) * (1 + slack)) // shards) + 1] * shards
    out, i = [], 0
    for segment in sorted(loads):
        while i < len(nodes) and nodes[i][0] < segment:
            i += 1
        at, k = 0, i
        while at < loads[segment]:
            shard = nodes[k % len(nodes)][1]
            if part := min(room[shard], loads[segment] - at):
                room[shard] -= part
                out.append((segment, at, at + part, shard))
                at += part
            k += 1
    return out


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = F.xxhash64(F.col(id_col))
    narrow = stored(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("place"), F.pmod(place, F.lit(SEGMENTS)).cast("int").alias("segment")), "narrow")
    loads = {r.segment: r.size for r in narrow.groupBy("segment").agg(F.sum("size").alias("size")).collect()}  # at most SEGMENTS rows
    ranges = spark.createDataFrame(bounded(loads, shards, ring(shards, virtual_nodes), slack), "segment int, low long, high long, shard int")
    order = Window.partitionBy("segment").orderBy("place", "doc_id", "size", "text_crc32")
    placed = narrow.withColumn("rank", F.row_number().over(order)).withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    middle = F.col("before") + F.floor(F.col("size") / 2)
    placed = stored(placed.join(F.broadcast(ranges.withColumnRenamed("segment", "s")), (F.col("segment") == F.col("s")) & (middle >= F.col("low")) & (middle < F.col("high"))).select("doc_id", "size", "text_crc32", "segment", "rank", "low", "shard"), "placed")
    # rows of a range are neighbours by rank, so a slot is the rank in the range after all earlier ranges of the shard
    ends = placed.groupBy("segment", "low", "shard").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    ends = ends.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("segment", "low").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    return placed.join(F.broadcast(ends.drop("n")), ["segment", "low", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
