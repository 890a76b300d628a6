"""Section files: gzipped JSON lines with checksums, and map records in a text format."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType


def write_geometry(vertices: DataFrame, folder: str) -> None:
    """One gzip file for each section, a JSON array of positions in each line; the line's number is the trail's id.

    vertices: section_id, trail, seq, lon, lat, ele. A trail without vertices is an empty array.
    """
    lines = vertices.groupBy("section_id", "trail").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat", "ele"))).alias("p"))
    last = lines.groupBy("section_id").agg(F.max("trail").alias("n")).select("section_id", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("trail"))
    text = F.to_json(F.transform(F.coalesce("p", F.array().cast("array<struct<seq:bigint,lon:double,lat:double,ele:double>>")), lambda x: F.when(x.ele.isNull(), F.array(x.lon, x.lat)).otherwise(F.array(x.lon, x.lat, x.ele))))
    rows = last.join(lines, ["section_id", "trail"], "left").select("section_id", "trail", text.alias("value"))
    rows.repartition("section_id").sortWithinPartitions("section_id", "trail").drop("trail").write.partitionBy("section_id").option("compression", "gzip").mode("overwrite").text(folder)


def read_geometry(spark: SparkSession, folder: str, trails: DataFrame | None = None) -> DataFrame:
    """section_id, trail, coordinates; of the given trails (section_id, trail) only. A malformed line fails the scan.

    A gzip file is read by one task from its start, so rows come in the order of lines and their number is the trail.
    """
    lines = spark.read.text(folder).withColumn("file", F.col("_metadata.file_path")).withColumn("at", F.monotonically_increasing_id())
    lines = lines.withColumn("trail", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).cast("long"))
    if trails is not None:
        lines = lines.join(trails, ["section_id", "trail"], "left_semi")
    return lines.select(F.col("section_id").cast("long").alias("section_id"), "trail", F.from_json("value", "array<array<double>>", {"mode": "FAILFAST"}).alias("coordinates"))


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(pinned: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose size or checksum is not the pinned one, or that are only on one side."""
    both = pinned.alias("p").join(now.alias("n"), "path", "full")
    return both.where("not (p.bytes <=> n.bytes and p.sha256 <=> n.sha256)").select("path")


_ESCAPE = re.compile("%([0-9a-fA-F]+)%")


def decoded(text: str) -> str:
    """Text with %hex% code points in place; surrogates are refused."""

    def one(match: re.Match) -> str:
        code = int(match[1], 16)
        if 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
            raise ValueError(f"no character: {match[0]}")
        return chr(code)

    return _ESCAPE.sub(one, text)


@F.pandas_udf(MapType(StringType(), StringType()))
def tag_map(text: pd.Series) -> pd.Series:
    """Tags from 'key=value,key=value', split before escapes are decoded."""
    pairs = lambda t: {decoded(k): decoded(v) for k, _, v in (p.partition("=") for p in t.split(",") if p)}
    return text.map(lambda t: pairs(t or ""))


def map_records(lines: DataFrame) -> DataFrame:
    """kind, id, tags, nodes from lines of key-letter fields such as 'w12 Thighway=path,name=A%20%B Nn1,n2'."""
    fields = F.split("value", " ")
    field = lambda k: F.element_at(F.filter(fields, lambda f: F.substring(f, 1, 1) == k), 1)
    rest = lambda c: F.substring(c, 2, 1 << 30)
    rows = lines.where("value rlike '^[nwr]'").select(F.substring("value", 1, 1).alias("kind"), rest(fields[0]).cast("long").alias("id"), rest(field("T")).alias("t"), rest(field("N")).alias("n"))
    refs = F.transform(F.filter(F.split(F.coalesce("n", F.lit("")), ","), lambda x: x != ""), lambda x: F.regexp_replace(x, "^n", "").cast("long"))
    return rows.select("kind", "id", tag_map("t").alias("tags"), refs.alias("nodes"))


def way_segments(ways: DataFrame) -> DataFrame:
    """id, seq, u, v: neighbouring nodes of each way."""
    rows = ways.select("id", F.posexplode("nodes").alias("seq", "u"))
    return rows.withColumn("v", F.lead("u").over(Window.partitionBy("id").orderBy("seq"))).where("v is not null").select("id", F.col("seq").cast("long").alias("seq"), "u", "v")


def way_locations(lines: DataFrame) -> DataFrame:
    """id, points (node, lon, lat) of way records whose node references carry places; one without a place fails the query."""
    form = r"^n(-?\d+)x([^y]+)y(.+)$"
    rows = lines.where("value rlike '^w'").select(F.substring(F.split("value", " ")[0], 2, 32).cast("long").alias("id"), F.regexp_extract("value", r" N(\S*)", 1).alias("n"))
    part = lambda x, i: F.regexp_extract(x, form, i)
    point = lambda x: F.struct(F.when(x.rlike(form), part(x, 1).cast("long")).otherwise(F.raise_error(F.concat(F.lit("no place: "), x)).cast("long")).alias("node"), part(x, 2).cast("double").alias("lon"), part(x, 3).cast("double").alias("lat"))
    return rows.select("id", F.transform(F.filter(F.split("n", ","), lambda x: x != ""), point).alias("points"))


#: The character that begins each text of a GeoJSON sequence.
SEPARATOR = "\x1e"


def write_geojson_sequence(shapes: DataFrame, folder: str) -> None:
    """shapes (id, coordinates of a polygon) as lines of features."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("id").alias("properties"), geometry.alias("geometry"))
    shapes.select(F.concat(F.lit(SEPARATOR), F.to_json(feature)).alias("value")).write.mode("overwrite").text(folder)


def read_geojson_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """id, coordinates of the polygons in a GeoJSON text sequence; a malformed text fails the scan."""
    schema = "type string, properties struct<id: bigint>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    lines = spark.read.text(folder).select(F.ltrim(F.regexp_replace("value", SEPARATOR, "")).alias("value")).where("value <> ''")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("f")).select("f.properties.id", "f.geometry.coordinates")
