"""Saved results: pages, comparison order, names, locations, paths, routes and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import xml_escape
from .graph import components, stored

PAGE = 50
SORTS = ("distance", "gain", "repetition", "road")


def page(routes: DataFrame, sort: str = "distance", descending: bool = False, number: int = 0) -> DataFrame:
    """One page in the order of a metric, ties by id."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort}")
    return routes.orderBy(F.col(sort).desc() if descending else F.col(sort).asc(), "route_id").offset(PAGE * number).limit(PAGE)


def compared(routes: DataFrame, sort: str, descending: bool = False) -> DataFrame:
    """place of each route in the order of a metric, nulls last both ways, ties by id upwards, within its section."""
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return routes.withColumn("place", F.row_number().over(Window.partitionBy("section_id").orderBy(key, F.col("route_id").asc())).cast("long"))


def pinned_first(routes: DataFrame, pins: DataFrame) -> DataFrame:
    """Routes with `pinned`, and their place: pinned ones first, each once."""
    rows = routes.join(pins.select("route_id").distinct().withColumn("pinned", F.lit(True)), "route_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("section_id").orderBy(F.col("pinned").desc(), "distance", "route_id")).cast("long"))


def steps(routes: DataFrame) -> DataFrame:
    """One row for each step: route_id, section_id, seq, trail, reverse, from an itinerary of trails and signs."""
    rows = routes.select("section_id", "route_id", F.posexplode(F.split("itinerary", ",")).alias("seq", "s"))
    return rows.select("section_id", "route_id", F.col("seq").cast("long").alias("seq"), F.regexp_replace("s", "[+-]", "").cast("long").alias("trail"), F.col("s").endswith("-").alias("reverse"))


def name_weights(route_steps: DataFrame, trails: DataFrame, routes: DataFrame) -> DataFrame:
    """Metres of each path name on each route's circuit, and its place: longest first, ties by first appearance.

    A name that is on the stem only has no metres. routes: section_id, route_id, stem_steps, itinerary (the way back included).
    """
    span = routes.select("section_id", "route_id", F.col("stem_steps").alias("first"), (F.size(F.split("itinerary", ",")) - F.col("stem_steps")).alias("end"))
    rows = route_steps.join(trails.where("name is not null and not connector").select("section_id", "trail", "name", "dist"), ["section_id", "trail"]).join(span, ["section_id", "route_id"])
    core = F.when((F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("end")), F.col("dist")).otherwise(0.0)
    sums = rows.groupBy("route_id", "name").agg(F.sum(core).alias("metres"), F.min("seq").alias("first_seq"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("route_id").orderBy(F.col("metres").desc(), "first_seq")).cast("long"))


def display_names(weights: DataFrame, routes: DataFrame, starts: DataFrame) -> DataFrame:
    """route_id, title: the first two names of each route, else that of its start."""
    two = F.array_sort(F.collect_list(F.struct("place", "name")))
    named = weights.where("place <= 2").groupBy("route_id").agg(F.array_join(F.transform(two, lambda x: x["name"]), " / ").alias("title"))
    begun = routes.select("section_id", "route_id", "start_id").join(starts.select("section_id", "start_id", F.col("name").alias("start")), ["section_id", "start_id"], "left")
    return begun.join(named, "route_id", "left").select("route_id", F.coalesce("title", "start", F.lit("Unnamed trails")).alias("title"))


def shared_paths(route_steps: DataFrame, routes: DataFrame) -> DataFrame:
    """section_id, trail, place, route_id: the routes that use each trail, each once, the shortest first."""
    rows = route_steps.select("section_id", "trail", "route_id").distinct().join(routes.select("route_id", "distance"), "route_id")
    place = F.row_number().over(Window.partitionBy("section_id", "trail").orderBy("distance", "route_id"))
    return rows.select("section_id", "trail", place.cast("long").alias("place"), "route_id")


def extents(route_steps: DataFrame, trails: DataFrame, nodes: DataFrame) -> DataFrame:
    """The box of each route's nodes, and its highest one (null if any height is unknown)."""
    ends = route_steps.join(trails.select("section_id", "trail", "a", "b"), ["section_id", "trail"]).select("section_id", "route_id", F.explode(F.array("a", "b")).alias("node"))
    rows = ends.distinct().join(nodes, ["section_id", "node"], "left")
    return rows.groupBy("route_id").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.when(F.count("ele") == F.count("*"), F.max("ele")).alias("peak"))


def joined_geometry(route_steps: DataFrame, trails: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of each route in order, the join of two steps once: route_id, seq, node, lon, lat, ele."""
    t = route_steps.join(trails.select("section_id", "trail", "a", "b"), ["section_id", "trail"])
    t = t.withColumn("from", F.when(F.col("reverse"), F.col("b")).otherwise(F.col("a"))).withColumn("to", F.when(F.col("reverse"), F.col("a")).otherwise(F.col("b")))
    first = t.where("seq = 0").select("section_id", "route_id", F.lit(0).cast("long").alias("seq"), F.col("from").alias("node"))
    rest = t.select("section_id", "route_id", (F.col("seq") + 1).alias("seq"), F.col("to").alias("node"))
    return first.unionByName(rest).join(nodes, ["section_id", "node"], "left").select("route_id", "seq", "node", "lon", "lat", "ele")


def broken_steps(route_steps: DataFrame, trails: DataFrame) -> DataFrame:
    """Steps that do not start where the step before ended (none in a sound result)."""
    t = route_steps.join(trails.select("section_id", "trail", "a", "b"), ["section_id", "trail"])
    t = t.withColumn("from", F.when(F.col("reverse"), F.col("b")).otherwise(F.col("a"))).withColumn("to", F.when(F.col("reverse"), F.col("a")).otherwise(F.col("b")))
    return t.withColumn("before", F.lag("to").over(Window.partitionBy("route_id").orderBy("seq"))).where("before is not null and before <> from")


def gpx_point(lon: Column, lat: Column, ele: Column) -> Column:
    """A track point; without a height, no height element."""
    text = lambda c: F.format_string("%.6f", c)
    return F.concat(F.lit('<trkpt lat="'), text(lat), F.lit('" lon="'), text(lon), F.lit('">'), F.when(ele.isNotNull(), F.concat(F.lit("<ele>"), F.format_string("%.1f", ele), F.lit("</ele>"))).otherwise(""), F.lit("</trkpt>"))


def gpx(geometry: DataFrame, names: DataFrame) -> DataFrame:
    """route_id, gpx: one track for each route. geometry: route_id, seq, lon, lat, ele. names: route_id, title."""
    points = geometry.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", gpx_point(F.col("lon"), F.col("lat"), F.col("ele")).alias("p")))).alias("points"))
    body = F.array_join(F.transform("points", lambda x: x.p), "")
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="waymark" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return points.join(names, "route_id", "left").select("route_id", F.concat(F.lit(head), xml_escape(F.coalesce("title", F.lit("Walk"))), F.lit("</name><trkseg>"), body, F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def _ends(steps: DataFrame, trails: DataFrame) -> DataFrame:
    """Steps with the nodes they lead from (f) and to (t)."""
    rows = steps.join(trails.select("section_id", "trail", "a", "b"), ["section_id", "trail"])
    return rows.withColumn("f", F.when(F.col("reverse"), F.col("b")).otherwise(F.col("a"))).withColumn("t", F.when(F.col("reverse"), F.col("a")).otherwise(F.col("b"))).drop("a", "b")


def walks_of_steps(steps: DataFrame, trails: DataFrame, *key: str) -> DataFrame:
    """key, walk: each walk in one row, its steps as (seq, f, t)."""
    return _ends(steps, trails).groupBy(*key).agg(_visits().alias("walk"))


def gaps(steps: DataFrame, trails: DataFrame, key: Sequence[str] = ("route_id", "variant")) -> DataFrame:
    """key, seq of steps that do not begin where the one before ended."""
    before = F.lag("t").over(Window.partitionBy(*key).orderBy("seq"))
    return _ends(steps, trails).withColumn("before", before).where("before <> f").select(*key, "seq")


def verified(steps: DataFrame, trails: DataFrame, key: Sequence[str] = ("route_id", "variant")) -> DataFrame:
    """key, joined, closed, distinct_trails of each walk."""
    before = F.lag("t").over(Window.partitionBy(*key).orderBy("seq"))
    rows = _ends(steps, trails).withColumn("fits", F.coalesce(before == F.col("f"), F.lit(True)))
    return rows.groupBy(*key).agg(F.bool_and("fits").alias("joined"), (F.min_by("f", "seq") == F.max_by("t", "seq")).alias("closed"), (F.countDistinct("trail") == F.count("*")).alias("distinct_trails"))


def first_repeats(steps: DataFrame, trails: DataFrame, key: Sequence[str] = ("route_id", "variant")) -> DataFrame:
    """key, first_repeat: the step by which each walk comes to a node for the second time."""
    return first_returns(walks_of_steps(steps, trails, *key), "walk", *key)


def _visits() -> Column:
    """A walk's steps as (seq, f, t); it has as many as its limit of length allows."""
    return F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("f"), F.col("t")))


def first_returns(rows: DataFrame, walk: str, *key: str) -> DataFrame:
    """key, first_repeat of walks that are one row each, with their steps as (seq, f, t) in any order: no step is shuffled again."""
    begin = F.transform(F.filter(walk, lambda x: x.seq == 0), lambda x: F.struct(F.lit(-1).cast("long").alias("seq"), x.f.alias("node")))
    visits = F.array_sort(F.concat(begin, F.transform(walk, lambda x: F.struct(x.seq.alias("seq"), x.t.alias("node")))))
    # a visit is a repeat if its node's first visit lies before it
    nodes = F.transform("visits", lambda x: x.node)
    again = F.filter(F.transform("visits", lambda x, i: F.when(F.array_position("nodes", x.node) <= i, x.seq)), lambda x: x.isNotNull())
    return rows.select(*key, visits.alias("visits")).withColumn("nodes", nodes).select(*key, F.array_min(again).alias("first_repeat")).where("first_repeat is not null")


def drawing_groups(steps: DataFrame, trails: DataFrame) -> DataFrame:
    """route_id, trail, piece (its least trail), name: trails that follow each other under one name are one piece."""
    rows = stored(steps.join(trails.select("section_id", "trail", "name"), ["section_id", "trail"]))
    order = Window.partitionBy("route_id").orderBy("seq")
    after = rows.withColumn("next", F.lead("trail").over(order)).withColumn("next_name", F.lead("name").over(order)).where("name = next_name").select("route_id", F.col("trail").alias("a"), F.col("next").alias("b"))
    turn = rows.groupBy("route_id").agg(F.max_by("trail", "seq").alias("a"), F.min_by("trail", "seq").alias("b"), F.max_by("name", "seq").alias("x"), F.min_by("name", "seq").alias("y")).where("x = y").select("route_id", "a", "b")
    found = components(after.unionByName(turn).select(F.col("route_id").alias("section_id"), "a", "b")).toDF("route_id", "trail", "piece")
    each = rows.select("route_id", "trail", "name").distinct().join(found, ["route_id", "trail"], "left")
    return each.select("route_id", "trail", F.coalesce("piece", "trail").alias("piece"), F.when(F.col("name").isNull(), "Trail name unavailable").when(F.col("name") == "", "Unnamed trail").otherwise(F.col("name")).alias("name"))


def trail_identities(trails: DataFrame, nodes: DataFrame) -> DataFrame:
    """section_id, trail, text, identity: the ends' positions in order, the length, and a rank among twins, hashed."""
    at = nodes.select("section_id", "node", F.concat_ws(",", scalars.plain_number("lon"), scalars.plain_number("lat")).alias("at"))
    rows = trails.join(at.toDF("section_id", "a", "at_a"), ["section_id", "a"]).join(at.toDF("section_id", "b", "at_b"), ["section_id", "b"])
    rows = rows.withColumn("base", F.concat_ws(";", F.least("at_a", "at_b"), F.greatest("at_a", "at_b"), F.floor(F.col("dist") + 0.5)))
    rank = F.row_number().over(Window.partitionBy("section_id", "base").orderBy("trail")) - 1
    rows = rows.withColumn("rank", rank).withColumn("text", F.when(F.col("rank") > 0, F.concat_ws("#", "base", "rank")).otherwise(F.col("base")))
    return rows.select("section_id", "trail", "text", scalars.fnv1a("text").alias("identity"))


def store(routes: DataFrame, steps: DataFrame, folder: str) -> None:
    """Saves a search: its routes, each used trail once, and the counts, which are written last."""
    routes.write.mode("overwrite").parquet(f"{folder}/routes")
    steps.select("section_id", "trail").distinct().write.mode("overwrite").parquet(f"{folder}/geometry")
    spark = routes.sparkSession
    kept = spark.read.parquet(f"{folder}/routes").groupBy("section_id").agg(F.count("*").alias("routes"), F.sum("distance").alias("metres"))
    drawn = spark.read.parquet(f"{folder}/geometry").groupBy("section_id").agg(F.count("*").alias("geometries"))
    kept.join(drawn, "section_id").write.mode("overwrite").parquet(f"{folder}/counts")


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    """section_id, routes, geometries, metres as saved."""
    return spark.read.parquet(f"{folder}/counts").select("section_id", "routes", "geometries", "metres")
