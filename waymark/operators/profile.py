"""Elevation profiles: cumulative distance, climb, high points, interpolation and sustained grade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 100.0


def samples(trails: DataFrame, nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """section_id, trail, seq, d, h along each trail: its first node, the interior vertices at equal steps, its last node."""
    count = vertices.groupBy("section_id", "trail").agg(F.count("*").alias("n"))
    base = trails.join(count, ["section_id", "trail"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    height = nodes.select("section_id", "node", F.col("ele").alias("h"))
    first = base.withColumnRenamed("a", "node").join(height, ["section_id", "node"], "left").select("section_id", "trail", F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("d"), "h")
    last = base.withColumnRenamed("b", "node").join(height, ["section_id", "node"], "left").select("section_id", "trail", (F.col("n") + 1).alias("seq"), F.col("dist").alias("d"), "h")
    inner = vertices.join(base.select("section_id", "trail", "dist", "n"), ["section_id", "trail"]).select("section_id", "trail", "seq", (F.col("dist") * F.col("seq") / (F.col("n") + 1)).alias("d"), F.col("ele").alias("h"))
    return first.unionByName(inner).unionByName(last)


def climbs(profile: DataFrame) -> DataFrame:
    """Gain and loss of each trail (null with any unknown height) and its highest point (null likewise)."""
    rise = F.col("h") - F.lag("h").over(Window.partitionBy("section_id", "trail").orderBy("seq"))
    known = F.count("h") == F.count("*")
    rows = profile.withColumn("rise", rise).groupBy("section_id", "trail")
    return rows.agg(F.when(known, F.sum(F.greatest("rise", F.lit(0.0)))).alias("gain"), F.when(known, F.sum(F.greatest(-F.col("rise"), F.lit(0.0)))).alias("loss"), F.when(known, F.max("h")).alias("peak"))


def intervals(profile: DataFrame) -> DataFrame:
    """Neighbouring samples as intervals d0..d1 with heights h0, h1; those of no length are left out."""
    w = Window.partitionBy("section_id", "trail").orderBy("seq")
    rows = profile.select("section_id", "trail", "seq", F.lag("d").over(w).alias("d0"), F.lag("h").over(w).alias("h0"), F.col("d").alias("d1"), F.col("h").alias("h1"))
    return rows.where("d1 > d0")


KEY = ("section_id", "trail")


def heights_at(profile: DataFrame, places: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """places (key, at and others) with the height there: a sample's, or linear between the two around it, null if one of
    these is unknown. Samples and places are merged in one sorted stream, so a profile is read once."""
    others = [c for c in places.columns if c not in (*key, "at")]
    sample = F.struct(F.col("d").alias("d"), F.col("h").alias("h"))
    none = [F.lit(None).cast(places.schema[c].dataType).alias(c) for c in others]
    rows = profile.select(*key, F.col("d").alias("at"), F.col("seq"), F.lit(1).alias("kind"), sample.alias("sample"), *none)
    rows = rows.unionByName(places.select(*key, "at", F.lit(None).cast(profile.schema["seq"].dataType).alias("seq"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["sample"].dataType).alias("sample"), *others))
    # a place stands before the samples at its distance: the next one is then the first at or behind it
    before = F.last("sample", True).over(Window.partitionBy(*key).orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0))
    behind = F.last("sample", True).over(Window.partitionBy(*key).orderBy(F.col("at").desc(), F.col("kind").desc(), F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("x", before).withColumn("y", behind).where("kind = 0")
    between = F.col("x.h") + (F.col("y.h") - F.col("x.h")) * (F.col("at") - F.col("x.d")) / F.nullif(F.col("y.d") - F.col("x.d"), F.lit(0.0))
    return rows.select(*key, "at", *others, F.when(F.col("y.d") == F.col("at"), F.col("y.h")).otherwise(between).alias("height"))


def exposure(profile: DataFrame, above: float, window: float = WINDOW, sign: int = 1, key: Sequence[str] = KEY) -> DataFrame:
    """For each profile: metres whose mean grade over the window around them exceeds `above` (times `sign`: -1 for descents),
    and the longest run of them.

    The grade over a window, clipped at the ends, is linear between breakpoints (samples shifted by half a window), so each
    interval has at most one crossing, found exactly. Unknown heights give null. All steps are dealt by the key, once.
    """
    half, key = window / 2, list(key)
    w = Window.partitionBy(*key)
    points = profile.withColumn("length", F.max("d").over(w)).withColumn("known", F.count("h").over(w) == F.count("*").over(w))
    ends = points.groupBy(*key).agg(F.first("length").alias("length"), F.first("known").alias("known"))
    points = points.where("known and length > 0")
    breaks = points.select(*key, "length", F.explode(F.array(F.lit(0.0), F.col("length"), F.col("d") - half, F.col("d") + half)).alias("mid")).where("mid >= 0 and mid <= length").distinct()
    sides = F.array(F.struct(F.lit(0).alias("side"), F.greatest(F.col("mid") - half, F.lit(0.0)).alias("at")), F.struct(F.lit(1).alias("side"), F.least(F.col("mid") + half, F.col("length")).alias("at")))
    asked = breaks.select(*key, "mid", F.explode(sides).alias("s")).select(*key, "mid", "s.side", "s.at")
    h = heights_at(points.select(*key, "seq", "d", "h"), asked, key)
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    # the excess: rise less what `above` allows over the window; its sign is the sign of grade - above
    span = h.groupBy(*key, "mid").agg((sign * (at(1, "height") - at(0, "height")) - above * (at(1, "at") - at(0, "at"))).alias("excess")).withColumn("excess", F.round("excess", 9))
    order = Window.partitionBy(*key).orderBy("mid")
    part = span.withColumn("next_mid", F.lead("mid").over(order)).withColumn("next_excess", F.lead("excess").over(order)).where("next_mid > mid")
    cross = F.col("mid") + (F.col("next_mid") - F.col("mid")) * F.col("excess") / F.when(F.col("excess") != F.col("next_excess"), F.col("excess") - F.col("next_excess"))
    start = F.when(F.col("excess") > 0, F.col("mid")).when(F.col("next_excess") > 0, cross)
    stop = F.when(F.col("next_excess") > 0, F.col("next_mid")).when(F.col("excess") > 0, cross)
    runs = part.withColumn("from", start).withColumn("to", stop).where("from is not null and to > from")
    again = Window.partitionBy(*key).orderBy("from")
    runs = runs.withColumn("new", F.when(F.col("from") <= F.lag("to").over(again) + 1e-9, 0).otherwise(1)).withColumn("run", F.sum("new").over(again))
    per = runs.groupBy(*key, "run").agg(F.sum(F.col("to") - F.col("from")).alias("metres"))
    found = per.groupBy(*key).agg(F.sum("metres").alias("total"), F.max("metres").alias("longest"))
    return ends.join(found, key, "left").select(*key, F.when(F.col("known"), F.coalesce("total", F.lit(0.0))).alias("total"), F.when(F.col("known"), F.coalesce("longest", F.lit(0.0))).alias("longest"))


def selection(profile: DataFrame, places: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """key, from, to, distance, gain, loss, grade (per cent) of the part of each profile between two places.

    places: key, one, two (in any order, clipped to the profile). An unknown height in it gives null; an empty part no row.
    """
    key = list(key)
    length = profile.groupBy(*key).agg(F.max("d").alias("length"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.col("length"), c))
    span = places.join(length, key).select(*key, clip(F.least("one", "two")).alias("from"), clip(F.greatest("one", "two")).alias("to")).where("from < to")
    asked = span.select(*key, "from", "to", F.explode(F.array("from", "to")).alias("at"))
    ends = heights_at(profile, asked, key).select(*key, "from", "to", "at", F.lit(0).cast("long").alias("seq"), F.col("height").alias("h"))
    inner = profile.join(span, key).where("d > from and d < to").select(*key, "from", "to", F.col("d").alias("at"), F.col("seq").cast("long").alias("seq"), "h")
    rows = ends.unionByName(inner)
    rise = F.col("h") - F.lag("h").over(Window.partitionBy(*key, "from", "to").orderBy("at", "seq"))
    known = F.count("h") == F.count("*")
    out = rows.withColumn("rise", rise).groupBy(*key, "from", "to").agg(F.when(known, F.sum(F.greatest("rise", F.lit(0.0)))).alias("gain"), F.when(known, F.sum(F.greatest(-F.col("rise"), F.lit(0.0)))).alias("loss"), F.when(known, F.max_by("h", "at") - F.min_by("h", "at")).alias("net"))
    size = F.col("to") - F.col("from")
    return out.select(*key, "from", "to", size.alias("distance"), "gain", "loss", (100 * F.col("net") / size).alias("grade"))


def walk_profile(steps: DataFrame, profile: DataFrame, walk: str = "route_id") -> DataFrame:
    """section_id, walk, seq, d, h of ordered steps (section_id, walk, seq, trail, reverse): their trails one after the other,
    turned where they are walked back, each join once."""
    length = profile.groupBy("section_id", "trail").agg(F.max("d").alias("length"), F.max("seq").alias("last"))
    rows = steps.join(length, ["section_id", "trail"])
    order = Window.partitionBy("section_id", walk).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0.0))).withColumnRenamed("seq", "step")
    rows = rows.join(profile, ["section_id", "trail"])
    place = F.when(F.col("reverse"), F.col("last") - F.col("seq")).otherwise(F.col("seq"))
    along = F.when(F.col("reverse"), F.col("length") - F.col("d")).otherwise(F.col("d"))
    rows = rows.withColumn("place", place).where("step = 0 or place > 0")
    return rows.select("section_id", walk, (F.col("step") * 1_000_000 + F.col("place")).alias("seq"), (F.col("offset") + along).alias("d"), "h")


def grades_at(profile: DataFrame, places: DataFrame, window: float = WINDOW) -> DataFrame:
    """section_id, trail, grade (per cent) over the window around each place, clipped at the ends; null with an unknown height in it."""
    key = ["section_id", "trail"]
    length = profile.groupBy(*key).agg(F.max("d").alias("length"))
    span = places.join(length, key).withColumn("lo", F.greatest(F.col("at") - window / 2, F.lit(0.0))).withColumn("hi", F.least(F.col("at") + window / 2, F.col("length")))
    asked = span.select(*key, F.col("lo").alias("at")).unionByName(span.select(*key, F.col("hi").alias("at"))).distinct()
    h = heights_at(profile, asked)
    span = span.join(h.withColumnsRenamed({"at": "lo", "height": "h_lo"}), [*key, "lo"]).join(h.withColumnsRenamed({"at": "hi", "height": "h_hi"}), [*key, "hi"])
    unknown = profile.where("h is null").select(*key, "d").join(span.select(*key, "lo", "hi"), key).where("d between lo and hi").select(*key, F.lit(True).alias("unknown")).distinct()
    grade = 100 * (F.col("h_hi") - F.col("h_lo")) / (F.col("hi") - F.col("lo"))
    return span.join(unknown, key, "left").select(*key, F.when(F.col("unknown").isNull(), grade).alias("grade"))
