"""Compiled sections on small maps: order of corridors, rings, points, climbs, edges; whole walks with their way back."""

import hashlib

import pytest
from pyspark.sql import functions as F

from waymark.operators import results, walks
from waymark.plans import compiled, topology

SEG = "section_id long, a string, b string, forward int, backward int, connector boolean, metres double"


@pytest.fixture(scope="module")
def built(spark):
    """A chain n1-n5-n2-n9 of three segments, a ring n3-n4-n8 without an anchor, a loop n6-n7-n60 at the anchor n6, a lone road."""
    rows = [("n1", "n5", 0, 1), ("n2", "n5", 1, 0), ("n2", "n9", 0, 1), ("n3", "n4", 0, 0), ("n4", "n8", 0, 0), ("n3", "n8", 0, 0), ("n6", "n7", 0, 2), ("n60", "n7", 2, 0), ("n6", "n60", 2, 0), ("n6", "n70", 0, 0)]
    segs = spark.createDataFrame([(0, a, b, f, g, b == "n70", 10.0) for a, b, f, g in rows], SEG)
    nodes = spark.createDataFrame([(0, n, 0.0, 0.0, None) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 60, 70)], "section_id long, node long, lon double, lat double, tags map<string,string>")
    stops = topology.anchors(segs, nodes.where("false").select("section_id", "node"), nodes)
    chains = topology.corridors(segs, stops)
    return segs, compiled.every_stop(stops, chains), chains


def test_corridors_are_walked_in_order(spark, built):
    found = {}
    for r in sorted(compiled.traversed(*built).collect(), key=lambda r: r.pos):
        found.setdefault(r.corridor, []).append((r.tail, r.head, r.turned))
    ways = sorted(tuple([w[0][0], *(h for _, h, _ in w)]) for w in found.values())
    assert ways == [("n1", "n5", "n2", "n9"), ("n3", "n4", "n8", "n3"), ("n6", "n60", "n7", "n6"), ("n6", "n70")]
    assert [t for *_, t in found["n1|n5"]] == [False, True, False]


def test_edges_of_corridors_and_their_names(spark, built):
    segs = built[0]
    up = segs.select("section_id", "a", "b", F.lit(3.0).alias("up"), F.lit(1.0).alias("down"))
    found = compiled.trails(segs, compiled.traversed(*built), up)
    by_way = {(r.one, r.two): r for r in found.collect()}
    chain = by_way["n1", "n9"]
    assert (chain.dist, chain.gain_out, chain.gain_back, chain.pieces, chain.out, chain.back) == (30.0, 7.0, 5.0, 3, 0, 1)
    assert chain.corridor_id == hashlib.sha256(b"n1|n5|n2|n9").hexdigest()[:24]
    edges = {(r.trail, r.f, r.t, r.reverse): (r.dist, r.gain, r.access, r.connector) for r in compiled.edges(found).collect()}
    ids = {r.key: r.id for r in compiled.end_ids(found).collect()}
    ring = by_way["n3", "n3"]
    assert edges[ring.trail, ids["n3"], ids["n3"], False][0] == 30.0 and edges[chain.trail, ids["n9"], ids["n1"], True] == (30.0, 5.0, "unknown", False)
    loop = by_way["n6", "n6"]
    assert [k[3] for k in edges if k[0] == loop.trail] == [True]  # it may be walked one way only
    doors = spark.createDataFrame([(0, 1, 2, 0), (0, 6, 0, 1), (0, 9, 1, 2), (0, 5, 2, 0)], "section_id long, node long, rank int, access int")
    assert {(r.start_id, r.node, r.access, r.kind_rank) for r in compiled.starts(found, doors).collect()} == {(1, ids["n1"], "public", 0), (6, ids["n6"], "unknown", 2)}
    one = compiled.audit(found, doors).first()
    assert (one.trails, one.roads, one.segments, one.metres, one.rings, one.cuts, one.starts) == (4, 1, 10, 100.0, 2, 0, 2)


def test_points_and_climbs(spark):
    segs = spark.createDataFrame([(0, "n1", "n2", 60.0), (0, "frontier:n1:n2:250000000", "n2", 10.0)], "section_id long, a string, b string, metres double")
    nodes = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 4.0, 0.0)], "section_id long, node long, lon double, lat double")
    at = compiled.places(segs.select("section_id", F.explode(F.array("a", "b")).alias("key")).distinct(), nodes)
    assert {(r.key, r.lon) for r in at.collect()} == {("n1", 0.0), ("n2", 4.0), ("frontier:n1:n2:250000000", 1.0)}
    points = compiled.densified(segs, at)
    assert sorted((r.a, r.i, round(r.lon, 6)) for r in points.collect()) == [("frontier:n1:n2:250000000", 0, 1.0), ("frontier:n1:n2:250000000", 1, 4.0), ("n1", 0, 0.0), ("n1", 1, round(4 / 3, 6)), ("n1", 2, round(8 / 3, 6)), ("n1", 3, 4.0)]
    pixels = spark.createDataFrame([(0, c, float(v)) for c, v in enumerate((0, 10, 4, 4, 8, 0))] + [(1, c, 0.0) for c in range(6)], "row long, col long, value double")
    found = {r.a: (round(r.up, 6), round(r.down, 6)) for r in compiled.climbs(points, pixels, F.col("lat"), F.col("lon")).collect()}
    assert found == {"n1": (12.0, 4.0), "frontier:n1:n2:250000000": (0.0, 2.0)}
    with pytest.raises(Exception, match="point without a height"):
        compiled.climbs(points, pixels.where("col <> 4"), F.col("lat"), F.col("lon")).collect()


def test_whole_walks_hold_the_way_back_and_names_weigh_the_circuit(spark):
    rows = [("r", 2, "1+,2-,3+,4+"), ("s", 0, "3+,4+")]
    routes = spark.createDataFrame([(0, k, 9, n, it) for k, n, it in rows], "section_id long, route_id string, start_id long, stem_steps int, itinerary string").withColumn("itinerary", walks.whole())
    assert {r.route_id: r.itinerary for r in routes.collect()} == {"r": "1+,2-,3+,4+,2+,1-", "s": "3+,4+"}
    trails = spark.createDataFrame([(0, 1, "A", 50.0, False), (0, 2, "B", 10.0, True), (0, 3, "C", 5.0, False), (0, 4, None, 7.0, False)], "section_id long, trail long, name string, dist double, connector boolean")
    weights = results.name_weights(results.steps(routes), trails, routes)
    assert {(r.route_id, r.name, r.metres, r.place) for r in weights.collect()} == {("r", "C", 5.0, 1), ("r", "A", 0.0, 2), ("s", "C", 5.0, 1)}
    starts = spark.createDataFrame([(0, 9, "Gate")], "section_id long, start_id long, name string")
    assert {(r.route_id, r.title) for r in results.display_names(weights.where("route_id = 'r'"), routes, starts).collect()} == {("r", "C / A"), ("s", "Gate")}
