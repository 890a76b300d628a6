"""Rules of the search, of preparation and of texts on small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import scalars
from waymark.operators import catalog, profile, results, walks
from waymark.plans import tags as rules
from waymark.plans import topology

EDGE = "section_id long, trail long, f long, t long, reverse boolean, dist double, gain double, access string, connector boolean"


def two_way(trail, f, t, dist, **more):
    a = {"gain": 0.0, "access": "public", "connector": False} | more
    return [(0, trail, x, y, r, dist, a["gain"], a["access"], a["connector"]) for x, y, r in ((f, t, False), (t, f, True))]


def start(spark, node):
    return spark.createDataFrame([(0, 7, node, "x", "public", 0)], "section_id long, start_id long, node long, name string, access string, kind_rank long")


@pytest.mark.parametrize("other, similar", [((1, 2, 3, 4, 9), True), ((2, 1, 3, 4, 9), False), ((4, 3, 2, 1, 9), True), ((3, 4, 8, 1, 2), True)])
def test_similar_circuits_share_trails_in_one_cyclic_order(spark, other, similar):
    circuits = spark.createDataFrame([(0, "a", [1, 2, 3, 4, 5]), (0, "b", list(other))], "section_id long, circuit string, core_trails array<bigint>")
    lengths = spark.createDataFrame([(0, i, 100.0) for i in range(1, 10)], "section_id long, trail long, dist double")
    assert walks.similarity(circuits, lengths).count() == int(similar)


def test_similarity_matches_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    cores = {f"c{k:02d}": [int(x) for x in rng.permutation(9)[: rng.integers(2, 7)]] for k in range(40)}
    dist = {i: float(rng.integers(50, 300)) for i in range(9)}

    def canonical(core):
        turns = [c[i:] + c[:i] for c in (core, core[::-1]) for i in range(len(core))]
        return min(turns)

    want = set()
    for a in cores:
        for b in cores:
            shared = set(cores[a]) & set(cores[b])
            if a < b and sum(dist[t] for t in shared) >= 0.6 * max(sum(dist[t] for t in cores[a]), sum(dist[t] for t in cores[b])) and canonical([t for t in cores[a] if t in shared]) == canonical([t for t in cores[b] if t in shared]):
                want.add((a, b))
    circuits = spark.createDataFrame([(0, k, c) for k, c in cores.items()], "section_id long, circuit string, core_trails array<bigint>")
    found = walks.similarity(circuits, spark.createDataFrame([(0, t, d) for t, d in dist.items()], "section_id long, trail long, dist double"))
    assert {(r.a, r.b) for r in found.collect()} == want and want
    ranked = circuits.select("section_id", "circuit", F.substring("circuit", 2, 2).cast("int").alias("place"))
    heads, group = [], {}
    for c in sorted(cores):  # one after the other
        group[c] = next((h for h in heads if (h, c) in want), None)
        if group[c] is None:
            heads.append(c)
            group[c] = c
    assert {r.circuit: r.group_circuit for r in walks.distinct_hikes(ranked, found).collect()} == group


def test_a_longer_road_with_the_same_trails_is_beaten(spark):
    """Roads of 50 and 120 metres lead to one trail circuit: the walk over the longer one goes."""
    rows = two_way(0, 0, 1, 50.0, connector=True) + two_way(1, 0, 1, 120.0, connector=True) + two_way(2, 1, 2, 100.0) + two_way(3, 2, 3, 100.0) + two_way(4, 3, 1, 100.0)
    q = walks.Query(max_road=None, max_road_share=None)
    every = walks.closed_walks(spark.createDataFrame(rows, EDGE), start(spark, 0), q)
    trails_once = every.where("size(core_trails) = 3")
    assert {r.road for r in trails_once.collect()} == {100.0, 240.0}
    assert {r.road for r in walks.normalized(trails_once, q).collect()} == {100.0}
    # a substitute must itself be within the upper limits, but may be below the lower ones
    assert {r.road for r in walks.normalized(trails_once, walks.Query(min_distance=450.0, max_road=None, max_road_share=None)).collect()} == set()


PERMISSIONS = [
    ({}, None, 1), ({"foot": "yes"}, None, 0), ({"access": "private"}, None, 2), ({"foot": "yes", "access": "private"}, None, 0), ({"foot": "no", "access": "yes"}, None, 2),
    ({"foot": "yes", "foot:conditional": "no @ night"}, None, 1), ({"foot:forward": "no", "foot": "yes"}, "forward", 2), ({"foot:forward": "no", "foot": "yes"}, "backward", 0), ({"foot": "yes", "access:conditional": "no @ x"}, None, 0),
]


def tagged(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, tags map<string,string>")


def test_permissions(spark):
    for side in (None, "forward", "backward"):
        some = [(t, want) for t, s, want in PERMISSIONS if s == side]
        found = {r.id: r.p for r in tagged(spark, [t for t, _ in some]).select("id", rules.permission(F.col("tags"), side).alias("p")).collect()}
        assert [found[i] for i in range(len(some))] == [want for _, want in some]


def test_directions_and_roles(spark):
    cases = [
        ({"highway": "motorway", "access": "yes"}, (2, 2)), ({"highway": "motorway", "foot": "yes"}, (0, 0)), ({"highway": "path", "foot": "yes", "oneway": "yes"}, (0, 1)),
        ({"highway": "track", "foot": "yes", "oneway": "yes"}, (0, 0)), ({"highway": "path", "foot": "yes", "oneway:foot": "yes"}, (0, 2)), ({"highway": "path", "foot": "yes", "oneway:foot": "-1"}, (2, 0)), ({"highway": "path", "foot": "yes", "oneway:foot": "alternating"}, (1, 1)),
    ]
    one, two = rules.directions(F.col("tags"))
    found = {r.id: (r.f, r.b) for r in tagged(spark, [t for t, _ in cases]).select("id", one.alias("f"), two.alias("b")).collect()}
    assert [found[i] for i in range(len(cases))] == [want for _, want in cases]


def test_crossings_and_barriers(spark):
    cases = [({}, 0, False), ({"barrier": "gate"}, 1, False), ({"barrier": "wall"}, 2, True), ({"barrier": "wall", "foot": "yes"}, 0, True), ({"barrier": "gate", "locked": "yes"}, 1, True), ({"barrier": "bollard", "motor_vehicle": "yes"}, 1, False), ({"amenity": "parking", "access": "private"}, 0, False), ({"access": "private"}, 2, False)]
    found = {r.id: (r.c, r.s) for r in tagged(spark, [t for t, _, _ in cases]).select("id", rules.crossing(F.col("tags")).alias("c"), rules.stops_cars(F.col("tags")).alias("s")).collect()}
    assert [found[i] for i in range(len(cases))] == [(c, s) for _, c, s in cases]


def small_map(spark, ways, nodes):
    w = spark.createDataFrame([(0, k, n, t) for k, (n, t) in enumerate(ways)], "section_id long, id long, nodes array<bigint>, tags map<string,string>")
    n = spark.createDataFrame([(0, k, k * 1e-3, 0.0, nodes.get(k)) for k in range(12)], "section_id long, node long, lon double, lat double, tags map<string,string>")
    return w, n


RING = ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))


def test_cars_stop_at_barriers_and_gaps_are_unknown(spark):
    """A public road 0-1, a service road 1-2-3-4 with a bollard at 2, and a service road 6-7 joined to nothing."""
    ways = [([0, 1], {"highway": "residential"}), ([1, 2, 3, 4], {"highway": "service", "oneway": "yes"}), ([6, 7], {"highway": "service"})]
    found = {r.node: (r.reach, r.gate) for r in topology.car_reach(*small_map(spark, ways, {2: {"barrier": "bollard"}}), RING).collect()}
    assert found == {0: ("open", False), 1: ("open", False), 2: ("open", True), 3: ("closed", False), 4: ("closed", False), 6: ("unknown", False), 7: ("unknown", False)}


def test_duplicate_segments_take_the_strictest(spark):
    ways = [([0, 1, 2], {"highway": "path", "foot": "yes", "name": "B"}), ([2, 1], {"highway": "footway", "footway": "sidewalk", "foot:forward": "no", "foot": "yes", "name": "A"}), ([5, 6], {"highway": "path", "foot": "no"})]
    found = {(r.a, r.b): r for r in topology.segments(*small_map(spark, ways, {}), RING).collect()}
    assert set(found) == {("n0", "n1"), ("n1", "n2")}
    both = found["n1", "n2"]
    assert (both.forward, both.backward, both.connector, both.names, both.copies) == (0, 2, True, ["A", "B"], 2)


def test_segments_are_cut_at_the_footprint(spark):
    ring = ((-1.0, -1.0), (1.25e-3, -1.0), (1.25e-3, 1.0), (-1.0, 1.0))
    found = {(r.a, r.b) for r in topology.segments(*small_map(spark, [([0, 1, 2, 3], {"highway": "path"})], {}), ring).collect()}
    assert found == {("n0", "n1"), ("frontier:n1:n2:250000000", "n1")}


def test_relations_in_a_cycle(spark):
    rows = spark.createDataFrame([(1, "w10"), (1, "r2"), (2, "w20"), (2, "r1"), (3, "r1"), (3, "n5")], "relation long, member string")
    found = {(r.relation, r.way) for r in topology.members(rows).collect()}
    assert found == {(k, w) for k in (1, 2, 3) for w in ("10", "20")}


def test_corridors_end_at_anchors_and_rings_have_none(spark):
    rows = [(0, a, b, 0, 0, False, 1.0) for a, b in (("n1", "n2"), ("n2", "n3"), ("n3", "n4"), ("n3", "n5"), ("n7", "n8"), ("n8", "n9"), ("n7", "n9"))]
    segs = spark.createDataFrame(rows, "section_id long, a string, b string, forward int, backward int, connector boolean, metres double")
    _, nodes = small_map(spark, [([0, 1], {"highway": "path"})], {})
    stops = topology.anchors(segs, nodes.where("false").select("section_id", "node"), nodes)
    assert {r.key for r in stops.collect()} == {"n1", "n3", "n4", "n5"}
    found = {(r.a, r.b): (r.corridor, r.ring) for r in topology.corridors(segs, stops).collect()}
    assert found["n1", "n2"] == found["n2", "n3"] == ("n1|n2", False) and found["n3", "n4"][0] != found["n3", "n5"][0]
    assert {found[k] for k in (("n7", "n8"), ("n8", "n9"), ("n7", "n9"))} == {("n7|n8", True)}
    edges = {(r.corridor, r.f, r.t, r.reverse, r.metres) for r in topology.assembled(segs, stops, topology.corridors(segs, stops)).collect()}
    assert {e for e in edges if e[0] == "n7|n8"} == {("n7|n8", 4, 4, False, 3.0), ("n7|n8", 4, 4, True, 3.0)} and len(edges) == 8


def _profile(spark, points):
    return spark.createDataFrame([(0, 0, i, float(d), None if h is None else float(h)) for i, (d, h) in enumerate(points)], "section_id long, trail long, seq long, d double, h double")


def test_selection_of_a_profile(spark):
    p = _profile(spark, ((0, 0), (100, 10), (200, 0), (300, 30)))
    asked = spark.createDataFrame([(0, 0, 250.0, 50.0), (0, 0, -9.0, 999.0), (0, 0, 40.0, 40.0)], "section_id long, trail long, one double, two double")
    found = {r["from"]: (r.to, r.distance, r.gain, r.loss, r.grade) for r in profile.selection(p, asked).collect()}
    assert found == {50.0: (250.0, 200.0, pytest.approx(20.0), pytest.approx(10.0), pytest.approx(5.0)), 0.0: (300.0, 300.0, 40.0, 10.0, pytest.approx(10.0))}
    gap = _profile(spark, ((0, 0), (100, None), (200, 0)))
    assert profile.selection(gap, asked.where("one = 250")).first().gain is None


def test_walk_profiles_join_and_turn_trails(spark):
    samples = spark.createDataFrame([(0, t, i, d, h) for t, pts in ((1, ((0.0, 1.0), (10.0, 2.0))), (2, ((0.0, 5.0), (4.0, 3.0), (20.0, 2.0)))) for i, (d, h) in enumerate(pts)], "section_id long, trail long, seq long, d double, h double")
    steps = spark.createDataFrame([(0, "r", 0, 1, False), (0, "r", 1, 2, True)], "section_id long, route_id string, seq long, trail long, reverse boolean")
    found = [(r.d, r.h) for r in profile.walk_profile(steps, samples).orderBy("seq").collect()]
    assert found == [(0.0, 1.0), (10.0, 2.0), (26.0, 3.0), (30.0, 5.0)]
    down = profile.exposure(_profile(spark, ((0, 40), (200, 0))), 0.1, sign=-1).first()
    assert down.total == pytest.approx(200.0) and profile.exposure(_profile(spark, ((0, 40), (200, 0))), 0.1).first().total == 0.0


def test_broken_walks_are_found(spark):
    trails = spark.createDataFrame([(0, 1, 1, 2), (0, 2, 2, 3), (0, 3, 3, 1)], "section_id long, trail long, a long, b long")
    rows = [("sound", [1, 2, 3]), ("gap", [1, 3]), ("open", [1, 2]), ("twice", [1, 2, 3, 1])]
    steps = spark.createDataFrame([(0, k, i, t, False) for k, ts in rows for i, t in enumerate(ts)], "section_id long, route_id string, seq long, trail long, reverse boolean")
    found = {r.route_id: (r.joined, r.closed, r.distinct_trails) for r in results.verified(steps, trails, ["route_id"]).collect()}
    assert found == {"sound": (True, True, True), "gap": (False, True, True), "open": (True, False, True), "twice": (True, False, False)}
    assert {(r.route_id, r.seq) for r in results.gaps(steps, trails, ["route_id"]).collect()} == {("gap", 1)}
    assert {r.route_id: r.first_repeat for r in results.first_repeats(steps, trails, ["route_id"]).collect()} == {"sound": 2, "gap": 1, "twice": 2}


COORDINATES = [
    ("47.5, -121.25", (-121.25, 47.5)), ("47.5 -121.25", (-121.25, 47.5)), ("(47.5; −121.25)", (-121.25, 47.5)), ("47°30'0\" N, 121°15' W", (-121.25, 47.5)), ("W 121 15 0 N 47 30 0", (-121.25, 47.5)), ("N47.5 W121.25", (-121.25, 47.5)),
    ("47°30′0″N 121°15′0″W", (-121.25, 47.5)), ("47 60 0 N, 121 W", None), ("47.5 30 N, 121 W", None), ("N 47, N 121", None), ("N 47, 121", None), ("-47 S, 121 W", None), ("95, 10", None), ("abc", None),
]


def test_coordinates(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(COORDINATES)], "id int, t string").select("id", scalars.coordinate("t").alias("c"))
    found = {r.id: None if r.c is None else (round(r.c.lon, 9), round(r.c.lat, 9)) for r in df.collect()}
    assert [found[i] for i in range(len(COORDINATES))] == [want for _, want in COORDINATES]


def test_hashes_of_code_units(spark):
    def brute(text):
        h, data = 0x811C9DC5, text.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[i : i + 2], "big")) * 0x01000193 % 2**32
        return h

    def times(a, b):
        return a * b % 2**32

    def jitter(identity, n):
        v = times(identity ^ times(n, 0x9E3779B9), 0x85EBCA6B)
        v = times(v ^ (v >> 16), 0xC2B2AE35)
        return 0.8 + (v ^ (v >> 16)) / 2**32 * 0.4

    texts = ["", "abc", "été", "a\U0001f600b", "\U0001f600"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.fnv1a("t").alias("h")).withColumn("j", scalars.jitter("h", 3)).collect()
    assert {r.t: r.h for r in rows} == {t: brute(t) for t in texts}
    assert all(r.j == pytest.approx(jitter(r.h, 3)) for r in rows)


def test_texts(spark):
    row = spark.range(1).select(scalars.highway_label(F.lit("I90, WA20 and US2")).alias("a"), scalars.date_ok(F.lit("2025-02-29")).alias("b"), scalars.date_ok(F.lit("2024-02-29")).alias("c"), scalars.url_ok(F.lit("https://a.b/c/"), True).alias("d"), scalars.url_ok(F.lit("https://u:p@a.b/c/"), True).alias("e"), scalars.high_point_text(F.lit(None).cast("double"), F.lit(1000.0)).alias("f"), scalars.high_point_text(F.lit(1000.0), F.lit(2000.0), True).alias("g")).first()
    assert tuple(row) == ("I-90, SR 20 and US 2", False, True, True, False, "≤3,281 ft", "1,000–2,000 m")


def test_what_must_fail_does(spark):
    sections = spark.createDataFrame([("a", 1)], "id string, n int")
    with pytest.raises(Exception, match="no section b"):
        catalog.looked_up(spark.createDataFrame([("a",), ("b",)], "id string"), sections).collect()
    hole = spark.createDataFrame([(0, 0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "feature int, ring int, points array<struct<x:double,y:double>>")
    with pytest.raises(Exception, match="hole without a ring"):
        catalog.polygons(hole).collect()
    tiles = spark.createDataFrame([(1, 0.0, 0.0, 1e-2, 1e-2), (2, 5e-3, 0.0, 2e-2, 1e-2)], "tile int, west double, south double, east double, north double")
    points = spark.createDataFrame([("p", 6e-3, 5e-3)], "id string, x double, y double")
    with pytest.raises(Exception, match="tiles overlap"):
        catalog.sampled_heights(points, tiles, spark.createDataFrame([(1, 1.0), (2, 2.0)], "tile int, value double")).collect()


def test_catalog_rules(spark):
    good = {"catalog": 0, "id": "s1", "state": "WA", "region_id": "r", "region_name": "R", "name": "N", "west": 0.0, "south": 0.0, "east": 1.0, "north": 1.0, "segments": 1, "starts": 0, "bytes": 5, "json_bytes": 9, "sha256": "a" * 64}
    rows = [good, good | {"id": "s2", "sha256": "xyz"}, good | {"id": "s3", "east": 0.0}, good | {"id": "-x"}, good | {"id": "s4", "state": None}, good | {"id": "s5", "starts": -1}, good | {"id": "s6", "name": " "}, good | {"id": "s7"}, good | {"id": "s7", "catalog": 1}]
    schema = "catalog int, id string, state string, region_id string, region_name string, name string, west double, south double, east double, north double, segments long, starts long, bytes long, json_bytes long, sha256 string"
    found = {(r.id, r.problem) for r in catalog.problems(spark.createDataFrame([tuple(r.values()) for r in rows], schema)).collect()}
    assert found == {("s2", "files"), ("s3", "bounds"), ("-x", "id"), ("s4", "state"), ("s5", "counts"), ("s6", "names"), ("s7", "duplicate")}


def test_a_stream_in_parts_admits_like_one(spark, tmp_path):
    """State is carried over batches: two active jobs at most, finished ones leave."""
    from waymark import streaming

    rows = [(7, 1, "queued"), (7, 2, "queued"), (7, 3, "queued"), (7, 4, "completed"), (7, 5, "queued"), (8, 6, "queued")]
    schema = "visitor long, position long, status string"
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"p{i}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
    stream = streaming.event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    found = streaming.appended(streaming.admissions(stream), str(tmp_path / "state"))
    assert {(r.position, r.admitted) for r in found.collect()} == {(1, True), (2, True), (3, False), (5, True), (6, True)}
    assert not list((tmp_path / "state" / "rows").glob("_staging*"))
