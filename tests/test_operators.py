"""Operators on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import scalars
from waymark.operators import graph, profile, results, spatial, walks

EDGE = "section_id long, trail long, f long, t long, reverse boolean, dist double, gain double, access string, connector boolean"


def two_way(trail, f, t, dist, **more):
    a = {"gain": 0.0, "access": "public", "connector": False} | more
    return [(0, trail, x, y, r, dist, a["gain"], a["access"], a["connector"]) for x, y, r in ((f, t, False), (t, f, True))]


@pytest.fixture(scope="module")
def lollipop(spark):
    """A stem 0-1 and a triangle 1-2-3."""
    rows = two_way(0, 0, 1, 100.0) + two_way(1, 1, 2, 50.0) + two_way(2, 2, 3, 60.0, connector=True) + two_way(3, 3, 1, 70.0, gain=5.0)
    edges = spark.createDataFrame(rows, EDGE)
    starts = spark.createDataFrame([(0, 7, 0, "x", "public", 0)], "section_id long, start_id long, node long, name string, access string, kind_rank long")
    return edges, starts


def test_lollipop_counts_the_stem_back_once(lollipop):
    q = walks.Query(max_road=None, max_road_share=None)
    rows = walks.closed_walks(*lollipop, q).collect()
    assert len(rows) == 2 and {r.itinerary for r in rows} == {"0+,1+,2+,3+", "0+,3-,2-,1-"}
    for r in rows:
        assert (r.stem_steps, r.stem, r.distance, r.road) == (1, 100.0, 380.0, 60.0)
        assert r.repetition == pytest.approx(100 / 380)


def brute_walks(edges, start, most, climb):
    """Itineraries of all walks from a start: depth first, no limit of steps."""
    by_trail = {(e.trail, e.reverse): e for e in edges}
    found = set()

    def grow(nodes, steps):
        for e in edges:
            if e.f != nodes[-1] or e.trail in {s.trail for s in steps}:
                continue
            now = [*steps, e]
            if sum(s.dist for s in now) > most or sum(s.gain for s in now) > climb:
                continue
            if e.t not in nodes:
                grow([*nodes, e.t], now)
                continue
            back = [by_trail.get((s.trail, not s.reverse)) for s in now[: nodes.index(e.t)]]
            if None not in back and sum(s.dist for s in now + back) <= most and sum(s.gain for s in now + back) <= climb:
                found.add(",".join(f"{s.trail}{'-' if s.reverse else '+'}" for s in now))

    grow([start], [])
    return found


def test_walks_have_no_limit_of_steps(spark):
    """A 3 x 4 lattice with a stem: loops of four to ten steps, lollipops around cells."""
    rows, n = two_way(0, 100, 0, 90.0), 1
    for i in range(12):
        for j in (i + 1,) * (i % 4 < 3) + (i + 4,) * (i < 8):
            rows += two_way(n, i, j, 100.0 + n, gain=float(n % 3))[: 1 if n == 5 else 2]
            n += 1
    edges = spark.createDataFrame(rows, EDGE)
    starts = spark.createDataFrame([(0, 7, 0, "x", "public", 0), (0, 8, 100, "y", "public", 0)], "section_id long, start_id long, node long, name string, access string, kind_rank long")
    q = walks.Query(max_distance=1150.0, max_gain=9.0, max_road=None, max_road_share=None)
    found = walks.closed_walks(edges, starts, q).collect()
    held = edges.collect()
    for start, node in ((7, 0), (8, 100)):
        assert sorted(r.itinerary for r in found if r.start_id == start) == sorted(brute_walks(held, node, 1150.0, 9.0))
    assert max(len(r.trails) for r in found) > 6 and any(r.stem_steps and len(r.core_trails) == 4 for r in found)


def test_one_way_stem_is_no_stem(spark, lollipop):
    edges, starts = lollipop
    assert walks.closed_walks(edges.where("not (trail = 0 and reverse)"), starts, walks.Query(max_road=None, max_road_share=None)).count() == 0


def test_limits_are_inclusive(lollipop):
    q = walks.Query(min_distance=380.0, max_distance=380.0, max_road=60.0, max_road_share=None)
    assert walks.qualified(walks.closed_walks(*lollipop, q), q).count() == 2
    q = walks.Query(max_distance=379.9, max_road=None, max_road_share=None)
    assert walks.closed_walks(*lollipop, q).count() == 0


def test_query_is_validated():
    for bad in ({"min_distance": 5.0, "max_distance": 1.0}, {"max_stem": None, "max_repetition": None}, {"max_road_share": 2.0}, {"max_steps": 0}):
        with pytest.raises(ValueError):
            walks.Query(**bad)


def test_circuit_key_ignores_start_and_direction(spark):
    rows = spark.createDataFrame([([3, 1, 2],), ([2, 1, 3],), ([1, 2, 3],), ([2, 3, 1],)], "c array<long>")
    assert {r.k for r in rows.select(walks.circuit_key("c").alias("k")).collect()} == {"1,2,3"}


def test_hidden_circuits_do_not_bridge_groups(spark):
    circuits = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "section_id long, circuit string, place int")
    pairs = spark.createDataFrame([(0, "a", "b"), (0, "b", "c")], "section_id long, a string, b string")
    found = {r.circuit: r.group_circuit for r in walks.distinct_hikes(circuits, pairs).collect()}
    assert found == {"a": "a", "b": "a", "c": "c"}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(0, i, i + 1) for i in range(40)] + [(1, 5, 9), (0, 100, 101)], "section_id long, a long, b long")
    found = {(r.section_id, r.node): r.component for r in graph.components(links).collect()}
    assert all(found[0, i] == 0 for i in range(41)) and found[0, 101] == 100 and found[1, 9] == 5


def _profile(spark, points):
    return spark.createDataFrame([(0, 0, i, float(d), None if h is None else float(h)) for i, (d, h) in enumerate(points)], "section_id long, trail long, seq long, d double, h double")


def brute_exposure(points, above, steps=60_000):
    """Share of fine steps whose clipped 100 m window climbs more than `above`."""
    import numpy as np

    d, h = np.array(points, float).T
    x = (np.arange(steps) + 0.5) * d[-1] / steps
    lo, hi = np.maximum(x - 50, 0), np.minimum(x + 50, d[-1])
    over = (np.interp(hi, d, h) - np.interp(lo, d, h)) - above * (hi - lo) > 1e-9
    runs = np.split(over, np.flatnonzero(np.diff(over.astype(int))) + 1)
    return over.mean() * d[-1], max((len(r) for r in runs if r[0]), default=0) * d[-1] / steps


@pytest.mark.parametrize("points", [((0, 0), (100, 0), (200, 40), (300, 40)), ((0, 10), (500, 10)), ((0, 0), (30, 9), (80, 12), (200, 60), (260, 40), (400, 120)), ((0, 0), (40, 20))])
def test_exposure_matches_fine_steps(spark, points):
    found = profile.exposure(_profile(spark, points), 0.15).first()
    total, longest = brute_exposure(points, 0.15)
    assert found.total == pytest.approx(total, abs=0.1) and found.longest == pytest.approx(longest, abs=0.1)


def test_unknown_height_makes_everything_unknown(spark):
    p = _profile(spark, ((0, 0), (100, None), (200, 40)))
    assert profile.exposure(p, 0.1).first().total is None
    assert profile.climbs(p).first().peak is None


def test_ring_edges_and_hole_edges_are_inside(spark):
    rings = spark.createDataFrame([(0, 0, False, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (0, 1, True, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])], "area int, ring int, hole boolean, points array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(0, 0.0, 2.0), (1, 2.0, 2.0), (2, 1.0, 2.0), (3, 0.5, 0.5), (4, 5.0, 1.0), (5, 4.0, 4.0)], "id int, lon double, lat double")
    assert {r.id for r in spatial.points_in_areas(points, rings, "id").collect()} == {0, 2, 3, 5}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.fnv1a(F.lit("abc")).alias("fnv"), scalars.gpx_filename(F.lit("Évian / Lac Noir!"), F.lit(16093.44)).alias("file"), scalars.coordinate(F.lit("47.5, -121.25")).alias("c"), scalars.coordinate(F.lit("95, 10")).alias("none"),
        scalars.xml_escape(F.lit("a<b&'c'")).alias("xml"), scalars.elapsed_text(F.lit(3700)).alias("t"), scalars.bytes_text(F.lit(2.5e9)).alias("b"), spatial.lerp_lon(F.lit(179.0), F.lit(-179.0), F.lit(0.5)).alias("lon"),
    ).first()
    assert row.fnv == 440920331 and row.file == "evian-lac-noir_10.0mi.gpx" and (row.c.lon, row.c.lat) == (-121.25, 47.5) and row.none is None
    assert row.xml == "a&lt;b&amp;&apos;c&apos;" and row.t == "1h 1m" and row.b == "2.5 GB" and row.lon == -180.0


def test_page_refuses_unknown_sorts(spark):
    with pytest.raises(ValueError):
        results.page(spark.range(1), "name; drop")


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from waymark import network, streaming

    jobs = network.jobs(spark, "/root/testdata/sf0.001")
    jobs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.progress(streaming.event_stream(spark, str(tmp_path / "in"), jobs.schema))
    q = stream.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("progress")) == key(streaming.progress(jobs))


def test_published_batches_are_whole(spark, tmp_path):
    from waymark import network, streaming

    jobs = network.jobs(spark, "/root/testdata/sf0.001")
    jobs.repartition(2).write.parquet(str(tmp_path / "in"))
    q = streaming.published(streaming.event_stream(spark, str(tmp_path / "in"), jobs.schema), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == jobs.count()


def test_entry_works_without_the_corpus_operators(tmp_path):
    """In a copy without the subpackage, its tests and its pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    root = __file__.rsplit("/tests/", 1)[0]
    for name in ("waymark", "tests"):
        shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'loops_in_range' in q and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=False)
    assert done.returncode == 0
