"""Work that grows with the result: paths that cannot come home end, and other steps that once outgrew their input."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import walks

EDGE = "section_id long, trail long, f long, t long, reverse boolean, dist double, gain double, access string, connector boolean"
START = "section_id long, start_id long, node long, name string, access string, kind_rank long"


def brute(edges, node, most):
    """Itineraries of all walks of at most `most` metres from a node."""
    back = {(r[1], r[4]): r[5] for r in edges}
    found = set()

    def go(at, nodes, steps, d):
        for _, trail, f, t, rev, dist, *_ in edges:
            if f != at or any(s[0] == trail for s in steps) or d + dist > most:
                continue
            now = [*steps, (trail, rev)]
            if t in nodes:
                stem = [back.get((k, not r)) for k, r in now[: nodes.index(t)]]
                if None not in stem and d + dist + sum(stem) <= most:
                    found.add(",".join(f"{k}{'-' if r else '+'}" for k, r in now))
            else:
                go(t, [*nodes, t], now, d + dist)

    go(node, [node], [], 0.0)
    return found


def test_walks_with_one_ways_are_those_of_a_plain_search(spark):
    rng = random.Random(3)
    edges = []
    for trail in range(14):
        f, t, dist = rng.randrange(7), rng.randrange(7), float(rng.randrange(0, 5) * 100)
        edges.append((0, trail, f, t, False, dist, 1.0, "public", trail % 3 == 0))
        if trail % 4:
            edges.append((0, trail, t, f, True, dist + 10.0, 2.0, "public", trail % 3 == 0))
    starts = spark.createDataFrame([(0, 5, 0, "x", "public", 0), (0, 6, 3, "x", "unknown", 1)], START)
    found = walks.closed_walks(spark.createDataFrame(edges, EDGE), starts, walks.Query(max_distance=1300.0, max_road=None, max_road_share=None)).collect()
    for start, node in ((5, 0), (6, 3)):
        want = brute(edges, node, 1300.0)
        assert sorted(r.itinerary for r in found if r.start_id == start) == sorted(want) and want


def test_a_path_that_cannot_come_home_ends(spark, monkeypatch):
    edges = [(0, i, *((i, i + 1) if not r else (i + 1, i)), r, 100.0, 0.0, "public", False) for i in range(20) for r in (False, True)]
    edges += [(0, 50, 0, 0, False, 100.0, 0.0, "public", False)]
    kept, stored = [], walks.stored
    monkeypatch.setattr(walks, "stored", lambda df: kept.append(df) or stored(df))
    starts = spark.createDataFrame([(0, 5, 0, "x", "public", 0)], START)
    found = walks.closed_walks(spark.createDataFrame(edges, EDGE), starts, walks.Query(max_distance=2000.0)).collect()
    assert [r.itinerary for r in found] == ["50+"]
    longest = max(df.agg(F.max(F.size("nodes"))).first()[0] or 0 for df in kept if "nodes" in df.columns)
    assert longest <= 10  # half of 2000 m, not all of the line


def test_kilobytes_stay_kilobytes(spark, tmp_path):
    from waymark.queries import QUERIES

    spark.range(100_000, 100_002).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    assert {r.shown for r in QUERIES["bytes_text"](spark, str(tmp_path)).collect()} == {"3700 kB"}


def test_a_catalog_of_no_sections_has_no_id(spark):
    from waymark.operators import catalog

    sections = spark.createDataFrame([], "west double, south double, east double, north double, starts long, bytes long")
    infos = spark.createDataFrame([(0, "2025-01-01", ["a"], ["b"])], "catalog long, source_date string, attributions array<string>, limitations array<string>")
    (row,) = catalog.composed(sections, infos).collect()
    assert row.id is None and row.sections == 0 and row.attributions == "a"


@pytest.mark.parametrize("files", [1, 3])
def test_events_in_files_that_follow_no_time(spark, tmp_path, files):
    from waymark.queries import QUERIES

    d = str(tmp_path)
    at = lambda m: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, {m})")
    events = spark.range(60).select(F.col("id").alias("event_id"), at("cast(id * 7 % 60 * 10 as int)").alias("ts"), F.lit(7).cast("long").alias("user_id"))
    for k in range(files):
        events.where(F.col("event_id") % files == k).coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    made, want = None, {}
    for minute, event in sorted((e * 7 % 60 * 10, e) for e in range(60)):
        want[event] = made is not None and minute - made < 30
        made = made if want[event] else minute
    assert {r.event_id: r.hit for r in QUERIES["stream_cache"](spark, d).collect()} == want


def test_components_send_no_links_through_the_driver(spark, monkeypatch):
    from waymark.operators import graph

    plans, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    links = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 7, 8)], "section_id long, a long, b long")
    assert {(r.node, r.component) for r in graph.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)


def test_the_map_is_joined_without_the_driver(spark, monkeypatch):
    from waymark.operators import graph
    from waymark.plans import topology

    plans, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    some = spark.createDataFrame([(0, "n1", "n2", 5.0, True), (0, "n2", "n3", 7.0, False), (0, "n8", "n9", 2.0, True)], "section_id long, a string, b string, metres double, counts boolean")
    found = topology.network_lengths(some)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.key, r.metres) for r in found.collect()} == {("n1", 5.0), ("n2", 5.0), ("n3", 5.0), ("n8", 2.0), ("n9", 2.0)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)


def test_first_repeats_shuffle_each_step_once(spark):
    from waymark.operators import results

    trails = spark.createDataFrame([(0, k, k, (k + 1) % 3) for k in range(3)], "section_id long, trail long, a long, b long")
    steps = [("loop", k, 0, k, False) for k in range(3)] + [("line", 0, 0, 0, False), ("line", 1, 0, 1, False), ("back", 0, 0, 1, False), ("back", 1, 0, 1, True)]
    found = results.first_repeats(spark.createDataFrame(steps, "route_id string, seq int, section_id long, trail long, reverse boolean"), trails, ["route_id"])
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.route_id: r.first_repeat for r in found.collect()} == {"loop": 2, "back": 1}


def test_labels_are_held_against_each_other_without_a_join(spark):
    from waymark.operators import discovery

    rows = [(1, 2.0, 1.0, 0.0, 1.0, True, "a"), (1, 2.0, 1.0, 0.0, 1.0, True, "b"), (1, 1.0, 9.0, 0.0, 1.0, False, "c"), (1, 3.0, 1.0, 0.0, 1.0, True, "d"), (2, 3.0, 1.0, 0.0, 1.0, True, "d")]
    kept = discovery._undominated(spark.createDataFrame(rows, "node long, twice double, gain double, road double, back double, sure boolean, stem string"), ["node"])
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
    assert {(r.node, r.stem) for r in kept.collect()} == {(1, "a"), (1, "c"), (2, "d")}


def test_ways_home_and_parts_take_no_rounds(spark, monkeypatch):
    """A long line once took a round of stored joins for each step of a way home, and several for its components."""
    from waymark.operators import graph
    from waymark.plans import topology

    made, stored = [], graph.stored
    for module in (graph, walks):
        monkeypatch.setattr(module, "stored", lambda df: made.append(df) or stored(df))
    edges = [(s, i, *((i, i + 1) if not r else (i + 1, i)), r, 100.0 + r, 0.0, "public", False) for s in (0, 1) for i in range(40) for r in (False, True)]
    starts = spark.createDataFrame([(0, 5, 0, "x", "public", 0), (0, 5, 30, "x", "public", 1), (1, 5, 40, "x", "public", 0), (2, 9, 3, "x", "public", 0)], START)
    found = walks.homeward(spark.createDataFrame(edges, EDGE), starts, 1010.0).collect()
    line = {(0, 5, n): min(101.0 * n, 101.0 * (n - 30) if n >= 30 else 100.0 * (30 - n)) for n in range(41)} | {(1, 5, n): 100.0 * (40 - n) for n in range(41)}
    assert {(r.section_id, r.start_id, r.node): r.home for r in found} == {k: x for k, x in (line | {(2, 9, 3): 0.0}).items() if x <= 1010.0}
    assert len(found) == len({(r.section_id, r.start_id, r.node) for r in found}) and not made
    links = spark.createDataFrame([(s, f"n{i}", f"n{i + 1}") for s in (0, 1) for i in range(40) if (s, i) != (1, 20)], "section_id long, a string, b string")
    parts = {}
    for r in topology.labelled(links).collect():
        parts.setdefault((r.section_id, r.component), set()).add(int(r.node[1:]))
    assert sorted((s, min(x), max(x), len(x)) for (s, _), x in parts.items()) == [(0, 0, 40, 41), (1, 0, 20, 21), (1, 21, 40, 20)]
    assert len(made) <= 1
