"""Differences from SQL on odd inputs, and searches whose parts grew faster than their input."""

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("case", ["no time", "an hour twice"])
def test_cached_requests_without_a_time_or_in_an_hour_that_comes_twice(spark, tmp_path, case):
    from waymark.queries import QUERIES

    d, zone = str(tmp_path), spark.conf.get("spark.sql.session.timeZone")
    rows = spark.range(40).select(F.col("id").alias("event_id"), F.when(F.col("id") == 39, 8).otherwise(7).cast("long").alias("user_id"))
    at = {e: e * 7 % 40 * 10 for e in range(39)}  # minutes
    if case == "no time":
        at = {e: m for e, m in at.items() if e % 5 != 3}
        ts = F.when((F.col("event_id") % 5 != 3) & (F.col("event_id") != 39), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(event_id * 7 % 40 * 10 as int))"))
    else:
        ts = F.expr("timestamp'2024-11-03 06:00:00Z' + make_dt_interval(0, 0, cast(event_id * 7 % 40 * 10 as int))")
    made, want = None, {e: None for e in range(39)} | {39: False}
    for minute, event in sorted((m, e) for e, m in at.items()):
        want[event] = made is not None and minute - made < 30
        made = made if want[event] else minute
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        rows.withColumn("ts", ts).write.parquet(f"{d}/events.parquet")
        assert {r.event_id: r.hit for r in QUERIES["stream_cache"](spark, d).collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sizes_take_the_unit_they_need(spark, tmp_path):
    from waymark.queries import QUERIES, SQL

    duckdb = pytest.importorskip("duckdb")
    keys = {0: "0 KB", 1: "0 KB", 2: "0.1 KB", 27: "1 KB", 50: "1.9 KB", 27_027: "1,000 KB", 27_028: "1 MB", 100_000: "3.7 MB", 27_027_027: "1,000 MB", 27_027_028: "1 GB", 50_000_000: "1.9 GB", 40_000_000_000: "1,480 GB"}
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["bytes_text"](spark, str(tmp_path))
    assert {r.id: r.text for r in found.collect()} == keys
    duckdb.sql(f"create or replace view part as from '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(duckdb.sql(SQL["bytes_text"]).fetchall())


def test_local_circuits_store_and_deal_no_branches(spark, monkeypatch):
    """Branches were stored, joined to every place of every circuit, and each step of each variant was shuffled: over 100 times the input."""
    from waymark.operators import discovery, walks

    two = lambda trail, a, b, dist, road=False: [(0, trail, a, b, False, dist, 0.0, "public", road), (0, trail, b, a, True, dist, 0.0, "public", road)]
    rows = [*two(1, 0, 1, 500.0), *two(2, 1, 2, 500.0), *two(3, 2, 3, 500.0), *two(4, 3, 0, 500.0), *two(6, 1, 4, 600.0), *two(7, 4, 3, 600.0, road=True), *two(8, 2, 2, 5.0)]
    rows += [(0, 5, 0, 2, False, 450.0, 0.0, "public", False), (0, 9, 3, 1, False, 10.0, 5000.0, "public", False), *two(10, 4, 5, 1.0), *two(11, 5, 6, 1.0), *two(12, 6, 0, 1.0)]
    edges = spark.createDataFrame(rows, "section_id long, trail long, f long, t long, reverse boolean, dist double, gain double, access string, connector boolean")
    circuits = spark.createDataFrame([(0, "1,2,3,4", [1, 2, 3, 4], [0, 1, 2, 3])], "section_id long, circuit string, trails array<long>, nodes array<long>")
    q = walks.Query(min_distance=1600.0, max_distance=4000.0, max_gain=1000.0)
    trails = discovery.physical(edges)
    calls, kept = [], discovery.stored
    monkeypatch.setattr(discovery, "stored", lambda df: calls.append(1) or kept(df))
    found = discovery.local_circuits(circuits, trails, q, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    best = {(r.circuit, tuple(r.trails), tuple(r.nodes), round(r.score, 9), r.place) for r in found.collect()}
    assert not calls and plan.count("Exchange hashpartitioning") == 3  # physical trails; circuits and trails by section
    road = round(600.0 / 2200.0 * 1e-3, 9)
    assert best == {
        ("1,4,7,6", (1, 6, 7, 4), (0, 1, 4, 3), road, 1), ("2,3,7,6", (2, 3, 7, 6), (1, 2, 3, 4), road, 2),
        ("1,2,5", (1, 2, 5), (0, 1, 2), 0.0375, 3), ("3,4,5", (5, 3, 4), (0, 2, 3), 0.0375, 4),
    }
    assert found.select("section_id", "origin").distinct().collect() == [(0, "1,2,3,4")]
    every = {r.circuit: round(r.score, 9) for r in discovery.local_circuits(circuits, trails, q, 4, best=99).collect()}
    assert every["1,4,9"] == every["2,3,9"] == round(590.0 / 4000.0 + 4.0, 9) and "1,6,10,11,12" in every
    assert "1,6,10,11,12" not in {r.circuit for r in discovery.local_circuits(circuits, trails, q, 3, best=99).collect()}


def test_approaches_and_trials_take_no_rounds(spark, monkeypatch):
    """A stem of 20 trails once took 20 rounds of stored labels, and each full pass a round of stored proposals."""
    from waymark.operators import discovery, walks

    two = lambda trail, a, b, dist, gain=0.0, access="public": [(0, trail, a, b, False, dist, gain, access, False), (0, trail, b, a, True, dist, gain, access, False)]
    rows = [*two(1, 0, 1, 50.0), *two(2, 1, 0, 60.0)] + [x for n in range(1, 21) for x in two(10 + n, n, n + 1, 10.0)]
    rows += [*two(50, 5, 6, 9.0, gain=3.0), *two(51, 5, 6, 9.0, gain=3.0), *two(52, 5, 6, 9.5, gain=3.0, access="unknown"), *two(60, 7, 70, 1.0)]
    edges = spark.createDataFrame(rows, "section_id long, trail long, f long, t long, reverse boolean, dist double, gain double, access string, connector boolean")
    circuit = spark.createDataFrame([(0, "1,2", [0, 1], 110.0, 0.0, 0.0), (3, "9", [0], 1.0, 0.0, 0.0)], "section_id long, circuit string, nodes array<long>, dist double, gain double, road double")
    trails, goals = discovery.physical(edges), spark.createDataFrame([(0, 21)], "section_id long, node long")
    calls, kept = [], discovery.stored
    monkeypatch.setattr(discovery, "stored", lambda df: calls.append(1) or kept(df))
    q = walks.Query(max_distance=1000.0, max_stem=200.0)
    found = discovery.approaches(circuit, trails, q, goals).collect()
    assert not any(r.node in (0, 1, 70) for r in found) and {r.node for r in found} == set(range(2, 22))
    ends = discovery.approaches(circuit, trails, q, goals, arrived=True).collect()
    assert {(r.node, r.contact, r.twice, r.gain, r.back, r.sure, 50 in [s.trail for s in r.stem]) for r in ends} == {(21, 1, 400.0, 0.0, 200.0, True, False), (21, 1, 398.0, 6.0, 199.0, True, True)}
    assert all(len(r.stem) == 20 for r in ends) and len(discovery.approaches(circuit, trails, walks.Query(max_distance=1000.0, max_stem=199.0), goals, arrived=True).collect()) == 1
    proposals = spark.createDataFrame([(0, f"c{i}", p, i) for i in range(12) for p in range(6)], "section_id long, circuit string, pass int, place long")
    assert {(r.circuit, r[2]) for r in discovery.taken(proposals, 2).collect()} == {(f"c{i}", i // 2) for i in range(12)}
    assert not calls


def test_walks_take_no_rounds_and_store_no_open_paths(spark, monkeypatch):
    """A circuit of 30 trails at the end of a stem once took a round of stored joins over all paths for each of its steps."""
    from waymark.operators import walks

    trail = lambda n, a, b, road=False: [(s, n, *((a, b) if not r else (b, a)), r, 10.0 + r, 1.0, "public", road) for s in (0, 1) for r in (False, True)]
    rows = [x for n in range(30) for x in trail(n, n, (n + 1) % 30)] + [*trail(40, 99, 0, True), (0, 41, 99, 5, False, 1.0, 0.0, "unknown", False), (0, 42, 7, 7, False, 2.0, 0.0, "public", False)]
    edges = spark.createDataFrame(rows, "section_id long, trail long, f long, t long, reverse boolean, dist double, gain double, access string, connector boolean")
    starts = spark.createDataFrame([(0, 5, 99, "x", "public", 0), (1, 6, 99, "x", "public", 1), (1, 6, 3, "x", "unknown", 1), (2, 7, 1, "x", "public", 0)], "section_id long, start_id long, node long, name string, access string, kind_rank long")
    calls, kept = [], walks.stored
    monkeypatch.setattr(walks, "stored", lambda df: calls.append(1) or kept(df))
    found = walks.closed_walks(edges, starts, walks.Query(max_distance=351.0, max_gain=400.0)).collect()
    assert len(calls) == 1
    forth, back = ",".join(f"{n}+" for n in range(30)), ",".join(f"{n}-" for n in range(29, -1, -1))
    turned = lambda k: ",".join(f"{n}+" for n in [*range(k, 30), *range(k)])
    rings = {(1, 6, f"40+,{forth}", 321.0, 11.0, 21.0, False), (1, 6, f"40+,{back}", 351.0, 11.0, 21.0, False), (1, 6, turned(3), 300.0, 0.0, 0.0, True)}
    got = {(r.section_id, r.start_id, r.itinerary, r.distance, r.stem, r.road, r.uncertain) for r in found}
    assert rings <= got and (0, 5, f"40+,{forth}", 321.0, 11.0, 21.0, False) in got and not any(s == 2 for s, *_ in got)
    around = ",".join(f"{n}+" for n in range(7))
    assert (0, 5, f"40+,{around},42+", 10.0 + 70.0 + 2.0 + 88.0, 88.0, 21.0, False) in got  # out, round the ring at 7, and home
    few = walks.closed_walks(edges, starts, walks.Query(max_distance=1000.0, max_steps=9))
    assert {r.itinerary for r in few.collect()} >= {f"40+,{around},42+"} and all(len(r.trails) <= 9 for r in few.collect())
