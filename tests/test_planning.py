"""Plans of sections, polygons with holes and parts, outlines: small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import polygons
from waymark.plans import planning

ORDER = ["I90", "US2", "WA20"]


@pytest.fixture(scope="module")
def region(spark):
    """100 places on a square; a freeway and a road that both halve it, and one that crosses the freeway."""
    points = spark.createDataFrame([(0, x + 0.2, y + 0.2) for x in range(10) for y in range(10)], "region long, x double, y double")
    roads = [("US2", -1.0, 2.5), ("US2", 11.0, 2.5), ("WA20", 5.0, -1.0), ("WA20", 5.0, 11.0), ("I90", -1.0, 5.0), ("I90", 11.0, 5.0), ("I90", 4.0, 5.0)]
    lines = planning.dividers(spark.createDataFrame([(0, *r) for r in roads], "region long, ref string, x double, y double"))
    return planning.cells(points, lines), lines


@pytest.mark.parametrize(
    ("cap", "names"),
    [
        (100, {("whole region", 100)}),
        (50, {("north of I90", 50), ("south of I90", 50)}),
        (30, {("north of I90, west of WA20", 25), ("north of I90, east of WA20", 25), ("south of I90, west of WA20", 25), ("south of I90, east of WA20", 25)}),
    ],
)
def test_the_fewest_lesser_roads_cut_what_is_too_large(region, cap, names):
    counted, lines = region
    plan = planning.planned(planning.cut(counted, planning.subsets(lines), ORDER, cap), cap, ORDER)
    found = planning.named(plan, lines, cap).collect()
    assert {(r.name, r.segments) for r in found} == names and {r.status for r in found} == {"ready"}
    assert len({r.section_id for r in found}) == len(names)


def test_what_no_road_can_cut_is_unresolved(region):
    counted, lines = region
    plan = planning.planned(planning.cut(counted, planning.subsets(lines), ORDER, 9), 9, ORDER)
    found = planning.named(plan, lines, 9).collect()
    assert sum(r.segments for r in found) == 100 and {r.status for r in found} == {"unresolved"} and {r.roads for r in found} == {"I90,US2,WA20"}


def test_too_many_lesser_roads_fail(spark):
    rows = [(0, f"WA{i:02}", float(i), float(y)) for i in range(13) for y in (0, 1)]
    lines = planning.dividers(spark.createDataFrame(rows, "region long, ref string, x double, y double"))
    with pytest.raises(Exception, match="narrow the candidates"):
        planning.subsets(lines).collect()


def test_subsets_are_applied_without_sorting_cells(spark, region):
    """A task holds rows, not all cells of all subsets: no window, and one row for each subset of a region."""
    counted, lines = region
    applied = planning.cut(counted, planning.subsets(lines), ORDER, 30)
    assert "Window" not in applied._jdf.queryExecution().executedPlan().toString()
    found = {(r.k, tuple(sorted(s["size"] for s in r.sections))) for r in applied.collect()}
    assert found == {(0, (50, 50)), (1, (20, 30, 50)), (2, (25, 25, 25, 25)), (3, (20, 25, 25, 30))}


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]
APART = [(6.0, 0.0), (8.0, 0.0), (8.0, 4.0), (6.0, 4.0)]
BAY = [(0.0, 10.0), (9.0, 10.0), (9.0, 14.0), (6.0, 14.0), (6.0, 11.0), (3.0, 11.0), (3.0, 14.0), (0.0, 14.0)]


def rings(spark, rows):
    return spark.createDataFrame([(a, i, h, [tuple(p) for p in ps]) for i, (a, h, ps) in enumerate(rows)], "area long, ring int, hole boolean, points array<struct<x:double,y:double>>")


def test_segments_in_holes_parts_and_bays(spark):
    area = rings(spark, [(1, False, SQUARE), (1, True, HOLE), (1, False, APART), (2, False, BAY)])
    segs = [("across", -1.0, 2.0, 9.0, 2.0), ("in hole", 1.5, 2.0, 2.5, 2.0), ("bay", 0.0, 12.0, 9.0, 12.0), ("along the side", 0.0, 4.0, 8.0, 4.0), ("away", 20.0, 20.0, 21.0, 20.0), ("inside", 0.2, 0.2, 0.4, 0.4), ("through a corner", -1.0, 5.0, 1.0, 3.0)]
    table = spark.createDataFrame(segs, "name string, ax double, ay double, bx double, by double")
    found = {}
    for r in polygons.inside(table, area, "name", cell=3.0).collect():
        found.setdefault((r.name, r.area), []).append((round(r.low, 9), round(r.high, 9)))
    assert {k: sorted(v) for k, v in found.items() if k[0] != "along the side"} == {
        ("across", 1): [(0.1, 0.2), (0.4, 0.5), (0.7, 0.9)],
        ("bay", 2): [(0.0, 0.333333333), (0.666666667, 1.0)],
        ("inside", 1): [(0.0, 1.0)],
        ("through a corner", 1): [(0.5, 1.0)],
    }


def test_outlines_lose_shared_edges_and_keep_holes(spark):
    """Eight cells around an empty one, and one far away: an outer ring, a hole, and a second part."""
    cells = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(7, 7)]
    rows = [(i, False, [(x + 0.0, y + 0.0), (x + 1.0, y + 0.0), (x + 1.0, y + 1.0), (x + 0.0, y + 1.0)]) for i, (x, y) in enumerate(cells)]
    groups = spark.createDataFrame([(i, 5) for i in range(len(cells))], "area long, group_id long")
    found = {(r.edges, r.length, r.area) for r in polygons.stitched(polygons.outline(rings(spark, rows), groups)).collect()}
    assert found == {(12, 12.0, 9.0), (4, 4.0, -1.0), (4, 4.0, 1.0)}
