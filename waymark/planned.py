"""Queries of section plans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import network as net
from .operators import polygons
from .plans import planning
from .registry import once, query

#: Rows and columns of the lattice that are numbered roads, and the order in which they cut.
ROADS = {"I90": ("row", 10), "US2": ("row", 5), "US97": ("col", 13), "WA20": ("col", 7), "WA530": ("row", 15)}
CAP = 200


def _lines(s, d):
    n = net.nodes(s, d)
    at = {"row": F.floor(F.col("node") / 20), "col": F.col("node") % 20}
    ref = F.array_compact(F.array(*(F.when(at[kind] == k, F.lit(r)) for r, (kind, k) in ROADS.items())))
    points = n.select(F.col("section_id").alias("region"), F.explode(ref).alias("ref"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return once(s, d, "dividers", lambda: planning.dividers(points))


def _cells(s, d):
    at = net.trails(s, d).select("section_id", F.col("a").alias("node")).join(net.nodes(s, d), ["section_id", "node"])
    return once(s, d, "cells", lambda: planning.cells(at.select(F.col("section_id").alias("region"), F.col("lon").alias("x"), F.col("lat").alias("y")), _lines(s, d)))


_REF = "unnest([" + ", ".join(f"case when {'floor(node / 20)' if kind == 'row' else 'node % 20'} = {k} then '{r}' end" for r, (kind, k) in ROADS.items()) + "])"
_LINES = f"""rp as (select * from (select section_id as region, {_REF} as ref, lon as x, lat as y from net_node) where ref is not null),
sp as (select region, ref, min({{'x': x, 'y': y}}) as w, max({{'x': x, 'y': y}}) as e, min({{'y': y, 'x': x}}) as s, max({{'y': y, 'x': x}}) as n from rp group by all),
line as (select * from (select region, ref, case when e.x - w.x >= n.y - s.y then w.x else s.x end as x1, case when e.x - w.x >= n.y - s.y then w.y else s.y end as y1, case when e.x - w.x >= n.y - s.y then e.x else n.x end as x2, case when e.x - w.x >= n.y - s.y then e.y else n.y end as y2, case when e.x - w.x >= n.y - s.y then 0 else 1 end as axis from sp) where x1 <> x2 or y1 <> y2)"""
_SIDES = ", ".join(f"max(case when ref = '{r}' then case when (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) > 0 then 0 else 1 end end) as s_{r}" for r in ROADS)
_CELLS = f"""pt as (select t.section_id as region, t.trail, n.lon as x, n.lat as y from net_trail t join net_node n on n.section_id = t.section_id and n.node = t.a),
sd as (select p.region, trail, {_SIDES} from pt p join line l on l.region = p.region group by p.region, trail),
cell as (select region, {', '.join(f's_{r}' for r in ROADS)}, count(*) as n from sd group by all)"""
_LESS = [r for r in ROADS if not r.startswith("I")]


def _step(i: int, ref: str) -> str:
    free = "true" if ref not in _LESS else f"coalesce((k // cast(pow(2, list_position(rest, '{ref}') - 1) as bigint)) % 2 = 1, false)"
    w = "over (partition by region, k, label)"
    return f"c{i} as (select * exclude (label, sd, ct), case when ct then label || '|{ref}' || sd else label end as label from (select *, coalesce(sum(n) {w} > {CAP} and min(sd) {w} < max(sd) {w}, false) as ct from (select *, case when {free} then s_{ref} end as sd from c{i - 1})))"


_PLAN = f"""c0 as (select cell.*, rest, unnest(range(0, cast(pow(2, len(rest)) as bigint))) as k, '' as label from cell join (select region, coalesce(list_sort(list(ref) filter (ref not like 'I%')), []) as rest from line group by region) r using (region)),
{', '.join(_step(i, r) for i, r in enumerate(ROADS, 1))},
sec as (select region, k, label, cast(sum(n) as bigint) as size from c{len(ROADS)} group by all),
sc as (select region, k, cast(sum(greatest(size - {CAP}, 0)) as bigint) as excess, list_filter([{', '.join(map(repr, ROADS))}], lambda r: contains(string_agg(label, '|'), '|' || r)) as used from sec group by all),
bs as (select *, len(list_filter(used, lambda r: r not like 'I%')) as lesser from sc),
pick as (select * from (select *, row_number() over (partition by region order by excess, lesser, used, k) as pl from bs) where pl = 1)"""


def _word(part: str) -> str:
    return f"(case (select axis from line l where l.region = p.region and l.ref = substr({part}, 1, length({part}) - 1)) when 0 then case right({part}, 1) when '0' then 'north' else 'south' end else case right({part}, 1) when '0' then 'west' else 'east' end end)"


@query(net.with_cte("net_node", f", {_LINES} select * from line").replace(")\n, rp", "),\nrp"))
def road_dividers(s, d):
    """The numbered roads of each region from end to end, along the axis on which they are longer."""
    return _lines(s, d)


@query(net.with_cte("net_trail net_node", f", {_LINES}, {_CELLS}, {_PLAN} select s.region, s.k, cast(sum(greatest(size - {CAP}, 0)) as bigint) as excess, count(*) as sections from sec s group by s.region, s.k").replace(")\n, rp", "),\nrp"))
def section_cuts(s, d):
    """What every subset of the lesser roads leaves too large, and in how many sections."""
    return _applied(s, d).select("region", "k", planning.excess(CAP).alias("excess"), F.size("sections").cast("long").alias("sections"))


def _applied(s, d):
    return once(s, d, "applied cuts", lambda: planning.cut(_cells(s, d), planning.subsets(_lines(s, d)), list(ROADS), CAP))


_NAME = f"""ex as (select p.region, p.label, i, string_split(substr(p.label, 2), '|')[i] as part from (select s.*, unnest(range(1, len(string_split(substr(s.label, 2), '|')) + 1)) as i from sec s join pick k on k.region = s.region and k.k = s.k where s.label <> '') p),
nm as (select region, label, string_agg({_word('part')} || ' of ' || substr(part, 1, length(part) - 1), ', ' order by i) as name from ex p group by region, label)"""


@query(net.with_cte("net_trail net_node", f", {_LINES}, {_CELLS}, {_PLAN}, {_NAME} select s.region, substr(sha256(s.region || ':' || coalesce(name, 'whole region')), 1, 24) as section_id, coalesce(name, 'whole region') as name, size as segments, case when size <= {CAP} then 'ready' else 'unresolved' end as status, array_to_string(used, ',') as roads from sec s join pick k on k.region = s.region and k.k = s.k left join nm on nm.region = s.region and nm.label = s.label").replace(")\n, rp", "),\nrp"))
def planned_sections(s, d):
    """Each region cut by its freeway and the fewest lesser roads that bring its sections below the cap."""
    plan = planning.planned(_applied(s, d), CAP, list(ROADS))
    return planning.named(plan, _lines(s, d), CAP)


# --- polygons: areas with a hole and two parts in every cell of the grid, and outlines of regions


_U = ((0.001, 0.001), (0.039, 0.001), (0.039, 0.037), (0.027, 0.037), (0.027, 0.017), (0.013, 0.017), (0.013, 0.037), (0.001, 0.037))
_HOLE = ((0.003, 0.003), (0.003, 0.023), (0.009, 0.023), (0.009, 0.003))
_PART = ((0.016, 0.021), (0.024, 0.021), (0.024, 0.033), (0.016, 0.033))
_SHAPES = ((0, False, _U), (1, True, _HOLE), (2, False, _PART))


def _shapes(s, d):
    a = net.sections(s, d)
    rows = None
    for ring, hole, corners in _SHAPES:
        points = F.array(*(F.struct((F.col("west") + F.lit(x)).alias("x"), (F.col("south") + F.lit(y)).alias("y")) for x, y in corners))
        one = a.select(F.col("area_id").alias("area"), F.lit(ring).alias("ring"), F.lit(hole).alias("hole"), points.alias("points"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _edge_sql(corners, x: str = "west", y: str = "south") -> str:
    pairs = zip(corners, (*corners[1:], corners[0]), strict=True)
    return ", ".join(f"{{'x1': {x} + {a}e0, 'y1': {y} + {b}e0, 'x2': {x} + {c}e0, 'y2': {y} + {e}e0}}" for (a, b), (c, e) in pairs)


_INSIDE = f"""ed as (select area_id as area, e.x1, e.y1, e.x2, e.y2 from (select area_id, unnest([{', '.join(_edge_sql(c) for *_, c in _SHAPES)}]) as e from net_section)),
sg as (select t.section_id, t.trail, x.lon as ax, x.lat as ay, y.lon as qx, y.lat as qy from net_trail t join net_node x on x.section_id = t.section_id and x.node = t.a join net_node y on y.section_id = t.section_id and y.node = t.b),
mt as (select sg.*, area from sg join (select area, min(x1) as w, max(x1) as e, min(y1) as s, max(y1) as n from ed group by area) on least(ax, qx) <= e and greatest(ax, qx) >= w and least(ay, qy) <= n and greatest(ay, qy) >= s),
cx as (select m.*, x1, y1, x2, y2, (qx - ax) * (y2 - y1) - (qy - ay) * (x2 - x1) as across from mt m join ed using (area)),
ct as (select section_id, trail, area, ax, ay, qx, qy, unnest(case when across <> 0 and ((x1 - ax) * (qy - ay) - (y1 - ay) * (qx - ax)) / across between 0 and 1 then [((x1 - ax) * (y2 - y1) - (y1 - ay) * (x2 - x1)) / across]
 when across = 0 and (x1 - ax) * (qy - ay) - (y1 - ay) * (qx - ax) = 0 then [((x1 - ax) * (qx - ax) + (y1 - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)), ((x2 - ax) * (qx - ax) + (y2 - ay) * (qy - ay)) / ((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay))] else [] end) as t from cx),
tt as (select distinct * from (select * from ct where t > 0 and t < 1 union all select section_id, trail, area, ax, ay, qx, qy, unnest([0e0, 1e0]) from mt)),
pc as (select * from (select *, lead(t) over (partition by section_id, trail, area order by t) as high from tt) where high - t > 1e-12),
ok as (select p.section_id, p.trail, p.area, p.t as low, p.high from (select *, ax + (qx - ax) * ((t + high) / 2) as mx, ay + (qy - ay) * ((t + high) / 2) as my from pc) p join ed using (area) group by p.section_id, p.trail, p.area, p.t, p.high having count(*) filter ((y1 > my) <> (y2 > my) and mx < (x2 - x1) * (my - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1),
rn as (select *, sum(nw) over (partition by section_id, trail, area order by low) as run from (select *, case when low - lag(high) over (partition by section_id, trail, area order by low) <= 1e-12 then 0 else 1 end as nw from ok))"""


@query(net.with_cte("net_trail net_node net_section", f", {_INSIDE} select section_id, trail, area, round(min(low), 9) as low, round(max(high), 9) as high from rn group by section_id, trail, area, run").replace(")\n, ed", "),\ned"))
def polygon_intervals(s, d):
    """The parts of every trail inside areas that are concave, have a hole and a second part."""
    n = net.nodes(s, d)
    t = net.trails(s, d).select("section_id", "trail", "a", "b").join(n.select("section_id", F.col("node").alias("a"), F.col("lon").alias("ax"), F.col("lat").alias("ay")), ["section_id", "a"])
    t = t.join(n.select("section_id", F.col("node").alias("b"), F.col("lon").alias("bx"), F.col("lat").alias("by")), ["section_id", "b"])
    found = polygons.inside(t.select("section_id", "trail", "ax", "ay", "bx", "by"), _shapes(s, d), "section_id", "trail")
    return found.select("section_id", "trail", "area", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_OUTLINE = """bx as (select n_regionkey as group_id, n_nationkey % 5 as x, n_nationkey // 5 as y from nation),
bd as (select group_id, e.x1, e.y1, e.x2, e.y2 from (select group_id, unnest([{'x1': x, 'y1': y, 'x2': x + 1, 'y2': y}, {'x1': x + 1, 'y1': y, 'x2': x + 1, 'y2': y + 1}, {'x1': x + 1, 'y1': y + 1, 'x2': x, 'y2': y + 1}, {'x1': x, 'y1': y + 1, 'x2': x, 'y2': y}]) as e from bx)),
ou as (select b.* from bd b where not exists (select 1 from bd o where o.group_id = b.group_id and o.x1 = b.x2 and o.y1 = b.y2 and o.x2 = b.x1 and o.y2 = b.y1)),
vx as (select group_id, cast(cast(x1 as double) as varchar) || ' ' || cast(cast(y1 as double) as varchar) as a, cast(cast(x2 as double) as varchar) || ' ' || cast(cast(y2 as double) as varchar) as b, x1, y1, x2, y2 from ou),
rc(group_id, node, c) as (select group_id, a, a from vx union select v.group_id, case when v.a = r.node then v.b else v.a end, r.c from rc r join vx v on v.group_id = r.group_id and (v.a = r.node or v.b = r.node))"""


@query("with recursive " + _OUTLINE + " select cast(v.group_id as bigint) as group_id, r.c as ring, count(*) as edges, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) as length, sum(x1 * y2 - x2 * y1) / 2 as area from vx v join (select group_id, node, min(c) as c from rc group by all) r on r.group_id = v.group_id and r.node = v.a group by all")
def region_outlines(s, d):
    """The rings around the united areas of each region, with their length and signed area; shared edges are gone."""
    k = F.col("n_nationkey")
    x, y = (k % 5).cast("double"), F.floor(k / 5).cast("double")
    corner = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    n = net.table(s, d, "nation")
    rings = n.select(k.alias("area"), F.lit(0).alias("ring"), F.lit(False).alias("hole"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("points"))
    return polygons.stitched(polygons.outline(rings, n.select(k.alias("area"), F.col("n_regionkey").cast("long").alias("group_id"))))
