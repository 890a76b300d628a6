"""A tagged map derived from the part table, and the queries that prepare a network from it, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import network as net
from .operators import walks
from .plans import compiled
from .plans import tags as rules
from .plans import topology
from .queries import WALK as _walks_sql
from .registry import once as _once
from .registry import query

#: The footprint of every section, a convex ring that some ways cross.
RING = ((-122.0005, 46.9993), (-121.9701, 47.0003), (-121.9693, 47.0409), (-122.0004, 47.0391))
NODES = 1700

_PICK = {
    "highway": (13, {0: "path", 1: "residential", 2: "track", 3: "footway", 4: "service", 5: "motorway", 6: "steps", 7: "path", 8: "primary", 9: "platform", 10: "cycleway", 11: "track", 12: "path"}),
    "foot": (9, {1: "yes", 3: "no", 5: "permissive", 7: "designated"}),
    "foot:forward": (11, {3: "no", 5: "yes"}),
    "foot:backward": (17, {4: "no"}),
    "foot:conditional": (19, {1: "no @ snow"}),
    "access": (10, {2: "private", 3: "yes", 7: "customers"}),
    "access:conditional": (23, {2: "no @ night"}),
    "oneway": (7, {1: "yes", 2: "-1", 3: "reversible"}),
    "oneway:foot": (29, {1: "yes", 2: "-1", 3: "alternating"}),
    "motorroad": (31, {0: "yes"}),
    "motor_vehicle": (6, {1: "no", 2: "yes", 3: "private"}),
    "area": (37, {0: "yes"}),
    "disused": (41, {0: "yes"}),
    "footway": (15, {1: "sidewalk"}),
    "surface": (3, {0: "asphalt", 1: "gravel"}),
    "name": (5, {1: "Ridge", 2: "Creek", 3: "Lake"}),
}
_NODE_PICK = {
    "barrier": (37, {0: "gate", 1: "bollard", 2: "wall"}),
    "locked": (74, {0: "yes"}),
    "foot": (53, {0: "no", 1: "yes"}),
    "access": (59, {0: "private", 1: "yes"}),
    "motor_vehicle": (43, {0: "yes", 1: "no"}),
    "amenity": (47, {0: "parking", 1: "bench"}),
    "highway": (61, {0: "trailhead"}),
    "information": (67, {0: "trailhead", 1: "board"}),
    "tourism": (71, {0: "information"}),
    "name": (2, {1: "Place"}),
}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A shared table of the map; its joins are merges, so that none sends it through the driver."""
    return _once(spark, sf_dir, name, make).hint("merge")


def _col(name: str) -> str:
    return "t_" + name.replace(":", "__")


def _case(key: str, pick: dict) -> str:
    return ", ".join(f"case {key} % {n} {' '.join(f'when {r} then ' + repr(v) for r, v in values.items())} end as {_col(name)}" for name, (n, values) in pick.items())


_BASE = f"select cast(floor(p_partkey / 1000) as bigint) as section_id, p_partkey as id, cast(floor((p_partkey % 1000) / 2) * 7 as bigint) % 1600 as s, p_partkey % 2 as odd, {_case('p_partkey', _PICK)} from part"
_NODE_COLUMNS = _case("node", _NODE_PICK)
_AT = "-122 + (node % 40) * 1e-3 as lon, 47 + floor(node / 40) * 1e-3 as lat"


def _map(df: DataFrame, pick: dict) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.col(_col(k)).alias("v")) for k in pick))
    return df.withColumn("tags", F.map_from_entries(F.filter(entries, lambda e: e.v.isNotNull()))).drop(*(_col(k) for k in pick))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, id, nodes, tags."""
    return once(spark, sf_dir, "ways", lambda: _ways(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_id, node, lon, lat, tags."""
    return once(spark, sf_dir, "nodes", lambda: _nodes(spark, sf_dir))


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = part.selectExpr(*_top(_BASE[len("select ") : -len(" from part")]))
    along = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.col("s") + i)
    up = F.array(*(F.col("s") + k for k in (1, 0, 40, 80)))
    return _map(rows.withColumn("nodes", F.when(F.col("odd") == 0, along).otherwise(up)).drop("s", "odd"), _PICK)


def _top(text: str) -> list[str]:
    """The expressions of a select list: commas at its top level part them."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.floor(F.col("p_partkey") / 1000).alias("section_id")).distinct()
    rows = sections.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NODES - 1).cast("long"))))
    return _map(rows.selectExpr("section_id", "node", *_top(_AT), *_top(_NODE_COLUMNS)), _NODE_PICK)


# --- the same rules in SQL, over columns


def _tag(pick: dict, name: str) -> str:
    return _col(name) if name in pick else "cast(null as varchar)"


def _is(value: str, names: tuple[str, ...]) -> str:
    return f"coalesce({value} in ({', '.join(map(repr, names))}), false)"


def _permission(pick: dict, side: str | None = None, who: dict = rules.WALKER) -> str:
    values = ", ".join(_tag(pick, k) for k in who[side])
    doubts = ", ".join(f"{_tag(pick, f'{k}:conditional')} is not null" for k in who[side])
    first = f"list_position(list_transform([{values}], lambda v: v is not null), true)"
    value = f"coalesce({values})"
    return f"(case when {_is(value, rules.DENIED)} then 2 when {_is(value, rules.PUBLIC)} and not list_contains(list_slice([{doubts}], 1, {first}), true) then 0 else 1 end)"


def _direction(side: str) -> str:
    t = lambda k: _tag(_PICK, k)
    motor = f"({_is(t('highway'), ('motorway', 'motorway_link'))} or {_is(t('motorroad'), ('yes',))})"
    invited = f"coalesce({t('foot:' + side)}, {t('foot')})"
    shut = f"({motor} and not {_is(invited, rules.PUBLIC)}) or {_is(t('oneway:foot'), rules.OPPOSED[side])}"
    general = _is(t("oneway"), rules.CHANGING + rules.OPPOSED[side])
    doubted = f"{_is(t('oneway:foot'), rules.CHANGING)} or ({general} and {t('oneway:foot')} is null and {_is(t('highway'), rules.PATHS)})"
    return f"greatest({_permission(_PICK, side)}, case when {shut} then 2 when {doubted} then 1 else 0 end)"


_ROUTABLE = f"(not {_is(_tag(_PICK, 'disused'), ('yes', '1', 'true'))} and not {_is(_tag(_PICK, 'area'), ('yes',))} and {_is(_tag(_PICK, 'highway'), rules.PATHS + rules.ROADS)})"
_CONNECTOR = f"({_is(_tag(_PICK, 'highway'), rules.ROADS)} or {_is(_tag(_PICK, 'footway'), ('sidewalk', 'crossing'))})"
_DRIVABLE = f"({_is(_tag(_PICK, 'highway'), rules.ROADS)} and {_ROUTABLE} and least({_permission(_PICK, 'forward', rules.DRIVER)}, {_permission(_PICK, 'backward', rules.DRIVER)}) < 2)"
_N = lambda k: _tag(_NODE_PICK, k)
_CROSSING = f"case when {_N('barrier')} is null and ({_is(_N('amenity'), ('parking',))} or {_is(_N('tourism'), ('information',))} or ({_N('foot')} is null and {_N('access')} is null)) then 0 when {_is(_N('barrier'), rules.SOLID)} and ({_permission(_NODE_PICK)}) <> 0 then 2 else {_permission(_NODE_PICK)} end"
_EXPLICIT = f"coalesce({', '.join(_N(k) for k in rules.VEHICLES)})"
_STOPS = f"({_N('barrier')} is not null and not {_is(_EXPLICIT, rules.PUBLIC)} and ({_is(_EXPLICIT, rules.DENIED)} or {_is(_N('locked'), ('yes',))} or {_is(_N('barrier'), rules.CAR_BARRIERS)}))"
_KIND = f"case when {_is(_N('highway'), ('trailhead',))} or {_is(_N('information'), ('trailhead',))} then 'trailhead' when {_is(_N('amenity'), ('parking',))} then 'parking' end"
_NAMED = lambda x: f"case {x} when 0 then 'public' when 1 then 'unknown' else 'prohibited' end"


def _clip_sql(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """Fractions at which a segment enters and leaves the ring: the greatest entry and the least exit over its sides."""
    low, high = ["0e0"], ["1e0"]
    for (px, py), (qx, qy) in zip(RING, (*RING[1:], RING[0]), strict=True):
        side = lambda x, y: f"(({qx}e0 - ({px}e0)) * ({y} - {py}e0) - ({qy}e0 - {py}e0) * ({x} - ({px}e0)))"  # noqa: B023, E731
        one, two = side(*a), side(*b)
        low.append(f"case when {one} < 0 and {two} >= 0 then {one} / ({one} - {two}) else 0 end")
        high.append(f"case when {one} < 0 and {two} < 0 then -1 when {one} >= 0 and {two} < 0 then {one} / ({one} - {two}) else 1 end")
    return f"greatest({', '.join(low)})", f"least({', '.join(high)})"


def _covers_sql(x: str, y: str) -> str:
    return " and ".join(f"(({qx}e0 - ({px}e0)) * ({y} - {py}e0) - ({qy}e0 - {py}e0) * ({x} - ({px}e0))) >= 0" for (px, py), (qx, qy) in zip(RING, (*RING[1:], RING[0]), strict=True))


@cache
def _ctes() -> dict[str, str]:
    low, high = _clip_sql(("ux", "uy"), ("vx", "vy"))
    hav = lambda a, b, c, d: f"asin(least(1.0, sqrt(pow(sin(radians({d} - {b}) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians({c} - {a}) / 2), 2)))) * 12742017.6"
    part = lambda axis, f: f"(u{axis} + (v{axis} - u{axis}) * {f})"
    public = tuple(x for x in rules.ROADS if x not in ("track", "service"))
    reach = lambda name, edges, seeds: f"{name}0(section_id, node) as (select section_id, node from ends where {seeds} union select e.section_id, case when e.a = r.node then e.b else e.a end from {name}0 r join {edges} e on e.section_id = r.section_id and (e.a = r.node or e.b = r.node)), {name} as (select distinct section_id, node from {name}0)"
    lengths = lambda name, some: f"{name}_e as ({some}), {name}_c(section_id, node, c) as (select section_id, a, a from {name}_e union select section_id, b, b from {name}_e union select e.section_id, case when e.a = x.node then e.b else e.a end, x.c from {name}_c x join {name}_e e on e.section_id = x.section_id and (e.a = x.node or e.b = x.node)), {name}_m as (select section_id, node, min(c) as c from {name}_c group by all), {name} as (select m.section_id, m.node as key, t.metres from {name}_m m join (select e.section_id, m.c, sum(case when counts then metres else 0 end) as metres from {name}_e e join {name}_m m on m.section_id = e.section_id and m.node = e.a group by all) t on t.section_id = m.section_id and t.c = m.c)"
    return {
        "way": f"way as (select *, case when odd = 0 then [s, s + 1, s + 2, s + 3, s + 4, s + 5, s + 6, s + 7, s + 8] else [s + 1, s, s + 40, s + 80] end as nodes from ({_BASE}))",
        "nd": f"nd as (select *, {_AT}, {_NODE_COLUMNS} from (select section_id, unnest(range(0, {NODES})) as node from (select distinct cast(floor(p_partkey / 1000) as bigint) as section_id from part)))",
        "rule": f"rule as (select section_id, id, nodes, {_ROUTABLE} as routable, {_direction('forward')} as along, {_direction('backward')} as against, {_CONNECTOR} as connector, {_DRIVABLE} as drivable, {_is('t_highway', public)} as public, t_name as name, not {_is('t_surface', rules.PAVED)} as bare, {_is('t_highway', ('track',))} as track, t_highway as highway from way)",
        "gate": f"gate as (select section_id, node, lon, lat, {_CROSSING} as pass, {_STOPS} as stops, {_KIND} as kind, t_barrier as barrier, {_permission(_NODE_PICK)} as walk, {_permission(_NODE_PICK, None, rules.DRIVER)} as drive, t_name as name, not ({_covers_sql('lon', 'lat')}) as outside from nd)",
        "pr": "pr as (select *, nodes[i] as l, nodes[i + 1] as r, least(nodes[i], nodes[i + 1]) as u, greatest(nodes[i], nodes[i + 1]) as v from (select *, unnest(range(1, len(nodes))) as i from rule))",
        "cut": f"cut as (select *, {low} as low, {high} as high from (select p.*, x.lon as ux, x.lat as uy, x.pass as upass, y.lon as vx, y.lat as vy, y.pass as vpass from pr p join gate x on x.section_id = p.section_id and x.node = u join gate y on y.section_id = p.section_id and y.node = v where routable and u <> v))",
        "keyed": f"keyed as (select *, case when low = 0 then 'n' || u else 'frontier:n' || u || ':n' || v || ':' || cast(floor(low * 1e9 + 0.5) as bigint) end as ku, case when high = 1 then 'n' || v else 'frontier:n' || u || ':n' || v || ':' || cast(floor(high * 1e9 + 0.5) as bigint) end as kv, {hav(part('x', 'low'), part('y', 'low'), part('x', 'high'), part('y', 'high'))} as metres, greatest(case when low = 0 then upass else 0 end, case when high = 1 then vpass else 0 end) as gated from cut where low < high)",
        "seg": "seg as (select * from (select section_id, least(ku, kv) as a, greatest(ku, kv) as b, max(greatest(gated, case when (l > r) <> (ku > kv) then against else along end)) as forward, max(greatest(gated, case when (l > r) <> (ku > kv) then along else against end)) as backward, bool_or(connector) as connector, coalesce(list_sort(list_distinct(list(name) filter (name is not null))), []) as names, count(*) as copies, bool_and(bare) as unpaved, bool_or(track) as track, min(metres) as metres from keyed where metres >= 1e-7 group by section_id, least(ku, kv), greatest(ku, kv)) where forward < 2 or backward < 2)",
        "ends": f"ends as (select e.section_id, e.node, bool_or(drivable) as road, bool_or(public or outside) as seed, bool_or(stops) and bool_or(drivable) as gate from (select section_id, drivable, public, unnest(nodes) as node from rule where routable and {_is('highway', rules.ROADS)}) e join gate g on g.section_id = e.section_id and g.node = e.node group by all)",
        "links": f"links as (select section_id, l as a, r as b, drivable from pr where routable and {_is('highway', rules.ROADS)} and l <> r)",
        "free": "free as (select l.* from links l left join ends x on x.section_id = l.section_id and x.node = a left join ends y on y.section_id = l.section_id and y.node = b where l.drivable and not coalesce(x.gate, false) and not coalesce(y.gate, false))",
        "driving": reach("driving", "free", "seed and road and not gate"),
        "walking": reach("walking", "links", "seed"),
        "reach": "reach as (select e.section_id, e.node, e.gate, case when d.node is not null or (e.gate and exists (select 1 from links l join driving o on o.section_id = l.section_id and o.node = case when l.a = e.node then l.b else l.a end where l.drivable and l.section_id = e.section_id and (l.a = e.node or l.b = e.node))) then 'open' when w.node is not null then 'closed' else 'unknown' end as reach from ends e left join driving d on d.section_id = e.section_id and d.node = e.node left join walking w on w.section_id = e.section_id and w.node = e.node where e.road)",
        "tn": "tn as (select distinct section_id, cast(substr(key, 2) as bigint) as node from (select section_id, unnest([a, b]) as key from seg where not connector) where key like 'n%')",
        "contact": "contact as (select r.section_id, r.node, string_agg(cast(id as varchar), ',' order by id) as roads from (select distinct section_id, id, unnest(nodes) as node from rule where drivable) r join tn on tn.section_id = r.section_id and tn.node = r.node join gate g on g.section_id = r.section_id and g.node = r.node left join reach c on c.section_id = r.section_id and c.node = r.node where coalesce(c.reach, '') <> 'closed' and g.pass <> 2 group by all)",
        "support": lengths("support", "select section_id, a, b, metres, unpaved as counts from seg where not connector or (track and unpaved)"),
        "past": lengths("past", "select s.section_id, a, b, metres, not connector as counts from seg s left join reach x on x.section_id = s.section_id and a = 'n' || x.node left join reach y on y.section_id = s.section_id and b = 'n' || y.node where not connector or not (coalesce(x.reach, '') = 'open' and coalesce(y.reach, '') = 'open')"),
        "gated": f"gated as (select distinct st.section_id, st.node from (select section_id, unnest(nodes) as node from rule where routable and not drivable and {_is('highway', rules.ROADS)} union select section_id, node from reach where gate) st join reach o on o.section_id = st.section_id and o.node = st.node and o.reach = 'open' join gate g on g.section_id = st.section_id and g.node = st.node join past p on p.section_id = st.section_id and p.key = 'n' || st.node where p.metres >= 500 and g.pass <> 2 and not exists (select 1 from contact c where c.section_id = st.section_id and c.node = st.node))",
        "poi": "poi as (select g.section_id, g.node, g.kind, greatest(walk, case when g.kind = 'parking' then drive else 0 end) as access, g.name, greatest(walk, case when g.kind = 'parking' then drive else 0 end) < 2 and case when g.kind = 'trailhead' then exists (select 1 from seg s where s.section_id = g.section_id and (s.a = 'n' || g.node or s.b = 'n' || g.node)) else exists (select 1 from tn where tn.section_id = g.section_id and tn.node = g.node) end as joined from gate g where g.kind is not null)",
        "entrance": "entrance as (select x.section_id, x.node, x.rank, case when x.rank > 0 then greatest(x.access, g.pass) else 1 end as access from (select section_id, node, max(rank) as rank, min(access) as access from (select section_id, node, 0 as rank, 1 as access from contact union all select section_id, node, 0, 1 from gated union all select section_id, node, case when kind = 'trailhead' then 2 else 1 end, access from poi where joined) group by all) x join gate g on g.section_id = x.section_id and g.node = x.node left join support n on n.section_id = x.section_id and n.key = 'n' || x.node where x.rank = 2 or n.metres >= 500)",
        "side": "side as (select section_id, a as key, a, b, forward as out, backward as back, connector, a || '|' || b as text from seg union all select section_id, b, a, b, backward, forward, connector, a || '|' || b from seg)",
        "anchor": "anchor as (select q.section_id, q.key from (select section_id, key, count(*) as n, count(distinct connector) as roads, min(out * 3 + back) as x, max(out * 3 + back) as y from side group by all) q where n <> 2 or roads > 1 or x // 3 <> y % 3 or x % 3 <> y // 3 or key like 'frontier%' or exists (select 1 from gate g where g.section_id = q.section_id and 'n' || g.node = q.key and g.barrier is not null) or exists (select 1 from entrance e where e.section_id = q.section_id and 'n' || e.node = q.key))",
        "chain": "thru as (select s.section_id, min(text) as x, max(text) as y from side s left join anchor n on n.section_id = s.section_id and n.key = s.key where n.key is null group by s.section_id, s.key having min(text) <> max(text)), lab(section_id, text, c) as (select section_id, x, x from thru union select section_id, y, x from thru union select t.section_id, case when t.x = l.text then t.y else t.x end, l.c from lab l join thru t on t.section_id = l.section_id and (t.x = l.text or t.y = l.text)), chain as (select s.section_id, s.a, s.b, s.a || '|' || s.b as text, coalesce(l.c, s.a || '|' || s.b) as corridor from seg s left join (select section_id, text, min(c) as c from lab group by all) l on l.section_id = s.section_id and l.text = s.a || '|' || s.b)",
        "stop": "stop as (select section_id, key from anchor union all select section_id, min(key) from (select c.section_id, c.corridor, unnest([c.a, c.b]) as key from chain c where not exists (select 1 from chain x join anchor n on n.section_id = x.section_id and (n.key = x.a or n.key = x.b) where x.section_id = c.section_id and x.corridor = c.corridor)) group by section_id, corridor)",
        "tip": "tip as (select s.section_id, c.corridor, min(s.key) as one, max(s.key) as two, min_by(s.out, s.key || '|' || s.text) as out, min_by(s.back, s.key || '|' || s.text) as back from side s join stop n on n.section_id = s.section_id and n.key = s.key join chain c on c.section_id = s.section_id and c.text = s.text group by all)",
    }


def sql(names: str, body: str) -> str:
    ctes = ",\n".join(_ctes()[n].replace(f"{n} as (", f"{n} as materialized (") for n in names.split())
    return "with recursive " + ctes + "\n" + body


_SEG = "way nd rule gate pr cut keyed seg"
_REACH = "way nd rule gate pr ends links free driving walking reach"
_ENTER = f"{_SEG} ends links free driving walking reach tn contact support past gated poi entrance"


def _segments(s: SparkSession, d: str) -> DataFrame:
    return once(s, d, "segments", lambda: topology.segments(ways(s, d), nodes(s, d), RING))


def _reach(s: SparkSession, d: str) -> DataFrame:
    return once(s, d, "car reach", lambda: topology.car_reach(ways(s, d), nodes(s, d), RING))


@query(sql("way rule", f"select section_id, id, routable, {_NAMED('along')} as forward, {_NAMED('against')} as backward, connector, drivable from rule"))
def way_directions(s, d):
    t = F.col("tags")
    one, two = rules.directions(t)
    return ways(s, d).select("section_id", "id", rules.routable(t).alias("routable"), rules.named(one).alias("forward"), rules.named(two).alias("backward"), rules.connector(t).alias("connector"), rules.drivable(t).alias("drivable"))


@query(sql("nd gate", f"select section_id, node, {_NAMED('pass')} as crossing, stops, kind from gate"))
def node_crossings(s, d):
    t = F.col("tags")
    return nodes(s, d).select("section_id", "node", rules.named(rules.crossing(t)).alias("crossing"), rules.stops_cars(t).alias("stops"), rules.poi_kind(t).alias("kind"))


@query(sql(_SEG, "select section_id, a, b, forward, backward, connector, array_to_string(names, ' / ') as names, copies, unpaved, track, round(metres, 3) as metres from seg"))
def topology_segments(s, d):
    """Segments between nodes and cuts of the footprint, with merged permissions, roles and names."""
    return _segments(s, d).withColumn("names", F.array_join("names", " / ")).withColumn("metres", F.round("metres", 3))


@query(sql("way nd rule gate pr cut", "select section_id, id, i - 1 as ordinal, round(low, 9) as low, round(high, 9) as high, low < high as held from cut"))
def footprint_intervals(s, d):
    """The part of every segment inside the footprint, as fractions from its smaller node."""
    rows = topology.pairs(ways(s, d).where(rules.routable(F.col("tags")))).where("l <> r").withColumn("u", F.least("l", "r")).withColumn("v", F.greatest("l", "r"))
    at = nodes(s, d).select("section_id", "node", "lon", "lat")
    for k in ("u", "v"):
        rows = rows.join(at.toDF("section_id", k, f"{k}x", f"{k}y"), ["section_id", k])
    low, high = topology.clipped(RING, *(F.col(c) for c in ("ux", "uy", "vx", "vy")))
    rows = rows.withColumn("low", low).withColumn("high", high)
    return rows.select("section_id", "id", F.col("ordinal").cast("long").alias("ordinal"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), (F.col("low") < F.col("high")).alias("held"))


@query(sql(_REACH, "select section_id, node, reach, gate from reach"))
def car_reach(s, d):
    return _reach(s, d)


@query(sql(f"{_SEG} ends links free driving walking reach tn contact", "select section_id, node, roads from contact"))
def road_contacts(s, d):
    return _contacts(s, d)


@query(sql(f"{_SEG} support", "select section_id, key, round(metres, 3) as metres from support"))
def supporting_network(s, d):
    return topology.supporting(_segments(s, d)).withColumn("metres", F.round("metres", 3))


@query(sql(f"{_SEG} ends links free driving walking reach past", "select section_id, key, round(metres, 3) as metres from past"))
def trail_beyond_closures(s, d):
    return topology.beyond(_segments(s, d), _reach(s, d)).withColumn("metres", F.round("metres", 3))


def _contacts(s, d):
    return once(s, d, "contacts", lambda: topology.road_contacts(ways(s, d), nodes(s, d), _segments(s, d), _reach(s, d)))


def _gates(s, d):
    return once(s, d, "gates", lambda: topology.gated_starts(nodes(s, d), _segments(s, d), _reach(s, d), ways(s, d), _contacts(s, d)))


@query(sql(f"{_SEG} ends links free driving walking reach tn contact past gated", "select section_id, node from gated"))
def gated_starts(s, d):
    return _gates(s, d)


@query(sql(f"{_SEG} tn poi", "select section_id, node, kind, access, name, joined from poi"))
def poi_starts(s, d):
    return topology.poi_starts(nodes(s, d), _segments(s, d))


def _entrances(s, d):
    return once(s, d, "entrances", lambda: topology.entrances(_contacts(s, d), _gates(s, d), topology.poi_starts(nodes(s, d), _segments(s, d)), nodes(s, d), _segments(s, d)))


@query(sql(_ENTER, "select section_id, node, rank, access from entrance"))
def entrances(s, d):
    return _entrances(s, d)


_CHAIN = f"{_ENTER} side anchor chain"


@query(sql(f"{_ENTER} side anchor", "select section_id, key from anchor"))
def corridor_anchors(s, d):
    return topology.anchors(_segments(s, d), _entrances(s, d), nodes(s, d))


def _corridors(s, d):
    stops = once(s, d, "anchors", lambda: corridor_anchors(s, d))
    return stops, once(s, d, "corridors", lambda: topology.corridors(_segments(s, d), stops))


@query(sql(_CHAIN, "select c.section_id, c.a, c.b, c.corridor, not exists (select 1 from chain x join anchor n on n.section_id = x.section_id and (n.key = x.a or n.key = x.b) where x.section_id = c.section_id and x.corridor = c.corridor) as ring from chain c"))
def corridors_with_anchors(s, d):
    """Chains of segments between starts, cuts, barriers, forks and changes of permission or role; rings without one."""
    return _corridors(s, d)[1]


@query(sql(f"{_CHAIN} stop tip", """, tot as materialized (select c.section_id, c.corridor, sum(s.metres) as metres, bool_or(s.connector) as connector from chain c join seg s on s.section_id = c.section_id and s.a = c.a and s.b = c.b group by all),
ids as materialized (select section_id, key, dense_rank() over (partition by section_id order by key) - 1 as id from (select section_id, one as key from tip union select section_id, two from tip)),
e as materialized (select section_id, corridor, one as f, two as t, false as reverse, out as access from tip where out < 2 union all select section_id, corridor, two, one, true, back from tip where back < 2),
ex as materialized (select e.*, x.id as fid from e join ids x on x.section_id = e.section_id and x.key = e.f),
ey as materialized (select ex.*, y.id as tid from ex join ids y on y.section_id = ex.section_id and y.key = ex.t)
select section_id, corridor, fid as f, tid as t, reverse, access, round(metres, 3) as metres, connector from ey join tot using (section_id, corridor)"""))
def assembled_edges(s, d):
    """Dense node ids by section, and an edge for each direction of a corridor that may be walked."""
    stops, chains = _corridors(s, d)
    return topology.assembled(_segments(s, d), stops, chains).withColumn("metres", F.round("metres", 3))


@query("""with recursive m as (select c_custkey as relation, unnest(['w' || (c_custkey * 3), 'w' || (c_custkey * 3 + 1), 'r' || ((c_custkey * 2) % 300), case when c_custkey % 5 = 0 then 'r' || c_custkey end]) as member from customer where c_custkey < 300),
r(relation, inside) as (select distinct relation, relation from m union select r.relation, cast(substr(member, 2) as bigint) from r join m on m.relation = r.inside where member like 'r%')
select distinct r.relation, substr(m.member, 2) as way from r join m on m.relation = r.inside where m.member like 'w%'""")
def relation_members(s, d):
    """Ways of relations, through relations in them, some of which contain each other."""
    k = F.col("c_custkey")
    text = lambda kind, x: F.concat(F.lit(kind), x.cast("string"))
    four = F.array(text("w", k * 3), text("w", k * 3 + 1), text("r", k * 2 % 300), F.when(k % 5 == 0, text("r", k)))
    rows = s.read.parquet(f"{d}/customer.parquet").where("c_custkey < 300").select(k.alias("relation"), F.explode(four).alias("member"))
    return topology.members(rows.where("member is not null"))


_BOXES = "select n_nationkey as area_id, -122 + (n_nationkey % 5) * 8e-3 as west, 47 + floor(n_nationkey / 5) * 8e-3 as south, -122 + (n_nationkey % 5) * 8e-3 + case when n_nationkey % 3 = 0 then 11e-3 else 5e-3 end as east, 47 + floor(n_nationkey / 5) * 8e-3 + 45e-4 as north from nation"


def _boxes(s, d):
    return s.read.parquet(f"{d}/nation.parquet").selectExpr(*_top(_BOXES[len("select ") : -len(" from nation")]))


@query(sql("way nd rule gate pr", f""", box as ({_BOXES}), sg as (select p.section_id, p.id, p.i, x.lon as lx, x.lat as ly, y.lon as rx, y.lat as ry, sqrt(pow(y.lon - x.lon, 2) + pow(y.lat - x.lat, 2)) as length from pr p join gate x on x.section_id = p.section_id and x.node = l join gate y on y.section_id = p.section_id and y.node = r where routable and {_is('highway', rules.WALKWAYS)}),
iv as (select section_id, id, i, length, greatest(0, case when rx = lx then case when lx between west and east then 0 else 2 end else least((west - lx) / (rx - lx), (east - lx) / (rx - lx)) end, case when ry = ly then case when ly between south and north then 0 else 2 end else least((south - ly) / (ry - ly), (north - ly) / (ry - ly)) end) as lo,
 least(1, case when rx = lx then case when lx between west and east then 1 else -1 end else greatest((west - lx) / (rx - lx), (east - lx) / (rx - lx)) end, case when ry = ly then case when ly between south and north then 1 else -1 end else greatest((south - ly) / (ry - ly), (north - ly) / (ry - ly)) end) as hi from sg join box on least(lx, rx) <= east and greatest(lx, rx) >= west and least(ly, ry) <= north and greatest(ly, ry) >= south),
un as (select section_id, id, i, length, greatest(0, hi - greatest(lo, coalesce(max(hi) over (partition by section_id, id, i order by lo, hi rows between unbounded preceding and 1 preceding), 0))) as part from (select distinct * from iv where lo < hi)),
ins as (select section_id, id, sum(part * length) as inside from un group by all)
select g.section_id, g.id, round(coalesce(ins.inside, 0), 9) as inside, round(g.length, 9) as length, coalesce(ins.inside, 0) >= 5e-1 * g.length as developed from (select section_id, id, sum(length) as length from sg group by all) g left join ins using (section_id, id)"""))
def developed_walkways(s, d):
    """Walkways mostly inside developed land count as road."""
    rows = topology.developed(ways(s, d), nodes(s, d), _boxes(s, d))
    return rows.select("section_id", "id", F.round("inside", 9).alias("inside"), F.round("length", 9).alias("length"), "developed")


# --- compiled sections


_GRID = 225.0


def _compiled(s, d):
    def make():
        segs = _segments(s, d)
        stops, chains = _corridors(s, d)
        order = compiled.traversed(segs, compiled.every_stop(stops, chains), chains)
        ends = segs.select("section_id", F.explode(F.array("a", "b")).alias("key")).distinct()
        points = compiled.densified(segs, compiled.places(ends, nodes(s, d)))
        up = compiled.climbs(points, net.pixels(s, d), (F.col("lat") - F.lit(47.0)) * _GRID, (F.col("lon") + F.lit(122.0)) * _GRID)
        return compiled.trails(segs, order, up)

    return once(s, d, "compiled", make)


_COMPILED = {
    "hop": """hop(section_id, corridor, pos, text, a, b, turned, head) as (
 select section_id, corridor, cast(0 as bigint), text, a, b, key <> a, case when key = a then b else a end from (select s.section_id, c.corridor, s.key, s.text, s.a, s.b, row_number() over (partition by s.section_id, c.corridor order by s.key, s.a, s.b, s.key <> s.a) as nth from side s join stop n on n.section_id = s.section_id and n.key = s.key join chain c on c.section_id = s.section_id and c.text = s.text) where nth = 1
 union all select h.section_id, h.corridor, h.pos + 1, s.text, s.a, s.b, s.key <> s.a, case when s.key = s.a then s.b else s.a end from hop h join side s on s.section_id = h.section_id and s.key = h.head and s.text <> h.text join chain c on c.section_id = s.section_id and c.text = s.text and c.corridor = h.corridor where not exists (select 1 from stop n where n.section_id = h.section_id and n.key = h.head))""",
    "spot": """spot as (select k.section_id, k.key, x.lon + (y.lon - x.lon) * f as lon, x.lat + (y.lat - x.lat) * f as lat from (select section_id, key, cast(substr(case when key like 'frontier%' then split_part(key, ':', 2) else key end, 2) as bigint) as u, cast(substr(case when key like 'frontier%' then split_part(key, ':', 3) else key end, 2) as bigint) as v, case when key like 'frontier%' then cast(split_part(key, ':', 4) as double) / 1e9 else 0e0 end as f from (select distinct section_id, key from side)) k join nd x on x.section_id = k.section_id and x.node = u join nd y on y.section_id = k.section_id and y.node = v)""",
    "dot": f"""dot as (select section_id, a, b, i, (alat + (blat - alat) * (i / n) - 47) * {_GRID} as r, (alon + (blon - alon) * (i / n) + 122) * {_GRID} as c from (select *, unnest(range(0, cast(n as bigint) + 1)) as i from (select s.section_id, s.a, s.b, x.lon as alon, x.lat as alat, y.lon as blon, y.lat as blat, greatest(1, ceil(s.metres / 25)) as n from seg s join spot x on x.section_id = s.section_id and x.key = s.a join spot y on y.section_id = s.section_id and y.key = s.b)))""",
    "high": """high as (select section_id, a, b, i, sum(w * value) as h from (select d.*, value, (case when p.row = floor(r) then 1 - (r - floor(r)) else r - floor(r) end) * (case when p.col = floor(c) then 1 - (c - floor(c)) else c - floor(c) end) as w from dot d join pixel p on p.row in (floor(r), floor(r) + 1) and p.col in (floor(c), floor(c) + 1)) where w > 1e-12 group by all)""",
    "climb": """climb as (select section_id, a, b, coalesce(sum(greatest(rise, 0)), 0) as up, coalesce(sum(greatest(-rise, 0)), 0) as down from (select *, h - lag(h) over (partition by section_id, a, b order by i) as rise from high) group by all)""",
    "ctrail": """ctrail as (select *, row_number() over (partition by section_id order by corridor_id, corridor) - 1 as trail from (select h.section_id, h.corridor, arg_min(case when turned then h.b else h.a end, pos) as one, arg_max(head, pos) as two, arg_min(case when turned then backward else forward end, pos) as out, arg_min(case when turned then forward else backward end, pos) as back, round(sum(metres), 3) as dist, round(sum(case when turned then down else up end), 6) as gain_out, round(sum(case when turned then up else down end), 6) as gain_back, bool_or(connector) as connector, count(*) as pieces, substr(sha256(arg_min(case when turned then h.b else h.a end, pos) || '|' || string_agg(head, '|' order by pos)), 1, 24) as corridor_id from hop h join seg s on s.section_id = h.section_id and s.a = h.a and s.b = h.b join climb c on c.section_id = h.section_id and c.a = h.a and c.b = h.b group by h.section_id, h.corridor))""",
    "cend": """cend as (select section_id, key, row_number() over (partition by section_id order by key) - 1 as id from (select section_id, one as key from ctrail union select section_id, two from ctrail))""",
    "cedge": """cedge as (select e.section_id, trail, x.id as f, y.id as t, reverse, dist, gain, case rank when 0 then 'public' else 'unknown' end as access, connector from (select section_id, trail, one as kf, two as kt, false as reverse, dist, gain_out as gain, out as rank, connector from ctrail union all select section_id, trail, two, one, true, dist, gain_back, back, connector from ctrail) e join cend x on x.section_id = e.section_id and x.key = kf join cend y on y.section_id = e.section_id and y.key = kt where rank < 2)""",
    "cstart": """cstart as (select e.section_id, e.node as start_id, c.id as node, case e.access when 0 then 'public' else 'unknown' end as access, 2 - e.rank as kind_rank from entrance e join cend c on c.section_id = e.section_id and c.key = 'n' || e.node where e.access < 2)""",
    "pixel": f"pixel as ({net.CTE['pixel']})",
}


def _compiled_sql(body: str, more: str = "") -> str:
    base = sql(f"{_CHAIN} stop", "").rstrip()
    return base + ",\n" + ",\n".join(_COMPILED[k] for k in ("hop", "spot", "pixel", "dot", "high", "climb", "ctrail", "cend", "cedge", "cstart")) + more + "\n" + body


@query(_compiled_sql("select section_id, corridor_id, trail, one, two, dist, gain_out, gain_back, connector, pieces from ctrail"))
def compiled_trails(s, d):
    """Corridors of every section in order, named by their places, with lengths and climbs from heights every 25 m."""
    return _compiled(s, d).select("section_id", "corridor_id", "trail", "one", "two", "dist", "gain_out", "gain_back", "connector", "pieces")


@query(_compiled_sql("select * from cedge"))
def compiled_section(s, d):
    """Every section as the directed graph that a search reads."""
    return compiled.edges(_compiled(s, d))


@query(_compiled_sql("""select t.*, coalesce(n.starts, 0) as starts from (select section_id, count(*) as trails, count(*) filter (connector) as roads, cast(sum(pieces) as bigint) as segments, round(sum(dist), 3) as metres, round(sum(gain_out + gain_back), 6) as climb, count(*) filter (one = two) as rings,
 cast(sum(cast(one like 'frontier%' as int) + cast(two like 'frontier%' as int)) as bigint) as cuts, substr(sha256(string_agg(corridor_id, ',' order by corridor_id)), 1, 24) as content_id from ctrail group by section_id) t left join (select section_id, count(*) as starts from cstart group by section_id) n using (section_id)"""))
def section_audit(s, d):
    """What each compiled section holds, and an id of its content."""
    return compiled.audit(_compiled(s, d), _entrances(s, d))


_ON_MAP = walks.Query(max_distance=2500.0, max_gain=400.0, max_road=None, max_road_share=None)


@query(_compiled_sql("select section_id, start_id, circuit, array_to_string(list_concat(itin, list_transform(list_reverse(list_slice(itin, 1, stem_steps)), lambda x: translate(x, '+-', '-+'))), ',') as whole, round(distance, 3) as distance, round(gain, 6) as gain, round(road, 3) as road, uncertain from best", ",\nnet_edge as (select * from cedge),\nnet_start as (select * from cstart)" + "".join(f",\n{k} as ({_walks_sql[k]})" for k in ("eb", "path", "walk0", "walk", "circuit", "best"))))
def hikes_of_compiled_section(s, d):
    """The best walk of every circuit of the compiled sections."""
    found = compiled.edges(_compiled(s, d))
    every = walks.closed_walks(found, compiled.starts(_compiled(s, d), _entrances(s, d)), _ON_MAP)
    best = walks.best_per(every.withColumn("circuit", walks.circuit_key("core_trails")), "section_id", "circuit")
    return best.select("section_id", "start_id", "circuit", walks.whole().alias("whole"), F.round("distance", 3).alias("distance"), F.round("gain", 6).alias("gain"), F.round("road", 3).alias("road"), "uncertain")
