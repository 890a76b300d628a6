"""Registered queries over the derived trail network, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import network as net
from . import sources, streaming
from .functions import scalars
from .operators import bounded, graph, jobs, profile, results, spatial, walks
from .plans import prepare
from .registry import QUERIES, SQL, Run, once


#: Limits of the registered searches: length and climb alone end them.
REACH = WHOLE = walks.Query(max_distance=2500.0, max_gain=400.0, max_road=None, max_road_share=None)
#: The same without a limit of climb.
STEEP = replace(REACH, max_gain=10_000.0)


def query(sql: str | None = None, cte: str = "") -> Callable[[Run], Run]:
    def add(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = net.with_cte(cte, sql, WALK) if cte else sql
        return f

    return add


WALK = {
    "eb": "select e.*, r.dist as back_dist, r.gain as back_gain from net_edge e left join net_edge r on e.section_id = r.section_id and e.trail = r.trail and e.reverse <> r.reverse",
    "path": """select section_id, start_id, kind_rank, access <> 'public' as unsure, node as at, cast(node as bigint) as t, [cast(node as bigint)] as nodes, cast([] as bigint[]) as trails, cast([] as varchar[]) as itin,
 cast(0 as double) as d, cast(0 as double) as g, cast(0 as double) as r, cast([] as double[]) as bd, cast([] as double[]) as bg, cast([] as double[]) as br, cast([] as varchar[]) as nr, cast([] as varchar[]) as nb, false as has_path, cast(0 as bigint) as place from net_start
 union all
 select p.section_id, p.start_id, p.kind_rank, p.unsure or e.access <> 'public', e.t, cast(e.t as bigint), list_append(p.nodes, cast(e.t as bigint)), list_append(p.trails, e.trail), list_append(p.itin, cast(e.trail as varchar) || case when e.reverse then '-' else '+' end),
 p.d + e.dist, p.g + e.gain, p.r + case when e.connector then e.dist else 0 end, list_append(p.bd, coalesce(e.back_dist, -1)), list_append(p.bg, coalesce(e.back_gain, 0)), list_append(p.br, case when e.connector then coalesce(e.back_dist, 0) else 0 end),
 list_append(p.nr, case when e.connector then '' else cast(e.trail as varchar) || case when e.reverse then '-' else '+' end end), list_append(p.nb, case when e.connector then '' else cast(e.trail as varchar) || case when e.reverse then '+' else '-' end end), p.has_path or not e.connector,
 cast(coalesce(list_position(p.nodes, cast(e.t as bigint)), 0) as bigint)
 from path p join eb e on e.section_id = p.section_id and e.f = p.at
 where p.place = 0 and not list_contains(p.trails, e.trail) and p.d + e.dist <= 2500 and p.g + e.gain <= 400""",
    "walk0": """select section_id, start_id, kind_rank, cast(place - 1 as integer) as stem_steps, trails, itin, array_to_string(itin, ',') as itinerary, array_to_string(list_filter(list_concat(nr, list_reverse(list_slice(nb, 1, place - 1))), lambda x: x <> ''), ',') as trail_itinerary, unsure as uncertain, has_path, r, d, g,
 list_slice(trails, place, len(trails)) as core, case when place > 1 then coalesce(list_sum(list_slice(bd, 1, place - 1)), 0) else 0 end as stem, case when place > 1 then coalesce(list_sum(list_slice(bg, 1, place - 1)), 0) else 0 end as sg,
 case when place > 1 then coalesce(list_sum(list_slice(br, 1, place - 1)), 0) else 0 end as sr from path where place > 0 and not (place > 1 and list_contains(list_slice(bd, 1, place - 1), -1))""",
    "walk": """select section_id, start_id, kind_rank, stem_steps, trails, itin, core, itinerary, trail_itinerary, cast(d + stem as double) as distance, cast(g + sg as double) as gain, cast(r + sr as double) as road, cast(stem as double) as stem, cast(stem / (d + stem) as double) as repetition, uncertain, has_path
 from walk0 where d + stem <= 2500 and g + sg <= 400""",
    "circuit": """select *, array_to_string(least(fwd, bwd), ',') as circuit from (select *, list_concat(list_slice(core, list_position(core, list_min(core)), len(core)), list_slice(core, 1, list_position(core, list_min(core)) - 1)) as fwd,
 list_concat(list_slice(list_reverse(core), list_position(list_reverse(core), list_min(core)), len(core)), list_slice(list_reverse(core), 1, list_position(list_reverse(core), list_min(core)) - 1)) as bwd from walk)""",
    "best": """select * from (select *, row_number() over (partition by section_id, circuit order by kind_rank, uncertain, road, repetition, distance, itinerary, start_id) as pl from circuit) where pl = 1""",
    "route": """select section_id, substr(sha256(section_id || ':' || start_id || ':' || array_to_string(whole, ',')), 1, 32) as route_id, start_id, stem_steps, array_to_string(whole, ',') as itinerary, whole as itin, distance, gain, road, repetition, uncertain
 from (select *, list_concat(itin, list_transform(list_reverse(list_slice(itin, 1, stem_steps)), lambda x: translate(x, '+-', '-+'))) as whole from best)""",
    "rstep": """select section_id, route_id, i as seq, cast(replace(replace(itin[i + 1], '+', ''), '-', '') as bigint) as trail, itin[i + 1] like '%-' as reverse from (select *, unnest(range(0, len(itin))) as i from route)""",
}
N_WALK = "net_trail net_edge net_start eb path walk0 walk"
N_ROUTE = N_WALK + " circuit best route"
COLUMNS = "section_id, start_id, stem_steps, itinerary, distance, gain, road, repetition, uncertain"


def all_walks(s: SparkSession, d: str, q: walks.Query = REACH) -> DataFrame:
    """All walks within the limits of q, searched once in an application."""
    return once(s, d, f"walks {q}", lambda: walks.closed_walks(net.edges(s, d), net.starts(s, d), q))


#: The walk entities of SQL without a limit of climb.
STEEP_WALK = WALK | {k: WALK[k].replace("+ e.gain <= 400", "+ e.gain <= 10000").replace("g + sg <= 400", "g + sg <= 10000") for k in ("path", "walk")}


def shown(w: DataFrame) -> DataFrame:
    return w.select(*COLUMNS.split(", "))


def with_circuit(w: DataFrame) -> DataFrame:
    return w.withColumn("circuit", walks.circuit_key("core_trails"))


def routes(s: SparkSession, d: str) -> DataFrame:
    """The best walk of every circuit, with all its steps: those of a stem out and back."""
    best = walks.best_per(with_circuit(all_walks(s, d)), "section_id", "circuit").withColumn("itinerary", walks.whole())
    return best.select("section_id", scalars.short_sha(F.concat_ws(":", "section_id", "start_id", "itinerary")).alias("route_id"), "start_id", "stem_steps", "itinerary", "distance", "gain", "road", "repetition", "uncertain")


# --- the network itself

for _name, _table, _cte in (("net_nodes", net.nodes, "net_node"), ("net_trails", net.trails, "net_trail"), ("net_edges", net.edges, "net_edge"), ("net_starts", net.starts, "net_start"), ("net_vertices", net.vertices, "net_vertex"), ("net_sections", net.sections, "net_section")):
    QUERIES[_name] = _table
    SQL[_name] = net.with_cte("net_trail net_edge" if _cte == "net_edge" else _cte, f"select * from {_cte}")


@query("select section_id, trail, reverse, dist, gain, back_dist, back_gain from eb", "net_trail net_edge eb")
def edge_reverse_pairs(s, d):
    return walks.with_reverse(net.edges(s, d)).select("section_id", "trail", "reverse", "dist", "gain", "back_dist", "back_gain")


@query("select section_id, max(back_dist / dist) as stem_ratio, max(back_gain - gain) as gain_gap, bool_or(dist = 0) as any_zero from eb group by section_id", "net_trail net_edge eb")
def stem_ratio(s, d):
    e = walks.with_reverse(net.edges(s, d))
    return e.groupBy("section_id").agg(F.max(F.col("back_dist") / F.col("dist")).alias("stem_ratio"), F.max(F.col("back_gain") - F.col("gain")).alias("gain_gap"), F.bool_or(F.col("dist") == 0).alias("any_zero"))


@query("select section_id, trail, f, t, reverse, dist from net_edge where dist <= 800 and gain <= 60 and (not connector or dist <= 300) and access = 'public'", "net_trail net_edge")
def edge_prefilter(s, d):
    return walks.allowed(net.edges(s, d), walks.Query(max_distance=800.0, max_gain=60.0, max_road=300.0, include_unknown=False)).select("section_id", "trail", "f", "t", "reverse", "dist")


@query("select section_id, start_id, node, name from net_start where access = 'public'", "net_start")
def access_public_only(s, d):
    return net.starts(s, d).where("access = 'public'").select("section_id", "start_id", "node", "name")


@query("select section_id, trail, cast(min(floor(dist)) as bigint) as low_dist, cast(max(ceil(dist)) as bigint) as high_dist, cast(min(floor(gain)) as bigint) as low_gain, cast(max(ceil(gain)) as bigint) as high_gain, count(*) as directions from net_edge group by section_id, trail", "net_trail net_edge")
def physical_trail_facts(s, d):
    return net.edges(s, d).groupBy("section_id", "trail").agg(F.min(F.floor("dist")).alias("low_dist"), F.max(F.ceil("dist")).alias("high_dist"), F.min(F.floor("gain")).alias("low_gain"), F.max(F.ceil("gain")).alias("high_gain"), F.count("*").alias("directions"))


@query("select section_id, node, count(distinct trail) as trails, count(distinct other) as neighbours from (select section_id, f as node, t as other, trail from net_edge union all select section_id, t, f, trail from net_edge) group by section_id, node", "net_trail net_edge")
def node_degree(s, d):
    return graph.degrees(net.edges(s, d))


@query("select e.section_id, e.f, e.t as via, e2.t, count(*) as ways, min(e.dist + e2.dist) as shortest from net_edge e join net_edge e2 on e.section_id = e2.section_id and e.t = e2.f and e.trail <> e2.trail where e.connector and e2.connector group by all", "net_trail net_edge")
def adjacency(s, d):
    e = net.edges(s, d).where("connector")
    two = e.select("section_id", F.col("f").alias("via"), "t", F.col("trail").alias("trail2"), F.col("dist").alias("dist2"))
    pairs = e.select("section_id", "f", F.col("t").alias("via"), "trail", "dist").join(two, ["section_id", "via"]).where("trail <> trail2")
    return pairs.groupBy("section_id", "f", "via", "t").agg(F.count("*").alias("ways"), F.min(F.col("dist") + F.col("dist2")).alias("shortest"))


@query("select c.section_id, c.node, c.via as incoming_road from (select section_id, t as node, trail as via, row_number() over (partition by section_id, t order by dist, trail) as pl from net_edge where connector) c where c.pl = 1", "net_trail net_edge")
def incoming_roads(s, d):
    w = Window.partitionBy("section_id", "t").orderBy("dist", "trail")
    return net.edges(s, d).where("connector").withColumn("pl", F.row_number().over(w)).where("pl = 1").select("section_id", F.col("t").alias("node"), F.col("trail").alias("incoming_road"))


_ROADS = "lk as (select section_id, a, b from net_trail where connector and a <> b), cc(section_id, node, c) as (select section_id, a, least(a, b) from lk union select section_id, b, least(a, b) from lk union select l.section_id, case when l.a = cc.node then l.b else l.a end, cc.c from cc join lk l on l.section_id = cc.section_id and (l.a = cc.node or l.b = cc.node)), comp as (select section_id, node, min(c) as component from cc group by section_id, node)"


def _road_components(s, d):
    return graph.components(net.trails(s, d).where("connector and a <> b").select("section_id", "a", "b"))


@query("select * from comp", "")
def components(s, d):
    return _road_components(s, d)


SQL["components"] = f"with recursive net_trail as ({net.CTE['net_trail']}), {_ROADS} select section_id, node, component from comp"


@query("")
def component_length(s, d):
    t = net.trails(s, d).where("connector and a <> b").withColumnRenamed("a", "node")
    return t.join(_road_components(s, d), ["section_id", "node"]).groupBy("section_id", "component").agg(F.sum("dist").alias("metres"), F.count("*").alias("trails"))


SQL["component_length"] = f"with recursive net_trail as ({net.CTE['net_trail']}), {_ROADS} select t.section_id, component, sum(dist) as metres, count(*) as trails from net_trail t join comp c on c.section_id = t.section_id and c.node = t.a where t.connector and t.a <> t.b group by all"


@query("")
def network_500m(s, d):
    """Starts whose node lies on roads of at least 500 m in all, or that are trailheads."""
    long = component_length(s, d).where("metres >= 500").select("section_id", "component")
    held = _road_components(s, d).join(long, ["section_id", "component"], "left_semi").select("section_id", "node", F.lit(True).alias("held"))
    return net.starts(s, d).join(held, ["section_id", "node"], "left").where("kind_rank = 0 or held").select("section_id", "start_id", "node")


SQL["network_500m"] = f"with recursive net_trail as ({net.CTE['net_trail']}), net_start as ({net.CTE['net_start']}), {_ROADS}, len as (select t.section_id, component, sum(dist) as metres from net_trail t join comp c on c.section_id = t.section_id and c.node = t.a where t.connector and t.a <> t.b group by all) select s.section_id, s.start_id, s.node from net_start s left join comp c on c.section_id = s.section_id and c.node = s.node left join len l on l.section_id = c.section_id and l.component = c.component where s.kind_rank = 0 or l.metres >= 500"


# --- searches


@query(f"select {COLUMNS} from walk where stem_steps = 0 and distance between 800 and 2500 and gain between 0 and 400 and has_path and road <= 1609.344 and road / distance <= 5e-1", N_WALK)
def loops_in_range(s, d):
    q = walks.Query(min_distance=800.0, max_distance=2500.0, max_gain=400.0, max_road_share=0.5)
    return shown(walks.qualified(all_walks(s, d).where("stem_steps = 0"), q))


@query("")
def loops_road_limit(s, d):
    return shown(walks.qualified(all_walks(s, d, STEEP).where("stem_steps = 0"), walks.Query(max_distance=2500.0, max_road=500.0)))


SQL["loops_road_limit"] = net.with_cte(N_WALK, f"select {COLUMNS} from walk where stem_steps = 0 and has_path and road <= 500 and road / distance <= 1e-1", STEEP_WALK)


@query(f"select {COLUMNS} from walk where stem_steps = 0 and has_path and not uncertain", N_WALK)
def loops_public(s, d):
    q = walks.Query(max_distance=2500.0, max_gain=400.0, max_road=None, max_road_share=None, include_unknown=False)
    return shown(walks.qualified(all_walks(s, d, q).where("stem_steps = 0"), q))


@query(f"select {COLUMNS} from walk where stem_steps > 0 and has_path", N_WALK)
def lollipops(s, d):
    return shown(walks.qualified(all_walks(s, d).where("stem_steps > 0"), REACH))


@query(f"select {COLUMNS} from walk where stem_steps > 0 and has_path and stem <= 400", N_WALK)
def lollipops_stem_abs(s, d):
    return shown(all_walks(s, d).where("stem_steps > 0 and has_path and stem <= 400"))


@query(f"select {COLUMNS} from walk where has_path and repetition <= 2e-1", N_WALK)
def lollipops_stem_pct(s, d):
    return shown(all_walks(s, d).where("has_path and repetition <= 0.2"))


#: A search with limits of length, climb, road and stem.
HIKES = walks.Query(min_distance=800.0, max_distance=2500.0, min_gain=20.0, max_gain=400.0, max_road=1200.0, max_road_share=0.6, max_repetition=0.5)
_UPPER = "has_path and road <= 1200 and road / distance <= 6e-1 and repetition <= 5e-1"
_LOWER = "distance >= 800 and gain >= 20"
_DOM = f"select * from (select *, case when uncertain then min(road) over p < road else coalesce(min(case when not uncertain then road end) over p < road, false) end as dominated from walk where {_UPPER} window p as (partition by section_id, start_id, trail_itinerary))"


def _upper(s, d):
    return walks.road_minimal(walks.qualified(all_walks(s, d), replace(HIKES, min_distance=0.0, min_gain=0.0)))


@query(f"select section_id, start_id, itinerary, road, trail_itinerary from ({_DOM}) where dominated", N_WALK)
def road_dominated(s, d):
    return _upper(s, d).where("dominated").select("section_id", "start_id", "itinerary", "road", "trail_itinerary")


@query(f"select section_id, start_id, itinerary, road, trail_itinerary from ({_DOM}) where not dominated and {_LOWER}", N_WALK)
def road_minimal_walks(s, d):
    return walks.normalized(all_walks(s, d), HIKES).select("section_id", "start_id", "itinerary", "road", "trail_itinerary")


@query("select section_id, circuit, count(*) as walks, min(distance) as shortest from circuit group by section_id, circuit", N_WALK + " circuit")
def circuit_key(s, d):
    return with_circuit(all_walks(s, d)).groupBy("section_id", "circuit").agg(F.count("*").alias("walks"), F.min("distance").alias("shortest"))


@query(f"select circuit, {COLUMNS} from best", N_WALK + " circuit best")
def best_per_circuit(s, d):
    return walks.best_per(with_circuit(all_walks(s, d)), "section_id", "circuit").select("circuit", *COLUMNS.split(", "))


@query(f"select circuit, {COLUMNS} from (select *, row_number() over (partition by section_id, circuit, start_id, list_contains(itin, list_min(core) || '-') order by kind_rank, uncertain, road, repetition, distance, itinerary, start_id) as pl from circuit) where pl = 1", N_WALK + " circuit")
def best_per_start(s, d):
    """The best walk of each circuit from each start, either way round."""
    found = with_circuit(all_walks(s, d)).withColumn("direction", walks.direction())
    return walks.best_per(found, "section_id", "circuit", "start_id", "direction").select("circuit", *COLUMNS.split(", "))


def _placed(best: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("section_id").orderBy(*walks.preference(best), "circuit"))
    return graph.stored(best.withColumn("place", place))


def _placed_circuits(s, d, q=REACH):
    return once(s, d, f"circuits {q}", lambda: _placed(walks.best_per(with_circuit(all_walks(s, d, q)), "section_id", "circuit")).select("section_id", "circuit", "core_trails", "place"))


def _canon(x: str) -> str:
    rot = lambda y: f"list_concat(list_slice({y}, list_position({y}, list_min({y})), len({y})), list_slice({y}, 1, list_position({y}, list_min({y})) - 1))"
    return f"least({rot(x)}, {rot(f'list_reverse({x})')})"


_PAIRS = f"""posts as (select section_id, circuit, unnest(core) as trail from best), pd as (select p.*, t.dist from posts p join net_trail t on t.section_id = p.section_id and t.trail = p.trail),
sz as (select section_id, circuit, sum(dist) as length from pd group by all),
pr0 as (select x.*, x.shared / greatest(la.length, lb.length) as similarity from (select a.section_id, a.circuit as a, b.circuit as b, sum(a.dist) as shared from pd a join pd b on a.section_id = b.section_id and a.trail = b.trail and a.circuit < b.circuit group by all) x
 join sz la on la.section_id = x.section_id and la.circuit = x.a join sz lb on lb.section_id = x.section_id and lb.circuit = x.b where x.shared / greatest(la.length, lb.length) >= 6e-1),
pr1 as (select pr0.*, list_filter(x.core, lambda t: list_contains(y.core, t)) as ca, list_filter(y.core, lambda t: list_contains(x.core, t)) as cb from pr0 join best x on x.section_id = pr0.section_id and x.circuit = pr0.a join best y on y.section_id = pr0.section_id and y.circuit = pr0.b),
pr as (select section_id, a, b, shared, similarity from pr1 where {_canon('ca')} = {_canon('cb')})"""
_GROUPS = """placed as (select section_id, circuit, row_number() over (partition by section_id order by kind_rank, uncertain, road, repetition, distance, itinerary, start_id, circuit) as place from best),
nb as (select pr.section_id, greatest(x.place, y.place) as place, list(least(x.place, y.place)) as es from pr join placed x on x.section_id = pr.section_id and x.circuit = pr.a join placed y on y.section_id = pr.section_id and y.circuit = pr.b group by all),
rep(section_id, place, reps) as (select distinct section_id, cast(1 as bigint), [cast(1 as bigint)] from placed union all select p.section_id, p.place, case when list_has_any(r.reps, coalesce(nb.es, [])) then r.reps else list_append(r.reps, p.place) end from rep r join placed p on p.section_id = r.section_id and p.place = r.place + 1 left join nb on nb.section_id = p.section_id and nb.place = p.place),
reps as (select section_id, arg_max(reps, place) as reps from rep group by section_id),
grp as (select p.section_id, p.circuit, p.place, case when list_contains(reps, p.place) then p.place else list_min(list_intersect(reps, es)) end as head from placed p join reps using (section_id) left join nb on nb.section_id = p.section_id and nb.place = p.place)"""


@query("")
def circuit_similarity(s, d):
    c = _placed_circuits(s, d)
    return walks.similarity(c, net.trails(s, d).select("section_id", "trail", "dist")).select("section_id", "a", "b", "shared", F.round("similarity", 9).alias("similarity"))


SQL["circuit_similarity"] = net.with_cte(N_WALK + " circuit best", f", {_PAIRS} select section_id, a, b, shared, round(similarity, 9) as similarity from pr", WALK).replace(")\n, posts", "),\nposts")


@query("")
def distinct_hikes(s, d):
    c = _placed_circuits(s, d)
    return walks.distinct_hikes(c, walks.similarity(c, net.trails(s, d).select("section_id", "trail", "dist")))


SQL["distinct_hikes"] = net.with_cte(N_WALK + " circuit best", f", {_PAIRS}, {_GROUPS} select g.section_id, g.circuit, h.circuit as group_circuit from grp g join placed h on h.section_id = g.section_id and h.place = g.head", WALK).replace(")\n, posts", "),\nposts")


@query("")
def search_hikes(s, d):
    """A whole search: walks within all limits, without those that less road would serve, the best of every circuit, one
    hike for each group of similar circuits, named by its circuit."""
    found = walks.normalized(all_walks(s, d), HIKES)
    best = _placed(walks.best_per(with_circuit(found), "section_id", "circuit"))
    groups = walks.distinct_hikes(best, walks.similarity(best, net.trails(s, d).select("section_id", "trail", "dist")))
    shown_ones = groups.where("circuit = group_circuit").select("section_id", "circuit")
    sizes = groups.groupBy("section_id", F.col("group_circuit").alias("circuit")).agg(F.count("*").alias("circuits"))
    hikes = best.join(shown_ones, ["section_id", "circuit"], "left_semi").join(sizes, ["section_id", "circuit"])
    return hikes.select(F.concat(F.lit("family-"), scalars.short_sha(F.concat_ws(":", "section_id", "circuit"))).alias("group_id"), "circuits", *COLUMNS.split(", "))


_HIKES_WALK = WALK | {"circuit": WALK["circuit"].replace("from walk)", f"from (select * from ({_DOM}) where not dominated and {_LOWER}))")}
SQL["search_hikes"] = net.with_cte(N_WALK + " circuit best", f", {_PAIRS}, {_GROUPS} select 'family-' || substr(sha256(b.section_id || ':' || b.circuit), 1, 32) as group_id, n.circuits, {', '.join('b.' + c for c in COLUMNS.split(', '))} from grp g join best b on b.section_id = g.section_id and b.circuit = g.circuit join (select section_id, head, count(*) as circuits from grp group by all) n on n.section_id = g.section_id and n.head = g.place where g.head = g.place", _HIKES_WALK).replace(")\n, posts", "),\nposts")


# --- the same searches with limits of their own, which the expansion prunes by


@query(SQL["loops_in_range"])
def loops_in_range_whole(s, d):
    q = walks.Query(min_distance=800.0, max_distance=2500.0, max_gain=400.0, max_road_share=0.5)
    return shown(walks.qualified(all_walks(s, d, q).where("stem_steps = 0"), q))


@query(SQL["loops_road_limit"])
def loops_road_limit_whole(s, d):
    q = walks.Query(max_distance=2500.0, max_road=500.0)
    return shown(walks.qualified(all_walks(s, d, q).where("stem_steps = 0"), q))


@query(SQL["loops_public"])
def loops_public_whole(s, d):
    q = replace(WHOLE, include_unknown=False)
    return shown(walks.qualified(all_walks(s, d, q).where("stem_steps = 0"), q))


@query(SQL["lollipops"])
def lollipops_whole(s, d):
    return shown(walks.qualified(all_walks(s, d, WHOLE).where("stem_steps > 0"), WHOLE))


@query(SQL["best_per_circuit"])
def best_per_circuit_whole(s, d):
    return walks.best_per(with_circuit(all_walks(s, d, WHOLE)), "section_id", "circuit").select("circuit", *COLUMNS.split(", "))


# --- results

_R = N_ROUTE
_RS = N_ROUTE + " rstep"


@query("select * exclude (itin) from route order by distance, route_id limit 50", _R)
def route_page_distance(s, d):
    return results.page(routes(s, d))


@query("select * exclude (itin) from route order by gain desc, route_id limit 50 offset 50", _R)
def route_page_gain_desc(s, d):
    return results.page(routes(s, d), "gain", True, 1)


@query("select section_id, route_id, row_number() over (partition by section_id order by case when uncertain then null else road end desc nulls last, route_id) as place from route", _R)
def hike_compare_nulls_last(s, d):
    r = routes(s, d).withColumn("sure_road", F.when(~F.col("uncertain"), F.col("road")))
    return results.compared(r, "sure_road", True).select("section_id", "route_id", "place")


@query("select section_id, route_id, road = 0 as pinned, row_number() over (partition by section_id order by road = 0 desc, distance, route_id) as place from route", _R)
def starred_first(s, d):
    r = graph.stored(routes(s, d))
    return results.pinned_first(r, r.where("road = 0")).select("section_id", "route_id", "pinned", "place")


def _steps(s, d):
    return results.steps(routes(s, d))


@query("select * from rstep", _RS)
def route_segments(s, d):
    return _steps(s, d)


_NAMES = "select route_id, name, metres, row_number() over (partition by route_id order by metres desc, first_seq) as place from (select r.route_id, t.name, coalesce(sum(t.dist) filter (r.seq >= w.stem_steps and r.seq < len(w.itin) - w.stem_steps), 0) as metres, min(r.seq) as first_seq from rstep r join route w on w.section_id = r.section_id and w.route_id = r.route_id join net_trail t on t.section_id = r.section_id and t.trail = r.trail where t.name is not null and not t.connector group by r.route_id, t.name)"


@query(_NAMES, _RS)
def route_name_weights(s, d):
    r = graph.stored(routes(s, d))
    return results.name_weights(results.steps(r), net.trails(s, d), r).drop("first_seq")


def _titles(s, d, r):
    return results.display_names(results.name_weights(results.steps(r), net.trails(s, d), r), r, net.starts(s, d))


@query(f"select w.route_id, coalesce(n.title, b.name, 'Unnamed trails') as title from route w left join (select route_id, string_agg(name, ' / ' order by place) as title from ({_NAMES}) where place <= 2 group by route_id) n on n.route_id = w.route_id left join net_start b on b.section_id = w.section_id and b.start_id = w.start_id", _RS)
def route_names(s, d):
    return _titles(s, d, graph.stored(routes(s, d)))


@query("select route_id, min(lon) as west, min(lat) as south, max(lon) as east, max(lat) as north, max(ele) as peak from (select distinct r.route_id, n.node, lon, lat, ele from rstep r join net_trail t on t.section_id = r.section_id and t.trail = r.trail join net_node n on n.section_id = r.section_id and (n.node = t.a or n.node = t.b)) group by route_id", _RS.replace("net_trail", "net_trail net_node", 1))
def route_locations(s, d):
    return results.extents(_steps(s, d), net.trails(s, d), net.nodes(s, d))


@query("select section_id, trail, row_number() over (partition by section_id, trail order by distance, route_id) as place, route_id from (select distinct s.section_id, s.trail, s.route_id, r.distance from rstep s join route r on r.route_id = s.route_id)", _RS)
def route_paths(s, d):
    r = graph.stored(routes(s, d))
    return results.shared_paths(results.steps(r), r)


_GEO = """geo as (select s.route_id, 0 as seq, case when s.reverse then t.b else t.a end as node, s.section_id from rstep s join net_trail t on t.section_id = s.section_id and t.trail = s.trail where s.seq = 0
 union all select s.route_id, s.seq + 1, case when s.reverse then t.a else t.b end, s.section_id from rstep s join net_trail t on t.section_id = s.section_id and t.trail = s.trail)"""


@query("")
def gpx_points(s, d):
    return results.joined_geometry(_steps(s, d), net.trails(s, d), net.nodes(s, d))


SQL["gpx_points"] = net.with_cte("net_node " + _RS, f", {_GEO} select g.route_id, cast(g.seq as bigint) as seq, g.node, n.lon, n.lat, n.ele from geo g left join net_node n on n.section_id = g.section_id and n.node = g.node", WALK).replace(")\n, geo", "),\ngeo")


@query()
def gpx_export(s, d):
    r = graph.stored(routes(s, d))
    return results.gpx(results.joined_geometry(results.steps(r), net.trails(s, d), net.nodes(s, d)), _titles(s, d, r))


# --- profiles

_SAMPLE = """vc as (select section_id, trail, count(*) as n from net_vertex group by all), tb as (select t.*, coalesce(n, 0) as n from net_trail t left join vc using (section_id, trail)),
sample as (select tb.section_id, tb.trail, cast(0 as bigint) as seq, cast(0 as double) as d, ele as h from tb left join net_node n on n.section_id = tb.section_id and n.node = tb.a
 union all select v.section_id, v.trail, v.seq, dist * v.seq / (n + 1), v.ele from net_vertex v join tb using (section_id, trail)
 union all select tb.section_id, tb.trail, n + 1, dist, ele from tb left join net_node n on n.section_id = tb.section_id and n.node = tb.b)"""


def _sample_sql(body: str) -> str:
    return net.with_cte("net_trail net_node net_vertex", f", {_SAMPLE} {body}").replace(")\n, vc", "),\nvc")


def _samples(s, d):
    return profile.samples(net.trails(s, d), net.nodes(s, d), net.vertices(s, d))


@query(_sample_sql("select section_id, trail, seq, round(d, 6) as d, h from sample"))
def trail_profile(s, d):
    return _samples(s, d).select("section_id", "trail", "seq", F.round("d", 6).alias("d"), "h")


_CLIMB = "select section_id, trail, case when count(h) = count(*) then sum(greatest(rise, 0)) end as gain, case when count(h) = count(*) then sum(greatest(-rise, 0)) end as loss, case when count(h) = count(*) then max(h) end as peak from (select *, h - lag(h) over (partition by section_id, trail order by seq) as rise from sample) group by section_id, trail"


@query(_sample_sql(f"select section_id, trail, gain, loss from ({_CLIMB})"))
def trail_climb(s, d):
    return profile.climbs(_samples(s, d)).select("section_id", "trail", "gain", "loss")


@query(_sample_sql(f"select section_id, trail, peak from ({_CLIMB})"))
def trail_high_point(s, d):
    return profile.climbs(_samples(s, d)).select("section_id", "trail", "peak")


@query(_sample_sql("""select section_id, trail, round(case when mid = d1 then h1 else h0 + (h1 - h0) * (mid - d0) / (d1 - d0) end, 6) as height from (select *, row_number() over (partition by section_id, trail order by seq) as pl from
 (select x.*, t.dist / 2 as mid from (select section_id, trail, seq, lag(d) over w as d0, lag(h) over w as h0, d as d1, h as h1 from sample window w as (partition by section_id, trail order by seq)) x join net_trail t using (section_id, trail)) where d1 > d0 and mid >= d0 and mid <= d1) where pl = 1"""))
def interpolate_at(s, d):
    places = net.trails(s, d).select("section_id", "trail", (F.col("dist") / 2).alias("at"))
    return profile.heights_at(_samples(s, d), places).select("section_id", "trail", F.round("height", 6).alias("height"))


@query("""select r.route_id, case when bool_and(p.peak is not null) then max(p.peak) end as peak from rstep r join pk p on p.section_id = r.section_id and p.trail = r.trail group by r.route_id""")
def route_high_point(s, d):
    peaks = profile.climbs(_samples(s, d)).select("section_id", "trail", "peak")
    return _steps(s, d).join(peaks, ["section_id", "trail"]).groupBy("route_id").agg(F.when(F.count("peak") == F.count("*"), F.max("peak")).alias("peak"))


SQL["route_high_point"] = net.with_cte("net_node net_vertex " + _RS, f", {_SAMPLE}, pk as ({_CLIMB}) {SQL['route_high_point']}", WALK).replace(")\n, vc", "),\nvc")


# --- geometry

_HAV = "asin(least(1.0, sqrt(pow(sin(radians(n2.lat - n1.lat) / 2), 2) + cos(radians(n1.lat)) * cos(radians(n2.lat)) * pow(sin(radians(n2.lon - n1.lon) / 2), 2)))) * 12742017.6"


@query(f"select t.section_id, t.trail, round({_HAV}, 3) as metres from net_trail t join net_node n1 on n1.section_id = t.section_id and n1.node = t.a join net_node n2 on n2.section_id = t.section_id and n2.node = t.b", "net_trail net_node")
def haversine_edges(s, d):
    n = net.nodes(s, d)
    one, two = n.select("section_id", F.col("node").alias("a"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), n.select("section_id", F.col("node").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    t = net.trails(s, d).join(one, ["section_id", "a"]).join(two, ["section_id", "b"])
    return t.select("section_id", "trail", F.round(spatial.haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), 3).alias("metres"))


#: A drawn area (a concave ring) with a hole.
OUTER = ((-121.995, 47.005), (-121.855, 47.012), (-121.905, 47.085), (-121.845, 47.165), (-121.985, 47.155))
HOLE = ((-121.965, 47.055), (-121.935, 47.055), (-121.935, 47.095), (-121.965, 47.095))


def _rings(s: SparkSession, hole: bool) -> DataFrame:
    rows = [(0, 0, False, [*OUTER])] + ([(0, 1, True, [*HOLE])] if hole else [])
    return s.createDataFrame(rows, "area int, ring int, hole boolean, points array<struct<x:double,y:double>>")


def _ring_sql(ring, strict: bool) -> str:
    """Even-odd test of n.lon, n.lat against a literal ring; edges count unless strict."""
    odd, on = [], []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        x1, y1, x2, y2 = (f"({v!r}e0)" for v in (x1, y1, x2, y2))
        odd.append(f"case when (({y1} > n.lat) <> ({y2} > n.lat)) and n.lon < ({x2} - {x1}) * (n.lat - {y1}) / ({y2} - {y1}) + {x1} then 1 else 0 end" if y1 != y2 else "0")
        on.append(f"(abs(({x2} - {x1}) * (n.lat - {y1}) - ({y2} - {y1}) * (n.lon - {x1})) <= 1e-12 and n.lon between least({x1}, {x2}) and greatest({x1}, {x2}) and n.lat between least({y1}, {y2}) and greatest({y1}, {y2}))")
    inside, edge = f"(({' + '.join(odd)}) % 2 = 1)", f"({' or '.join(on)})"
    return f"({inside} and not {edge})" if strict else f"({inside} or {edge})"


@query(f"select n.section_id, n.node from net_node n where {_ring_sql(OUTER, False)}", "net_node")
def point_in_ring(s, d):
    return spatial.points_in_areas(net.nodes(s, d), _rings(s, False), "section_id", "node").drop("area")


@query(f"select n.section_id, n.node from net_node n where {_ring_sql(OUTER, False)} and not {_ring_sql(HOLE, True)}", "net_node")
def point_in_area_with_hole(s, d):
    return spatial.points_in_areas(net.nodes(s, d), _rings(s, True), "section_id", "node").drop("area")


@query(f"select s.section_id, s.start_id, s.name from net_start s join net_node n on n.section_id = s.section_id and n.node = s.node where {_ring_sql(OUTER, False)}", "net_start net_node")
def starts_in_area(s, d):
    inside = spatial.points_in_areas(net.nodes(s, d), _rings(s, False), "section_id", "node")
    return net.starts(s, d).join(inside, ["section_id", "node"], "left_semi").select("section_id", "start_id", "name")


@query("select a.area_id as a, b.area_id as b from net_section a join net_section b on a.area_id < b.area_id and a.west <= b.east and b.west <= a.east and a.south <= b.north and b.south <= a.north", "net_section")
def bbox_overlap(s, d):
    x = net.sections(s, d)
    sides = ("west", "south", "east", "north")
    # the grid cell is the join key; a pair that meets in several cells is one
    held = x.withColumn("cx", F.explode(spatial.cells("west", "east", 0.1))).withColumn("cy", F.explode(spatial.cells("south", "north", 0.1)))
    a, b = (held.select("cx", "cy", F.col("area_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in sides)) for k in "ab")
    box = lambda k: tuple(F.col(f"{c}_{k}") for c in sides)
    return a.join(b, ["cx", "cy"]).where((F.col("a") < F.col("b")) & spatial.boxes_overlap(box("a"), box("b"))).select("a", "b").distinct()


@query("select area_id, name from net_section where west <= -121.9 and east >= -121.95 and south <= 47.1 and north >= 47.05", "net_section")
def sections_in_view(s, d):
    view = (F.lit(-121.95), F.lit(47.05), F.lit(-121.9), F.lit(47.1))
    return net.sections(s, d).where(spatial.boxes_overlap(tuple(map(F.col, ("west", "south", "east", "north"))), view)).select("area_id", "name")


@query("select s.section_id || '/' || s.start_id as id, s.name, n.lon, n.lat from net_start s join net_node n on n.section_id = s.section_id and n.node = s.node", "net_start net_node")
def access_points(s, d):
    return net.starts(s, d).join(net.nodes(s, d), ["section_id", "node"]).select(F.concat_ws("/", "section_id", "start_id").alias("id"), "name", "lon", "lat")


@query("select section_id, node from net_node where lon between -122 - 25e-3 and -121.9 + 25e-3 and lat between 47 - 25e-3 and 47.1 + 25e-3", "net_node")
def viewport_filter(s, d):
    return net.nodes(s, d).where(F.col("lon").between(F.lit(-122) - F.lit(25e-3), F.lit(-121.9) + F.lit(25e-3)) & F.col("lat").between(F.lit(47) - F.lit(25e-3), F.lit(47.1) + F.lit(25e-3))).select("section_id", "node")


@query("select lon, lat, string_agg(start_id, ',' order by start_id) as starts, count(*) as n from net_start s join net_node n on n.section_id = s.section_id and n.node = s.node group by lon, lat", "net_start net_node")
def start_points(s, d):
    rows = net.starts(s, d).join(net.nodes(s, d), ["section_id", "node"])
    return rows.groupBy("lon", "lat").agg(F.array_join(F.array_sort(F.collect_list("start_id")).cast("array<string>"), ",").alias("starts"), F.count("*").alias("n"))


@query("select cast(floor(lon / 5e-2) as bigint) as cx, cast(floor(lat / 5e-2) as bigint) as cy, count(*) as starts from net_start s join net_node n on n.section_id = s.section_id and n.node = s.node group by 1, 2", "net_start net_node")
def start_grid_clusters(s, d):
    rows = net.starts(s, d).join(net.nodes(s, d), ["section_id", "node"])
    return rows.groupBy(F.floor(F.col("lon") / F.lit(5e-2)).alias("cx"), F.floor(F.col("lat") / F.lit(5e-2)).alias("cy")).agg(F.count("*").alias("starts"))


_LERP = "((((179.5e0 + ((((lon - 179.5e0 + 540) % 360 + 360) % 360) - 180) * 25e-2 + 540) % 360) + 360) % 360) - 180"


@query(f"select section_id, node, round({_LERP}, 9) as lon from net_node", "net_node")
def antimeridian_lerp(s, d):
    return net.nodes(s, d).select("section_id", "node", F.round(spatial.lerp_lon(F.lit(179.5), F.col("lon"), F.lit(0.25)), 9).alias("lon"))


@query("""select p_partkey as id, case when count(value) = count(*) then round(sum(w * value), 6) end as height from (select p_partkey, value, (case when i = 1 then fr else 1 - fr end) * (case when j = 1 then fc else 1 - fc end) as w
 from (select p_partkey, floor(p_partkey / 10) as r0, p_partkey % 10 as c0, (p_partkey % 4) * 25e-2 as fr, (p_partkey % 3) * 5e-1 - floor((p_partkey % 3) * 5e-1) as fc, (p_partkey % 3) * 5e-1 as oc from part) q
 cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j) left join pixel x on x.row = q.r0 + i and x.col = floor(q.c0 + q.oc) + j where (case when i = 1 then fr else 1 - fr end) * (case when j = 1 then fc else 1 - fc end) > 1e-12) group by p_partkey""", "pixel")
def bilinear_sample(s, d):
    k = F.col("p_partkey")
    points = net.table(s, d, "part").select(k.alias("id"), (F.floor(k / 10) + (k % 4) * F.lit(25e-2)).alias("r"), (k % 10 + (k % 3) * F.lit(5e-1)).alias("c"))
    return spatial.bilinear(points, net.pixels(s, d), "id").select("id", F.round("height", 6).alias("height"))


@query("select section_id, trail, unnest(range(0, cast(ceil(dist / 25) as bigint) + 1)) as i, dist from net_trail", "net_trail")
def densify_25m(s, d):
    return net.trails(s, d).select("section_id", "trail", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("dist") / 25))).alias("i"), "dist")


@query("select section_id, trail, cast(case when r <= p then p when r <= 2 * p then 2 * p when r <= 5 * p then 5 * p else 10 * p end as double) as step from (select *, dist / 5 as r, pow(10.0, floor(log10(dist / 5))) as p from net_trail)", "net_trail")
def tick_step(s, d):
    return net.trails(s, d).select("section_id", "trail", scalars.tick_step("dist").alias("step"))


# --- catalog


@query("select n.area_id, n.name, count(s.start_id) as starts from net_section n left join net_start s on s.section_id = n.area_id group by all having count(s.start_id) = 0", "net_section net_start")
def coverage_missing(s, d):
    missing = net.sections(s, d).join(net.starts(s, d).select(F.col("section_id").alias("area_id")), "area_id", "left_anti")
    return missing.select("area_id", "name", F.lit(0).cast("long").alias("starts"))


@query("select r_name as region, count(*) as areas, string_agg(n_name, ', ' order by n_name) as names, count(*) > 1 as headed from nation join region on r_regionkey = n_regionkey group by r_name")
def catalog_groups(s, d):
    rows = net.table(s, d, "nation").join(net.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("areas"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"), (F.count("*") > 1).alias("headed"))


@query("select c_mktsegment as job, case when count(distinct r_name) = 1 then min(r_name) else count(distinct r_name) || ' regions' end as label, count(distinct n_nationkey) as areas from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by c_mktsegment")
def area_summary(s, d):
    t = lambda n: net.table(s, d, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = F.countDistinct("r_name")
    return rows.groupBy(F.col("c_mktsegment").alias("job")).agg(F.when(n == 1, F.min("r_name")).otherwise(F.concat(n.cast("string"), F.lit(" regions"))).alias("label"), F.countDistinct("n_nationkey").alias("areas"))


@query("select min(south) as south, min(west) as west, max(north) as north, max(east) as east, count(*) as sections, (select strftime(min(o_orderdate), '%Y-%m-%d') from orders) as source_date from net_section", "net_section")
def compose_catalog(s, d):
    box = net.sections(s, d).agg(F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east"), F.count("*").alias("sections"))
    return box.crossJoin(net.table(s, d, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("source_date")))  # one row each


# --- identity and text


@query("""select id, cast(h as bigint) as hash from f where i = length(text)""")
def fnv1a(s, d):
    return net.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), scalars.fnv1a("n_name").alias("hash"))


SQL["fnv1a"] = "with recursive f(id, text, i, h) as (select cast(n_nationkey as bigint), n_name, 0, cast(2166136261 as bigint) from nation union all select id, text, i + 1, (xor(h, cast(ascii(substr(text, i + 1, 1)) as bigint)) * 16777619) & 4294967295 from f where i < length(text)) " + SQL["fnv1a"]


@query("select route_id, distance, gain, cast(round(gain / 0.3048) as bigint) || ' ft' as climb_text from route", _R)
def unit_text(s, d):
    return routes(s, d).select("route_id", "distance", "gain", scalars.climb_text("gain").alias("climb_text"))


@query("select p_partkey, replace(replace(replace(replace(replace(p_name || ' <' || p_brand || '> & \"' || p_type || '\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') as safe from part")
def xml_escape(s, d):
    text = F.concat(F.col("p_name"), F.lit(" <"), F.col("p_brand"), F.lit('> & "'), F.col("p_type"), F.lit('"'))
    return net.table(s, d, "part").select("p_partkey", scalars.xml_escape(text).alias("safe"))


@query("select doc_id, regexp_replace(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 150), '-+$', '') as slug from documents")
def slug(s, d):
    return net.table(s, d, "documents").select("doc_id", scalars.slug("text").alias("slug"))


@query()
def slug_whole(s, d):
    """Slugs of whole texts in every language, without marks."""
    return net.table(s, d, "documents").select("doc_id", scalars.slug(scalars.without_marks(F.col("text"))).alias("slug"))


@query("select c_custkey, case when regexp_matches(x, '^[0-9]') then 'US' || x else x end as ref from (select c_custkey, regexp_replace(upper(regexp_replace(ref, '\\s+', '', 'g')), '^SR', 'WA') as x from (select c_custkey, case c_custkey % 3 when 0 then 'sr ' || c_custkey when 1 then 'i- ' || c_custkey else '' || c_custkey end as ref from customer))")
def ref_normalise(s, d):
    k = F.col("c_custkey")
    ref = F.when(k % 3 == 0, F.concat(F.lit("sr "), k)).when(k % 3 == 1, F.concat(F.lit("i- "), k)).otherwise(k.cast("string"))
    return net.table(s, d, "customer").select("c_custkey", scalars.road_ref(ref, F.lit("US")).alias("ref"))


@query("select section_id, node, -122 + (node % 20) * 1e-2 as lon, lat from net_node", "net_node")
def coordinate_parse(s, d):
    n = net.nodes(s, d)
    text = F.concat_ws(", ", F.format_string("%.2f° N", "lat"), F.format_string("%.2f° W", -F.col("lon")))
    parsed = n.withColumn("p", scalars.coordinate(text))
    return parsed.select("section_id", "node", F.round("p.lon", 2).alias("lon"), F.round("p.lat", 2).alias("lat"))


SQL["coordinate_parse"] = net.with_cte("net_node", "select section_id, node, round(lon, 2) as lon, round(lat, 2) as lat from net_node")


@query("select event_id, case when h > 0 then h || 'h ' || m || 'm' when m > 0 then m || 'm ' || r || 's' else r || 's' end as elapsed from (select event_id, cast(floor(s / 3600) as bigint) as h, cast(floor(s % 3600 / 60) as bigint) as m, s % 60 as r from (select event_id, event_id * 7 as s from events))")
def elapsed_text(s, d):
    return net.table(s, d, "events").select("event_id", scalars.elapsed_text(F.col("event_id") * 7).alias("elapsed"))


# --- preparation

@query("select section_id, least(a, b) as u, greatest(a, b) as v, max(case access when 'public' then 0 else 1 end) as access_rank, bool_or(connector) as connector, min(dist) as dist, count(*) as copies from net_trail group by 1, 2, 3", "net_trail")
def segment_dedup(s, d):
    return prepare.merged_segments(net.trails(s, d))


@query("select a.area_id, count(*) as segments, count(*) <= 700000 as fits from net_section a join net_node n on n.lon >= a.west and n.lon < a.east and n.lat >= a.south and n.lat < a.north join net_trail t on t.section_id = n.section_id and t.a = n.node group by a.area_id", "net_section net_node net_trail")
def segment_count_by_section(s, d):
    return prepare.segment_counts(net.trails(s, d), net.nodes(s, d), net.sections(s, d))


# --- jobs


@query("select visitor, position, status from (select *, row_number() over (partition by visitor order by position desc) as pl from job) where pl = 1", "job")
def job_latest(s, d):
    return jobs.latest(net.jobs(s, d), "visitor").select("visitor", "position", "status")


@query("select position, visitor, status from job where status = 'queued' order by position limit 1", "job")
def job_fifo(s, d):
    return jobs.fifo(net.jobs(s, d)).select("position", "visitor", "status")


@query("select position, visitor, status from job where position < 500 order by position desc limit 51", "job")
def job_history_page(s, d):
    return jobs.history_page(net.jobs(s, d), 500).select("position", "visitor", "status")


@query("select visitor, active, active < 2 and (select count(*) from (select *, row_number() over (partition by visitor order by position desc) as pl from job) where pl = 1 and status in ('queued', 'running')) < 20 as admitted from (select visitor, sum(case when status in ('queued', 'running') then 1 else 0 end)::bigint as active from (select *, row_number() over (partition by visitor order by position desc) as pl from job) where pl = 1 group by visitor)", "job")
def job_admission(s, d):
    return jobs.admission(jobs.latest(net.jobs(s, d), "visitor"))


@query("select position, visitor, cast(floor((epoch_us(created_at) - epoch_us(lag(created_at) over (partition by visitor order by position))) / 1000) as bigint) as elapsed_ms from job", "job")
def job_elapsed(s, d):
    return jobs.elapsed(net.jobs(s, d)).select("position", "visitor", "elapsed_ms")


@query("select strftime(created_at, '%Y-%m') as month, least(count(*), 4500) as used from job group by 1", "job")
def monthly_quota(s, d):
    return jobs.monthly_usage(net.jobs(s, d))


@query("select position, visitor, status from (select *, sum(case when status not in ('queued', 'running') then 1 else 0 end) over (partition by visitor order by position desc rows unbounded preceding) as nth from (select position, visitor, case when status = 'running' then 'interrupted' else status end as status from job)) where status = 'queued' or nth <= 50", "job")
def merge_jobs(s, d):
    j = net.jobs(s, d)
    return jobs.merge(j, jobs.recovered(j)).select("position", "visitor", "status")


@query("select position from job where status = 'running'", "job")
def finished_ids(s, d):
    j = net.jobs(s, d)
    return jobs.finished(j, jobs.recovered(j)).select("position")


@query("select position, visitor, status, before from (select *, lag(status) over (partition by visitor order by position) as before from job) where before is not null and not (before = 'queued' and status in ('running', 'cancelled', 'failed') or before = 'running' and status in ('completed', 'cancelled', 'failed', 'interrupted'))", "job")
def job_invalid_transitions(s, d):
    return jobs.invalid_transitions(net.jobs(s, d), "visitor").select("position", "visitor", "status", "before")


@query("select position, visitor = 7 as owner, case when visitor = 7 then value end as value from job", "job")
def job_redacted(s, d):
    return jobs.redacted(net.jobs(s, d), 7).select("position", "owner", "value")


# --- bounded discovery

_REACHED = "rp as (select section_id, start_id as root, cast(node as bigint) as node, cast(0 as double) as d, [cast(node as bigint)] as seen from net_start union all select r.section_id, r.root, cast(e.t as bigint), r.d + e.dist, list_append(r.seen, cast(e.t as bigint)) from rp r join net_edge e on e.section_id = r.section_id and e.f = r.node where r.d + e.dist <= 1200 and not list_contains(r.seen, cast(e.t as bigint)))"


def _trees(s, d, limit=1200.0):
    roots = net.starts(s, d).select("section_id", F.col("start_id").alias("root"), "node")
    return bounded.forest(net.edges(s, d), roots, limit)


@query("")
def shortest_path_forest(s, d):
    return _trees(s, d).select("section_id", "root", "node", "d")


SQL["shortest_path_forest"] = net.with_cte("net_trail net_edge net_start", f", {_REACHED} select section_id, root, node, min(d) as d from rp group by all").replace(")\n, rp", "),\nrp")


@query("select section_id, circuit, band, row_number() over (partition by section_id order by turn, band, circuit) as place from (select *, row_number() over (partition by section_id, band order by score, circuit) as turn from (select section_id, circuit, cast(floor(distance / 500) as bigint) as band, abs(distance - 1250) + road as score from best))", N_WALK + " circuit best")
def proposals_interleaved(s, d):
    best = walks.best_per(with_circuit(all_walks(s, d)), "section_id", "circuit")
    rows = best.select("section_id", "circuit", F.floor(F.col("distance") / 500).alias("band"), (F.abs(F.col("distance") - 1250) + F.col("road")).alias("score"))
    return bounded.interleaved(rows).select("section_id", "circuit", "band", "place")


_ENDS = "ends as (select section_id, trail, a as u, b as v, dist from net_trail union all select section_id, trail, b, a, dist from net_trail)"


@query("")
def local_variants(s, d):
    return bounded.detours(net.trails(s, d))


SQL["local_variants"] = f"with net_trail as ({net.CTE['net_trail']}), {_ENDS} select t.section_id, t.trail, cast(e.trail as varchar) as by, e.dist from net_trail t join ends e on e.section_id = t.section_id and e.u = t.a and e.v = t.b and e.trail <> t.trail union all select t.section_id, t.trail, x.trail || ',' || y.trail, x.dist + y.dist from net_trail t join ends x on x.section_id = t.section_id and x.u = t.a join ends y on y.section_id = t.section_id and y.u = x.v and y.v = t.b where t.a <> t.b and x.trail <> t.trail and y.trail <> t.trail and x.trail <> y.trail and x.v <> t.a and x.v <> t.b"


# --- files


@query("select section_id, trail, count(*) as points, count(ele) as heights from net_vertex group by section_id, trail", "net_vertex")
def geometry_round_trip(s, d):
    """Vertices written as section files, read again for the trails that have some."""
    v = net.vertices(s, d).withColumn("lon", F.col("seq") * 1.0).withColumn("lat", F.col("trail") * 1.0)
    folder = graph.shared_folder(s)
    sources.write_geometry(v, folder)
    back = sources.read_geometry(s, folder, v.select("section_id", "trail").distinct())
    return back.select("section_id", "trail", F.size("coordinates").cast("long").alias("points"), F.size(F.filter("coordinates", lambda c: F.size(c) == 3)).cast("long").alias("heights"))


@query("select c_custkey as id, 'footway & ' || c_mktsegment || ', x' as name, 4 - c_custkey % 3 as nodes from customer")
def map_records(s, d):
    k = F.col("c_custkey").cast("string")
    refs = F.array_join(F.transform(F.sequence(F.lit(1), (4 - F.col("c_custkey") % 3).cast("int")), lambda i: F.concat(F.lit("n"), i.cast("string"))), ",")
    line = F.concat(F.lit("w"), k, F.lit(" Thighway=path,name=footway%20%%26%%20%"), F.col("c_mktsegment"), F.lit("%2c%%20%x N"), refs)
    rows = sources.map_records(net.table(s, d, "customer").select(line.alias("value")))
    return rows.select("id", F.col("tags")["name"].alias("name"), F.size("nodes").cast("long").alias("nodes"))


# --- streams


def _job_stream(s, d):
    return net.job_rows(streaming.table_stream(s, d, "events"))


@query("select visitor, max(position) as last_position, count(*) as events from job group by visitor", "job")
def stream_progress(s, d):
    return streaming.settled(streaming.progress(_job_stream(s, d)), graph.shared_folder(s))


@query("select strftime(created_at, '%Y-%m') as month, least(count(*), 4500) as used from job group by 1", "job")
def stream_quota(s, d):
    return streaming.settled(streaming.monthly_usage(_job_stream(s, d)), graph.shared_folder(s)).select(F.date_format("month", "yyyy-MM").alias("month"), "used")


# --- more of profiles, areas and names


@query(_sample_sql("""select t.section_id, t.trail, round(100 * (h_hi - h_lo) / (hi - lo), 6) + case when exists (select 1 from sample x where x.section_id = t.section_id and x.trail = t.trail and x.h is null and x.d between t.lo and t.hi) then null else 0 end as grade from (select section_id, trail, dist, greatest(dist / 2 - 50, 0) as lo, least(dist / 2 + 50, dist) as hi from net_trail) t
 join lateral (select case when t.lo = d1 then h1 when t.lo = d0 then h0 else h0 + (h1 - h0) * (t.lo - d0) / (d1 - d0) end as h_lo from iv where iv.section_id = t.section_id and iv.trail = t.trail and t.lo between d0 and d1 order by seq limit 1) a on true
 join lateral (select case when t.hi = d1 then h1 when t.hi = d0 then h0 else h0 + (h1 - h0) * (t.hi - d0) / (d1 - d0) end as h_hi from iv where iv.section_id = t.section_id and iv.trail = t.trail and t.hi between d0 and d1 order by seq limit 1) b on true""").replace("select t.section_id, t.trail, round(100", ", iv as (select * from (select section_id, trail, seq, lag(d) over w as d0, lag(h) over w as h0, d as d1, h as h1 from sample window w as (partition by section_id, trail order by seq)) where d1 > d0) select t.section_id, t.trail, round(100"))
def grade_at(s, d):
    """Per cent over 100 m around the middle of each trail, clipped at its ends; null with an unknown height."""
    t = net.trails(s, d)
    places = t.select("section_id", "trail", (F.col("dist") / 2).alias("at"))
    return profile.grades_at(graph.stored(_samples(s, d)), places).select("section_id", "trail", F.round("grade", 6).alias("grade"))


#: Rings by id: a sound one, one that crosses itself, one with equal points, one of no area, one with too few points.
RINGS = {
    0: ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)),
    1: ((0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)),
    2: ((0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (0.0, 4.0)),
    3: ((0.0, 0.0), (2.0, 0.0), (4.0, 0.0)),
    4: ((0.0, 0.0), (4.0, 0.0)),
}


@query("select cast(id as bigint) as id, error from (values (0, null), (1, 'crosses itself'), (2, 'repeats a point'), (3, 'has no area'), (4, 'needs 3 to 128 points')) r(id, error)")
def boundary_error(s, d):
    rings = s.createDataFrame([(k, list(v)) for k, v in RINGS.items()], "id long, points array<struct<x:double,y:double>>")
    return spatial.ring_errors(rings)


@query("select section_id, u, v, case max(case access when 'public' then 0 else 1 end) when 0 then 'public' else 'unknown' end as access from (select section_id, least(a, b) as u, greatest(a, b) as v, access from net_trail) group by section_id, u, v", "net_trail")
def combine_access(s, d):
    rows = net.trails(s, d).groupBy("section_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(prepare.combined("access").alias("rank"))
    return rows.select("section_id", "u", "v", prepare.access_name("rank").alias("access"))


@query("select section_id, node, case min(kind_rank) when 0 then 'trailhead' when 1 then 'parking' else 'road-contact' end as kind, min_by(name, (kind_rank, start_id)) as name, bool_or(access = 'public') as open from net_start group by section_id, node", "net_start")
def start_kind(s, d):
    return prepare.start_kinds(net.starts(s, d))


@query("""select p_partkey as id, case when b >= 1e9 then b else b end as bytes, cast(round(b / 1e3) as bigint) || ' kB' as shown,
 format('{:,}', t // 10) || case when t % 10 = 0 then '' else '.' || t % 10 end || case d when 1000 then ' KB' when 1000000 then ' MB' else ' GB' end as text
 from (select *, (b * 20 + d) // (2 * d) as t from (select *, case when b >= 1000000000 then 1000000000 when b >= 1000000 then 1000000 else 1000 end as d from (select p_partkey, p_partkey * 37 as b from part)))""")
def bytes_text(s, d):
    """Sizes as a catalog shows them (`text`), and in whole kilobytes (`shown`)."""
    b = F.col("p_partkey") * 37
    return net.table(s, d, "part").select(F.col("p_partkey").alias("id"), b.alias("bytes"), scalars.kilobytes_text(b).alias("shown"), scalars.bytes_text(b).alias("text"))


@query("select c_mktsegment as attribution, min(c_custkey) as first_seen from customer group by 1")
def compose_attribution(s, d):
    """Distinct attributions in the order of first appearance."""
    return net.table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("attribution")).agg(F.min("c_custkey").alias("first_seen"))


@query("select s.section_id, s.start_id, count(*) as near from net_start s join net_node n1 on n1.section_id = s.section_id and n1.node = s.node join net_node n2 on n2.section_id = s.section_id and abs(n2.lon - n1.lon) <= 2e-2 and abs(n2.lat - n1.lat) <= 2e-2 where asin(least(1.0, sqrt(pow(sin(radians(n2.lat - n1.lat) / 2), 2) + cos(radians(n1.lat)) * cos(radians(n2.lat)) * pow(sin(radians(n2.lon - n1.lon) / 2), 2)))) * 12742017.6 <= 1500 group by all", "net_start net_node")
def nodes_beside_starts(s, d):
    """Nodes within 1500 m of each start: grid cells are the join key, the exact distance the condition."""
    n = net.nodes(s, d)
    at = net.starts(s, d).join(n, ["section_id", "node"]).select("section_id", "start_id", "lon", "lat")
    return spatial.within(at, n, 1500.0, 2e-2, ["section_id"]).groupBy("section_id", "start_id").agg(F.count("*").alias("near"))


@query("select coalesce(a.area_id, b.area_id) as area_id, a.name as pinned, b.name as current from net_section a full join (select area_id, case when area_id % 7 = 0 then upper(name) || '!' else name end as name, west from net_section where area_id % 5 <> 0) b on a.area_id = b.area_id where not (a.name is not distinct from b.name)", "net_section")
def changed_inputs(s, d):
    """Pinned inputs that the current catalog no longer matches."""
    pinned = net.sections(s, d).select("area_id", F.col("name").alias("pinned"))
    now = net.sections(s, d).where("area_id % 5 <> 0").select("area_id", F.when(F.col("area_id") % 7 == 0, F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name")).alias("current"))
    return pinned.join(now, "area_id", "full").where("not (pinned <=> current)")


from . import catalogs, mapped, planned, profiles  # noqa: E402, F401  they register more queries
