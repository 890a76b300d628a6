"""Queries over profiles, walks with heights, identities, passes and drawings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import network as net
from . import queries as q
from .functions import scalars
from .operators import bounded, graph, jobs, profile, results, walks
from .registry import SQL, once, query

_WALKS = " net_node net_vertex"


def _with(names: str, body: str, more: str = "") -> str:
    """SQL with the samples of trails, and further entities after them."""
    head = net.with_cte(names, "", q.WALK).rstrip()
    return f"{head},\n{q._SAMPLE}{more}\n{body}"


def _exposure(n: str, src: str, above: float, sign: int) -> str:
    """Entities that end in n (k, total, longest): exposure over the samples of src (k, seq, d, h)."""
    return f""", {n}_e as (select k, max(d) as length, count(h) = count(*) as known from {src} group by k),
{n}_p as (select k, seq, d, h, length from {src} join {n}_e using (k) where known and length > 0),
{n}_b as (select distinct * from (select k, length, unnest([cast(0 as double), length, d - 50, d + 50]) as mid from {n}_p) where mid >= 0 and mid <= length),
{n}_i as (select * from (select k, lag(d) over w as d0, lag(h) over w as h0, d as d1, h as h1 from {n}_p window w as (partition by k order by seq)) where d1 > d0),
{n}_s as (select k, length, mid, side, case side when 0 then greatest(mid - 50, 0) else least(mid + 50, length) end as x0 from {n}_b, (values (0), (1)) v(side)),
{n}_h as (select s.k, mid, side, x0, arg_min(h0 + (h1 - h0) * (x0 - d0) / (d1 - d0), d1) as height from {n}_s s join {n}_i i on i.k = s.k and x0 >= d0 and x0 <= d1 group by all),
{n}_x as (select k, mid, round({sign} * (max(height) filter (side = 1) - max(height) filter (side = 0)) - {above} * (max(x0) filter (side = 1) - max(x0) filter (side = 0)), 9) as excess from {n}_h group by all),
{n}_n as (select *, lead(mid) over w as nm, lead(excess) over w as ne from {n}_x window w as (partition by k order by mid)),
{n}_r as (select k, case when excess > 0 then mid else mid + (nm - mid) * excess / (excess - ne) end as a, case when ne > 0 then nm else mid + (nm - mid) * excess / (excess - ne) end as b from {n}_n where nm > mid and (excess > 0 or ne > 0)),
{n}_g as (select *, sum(fresh) over (partition by k order by a) as run from (select *, case when a <= lag(b) over (partition by k order by a) + 1e-9 then 0 else 1 end as fresh from {n}_r where b > a)),
{n} as (select e.k, case when known then coalesce(total, 0) end as total, case when known then coalesce(longest, 0) end as longest from {n}_e e left join (select k, sum(m) as total, max(m) as longest from (select k, run, sum(b - a) as m from {n}_g group by all) group by k) g using (k))"""


def _routes(s, d):
    return once(s, d, "routes", lambda: q.routes(s, d))


def _steps(s, d):
    return once(s, d, "steps", lambda: results.steps(_routes(s, d)))


def _samples(s, d):
    return once(s, d, "samples", lambda: q._samples(s, d))


_TRAIL_KEY = ", tk as (select section_id || '/' || trail as k, seq, d, h from sample)"


@query(_with("net_trail" + _WALKS, "select t.section_id, t.trail, round(total, 3) as total, round(longest, 3) as longest from up join net_trail t on up.k = t.section_id || '/' || t.trail", _TRAIL_KEY + _exposure("up", "tk", 0.5, 1)))
def route_grade_exposure(s, d):
    """Metres of every trail, and the longest run of them, that climb more than 50 % over 100 m."""
    return profile.exposure(_samples(s, d), 0.5).select("section_id", "trail", F.round("total", 3).alias("total"), F.round("longest", 3).alias("longest"))


_WALK_SAMPLES = """, tl as (select section_id, trail, max(d) as length, max(seq) as last from sample group by all),
so as (select r.*, tl.length, tl.last, coalesce(sum(tl.length) over (partition by r.route_id order by r.seq rows between unbounded preceding and 1 preceding), 0) as off from rstep r join tl on tl.section_id = r.section_id and tl.trail = r.trail),
wk as (select o.route_id as k, o.seq * 1000000 + case when o.reverse then o.last - s.seq else s.seq end as seq, o.off + case when o.reverse then o.length - s.d else s.d end as d, s.h from so o join sample s on s.section_id = o.section_id and s.trail = o.trail
 where o.seq = 0 or case when o.reverse then o.last - s.seq else s.seq end > 0)"""
#: Limits of grade (a share over 100 m, metres in all, metres in one run) and of the highest point.
STEEP, TOTAL, RUN, PEAK = 0.6, 900.0, 400.0, (300.0, 480.0)


@query(_with(q._RS + _WALKS, f"select u.k as route_id, round(u.total, 3) as up_total, round(u.longest, 3) as up_longest, round(w.total, 3) as down_total, round(w.longest, 3) as down_longest, coalesce(u.total <= {TOTAL} and u.longest <= {RUN} and w.total <= {TOTAL} and w.longest <= {RUN}, false) as passes from u join w using (k)", _WALK_SAMPLES + _exposure("u", "wk", STEEP, 1) + _exposure("w", "wk", STEEP, -1)))
def walks_by_grade(s, d):
    """Exposure to climbs and descents of whole walks, their trails joined in walking order, and whether limits hold."""
    along = once(s, d, "walk profiles", lambda: profile.walk_profile(_steps(s, d), _samples(s, d)))
    both = None
    for name, sign in (("up", 1), ("down", -1)):
        found = profile.exposure(along, STEEP, sign=sign, key=("section_id", "route_id")).select("route_id", F.col("total").alias(f"{name}_total"), F.col("longest").alias(f"{name}_longest"))
        found = graph.stored(found)  # both come from one stream, so each is settled before they meet
        both = found if both is None else both.join(found, "route_id")
    passes = (F.greatest("up_total", "down_total") <= TOTAL) & (F.greatest("up_longest", "down_longest") <= RUN)
    passes = F.coalesce(passes & F.col("up_total").isNotNull() & F.col("down_total").isNotNull(), F.lit(False))
    return both.select("route_id", *(F.round(f"{n}_{c}", 3).alias(f"{n}_{c}") for n in ("up", "down") for c in ("total", "longest")), passes.alias("passes"))


@query(_with(q._RS + _WALKS, f"select route_id, peak from (select r.route_id, case when bool_and(p.peak is not null) then max(p.peak) end as peak from rstep r join pk p on p.section_id = r.section_id and p.trail = r.trail group by r.route_id) where peak between {PEAK[0]} and {PEAK[1]}", ", pk as (select section_id, trail, case when count(h) = count(*) then max(h) end as peak from sample group by all)"))
def walks_by_high_point(s, d):
    """Walks whose highest point lies in a range; one with an unknown height does not."""
    peaks = profile.climbs(_samples(s, d)).select("section_id", "trail", "peak")
    rows = _steps(s, d).join(peaks, ["section_id", "trail"]).groupBy("route_id").agg(F.when(F.count("peak") == F.count("*"), F.max("peak")).alias("peak"))
    return rows.where(F.col("peak").between(*PEAK))


@query(_with("net_trail" + _WALKS, """select section_id, trail, f as "from", t as "to", t - f as distance, gain, loss, round(100 * net / (t - f), 6) as grade from (
 select section_id, trail, f, t, case when count(h) = count(*) then sum(greatest(rise, 0)) end as gain, case when count(h) = count(*) then sum(greatest(-rise, 0)) end as loss, case when count(h) = count(*) then max_by(h, x0) - min_by(h, x0) end as net from (
  select *, h - lag(h) over (partition by section_id, trail order by x0, seq) as rise from pts) group by all)""", """, sp as (select section_id, trail, least(dist, 100) as f, least(dist, 300) as t from net_trail where least(dist, 100) < least(dist, 300)),
iv as (select * from (select section_id, trail, lag(d) over w as d0, lag(h) over w as h0, d as d1, h as h1 from sample window w as (partition by section_id, trail order by seq)) where d1 > d0),
pts as (select e.section_id, e.trail, f, t, x0, cast(0 as bigint) as seq, arg_min(coalesce(case when x0 = d1 then h1 else h0 + (h1 - h0) * (x0 - d0) / (d1 - d0) end, -1e9), d1) as h0x, nullif(arg_min(coalesce(case when x0 = d1 then h1 else h0 + (h1 - h0) * (x0 - d0) / (d1 - d0) end, -1e9), d1), -1e9) as h from (select *, unnest([f, t]) as x0 from sp) e join iv on iv.section_id = e.section_id and iv.trail = e.trail and x0 >= d0 and x0 <= d1 group by e.section_id, e.trail, f, t, x0
 union all select s.section_id, s.trail, f, t, d, seq, 0, h from sample s join sp using (section_id, trail) where d > f and d < t)"""))
def profile_selection(s, d):
    """Length, climb, descent and net grade between metres 100 and 300 of every trail; null with an unknown height."""
    places = net.trails(s, d).select("section_id", "trail", F.lit(300.0).alias("one"), F.lit(100.0).alias("two"))
    return profile.selection(_samples(s, d), places).withColumn("grade", F.round("grade", 6))


# --- identities and passes

_NUMBER = lambda x: f"regexp_replace(cast(cast(round({x}, 7) as decimal(14,7)) as varchar), '\\.?0+$', '')"
_IDENTITY = f"""idt as (select t.section_id, t.trail, least({_NUMBER('x.lon')} || ',' || {_NUMBER('x.lat')}, {_NUMBER('y.lon')} || ',' || {_NUMBER('y.lat')}) || ';' || greatest({_NUMBER('x.lon')} || ',' || {_NUMBER('x.lat')}, {_NUMBER('y.lon')} || ',' || {_NUMBER('y.lat')}) || ';' || cast(floor(dist + 0.5) as bigint) as base from net_trail t join net_node x on x.section_id = t.section_id and x.node = a join net_node y on y.section_id = t.section_id and y.node = b),
idx as (select section_id, trail, case when rk > 0 then base || '#' || rk else base end as text from (select *, row_number() over (partition by section_id, base order by trail) - 1 as rk from idt)),
fnv(section_id, trail, text, i, h) as (select section_id, trail, text, 0, cast(2166136261 as bigint) from idx union all select section_id, trail, text, i + 1, (xor(h, cast(ascii(substr(text, i + 1, 1)) as bigint)) * 16777619) & 4294967295 from fnv where i < length(text)),
ident as (select section_id, trail, text, h as identity from fnv where i = length(text))"""


def _identities(s, d):
    return once(s, d, "identities", lambda: results.trail_identities(net.trails(s, d), net.nodes(s, d)))


def _plain(names: str, more: str, body: str, ctes: dict | None = None) -> str:
    return net.with_cte(names, "", ctes or q.WALK).rstrip() + ",\n" + more + "\n" + body


@query(_plain("net_trail net_node", _IDENTITY, "select section_id, trail, text, identity from ident"))
def trail_identity(s, d):
    """A trail's identity by its ends and length, whatever its number; twins have a rank in it."""
    return _identities(s, d)


_T32 = lambda a, b: f"((({a}) // 65536 * {b} % 65536 * 65536 + ({a}) % 65536 * {b}) % 4294967296)"
_JIT1 = _T32("xor(identity, cast(2654435769 as bigint))", 0x85EBCA6B)
_PASS = f"""lst as (select section_id, trail, min(dist + 2e0 * gain + case when connector then 12e0 * dist else 0 end) as least from net_edge group by all),
jt as (select section_id, trail, {_T32('xor(v, v // 65536)', 0xC2B2AE35)} as w from (select section_id, trail, {_JIT1} as v from ident)),
pe as (select e.*, l.least * (8e-1 + xor(w, w // 65536) / 4294967296e0 * 4e-1) as weight from net_edge e join lst l using (section_id, trail) join jt using (section_id, trail))"""


def _forest(edges: str, weight: str, limit: float) -> str:
    return f"rp as (select section_id, start_id as root, cast(node as bigint) as node, cast(0 as double) as d, [cast(node as bigint)] as seen, cast([] as bigint[]) as path from net_start union all select r.section_id, r.root, cast(e.t as bigint), r.d + e.{weight}, list_append(r.seen, cast(e.t as bigint)), list_append(r.path, e.trail) from rp r join {edges} e on e.section_id = r.section_id and e.f = r.node where r.d + e.{weight} <= {limit} and not list_contains(r.seen, cast(e.t as bigint))), tree as (select * from (select *, row_number() over (partition by section_id, root, node order by d, path) as pl from rp) where pl = 1)"


@query(_plain("net_trail net_edge net_node net_start", f"{_IDENTITY}, {_PASS}, {_forest('pe', 'weight', 3000.0)}", "select section_id, root, node, round(d, 6) as d from tree"))
def weighted_forest(s, d):
    """A pass that shuns climbs and roads."""
    roots = net.starts(s, d).select("section_id", F.col("start_id").alias("root"), "node")
    return bounded.forest(bounded.passed(net.edges(s, d), _identities(s, d), 1), roots, 3000.0, "weight").select("section_id", "root", "node", F.round("d", 6).alias("d"))


_CHORDS = f"""ch as (select c.section_id, x.root, c.trail as chord, x.path as pf, y.path as pt from net_edge c join tree x on x.section_id = c.section_id and x.node = c.f join tree y on y.section_id = c.section_id and y.node = c.t and y.root = x.root where not c.reverse and not list_contains(x.path, c.trail) and not list_contains(y.path, c.trail)),
ck as (select *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(pf), len(pt)) + 1), lambda i: coalesce(pf[i] = pt[i], false)), false), 0) - 1, greatest(len(pf), len(pt))) as n from ch),
cc2 as (select section_id, root, chord, list_concat(list_append(list_slice(pf, n + 1, len(pf)), chord), list_reverse(list_slice(pt, n + 1, len(pt)))) as core from ck)"""


@query(_plain("net_trail net_edge net_start", f"{_forest('net_edge', 'dist', 1200.0)}, {_CHORDS}", f"select section_id, root, chord, array_to_string({q._canon('core')}, ',') as circuit from cc2 where len(list_distinct(core)) = len(core)"))
def fundamental_circuits(s, d):
    """The circuit that each trail outside a shortest-path tree closes in it."""
    return bounded.fundamental_circuits(net.edges(s, d), q._trees(s, d)).drop("core_trails")


@query(_plain("net_trail net_edge eb net_start", "be as (select * from eb where back_dist is not null), " + _forest("be", "dist", 1500.0), "select section_id, root, node, d, array_to_string(path, ',') as stem from tree"))
def stem_tree(s, d):
    """Ways out of each start on trails that can be walked back."""
    both = walks.with_reverse(net.edges(s, d)).where("back_dist is not null")
    roots = net.starts(s, d).select("section_id", F.col("start_id").alias("root"), "node")
    return bounded.forest(both, roots, 1500.0).select("section_id", "root", "node", "d", F.array_join(F.col("path").cast("array<string>"), ",").alias("stem"))


@query("with recursive net_trail as (" + net.CTE["net_trail"] + "), rd as (select * from net_trail where connector), en as (select section_id, trail, unnest([a, b]) as node from rd), th as (select section_id, min(trail) as x, max(trail) as y from en group by section_id, node having count(*) = 2 and min(trail) < max(trail)), lb(section_id, trail, c) as (select section_id, x, x from th union select section_id, y, x from th union select l.section_id, case when t.x = l.trail then t.y else t.x end, l.c from lb l join th t on t.section_id = l.section_id and (t.x = l.trail or t.y = l.trail)) select r.section_id, r.trail, coalesce(m.c, r.trail) as corridor, r.dist from rd r left join (select section_id, trail, min(c) as c from lb group by all) m using (section_id, trail)")
def corridor_contraction(s, d):
    return graph.corridors(net.trails(s, d).where("connector"))


# --- walks that are checked, and drawn

#: Each route as it is (0), without its second step (1), with its first step turned (2), and with its last step twice (3).
_VARIANTS = """var as (select r.*, 0 as variant from rstep r union all select r.*, 1 from rstep r where seq <> 1 union all select section_id, route_id, seq, trail, case when seq = 0 then not reverse else reverse end, 2 from rstep union all select r.*, 3 from rstep r union all select section_id, route_id, seq + 1, trail, reverse, 3 from rstep r where seq = (select max(seq) from rstep x where x.route_id = r.route_id)),
ve as (select v.*, case when v.reverse then b else a end as f, case when v.reverse then a else b end as t from var v join net_trail n on n.section_id = v.section_id and n.trail = v.trail)"""


def _variants(s, d):
    st = _steps(s, d)
    last = F.max("seq").over(Window.partitionBy("route_id"))
    kind = lambda k: F.lit(k).alias("variant")
    rows = st.select("*", kind(0)).unionByName(st.where("seq <> 1").select("*", kind(1))).unionByName(st.withColumn("reverse", F.when(F.col("seq") == 0, ~F.col("reverse")).otherwise(F.col("reverse"))).select("*", kind(2)))
    return rows.unionByName(st.select("*", kind(3))).unionByName(st.withColumn("last", last).where("seq = last").withColumn("seq", F.col("seq") + 1).drop("last").select("*", kind(3)))


@query(_plain(q._RS, _VARIANTS, "select route_id, variant, bool_and(coalesce(before = f, true)) as joined, min_by(f, seq) = max_by(t, seq) as closed, count(distinct trail) = count(*) as distinct_trails from (select *, lag(t) over (partition by route_id, variant order by seq) as before from ve) group by all"))
def walk_verifier(s, d):
    """Whether walks are joined, closed and free of repeated trails: sound walks, and ones broken in three ways."""
    return results.verified(_variants(s, d), net.trails(s, d))


@query(_plain(q._RS, _VARIANTS, "select route_id, variant, seq from (select *, lag(t) over (partition by route_id, variant order by seq) as before from ve) where before <> f"))
def route_continuity(s, d):
    """Steps that do not begin where the one before ended."""
    return results.gaps(_variants(s, d), net.trails(s, d))


@query(_plain(q._RS, _VARIANTS, "select route_id, variant, min(seq) as first_repeat from (select route_id, variant, seq, count(*) over (partition by route_id, variant, node order by seq, mark) as nth from (select route_id, variant, -1 as seq, 0 as mark, f as node from ve where seq = 0 union all select route_id, variant, seq, 1, t from ve)) where nth > 1 group by all"))
def first_repeat(s, d):
    """The step by which a walk comes to a node for the second time."""
    one = results.walks_of_steps(_steps(s, d), net.trails(s, d), "route_id")
    # the variants of a walk are made of its row, as _variants() makes them of its steps
    walk, last = F.col("walk"), F.array_max(F.transform("walk", lambda x: x.seq))
    turned = F.transform(walk, lambda x: F.struct(x.seq.alias("seq"), F.when(x.seq == 0, x.t).otherwise(x.f).alias("f"), F.when(x.seq == 0, x.f).otherwise(x.t).alias("t")))
    twice = F.concat(walk, F.transform(F.filter(walk, lambda x: x.seq == last), lambda x: F.struct((x.seq + 1).alias("seq"), x.f.alias("f"), x.t.alias("t"))))
    four = F.array(walk, F.filter(walk, lambda x: x.seq != 1), turned, twice)
    return results.first_returns(one.select("route_id", F.posexplode(four).alias("variant", "walk")), "walk", "route_id", "variant")


_NAMED = """nm as (select r.*, t.name from rstep r join net_trail t on t.section_id = r.section_id and t.trail = r.trail),
lk as (select route_id, trail as x, after as y from (select *, lead(trail) over w as after, lead(name) over w as next_name from nm window w as (partition by route_id order by seq)) where name = next_name union select route_id, max_by(trail, seq), min_by(trail, seq) from nm group by route_id having arg_max_null(name, seq) = arg_min_null(name, seq)),
gp(route_id, trail, c) as (select route_id, trail, trail from nm union select g.route_id, case when l.x = g.trail then l.y else l.x end, g.c from gp g join lk l on l.route_id = g.route_id and (l.x = g.trail or l.y = g.trail))"""


@query(_plain(q._RS, _NAMED, "select n.route_id, n.trail, m.c as piece, case when n.name is null then 'Trail name unavailable' when n.name = '' then 'Unnamed trail' else n.name end as name from (select distinct route_id, trail, name from nm) n join (select route_id, trail, min(c) as c from gp group by all) m using (route_id, trail)"))
def drawing_groups(s, d):
    """Trails of a walk that follow each other under one name are drawn as one piece, also over its start."""
    return results.drawing_groups(_steps(s, d), net.trails(s, d))


# --- the one queue


@query("select position, visitor, row_number() over (order by position) as queue_position from job where status = 'queued'")
def job_queue_position(s, d):
    return jobs.queue_positions(net.jobs(s, d)).select("position", "visitor", "queue_position")


SQL["job_queue_position"] = net.with_cte("job", SQL["job_queue_position"])


from . import discovered  # noqa: E402, F401  it registers more queries
