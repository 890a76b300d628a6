"""Queries over catalogs, areas, heights, texts, job tables and job streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import network as net
from . import sources, streaming
from .functions import scalars
from .operators import catalog, graph, jobs, results, spatial
from .plans import prepare
from .queries import _R, HOLE, OUTER, WALK, routes
from .registry import once, query

# --- catalogs

#: Sections of three catalogs made from the supplier table, some of which break a rule.
_SECTION = """select s_suppkey % 3 as catalog, case when s_suppkey % 41 = 5 then '-bad id' when s_suppkey % 37 = 3 then 'section-1' else 'section-' || s_suppkey end as id, case when s_suppkey % 31 = 7 then 'wa' else 'WA' end as state,
 'region-' || s_nationkey as region_id, case when s_suppkey % 97 = 11 then 'Other' else 'Region ' || s_nationkey end as region_name, case when s_suppkey % 29 = 4 then ' ' else s_name end as name, -122 + (s_suppkey % 50) * 1e-2 as west, 47 + floor(s_suppkey / 50) * 1e-2 as south,
 -122 + (s_suppkey % 50) * 1e-2 + case when s_suppkey % 43 = 9 then 0 else 1e-2 end as east, 47 + floor(s_suppkey / 50) * 1e-2 + 1e-2 as north, s_suppkey * 13 % 9000 as segments, case when s_suppkey % 53 = 2 then -1 else s_suppkey % 7 end as starts,
 s_suppkey * 1000 + 1 as bytes, case when s_suppkey % 47 = 6 then 0 else s_suppkey * 4000 + 1 end as json_bytes, sha256(s_name) as sha256 from supplier"""


def _sections(s, d):
    return s.sql(f"select * from ({_SECTION.replace('sha256(s_name)', 'sha2(s_name, 256)').replace('from supplier', 'from {t}')})", t=net.table(s, d, "supplier"))


_PROBLEM = """select catalog, id, case when not regexp_full_match(id, '[a-zA-Z0-9][a-zA-Z0-9._-]{0,127}') then 'id' when count(*) over (partition by id) > 1 then 'duplicate' when not regexp_full_match(state, '[A-Z]{2}') then 'state' when trim(name) = '' or trim(region_name) = '' then 'names'
 when (select count(distinct region_name) from sec y where y.state = x.state and y.region_id = x.region_id) > 1 then 'conflicting region' when not (west >= -180 and east <= 180 and south >= -90 and north <= 90 and west < east and south < north) then 'bounds' when segments < 0 or starts < 0 then 'counts' when bytes < 1 or json_bytes < 1 then 'files' end as problem from sec x"""


@query(f"with sec as ({_SECTION}) select * from ({_PROBLEM}) where problem is not null")
def catalog_problems(s, d):
    """The first rule that each section of some catalogs breaks."""
    return catalog.problems(_sections(s, d))


_INFO = "select cast(r_regionkey as bigint) as catalog, '2025-0' || (r_regionkey + 1) || '-01' as source_date, ['Map data', 'Heights ' || r_regionkey % 2] as attributions, ['Whole sections', 'Region ' || r_name] as limitations from region where r_regionkey < 3"


@query(f"""with sec as ({_SECTION}), bad as (select distinct id from ({_PROBLEM}) where problem is not null), good as (select * from sec where id not in (select id from bad)), inf as ({_INFO}),
att as (select string_agg(item, '; ' order by c, k) as x from (select item, min(catalog) as c, min_by(k, catalog * 100 + k) as k from (select catalog, unnest(range(0, len(attributions))) as k, unnest(attributions) as item from inf) group by item)),
lim as (select string_agg(item, '; ' order by c, k) as x from (select item, min(catalog) as c, min_by(k, catalog * 100 + k) as k from (select catalog, unnest(range(0, len(limitations))) as k, unnest(limitations) as item from inf) group by item)),
box as (select min(west) as west, min(south) as south, max(east) as east, max(north) as north, cast(sum(starts) as bigint) as starts, count(*) as sections, cast(sum(bytes) as bigint) as bytes from good),
dat as (select min(source_date) as source_date, max(source_date) as newest from inf),
al as (select box.*, source_date, att.x as attributions, lim.x || '; Source dates range from ' || source_date || ' to ' || newest as limitations from box, dat, att, lim)
select *, 'composed-' || sha256(starts || '|' || sections || '|' || bytes || '|' || source_date || '|' || attributions || '|' || limitations) as id from al""")
def composed_catalog(s, d):
    """Sound sections of several catalogs as one, with the oldest date, all attributions and an id of its content."""
    sections = graph.stored(_sections(s, d))
    sound = sections.join(catalog.problems(sections).select("id").distinct(), "id", "left_anti")
    r = net.table(s, d, "region").where("r_regionkey < 3")
    infos = r.select(F.col("r_regionkey").cast("long").alias("catalog"), F.concat(F.lit("2025-0"), F.col("r_regionkey") + 1, F.lit("-01")).alias("source_date"), F.array(F.lit("Map data"), F.concat(F.lit("Heights "), F.col("r_regionkey") % 2)).alias("attributions"), F.array(F.lit("Whole sections"), F.concat(F.lit("Region "), "r_name")).alias("limitations"))
    return catalog.composed(sound, infos)


@query(f"with sec as ({_SECTION}) select region_id, count(*) as sections, count(*) filter (segments % 3 <> 0) as installed, cast(sum(bytes) as bigint) as bytes, cast(coalesce(sum(bytes) filter (segments % 3 = 0), 0) as bigint) as missing_bytes, cast(sum(starts) as bigint) as starts from sec group by region_id")
def catalog_view(s, d):
    """Sections, installed ones, bytes, missing bytes and starts of each region."""
    rows = _sections(s, d).withColumn("installed", F.col("segments") % 3 != 0)
    return rows.groupBy("region_id").agg(F.count("*").alias("sections"), F.count_if("installed").alias("installed"), F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.when(~F.col("installed"), F.col("bytes"))), F.lit(0)).alias("missing_bytes"), F.sum("starts").alias("starts"))


@query(f"with sec as ({_SECTION}) select id, name, segments % 3 = 1 as installed, segments % 3 = 2 as repair, segments % 3 = 0 as unavailable, row_number() over (order by south, id, catalog, west, name) as place from sec")
def catalog_sections(s, d):
    """Prepared and unavailable sections from south to north, with what is installed and what needs repair."""
    state = F.col("segments") % 3
    rows = _sections(s, d)
    ready = rows.where("segments % 3 <> 0").withColumn("unavailable", F.lit(False))
    every = ready.unionByName(rows.where("segments % 3 = 0").withColumn("unavailable", F.lit(True)))
    place = F.row_number().over(Window.orderBy("south", "id", "catalog", "west", "name")).cast("long")  # a catalog is at most 16 MB
    return every.select("id", "name", (state == 1).alias("installed"), (state == 2).alias("repair"), "unavailable", place.alias("place"))


@query("""select c_custkey, 'a' || c_custkey as id, c_custkey % 4 <> 1 and c_custkey % 4 <> 3 as id_ok, c_custkey % 13 < 12 and c_custkey % 3 <> 0 as date_ok, c_custkey % 5 = 2 as url_ok from customer""")
def format_checks(s, d):
    """Identifiers, dates that exist, and addresses of folders."""
    k = F.col("c_custkey")
    name = F.concat(F.element_at(F.array(F.lit("id-"), F.lit("-"), F.lit("x."), F.lit("a b")), (k % 4 + 1).cast("int")), k.cast("string"))
    date = F.concat(F.lit("2025-"), F.lpad((k % 13 + 1).cast("string"), 2, "0"), F.when(k % 3 == 0, "-32").otherwise("-28"))
    url = F.element_at(F.array(F.lit("ftp://a.b/"), F.lit("https://a.b/c"), F.lit("https://a.b/c/"), F.lit("https://u@a.b/"), F.lit("https://a.b/?q=/")), (k % 5 + 1).cast("int"))
    return net.table(s, d, "customer").select("c_custkey", F.concat(F.lit("a"), k).alias("id"), scalars.identifier_ok(name).alias("id_ok"), scalars.date_ok(date).alias("date_ok"), scalars.url_ok(url, True).alias("url_ok"))


@query("select c_custkey, case c_custkey % 3 when 0 then 'north of I-' || c_custkey when 1 then 'west of US ' || c_custkey else 'east of SR ' || c_custkey end as label, sha256('{\"a\":' || c_custkey || ',\"b\":\"' || c_mktsegment || '\"}') as digest from customer")
def section_labels(s, d):
    """Readable names of highway cuts, and hashes of canonical JSON."""
    k = F.col("c_custkey")
    ref = F.concat(F.element_at(F.array(F.lit("north of I"), F.lit("west of US"), F.lit("east of WA")), (k % 3 + 1).cast("int")), k.cast("string"))
    rows = net.table(s, d, "customer").withColumn("b", F.col("c_mktsegment")).withColumn("a", k)
    return rows.select("c_custkey", scalars.highway_label(ref).alias("label"), F.sha2(catalog.canonical_json("b", "a"), 256).alias("digest"))


# --- areas

_SIDES = ", ".join(f"({x1!r}e0, {y1!r}e0, {x2!r}e0, {y2!r}e0)" for (x1, y1), (x2, y2) in zip(OUTER, (*OUTER[1:], OUTER[0]), strict=True))
_X = lambda a, b, c: f"(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"


def _crossed() -> str:
    a, b, out = ("ax", "ay"), ("bx", "by0"), []
    corners = (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"))
    for p, q in zip(corners, (*corners[1:], corners[0]), strict=True):
        out.append(f"({_X(a, b, p)} * {_X(a, b, q)} < 0 and {_X(p, q, a)} * {_X(p, q, b)} < 0)")
    return " or ".join(out)


_AREA = f"""ring(ax, ay, bx, by0) as (values {_SIDES}), hit as (select area_id, name, region_id, bool_or({_crossed()} or (ax > west and ax < east and ay > south and ay < north)) as hit,
 count(*) filter ((ay > (south + north) / 2) <> (by0 > (south + north) / 2) and (west + east) / 2 < (bx - ax) * ((south + north) / 2 - ay) / (by0 - ay) + ax) % 2 = 1 as middle
 from net_section, ring group by all)"""


def _drawn(s):
    return s.createDataFrame([([*OUTER],)], "points array<struct<x:double,y:double>>")


@query(net.with_cte("net_section", "").rstrip() + f",\n{_AREA}\nselect area_id, name from hit where hit or middle")
def sections_in_area(s, d):
    """Sections that overlap a drawn ring."""
    x = net.sections(s, d).withColumnRenamed("area_id", "id")
    return catalog.area_sections(x, _drawn(s)).withColumnRenamed("id", "area_id").join(net.sections(s, d).select("area_id", "name"), "area_id")


@query(net.with_cte("net_section net_start net_node", "").rstrip() + f",\n{_AREA}\nselect h.area_id, h.name, count(*) as starts from hit h join net_section x using (area_id) join net_node n on n.lon >= x.west and n.lon < x.east and n.lat >= x.south and n.lat < x.north join net_start st on st.section_id = n.section_id and st.node = n.node where hit or middle group by all")
def starts_of_reachable_sections(s, d):
    """Sections that a driving area reaches, looked up by id, and the starts in their boxes."""
    x = net.sections(s, d).withColumnRenamed("area_id", "id")
    reached = catalog.looked_up(catalog.area_sections(x, _drawn(s)), x)
    cell = 4e-2
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) + 180) / cell), F.floor((F.col(b) + 180) / cell)))
    cells = reached.withColumn("cx", span("west", "east")).withColumn("cy", span("south", "north"))
    at = net.starts(s, d).join(net.nodes(s, d), ["section_id", "node"]).withColumn("cx", F.floor((F.col("lon") + 180) / cell)).withColumn("cy", F.floor((F.col("lat") + 180) / cell))
    held = at.join(cells.withColumnRenamed("name", "area"), ["cx", "cy"]).where("lon >= west and lon < east and lat >= south and lat < north")
    return held.groupBy(F.col("id").alias("area_id"), F.col("area").alias("name")).agg(F.count("*").alias("starts"))


@query("""select * from (select n_nationkey as feature, unnest([0, 0, 0, 3]) as polygon, unnest([0, 1, 2, 3]) as ring, unnest([false, true, true, false]) as hole from nation)""")
def provider_polygons(s, d):
    """Rings of a provider's areas as polygons: clockwise ones are outer, holes go to the smallest ring around them."""
    square = lambda x, y, r, clockwise: [(x - r, y - r), *(((x - r, y + r), (x + r, y + r), (x + r, y - r)) if clockwise else ((x + r, y - r), (x + r, y + r), (x - r, y + r)))]
    shapes = [square(0.0, 0.0, 9.0, True), square(-4.0, 0.0, 2.0, False), square(4.0, 0.0, 3.0, False), square(4.0, 0.0, 1.0, True)]
    rings = s.createDataFrame([(k, [*p]) for k, p in enumerate(shapes)], "ring int, points array<struct<x:double,y:double>>")
    moved = F.transform("points", lambda p: F.struct((p.x + F.col("n_nationkey") * 100).alias("x"), p.y.alias("y")))
    every = net.table(s, d, "nation").crossJoin(F.broadcast(rings)).select(F.col("n_nationkey").alias("feature"), "ring", moved.alias("points"))  # four rings for each feature
    return catalog.polygons(every)


@query("select n_nationkey as id, -122 + (n_nationkey % 5) * 1e-2 as west, 47 + floor(n_nationkey / 5) * 1e-2 as north, 5 as points from nation")
def geojson_sequence(s, d):
    """Polygons written as a GeoJSON text sequence and read again."""
    folder = graph.shared_folder(s)
    x, y = -122 + (F.col("n_nationkey") % 5) * F.lit(1e-2), 47 + F.floor(F.col("n_nationkey") / 5) * F.lit(1e-2)
    ring = F.array(F.array(x, y), F.array(x + 5e-3, y), F.array(x + 5e-3, y - 5e-3), F.array(x, y - 5e-3), F.array(x, y))
    sources.write_geojson_sequence(net.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.array(ring).alias("coordinates")), folder)
    rows = sources.read_geojson_sequence(s, folder)
    outer = F.col("coordinates")[0]
    return rows.select("id", F.array_min(F.transform(outer, lambda p: p[0])).alias("west"), F.array_max(F.transform(outer, lambda p: p[1])).alias("north"), F.size(outer).alias("points"))


@query("select c_custkey as id, 3 as nodes, round(-122 + c_custkey * 1e-3, 6) as first_lon, round(47 + c_custkey * 1e-3, 6) as first_lat from customer")
def way_locations(s, d):
    """Ways with the places of their nodes in the record."""
    k = F.col("c_custkey")
    ref = lambda i: F.concat(F.lit("n"), (k + i).cast("string"), F.lit("x"), F.round(-122 + (k + i) * F.lit(1e-3), 6).cast("decimal(12,6)").cast("string"), F.lit("y"), F.round(47 + (k + i) * F.lit(1e-3), 6).cast("decimal(12,6)").cast("string"))
    line = F.concat(F.lit("w"), k, F.lit(" Thighway=path N"), ref(0), F.lit(","), ref(1), F.lit(","), ref(2))
    rows = sources.way_locations(net.table(s, d, "customer").select(line.alias("value")))
    return rows.select("id", F.size("points").alias("nodes"), F.round(F.col("points")[0].lon, 6).alias("first_lon"), F.round(F.col("points")[0].lat, 6).alias("first_lat"))


# --- heights

_TILE = "select n_nationkey as tile, -122 + (n_nationkey % 5) * 4e-2 as west, 47 + floor(n_nationkey / 5) * 4e-2 as south, -122 + (n_nationkey % 5 + 1) * 4e-2 as east, 47 + (floor(n_nationkey / 5) + 1) * 4e-2 as north, n_nationkey * 10e0 as value from nation"


@query(net.with_cte("net_node", "").rstrip() + f""",
tile as ({_TILE}), pt as (select section_id || '/' || node as id, lon + 3e-3 as x, lat + 3e-3 as y from net_node),
main as (select p.id, max(t.value) as v from pt p left join tile t on t.tile % 3 <> 1 and x >= west and x < east and y > south and y <= north group by p.id),
more as (select p.id, max(t.value) + 5 as v from pt p left join tile t on x >= west and x < east and y > south and y <= north group by p.id)
select m.id, coalesce(m.v, o.v) as height, m.v is null as filled from main m join more o using (id) where coalesce(m.v, o.v) is not null""")
def filled_heights(s, d):
    """Heights of the tiles that points lie in, gaps filled from a supplement."""
    n = net.table(s, d, "nation")
    k = F.col("n_nationkey")
    x, y = k % 5, F.floor(k / 5)
    tiles = n.select(k.alias("tile"), (-122 + x * F.lit(4e-2)).alias("west"), (47 + y * F.lit(4e-2)).alias("south"), (-122 + (x + 1) * F.lit(4e-2)).alias("east"), (47 + (y + 1) * F.lit(4e-2)).alias("north"), (k * F.lit(10.0)).alias("value"))
    points = net.nodes(s, d).select(F.concat_ws("/", "section_id", "node").alias("id"), (F.col("lon") + F.lit(3e-3)).alias("x"), (F.col("lat") + F.lit(3e-3)).alias("y"))
    inside = points.where("x >= -122 and x < -121.8 and y > 47 and y <= 47.2")
    value = lambda df, more: df.select("tile", (F.col("value") + more).alias("value"))
    main = tiles.where("tile % 3 <> 1")
    return catalog.filled_heights(inside, (main.drop("value"), value(main, 0.0)), (tiles.drop("value"), value(tiles, 5.0)))


@query(net.with_cte("net_node", "select section_id, node, round((lon + 122) * 111320 * cos(radians(47)), 3) as x, round((lat - 47) * 110540, 3) as y from net_node"))
def local_projection(s, d):
    """Metres east and north of a place, for short distances."""
    x, y = spatial.local_metres(F.col("lon") - F.lit(-122.0), F.col("lat") - F.lit(47.0), F.lit(47.0))
    return net.nodes(s, d).select("section_id", "node", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(net.with_cte("net_start net_node", "select a.section_id, a.start_id, b.start_id as lot from (select s.*, lon, lat from net_start s join net_node n on n.section_id = s.section_id and n.node = s.node) a join (select s.*, lon, lat from net_start s join net_node n on n.section_id = s.section_id and n.node = s.node) b on b.section_id = a.section_id and b.kind_rank = 1 and a.start_id <> b.start_id where sqrt(pow((b.lon - a.lon) * 111320 * cos(radians(b.lat)), 2) + pow((b.lat - a.lat) * 110540, 2)) <= 9000"))
def lots_beside(s, d):
    """Parking beside entrances: by grid cell, then by distance on the local plane. A lot labels, it creates no start."""
    at = net.starts(s, d).join(net.nodes(s, d), ["section_id", "node"]).select("section_id", "start_id", "lon", "lat", "kind_rank")
    return spatial.beside(at, at.where("kind_rank = 1"), 9000.0)


# --- texts and charts


@query(net.with_cte(_R, "select route_id, case when gain < 100 then '≤' || cast(floor(distance / 0.3048 + 0.5) as bigint) when gain < 200 then '≥' || cast(floor(gain / 0.3048 + 0.5) as bigint) else cast(floor(gain / 0.3048 + 0.5) as bigint) || '–' || cast(floor(distance / 0.3048 + 0.5) as bigint) end || ' ft' as label, round(least(1000, greatest(0, gain + 1e-1)), 10) as stepped, distance * repetition as stem from route", WALK))
def high_point_labels(s, d):
    """Ranges of heights as text, clamped steps and stem lengths."""
    r = once(s, d, "routes", lambda: routes(s, d))
    low, high = F.when(F.col("gain") >= 100, F.col("gain")), F.when((F.col("gain") < 100) | (F.col("gain") >= 200), F.col("distance"))
    return r.select("route_id", F.replace(scalars.high_point_text(low, high), F.lit(","), F.lit("")).alias("label"), scalars.stepped(F.col("gain"), F.lit(0.1), 0.0, 1000.0).alias("stepped"), (F.col("distance") * F.col("repetition")).alias("stem"))


@query(net.with_cte("net_vertex", "select section_id, trail, round(low, 6) as low, round(high, 6) as high, step, round(ceil(low / step) * step, 6) + 0e0 as first_tick, cast(floor((high - ceil(low / step) * step) / step) + 1 as bigint) as ticks from (select *, cast(case when r <= p then p when r <= 2 * p then 2 * p when r <= 5 * p then 5 * p else 10 * p end as double) as step from (select *, (high - low) / 3 as r, pow(10.0, floor(log10((high - low) / 3))) as p from (select section_id, trail, min(ele) - greatest((max(ele) - min(ele)) * 6e-2, 6) as low, max(ele) + greatest((max(ele) - min(ele)) * 6e-2, 6) as high from net_vertex group by all having max(ele) is not null)))"))
def chart_domain(s, d):
    """Bounds, step and ticks of the height axis of each trail."""
    rows = net.vertices(s, d).groupBy("section_id", "trail").agg(F.min("ele").alias("least"), F.max("ele").alias("most")).where("most is not null")
    pad = F.greatest((F.col("most") - F.col("least")) * F.lit(6e-2), F.lit(6.0))
    rows = rows.select("section_id", "trail", (F.col("least") - pad).alias("low"), (F.col("most") + pad).alias("high"))
    rows = rows.withColumn("step", scalars.tick_step(F.col("high") - F.col("low"), 3)).withColumn("first", F.ceil(F.col("low") / F.col("step")) * F.col("step"))
    ticks = (F.floor((F.col("high") - F.col("first")) / F.col("step")) + 1).cast("long")
    return rows.select("section_id", "trail", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "step", (F.round("first", 6) + 0.0).alias("first_tick"), ticks.alias("ticks"))


@query(net.with_cte("net_trail net_edge eb", "select section_id, (k + 1) * least(500e0, 2e-1 * 2500) as budget, least(2500e0, 2000 + (k + 1) * 500) as ceiling from (select section_id, max(back_dist / dist) as k from eb where back_dist is not null group by section_id)", WALK))
def stem_budget(s, d):
    """The most that both ways of a stem can add to a circuit, and the longest walk that a circuit of 2000 m can give."""
    from .operators import walks

    ratio = walks.with_reverse(net.edges(s, d)).where("back_dist is not null").groupBy("section_id").agg(F.max(F.col("back_dist") / F.col("dist")).alias("k"))
    return ratio.select("section_id", ((F.col("k") + 1) * F.least(F.lit(500.0), F.lit(0.2) * 2500)).alias("budget"), F.least(F.lit(2500.0), 2000 + (F.col("k") + 1) * 500).alias("ceiling"))


@query("select event_id, case when event_id % 3 = 0 then 'Drawn boundary; ' else '' end || case when event_id % 4 = 0 then 'Within ' || user_id || ' min drive' when event_id % 4 = 1 then 'Search area' else event_type || ', section-' || user_id end as title from events")
def job_titles(s, d):
    """Titles of searches: known sections by name, others by id, or the driving time."""
    names = F.array(F.col("event_type"), F.concat(F.lit("section-"), "user_id"))
    drawn = F.when(F.col("event_id") % 3 == 0, "Drawn boundary; ").otherwise("")
    area = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Within "), "user_id", F.lit(" min drive"))).when(F.col("event_id") % 4 == 1, "Search area").otherwise(F.array_join(names, ", "))
    return net.table(s, d, "events").select("event_id", F.concat(drawn, area).alias("title"))


@query("select event_id, case when event_id % 3 = 0 then user_id - 1 when event_id % 3 = 1 then user_id - 2 else least(user_id, event_id) end as west from events")
def saved_view(s, d):
    """The map view of a saved search: its driving area's bounds, else its drawing's, else those of its sections."""
    drive = F.when(F.col("event_id") % 3 == 0, F.col("user_id") - 1)
    drawing = F.when(F.col("event_id") % 3 == 1, F.col("user_id") - 2)
    return net.table(s, d, "events").select("event_id", F.coalesce(drive, drawing, F.array_min(F.array("user_id", "event_id"))).alias("west"))


# --- job tables


@query(net.with_cte("job", "select position, visitor from job where status in ('queued', 'running') and (cast(null as bigint) is null or visitor = null) order by position desc"))
def active_jobs(s, d):
    return jobs.active(net.jobs(s, d)).select("position", "visitor")


@query(net.with_cte("job", "select position, visitor, status, case when visitor <> 7 and status <> 'completed' then 404 when visitor <> 7 then 403 else 200 end as outcome from job"))
def job_authorized(s, d):
    """What a visitor who wants to change a job is told."""
    return jobs.authorized(net.jobs(s, d), 7, True).select("position", "visitor", "status", "outcome")


@query(net.with_cte("job", ", gone as (select position from job where visitor = 7 and status not in ('queued', 'running')) select 'job' as kind, position from job where position not in (select position from gone) union all select 'input', position from job where position % 2 = 0 and position not in (select position from gone)").replace(")\n, gone", "),\ngone"))
def jobs_without_deleted(s, d):
    """Two tables without a visitor's finished jobs and their inputs."""
    j = net.jobs(s, d)
    gone = j.where((F.col("visitor") == 7) & ~F.col("status").isin(*jobs.ACTIVE)).select("position")
    kept = jobs.without(j, gone).select(F.lit("job").alias("kind"), "position")
    return kept.unionByName(jobs.without(j.where("position % 2 = 0"), gone).select(F.lit("input").alias("kind"), "position"))


@query(net.with_cte("job", "select position, visitor, status, case when status in ('queued', 'running') then 'cancelled' else status end as after from job where visitor % 5 = 0"))
def cancelled_jobs(s, d):
    """Jobs of some visitors after they are cancelled: what is over stays as it is."""
    return jobs.cancelled(net.jobs(s, d).where("visitor % 5 = 0")).select("position", "visitor", "status", "after")


@query(net.with_cte(_R, ", st as (select route_id, section_id, itin from route), seg as (select distinct section_id, cast(replace(replace(x, '+', ''), '-', '') as bigint) as trail from (select section_id, unnest(itin) as x from route)) select r.section_id, count(*) as routes, (select count(*) from seg where seg.section_id = r.section_id) as geometries, sum(distance) as metres from route r group by r.section_id", WALK).replace(")\n, st as", "),\nst as"))
def result_store(s, d):
    """One row for each hike, each trail's drawing once, and counts that are carried rather than counted again."""
    folder = graph.shared_folder(s)
    r = once(s, d, "routes", lambda: routes(s, d))
    results.store(r, results.steps(r), folder)
    return results.stored_counts(s, folder)


# --- job streams


def _stream(s, d):
    return net.job_rows(streaming.table_stream(s, d, "events"))


@query(net.with_cte("job", """, num as (select *, row_number() over (partition by visitor order by position) as i from job),
fold(visitor, i, position, active, admitted) as (select visitor, i, position, case when status = 'queued' then 1 else 0 end, case when status = 'queued' then true end from num where i = 1
 union all select n.visitor, n.i, n.position, case when n.status = 'queued' then case when f.active < 2 then f.active + 1 else f.active end when n.status in ('completed', 'cancelled', 'failed') then greatest(f.active - 1, 0) else f.active end, case when n.status = 'queued' then f.active < 2 end from fold f join num n on n.visitor = f.visitor and n.i = f.i + 1)
select visitor, position, admitted from fold where admitted is not null""").replace(")\n, num", "),\nnum"))
def stream_admission(s, d):
    """Submissions let in, two active jobs a visitor: state that finished jobs leave."""
    return streaming.appended(streaming.admissions(_stream(s, d)), graph.shared_folder(s))


@query("""with recursive num as (select user_id % 50 as key, event_id, epoch_ms(ts) as x0, row_number() over (partition by user_id % 50 order by ts, event_id) as i from events),
fold(key, i, event_id, made, hit) as (select key, i, event_id, x0, false from num where i = 1 union all select n.key, n.i, n.event_id, case when n.x0 - f.made < 1800000 then f.made else n.x0 end, n.x0 - f.made < 1800000 from fold f join num n on n.key = f.key and n.i = f.i + 1)
select key, event_id, hit from fold""")
def stream_cache(s, d):
    """Requests that a kept answer of the last 30 minutes serves."""
    rows = streaming.table_stream(s, d, "events").select((F.col("user_id") % 50).alias("key"), "event_id", F.col("ts").alias("at"))
    return streaming.appended(streaming.cached(rows), graph.shared_folder(s))


@query(net.with_cte("job", "select position, visitor from (select *, row_number() over (partition by visitor order by position desc) as pl from job) where pl = 1 and status not in ('queued', 'running') and visitor in (select visitor from job where status in ('queued', 'running'))"))
def stream_finished(s, d):
    """Visitors' jobs that were active and are no longer: the latest state of each, kept by the stream."""
    now = streaming.settled(streaming.latest(_stream(s, d)), graph.shared_folder(s))
    return now.where("was_active and not active").select("position", "visitor")
