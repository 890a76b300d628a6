"""A trail network derived from the order tables, as DataFrames and as SQL.

Each block of 1200 orders is a section of 400 nodes on a 20 x 20 lattice and 1200 trails. Section ids are part of
every key, so all graph joins stay within a section. `CTE` has the same rules as SQL text for checking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRAILS, NODES = 1200, 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _section(key: str) -> Column:
    return F.floor(F.col(key) / TRAILS).cast("long")


def trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % TRAILS
    a = k % NODES
    return o.select(
        _section("o_orderkey").alias("section_id"), k.alias("trail"), a.alias("a"),
        F.when(F.floor(k / NODES) == 1, (a + 20) % NODES).otherwise((a + 1) % NODES).alias("b"),
        (100 + F.floor(F.col("o_totalprice") / 500)).cast("double").alias("dist"), (F.col("o_custkey") % 97).cast("double").alias("gain_fwd"), (F.col("o_custkey") % 89).cast("double").alias("gain_rev"),
        (F.col("o_orderpriority") == "5-LOW").alias("connector"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("public").alias("access"),
        (F.col("o_orderkey") % 17 == 0).alias("oneway"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("name"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two directed edges for each trail, one if it is one-way."""
    t = trails(spark, sf_dir)
    way = lambda f, to, rev, gain: F.struct(F.col(f).alias("f"), F.col(to).alias("t"), F.lit(rev).alias("reverse"), F.col(gain).alias("gain"))
    both = F.when(F.col("oneway"), F.array(way("a", "b", False, "gain_fwd"))).otherwise(F.array(way("a", "b", False, "gain_fwd"), way("b", "a", True, "gain_rev")))
    return t.select("section_id", "trail", "dist", "connector", "access", F.explode(both).alias("e")).select("section_id", "trail", "e.f", "e.t", "e.reverse", "dist", "e.gain", "access", "connector")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % TRAILS
    return table(spark, sf_dir, "orders").where(k < NODES).select(_section("o_orderkey").alias("section_id"), k.alias("node"), (-122 + (k % 20) * F.lit(1e-2)).alias("lon"), (47 + F.floor(k / 20) * F.lit(1e-2)).alias("lat"), F.floor(F.col("o_totalprice") / 500).cast("double").alias("ele"))


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.floor(s / 8).cast("long").alias("section_id"), s.alias("start_id"), (s * 37 % NODES).alias("node"), F.col("s_name").alias("name"), F.when(s % 4 == 0, "unknown").otherwise("public").alias("access"), (s % 3).alias("kind_rank"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interior vertices of each trail, in order; a null height is unknown."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(_section("l_orderkey").alias("section_id"), (F.col("l_orderkey") % TRAILS).alias("trail"), F.row_number().over(w).cast("long").alias("seq"), F.when(F.col("l_tax") != 0, F.col("l_quantity") * 10).cast("double").alias("ele"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5 x 5 grid of named areas over the lattice."""
    k = F.col("n_nationkey")
    west, south = -122 + (k % 5) * F.lit(4e-2), 47 + F.floor(k / 5) * F.lit(4e-2)
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("area_id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region_id"), west.alias("west"), south.alias("south"), (west + 4e-2).alias("east"), (south + 4e-2).alias("north"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_rows(table(spark, sf_dir, "events"))


def job_rows(events: DataFrame) -> DataFrame:
    """Job rows of events, in a table or a stream."""
    kinds = F.create_map(*(F.lit(x) for pair in (("view", "queued"), ("click", "running"), ("purchase", "completed"), ("signup", "cancelled"), ("error", "failed")) for x in pair))
    return events.select(F.col("event_id").alias("position"), F.col("ts").alias("created_at"), F.col("user_id").alias("visitor"), kinds[F.col("event_type")].alias("status"), "value")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).cast("long").alias("row"), (F.col("p_partkey") % 10).alias("col"), F.col("p_retailprice").cast("double").alias("value"))


CTE = {
    "net_trail": """select cast(floor(o_orderkey / 1200) as bigint) as section_id, o_orderkey % 1200 as trail, (o_orderkey % 1200) % 400 as a,
 case when floor((o_orderkey % 1200) / 400) = 1 then ((o_orderkey % 1200) % 400 + 20) % 400 else ((o_orderkey % 1200) % 400 + 1) % 400 end as b,
 cast(100 + floor(o_totalprice / 500) as double) as dist, cast(o_custkey % 97 as double) as gain_fwd, cast(o_custkey % 89 as double) as gain_rev,
 o_orderpriority = '5-LOW' as connector, case when o_orderstatus = 'P' then 'unknown' else 'public' end as access, o_orderkey % 17 = 0 as oneway,
 case when o_custkey % 5 <> 0 then o_orderpriority end as name from orders""",
    "net_edge": """select section_id, trail, a as f, b as t, false as reverse, dist, gain_fwd as gain, access, connector from net_trail
 union all select section_id, trail, b, a, true, dist, gain_rev, access, connector from net_trail where not oneway""",
    "net_node": """select cast(floor(o_orderkey / 1200) as bigint) as section_id, o_orderkey % 1200 as node, -122 + ((o_orderkey % 1200) % 20) * 1e-2 as lon,
 47 + floor((o_orderkey % 1200) / 20) * 1e-2 as lat, cast(floor(o_totalprice / 500) as double) as ele from orders where o_orderkey % 1200 < 400""",
    "net_start": """select cast(floor(s_suppkey / 8) as bigint) as section_id, s_suppkey as start_id, s_suppkey * 37 % 400 as node, s_name as name,
 case when s_suppkey % 4 = 0 then 'unknown' else 'public' end as access, s_suppkey % 3 as kind_rank from supplier""",
    "net_vertex": """select cast(floor(l_orderkey / 1200) as bigint) as section_id, l_orderkey % 1200 as trail,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq, cast(case when l_tax <> 0 then l_quantity * 10 end as double) as ele from lineitem""",
    "net_section": """select cast(n_nationkey as bigint) as area_id, n_name as name, cast(n_regionkey as bigint) as region_id, -122 + (n_nationkey % 5) * 4e-2 as west, 47 + floor(n_nationkey / 5) * 4e-2 as south,
 -122 + (n_nationkey % 5) * 4e-2 + 4e-2 as east, 47 + floor(n_nationkey / 5) * 4e-2 + 4e-2 as north from nation""",
    "job": """select event_id as position, ts as created_at, user_id as visitor, case event_type when 'view' then 'queued' when 'click' then 'running' when 'purchase' then 'completed' when 'signup' then 'cancelled' when 'error' then 'failed' end as status, value from events""",
    "pixel": "select cast(floor(p_partkey / 10) as bigint) as row, p_partkey % 10 as col, cast(p_retailprice as double) as value from part",
}


def with_cte(names: str, body: str, more: dict[str, str] | None = None) -> str:
    """SQL: the named entities (in order), then the body."""
    every = CTE | (more or {})
    return "with recursive " + ",\n".join(f"{n} as ({every[n]})" for n in names.split()) + "\n" + body
