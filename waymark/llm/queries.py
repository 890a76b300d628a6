"""The registered queries of the numbered operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, exact_dedup, filter_audit, language, lm, mixing, near_dedup, packing, pii, quality, sharding, token_counts, toxicity
from .common import documents, labels


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 24)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), shingle=4).drop("component")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), labels(spark, sf_dir))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_lm_scoring, op2_toxicity, op3_packing, op4_sharding, op5_language, op6_mixing, op7_quality, op8_pii, op9_exact_dedup, op10_near_dedup, op11_filter_audit, op12_centroids, op13_token_counts, pipeline)
    return {f.__name__: f for f in found}


def _mixing_sql() -> str:
    p = 2147483647

    def h(x: str, key: str) -> str:
        one = f"((({x}) % {p} * 48271 + ({x}) // {p} * 69621 + ({key}) * 40692 + 1) % {p})"
        two = f"({one} * ({one} + 16807) % {p})"
        return f"({two} * ({two} + 271828183) % {p})"

    def key(r: int) -> str:
        return f"({h(f'rk * 64 + {r}', '2')} * {p} + {h(f'rk * 64 + {r}', '3')}) % n"

    rounds = ["p0 as (select *, ((case when n % 104729 <> 0 then 104729 when n % 104723 <> 0 then 104723 else 104717 end) * (i % n) + k) % n as x from slot)"]
    for r in range(6):
        rounds.append(f"y{r} as (select *, (k{r} - x + n) % n as y from p{r})")
        coin = f"((greatest(x, y) % {p} * 48271 + k{r} % {p}) % {p})"
        rounds.append(f"p{r + 1} as (select * exclude (x, y), case when {coin} * ({coin} + 16807) % {p} % 2 = 1 then y else x end as x from y{r})")
    return rf"""
with d as (select doc_id, source, coalesce('s' || source, 'null') as skey, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s0 as (select skey, source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as rk from d group by skey, source),
s1 as (select *, cast((rk - 1) % 3 + 1 as double) as weight, cast(3 * source_size as double) as most from s0),
s2 as (select *, (sum(source_size) over () - coalesce(sum(most) over (order by most / weight, rk rows between unbounded preceding and 1 preceding), 0))
 / (sum(weight) over () - coalesce(sum(weight) over (order by most / weight, rk rows between unbounded preceding and 1 preceding), 0)) as level from s1),
sh as (select level as share from s2 where most >= level * weight order by most / weight, rk limit 1),
src as (select s2.*, least(most, share * weight) as target from s2 cross join sh),
t1 as (select *, cast(ceil(source_size / 32) as bigint) as n from src where source_size > 0),
t2 as (select *, cast(floor(target * n / source_size + 1e-9) as bigint) as whole from t1),
t3 as (select *, greatest(0, cast(round((target * n / source_size - whole) * source_size / n) as bigint)) as rest from t2),
t as (select skey, rk, n, whole, rest, whole + case when rest > 0 then 1 else 0 end as m from t3 where whole + rest > 0),
tot as (select cast(sum(m) as bigint) as ms, greatest(1, cast(ceil(sum(m) / 4096) as bigint)) as shards from t),
bounds as (select skey, floor((c - m) * ({p} / ms)) as low, case when c = ms then {p} else floor(c * ({p} / ms)) end as high from (select skey, m, cast(sum(m) over (order by rk) as bigint) as c from t), tot),
draws as (select id // 4096 as shard, {h("id", "11")} as u from (select unnest(range(0, ms)) as id from tot)),
cnt as (select skey, shard, cast(sum(drawn) as bigint) as drawn from (select skey, shard, count(*) as drawn from draws join bounds on u >= low and u < high group by all
 union all select skey, {h("rk", "13")} % shards, 0 from t, tot) group by all),
upto as (select *, cast(sum(drawn) over (partition by skey order by shard) as bigint) as hi, cast(sum(drawn) over (partition by skey) as bigint) as total from cnt),
rng as (select t.*, shard, case when hi - drawn = 0 then 0 when hi - drawn = total then m else cast(floor((hi - drawn) * (m / greatest(total, 1))) as bigint) end as low,
 case when hi = total then m else cast(floor(hi * (m / greatest(total, 1))) as bigint) end as high from upto join t using (skey)),
slot as (select skey, rk, n, whole, rest, shard, {key(6)} as k, {", ".join(f"{key(r)} as k{r}" for r in range(6))}, unnest(range(low, high)) as i from rng where low < high),
{", ".join(rounds)},
times as (select skey, x as block, count(*) filter (i < whole or rest = 32) as times, max(rest) filter (i >= whole and rest < 32) as short, min(shard) as first_shard from p6 group by all),
placed as (select d.*, cast(sum(size) over (partition by skey order by {h("abs(coalesce(doc_id, size) % 2147483647)", "7")} % 1024, doc_id nulls last, size rows unbounded preceding) as bigint) - size as pos from d),
cut as (select *, unnest(range(pos // 32, (pos + size - 1) // 32 + 1)) as block from placed where size > 0),
part as (select c.*, greatest(block * 32 - pos, 0) as a, least((block + 1) * 32 - pos, size) as b, coalesce(times, 0) as times, coalesce(short, 0) as short, first_shard from cut c left join times using (skey, block)),
reached as (select *, greatest(least(short, pos + b - block * 32) - (pos + a - block * 32), 0) as extra from part),
got as (select skey, doc_id, pos, size, sum((b - a) * times + extra) as taken, min(first_shard) filter (times > 0 or extra > 0) as first_shard from reached group by all)
select doc_id, g.size, source_size, target, cast(taken as bigint) as taken, first_shard from got g join src using (skey)
union all select doc_id, size, source_size, target, cast(0 as bigint), null from d join src using (skey) where size = 0
"""


def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select row, vec_id, v, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance from (select row, vec_id, v, cluster, {far} as d from kept, c{r}) group by all)")
        if r < rounds:
            steps.append(
                f"s{r} as (select cluster, i, sum(x) as s, count(*) as n from (select cluster, unnest(v) as x, unnest(range(1, 65)) as i from a{r}) group by all), "
                f"m{r} as (select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from s{r} group by cluster), "
                f"c{r + 1} as materialized (select cluster, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (cluster))"
            )
    return f"""
with sound as (select row_number() over () as row, vec_id, embedding from embeddings where len(embedding) = 64
 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x) or abs(cast(x as double) * 1024) >= 134217728)) = 0),
kept as materialized (select row, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) as v from sound),
c0 as materialized (select cast(row_number() over (order by sha256('3:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as integer) as cluster, v as c from kept qualify cluster < {k}),
{", ".join(steps)},
t as (select cluster, cast(sum(distance) as bigint) as cluster_inertia from a{rounds} group by cluster)
select vec_id, cluster, cast(distance as bigint) as distance, cluster_inertia, (select cast(sum(cluster_inertia) as bigint) from t) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join t using (cluster) join c{rounds} using (cluster)
"""


SQL = {
    "op11_filter_audit": r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
f as (select t.doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text), regexp_matches(text, '[#$%&*|]'),
 coalesce(t.doc_id > min(t.doc_id) over (partition by text), false)] as fails, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as bad
 from t left join labels using (doc_id)),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, instr('ABCDE', filter_order[step]) as here, [instr('ABCDE', filter_order[i]) for i in range(1, step)] as earlier from o, (select cast(unnest(range(1, 6)) as integer) as step)),
r as (select part, filter_order, step, here, fails, good, bad, fails[here] as failing, len([i for i in earlier if fails[i]]) > 0 as gone from f, s),
n as (select part, filter_order, step, here, count(*) filter (not failing and not gone) as kept, count(*) filter (failing and not gone) as removed, count(*) filter (failing and gone) as redundant,
 count(*) filter (failing and len([y for y in fails if y]) = 1) as unique_fails, count(*) filter (failing and not gone and good) as good_lost, count(*) filter (failing and not gone and bad) as toxic_lost from r group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, here) as bigint) as shapley from n
""",
    "op12_centroids": _centroid_sql(),
    "op9_exact_dedup": r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.text_sha256 from t join g using (text_sha256)
""",
    "op6_mixing": _mixing_sql(),
    "op10_near_dedup": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select distinct doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
cc(node, c) as (select b, a from link union select l.node, cc.c from cc join (select a as node, b as other from link union all select b, a from link) l on l.other = cc.node),
low as (select node, min(c) as c from cc group by node)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(low.c, w.doc_id)) as component_id, w.doc_id <= coalesce(low.c, w.doc_id) as kept from w left join n on n.doc_id = w.doc_id left join low on low.node = w.doc_id
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
