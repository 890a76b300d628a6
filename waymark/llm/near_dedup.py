"""Operator 10: near duplicates by an inverted join over MinHash signature coordinates.

1. One pass over the texts makes, for each row, the number of its distinct word shingles, a digest of
   the set, and a signature of `COORDS` coordinates. A coordinate's value carries the coordinate's number.
   Equal sets are one class, stood for by one node (its smallest id).
2. Nodes are posted under each coordinate-value pair. A pair of nodes is a candidate if they collide in at
   least `MATCHES` coordinates. Collisions are looked for by prefix: with a node's postings ordered from
   the rarest to the most frequent, two such nodes share one of their first COORDS - MATCHES + 1, so the
   long lists of frequent shingles are skipped, and postings under a value of one node are dropped.
3. Whole sets are read again for the nodes that meet another one. A shingle of only one of these sets is common to
   no pair, so the count of the others bounds every intersection: nodes and pairs that cannot reach the
   similarity go, among them those that only share a passage with many.
4. In a list, every node is first held against `LEADERS` leaders of its size class and the two beside it (the
   one with the smallest share of lone shingles, the rest by a hash of node and list), which is linear in the list.
   Links are confirmed on whole sets. Nodes that are then connected need no more comparison: only pairs of
   different components that still share a list are, all of them. Of the nodes in such lists, two either share a
   shingle of at most `RARE` of these nodes, and are paired under it, or have only more frequent ones in common,
   whose counts in `GROUPS` groups by hash then bound their intersection. So no pair within a group of near copies is listed, frequent lists
   give pairs only where that bound allows a link, and no link between components is lost. A long list is dealt out in
   shares of `SHARE` nodes, each held against the whole list in its own task.
5. Components come from alternating star joins over the confirmed links, cut by stored tables.

With J >= 0.8 a pair has 25.6 collisions of 32 on average; fewer than 15 has a chance of about 2e-6.

Null text, and text without words, has an empty set and is linked with nothing. With fewer words than
a shingle has, the whole sequence is its one shingle. Rows with a null id are compared like others;
component_id is the smallest id reachable, null if there is none. Repeated rows are of one class; rows of one id with
different texts are compared like those of different ids. Ids are integers, texts
are of any length, an empty table gives no rows, and other columns, whatever their names, are not looked at; those named in
`carry` are given back. A Bloom filter, sized by the number of sets to compare, sifts texts before the second pass is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bloom, by_bytes, give_back, in_bloom, small_batches, stored
from .tokens import mix, windows, words

COORDS, MATCHES, SIMILAR, LEADERS, RARE, GROUPS = 32, 15, 80, 4, 16, 32
#: Nodes of a list that one task holds against the whole list.
SHARE = 512
#: Bytes of text whose shingles are made at once: their arrays take about 20 times as much.
AT_ONCE = 1 << 20
#: Nodes without an id get numbers from here up.
NO_ID = 1 << 62
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 2**63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDS, np.uint64)
_TAG = _RNG.integers(0, 2**63, COORDS, np.uint64)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(texts, lower=True)
    h = w.hashes()
    shingles, at = windows(h, w.at, n)
    sets = [np.unique(shingles[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for k in range(1, n):
        for i in np.flatnonzero(w.counts == k).tolist():
            part = windows(h[w.at[i] : w.at[i + 1]], np.array([0, k]), k)[0]
            sets[i] = mix(part + np.uint64(k))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDS tagged values for each set; none of them may be empty."""
    values = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.empty((len(sets), COORDS), np.uint64)
    for k in range(COORDS):
        out[:, k] = mix(np.minimum.reduceat(values * _MUL[k] + _ADD[k], first) ^ _TAG[k])
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    body = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(body.view(np.int64)))


def _signed(n: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=AT_ONCE):
            sets = shingle_sets(batch.column("text"), n)
            full = [i for i, x in enumerate(sets) if len(x)]
            sig = [np.zeros(0, np.uint64)] * len(sets)
            if full:
                for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                    sig[i] = row
            ids = [digest(x) if len(x) else None for x in sets]
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.binary()), _lists(sig)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "n", "set_id", "sig"])
        give_back()

    return run


def _sets(n: int, sieve: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=AT_ONCE):
            seen = {}
            for x in shingle_sets(batch.column("text"), n):
                if len(x):
                    set_id = digest(x)
                    if in_bloom(sieve, set_id):
                        seen[set_id] = x
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), _lists(list(seen.values()))], ["set_id", "shingles"])
        give_back()

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b)."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now.n == 0 or now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = stored(edges.where("u <> v").distinct(), "edges")


def _fits(n: str, m: str, n2: str, m2: str, similar: int) -> Column:
    """Whether sets of n and n2 shingles, of which m and m2 may be common, can be similar enough."""
    common = F.least(m, m2)
    return 100 * common >= similar * (F.col(n) + F.col(n2) - common)


def near_groups(docs: DataFrame, shingle: int = 5, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, component (its number, also where ids are null) and the columns in carry:
    one row for each row of docs."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"own_{c}") for c in carry))
    carried = [f"own_{c}" for c in carry]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    rows = stored(docs.mapInArrow(_signed(shingle, ["doc_id", *carried]), f"{schema}, n long, set_id binary, sig array<long>"), "signatures")
    classes = rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("head"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    step = F.log(F.lit(100 / similar))
    classes = stored(classes.select("set_id", "head", "n", F.floor(F.log(F.col("n")) / step).cast("int").alias("size"), "sig"), "classes")
    # an id that stands on rows with different sets names no class; these classes are numbered like those without an id
    many = stored(classes.where("head is not null").groupBy("head").agg(F.count("*").alias("c")).where("c > 1").select("head", F.lit(True).alias("many")), "repeated")
    repeated = not many.isEmpty()
    number = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("set_id"), 2)
    if repeated:
        classes = stored(classes.join(many, "head", "left").withColumn("node", F.when(F.col("many"), number).otherwise(F.coalesce("head", number))).drop("many"), "classes")
    else:
        classes = classes.withColumn("node", F.coalesce("head", number))

    # postings of each node, rarest first, cut to the prefix
    posts = classes.select("node", "n", "size", F.explode("sig").alias("key"))
    often = posts.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    posts = posts.join(often, "key")
    own = Window.partitionBy("node")
    posts = posts.withColumn("place", F.row_number().over(own.orderBy("often", "key")) + COORDS - F.count("*").over(own)).where(F.col("place") <= COORDS - MATCHES + 1)
    posts = stored(posts.select("key", "node", "n", "size"), "postings")

    # whole sets, only of nodes that meet another one
    meet = posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    wanted = classes.select("node", "set_id").join(posts.join(meet, "key", "left_semi").select("node").distinct(), "node", "left_semi")
    wanted = stored(wanted, "wanted")
    sets = docs.select("text").mapInArrow(_sets(shingle, bloom(wanted.select("set_id"))), "set_id binary, shingles array<long>")
    sets = sets.groupBy("set_id").agg(F.first("shingles").alias("shingles"))
    sets = stored(classes.select("set_id", "node", "n", "sig").join(wanted.select("set_id"), "set_id", "left_semi").join(sets, "set_id").select("node", "n", "sig", "shingles"), "sets")

    # shingles that no other of these sets has cannot be common: m, the others, bounds every intersection
    lone = sets.select("node", F.explode("shingles").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("lone"))
    able = sets.select("node", "n").join(lone, "node", "left").select("node", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("m")).where(100 * F.col("m") >= similar * F.col("n"))
    posts = stored(posts.join(able, "node"), "postings")

    beside = F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1)))).alias("size")
    me = ("node", "n", "m")
    leads = [F.max(F.struct(F.col("m") / F.col("n"), *me)).alias("x0")] + [F.min(F.struct(F.xxhash64("node", "key", F.lit(i)), *me)).alias(f"x{i}") for i in range(1, LEADERS)]
    leaders = posts.groupBy("key", "size").agg(*leads)
    leaders = leaders.select("key", "size", F.explode(F.array_distinct(F.array(*(F.struct(*(F.col(f"x{i}.{c}") for c in me)) for i in range(LEADERS))))).alias("lead"))
    stars = posts.select("key", *me, beside).join(leaders, ["key", "size"])
    stars = stars.where((F.col("node") != F.col("lead.node")) & _fits("n", "m", "lead.n", "lead.m", similar))
    stars = stars.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        brief = sets.select("node", "sig")
        near = pairs.join(brief.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(brief.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        near = near.where(F.size(F.array_intersect("sa", "sb")) >= MATCHES).select("a", "b")
        whole = sets.select("node", "n", "shingles")
        near = near.join(whole.toDF("a", "na", "xa"), "a").join(whole.toDF("b", "nb", "xb"), "b").withColumn("common", F.size(F.array_intersect("xa", "xb")))
        return near.where(100 * F.col("common") >= similar * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    links = stored(confirmed(stars), "links")
    found = components(links)
    labelled = posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    labelled = stored(labelled.join(mixed, "key", "left_semi"), "mixed")
    left = labelled.select("node", "n", "m", "component").distinct()
    spread = stored(sets.select("node", "shingles").join(left, "node").select("node", "n", "m", "component", F.explode("shingles").alias("x")), "spread")
    counts = stored(spread.groupBy("x").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high")).where("c > 1"), "counts")

    def crossed(lists: DataFrame, on: list[str], m: str, two: DataFrame, common: Column) -> DataFrame:
        # a long list is dealt out: each of its shares meets the whole list in a task of its own
        parts = lists.groupBy(*on).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("parts"))
        lists = lists.join(parts, on).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        two = two.join(parts, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        on = [*on, "part"]
        one = lists.select(*on, F.col("node").alias("p"), F.col("n").alias("np"), F.col(m).alias("mp"), F.col("component").alias("cp"))
        two = two.select(*on, F.col("node").alias("q"), F.col("n").alias("nq"), F.col(m).alias("mq"), F.col("component").alias("cq"))
        pairs = one.join(two, on).where((F.col("cp") < F.col("cq")) & (100 * common >= similar * (F.col("np") + F.col("nq") - common)))
        return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    rare = spread.join(counts.where((F.col("c") <= RARE) & (F.col("low") < F.col("high"))).select("x"), "x")
    # frequent shingles are counted in GROUPS by hash: the lesser counts of all groups bound what two sets have in common
    hot = spread.join(counts.where(F.col("c") > RARE).select("x"), "x")
    hot = hot.groupBy("node").agg(F.count("*").alias("all"), F.array(*(F.count_if(F.pmod("x", F.lit(GROUPS)) == g) for g in range(GROUPS))).alias("h"))
    hot = labelled.join(hot, "node").where(100 * F.col("all") >= similar * F.col("n"))
    frequent = F.aggregate(F.zip_with("mp", "mq", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, b: a + b)
    cross = crossed(rare, ["x"], "m", rare, F.least("mp", "mq"))
    cross = cross.unionByName(crossed(hot, ["key", "size"], "h", hot.select("key", "node", "n", "h", "component", beside), frequent)).distinct()
    more = stored(confirmed(cross.join(stars, ["a", "b"], "left_anti")), "links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.select("set_id", "head", "node").join(found, "node", "left").select("set_id", "head", F.coalesce("component", "node").alias("component"))
    if repeated:
        least = named.groupBy("component").agg(F.min("head").alias("component_id"))
        named = named.drop("head").join(least, "component")
    else:
        named = named.drop("head").withColumn("component_id", F.when(F.col("component") < NO_ID, F.col("component")))
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_id", *carried)
    linked = rows.where("n_shingles > 0").join(named, "set_id").drop("set_id")
    alone = rows.where("n_shingles = 0").drop("set_id").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    every = linked.select(*alone.columns).unionByName(alone).withColumn("kept", F.expr("doc_id <=> component_id"))
    return every.select("doc_id", "n_shingles", "component_id", "kept", "component", *(F.col(f"own_{c}").alias(c) for c in carry))
