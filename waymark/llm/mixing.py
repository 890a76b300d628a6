"""Operator 6: mix sources to target weights, with DataFrame functions only.

Each source's texts, in a fixed order, are one stream of words, cut into blocks of `block` words. A source's target in
words is a number of slots, the last of which may be shorter. Every output shard draws `shard_slots` slots from the
sources by their weights: a seeded multinomial count for each source. The counts of a source are scaled along the shards so
that they add up to its slots. The i-th slot of a source lies in the shard whose counts reach it and takes block
perm(i mod n) of its n blocks, where perm is the source's pseudorandom permutation: an affine map and `ROUNDS` rounds of
swap-or-not, in which an index and its mirror image change places or stay. Slots and blocks are joined by index.

A hot source is dealt out by (source, part) for running sums, by (source, shard) for its slots and by (source, block) for
joins, never by the source alone. Sources themselves are ranked in one task, one row for each.

Ids are integers. Null text has no words and is taken 0 times; a null source is a source, placed last. Null ids and repeated
rows are rows like others; rows of one id follow by size, then by checksum of the text, so reruns agree. A text of any
length is cut like others. Tables without words give 0 for every target, empty tables give no rows. Other columns,
whatever their names, are not looked at, and `mixed_texts` gives them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

BLOCK, PARTS, SHARD_SLOTS, ROUNDS = 32, 1024, 4096, 6
#: A prime below which all pseudorandom numbers lie; products of two such numbers fit in 64 bits.
P = 2**31 - 1
#: Multipliers of the affine maps: primes, so that one of them shares no factor with n.
PRIMES = (104729, 104723, 104717)


def scrambled(x: Column, key: Column | int) -> Column:
    """A number from 0 to P - 1 that looks random, by plain arithmetic. x and key are not negative."""
    h = (x % P * 48271 + F.floor(x / P) * 69621 + key * 40692 + 1) % P
    h = h * (h + 16807) % P
    return h * (h + 271828183) % P


def mirrors(key: Column, n: Column) -> Column:
    """The keys of a permutation of 0..n-1: its mirrors, one for each round, the last one for the affine map."""
    return F.array(*((scrambled(key * 64 + r, 2) * P + scrambled(key * 64 + r, 3)) % n for r in range(ROUNDS + 1)))


def permuted(i: Column, n: Column, keys: Column) -> Column:
    """The image of i mod n under the bijection of 0..n-1 with these keys."""
    prime = F.when(n % PRIMES[0] != 0, PRIMES[0]).when(n % PRIMES[1] != 0, PRIMES[1]).otherwise(PRIMES[2]).cast("long")

    def turned(x: Column, k: Column) -> Column:
        mirror = (k - x + n) % n
        h = (F.greatest(x, mirror) % P * 48271 + k % P) % P
        return F.when(h * (h + 16807) % P % 2 == 1, mirror).otherwise(x)

    return F.aggregate(F.slice(keys, 1, ROUNDS), (prime * (i % n) + F.element_at(keys, ROUNDS + 1)) % n, turned)


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """source, source_size, rank (by code point, null last), target. sizes: source, source_size.

    Water-filling: the sources at their cap are those of the smallest cap/weight; the others share the
    rest by weight. One row for each source is sorted here, not one for each document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double")).withColumn("most", cap * F.col("source_size"))
    up = Window.orderBy((F.col("most") / F.col("weight")).asc(), "rank")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # level: the share of a unit of weight if all before this one are at their cap
    s = s.withColumn("free", F.col("most") >= F.col("level") * F.col("weight"))
    first_free = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("rank"), F.col("level")))).over(every)
    s = s.withColumn("share", first_free["level"])
    return s.withColumn("target", F.least(F.col("most"), F.col("share") * F.col("weight"))).select("source", "source_size", "rank", "target")


def running(df: DataFrame, keys: list[str], part: str, order: list[Column], value: str, out: str) -> DataFrame:
    """df with the sum of value over all rows before each, within keys, by part and then by order: in two levels, so
    that no task holds all rows of a key."""
    parts = df.groupBy(*keys, part).agg(F.sum(value).alias("part_sum"))
    parts = parts.withColumn("part_at", F.sum("part_sum").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("part_sum")).drop("part_sum")
    inner = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(out, F.sum(value).over(inner) - F.col(value)).join(parts, [*keys, part])
    return df.withColumn(out, F.col(out) + F.col("part_at")).drop("part_at")


def placed_words(docs: DataFrame, id_col: str, text_col: str, source_col: str, *others: str) -> DataFrame:
    """doc_id, source, size and checksum of each row, and other columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("sum"), *others)


def plan(rows: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, source, size, sum and others. Gives (rows with their place in the stream and target, slots)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    part = scrambled(F.abs(F.coalesce("doc_id", "size") % P), 7) % PARTS
    rows = rows.withColumn("skey", key).withColumn("part", part)
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes.drop("skey")).withColumn("skey", key), "targets")
    rows = running(rows, ["skey"], "part", [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("sum")], "size", "at")
    rows = rows.drop("part").join(targets.drop("source"), "skey")
    return rows, slots(targets, block, shard_slots, seed)


def drawn(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """skey, rank, n (blocks), m (slots), rest (words of the last slot, if it is a short one), shard, drawn: how many slots
    each shard draws from each source. A source that no shard draws has one row, with 0."""
    spark = targets.sparkSession
    t = targets.where("source_size > 0").withColumn("n", F.ceil(F.col("source_size") / block))
    t = t.withColumn("whole", F.floor(F.col("target") * F.col("n") / F.col("source_size") + 1e-9))
    # a source's mean words in a block, which is less than `block` if its last one is short, turn words into slots
    t = t.withColumn("rest", F.round((F.col("target") * F.col("n") / F.col("source_size") - F.col("whole")) * F.col("source_size") / F.col("n")).cast("long"))
    t = t.withColumn("rest", F.greatest("rest", F.lit(0))).withColumn("m", F.col("whole") + (F.col("rest") > 0).cast("long"))
    t = stored(t.where("m > 0").select("skey", "rank", "n", "m", "whole", "rest"), "sources")
    all_slots, sources = t.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count("*")).first()
    shards, width = max(1, -(-all_slots // shard_slots)), -(-P // (4 * max(1, sources)))
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("m").over(up)
    bounds = t.select("skey", F.floor((total - F.col("m")) * (P / max(1, all_slots))).alias("low"), F.when(total == all_slots, P).otherwise(F.floor(total * (P / max(1, all_slots)))).alias("high")).where("low < high")
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    draws = spark.range(all_slots).select(F.floor(F.col("id") / shard_slots).alias("shard"), scrambled(F.col("id"), seed * 64 + 11).alias("u"))
    draws = draws.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").where("u >= low and u < high")
    counts = draws.groupBy("skey", "shard").agg(F.count("*").alias("drawn"))
    home = t.select("skey", (scrambled(F.col("rank").cast("long"), 13) % shards).alias("shard"), F.lit(0).cast("long").alias("drawn"))
    counts = counts.unionByName(home).groupBy("skey", "shard").agg(F.sum("drawn").alias("drawn"))
    return stored(counts.join(t, "skey"), "drawn")


def slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """One row for each slot of the mix: skey, i (slot of the source), shard, block, words (that it takes of the block)."""
    counts = drawn(targets, block, shard_slots, seed)
    sums = counts.groupBy("skey").agg(F.sum("drawn").alias("all_drawn"))
    t = running(counts.withColumn("part", F.floor(F.col("shard") / PARTS)), ["skey"], "part", [F.col("shard")], "drawn", "at").drop("part").join(sums, "skey")
    reach = lambda c: F.when(c == F.col("all_drawn"), F.col("m")).otherwise(F.floor(c * (F.col("m") / F.greatest("all_drawn", F.lit(1)))))
    low = F.when(F.col("at") == 0, 0).otherwise(reach(F.col("at")))
    t = t.withColumn("high", reach(F.col("at") + F.col("drawn"))).withColumn("low", low).where("low < high")
    t = t.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "skey", "shard")  # a given number is not coalesced: rows are few here, and many below
    t = t.withColumn("keys", mirrors(F.col("rank"), F.col("n"))).withColumn("i", F.explode(F.sequence("low", F.col("high") - 1)))
    return t.select("skey", "i", "shard", permuted(F.col("i"), F.col("n"), F.col("keys")).alias("block"), F.when(F.col("i") < F.col("whole"), F.lit(block)).otherwise(F.col("rest")).alias("words"))


def cut_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows once for each block they have words in: low, high (words of the row in the block)."""
    low, high = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(low, high))))
    return cut.withColumn("low", F.greatest(F.col("block") * block - F.col("at"), F.lit(0))).withColumn("high", F.least((F.col("block") + 1) * block - F.col("at"), F.col("size")))


def _reached(words: Column, block: int) -> Column:
    """How many of a row's words in a block are among the block's first ones."""
    first = F.col("at") + F.col("low") - F.col("block") * block
    return F.greatest(F.least(words, first + F.col("high") - F.col("low")) - first, F.lit(0))


def pieces(rows: DataFrame, slot_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows once for each block they have words in: low, high (words of the row in the block), times, some (words that a
    short slot takes besides), first_shard."""
    times = slot_rows.groupBy("skey", "block").agg(F.count_if(F.col("words") == block).alias("times"), F.max(F.when(F.col("words") < block, F.col("words"))).alias("short"), F.min("shard").alias("first_shard"))
    cut = cut_rows(rows, block).join(times.hint("merge"), ["skey", "block"], "left")
    cut = cut.withColumn("some", _reached(F.coalesce("short", F.lit(0)), block)).withColumn("times", F.coalesce("times", F.lit(0)))
    return cut.withColumn("first_shard", F.when((F.col("times") > 0) | (F.col("some") > 0), F.col("first_shard")))


def mix(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard (of those that hold its words): one row for each row of docs."""
    rows, slot_rows = plan(stored(placed_words(docs, id_col, text_col, source_col), "sizes"), block, shard_slots, seed)
    taken = F.sum((F.col("high") - F.col("low")) * F.col("times") + F.col("some")).cast("long")
    full = pieces(rows.where("size > 0"), slot_rows, block)  # a row with words has its place in the stream to itself
    full = full.groupBy("skey", "at", "doc_id", "size", "source_size", "target").agg(taken.alias("taken"), F.min("first_shard").alias("first_shard"))
    cols = ["doc_id", "size", "source_size", "target", "taken", "first_shard"]
    empty = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_shard", F.lit(None).cast("long"))
    return full.select(*cols).unionByName(empty.select(*cols))


def dealt(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """shard, source, i, doc_id, low, high: the words of rows that each slot of each output shard takes."""
    rows, slot_rows = plan(stored(placed_words(docs, id_col, text_col, source_col), "sizes"), block, shard_slots, seed)
    cut = cut_rows(rows.where("size > 0"), block).join(slot_rows.hint("merge"), ["skey", "block"])
    cut = cut.withColumn("high", F.col("low") + _reached(F.col("words"), block)).where("low < high")
    return cut.select("shard", "source", "i", "doc_id", "low", "high")


def mixed_texts(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs once for each time a row is taken: its text where all its words are, else the taken words with single spaces.

    The n-th row of a document holds the words of its blocks that the mix takes n times or more.
    """
    # the columns of docs stay in a struct, so that none clashes with one of the mix
    spread = docs.select(F.monotonically_increasing_id().alias("mix_row"), F.struct("*").alias("doc"))
    # ids of rows would differ if they were made anew, so the table that carries them is stored
    spread = stored(spread, "rows")
    text = F.coalesce(F.col(f"doc.{text_col}"), F.lit(""))
    narrow = placed_words(spread, f"doc.{id_col}", f"doc.{text_col}", f"doc.{source_col}", "mix_row")
    rows, slot_rows = plan(stored(narrow, "sizes"), block)
    cut = pieces(rows.where("size > 0"), slot_rows, block).where("times > 0 or some > 0")
    cut = cut.select("mix_row", "size", "low", "high", "times", "some", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times") + (F.col("some") > 0).cast("long"))).alias("turn"))
    cut = cut.withColumn("high", F.when(F.col("turn") > F.col("times"), F.col("low") + F.col("some")).otherwise(F.col("high")))
    taken = cut.groupBy("mix_row", "size", "turn").agg(F.sum(F.col("high") - F.col("low")).alias("n"), F.array_sort(F.collect_list(F.struct("low", "high"))).alias("parts"))
    taken = taken.select("mix_row", "turn", (F.col("n") == F.col("size")).alias("whole"), F.when(F.col("n") < F.col("size"), F.col("parts")).alias("parts"))
    found = spread.join(taken, "mix_row")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    # the words are bound to a lambda's variable, so that they are taken from the text once and not for each part
    both = F.array(F.struct(words.alias("words"), F.col("parts").alias("parts")))
    some = F.transform(both, lambda b: F.flatten(F.transform(b.parts, lambda p: F.slice(b.words, (p.low + 1).cast("int"), (p.high - p.low).cast("int")))))[0]
    taken_text = F.when(F.col("whole"), F.col(f"doc.{text_col}")).otherwise(F.array_join(some, " "))
    return found.select(*(taken_text.alias(c) if c == text_col else F.col(f"doc.{c}").alias(c) for c in docs.columns))
