"""Operator 11: what each filter of a cleaning recipe removes, in every order of the filters, by direct relational replay.

One pass over the texts gives each document's failures of five filters as flags; texts are not shuffled. The rows of flags are
crossed with the 120 orders (a broadcast table of fixed size), each order gives its five steps, the first failing step of the
document in that order decides, and one conditional aggregation, combined before the shuffle, counts.

Filters (words: maximal `[^\\x20\\x09-\\x0D]+`, case counts). A: under `min_words` words. B: 100 * distinct words <
`min_distinct` * words. C: 100 * `[A-Z]` characters > `max_upper` * code points. D: a character of `[#$%&*|]`. E: the same
text as a row with a smaller id, table-wide, whether that row is removed or not.

Null text is empty: it fails A only (and E, beside another empty text of a smaller id). A null id never fails E and has no
label. Repeated rows count row by row; rows of one id and text are no copies of each other. A null part counts as the empty
string. Of several labels of one id the highest holds; a null label is none. An empty table gives no row. Other columns are
not read. Distinct words are told apart by 64-bit hashes, texts by SHA-256.

Joins stand between written tables, so that adaptive execution can split a group of copies, or a missing id, that holds many rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, small_batches, stored
from .tokens import flat, words

FILTERS = "ABCDE"
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*|")] = True
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _totals(hits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each text hit."""
    return np.diff(np.concatenate([[0], np.cumsum(hits)])[at])


def _flags(min_words: int, min_distinct: int, max_upper: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bytes(batches):
            data, at = flat(rows.column("text"))
            w = words(rows.column("text"))
            n = w.counts
            order = np.lexsort((h := w.hashes(), of := w.text_of))
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
            distinct = np.bincount(of[order][new], minlength=len(n))
            upper = _totals((data >= 65) & (data <= 90), at)
            points = _totals((data & 0xC0) != 0x80, at)
            raw = memoryview(data)
            digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            found = [n < min_words, 100 * distinct < min_distinct * n, 100 * upper > max_upper * points, _totals(MARKS[data], at) > 0]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("part"), pa.array(digest, pa.binary()), *map(pa.array, found)],
                ["doc_id", "part", "digest", "fails_a", "fails_b", "fails_c", "fails_d"],
            )

    return run


def flags(docs: DataFrame, labels: DataFrame, part_col: str = "source", min_words: int = 50, min_distinct: int = 65, max_upper: int = 5) -> DataFrame:
    """doc_id, part, fails_a to fails_e, good, toxic of every row. labels: doc_id, quality, toxic."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), "text")
    schema = f"doc_id {id_type}, part string, digest binary, fails_a boolean, fails_b boolean, fails_c boolean, fails_d boolean"
    read = stored(rows.mapInArrow(_flags(min_words, min_distinct, max_upper), schema), "flags")
    copies = stored(read.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "copies")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    # merge joins: neither side has a bound, and adaptive execution splits their hot partitions
    told = read.join(copies.hint("merge"), "digest", "left").join(stored(marks, "marks").hint("merge"), "doc_id", "left")
    return told.select(
        "doc_id", "part", "fails_a", "fails_b", "fails_c", "fails_d",
        F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("fails_e"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def replay(told: DataFrame) -> DataFrame:
    """The counts of each part, order and step, from rows of part, fails_a to fails_e, good and toxic."""
    spark = told.sparkSession
    orders = spark.createDataFrame(
        [("".join(p), *(p.index(x) + 1 for x in FILTERS)) for p in permutations(FILTERS)],
        "filter_order string, " + ", ".join(f"at_{x} int" for x in FILTERS.lower()),
    )
    failed = F.array(*(F.col(f"fails_{x}") for x in FILTERS.lower()))
    first = F.least(*(F.when(F.col(f"fails_{x}"), F.col(f"at_{x}")).otherwise(len(FILTERS) + 1) for x in FILTERS.lower()))
    crossed = told.select("part", failed.alias("failed"), F.size(F.filter(failed, lambda x: x)).alias("n_failed"), "good", "toxic", *(f"fails_{x}" for x in FILTERS.lower()))
    steps = (
        crossed.crossJoin(F.broadcast(orders))
        .withColumn("first", first)
        .withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(FILTERS) + 1)))))
        .withColumn("fails", F.element_at("failed", F.instr(F.lit(FILTERS), F.col("filter_order").substr(F.col("step"), F.lit(1)))))
    )
    here = F.col("first") == F.col("step")
    cases = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": F.col("fails") & (F.col("first") < F.col("step")),
        "unique_fails": F.col("fails") & (F.col("n_failed") == 1),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    counted = steps.groupBy("part", "filter_order", "step").agg(*(F.sum(cases[c].cast("long")).alias(c) for c in COUNTS))
    one_filter = Window.partitionBy("part", F.col("filter_order").substr(F.col("step"), F.lit(1)))  # 120 rows each
    return counted.withColumn("shapley", F.sum("removed").over(one_filter))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return replay(flags(docs, labels))
