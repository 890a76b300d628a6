"""Operator 7: quality rules with a hashed n-gram log-likelihood ratio.

Byte trigrams of the texts are hashed to `BUCKETS` buckets. Their counts over all documents make the raw-corpus
multinomial; their counts over trusted documents (labels.quality = 1) make the target multinomial. A document's score is
the mean, over its trigrams, of log(target / raw): length-normalised. One threshold decides every document; base rules are
applied first. The log ratios are whole numbers of 2^-20, so a score does not depend on the texts beside it.

Labelled rows fall into two halves by crc32 of the id: all trusted rows of one half make the target, all labelled rows
of the other half set the threshold, from a histogram of their scores. Labels meet documents in a join
on the id, behind a Bloom filter of the ids, so that only labelled texts are shuffled.

Null text has no words and fails the base rules, so it is not kept. Without trusted rows the score is 0, and without
trusted and untrusted rows in the other half there is no threshold: then the base rules alone decide. Repeated labels count once, a row with both labels as untrusted; labels with
null in id or quality are left out. Null ids are scored like others but never trusted. Repeated rows are judged one by one,
a text of any length in one piece; an empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fold, give_back, small_batches, stored, with_ids
from .tokens import SPACE, flat, mix, windows, words

BUCKETS, ROW, BINS, UNIT = 1 << 15, 512, 2000, 1 << 20
#: Bytes of text that a task judges at once; the arrays of a batch take some fifty times as much.
BYTES = 2 << 20
#: What rejecting a trusted document costs, as a multiple of keeping an untrusted one.
COST = 20
#: The rules that are applied first.
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_RULE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram at each byte, and whether it lies within one text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    x = data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]
    within = np.ones(len(x), bool)
    edges = at[1:-1]
    for k in (1, 2):
        within[np.clip(edges - k, 0, len(x) - 1)[(edges >= k) & (edges - k < len(x))]] = False
    return ((x * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), within


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of whole values over the spans between the offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[np.minimum(at[1:], len(values))] - total[np.minimum(at[:-1], len(values))]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's trigrams, a row for each `ROW` buckets."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in by_bytes(batches, limit=BYTES):
        bucket, within = grams(*flat(batch.column("text")))
        total += np.bincount(bucket[within], minlength=BUCKETS)
    some = np.flatnonzero(total.reshape(-1, ROW).any(1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(total.reshape(-1, ROW)[some]), pa.list_(pa.int64()))], ["row", "counts"])
    give_back()


def _summed(table: pa.Table) -> pa.Table:
    counts = sum(np.asarray(chunk.flatten()).reshape(-1, ROW).sum(0) for chunk in table.column("counts").chunks if len(chunk))
    return pa.table({"row": table.column("row")[:1], "counts": pa.array([counts], pa.list_(pa.int64()))})


def dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def repeated(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, its words in 3-word windows that occur twice or more."""
    w, out = windows(h, at, 3)
    text = np.repeat(np.arange(len(at) - 1), np.diff(out))
    key = mix(w ^ mix(text.astype(np.uint64)))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    first = (np.arange(len(w)) - out[text] + at[text])[times[where] > 1]
    marked = np.zeros(len(h), bool)
    for k in range(3):
        marked[first + k] = True
    return sums(marked, at)


def rules(texts: pa.Array, ratio: np.ndarray | None) -> tuple[np.ndarray, ...]:
    w = words(texts)
    chars = (w.data & 0xC0) != 0x80
    n = w.counts
    lines = np.array([dup_lines(w.data[a:b].tobytes()) for a, b in zip(w.text_at[:-1].tolist(), w.text_at[1:].tolist(), strict=True)], np.int64)
    score = np.zeros(len(texts))
    if ratio is not None:
        bucket, within = grams(w.data, w.text_at)
        score = sums(np.where(within, ratio[bucket], 0), w.text_at) / (np.maximum(np.diff(w.text_at) - 2, 1) * UNIT)
    return n, sums(chars & ~SPACE[w.data], w.text_at), sums(SYMBOL[w.data], w.text_at), lines, repeated(w.hashes(), w.at), score


def _scored(ratio: np.ndarray | None, names: list[str], text_col: str, floor: float | None = None):
    """Batches with the rules' columns beside those named; with a floor, only the columns named, of the rows that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, BYTES):
            found = rules(batch.column(text_col), ratio)
            if floor is not None:
                n, repeats, score = found[0], found[4], found[5]
                yield batch.filter(pa.array((n >= 50) & (100 * repeats <= 50 * n) & (score >= floor)))
            else:
                own = [x.split()[0] for x in _RULE.split(", ")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(np.asarray(x)) for x in found)], [*names, *own])
        give_back()

    return run


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, good (quality 1 and no other label), half (0 sets the target, 1 the threshold)."""
    by_id = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    return stored(by_id.withColumn("half", fold("doc_id", 2)), "marks")


def trigrams(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in a column of texts."""
    schema = "row int, counts array<long>"
    found = texts.toDF("text").mapInArrow(_counted, schema).groupBy("row").applyInArrow(_summed, schema).collect()  # BUCKETS / ROW rows at most
    out = np.zeros((BUCKETS // ROW, ROW))
    for r in found:
        out[r.row] = r.counts
    return out.reshape(-1)


def log_ratio(docs: DataFrame, marks: DataFrame) -> np.ndarray | None:
    """log(target / raw) of each bucket in units of 1 / UNIT; None without trusted documents."""
    raw = trigrams(docs.select("text"))
    target = trigrams(with_ids(docs, marks.where("good and half = 0").select("doc_id")).select("text"))
    if not target.sum():
        return None
    smooth = 1.0
    ratio = np.log((target + smooth) / (target.sum() + smooth * BUCKETS)) - np.log((raw + smooth) / (raw.sum() + smooth * BUCKETS))
    return np.round(ratio * UNIT).astype(np.int64)


def threshold(docs: DataFrame, marks: DataFrame, ratio: np.ndarray) -> float:
    """The score below which documents go: the one of least cost on the labelled rows that pass the base rules."""
    rows = with_ids(docs, marks.where("half = 1").select("doc_id", "good")).select("text", "good")
    rows = stored(rows.mapInArrow(_scored(ratio, ["good"], "text"), f"good boolean, {_RULE}").where(f"not ({BASE})").select("good", "score"), "scores")
    spread = rows.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if spread.low is None or spread.low == spread.high:
        return -np.inf
    width = (spread.high - spread.low) / BINS
    table = np.zeros((2, BINS + 1))
    for r in rows.groupBy("good", F.floor((F.col("score") - spread.low) / width).alias("bin")).count().collect():  # 2 * BINS rows at most
        table[int(r.good), min(r.bin, BINS)] += r["count"]
    if not table[0].sum() or not table[1].sum():
        return -np.inf  # nothing to tell apart
    lost = np.concatenate([[0], np.cumsum(table[1])]) / max(1, table[1].sum())
    stay = 1 - np.concatenate([[0], np.cumsum(table[0])]) / max(1, table[0].sum())
    cost = COST * lost + stay
    tied = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(spread.low + width * float(tied[0] + tied[-1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray | None, float]:
    """The log ratios and the threshold."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marks = marked(labels)
    ratio = log_ratio(own, marks)
    return ratio, -np.inf if ratio is None else threshold(own, marks, ratio)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept."""
    ratio, least = fit(docs, labels, id_col, text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    scores = own.mapInArrow(_scored(ratio, ["doc_id"], "text"), f"doc_id {kind}, {_RULE}").withColumn("base_failed", F.expr(BASE))
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(least)))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judged keeps, each by its own verdict, with all their columns."""
    ratio, least = fit(docs, labels, id_col, text_col)
    return docs.mapInArrow(_scored(ratio, docs.columns, text_col, least), docs.schema)
