"""Operator 2: toxicity by weak supervision.

Voters are lexicon voters (a word, or the first 4 to 10 bytes of words, occurs in the text) and pattern voters (runs of
marks, shares of capitals, repeated words, no lexicon voter at all). The lexicon is mined from labelled rows. A generative label
model has, for each class, every voter's rate of firing; expectation-maximisation estimates them together with the class
balance from the votes of labelled and unlabelled rows. Labels start the classes and are one more voter, whose rate of error is
estimated too; voters that fire together within a class share their weight, so that correlated ones are not counted twice. A
linear classifier is then trained on the posterior labels of all these rows.

Labels are read only from rows outside the held-out fold. At most `SAMPLE` rows of each class and as many without a label, those of
the least hashes of the id, mine the lexicon, start the label model and are its training rows. Nothing but the text enters a
score.

Null text counts as empty: no lexicon voter fires. Without toxic or without clean labels no voter is learned and scores are 0.
Labels with null are left out; of repeated labels the largest counts; of rows that repeat an id the least text trains.
Repeated rows are scored one by one, texts of any length whole; an empty table gives no rows, and other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fold, small_batches, stored
from .quality import repeated, sums
from .tokens import hash_spans, words

SAMPLE, FOLDS, VOTERS, LEAST = 4000, 5, 300, 4
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
#: What share of the labels is taken to be right, and the correlation from which voters share their weight.
TRUST, BOUND = 0.95, 0.7
#: Least log odds of a lexicon term between toxic and clean rows.
ODDS = 3.0
_PUNCT = np.ones(256, bool)
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
PATTERNS = ("marks", "capitals", "repeats", "symbols", "short")


def terms(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of each word and of its prefixes (0: none), the word offsets of the texts, and the pattern votes."""
    w = words(texts, lower=True)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        start += (start < end - 1) & _PUNCT[w.data[np.minimum(start, max(0, len(w.data) - 1))]] if len(start) else 0
        end -= (end - 1 > start) & _PUNCT[w.data[end - 1]] if len(end) else 0
    found = [hash_spans(w.data, start, end)]
    for k in PREFIXES:
        longer = end - start > k
        h = np.zeros(len(start), np.uint64)
        h[longer] = hash_spans(w.data, start[longer], start[longer] + k) ^ np.uint64(k)
        found.append(h)
    raw = words(texts)
    size = np.maximum(np.diff(raw.text_at), 1)
    n = np.maximum(w.counts, 1)
    capital = sums((raw.data >= 65) & (raw.data <= 90), raw.text_at)
    marks = np.zeros(len(raw.data), bool)
    if len(raw.data) > 1:
        marks[1:] = (raw.data[1:] == 33) & (raw.data[:-1] == 33)
    symbols = sums(np.isin(raw.data, list(b"#*$%&|<>")), raw.text_at)
    patterns = np.stack([sums(marks, raw.text_at) > 0, capital > 0.3 * size, 2 * repeated(w.hashes(), w.at) > n, symbols > 0.02 * size, w.counts < 50], 1)
    return found, w.at, patterns


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        bad = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
        found, at, _ = terms(batch.column("text"))
        text = np.tile(np.repeat(np.arange(len(batch)), np.diff(at)), len(found))
        key = np.concatenate(found)
        pairs = np.unique(np.stack([key.view(np.int64), text], 1)[key != 0], axis=0)
        unique, where = np.unique(pairs[:, 0], return_inverse=True)
        hits = bad[pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(np.bincount(where, hits, len(unique)).astype(np.int64)), pa.array(np.bincount(where, ~hits, len(unique)).astype(np.int64))], ["term", "toxic", "clean"])


@dataclass
class Model:
    lexicon: np.ndarray  # sorted hashes
    weights: np.ndarray  # of the lexicon voters, the pattern voters, log hits, and the constant


def features(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """The votes of lexicon, patterns and of no lexicon hit, the log of all lexicon hits, and 1."""
    found, at, patterns = terms(texts)
    n, k = len(texts), len(lexicon)
    votes = np.zeros((n, k))
    if k:
        sieve = np.zeros(1 << 16, bool)
        sieve[(lexicon & np.uint64(0xFFFF)).astype(np.int64)] = True
        for h in found:
            near = np.flatnonzero(sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(lexicon, h[near]), k - 1)
            hit = lexicon[place] == h[near]
            np.add.at(votes, (np.searchsorted(at, near[hit], "right") - 1, place[hit]), 1)
    hits = np.log1p(votes.sum(1))
    return np.column_stack([votes > 0, patterns, hits == 0, hits, np.ones(n)]).astype(float)


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posterior of class 1 for each row, firing rates by class (2 x voters), each voter's share of weight, and how often
    the labels are right. labels: 1, 0, or -1 for a row without one.

    A voter that does not fire speaks too, with the rate at which it is silent in each class. The labels start the classes
    and are then one more voter, whose rate of error is estimated like the others'.
    """
    known = labels >= 0
    trust = TRUST
    posterior = np.where(known, np.where(labels == 1, trust, 1 - trust), (labels == 1).sum() / max(1, known.sum()))
    for r in range(rounds):
        mass = np.stack([1 - posterior, posterior])
        rates = np.clip((mass @ votes + 0.1) / (mass.sum(1, keepdims=True) + 1), 1e-4, 1 - 1e-4)
        together = np.zeros((votes.shape[1], votes.shape[1]))
        for y in (0, 1):  # correlations within a class
            part = votes - rates[y]
            cov = (part * mass[y][:, None]).T @ part / max(mass[y].sum(), 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            both = cov / np.outer(sd, sd)
            together = np.maximum(together, np.where(both > BOUND, np.clip(both, 0, 1), 0))
        np.fill_diagonal(together, 1)
        # classes that are still mixed make voters look alike, so the first rounds take them as independent
        share = 1 / together.sum(1) if 3 * r >= rounds else np.ones(len(together))
        fires, silent = share * (np.log(rates[1]) - np.log(rates[0])), share * (np.log1p(-rates[1]) - np.log1p(-rates[0]))
        balance = np.log(mass[1].sum() + 1) - np.log(mass[0].sum() + 1)
        gold = np.where(known, np.where(labels == 1, 1, -1) * np.log(trust / (1 - trust)), 0)
        posterior = 1 / (1 + np.exp(-np.clip(votes @ (fires - silent) + silent.sum() + balance + gold, -30, 30)))
        agree = np.where(labels == 1, posterior, 1 - posterior)[known]
        trust = float(np.clip((agree.sum() + TRUST * 10) / (known.sum() + 10), 0.6, 0.98))
    return posterior, rates, share, trust


def linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sampled(lexicon: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            x = features(batch.column("text"), lexicon).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([r.tobytes() for r in x], pa.binary())], ["toxic", "x"])

    return run


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            score = np.zeros(len(batch))
            if model is not None:
                score = 1 / (1 + np.exp(-np.clip(features(batch.column("text"), model.lexicon) @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic (1, 0, or -1 without a label): at most `sample` rows of each, those of the least hashes of the id."""
    outside = (fold("doc_id", FOLDS) != 0) & F.col("doc_id").isNotNull()
    by_id = labels.where(outside & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.where(outside).select("doc_id")
    least = lambda some: some.select("doc_id", F.xxhash64("doc_id").alias("place")).distinct().orderBy("place", "doc_id").limit(sample).select("doc_id")
    picked = [least(by_id.where(F.col("toxic") == y)).withColumn("toxic", F.lit(y)) for y in (1, 0)]
    picked.append(least(ids.join(by_id, "doc_id", "left_anti")).withColumn("toxic", F.lit(-1)))
    chosen = stored(picked[0].unionByName(picked[1]).unionByName(picked[2]), "sampled")  # 3 * sample rows at most
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, text. labels: doc_id, toxic."""
    rows = stored(sampled(docs, labels, sample), "rows")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    rows = rows.select("toxic", "text").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.where("toxic >= 0").mapInArrow(_counts, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    best = counts.where(F.col("toxic") >= LEAST).withColumn("worth", odds * F.sqrt("toxic")).where(odds > ODDS)
    lexicon = np.sort(np.array([r.term for r in best.orderBy(F.col("worth").desc(), "term").limit(VOTERS).collect()], np.int64).view(np.uint64))
    seen = rows.mapInArrow(_sampled(lexicon), "toxic int, x binary").orderBy("toxic", "x").collect()  # 3 * sample rows of VOTERS numbers at most
    x = np.array([np.frombuffer(r.x, np.float32) for r in seen], float)
    votes = x[:, : len(lexicon) + len(PATTERNS) + 1]
    posterior, _, _, _ = label_model(votes, np.array([r.toxic for r in seen]))
    return Model(lexicon, linear(x, posterior))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold(id_col, FOLDS) == 0).alias("held_out"))
    model = fit(own.select("doc_id", "text"), labels, sample)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_scored(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
