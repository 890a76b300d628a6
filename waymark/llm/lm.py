"""Operator 1: language-model scores by a weighted backoff automaton.

States are the contexts seen in training, from the empty one (unigrams) up to `order` - 1 words. A state
has an arc for each word that followed it, weighted by the log10 of its interpolated probability, and a failure
arc to the state of the shorter context, weighted by log10 of that context's share, mu / (count^gamma + mu):
the more often a state was seen, the less it leaves to the shorter one. A text is read once from left to right: the word's
arc leads to the next state, a missing arc means taking failure arcs until there is one, and the log-probabilities add
up. Unigrams have additive smoothing, with one share for all unknown words, so each state's probabilities sum to 1.

The automaton grows with the corpus and is never held by one machine. Documents are dealt to blocks by a hash of
the id and the text. A block sends its distinct n-grams with their training counts, packed as sorted arrays, to
buckets by n-gram hash; a bucket adds them up and answers each block with the totals for the n-grams that
it asked for. So each block builds just the part of the automaton that its texts can reach, and reads all its texts in step,
in segments of `SEGMENT` tokens: the words before a segment lead to its first state, since a state holds order - 1 words. A
frequent n-gram comes once from each block, whatever its count, so no bucket is hot. The number of buckets is bounded.

Words are told apart by 64-bit hashes, longer n-grams by hashes that grow with the corpus, so that about one in
a million is taken for another one. Null text is the empty text: one end token. Null ids are of the crc32 of the empty text,
so held out. Repeated rows count as often as they occur; those equal in id and text share a block. A text of any length is read
whole. An empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches
from .tokens import mix, words

ALPHA, ORDER, FOLDS, SEGMENT = 0.1, 3, 10, 512
#: The share of the shorter context: near the optimum for held-out text at every count from 1 to 2^18.
MU, GAMMA = 8.0, 0.3
#: Buckets at most.
BUCKETS = 1 << 16
#: Bytes of text in a block: the smallest, and the largest that a worker holds at once.
BLOCK, MOST = 6 << 20, 256 << 20
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_K = np.uint64(0x9E3779B97F4A7C15)


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes; the empty planes on top cost nothing."""
    body = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(body.tobytes())


def from_planes(body: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, 8 * n))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(-1)


class Grams:
    """The n-grams of a block's texts: for each order, sorted distinct keys, each token's place among them, and the place
    of a token with each key."""

    def __init__(self, texts: pa.Array, train: np.ndarray, order: int, bits: int = 64):
        w = words(texts, lower=True)
        self.n_tokens = w.counts + 1
        self.at = np.concatenate([[0], np.cumsum(self.n_tokens)])
        token = np.full(self.at[-1], _END)
        last = self.at[1:] - 1
        inner = np.ones(len(token), bool)
        inner[last] = False
        token[inner] = w.hashes()
        train_token = np.repeat(train.astype(bool), self.n_tokens)
        first = self.at[:-1]
        self.keys, self.where, self.counts, self.pads, self.token_of = [], [], [], [], []
        key = np.zeros(len(token), np.uint64)
        pad = np.zeros(1, np.uint64)
        depth = np.arange(len(token)) - np.repeat(first, self.n_tokens)
        back = np.arange(len(token), dtype=np.int32)
        for k in range(order):
            # the key grows to the left by one word, or by a start sign before the text
            word = np.where(depth >= k, token[np.maximum(back - k, 0)], _START)
            key = mix(key * _K + word)
            pad = mix(pad * _K + _START)
            keys = np.append(key, pad) >> np.uint64(64 - (bits if k else 64))
            unique, where = np.unique(keys, return_inverse=True)
            where, pad_at = where[:-1].astype(np.int32), int(where[-1])
            counts = np.bincount(where[train_token], minlength=len(unique))
            counts[pad_at] += int(train.sum())
            token_of = np.zeros(len(unique), np.int32)
            token_of[where] = back
            self.keys.append(unique)
            self.counts.append(counts)
            self.where.append(where)
            self.pads.append(pad_at)
            self.token_of.append(token_of)

    def context(self, k: int, tokens: np.ndarray) -> np.ndarray:
        """Where, among keys of order k, the k words before these tokens are."""
        out = self.where[k - 1][np.maximum(tokens - 1, 0)]
        out[np.isin(tokens, self.at[:-1])] = self.pads[k - 1]
        return out


def bucket_bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Offsets of the buckets in sorted keys: bucket b has the keys of the b-th equal share of all values."""
    bounds = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


class Automaton:
    """The states and arcs that a block's texts can reach. State 0 is the empty context; it has an arc for every word."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, v: int, mu: float = MU, gamma: float = GAMMA, alpha: float = ALPHA):
        order = len(totals)
        sizes = [len(t) for t in totals]
        self.base = base = np.concatenate([[0, 1], 1 + np.cumsum(sizes[:-1])]).astype(np.int64)  # first state of each depth
        self.fail, self.leave = np.zeros(base[order], np.int64), np.zeros(base[order])
        self.words = sizes[0]
        self.unknown = math.log10(alpha) - math.log10(n + alpha * (v + 1))
        sources, labels, weights, targets = [], [], [], []
        lower = None
        for k in range(order):
            token = grams.token_of[k]
            some = totals[k] > 0
            some[grams.pads[k]] = False  # start signs alone are a state and no arc
            if k == 0:
                p = (totals[0] + alpha) / (n + alpha * (v + 1))
                source = np.zeros(sizes[0], np.int64)
            else:
                state = grams.context(k, token)
                count = totals[k - 1][state].astype(float)
                share = np.where(count > 0, mu / (count**gamma + mu), 1.0)
                p = (1 - share) * totals[k] / np.maximum(count, 1) + share * lower[grams.where[k - 1][token]]
                source = base[k] + state
            if k + 1 < order:
                target = base[k + 1] + np.arange(sizes[k])
                up = base[k] + grams.where[k - 1][token] if k else np.zeros(sizes[0], np.int64)
                if k:
                    up[grams.pads[k]] = base[k] + grams.pads[k - 1]
                self.fail[target] = up
                count = totals[k].astype(float)
                self.leave[target] = np.log10(mu / (count**gamma + mu))
            else:
                target = base[k] + grams.where[k - 1][token] if k else np.zeros(sizes[0], np.int64)
            sources.append(source[some])
            labels.append(grams.where[0][token][some])
            weights.append(np.log10(p[some]))
            targets.append(target[some])
            lower = p
        arcs = np.concatenate(sources) * self.words + np.concatenate(labels)
        del sources, labels, lower
        by = np.argsort(arcs, kind="stable")
        self.arcs, self.weights, self.targets = arcs[by], np.concatenate(weights)[by], np.concatenate(targets)[by].astype(np.int32)
        self.start = int(base[order - 1] + grams.pads[order - 2]) if order > 1 and totals[order - 2][grams.pads[order - 2]] > 0 else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the log10 probability of a word in each state."""
        state, weight, after = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            arc = state[left] * self.words + word[left]
            place = np.minimum(np.searchsorted(self.arcs, arc), len(self.arcs) - 1)
            hit = self.arcs[place] == arc if len(self.arcs) else np.zeros(len(left), bool)
            found = left[hit]
            weight[found] += self.weights[place[hit]]
            after[found] = self.targets[place[hit]]
            left = left[~hit]
            root = state[left] == 0
            weight[left[root]] += self.unknown
            left = left[~root]
            weight[left] += self.leave[state[left]]
            state[left] = self.fail[state[left]]
        return after, weight

    def read(self, grams: Grams, order: int, segment: int = SEGMENT) -> np.ndarray:
        """The log10 probability of every token, texts read from left to right."""
        size = grams.n_tokens
        pieces = -(-size // segment)
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(grams.at[:-1], pieces) + place * segment
        length = np.minimum(np.repeat(grams.at[1:], pieces) - begin, segment)
        lead = np.where(place > 0, min(order - 1, segment), 0)  # words that lead to a segment's first state
        begin, length = begin - lead, length + lead
        state = np.where(place > 0, 0, self.start)
        by = np.argsort(-length, kind="stable")
        begin, length, lead, state = begin[by], length[by], lead[by], state[by]
        out, word = np.zeros(grams.at[-1]), grams.where[0]
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, "left"))
            token = begin[:n] + t
            state, weight = self.step(state[:n], word[token])
            own = t >= lead[:n]
            out[token[own]] = weight[own]
        return out


def walk(grams: Grams, totals: list[np.ndarray], n: int, v: int, mu: float = MU, gamma: float = GAMMA, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_known, base_score, score of each text."""
    first = grams.at[:-1]
    seen = totals[0][grams.where[0]]
    base = np.log10(seen + alpha) - math.log10(n + alpha * (v + 1))
    read = Automaton(grams, totals, n, v, mu, gamma, alpha).read(grams, len(totals))
    return np.add.reduceat((seen > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(read, first)


def _asks(buckets: int, order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        grams = Grams(table.column("text").combine_chunks(), table.column("train").to_numpy(), order, bits)
        rows = []
        for k in range(order):
            bounds = bucket_bounds(grams.keys[k], buckets, bits if k else 64)
            for b in range(buckets):
                own = grams.keys[k][bounds[b] : bounds[b + 1]]
                rows.append((k * buckets + b, table.column("block")[0].as_py(), len(own), planes(np.diff(own, prepend=np.uint64(0))), planes(grams.counts[k][bounds[b] : bounds[b + 1]])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "n", "keys", "counts"])

    return run


def _answers(pad: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        keys = [np.cumsum(from_planes(x, n)).astype(np.uint64) for x, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
        counts = np.concatenate([from_planes(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        unique, where = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(where, weights=counts.astype(float), minlength=len(unique)).astype(np.int64)
        real = unique != np.uint64(pad)
        at = np.concatenate([[0], np.cumsum(sizes)])
        answers = [planes(totals[where[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
        n = len(answers)
        return pa.Table.from_arrays([table.column("bucket"), table.column("block"), table.column("n"), pa.array(answers, pa.binary()), pa.array([int(((totals > 0) & real).sum())] * n), pa.array([int(totals[real].sum())] * n)], ["bucket", "block", "n", "totals", "v", "tokens"])

    return run


def _scores(buckets: int, order: int, bits: int, mu: float):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        answers = answers.sort_by("bucket")
        sizes, bodies, bucket = answers.column("n").to_pylist(), answers.column("totals").to_pylist(), answers.column("bucket").to_pylist()
        totals = [np.concatenate([from_planes(x, n) for x, n, b in zip(bodies, sizes, bucket, strict=True) if b // buckets == k]).astype(np.int64) for k in range(order)]
        one = np.array(bucket) < buckets
        v, n = (int(answers.column(c).to_numpy()[one].sum()) for c in ("v", "tokens"))
        del answers, bodies
        grams = Grams(texts.column("text").combine_chunks(), texts.column("train").to_numpy(), order, bits)
        grams.keys = grams.counts = []  # the totals stand for them
        known, base, score = walk(grams, totals, n, v, mu)
        rows = len(texts)
        mean, gain = score / grams.n_tokens, (score - base) / grams.n_tokens
        return pa.Table.from_arrays([texts.column("doc_id"), pa.array(~texts.column("train").to_numpy()), pa.array(grams.n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(rows, n)), pa.array(base), pa.array(score), pa.array(mean), pa.array(gain)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_score", "mean_gain"])

    return run


def start_key() -> int:
    return int(mix(np.array([_START], np.uint64))[0])


def score(docs: DataFrame, order: int = ORDER, mu: float = MU, folds: int = FOLDS, block_bytes: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score (a token's), mean_gain (what contexts
    add to the base score of a token): one row for each row of docs."""
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    size = min(MOST, max(block_bytes, math.isqrt(total * 2560)))  # larger blocks as the corpus grows: blocks times buckets stays in hand
    blocks = max(1, -(-total // size))
    buckets, bits = min(blocks, BUCKETS), min(64, total.bit_length() + 20)
    block = F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (fold(id_col, folds) != 0).alias("train"), block.alias("block")).repartition(blocks, "block")
    asks = texts.groupBy("block").applyInArrow(_asks(buckets, order, bits), "bucket int, block int, n long, keys binary, counts binary")
    answers = asks.groupBy("bucket").applyInArrow(_answers(start_key()), "bucket int, block int, n long, totals binary, v long, tokens long")
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double, mean_gain double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(buckets, order, bits, mu), schema)
