"""Operator 5: language identification by a linear-chain conditional random field over words.

A text is a sequence of words, each with a hidden language. Emissions sum the weights of hashed features
of the word: byte 1- to 4-grams with word bounds (so prefixes and suffixes are among them) and the word itself
(the lexicon). Transitions between languages are learned with them, so switches within a text are found.
Forward-backward gives every word's distribution; a text's language is the one with the largest sum over its
words with letters, and the score is that language's mean.

Training takes at most `SAMPLE` labelled texts of each language, in the order of a hash of id and text, outside the
held-out fold; for a text over `longest` bytes stand `SPANS` spans spread evenly over the whole of it, `longest / 4`
characters in all. So every language with a labelled row is learned, from rows whose number and size are bounded. Every text
is labelled whole. Words are scored once for each batch, and the chain runs over all texts of a batch in step, long ones in
segments of `SEGMENT` words.

A letter is one of Unicode's letter categories. Null text, and text without a letter, is `und` with score 0. Without labelled rows everything is `und`. Repeated
rows are predicted one by one; null ids belong to the fold of the empty text. Of equal hashes, the least text is taken for
training. An empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fold, small_batches
from .tokens import LOWER, Words, hash_spans, mix, words

SAMPLE, SPREAD, LONGEST, FOLDS, HELD_OUT = 375, 4096, 20_000, 4, 2
FEATURES, GRAMS, ROUNDS = 1 << 16, 4, 25
#: Words of a chain that are run one after the other; the segments of longer chains run in step.
SEGMENT = 2048
#: Spans that stand for a labelled text over LONGEST bytes.
SPANS = 10
UNKNOWN = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # FEATURES x languages
    moves: np.ndarray  # log weights from language to language
    first: np.ndarray  # log weights of the first word's language


@dataclass
class Chains:
    """A batch of texts as chains of unique words."""

    at: np.ndarray  # offsets of the texts in the words
    word: np.ndarray  # which unique word each word is
    letters: np.ndarray  # of each unique word: has it a letter
    feature: np.ndarray  # features of all unique words, one after the other
    feature_at: np.ndarray  # offsets of the unique words in feature


def _lettered(w: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether spans have a letter: bytes decide for ASCII, other text is looked at."""
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[w.data])])
    found = total[end] > total[start]
    other = np.concatenate([[0], np.cumsum(w.data > 127)])
    for i in np.flatnonzero(~found & (other[end] > other[start])).tolist():
        found[i] = any(map(str.isalpha, w.data[start[i] : end[i]].tobytes().decode(errors="replace")))
    return found


def chains(texts: pa.Array) -> Chains:
    w = words(texts)
    w.data = LOWER[w.data]
    unique, index, where = np.unique(w.hashes(), return_index=True, return_inverse=True)
    start, end = w.start[index], w.end[index]
    size = end - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    body = np.full(at[-1], 32, np.uint8)  # a space stands for the bound of a word
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    offset = np.arange(at[-1]) - np.repeat(at[:-1], size)
    body[inner] = w.data[(np.repeat(start, size) + offset - 1)[inner]]
    left = np.repeat(at[1:], size) - np.arange(at[-1])  # bytes left in the word
    parts, owner = [unique], [np.arange(len(unique))]
    of = np.repeat(np.arange(len(unique)), size)
    key = np.zeros(len(body), np.uint64)
    padded = np.concatenate([body, np.zeros(GRAMS, np.uint8)]).astype(np.uint64)
    for n in range(1, GRAMS + 1):
        key = key << np.uint64(8) | padded[n - 1 : n - 1 + len(body)]
        some = left >= n
        parts.append(key[some] + (np.uint64(n) << np.uint64(40)))
        owner.append(of[some])
    owned = np.concatenate(owner)
    order = np.argsort(owned, kind="stable")
    feature = (mix(np.concatenate(parts)) % np.uint64(FEATURES)).astype(np.int64)[order]
    return Chains(w.at, where, _lettered(w, start, end), feature, np.searchsorted(owned[order], np.arange(len(unique) + 1)))


def emissions(c: Chains, weights: np.ndarray) -> np.ndarray:
    """Log emission weights of each unique word."""
    if not len(c.letters):
        return np.zeros((0, weights.shape[1]), np.float32)
    out = np.add.reduceat(weights[c.feature], c.feature_at[:-1], axis=0) / np.sqrt(np.diff(c.feature_at))[:, None]
    return out.astype(np.float32)


def transfers(word: np.ndarray, begin: np.ndarray, size: np.ndarray, strength: np.ndarray, move: np.ndarray) -> np.ndarray:
    """For each segment of words, the matrix that takes the message before it to the one after it, scaled to sum 1."""
    k = len(move)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    state = np.tile(np.eye(k, dtype=np.float32) / k, (len(begin), 1, 1))
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # segments with more than t words
    for t, n in enumerate(live.tolist()):
        now = (state[:n] @ move) * strength[word[begin[:n] + t]][:, None, :]
        state[:n] = now / now.sum((1, 2), keepdims=True)
    out = np.empty_like(state)
    out[order] = state
    return out


def forward_backward(c: Chains, emit: np.ndarray, moves: np.ndarray, first: np.ndarray, segment: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Each word's distribution over languages, expected moves between languages, and the log partition sum.

    With `segment`, longer chains are cut into segments that run in step: a segment's transfer matrix carries the messages
    over it, so the distributions are those of the whole chain. The moves over cuts and the sum are left out then.
    """
    top = emit.max(1, keepdims=True) if len(emit) else emit
    strength = np.exp(emit - top)
    move, start = np.exp(moves).astype(np.float32), np.exp(first).astype(np.float32)
    k = emit.shape[1]
    whole = np.diff(c.at)
    pieces = np.maximum(-(-whole // segment), 1) if segment else np.ones(len(whole), np.int64)
    head = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)
    place = np.arange(head[-1]) - np.repeat(head[:-1], pieces)
    begin = np.repeat(c.at[:-1], pieces) + place * (segment or 0)
    size = np.minimum(np.repeat(c.at[1:], pieces) - begin, segment) if segment else whole
    into = np.zeros((len(begin), k), np.float32)  # message before a segment; unused for first ones
    after = np.ones((len(begin), k), np.float32)  # message behind its last word
    opens = place == 0
    long = np.repeat(pieces > 1, pieces)
    skip = opens[long].astype(np.int64)  # the first word has its own message
    matrices = transfers(c.word, begin[long] + skip, size[long] - skip, strength, move)  # of all long texts in step
    done = 0
    for i in np.flatnonzero(pieces > 1).tolist():
        a, b = head[i], head[i + 1]
        matrix = matrices[done : done + b - a]
        done += b - a
        message = start * strength[c.word[begin[a]]]
        for j in range(a, b - 1):
            message = message @ matrix[j - a]
            message = into[j + 1] = message / message.sum()
        message = after[b - 1]
        for j in range(b - 2, a - 1, -1):
            message = matrix[j + 1 - a] @ message
            message = after[j] = message / message.sum()
    order = np.argsort(-size, kind="stable")
    begin, size, into, after, opens = begin[order], size[order], into[order], after[order], opens[order]
    ahead = np.empty((len(c.word), k), np.float32)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")  # segments with more than t words
    log_z = float(top[c.word].sum()) if len(c.word) else 0.0
    state = None
    for t in range(longest):
        n = live[t]
        rows = begin[:n] + t
        state = (np.where(opens[:n, None], start, into[:n] @ move) if t == 0 else state[:n] @ move) * strength[c.word[rows]]
        scale = state.sum(1, keepdims=True)
        state /= scale
        log_z += float(np.log(scale).sum())
        ahead[rows] = state
    expected = np.zeros_like(move, dtype=float)
    behind = np.ones((0, k), np.float32)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        rows = begin[:n] + t
        if n > len(behind):
            behind = np.concatenate([behind, after[len(behind) : n]])
        if t:
            below = behind * strength[c.word[rows]]
            before = ahead[rows - 1]
            pair = before.T @ (below / np.einsum("ni,ij,nj->n", before, move, below)[:, None])
            expected += pair * move
            up = below @ move.T
        both = ahead[rows] * behind
        ahead[rows] = both / both.sum(1, keepdims=True)
        if t:
            behind = up / up.sum(1, keepdims=True)
    return ahead, expected, log_z


def train(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> Model | None:
    """Penalised likelihood by Adam, from a naive Bayes start."""
    names = sorted(set(langs))
    if not names:
        return None
    c = chains(pa.array(texts, pa.string()))
    k = len(names)
    label = np.repeat([names.index(x) for x in langs], np.diff(c.at))
    unique = len(c.letters)
    gold = np.bincount(c.word * k + label, minlength=unique * k).reshape(unique, k).astype(float)
    owner = np.repeat(np.arange(unique), np.diff(c.feature_at))
    scale = 1 / np.sqrt(np.diff(c.feature_at))

    def spread(by_word: np.ndarray) -> np.ndarray:
        by_word = by_word * scale[:, None]
        return np.stack([np.bincount(c.feature, by_word[owner, j], FEATURES) for j in range(k)], 1)

    counts = spread(gold) + 0.5
    weights = np.log(counts / counts.sum(0))
    weights -= weights.mean(1, keepdims=True)
    weights *= 0.3
    starts = np.bincount([names.index(x) for x in langs], minlength=k).astype(float)
    first = np.log((starts + 1) / (starts.sum() + k))
    moves = np.full((k, k), -4.0) + np.eye(k) * 4
    inside = np.bincount([names.index(x) for x in langs], np.maximum(np.diff(c.at) - 1, 0), k)
    speed = [0.1, 0.05]
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, moves)]
    for r in range(1, rounds + 1):
        marginal, expected, _ = forward_backward(c, emissions(c, weights), moves, first)
        have = np.stack([np.bincount(c.word, marginal[:, j], unique) for j in range(k)], 1)
        slopes = [spread(gold - have) / len(c.word) * 1000 - 1e-3 * weights, (np.diag(inside) - expected) / len(c.word) * 1000 - 1e-2 * moves]
        for x, g, (m, v), rate in zip((weights, moves), slopes, state, speed, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        moves[:] = np.clip(moves, -8, 4)  # a switch stays possible, though most training texts have none
    return Model(names, weights.astype(np.float32), moves, first)


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    c = chains(texts)
    marginal, _, _ = forward_backward(c, emissions(c, model.weights), model.moves, model.first, SEGMENT)
    votes = np.zeros((len(texts), len(model.langs)))
    some = np.diff(c.at) > 0
    if some.any():  # each text is summed by itself, so its score does not depend on the texts beside it
        votes[some] = np.add.reduceat(np.where(c.letters[c.word][:, None], marginal, 0).astype(float), c.at[:-1][some], axis=0)
    total = votes.sum(1)
    best = votes.argmax(1)
    score = np.where(total > 0.5, votes[np.arange(len(best)), best] / np.maximum(total, 1e-9), 0.0)
    return [model.langs[b] if t > 0.5 else UNKNOWN for b, t in zip(best, total, strict=True)], np.clip(score, 0, 1)


def _predicted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            if model is None:
                langs, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            else:
                langs, score = predict(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs."""
    small_batches(docs.sparkSession)
    held = fold(id_col, FOLDS) == HELD_OUT
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    width = max(1, longest // (4 * SPANS))
    spans = F.transform(F.sequence(F.lit(0), F.lit(SPANS - 1)), lambda i: F.substring(F.col(text_col), (1 + i * F.floor((F.char_length(text_col) - width) / (SPANS - 1))).cast("int"), F.lit(width)))
    span = F.when(F.octet_length(text_col) <= longest, F.col(text_col)).otherwise(F.array_join(spans, " "))
    known = docs.where(~held & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(span.alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("place"))
    # the least hash of each of SPREAD classes: bounded for each language, however its rows are dealt
    least = known.groupBy("lang", F.pmod("place", F.lit(SPREAD))).agg(F.min("place").alias("place")).select("lang", "place").collect()
    places: dict[str, list[int]] = {}
    for r in sorted(least):
        places.setdefault(r.lang, []).append(r.place)
    picked = docs.sparkSession.createDataFrame([(x, p) for x, some in places.items() for p in some[:sample]], "lang string, place long")
    rows = known.join(F.broadcast(picked), ["lang", "place"]).groupBy("lang", "place").agg(F.min("text").alias("text")).collect()  # at most sample * longest bytes for each language
    rows.sort(key=lambda r: (r.place, r.lang))
    model = train([r.text for r in rows], [r.lang for r in rows])
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_predicted(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
