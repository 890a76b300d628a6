"""Operator 3: pack documents into token sequences by cutting-stock column generation.

A document's tokens fill whole sequences first; what remains (its tail) is packed with other tails. The
tails' lengths, in `GRAIN`-token classes, make a histogram of at most `SPACE / GRAIN` rows, and only that
reaches the driver. There a linear program over packing patterns is solved: its columns are priced by an
unbounded-knapsack dynamic program over the duals until none is worth entering. The solution is rounded
down; pattern copies own ranges of ranks in each class, and the documents, ranked within their class, take
the places. Tails beyond the rounded patterns, or in patterns that would waste more than `WASTE` classes,
are laid end to end and cut at sequence bounds, so that only the last sequence is short.

Ranks and running sums are made in two levels (a part of a class, then the parts), so a class that holds
most documents is not ranked in one task. A first pass keeps lengths and checksums only; the texts of tails
that are cut are read once more. Words are tokenized once for each batch: the tokenizer drops white
space, so a text's ids are those of its words, one after the other.
With classes of 16 tokens the program converges within its pivots and about 0.4 % of tails are cut.

Null text is empty and packs as its end id alone. Repeated rows and null ids are packed row by row.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, give_back, small_batches, stored
from .tokens import LOWER, Words, hash_spans, words
from .tokens import SPACE as SPACES

SPACE, END, GRAIN, WASTE, PARTS, BITS = 2048, 1, 16, 1, 1024, 1 << 16
#: Pivots at most; every basis is a feasible packing, so an early stop costs padding only.
PIVOTS = 2500
#: The program stops when its dual bound shows it within this share of the optimum.
GAP = 0.003
#: Pieces of words whose ids a worker remembers, and bytes of text that it encodes at once.
REMEMBER, AT_ONCE = 400_000, 1 << 20


_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: bytes without a visible Latin-1 character take the next ones from U+0100.
_ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_ALPHA, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True
_DIGIT[48:58] = True


def pieces(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, piece starts, piece ends, and whether a piece is a whole word of other characters.

    A plain word (printable ASCII but for the apostrophe, and Latin-1 letters) falls into runs of letters, single
    digits and runs of signs, as the tokenizer splits it; any other word, or one with a special token's mark, is left whole.
    """
    d = w.data
    if not len(d):
        return d, w.start, w.end, np.zeros(0, bool)
    before, after = np.concatenate([[0], d[:-1]]), np.concatenate([d[1:], [0]])
    latin = (before == 0xC3) & (d >= 0x80) & (d < 0xC0) & (d != 0x97) & (d != 0xB7)
    lead = np.concatenate([latin[1:], [False]])
    letter = _ALPHA[d] | latin | lead
    other = (d < 33) | (d == 127) | (d == 0x27) | ((d >= 0x80) & ~latin & ~lead) | ((d == 0x3C) & (after == 0x7C))
    total = np.concatenate([[0], np.cumsum(other)])
    whole = total[w.end] > total[w.start]
    low = LOWER[d]
    low[latin & (d < 0x9F)] += 0x20
    kind = np.where(letter, 0, 1 + _DIGIT[d])
    new = np.ones(len(d), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    for a, b in zip(w.start[whole].tolist(), w.end[whole].tolist(), strict=True):
        new[a:b] = False
        low[a:b] = d[a:b]
    new &= ~SPACES[d]
    new[w.start] = True
    start = np.flatnonzero(new)
    word = np.searchsorted(w.start, start, "right") - 1
    return low, start, np.minimum(np.append(start[1:], len(d)), w.end[word]), whole[word]


#: The normaliser and the split that `pieces` does by itself. Of any other tokenizer whole texts are encoded.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


class WordIds:
    """ids of Arrow texts: each unique piece of a batch's words is merged once, and remembered.

    What is remembered are arrays in the order of the pieces' hashes (about 30 bytes a piece), as a worker has little memory.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        self.merge = self.tokenizer.model.tokenize
        said = lambda part: json.loads(part.__getstate__()) if part else {}  # noqa: E731  (not the whole tokenizer as text, with its vocabulary)
        self.by_pieces = said(self.tokenizer.normalizer) == _NORMAL and said(self.tokenizer.pre_tokenizer).get("pretokenizers", [None])[0] == _SPLIT

    def forget(self) -> None:
        self.hashes, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def piece(self, body: bytes, whole: bool) -> list[int]:
        if whole:
            return self.tokenizer.encode(body.decode(), add_special_tokens=False).ids
        return [t.id for t in self.merge(body.decode() if body.isascii() else "".join(_ALPHABET[b] for b in body))]

    def new(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes (ascending) are not remembered."""
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return self.hashes[place] != hashes if len(self.hashes) else np.ones(len(hashes), bool)

    def learn(self, hashes: np.ndarray, bodies: list[bytes], whole: list[bool]) -> None:
        ids = [self.piece(x, o) for x, o in zip(bodies, whole, strict=True)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        place = np.searchsorted(self.hashes, hashes)
        self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(size, dtype=np.int64) - size)
        self.size, self.hashes = np.insert(self.size, place, size), np.insert(self.hashes, place, hashes)
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.by_pieces:
            return [np.array([*self.tokenizer.encode(t or "", add_special_tokens=False).ids, END], "<u4") for t in texts.to_pylist()]
        w = words(texts)
        low, start, end, whole = pieces(w)
        hashes, first, where = np.unique(hash_spans(low, start, end), return_index=True, return_inverse=True)
        if len(self.hashes) + self.new(hashes).sum() > REMEMBER:
            self.forget()
        if (new := self.new(hashes)).any():
            spans = zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
            self.learn(hashes[new], [low[a:b].tobytes() for a, b in spans], whole[first[new]].tolist())
        known = np.searchsorted(self.hashes, hashes)[where]
        size = self.size[known]
        out = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        shift = np.repeat(self.at[known] - out[:-1], size)
        shift += np.arange(out[-1])
        text_at = out[np.searchsorted(start, w.text_at)]
        every = np.insert(self.ids[shift], text_at[1:], np.uint32(END)).astype("<u4", copy=False)
        bounds = (text_at + np.arange(len(text_at))).tolist()
        return [every[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def _measured(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=AT_ONCE):
            ids = loaded(path)(batch.column("text"))
            sums = [[checksum(x[i : i + SPACE]) for i in range(0, len(x), SPACE)] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "total", "sums"])
        give_back()

    return run


def _tails(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=AT_ONCE):
            ids = loaded(path)(batch.column("text"))
            tail = [x[len(x) // SPACE * SPACE :] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([checksum(x) for x in tail], pa.int64()), pa.array([x.tobytes() for x in tail], pa.binary())], ["doc_id", "total", "tail_sum", "tail_ids"])
        give_back()

    return run


def best_pattern(prices: np.ndarray, sizes: np.ndarray, space: int) -> np.ndarray:
    """The counts that fill at most `space` with the dearest items: unbounded knapsack."""
    value, taken = np.zeros(space + 1), np.full(space + 1, -1)
    for c in range(1, space + 1):
        fits = np.searchsorted(sizes, c, "right")
        value[c], taken[c] = value[c - 1], -1
        if fits:
            worth = value[c - sizes[:fits]] + prices[:fits]
            if worth[best := int(worth.argmax())] > value[c] + 1e-12:
                value[c], taken[c] = worth[best], best
    out, c = np.zeros(len(sizes)), space
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out[taken[c]] += 1
            c -= sizes[taken[c]]
    return out


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, space: int, pivots: int = PIVOTS) -> list[tuple[np.ndarray, float]]:
    """(counts by size, times) of the patterns in the optimal basis. sizes ascend."""
    m = len(sizes)
    if not m:
        return []
    columns = np.diag((space // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    times = inverse @ demand
    for _ in range(pivots):
        prices = inverse.sum(0)
        new = best_pattern(np.maximum(prices, 0), sizes, space)
        if prices @ new <= 1 + GAP:
            break
        step = inverse @ new
        able = step > 1e-10
        leaves = int(np.where(able, times / np.where(able, step, 1), np.inf).argmin())
        columns[:, leaves] = new
        row = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, row)
        inverse[leaves] = row
        times = np.maximum(inverse @ demand, 0)
    return [(columns[:, j], float(times[j])) for j in range(m)]


def layout(histogram: dict[int, int], space: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(class, from rank, to rank, each, first sequence, first place) for the rounded patterns, and their sequences."""
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], float)
    used, rows, sequence = np.zeros(len(sizes), np.int64), [], 0
    for counts, times in cutting_stock(sizes, demand, space):
        some = np.flatnonzero(counts)
        copies = int(times + 1e-6)
        if not len(some) or space - counts @ sizes > WASTE:
            continue
        copies = int(min([copies, *((histogram[int(sizes[i])] - used[i]) // int(counts[i]) for i in some)]))
        if copies <= 0:
            continue
        place = 0
        for i in some[::-1]:
            each = int(counts[i])
            rows.append((int(sizes[i]), int(used[i]), int(used[i]) + each * copies, each, sequence, place))
            used[i] += each * copies
            place += each
        sequence += copies
    return rows, sequence


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "total"), F.lit(PARTS)), F.lit(0)).cast("int")
    rows = docs.mapInArrow(_measured(tokenizer), "doc_id long, total long, sums array<long>")
    rows = rows.withColumn("part", part).withColumn("tail", F.col("total") % SPACE).withColumn("class", F.ceil(F.col("tail") / GRAIN).cast("int")).withColumn("full", F.floor(F.col("total") / SPACE)).withColumn("tail_sum", F.when(F.col("tail") > 0, F.element_at("sums", -1)))
    rows = stored(rows, "lengths")

    tally = stored(rows.groupBy("class", "part").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "tally")  # SPACE / GRAIN * PARTS rows at most
    histogram = {r["class"]: r.n for r in tally.where("class > 0").groupBy("class").agg(F.sum("n").alias("n")).collect()}
    ranges, patterns = layout(histogram, SPACE // GRAIN)
    ranges = spark.createDataFrame(ranges, "class int, low long, high long, each long, first_sequence long, first_place long")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    class_at = tally.select("class", "part", F.coalesce(F.sum("n").over(before(Window.partitionBy("class").orderBy("part"))), F.lit(0)).alias("class_at"))
    order = ["doc_id", "total", "tail_sum"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("class", "part").orderBy(*order)) - 1).join(class_at, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("class_at"))
    # ranges has at most (SPACE / GRAIN)^2 rows, whatever the input
    ranked = ranked.join(F.broadcast(ranges.withColumnRenamed("class", "c")), (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    k = F.col("rank") - F.col("low")
    ranked = ranked.withColumn("sequence_id", F.col("first_sequence") + F.floor(k / F.col("each"))).withColumn("place", F.col("first_place") + k % F.col("each"))
    ranked = stored(ranked.select("doc_id", "total", "sums", "part", "tail", "full", "tail_sum", "rank", "sequence_id", "place"), "ranked")

    start = (F.col("full") * SPACE).alias("start")
    seat = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = ranked.where("sequence_id is not null").select("doc_id", start, F.col("tail").alias("length"), F.col("tail_sum").alias("ids_crc32"), F.col("total").alias("doc_tokens"), "sequence_id", (F.sum("tail").over(seat) - F.col("tail")).alias("offset"))

    # tails that no pattern took, end to end
    pool = ranked.where("sequence_id is null and tail > 0")
    pool_parts = pool.groupBy("part").agg(F.sum("tail").alias("n"))
    pool_tokens = pool_parts.agg(F.sum("n")).first()[0] or 0
    pool_at = pool_parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_at"))
    at = F.coalesce(F.sum("tail").over(before(Window.partitionBy("part").orderBy(*order, "rank"))), F.lit(0))
    cuts = pool.withColumn("at", at).join(pool_at, "part").withColumn("at", F.col("at") + F.col("part_at"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / SPACE), F.floor((F.col("at") + F.col("tail") - 1) / SPACE))))
    low, high = F.greatest(F.col("at"), F.col("k") * SPACE), F.least(F.col("at") + F.col("tail"), (F.col("k") + 1) * SPACE)
    cuts = stored(cuts.select("doc_id", "full", "total", "tail", "tail_sum", (low - F.col("at")).alias("skip"), (high - low).alias("length"), (F.col("k") + patterns).alias("sequence_id"), (low - F.col("k") * SPACE).alias("offset")), "cuts")
    whole = cuts.where("length = tail").select("doc_id", start, "length", F.col("tail_sum").alias("ids_crc32"), F.col("total").alias("doc_tokens"), "sequence_id", "offset")
    cut = cuts.where("length < tail")
    bit = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(BITS)), F.lit(0))
    bits = cut.select(bit.alias("bit")).distinct()  # BITS rows at most
    again = docs.join(F.broadcast(bits), bit == F.col("bit"), "left_semi").mapInArrow(_tails(tokenizer), "doc_id long, total long, tail_sum long, tail_ids binary")
    again = again.groupBy(*order).agg(F.first("tail_ids").alias("tail_ids"))
    same = F.expr("doc_id <=> d and total = t and tail_sum = s")
    cut = cut.join(again.withColumnsRenamed({"doc_id": "d", "total": "t", "tail_sum": "s"}), same)
    part_ids = F.expr("substring(tail_ids, cast(4 * skip + 1 as int), cast(4 * length as int))")
    cut = cut.select("doc_id", start, "skip", "length", F.crc32(part_ids).alias("ids_crc32"), F.col("total").alias("doc_tokens"), "sequence_id", "offset").withColumn("start", F.col("start") + F.col("skip"))

    # whole sequences of one document
    base = patterns + -(-pool_tokens // SPACE)
    full_at = tally.groupBy("part").agg(F.sum("full").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("part_at"))
    inner = F.coalesce(F.sum("full").over(before(Window.partitionBy("part").orderBy(*order, "rank"))), F.lit(0))
    fulls = ranked.where("full > 0").withColumn("at", inner).join(full_at, "part").withColumn("at", F.col("at") + F.col("part_at"))
    fulls = fulls.select("doc_id", "total", "sums", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k"))
    fulls = fulls.select("doc_id", (F.col("k") * SPACE).alias("start"), F.lit(SPACE).cast("long").alias("length"), F.col("sums")[F.col("k").cast("int")].alias("ids_crc32"), F.col("total").alias("doc_tokens"), (F.col("at") + F.col("k") + base).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(*out).unionByName(whole.select(*out)).unionByName(cut.select(*out)).unionByName(fulls.select(*out))
