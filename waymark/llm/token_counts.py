"""Operator 13: tokens of every whole text, as the tokenizer's library gives them; huge texts by overlap resynchronisation.

Texts up to `huge` bytes are counted whole. A longer text is cut into chunks of `core` bytes, each lengthened by `overlap`
bytes of the next; chunks are dealt to tasks by themselves and encoded with offsets. Two neighbours are spliced at the first
place in their overlap where both have the start of a pre-token (the splitter's unit, inside which alone tokens are merged).
That place is proven: the splitter goes from left to right and what it finds after a start depends on the text after it only,
so from a start that both have on, the right chunk reads as the whole text does; and a start that lies `margin` characters or
more before the left chunk's end does not depend on what follows that end, since the splitter looks two characters ahead and
an added token is at most `margin - 4` long. Tokens of the left chunk before the place and of the right one after it then add up.
Where neighbours have no such place (a pre-token longer than the overlap), that document is cut again with a wider overlap,
until every splice is proven or one chunk holds the text.

Null text is empty (0 tokens). Repeated texts are encoded once if huge, and each row gets its count. Ids are carried only, so
null and repeated ids do no harm. An empty table gives no row. Other columns are not read. Strings of added tokens inside texts
count as the library's default has them (one token each).

Pieces of texts without characters beyond U+024F are split by a pattern with the classes of the library's one, and each
distinct piece goes through the library's model once in a worker; other texts, texts that hold an added token's string, and all
texts of a tokenizer with another splitter go through the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, stored

HUGE, CORE, OVERLAP = 64 << 10, 32 << 10, 256
#: Distinct pieces that a worker remembers, and the longest one.
REMEMBER, LONGEST = 400_000, 64

#: Letters, digits and white space up to U+024F, and the byte-level splitter's cases over them.
_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[ɐ-\U0010ffff]")
_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Pieces(dict):
    """Tokens of each distinct piece, by the library's model."""

    def __init__(self, model):
        super().__init__()
        self.merge = model.tokenize

    def __missing__(self, piece: str) -> int:
        n = len(self.merge("".join([_ALPHABET[b] for b in piece.encode()])))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBER:
                self.clear()
            self[piece] = n
        return n


class Encoder:
    """Counts of texts, and the starts of pre-tokens with the tokens before each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in spec["added_tokens"]]
        self.margin = max(map(len, added), default=0) + 4
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.pieces = Pieces(self.tokenizer.model)
        splitter = spec["pre_tokenizer"] or {}
        self.chunked = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and all(splitter.get(k) == v for k, v in _SPLITTER.items())
        plain = not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        self.chunked &= plain and not spec["model"]["dropout"] and not spec["model"]["ignore_merges"]

    def by_pieces(self, text: str) -> bool:
        return self.chunked and not _BEYOND.search(text) and not self.added.search(text)

    def count(self, text: str) -> int:
        if self.by_pieces(text):
            return sum(map(self.pieces.__getitem__, _PIECE.findall(text)))
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def starts(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Where each pre-token starts (characters), tokens before it, and all tokens."""
        if self.by_pieces(text):
            at = np.array([m.start() for m in _PIECE.finditer(text)], np.int64)
            n = np.array([self.pieces[p] for p in _PIECE.findall(text)], np.int64)
            return at, np.cumsum(n) - n, int(n.sum())
        found = self.tokenizer.encode(text, add_special_tokens=False)
        unit = np.array([-1 if u is None else u for u in found.word_ids], np.int64)
        first = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (unit[1:] < 0)])[: len(unit)])
        at = np.array([s for s, _ in found.offsets], np.int64)
        return at[first], first, len(unit)


def _counted(path: str, huge: int):
    """doc_id, n_bytes, n_tokens and null; of a huge text its digest in place of n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        most = huge if encoder.chunked else float("inf")
        for rows in by_bytes(batches):
            n_bytes, n_tokens, digest = [], [], []
            for text in rows.column("text"):
                raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                n_bytes.append(len(raw))
                n_tokens.append(encoder.count(raw.decode()) if len(raw) <= most else None)
                digest.append(hashlib.sha256(raw).digest() if len(raw) > most else None)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(digest, pa.binary())],
                ["doc_id", "n_bytes", "n_tokens", "digest"],
            )

    return run


def _cut(core: int, overlap: int):
    """Chunks of huge texts: digest, chunk, the text of its core and that of its overlap, null after the last core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                raw = text.as_buffer().to_pybytes()
                digest = hashlib.sha256(raw).digest()

                def edge(i: int, raw: bytes = raw) -> int:
                    """i, or the next place after it where a character starts."""
                    while i < len(raw) and raw[i] & 0xC0 == 0x80:
                        i += 1
                    return min(i, len(raw))

                places = [edge(at) for at in range(0, len(raw) - core // 2, core)] or [0]  # a short rest stays with the chunk before it
                for k, (a, b) in enumerate(zip(places, [*places[1:], len(raw)], strict=True)):
                    over = raw[b : edge(b + overlap)].decode() if b < len(raw) else None
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest], pa.binary()), pa.array([k], pa.int32()), pa.array([raw[a:b].decode()]), pa.array([over], pa.string())],
                        ["digest", "chunk", "core", "over"],
                    )

    return run


_CHUNK = "digest binary, chunk int, n long, last boolean, head array<struct<at:long,before:long>>, tail array<struct<at:long,before:long>>"


def _encoded(path: str, overlap: int):
    """Of each chunk its tokens, the starts in its first `overlap` characters, and those after its core that are safe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        pairs = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
        for batch in batches:
            out = [[], [], [], []]
            for core, over in zip(batch.column("core").to_pylist(), batch.column("over").to_pylist(), strict=True):
                at, before, n = encoder.starts(core + (over or ""))
                head = at <= overlap
                tail = (at >= len(core)) & (at + encoder.margin <= len(core) + len(over or ""))
                out[0].append(n)
                out[1].append(over is None)
                out[2].append([{"at": p, "before": q} for p, q in zip(at[head].tolist(), before[head].tolist(), strict=True)])
                out[3].append([{"at": p - len(core), "before": q} for p, q in zip(at[tail].tolist(), before[tail].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("chunk"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pairs), pa.array(out[3], pairs)],
                ["digest", "chunk", "n", "last", "head", "tail"],
            )

    return run


def _spliced(chunks: DataFrame) -> DataFrame:
    """digest and n_tokens of chunked texts; n_tokens is null where neighbours have no common start."""
    left = chunks.where("not last").select("digest", (F.col("chunk") + 1).alias("chunk"), F.explode("tail").alias("t")).select("digest", "chunk", "t.at", F.col("t.before").alias("left_n"))
    right = chunks.where("chunk > 0").select("digest", "chunk", F.explode("head").alias("h")).select("digest", "chunk", "h.at", F.col("h.before").alias("right_n"))
    splice = left.join(right, ["digest", "chunk", "at"]).groupBy("digest", "chunk").agg(F.min_by(F.col("left_n") - F.col("right_n"), "at").alias("n"))
    parts = splice.select("digest", "n", F.lit(1).alias("found"), F.lit(0).alias("wanted")).unionByName(
        chunks.select("digest", F.when(F.col("last"), F.col("n")).otherwise(0).alias("n"), F.lit(0).alias("found"), F.when(F.col("last"), 0).otherwise(1).alias("wanted"))
    )
    total = parts.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("found").alias("found"), F.sum("wanted").alias("wanted"))
    return total.select("digest", F.when(F.col("found") == F.col("wanted"), F.col("n")).alias("n_tokens"))


def chunked_counts(docs: DataFrame, path: str, huge: int = HUGE, core: int = CORE, overlap: int = OVERLAP) -> DataFrame:
    """digest (SHA-256) and n_tokens of the distinct texts over `huge` bytes."""
    small_batches(docs.sparkSession)
    texts = docs.select("text").where(F.octet_length("text") > huge)
    done = None
    while True:
        cut = texts.mapInArrow(_cut(core, overlap), "digest binary, chunk int, core string, over string").dropDuplicates(["digest", "chunk"])
        found = stored(_spliced(stored(cut.mapInArrow(_encoded(path, overlap), _CHUNK), "chunks")), "spliced")
        good = found.where("n_tokens is not null")
        done = good if done is None else done.unionByName(good)
        failed = found.where("n_tokens is null").select("digest")
        if failed.isEmpty():
            return done
        core *= 4
        overlap = min(16 * overlap, core // 2)
        # Spark compares the size of `failed` with its broadcast threshold and merges beyond it
        texts = docs.select("text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")).where(F.octet_length("text") > huge).join(failed, "digest", "left_semi").select("text")


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, huge: int = HUGE, core: int = CORE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.select("doc_id", "text").mapInArrow(_counted(path, huge), f"doc_id {id_type}, n_bytes long, n_tokens long, digest binary"), "counts")
    whole = rows.where("digest is null").select("doc_id", "n_bytes", "n_tokens")
    large = rows.where("digest is not null")
    if not large.isEmpty():
        large = large.drop("n_tokens").join(stored(chunked_counts(docs, path, huge, core, overlap), "huge").hint("merge"), "digest")
        whole = whole.unionByName(large.select("doc_id", "n_bytes", "n_tokens"))
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
