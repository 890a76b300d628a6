"""A corpus pipeline: quality rules, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with the columns of documents; the last gives
packed pieces. run() writes each stage's rows as Parquet in the shared folder and reads them again as the next one's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import exact_dedup, mixing, near_dedup, packing, quality
from waymark.llm.common import documents, labels, stored
from waymark.llm.queries import tokenizer_path


def _keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a key made of each row's id and text, and the key's name, which no column of docs has."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    text = F.when(F.col(text_col).isNull(), "null").otherwise(F.md5(F.col(text_col).cast("binary")))
    return docs.withColumn(name, F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text)), name


def _only(docs: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows of docs (keyed) whose key is kept, one for each key. kept: key."""
    # the join and the removal of repeated rows are dealt by the same key, so rows are shuffled once
    return docs.join(kept.distinct(), key, "left_semi").dropDuplicates([key]).drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the rules reject go, each row by its own verdict."""
    return quality.kept(docs, labels(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts one row stays, one of the smallest id.

    The verdict is carried by the row's id and text, so rows of one id with different texts, and rows without an id, each
    follow their own.
    """
    rows, key = _keyed(docs)
    found = exact_dedup.exact_groups(rows, carry=[key]).where("kept")
    return _only(rows, key, found.groupBy("text_sha256").agg(F.min(key).alias(key)).select(key))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row of each group of near duplicates (five-word shingles, 0.8) stays, one of the smallest id.
    Rows without a word are linked with nothing and all stay."""
    rows, key = _keyed(docs)
    found = near_dedup.near_groups(rows, shingle=5, carry=[key]).where("kept")
    linked = found.where("n_shingles > 0").groupBy("component").agg(F.min(key).alias(key)).select(key)
    return _only(rows, key, linked.unionByName(found.where("n_shingles = 0").select(key)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the words that the mix takes. A document gives one row for each time it is taken; a row that is taken
    in part holds just those words, one space between them, and its n_chars."""
    return mixing.mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Byte-pair encoding and the column generation are not expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
