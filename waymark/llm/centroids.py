"""Operator 12: plain Lloyd clustering of vectors in whole numbers.

Each round sends the centroids (`k` rows of `size` integers) to every task; mapInPandas takes the squared differences to one
centroid after the other in NumPy, argmin gives the nearest (the lowest number on a tie), and each partition yields one row
of integer sums for each of its clusters. groupBy adds those rows; only `k` sums come to the driver, where they are divided.
All arithmetic is exact, so neither the dealing of the rows nor a lost executor changes a result.

Kept are vectors of exactly `size` components, none null, NaN or infinite; others give no row. A component x becomes
floor(`SCALE` * x). Vectors with a component beyond +-`RANGE` after that are left out too: the distance would not fit a long.
Vectors of one id count one by one, in order of components where their hashes tie; a null id hashes as the empty text. With
fewer than `k` vectors each is a centroid; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, RANGE = 1024, 1 << 27


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64) -> DataFrame:
    """vec_id and `v`, the whole-number components, of the vectors that are kept."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    sound = (F.size(vector_col) == size) & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < RANGE))
    return vectors.where(sound).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda c: c.cast("int")).alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector, and the squared distance."""
    far = np.stack([np.square(v - c).sum(axis=1) for c in centroids], axis=1)
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(v)), cluster]


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["v"].to_numpy()).astype(np.int64)


def _sums(centroids: np.ndarray):
    """One row for each cluster that a partition has: cluster, n, s0, s1, ..."""
    k, size = centroids.shape

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for part in parts:
            if len(part):
                v = _matrix(part)
                cluster, _ = nearest(v, centroids)
                np.add.at(total, cluster, v)
                n += np.bincount(cluster, minlength=k)
        found = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": found, "n": n[found], **{f"s{j}": total[found, j] for j in range(size)}})

    return run


def _assigned(centroids: np.ndarray):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                cluster, distance = nearest(_matrix(part), centroids)
                yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance})

    return run


def start(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k kept vectors with the smallest SHA-256 of seed and id, in ascending order."""
    text = F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.withColumn("h", F.sha2(text.cast("binary"), 256)).orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means; a centroid without vectors stays."""
    sums = [f"s{j}" for j in range(centroids.shape[1])]
    parts = kept.mapInPandas(_sums(centroids), "cluster int, n long, " + ", ".join(f"{s} long" for s in sums))
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *sums))).collect():  # k rows
        out[r.cluster] = [int(r[s]) // int(r.n) for s in sums]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3:", size: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    kept = stored(whole_vectors(vectors, size=size), "vectors")
    id_type = kept.schema["vec_id"].dataType.simpleString()
    centroids = start(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    rows = stored(kept.mapInPandas(_assigned(centroids), f"vec_id {id_type}, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    return rows.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
