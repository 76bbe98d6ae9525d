"""Clusters of embeddings by plain Lloyd rounds over integer vectors.

Components are scaled to integers once and written. In each round every task is sent
the centroids (``clusters`` x ``dim`` integers, whatever the size of the input), finds
the nearest one of each vector and returns one row of sums for each centroid; those are
added up by a groupBy. All arithmetic is on integers, so the result is the same
whatever the partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import discard, materialise

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
_MOST = (1 << 63) - 1


def limit(dim: int) -> int:
    """The largest component whose squared distances still fit in 64 bits."""
    return isqrt(_MOST // dim) // 2


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, x (integers) of the vectors with ``dim`` components, none null, infinite
    or not a number."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    most = limit(dim)
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    return vectors.where(x.isNotNull() & (F.size(x) == dim) & ~bad).select(F.col(id_col).alias("vec_id"), whole.alias("x"))


def first_centroids(x: DataFrame, *, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the least SHA-256 of seed:vec_id, in that order (ties: by their
    components). A top ``clusters``: so many rows reach the driver."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in x.orderBy(digest, "x").select("x").limit(clusters).collect()], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (ties: the smallest), and the
    squared distance to it."""
    found = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        found[:, k] = np.einsum("ij,ij->i", d, d)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(x)), best]


def _stacked(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).reshape(-1, dim).astype(np.int64) if len(column) else np.zeros((0, dim), np.int64)


def _sums(centroids: np.ndarray):
    k, dim = centroids.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, many = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for frame in frames:
            x = _stacked(frame["x"], dim)
            best, _ = nearest(x, centroids)
            many += np.bincount(best, minlength=k)
            for j in np.unique(best):
                sums[j] += x[best == j].sum(axis=0)
        held = np.flatnonzero(many)
        yield pd.DataFrame({"cluster": held.astype(np.int32), "n": many[held], **{f"s{i}": sums[held, i] for i in range(dim)}})

    return run


def _assigned(centroids: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best, distance = nearest(_stacked(frame["x"], centroids.shape[1]), centroids)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": best.astype(np.int32), "distance": distance})

    return run


def moved(x: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid becomes the floor of the mean of its vectors; one
    without vectors stays. At most one row for each centroid reaches the driver."""
    k, dim = centroids.shape
    columns = [f"s{i}" for i in range(dim)]
    parts = x.select("x").mapInPandas(_sums(centroids), "cluster int, n long, " + ", ".join(f"{c} long" for c in columns))
    # Sums over all partitions are added as decimals: these don't overflow.
    total = parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *columns)])
    out = centroids.copy()
    for r in total.collect():
        out[r.cluster] = [int(r[c]) // int(r.n) for c in columns]
    return out


def clusters_of(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Return per kept vector: vec_id, cluster, distance (squared, of the scaled
    integers), cluster_inertia, inertia, centroid_sha256.

    * vectors that are null, of another length, or with a component that is null,
      infinite or not a number are left out
    * with fewer kept vectors than ``clusters``, each is a centroid at the start; with
      none, the result is empty
    * a null id hashes as an empty one; repeated ids are vectors of their own, those
      with equal hashes start in the order of their components; equal centroids leave
      the later ones without vectors, where they stay
    * components beyond ``limit(dim)`` after scaling (about 10**8) count as that limit
      and inertias beyond 64 bits as the largest 64-bit integer
    * other columns are ignored
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType
    x = materialise(quantised(vectors, id_col=id_col, vector_col=vector_col, dim=dim, scale=scale), "centroids-vectors")
    centres = first_centroids(x, clusters=clusters, seed=seed)
    schema = "vec_id string, cluster int, distance long"
    if not len(centres):
        discard(x)
        empty = spark.createDataFrame([], schema).withColumn("vec_id", F.col("vec_id").cast(kind))
        return empty.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centres = moved(x, centres)
    # Ids travel as strings: pandas has no null in a column of integers.
    named = x.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(_assigned(centres), schema)
    found = materialise(named, "centroids-assigned")
    discard(x)
    sums = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(sum(sums.values()), _MOST)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    # One row for each centroid.
    facts = spark.createDataFrame([(k, min(d, _MOST), whole, digest(centres[k].tolist())) for k, d in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("vec_id").cast(kind).alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
