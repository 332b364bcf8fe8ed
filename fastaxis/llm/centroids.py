"""Centroid clustering: plain Lloyd rounds over vectors of whole numbers.

A round is one pass: the centroids are broadcast (k rows of a fixed number of components), each
partition assigns its batches by integer squared differences and hands on one row of counts and
sums for every cluster it met, and a groupBy adds those up. Everything is exact, so that neither
the partitioning nor a task that runs again can change a result. The driver holds k centroids.

Defined results: vectors that are null, have another number of components, or a component that is
null, not finite or beyond LARGEST in its whole form (whose squared distances would not fit a
long) are left out; rows of one id are vectors of their own; a vector without an id is clustered,
and starts a cluster only where too few others do; with fewer vectors than k, each starts a
cluster; an empty table gives no rows. Only the two named columns are read, so further columns
don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.llm.common import remove, written

#: Components of a vector, their scale, clusters, rounds, and the number before the colon of what is hashed for the start.
DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Beyond this, 64 squared differences might not fit 63 bits.
LARGEST = 1 << 27
#: Vectors whose differences NumPy holds at once.
BLOCK = 4096


def whole_vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors, each component x as floor(scale * x) of x as a double."""
    x = F.col(f"`{column}`").cast("array<double>")
    kept = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / scale))
    return df.filter(kept).select(F.col(f"`{id_column}`").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hexadecimal sha256 of ``seed:id``, in the order of the hashes; repeated ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the smaller number of equal ones, and the squared distance to it."""
    label, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK]
        squares = np.empty((len(part), len(centroids)), np.int64)
        for k, c in enumerate(centroids):
            d = part - c
            squares[:, k] = np.einsum("ij,ij->i", d, d)
        best = squares.argmin(axis=1)
        label[lo : lo + BLOCK], distance[lo : lo + BLOCK] = best, squares[np.arange(len(part)), best]
    return label, distance


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _sums(centroids) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A partition's counts and sums, one row for each cluster it met."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = centroids.value
        count, total = np.zeros(len(at), np.int64), np.zeros(at.shape, np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["v"])
            label, _ = nearest(x, at)
            order = np.argsort(label, kind="stable")
            met, first = np.unique(label[order], return_index=True)
            total[met] += np.add.reduceat(x[order], first, axis=0)
            count[met] += np.diff(np.append(first, len(order)))
        met = np.flatnonzero(count)
        if len(met):
            yield pd.DataFrame({"cluster": met.astype(np.int32), "n": count[met], "total": list(total[met])})

    return run


def _assignments(centroids) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                label, distance = nearest(_matrix(pdf["v"]), centroids.value)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": label.astype(np.int32), "distance": distance})

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of their vectors' means; one without vectors stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    parts = vectors.select("v").mapInPandas(_sums(shared), "cluster int, n long, total array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]).collect()
    shared.unpersist()
    out = centroids.copy()
    for r in merged:
        out[r.cluster] = [s // r.n for s in r[2:]]
    return out


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after all rounds."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    The whole vectors are written once, in a fraction of the floats' bytes, and read by each
    round; so are the last assignments, which the sums over clusters and the result both read.
    """
    vectors = written(whole_vectors(df, id_column, column, dimensions, scale), "vectors")
    kind = vectors.schema["vec_id"].dataType
    centroids = fit(vectors, k, rounds, seed)
    if not len(centroids):
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    # Ids travel as text: pandas holds a column of longs with nulls as floats.
    named = vectors.select(F.col("vec_id").cast("string").alias("vec_id"), "v")
    found = written(named.mapInPandas(_assignments(shared), "vec_id string, cluster int, distance long").withColumn("vec_id", F.col("vec_id").cast(kind)), "clusters")
    remove(vectors)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    own = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))])
    names = F.array(*[F.lit(digest(c)) for c in centroids])
    return found.select("vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"))
