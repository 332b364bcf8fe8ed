"""Centroid clustering against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastaxis.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, `in.ertia` int"


def plain(rows, k, rounds):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, sha)] by whole numbers of Python."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    at = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        at = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)) if j in groups else c for j, c in enumerate(at)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    own = {}
    for _, c, d in found:
        own[c] = own.get(c, 0) + d
    return [(i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in found]


def vectors(n, seed=3):
    rnd = random.Random(seed)
    middle = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in middle[rnd.randrange(5)]]) for i in range(n)]
    rows += [(i, list(rows[7][1])) for i in range(n, n + 30)]  # one vector many times: ties
    rows += [rows[3], rows[3], (5, rows[9][1])]  # rows and ids again
    odd = [float("nan"), float("inf"), float("-inf"), None]
    rows += [(900 + j, [x, *rows[0][1][1:]]) for j, x in enumerate(odd)] + [(950, None), (951, []), (952, rows[0][1][:63]), (953, rows[0][1] * 2), (None, rows[2][1]), ((1 << 53) + 1, rows[4][1]), ((1 << 53) + 2, rows[4][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("k,rounds", [(7, 3), (1, 2), (40, 5), (500, 2)])
def test_equals_plain_python(spark, k, rounds):
    rows = vectors(150)
    got = centroids.cluster(frame(spark, rows), k=k, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows, k, rounds), key=repr)


def test_a_cluster_that_loses_all_vectors_stays():
    at = np.array([[0], [10], [10]])
    label, distance = centroids.nearest(np.array([[0], [9], [5], [20]]), at)
    assert label.tolist() == [0, 1, 0, 1] and distance.tolist() == [0, 1, 25, 100]


def test_negative_means_are_floored_and_empty_centroids_stay(spark):
    v = spark.createDataFrame([(1, [-1, 0]), (2, [-2, 1]), (3, [-2, 1])], "vec_id long, v array<int>")
    assert centroids.moved(v, np.array([[-2, 0], [90, 90]])).tolist() == [[-2, 0], [90, 90]]


def test_largest_values_are_exact(spark):
    far = float(centroids.LARGEST) / 256
    rows = [(1, [far] * 64), (2, [-far] * 64), (3, [far * 2] * 64)]
    got = {r.vec_id: r.distance for r in centroids.cluster(frame(spark, rows), k=1, rounds=0).collect()}
    assert sorted(got.values()) == [0, 64 * (2 * centroids.LARGEST) ** 2] and set(got) == {1, 2}


def test_empty(spark):
    for rows in ([], [(1, None)]):
        out = centroids.cluster(frame(spark, rows))
        assert out.count() == 0 and out.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]


def test_other_ids_and_doubles(spark):
    df = frame(spark, vectors(40)).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name.of"), F.col("embedding").cast("array<double>").alias("x"))
    out = centroids.cluster(df, "name.of", "x", k=3, rounds=1)
    assert out.schema["vec_id"].dataType.simpleString() == "string" and out.filter("vec_id = 'v9007199254740993'").count() == 1
