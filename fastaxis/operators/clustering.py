"""Cluster analysis of window measurements: scaling, dendrogram, criteria, selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scaled(df: DataFrame, columns: dict[str, str], by: str = "grp") -> DataFrame:
    """Adds each column divided by its range within the group, under the new name; 1 where all are equal."""
    w = Window.partitionBy(by)
    out = {}
    for name, new in columns.items():
        span = F.max(name).over(w) - F.min(name).over(w)
        out[new] = F.when(span > 0, F.col(name) / span).otherwise(F.lit(1.0))
    return df.withColumns(out)


def cluster_moments(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Counts, sums and sums of squares of clusters: mergeable, so that pairs of clusters need no rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col(c)).alias(f"s{k}") for k, c in (("x", x), ("y", y))], F.sum(F.col(x) * F.col(x) + F.col(y) * F.col(y)).alias("q"))


def within(n: Column, sx: Column, sy: Column, q: Column) -> Column:
    """Sum of squares about the mean, from moments."""
    return q - (sx * sx + sy * sy) / n


def duda_hart(moments: DataFrame, by: str = "grp", cluster: str = "cluster") -> DataFrame:
    """(by, cluster, cluster2, score) of each pair of clusters: how much two clusters explain that one would not.

    A score up to the critical value says that the two are not worth telling apart.
    """
    a = moments.select(by, *[F.col(c).alias(f"{c}1") for c in (cluster, "n", "sx", "sy", "q")])
    b = moments.select(by, *[F.col(c).alias(f"{c}2") for c in (cluster, "n", "sx", "sy", "q")])
    pairs = a.join(b, by).filter(F.col(f"{cluster}1") < F.col(f"{cluster}2"))
    size = moments.groupBy(by).agg(F.sum("n").alias("n_all"))
    s22 = within(*[F.col(f"{c}1") for c in ("n", "sx", "sy", "q")]) + within(*[F.col(f"{c}2") for c in ("n", "sx", "sy", "q")])
    s21 = within(*[F.col(f"{c}1") + F.col(f"{c}2") for c in ("n", "sx", "sy", "q")])
    score = F.when(s21 > 0, (1 - s22 / s21 - 1 / math.pi) * F.sqrt(F.col("n_all") / (1 - 4 / math.pi**2)))
    return pairs.join(size, by).select(by, F.col(f"{cluster}1").alias("cluster"), F.col(f"{cluster}2").alias("cluster2"), score.alias("score"))


def calinski_harabasz(moments: DataFrame, by: str = "grp") -> DataFrame:
    """(by, score): spread between clusters over spread within, each by its degrees of freedom."""
    t = moments.groupBy(by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), F.sum("q").alias("q"), F.sum(within(F.col("n"), F.col("sx"), F.col("sy"), F.col("q"))).alias("inside"))
    between = within(F.col("n"), F.col("sx"), F.col("sy"), F.col("q")) - F.col("inside")
    return t.select(by, F.when((F.col("k") > 1) & (F.col("inside") > 1e-12) & (F.col("n") > F.col("k")), between / (F.col("k") - 1) / (F.col("inside") / (F.col("n") - F.col("k")))).alias("score"))


def cluster_variances(df: DataFrame, keys: list[str], x: str, y: str, ex: str, ey: str) -> DataFrame:
    """(keys, n, inside, data, overall): variance about the mean, variance pooled from errors, and the larger.

    Errors of zero have no weight; without any weight the pooled variance is infinite.
    """
    weight = lambda e: F.sum(F.when(F.col(e) > 0, 1 / (F.col(e) * F.col(e))).otherwise(F.lit(0.0)))
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.var_pop(x) + F.var_pop(y)).alias("inside"), weight(ex).alias("wx"), weight(ey).alias("wy"))
    infinite = F.lit(float("inf"))
    inverse = lambda w: F.when(F.col(w) > 0, 1 / F.when(F.col(w) > 0, F.col(w))).otherwise(infinite)
    data = inverse("wx") + inverse("wy")
    return g.select(*keys, "n", "inside", data.alias("data"), F.greatest("inside", data).alias("overall"))


def chosen_cluster(variances: DataFrame, n_min: int, by: str = "grp", cluster: str = "cluster") -> DataFrame:
    """The cluster of least overall variance among those of n_min rows or more, or among all if there is none; ties go to the lowest number."""
    big = F.col("n") >= n_min
    w = Window.partitionBy(by)
    allowed = variances.withColumn("_any", F.max(big).over(w)).filter(big | ~F.col("_any"))
    return allowed.groupBy(by).agg(F.min(F.struct(F.round("overall", 9).alias("v"), F.col(cluster)))[cluster].alias(cluster))


def best_measurement(df: DataFrame, error: Column, by: str = "grp") -> DataFrame:
    """(by, window_idx) of the least error; ties go to the first window."""
    return df.groupBy(by).agg(F.min(F.struct(F.round(error, 9).alias("e"), F.col("window_idx")))["window_idx"].alias("window_idx"))


LINKAGES = ("ward", "single", "complete", "average")


def dendrogram(points: np.ndarray, linkage: str = "ward") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) in order of distance, by nearest-neighbour chains; the points are 0 to n - 1, merge i is n + i."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {', '.join(LINKAGES)}")
    n = len(points)
    d = ((points[:, None] - points[None]) ** 2).sum(-1)
    if linkage != "ward":
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = sorted((a, b))
        da, db, dab = d[a].copy(), d[b].copy(), d[a, b]
        if linkage == "ward":
            new = ((size[a] + size) * da + (size[b] + size) * db - size * dab) / (size[a] + size[b] + size)
        elif linkage == "single":
            new = np.minimum(da, db)
        elif linkage == "complete":
            new = np.maximum(da, db)
        else:
            new = (size[a] * da + size[b] * db) / (size[a] + size[b])
        merges.append((a, b, float(dab), int(size[a] + size[b])))
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        alive[b], size[a] = False, size[a] + size[b]
    order = sorted(range(len(merges)), key=lambda i: (merges[i][2], i))
    # Slots become cluster numbers in the order of distance.
    name, out, parent = list(range(n)), [], {}
    find = lambda i: i if i not in parent else find(parent[i])
    for k, i in enumerate(order):
        a, b, dist, _ = merges[i]
        ra, rb = find(a), find(b)
        na, nb = name[ra], name[rb]
        parent[rb] = ra
        name[ra] = n + k
        out.append((na, nb, dist, 0))
    sizes = [1] * n
    for k, (a, b, dist, _) in enumerate(out):
        sizes.append(sizes[a] + sizes[b])
        out[k] = (a, b, dist, sizes[-1])
    return out


def dendrograms(points: np.ndarray, linkage: str = "ward") -> tuple[np.ndarray, np.ndarray]:
    """dendrogram() of many groups of n points each, (groups, n, 2): their chains take a step at a time together.

    (pairs, distances) in order of distance: pairs (groups, n - 1, 2) are a point of either cluster, distances (groups, n - 1).
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {', '.join(LINKAGES)}")
    g, n = points.shape[:2]
    d = ((points[:, :, None] - points[:, None]) ** 2).sum(-1)
    if linkage != "ward":
        d = np.sqrt(d)
    # The diagonal is infinite, and so are the distances to what is merged away, once ``gone`` is added.
    d[:, np.arange(n), np.arange(n)] = np.inf
    flat, rows, down = d.reshape(-1), d.reshape(g * n, n), np.arange(n) * n
    size, gone = np.ones((g, n)), np.zeros((g, n))
    chain, length, made = np.zeros((g, n + 1), int), np.zeros(g, int), np.zeros(g, int)
    pairs, heights = np.zeros((g, max(n - 1, 0), 2), int), np.zeros((g, max(n - 1, 0)))
    busy = np.arange(g) if n > 1 else np.arange(0)
    while len(busy):
        empty = busy[length[busy] == 0]
        chain[empty, 0], length[empty] = gone[empty].argmin(1), 1
        last = chain[busy, length[busy] - 1]
        row = rows.take(busy * n + last, axis=0)
        row += gone.take(busy, axis=0)
        near = row.argmin(1)
        before = chain[busy, np.maximum(length[busy] - 2, 0)]
        at = np.arange(len(busy))
        back = (length[busy] > 1) & (row[at, before] <= row[at, near])
        on = busy[~back]
        chain[on, length[on]] = near[~back]
        length[on] += 1
        q = busy[back]
        if len(q):
            a, b = np.minimum(last[back], before[back]), np.maximum(last[back], before[back])
            da, db, own = rows.take(q * n + a, axis=0), rows.take(q * n + b, axis=0), size.take(q, axis=0)
            dab, sa, sb = d[q, a, b][:, None], size[q, a][:, None], size[q, b][:, None]
            if linkage == "ward":
                new = ((sa + own) * da + (sb + own) * db - own * dab) / (sa + sb + own)
            elif linkage == "single":
                new = np.minimum(da, db)
            elif linkage == "complete":
                new = np.maximum(da, db)
            else:
                new = (sa * da + sb * db) / (sa + sb)
            gone[q, b] = np.inf
            new[np.arange(len(q)), a] = np.inf
            rows[q * n + a] = new
            flat[(q * (n * n) + a)[:, None] + down] = new
            pairs[q, made[q]], heights[q, made[q]] = np.stack([a, b], 1), dab[:, 0]
            size[q, a] += size[q, b]
            length[q] -= 2
            made[q] += 1
            busy = busy[made[busy] < n - 1]
    order = np.argsort(heights, axis=1, kind="stable")
    return np.take_along_axis(pairs, order[..., None], 1), np.take_along_axis(heights, order, 1)


def labels_of_cuts(pairs: np.ndarray, k_max: int) -> dict[int, np.ndarray]:
    """For each k from 2 to k_max, or to n: labels (groups, n) of the cut into k clusters of dendrograms(), numbered by their first point."""
    g, n = pairs.shape[0], pairs.shape[1] + 1
    root, at, out = np.tile(np.arange(n), (g, 1)), np.arange(g), {}
    for k in range(n, 1, -1):
        if k <= k_max:
            # A cluster's root is its first point: the roots that came before are its number.
            first = root == np.arange(n)
            out[k] = np.take_along_axis(np.cumsum(first, axis=1) - 1, root, 1)
        one, two = root[at, pairs[:, n - k, 0]], root[at, pairs[:, n - k, 1]]
        root = np.where(root == np.maximum(one, two)[:, None], np.minimum(one, two)[:, None], root)
    return dict(sorted(out.items()))


def cut_labels(n: int, merges: list[tuple[int, int, float, int]], k: int) -> np.ndarray:
    """Labels 0 to k - 1 of the cut into k clusters, numbered by their first point."""
    parent = list(range(2 * n - 1))
    for i, (a, b, _, _) in enumerate(merges[: n - k]):
        parent[a] = parent[b] = n + i
    root = np.arange(n)
    for p in range(n):
        r = p
        while parent[r] != r:
            r = parent[r]
        root[p] = r
    _, first, label = np.unique(root, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[label]


#: Matrix elements of the distances of the groups that are merged at once.
TOGETHER = 1_000_000


def cuts(df: DataFrame, x: str, y: str, k_max: int, linkage: str = "ward", by: str = "grp") -> DataFrame:
    """(by, k, window_idx, cluster): the cuts of each group's one dendrogram into 2 to k_max clusters.

    A dendrogram is quadratic in a group's rows and can't be shared out; groups are the windows of
    one pick and filter, whose number the window lattice bounds. A task takes its groups as they come in batches, many at a
    time; a window function puts the rows of a group together and numbers them.
    """

    def placed(keys: np.ndarray, index: np.ndarray, xy: np.ndarray, begins: np.ndarray) -> Iterator[pd.DataFrame]:
        sizes = np.diff(begins)
        for n in np.unique(sizes[sizes > 1]):
            starts = begins[:-1][sizes == n]
            step = max(1, TOGETHER // int(n * n))
            for some in (starts[i : i + step] for i in range(0, len(starts), step)):
                rows = some[:, None] + np.arange(n)
                for k, label in labels_of_cuts(dendrograms(xy[rows], linkage)[0], k_max).items():
                    yield pd.DataFrame({by: keys[rows.ravel()], "k": k, "window_idx": index[rows.ravel()], "cluster": label.ravel()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            starts = np.flatnonzero(pdf["_place"].to_numpy() == 1)
            # The last group of a batch may go on in the next one.
            rest = pdf.iloc[starts[-1] :]
            yield from placed(pdf[by].to_numpy(), pdf["window_idx"].to_numpy(), pdf[[x, y]].to_numpy(float), starts)
        if rest is not None:
            yield from placed(rest[by].to_numpy(), rest["window_idx"].to_numpy(), rest[[x, y]].to_numpy(float), np.array([0, len(rest)]))

    kind = dict(df.dtypes)[by]
    together = df.select(by, "window_idx", x, y).withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy("window_idx")))
    return together.mapInPandas(run, f"{by} {kind}, k long, window_idx long, cluster long")
