"""The splitting grid searches as aggregations.

Both methods need, for every window and delay, only the second moments of the two
horizontal components and of their delayed copies; the fast axis enters as arithmetic on
these. The moments come from running sums over each record and delay, read at the two ends
of each window, so a record's samples are visited once per delay and not once per window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Products of (x, y) and of the copies (u, w) delayed against them.
_SUMS = {"sx": ("x",), "sy": ("y",), "su": ("u",), "sw": ("w",), "xx": ("x", "x"), "yy": ("y", "y"), "xy": ("x", "y"), "uu": ("u", "u"), "ww": ("w", "w"), "uw": ("u", "w"), "xu": ("x", "u"), "xw": ("x", "w"), "yu": ("y", "u"), "yw": ("y", "w")}


#: Rows that a task hands on at once, and samples that it multiplies at once.
ROWS, SAMPLES = 32_768, 1_000_000


def _dense(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of so many values for each list, and which of them the lists hold; the others are 0."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    inside = np.arange(max(width, size.max(initial=0))) < size[:, None]
    values, held = np.zeros(inside.shape), np.zeros(inside.shape, bool)
    values[inside], held[inside] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), pc.is_valid(flat).to_numpy(zero_copy_only=False)
    return values[:, :width], held[:, :width]


def _ends(part: pa.RecordBatch, windows: list[dict], base: int, max_lag: int, beside: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """lagged_sums() of some records, a batch for each lag: running sums along the records, read at both ends of every window."""
    size = pc.list_value_length(part.column("x")).to_numpy(zero_copy_only=False)
    width = int(size.max())
    (x, x_held), (y, y_held) = _dense(part.column("x"), width), _dense(part.column("y"), width)
    inside = np.arange(width) < size[:, None]
    holes = bool((inside & ~(x_held & y_held)).any())
    first, last = (np.array([w[k] for w in windows]) - base for k in ("i0", "i1"))
    for lag in range(min(max_lag, width - 1) + 1):
        rest = width - lag
        at, k = np.nonzero((last <= (size - lag)[:, None]) & (last > first))
        values = {"x": x[:, :rest], "y": y[:, :rest], "u": x[:, lag:], "w": y[:, lag:]}
        held = {"x": x_held[:, :rest], "y": y_held[:, :rest], "u": x_held[:, lag:], "w": y_held[:, lag:]}
        columns = [part.column("rec").take(pa.array(at)), pa.array(np.array([w["window_idx"] for w in windows])[k], pa.int32()), pa.array(np.full(len(at), lag), pa.int32()), pa.array((last - first)[k], pa.int64())]
        run = np.zeros((len(part), rest + 1))
        with np.errstate(all="ignore"):
            for names in _SUMS.values():
                product, nothing = values[names[0]], None
                for other in names[1:]:
                    product = product * values[other]
                if holes:
                    # As in SQL: what lacks a factor is left out, and a sum of nothing is null.
                    there = np.logical_and.reduce([held[c] for c in names])
                    product = np.where(there, product, 0.0)
                    np.cumsum(there, axis=1, out=run[:, 1:])
                    nothing = run[at, last[k]] == run[at, first[k]]
                np.cumsum(product, axis=1, out=run[:, 1:])
                columns.append(pa.array(run[at, last[k]] - run[at, first[k]], mask=nothing))
        columns += [part.column(c).flatten().take(pa.array(at * len(windows) + k)) for c in beside]
        if len(at):
            yield pa.RecordBatch.from_arrays(columns, ["rec", "window_idx", "lag", "n", *_SUMS, *beside])


def lagged_sums(records: DataFrame, windows: DataFrame, max_lag: int, beside: tuple[str, ...] = ()) -> DataFrame:
    """(rec, window_idx, lag, n, sums): over each window, x and y (arrays of a record) with their copies lag samples later.

    windows: (window_idx, i0, i1), samples from i0 to before i1. A window whose delayed copy
    leaves the record has no row for that lag. Of a record only the samples that some window
    reaches are multiplied by the lags. ``beside`` names arrays of the records that hold a value for each
    window, in the order of window_idx: a row takes along that of its window, so that none has to be joined to the rows.

    Records are dealt out once, as single rows, and what multiplies them is made batch by batch: neither sorted nor kept.
    """
    lattice = windows.agg(F.min("i0").alias("_from"), (F.max("i1") + max_lag).alias("_to"), F.sort_array(F.collect_list(F.struct("window_idx", "i0", "i1"))).alias("_windows"))
    cut = lambda c: F.slice(c, F.col("_from") + 1, F.greatest(F.col("_to") - F.col("_from"), F.lit(0))).cast("array<double>").alias(c)
    records = records.select("rec", "x", "y", *beside).repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec")
    near = records.join(F.broadcast(lattice.filter("_from is not null"))).select("rec", cut("x"), cut("y"), "_from", "_windows", *beside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            windows, base = batch.column("_windows")[0].as_py(), batch.column("_from")[0].as_py()
            step = max(1, min(ROWS // len(windows), SAMPLES // int(pc.max(pc.list_value_length(batch.column("x"))).as_py())))
            for i in range(0, len(batch), step):
                yield from _ends(batch.slice(i, step), windows, base, max_lag, beside)

    kinds = dict(near.dtypes)
    made = [f"rec {kinds['rec']}", "window_idx int", "lag int", "n long", *[f"{k} double" for k in _SUMS], *[f"{c} {kinds[c].removeprefix('array<').removesuffix('>')}" for c in beside]]
    return near.filter((F.size("x") > 0) & F.col("y").isNotNull()).mapInArrow(run, ", ".join(made))


def moments(sums: DataFrame) -> DataFrame:
    """Sample variances and covariances from lagged_sums(); what came beside them stays."""
    cov = lambda p, a, b: ((F.col(p) - F.col(a) * F.col(b) / F.col("n")) / (F.col("n") - 1)).alias(f"c_{p}")
    pairs = {"xx": ("sx", "sx"), "yy": ("sy", "sy"), "xy": ("sx", "sy"), "uu": ("su", "su"), "ww": ("sw", "sw"), "uw": ("su", "sw"), "xu": ("sx", "su"), "xw": ("sx", "sw"), "yu": ("sy", "su"), "yw": ("sy", "sw")}
    known = {"rec", "window_idx", "lag", "n", *_SUMS}
    return sums.select("rec", "window_idx", "lag", "n", *[cov(p, *ab) for p, ab in pairs.items()], *[c for c in sums.columns if c not in known])


def rotated(m: DataFrame, prefix: str, angles: DataFrame) -> DataFrame:
    """Adds, for every angle (phi, c, s), the moments ff, ss and fs of the fast component and the delayed slow one.

    The product with the angles is only ever aggregated into whole numbers and doubles, in hash maps of a row for each
    window, so that neither a sort nor a shuffle sees it. Join what else is needed before the angles multiply the rows.
    """
    return m.crossJoin(F.broadcast(angles)).withColumns(turned(prefix))


def turned(prefix: str) -> dict[str, Column]:
    """ff, ss and fs at the axis whose cosine and sine are the columns c and s."""
    k = lambda p: F.col(f"{prefix}{p}")
    c, s = F.col("c"), F.col("s")
    ff = c * c * k("xx") + 2 * c * s * k("xy") + s * s * k("yy")
    ss = s * s * k("uu") - 2 * c * s * k("uw") + c * c * k("ww")
    fs = -c * s * k("xu") + c * c * k("xw") - s * s * k("yu") + c * s * k("yw")
    return {"ff": ff, "ss": ss, "fs": fs}


def angles(spark, first: int = -90, last: int = 90) -> DataFrame:
    """The trial axes, a degree apart: a table of fixed size. Both ends are the same axis, so that extents reach from one to the other."""
    phi = spark.range(first, last + 1).select(F.col("id").cast("int").alias("phi"))
    return phi.select("phi", F.cos(F.radians("phi")).alias("c"), F.sin(F.radians("phi")).alias("s"))


def ev_objective() -> Column:
    """Eigenvalue ratio; nearly negative values from rounding are 0, and a window without motion has none."""
    root = F.sqrt((F.col("ff") - F.col("ss")) * (F.col("ff") - F.col("ss")) + 4 * F.col("fs") * F.col("fs"))
    whole = F.col("ff") + F.col("ss") + root
    return F.when(whole > 0, F.greatest(F.try_divide(F.col("ff") + F.col("ss") - root, whole), F.lit(0.0)))


def rc_objective() -> Column:
    """Absolute correlation; none where a component does not move."""
    whole = F.sqrt(F.greatest(F.col("ff") * F.col("ss"), F.lit(0.0)))
    return F.when(whole > 0, F.try_divide(F.abs("fs"), whole))


#: Objectives are compared to nine decimals. A ratio, an axis and a lag make one whole number of so many bits for the last two.
DECIMALS, AXIS_BITS, LAG_BITS = 1e9, 8, 18
#: What stands for a ratio that is no number or missing, behind all others; no ratio exceeds 1 but by rounding, and half of this holds those that do.
UNKNOWN = 2 ** (62 - AXIS_BITS - LAG_BITS)
LARGEST = UNKNOWN / 2 / DECIMALS


def billionths(value: Column) -> Column:
    """An objective to nine decimals, as a whole number of billionths (a double)."""
    return F.rint(value * DECIMALS)


def _place() -> Column:
    return F.shiftleft((F.col("phi") + 90).cast("long"), LAG_BITS) + F.col("lag")


def _axis(place: Column) -> Column:
    return (F.shiftright(place, LAG_BITS).bitwiseAND(2**AXIS_BITS - 1) - 90).cast("int")


def _lag(place: Column) -> Column:
    return place.bitwiseAND(2**LAG_BITS - 1).cast("int")


def cell(ratio: Column) -> Column:
    """A ratio, its axis and its lag as one number: the least of these numbers is the best cell, in the order of ties. A missing ratio is no number."""
    held = F.when(ratio.isNull() | F.isnan(ratio), F.lit(UNKNOWN)).otherwise(billionths(F.greatest(F.least(ratio, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    return F.shiftleft(held, AXIS_BITS + LAG_BITS) + _place()


def opened(number: Column) -> tuple[Column, Column, Column]:
    """phi, lag and the ratio of a cell()."""
    value = F.shiftright(number, AXIS_BITS + LAG_BITS)
    return _axis(number), _lag(number), F.when(value == UNKNOWN, F.lit(float("nan"))).otherwise(value / DECIMALS)


def best(m: DataFrame, prefix: str, objective: Column, largest: bool = False) -> DataFrame:
    """(rec, window_idx, phi, lag, c): the best cell of a ratio; ties, to nine decimals, go to the first axis and then to the first delay."""
    found = rotated(m, prefix, angles(m.sparkSession)).groupBy("rec", "window_idx").agg(F.min(cell(-objective if largest else objective)).alias("b"))
    phi, lag, c = opened(F.col("b"))
    return found.select("rec", "window_idx", phi.alias("phi"), lag.alias("lag"), (-c if largest else c).alias("c"))


def least(m: DataFrame, prefix: str, objective: Column) -> DataFrame:
    """best() for an objective of any size: its least value first, then the first cell that has it."""
    spark, keys = m.sparkSession, ["rec", "window_idx"]
    value = billionths(objective)
    low = rotated(m, prefix, angles(spark)).groupBy(*keys).agg(F.min(value).alias("low"))
    found = rotated(m.join(low, keys), prefix, angles(spark)).groupBy(*keys).agg(F.min(F.when(value == F.col("low"), _place())).alias("b"), F.min("low").alias("low"))
    return found.select(*keys, _axis(F.col("b")).alias("phi"), _lag(F.col("b")).alias("lag"), (F.col("low") / DECIMALS).alias("c"))


def at_best(m: DataFrame, prefix: str, best: DataFrame) -> DataFrame:
    """The moments ff, ss and fs at each window's best axis and delay: (rec, window_idx, phi, lag) meets the moments, no other cell is made again."""
    at = m.join(best.select("rec", "window_idx", "lag", "phi"), ["rec", "window_idx", "lag"])
    return at.withColumns({"c": F.cos(F.radians("phi")), "s": F.sin(F.radians("phi"))}).withColumns(turned(prefix))


def extents(grid: DataFrame, **wanted: tuple[Column, str]) -> DataFrame:
    """(rec, window_idx, <name>_phi_err, <name>_lag_err): a quarter of the ranges of axes and delays with an objective up to a level column; null where there is none.

    The levels are columns of the grid: join them to the moments, before the axes multiply the rows.
    """
    made = []
    for name, (objective, level) in wanted.items():
        inside = billionths(objective) <= billionths(F.col(level))
        for c in ("phi", "lag"):
            at = F.when(inside, F.col(c))
            made.append(((F.max(at) - F.min(at)) / 4.0).alias(f"{name}_{c}_err"))
    return grid.groupBy("rec", "window_idx").agg(*made)


def bests(m: DataFrame, prefix: str) -> DataFrame:
    """(rec, window_idx) with ev_ and rc_ phi, lag and c: both methods' best cells in one pass over the grid."""
    found = rotated(m, prefix, angles(m.sparkSession)).groupBy("rec", "window_idx").agg(F.min(cell(ev_objective())).alias("e"), F.min(cell(-rc_objective())).alias("r"))
    e, r = opened(F.col("e")), opened(F.col("r"))
    return found.select("rec", "window_idx", *[v.alias(f"ev_{c}") for c, v in zip(("phi", "lag", "c"), e, strict=True)], *[v.alias(f"rc_{c}") for c, v in zip(("phi", "lag"), r, strict=False)], (-r[2]).alias("rc_c"))
