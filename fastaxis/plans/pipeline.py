"""The pick pipeline: records and windows in, one result per record out.

Every step is a DataFrame, so that Spark works over all picks, windows and delays at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastaxis.functions import geometry as g
from fastaxis.operators import clustering, grid, quality, waveform
from fastaxis.plans.cutting import cut


@dataclass(frozen=True)
class Settings:
    """What a measurement depends on; delays and windows are in samples."""

    rate: float = 100.0
    max_lag: int = 12
    gamma: float = 0.75
    omega1: float = 1 / 3
    omega2: float = 2 / 3
    linkage: str = "ward"
    k_max: int = 20
    n_min: int = 10
    ccrit: float = 3.2


def _spectral_freedom(signals: pd.Series) -> pd.Series:
    def together(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n < 2:
            return np.full(len(x), np.nan)
        p = np.abs(np.fft.fft(x, 1 << (n - 1).bit_length())) ** 2
        f2 = p.sum(axis=1) - (p[:, 0] - p[:, -1]) / 2
        f4 = 4 / 3 * (p**2).sum(axis=1) - (p[:, 0] ** 2 - p[:, -1] ** 2) / 3
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(f4 > 0, np.minimum(np.rint(2 * f2 * f2 / f4 - 1), n), np.nan)

    return pd.Series(waveform.stacked(signals.to_list(), together), index=signals.index, dtype=float)


def spectral_freedom(signals: Column) -> Column:
    """Degrees of freedom of each signal, from its spectrum over the next power of two."""
    return F.pandas_udf(_spectral_freedom, "double")(signals)


def corrected_transverse(records: DataFrame, best: DataFrame, windows: DataFrame) -> DataFrame:
    """(rec, window_idx, t): the transverse component of each window at its best axis and delay."""
    at = best.join(records, "rec").join(F.broadcast(windows), "window_idx")
    n = F.col("i1") - F.col("i0")
    cut = lambda c, lag: F.slice(c, F.col("i0") + 1 + lag, n)
    zipped = F.arrays_zip(cut("x", 0).alias("x"), cut("y", 0).alias("y"), cut("x", F.col("lag")).alias("u"), cut("y", F.col("lag")).alias("w"))
    at = at.select("rec", "window_idx", F.cos(F.radians("phi")).alias("c"), F.sin(F.radians("phi")).alias("s"), zipped.alias("z"))
    t = F.transform("z", lambda p: F.col("s") * (F.col("c") * p["x"] + F.col("s") * p["y"]) + F.col("c") * (F.col("c") * p["w"] - F.col("s") * p["u"]))
    return at.select("rec", "window_idx", t.alias("t"))


def by_window(values: DataFrame, windows: DataFrame, *columns: str) -> DataFrame:
    """(rec, columns): each column of (rec, window_idx, columns) as an array in the order of all window_idx, null where a window has no row."""
    order = F.broadcast(windows.agg(F.sort_array(F.collect_list("window_idx")).alias("_order")))
    held = values.groupBy("rec").agg(*[F.map_from_entries(F.collect_list(F.struct("window_idx", c))).alias(c) for c in columns])
    placed = lambda c: F.transform("_order", lambda i: F.element_at(c, i)).alias(c)
    return held.join(order).select("rec", *[placed(c) for c in columns])


def measured(records: DataFrame, windows: DataFrame, use: Settings = Settings()) -> DataFrame:
    """One row per record and window with both methods' axis, delay and errors, and the window's quality.

    records: (rec, x, y, back_azimuth), radial and transverse arrays; windows: (window_idx, i0, i1).
    """
    spark = records.sparkSession
    best = cut(grid.bests(grid.moments(grid.lagged_sums(records, windows, use.max_lag)), "c_"))
    freedom = corrected_transverse(records, best.select("rec", "window_idx", F.col("ev_phi").alias("phi"), F.col("ev_lag").alias("lag")), windows).select("rec", "window_idx", spectral_freedom(F.col("t")).alias("ndf"))
    n_cells = 181 * (use.max_lag + 1)
    levels = best.join(freedom, ["rec", "window_idx"]).select("rec", "window_idx", g.confidence_level(F.col("ev_c"), g.nan_to_null(F.col("ndf"))).alias("ev_level"), g.fisher_lower(F.col("rc_c"), F.lit(n_cells - 1)).alias("rc_level"))
    # A record's levels go with it into its sums: made again, these take less than to be kept and joined with the levels.
    marked = records.select("rec", "x", "y").join(by_window(levels, windows, "ev_level", "rc_level"), "rec")
    cells = grid.rotated(grid.moments(grid.lagged_sums(marked, windows, use.max_lag, ("ev_level", "rc_level"))), "c_", grid.angles(spark))
    both = best.join(grid.extents(cells, ev=(grid.ev_objective(), "ev_level"), rc=(grid.rc_objective(), "rc_level")), ["rec", "window_idx"], "left")
    both = both.join(records.select("rec", "back_azimuth"), "rec")
    seconds = lambda c: F.col(c) / use.rate
    wide = both.select("rec", F.col("window_idx").cast("long").alias("window_idx"), g.axial(F.col("ev_phi") + F.col("back_azimuth")).alias("phi"), seconds("ev_lag").alias("dt"), F.col("ev_phi_err").alias("phi_err"), seconds("ev_lag_err").alias("dt_err"), F.col("ev_c").alias("linearity"), g.axial(F.col("rc_phi") + F.col("back_azimuth")).alias("rc_phi"), seconds("rc_lag").alias("rc_dt"), F.col("rc_phi_err"), seconds("rc_lag_err").alias("rc_dt_err"), F.col("rc_c").alias("cc"))
    errors = [F.col(c).isNotNull() for c in ("phi_err", "dt_err", "rc_phi_err", "rc_dt_err")]
    q = quality.window_quality(wide, use.gamma)
    return q.withColumn("qwin", F.when(errors[0] & errors[1] & errors[2] & errors[3], F.col("qwin")))


def clustered(measures: DataFrame, use: Settings = Settings()) -> DataFrame:
    """(rec, window_idx, chosen windows' cluster, n_clusters): the windows of each record's best cluster, and which is best.

    Records with fewer than three windows with errors have none.
    """
    valid = measures.filter("phi_err is not null and dt_err is not null")
    enough = valid.groupBy("rec").agg(F.count("*").alias("_n")).filter("_n >= 3").select("rec")
    z = clustering.scaled(valid.join(enough, "rec"), {"dt": "x", "phi": "y", "dt_err": "ex", "phi_err": "ey"}, "rec")
    z = cut(z)
    labels = cut(clustering.cuts(z, "x", "y", use.k_max, use.linkage, by="rec"))
    tagged = labels.join(z, ["rec", "window_idx"]).withColumn("rk", F.col("rec") * 1000 + F.col("k"))
    moments = clustering.cluster_moments(tagged, ["rk", "cluster"], "x", "y")
    met = clustering.duda_hart(moments, "rk").groupBy("rk").agg(F.min("score").alias("score"))
    limit = met.filter(F.col("score") <= use.ccrit).select(F.floor(F.col("rk") / 1000).alias("rec"), (F.col("rk") % 1000).alias("k")).groupBy("rec").agg(F.min("k").alias("k_limit"))
    scores = clustering.calinski_harabasz(moments, "rk").select(F.floor(F.col("rk") / 1000).alias("rec"), (F.col("rk") % 1000).alias("k"), F.coalesce("score", F.lit(0.0)).alias("score"))
    allowed = scores.join(limit, "rec", "left").filter(F.col("k") <= F.least(F.coalesce("k_limit", F.lit(use.k_max)), F.lit(use.k_max)))
    k = allowed.groupBy("rec").agg(F.min(F.struct(F.round(-F.col("score"), 9).alias("s"), "k")).alias("b")).select("rec", F.when(F.col("b.s") < 0, F.col("b.k")).otherwise(F.lit(1)).alias("n_clusters"))
    placed = z.join(k, "rec").join(labels, ["rec", "window_idx"], "left").filter((F.col("k") == F.col("n_clusters")) | (F.col("n_clusters") == 1)).withColumn("cluster", F.when(F.col("n_clusters") == 1, F.lit(0)).otherwise(F.col("cluster"))).dropDuplicates(["rec", "window_idx"])
    placed = cut(placed)
    variances = clustering.cluster_variances(placed, ["rec", "cluster"], "x", "y", "ex", "ey")
    chosen = clustering.chosen_cluster(variances, use.n_min, "rec")
    inside = placed.join(chosen, ["rec", "cluster"], "left_semi")
    best = clustering.best_measurement(inside, F.col("ex") + F.col("ey"), "rec").withColumnRenamed("window_idx", "best_window")
    size = inside.groupBy("rec").agg(F.count("*").alias("n_in_cluster"))
    return inside.select("rec", "window_idx", "n_clusters").join(best, "rec").join(size, "rec")


def results(records: DataFrame, windows: DataFrame, use: Settings = Settings()) -> DataFrame:
    """One row per record: the best window's measurement, the quality, and an error where there is none."""
    records = cut(records)
    m = cut(measured(records, windows, use))
    c = cut(clustered(m, use))
    graded = quality.event_quality(m.join(c.select("rec", "window_idx"), ["rec", "window_idx"], "left_semi"), use.gamma, use.omega1, use.omega2, by="rec")
    best = c.filter("window_idx = best_window").join(m, ["rec", "window_idx"])
    wide = records.select("rec").join(best, "rec", "left").join(graded.drop("delta", "omega"), "rec", "left")
    return wide.select(
        "rec",
        F.col("phi").alias("ev_phi"),
        (F.col("dt") * 1000).alias("ev_dt_ms"),
        F.col("phi_err").alias("ev_phi_err"),
        (F.col("dt_err") * 1000).alias("ev_dt_err_ms"),
        F.col("linearity").alias("ev_linearity"),
        "rc_phi",
        (F.col("rc_dt") * 1000).alias("rc_dt_ms"),
        F.col("cc").alias("rc_cc_fs"),
        "qmean",
        "qbest",
        "qfinal",
        "quality_class",
        "n_clusters",
        "n_in_cluster",
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_cluster_windows"),
        F.when(F.col("phi").isNull(), F.lit("no valid cluster")).alias("error"),
    )
