"""Quality of an event's measurement, and consensus over filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.functions import geometry as g


def window_quality(measures: DataFrame, gamma: float) -> DataFrame:
    """Adds qwin, delta, omega and class of each window that both methods measured."""
    q = g.quality_index(F.col("rc_phi"), F.col("rc_dt"), F.col("phi"), F.col("dt"), gamma)
    both = F.col("phi").isNotNull() & F.col("rc_phi").isNotNull()
    return measures.withColumn("_q", F.when(both, q)).select(*measures.columns, F.col("_q.q").alias("qwin"), F.col("_q.delta").alias("delta"), F.col("_q.omega").alias("omega"), F.col("_q.class").alias("class"))


def event_quality(windows: DataFrame, gamma: float, omega1: float = 1 / 3, omega2: float = 2 / 3, by: str = "grp") -> DataFrame:
    """(by, qmean, qbest, qfinal, delta, omega, quality_class, n_windows) over the windows of the chosen cluster.

    The best window is that of the largest |qwin|, the first on a tie; the class is that of the
    weighted mean of mean and best. Without a window quality there is none of the event.
    """
    order = F.struct(F.round(-F.abs("qwin"), 9).alias("a"), F.col("window_idx"), F.col("qwin"), F.col("delta"), F.col("omega"))
    found = windows.filter("qwin is not null").groupBy(by).agg(F.avg("qwin").alias("qmean"), F.min(order).alias("b"), F.count("*").alias("n_windows"))
    final = omega1 * F.col("qmean") + omega2 * F.col("b.qwin")
    return found.select(by, "qmean", F.col("b.qwin").alias("qbest"), final.alias("qfinal"), F.col("b.delta").alias("delta"), F.col("b.omega").alias("omega"), g.quality_class(F.round(final, 9), gamma).alias("quality_class"), "n_windows")


def consensus(results: DataFrame, phi_tolerance: float = 15.0, dt_tolerance: float = 0.02, by: str = "grp", rank: str = "window_idx") -> DataFrame:
    """(by, phi, dt, phi_err, dt_err, n_used): the plain mean of what agrees with the first result.

    An angular difference is folded only beyond 90 degrees; tolerances are inclusive; errors
    are root mean squares.
    """
    first = results.groupBy(by).agg(F.min_by(F.struct("phi", "dt"), rank).alias("a"))
    apart = F.abs(F.col("phi") - F.col("a.phi"))
    apart = F.when(apart > 90, 180 - apart).otherwise(apart)
    near = results.join(first, by).filter((F.round(apart, 9) <= phi_tolerance) & (F.round(F.abs(F.col("dt") - F.col("a.dt")), 9) <= dt_tolerance))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return near.groupBy(by).agg(F.avg("phi").alias("phi"), F.avg("dt").alias("dt"), rms("phi_err").alias("phi_err"), rms("dt_err").alias("dt_err"), F.count("*").alias("n_used"))
