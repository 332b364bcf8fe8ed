"""The lattice of analysis windows, and the ranking of filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trial bands in Hz (fixed values; one band stands twice, as in the published practice this follows).
FILTER_BANK = [(0.4, 4.0), (0.5, 5.0), (0.2, 7.5), (0.3, 3.0), (0.5, 4.0), (0.6, 3.0), (0.8, 6.0), (1.0, 3.0), (0.5, 2.5), (1.0, 8.0), (2.0, 3.0), (2.0, 6.0), (3.0, 8.0), (4.0, 10.0), (1.0, 10.0), (1.0, 20.0), (1.0, 8.0), (0.5, 10.0), (0.5, 20.0), (0.5, 8.0)]


def lattice(spark: SparkSession, pick: float = 0.0, max_delay: float = 0.4, tbeg0: float = -0.5, tbeg1: float = -0.1, tend0: float = 0.1, tend1: float = 0.4, dtbeg: float = 0.05, dtend: float = 0.01, nbeg: int = 10, nend: int = 20) -> DataFrame:
    """(window_idx, t0, t1) by length: starts going back from tbeg1, ends going on from tend0, longer than the largest delay."""
    a = spark.range(nbeg).select(F.col("id").alias("a"))
    b = spark.range(nend).select(F.col("id").alias("b"))
    t0, t1 = tbeg1 - F.col("a") * dtbeg, tend0 + F.col("b") * dtend
    near = 1e-9
    kept = a.crossJoin(b).select("a", "b", t0.alias("t0"), t1.alias("t1")).filter((F.col("t0") >= tbeg0 - near) & (F.col("t1") <= tend1 + near) & (F.col("t1") - F.col("t0") > max_delay + 1e-6))
    order = Window.orderBy(F.round(F.col("t1") - F.col("t0"), 9), "a", "b")
    return kept.select((F.row_number().over(order) - 1).cast("int").alias("window_idx"), (F.col("t0") + pick).alias("t0"), (F.col("t1") + pick).alias("t1"))


def sample_windows(spark: SparkSession, arrival: int = 24, starts: int = 5, ends: int = 4) -> DataFrame:
    """(window_idx, i0, i1): a lattice in whole samples around an arrival."""
    a, b = spark.range(starts).select(F.col("id").alias("a")), spark.range(ends).select(F.col("id").alias("b"))
    return a.crossJoin(b).select((F.col("a") * ends + F.col("b")).cast("int").alias("window_idx"), (arrival - (4 + 2 * F.col("a"))).cast("int").alias("i0"), (arrival + 12 + 4 * F.col("b")).cast("int").alias("i1"))


def truncated(seconds: Column, rate: Column) -> Column:
    """A time as a sample number, cut off toward zero."""
    return (seconds * rate).cast("int")


def bank(spark: SparkSession, bands=FILTER_BANK) -> DataFrame:
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(bands)], "bank_idx int, low double, high double")


def usable(bands: DataFrame, rate: float) -> DataFrame:
    """Bands that end below nine tenths of the Nyquist frequency."""
    return bands.filter(F.col("high") < 0.9 * rate / 2)


def ranked(candidates: DataFrame, snr_min: float, best: int | None = None, by: str = "pick") -> DataFrame:
    """Bands by snr times octaves, of those whose snr passes; the first ``best`` of each pick."""
    score = F.col("snr") * F.log2(F.col("high") / F.col("low"))
    passed = candidates.withColumn("score", F.round(score, 9)).filter(F.col("snr") >= snr_min)
    out = passed.withColumn("filter_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "bank_idx")).cast("int"))
    return out if best is None else out.filter(F.col("filter_rank") <= best)
