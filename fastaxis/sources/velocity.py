"""Layered velocity models: text files of depth, P and S velocity and density."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def layers(spark: SparkSession, path: str) -> DataFrame:
    """(line, depth_km, vp, vs, rho): comments and lines that are not four numbers left out; a depth given twice is a discontinuity.

    In ``.tvel`` files the first two lines are titles, whatever they hold; ``.nd`` files name boundaries on lines of their own.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    if path.lower().endswith(".tvel"):
        rows = rows.filter("line > 1")
    parts = F.split(F.trim("value"), r"\s+")
    kept = rows.filter(~F.trim("value").startswith("#")).select("line", parts.alias("p")).filter(F.size("p") == 4)
    numbers = kept.select("line", *[F.expr(f"try_cast(p[{i}] as double)").alias(n) for i, n in enumerate(("depth_km", "vp", "vs", "rho"))])
    return numbers.filter("depth_km is not null and vp is not null and vs is not null and rho is not null").orderBy("line")


def profile(table: DataFrame, most: int = 10_000) -> np.ndarray:
    """The model as an array of (depth, vs), which every task needs; more than ``most`` lines are no layered model."""
    rows = table.orderBy("line").select("depth_km", "vs").take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a velocity model has at most {most} lines")
    return np.array([(r.depth_km, r.vs) for r in rows])
