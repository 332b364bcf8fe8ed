"""The engine's functions for queries written as SQL text: ``register(spark)`` makes them known to a session.

Scalar functions are SQL functions, which Catalyst inlines: filters and generated code see
through them. The lattice of windows and the bank of bands are table functions, to be joined
laterally. Each equals its counterpart among the DataFrame operators (tested).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, NumericType, StructType

from fastaxis.operators.windows import FILTER_BANK

#: Name and parameters, result and body; each may use those above it.
FUNCTIONS = {
    "axial(degrees DOUBLE)": ("DOUBLE", "pmod(degrees, 180D)"),
    "octaves(low DOUBLE, high DOUBLE)": ("DOUBLE", "log2(try_divide(high, low))"),
    "rotated(a DOUBLE, b DOUBLE, degrees DOUBLE)": ("STRUCT<along: DOUBLE, across: DOUBLE>", "named_struct('along', cos(radians(degrees)) * a + sin(radians(degrees)) * b, 'across', cos(radians(degrees)) * b - sin(radians(degrees)) * a)"),
    "ray_coordinates(z DOUBLE, n DOUBLE, e DOUBLE, back_azimuth DOUBLE, incidence DOUBLE)": (
        "STRUCT<l: DOUBLE, q: DOUBLE, t: DOUBLE>",
        "named_struct('l', cos(radians(incidence)) * z - sin(radians(incidence)) * rotated(n, e, back_azimuth).along, "
        "'q', sin(radians(incidence)) * z + cos(radians(incidence)) * rotated(n, e, back_azimuth).along, 't', -rotated(n, e, back_azimuth).across)",
    ),
    "quality_class(q DOUBLE, gamma DOUBLE)": ("STRING", "CASE WHEN q >= gamma THEN 'Good Split' WHEN q <= -gamma THEN 'Good Null' WHEN q IS NOT NULL THEN 'Poor/Noise' END"),
    "delay_ratio(dt_rc DOUBLE, dt_ev DOUBLE)": ("DOUBLE", "CASE WHEN dt_ev = 0 THEN 0D ELSE try_divide(dt_rc, dt_ev) END"),
    "axis_difference(phi_rc DOUBLE, phi_ev DOUBLE)": ("DOUBLE", "abs(CASE WHEN abs(phi_rc - phi_ev) > 45 THEN 90 - abs(phi_rc - phi_ev) ELSE abs(phi_rc - phi_ev) END) / 45D"),
    "nearness(delta DOUBLE, omega DOUBLE, delta_of DOUBLE, omega_of DOUBLE)": ("DOUBLE", "least(sqrt((delta - delta_of) * (delta - delta_of) + (omega - omega_of) * (omega - omega_of)), 1D)"),
    "split_quality(delta DOUBLE, omega DOUBLE)": ("DOUBLE", "CASE WHEN nearness(delta, omega, 0D, 1D) < nearness(delta, omega, 1D, 0D) THEN nearness(delta, omega, 0D, 1D) - 1 ELSE 1 - nearness(delta, omega, 1D, 0D) END"),
    "quality_index(phi_rc DOUBLE, dt_rc DOUBLE, phi_ev DOUBLE, dt_ev DOUBLE)": ("DOUBLE", "split_quality(delay_ratio(dt_rc, dt_ev), axis_difference(phi_rc, phi_ev))"),
}
#: Settings of the lattice with their defaults, after the pick's time.
LATTICE = {"max_delay": 0.4, "tbeg0": -0.5, "tbeg1": -0.1, "tend0": 0.1, "tend1": 0.4, "dtbeg": 0.05, "dtend": 0.01, "nbeg": 10, "nend": 20}


@lru_cache(maxsize=8)
def _offsets(max_delay, tbeg0, tbeg1, tend0, tend1, dtbeg, dtend, nbeg, nend) -> list[tuple[float, float]]:
    """Starts and ends against the pick, by length, then by start and end."""
    spans = [(tbeg1 - a * dtbeg, tend0 + b * dtend, a, b) for a in range(int(nbeg)) for b in range(int(nend))]
    kept = [x for x in spans if x[0] >= tbeg0 - 1e-9 and x[1] <= tend1 + 1e-9 and x[1] - x[0] > max_delay + 1e-6]
    return [x[:2] for x in sorted(kept, key=lambda x: (round(x[1] - x[0], 9), x[2], x[3]))]


def _numbers(given: dict[str, AnalyzeArgument], constant: set[str]) -> None:
    for name, argument in given.items():
        if not isinstance(argument.dataType, NumericType):
            raise ValueError(f"{name} must be a number")
        if name in constant and not argument.isConstantExpression:
            raise ValueError(f"{name} must be a constant")


class WindowLattice:
    """window_lattice(pick, settings by name): (window_idx, t0, t1); none for a pick without a time."""

    @staticmethod
    def analyze(pick: AnalyzeArgument, **settings: AnalyzeArgument) -> AnalyzeResult:
        if unknown := sorted(set(settings) - set(LATTICE)):
            raise ValueError(f"the lattice has no setting {', '.join(unknown)}; it has {', '.join(LATTICE)}")
        _numbers({"pick": pick, **settings}, set(settings))
        return AnalyzeResult(StructType().add("window_idx", IntegerType()).add("t0", DoubleType()).add("t1", DoubleType()))

    def eval(self, pick, **settings):
        if pick is not None:
            for i, (t0, t1) in enumerate(_offsets(*(float(v) for v in (LATTICE | settings).values()))):
                yield i, t0 + float(pick), t1 + float(pick)


class BandBank:
    """band_bank(rate): (bank_idx, low, high) of the bands that end below nine tenths of the Nyquist frequency."""

    @staticmethod
    def analyze(rate: AnalyzeArgument) -> AnalyzeResult:
        _numbers({"rate": rate}, set())
        return AnalyzeResult(StructType().add("bank_idx", IntegerType()).add("low", DoubleType()).add("high", DoubleType()))

    def eval(self, rate):
        for i, (low, high) in enumerate(FILTER_BANK):
            if rate is not None and high < 0.9 * float(rate) / 2:
                yield i, low, high


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; once more changes nothing."""
    for head, (result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    spark.udtf.register("window_lattice", udtf(WindowLattice))
    spark.udtf.register("band_bank", udtf(BandBank))
