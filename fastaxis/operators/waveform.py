"""Waveform screening and preparation on (rec, comp, i, v) samples or (rec, comp, data) traces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Largest amplitude of a dead sensor; largest spread of horizontal maxima, in percent.
DEAD, SPREAD = 1e-6, 30.0


def snr(samples: DataFrame, noise: tuple[int, int], signal: tuple[int, int], least: int = 10) -> DataFrame:
    """(rec, snr): the mean over components of signal over noise root mean squares, both ranges inclusive.

    A component counts with ``least`` samples on either side and some noise; 0 without any.
    """
    inside = lambda r: F.col("i").between(*r)
    rms = lambda r: F.sqrt(F.avg(F.when(inside(r), F.col("v") * F.col("v"))))
    per = samples.groupBy("rec", "comp").agg(rms(noise).alias("noise"), rms(signal).alias("signal"), F.count_if(inside(noise)).alias("n0"), F.count_if(inside(signal)).alias("n1"))
    ratio = F.when((F.col("n0") >= least) & (F.col("n1") >= least) & (F.col("noise") > 0), F.col("signal") / F.col("noise"))
    return per.groupBy("rec").agg(F.coalesce(F.avg(ratio), F.lit(0.0)).alias("snr"))


def peak(data: Column) -> Column:
    """Largest absolute amplitude of an array."""
    return F.array_max(F.transform(data, lambda v: F.abs(v)))


def quality_flags(traces: DataFrame, horizontal: Column) -> DataFrame:
    """(rec, n_channels, spread, reason): the first reason against a record, or null.

    In this order: fewer than three channels, a dead sensor, horizontal maxima that differ too much.
    """
    per = traces.groupBy("rec").agg(F.count_distinct("comp").alias("n_channels"), F.min(peak(F.col("data"))).alias("lowest"), F.min(F.when(horizontal, peak(F.col("data")))).alias("h0"), F.max(F.when(horizontal, peak(F.col("data")))).alias("h1"), F.count_if(horizontal).alias("nh"))
    spread = F.when((F.col("nh") >= 2) & (F.col("h1") > 0), 100 - 100 * F.col("h0") / F.col("h1"))
    reason = F.when(F.col("n_channels") < 3, F.lit("fewer than three channels")).when(F.col("lowest") <= DEAD, F.lit("dead sensor")).when(spread > SPREAD, F.lit("horizontal amplitudes differ"))
    return per.select("rec", "n_channels", spread.alias("spread"), reason.alias("reason"))


def gaps(segments: DataFrame, min_gap: float) -> DataFrame:
    """(key, gap): segments (key, start, end in seconds) that begin min_gap or more after the one before; overlaps are no gaps."""
    before = F.lag("end").over(Window.partitionBy("key").orderBy("start"))
    return segments.select("key", (F.col("start") - before).alias("gap")).filter(F.col("gap") >= min_gap)


def detrended(samples: DataFrame) -> DataFrame:
    """(rec, comp, i, v): without the least-squares line of each trace."""
    w = Window.partitionBy("rec", "comp")
    slope, cut = F.regr_slope("v", "i").over(w), F.regr_intercept("v", "i").over(w)
    return samples.select("rec", "comp", "i", (F.col("v") - cut - slope * F.col("i")).alias("v"))


def decimated(traces: DataFrame, every: int) -> DataFrame:
    """Every n-th sample from the first, without a filter before."""
    return traces.withColumn("data", F.filter("data", lambda _, i: i % every == 0))


def resampling(rate: Column, target: float, decimate: bool) -> Column:
    """struct(every, reason): how a rate comes to the target."""
    ratio = rate / target
    reason = F.when(rate < target, F.lit("sampling rate too low")).when((rate > target) & F.lit(not decimate), F.lit("decimation is off")).when(F.abs(ratio - F.rint(ratio)) > 1e-9, F.lit("sampling rate is no multiple"))
    return F.struct(F.when(reason.isNull(), F.rint(ratio).cast("int")).alias("every"), reason.alias("reason"))


def to_zne(traces: DataFrame) -> DataFrame:
    """(rec, z, n, e) from three channels with azimuth and dip (degrees): their directions' inverse matrix, sample by sample.

    traces: (rec, code, azimuth, dip, data). The first three channels by code count, cut to their
    common length; a record with fewer, or whose directions lie in a plane, comes back null.
    """
    ordered = traces.withColumn("k", F.row_number().over(Window.partitionBy("rec").orderBy("code"))).filter("k <= 3")
    az, dip = F.radians("azimuth"), F.radians("dip")
    unit = F.struct((-F.sin(dip)).alias("z"), (F.cos(dip) * F.cos(az)).alias("n"), (F.cos(dip) * F.sin(az)).alias("e"), "data")
    wide = ordered.withColumn("u", unit).groupBy("rec").agg(*[F.max(F.when(F.col("k") == k, F.col("u"))).alias(f"u{k}") for k in (1, 2, 3)])
    g = lambda k, c: F.col(f"u{k}")[c]
    minor = lambda i, j, a, b: g(i, a) * g(j, b) - g(i, b) * g(j, a)
    det = g(1, "z") * minor(2, 3, "n", "e") - g(1, "n") * minor(2, 3, "z", "e") + g(1, "e") * minor(2, 3, "z", "n")
    rows = {"z": (minor(2, 3, "n", "e"), -minor(1, 3, "n", "e"), minor(1, 2, "n", "e")), "n": (-minor(2, 3, "z", "e"), minor(1, 3, "z", "e"), -minor(1, 2, "z", "e")), "e": (minor(2, 3, "z", "n"), -minor(1, 3, "z", "n"), minor(1, 2, "z", "n"))}
    n = F.least(*[F.size(g(k, "data")) for k in (1, 2, 3)])
    zipped = F.arrays_zip(*[F.slice(g(k, "data"), F.lit(1), n).alias(f"d{k}") for k in (1, 2, 3)])
    ready = wide.withColumn("det", det).withColumn("s", F.when(F.abs("det") > 1e-9, zipped))
    coefficients = {f"{c}{k}": w / F.col("det") for c, ws in rows.items() for k, w in enumerate(ws, 1)}
    ready = ready.withColumns({c: F.when(F.abs("det") > 1e-9, w) for c, w in coefficients.items()})
    mixed = lambda c: F.transform("s", lambda x: F.col(f"{c}1") * x["d1"] + F.col(f"{c}2") * x["d2"] + F.col(f"{c}3") * x["d3"])
    return ready.select("rec", *[mixed(c).alias(c) for c in ("z", "n", "e")])


def butterworth(low: float, high: float, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order band-pass as two biquads (b, a), by the bilinear transform of the analogue prototype."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    w0, bw = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
    poles = np.exp(1j * np.pi * np.array([3, 5]) / 4) * bw / 2
    poles = np.concatenate([poles + np.sqrt(poles**2 - w0**2 + 0j), poles - np.sqrt(poles**2 - w0**2 + 0j)])
    z = (2 * rate + poles) / (2 * rate - poles)
    gain = np.real(bw**2 * (2 * rate) ** 2 / np.prod(2 * rate - poles))
    upper = sorted(z[z.imag > 0], key=abs) if np.any(z.imag > 0) else sorted(z, key=abs)[::2]
    sections = [np.array([1.0, -2 * p.real, abs(p) ** 2]) for p in upper]
    return [(np.array([1.0, 0.0, -1.0]) * (gain if k == 0 else 1.0), a) for k, a in enumerate(sections)]


def response(sections: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The frequency response of biquads at the non-negative frequencies of a real transform over n samples."""
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    out = np.ones(len(z), complex)
    for b, a in sections:
        out *= (b[0] + b[1] * z + b[2] * z * z) / (a[0] + a[1] * z + a[2] * z * z)
    return out


#: Up to so many samples a record is filtered by one product with a matrix; elements of the transforms that are held at once.
SHORT, HELD = 256, 1 << 20


@lru_cache(maxsize=128)
def _transform(low: float, high: float, rate: float, n: int) -> tuple[int, np.ndarray]:
    """The length of a transform that holds n samples and the recursion's coming to rest, and the response over it."""
    sections = butterworth(low, high, rate)
    slowest = max(np.abs(np.roots(a)).max() for _, a in sections)
    rest = int(np.ceil(np.log(1e-15) / np.log(slowest))) if slowest < 1 else n
    m = 1 << int(n + rest).bit_length()
    return m, response(sections, m)


@lru_cache(maxsize=128)
def _both_ways(low: float, high: float, rate: float, n: int) -> np.ndarray:
    """The matrix of the band-pass over n samples, forward and then backward."""
    m, h = _transform(low, high, rate, n)
    impulse = np.fft.irfft(h, m)[:n]
    at = np.arange(n)[:, None] - np.arange(n)
    forward = np.where(at >= 0, impulse[at], 0.0)
    return forward.T @ forward


def bandpass(x: np.ndarray, low: float, high: float, rate: float) -> np.ndarray:
    """Zero-phase band-pass of the rows of x: forward, then backward, from rest and without padding.

    Each direction is the recursion's convolution: of short records a matrix, else made by a transform that is longer than the
    record by as many samples as the recursion takes to come to rest, over a few rows at a time.
    """
    y = np.array(x, float, ndmin=2)
    n = y.shape[1]
    if n <= SHORT:
        y = y @ _both_ways(low, high, rate, n)
    else:
        m, h = _transform(low, high, rate, n)
        step = max(1, HELD // m)
        for i in range(0, len(y), step):
            part = y[i : i + step]
            for _ in range(2):
                part = np.fft.irfft(np.fft.rfft(part, m) * h, m)[:, :n][:, ::-1]
            y[i : i + step] = part
    return y if np.ndim(x) > 1 else y[0]


def filtered(traces: DataFrame, bands: DataFrame, rate: float) -> DataFrame:
    """(rec, comp, bank_idx, low, high, data): every trace in every band; an IIR recursion, so in Arrow batches, whose rows leave in pieces of HELD samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["data"].map(len)
            for (low, high, n), rows in pdf.groupby(["low", "high", sizes], sort=False).indices.items():
                step = max(1, HELD // max(n, 1))
                for i in range(0, len(rows), step):
                    part = pdf.iloc[rows[i : i + step]]
                    yield part.assign(data=list(bandpass(np.stack(part["data"].to_numpy()), float(low), float(high), rate)))

    wide = traces.select("rec", "comp", "data").crossJoin(F.broadcast(bands)).select("rec", "comp", "bank_idx", "low", "high", "data")
    return wide.mapInPandas(run, wide.schema)


def stacked(arrays, work) -> list:
    """``work`` on arrays of equal length together: it takes a matrix and gives a value or row for each of its rows."""
    out: list = [None] * len(arrays)
    sizes = np.array([0 if x is None else len(x) for x in arrays])
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        made = work(np.stack([np.asarray(arrays[i], float) for i in rows]) if n else np.zeros((len(rows), 0)))
        for i, value in zip(rows, made, strict=True):
            out[i] = value
    return out


def power_spectrum(traces: DataFrame, n: int, keys: tuple[str, ...] = ("rec", "comp")) -> DataFrame:
    """(keys, k, power): squared amplitudes of the Fourier transform of traces (keys, data) over n samples, k from 0 to before n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            power = stacked(pdf["data"].to_list(), lambda x: list(np.abs(np.fft.fft(x, n)) ** 2))
            yield pdf[list(keys)].assign(power=power)

    kinds = dict(traces.dtypes)
    spectra = traces.select(*keys, "data").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", power array<double>")
    return spectra.select(*keys, F.posexplode("power").alias("k", "power"))


def degrees_of_freedom(power: DataFrame, points: int, keys: tuple[str, ...] = ("rec", "comp")) -> DataFrame:
    """(keys, ndf): from second and fourth spectral moments; the last bin stands in for the Nyquist bin."""
    ends = {"first": F.min(F.struct("k", "power"))["power"], "last": F.max(F.struct("k", "power"))["power"]}
    m = power.groupBy(*keys).agg(F.sum("power").alias("p2"), F.sum(F.col("power") * F.col("power")).alias("p4"), *[e.alias(k) for k, e in ends.items()])
    f2 = F.col("p2") - (F.col("first") - F.col("last")) / 2
    f4 = F.col("p4") * 4 / 3 - (F.col("first") * F.col("first") - F.col("last") * F.col("last")) / 3
    return m.select(*keys, F.least(F.rint(2 * f2 * f2 / f4 - 1), F.lit(float(points))).cast("long").alias("ndf"))


def dominant_period(power: DataFrame, n: int, rate: float, keys: tuple[str, ...] = ("rec", "comp")) -> DataFrame:
    """(keys, period): of the strongest bin above zero frequency, up to the Nyquist frequency."""
    best = power.filter((F.col("k") > 0) & (F.col("k") <= n // 2)).groupBy(*keys).agg(F.min(F.struct(F.round(-F.col("power"), 9).alias("p"), F.col("k")))["k"].alias("k"))
    return best.select(*keys, (F.lit(float(n)) / rate / F.col("k")).alias("period"))
