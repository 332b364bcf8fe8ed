"""A pick's measurement from its record, in arrays: preparation, bands, both splitting methods, clusters, quality.

One pick needs its record and nothing else, so a batch of picks is a narrow pass. The grids of
axes and delays come from second moments: running sums over the record give those of every
window and delay, and axes are arithmetic on them, as in grid.py.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np

from fastaxis.functions.geometry import Z95
from fastaxis.operators.clustering import cut_labels, dendrogram
from fastaxis.operators.waveform import DEAD, SPREAD, bandpass

#: Channels that dip less are horizontal (degrees).
LEVEL = 5.0
#: Trial axes in degrees.
AXES = np.arange(-90, 91)
#: Cells of grids, and products with delayed copies, that are held at once; the longest delay where none is given and none can be found, in seconds.
CELLS, HELD, FALLBACK = 1 << 15, 1 << 20, 0.3


class Rejected(ValueError):
    """Why a pick has no measurement."""


@dataclass
class Segment:
    """Samples of a channel without a break: ``start`` in seconds."""

    channel: str
    start: float
    rate: float
    data: np.ndarray


def detrended(x: np.ndarray) -> np.ndarray:
    """Samples less their least-squares line."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * (t @ x / max(t @ t, 1e-300))


def joined(segments: list[Segment], min_gap: float) -> Segment:
    """One segment of several of a channel: each without its trend, short gaps zero, the later one where two overlap."""
    segments = sorted(segments, key=lambda s: s.start)
    rate = segments[0].rate
    if any(b.start - (a.start + (len(a.data) - 1) / a.rate) - 1 / a.rate >= min_gap - 1e-9 for a, b in zip(segments, segments[1:], strict=False)):
        raise Rejected("gaps in the record")
    if any(s.rate != rate for s in segments):
        raise Rejected("sampling rates differ")
    begin = segments[0].start
    places = [round((s.start - begin) * rate) for s in segments]
    out = np.zeros(max(p + len(s.data) for p, s in zip(places, segments, strict=True)))
    for place, s in zip(places, segments, strict=True):
        out[place : place + len(s.data)] = detrended(np.asarray(s.data, float))
    return Segment(segments[0].channel, begin, rate, out)


def prepared(segments: Iterable[Segment], orientations: dict[str, tuple[float, float]], min_gap: float, target: float, decimate: bool) -> tuple[np.ndarray, float]:
    """Vertical, north and east at the target rate, and the time of their first sample.

    Refused in this order: fewer than three channels, gaps, a dead sensor, horizontals of other
    size, channels without a known direction, a rate that can't become the target.
    """
    by: dict[str, list[Segment]] = {}
    for s in segments:
        if len(s.data):
            by.setdefault(s.channel, []).append(s)
    if len(by) < 3:
        raise Rejected("fewer than three channels")
    whole = {c: joined(parts, min_gap) for c, parts in sorted(by.items())}
    peaks = {c: float(np.abs(s.data).max()) for c, s in whole.items()}
    if min(peaks.values()) <= DEAD:
        raise Rejected("dead sensor")
    level = [peaks[c] for c in whole if c in orientations and abs(orientations[c][1]) <= LEVEL and not c.endswith("Z")]
    if len(level) >= 2 and 100 - 100 * min(level) / max(level) > SPREAD:
        raise Rejected("horizontal amplitudes differ")
    ends = {c[-1]: s for c, s in whole.items()}
    if sorted(ends) == ["E", "N", "Z"]:
        three = [ends[k] for k in "ZNE"]
        turn = np.eye(3)
    else:
        three = list(whole.values())[:3]
        if unknown := [s.channel for s in three if s.channel not in orientations]:
            raise Rejected(f"no orientation of channel {unknown[0]}")
        az, dip = np.radians([orientations[s.channel] for s in three]).T
        directions = np.stack([-np.sin(dip), np.cos(dip) * np.cos(az), np.cos(dip) * np.sin(az)], 1)
        if abs(np.linalg.det(directions)) < 1e-9:
            raise Rejected("channels lie in a plane")
        turn = np.linalg.inv(directions)
    if len({s.rate for s in three}) > 1:
        raise Rejected("sampling rates differ")
    n = min(len(s.data) for s in three)
    zne = turn @ np.stack([s.data[:n] for s in three])
    rate = three[0].rate
    if rate != target:
        if rate < target:
            raise Rejected("sampling rate too low")
        if not decimate:
            raise Rejected("decimation is off")
        every = round(rate / target)
        if abs(rate / target - every) > 1e-9:
            raise Rejected("sampling rate is no multiple")
        zne = zne[:, ::every]
    return zne, three[0].start


def signals_to_noise(zne: np.ndarray, rate: float, at: float) -> np.ndarray:
    """Of each of a stack of records (records, components, samples), the mean over components of signal over noise root mean squares.

    1 to 0.1 s before the arrival is noise, from there to 1 s after it signal.
    """
    first = lambda t: max(0, math.ceil((at + t) * rate - 1e-6))
    last = lambda t: max(0, math.floor((at + t) * rate + 1e-6) + 1)
    noise, signal = zne[..., first(-1.0) : last(-0.1)], zne[..., first(-0.1) : last(1.0)]
    if noise.shape[-1] < 10 or signal.shape[-1] < 10:
        return np.zeros(len(zne))
    level, height = np.sqrt((noise**2).mean(axis=-1)), np.sqrt((signal**2).mean(axis=-1))
    ratio = np.divide(height, level, out=np.zeros_like(level), where=level > 0)
    return ratio.sum(axis=-1) / np.maximum((level > 0).sum(axis=-1), 1)


def signal_to_noise(zne: np.ndarray, rate: float, at: float) -> float:
    """signals_to_noise() of one record."""
    return float(signals_to_noise(zne[None], rate, at)[0])


def ranked_bands(zne: np.ndarray, rate: float, at: float, bank: Iterable[tuple[float, float]], snr_min: float) -> list[dict[str, Any]]:
    """The bands whose signal is clear, by snr times octaves, with their filtered record; ties in the order of the bank."""
    bands = [(low, high) for low, high in bank if high < 0.9 * rate / 2]
    if not bands:
        return []
    stack = np.stack([bandpass(zne, low, high, rate) for low, high in bands])
    found = zip(bands, signals_to_noise(stack, rate, at).tolist(), stack, strict=True)
    return sorted(({"low": low, "high": high, "snr": snr, "score": snr * math.log2(high / low), "zne": filtered} for (low, high), snr, filtered in found if snr >= snr_min), key=lambda b: -b["score"])


def lattice(pick: float, max_delay: float, w: Any) -> list[tuple[float, float]]:
    """The windows around a pick by length, as windows.lattice() has them."""
    near = 1e-9
    found = [(w.tbeg1 - a * w.dtbeg, w.tend0 + b * w.dtend, a, b) for a in range(w.nbeg) for b in range(w.nend)]
    kept = [x for x in found if x[0] >= w.tbeg0 - near and x[1] <= w.tend1 + near and x[1] - x[0] > max_delay + 1e-6]
    return [(t0 + pick, t1 + pick) for t0, t1, _, _ in sorted(kept, key=lambda x: (round(x[1] - x[0], 9), x[2], x[3]))]


def in_ray_plane(zne: np.ndarray, back_azimuth: float, incidence: float | None) -> np.ndarray:
    """The two components across a ray: Q and T of ray coordinates where an incidence is given and not 0, else radial and transverse.

    T points the other way in ray coordinates than transverse does.
    """
    z, n, e = zne
    cb, sb = math.cos(math.radians(back_azimuth)), math.sin(math.radians(back_azimuth))
    if incidence:
        ca, sa = math.cos(math.radians(incidence)), math.sin(math.radians(incidence))
        return np.stack([sa * z + ca * (sb * e + cb * n), sb * n - cb * e])
    return np.stack([cb * n + sb * e, cb * e - sb * n])


def _prefix(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((*x.shape[:-1], 1)), np.cumsum(x, axis=-1)], axis=-1)


def _covariances(xy: np.ndarray, lo: np.ndarray, hi: np.ndarray, lags: int) -> dict[str, np.ndarray]:
    """Covariances of x, y in windows, arrays (windows, 1), and with and of u, w, the same delayed: arrays (windows, lags)."""
    base, end = int(lo.min()), int(hi.max()) + lags - 1
    x, y = xy[:, base:end]
    lo, hi = lo - base, hi - base
    lag = np.arange(lags)
    n = (hi - lo)[:, None].astype(float)
    of = lambda v: _prefix(v)
    still = lambda p: (p[hi] - p[lo])[:, None]
    late = lambda p: p[hi[:, None] + lag] - p[lo[:, None] + lag]

    def across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        delayed = np.lib.stride_tricks.sliding_window_view(np.concatenate([b, np.zeros(lags - 1)]), len(b))
        out = np.empty((len(lo), lags))
        step = max(1, HELD // len(b))
        for k in range(0, lags, step):
            p = _prefix(a * delayed[k : k + step])
            out[:, k : k + step] = (p[:, hi] - p[:, lo]).T
        return out

    sx, sy, su, sw = still(of(x)), still(of(y)), late(of(x)), late(of(y))
    cov = lambda s, a, b: (s - a * b / n) / (n - 1)
    return {
        "xx": cov(still(of(x * x)), sx, sx), "yy": cov(still(of(y * y)), sy, sy), "xy": cov(still(of(x * y)), sx, sy),
        "uu": cov(late(of(x * x)), su, su), "ww": cov(late(of(y * y)), sw, sw), "uw": cov(late(of(x * y)), su, sw),
        "xu": cov(across(x, x), sx, su), "xw": cov(across(x, y), sx, sw), "yu": cov(across(y, x), sy, su), "yw": cov(across(y, y), sy, sw),
    }


_C, _S = np.cos(np.radians(AXES)), np.sin(np.radians(AXES))
#: What the moments of the fast component, of the slow one and of both are multiplied by at each axis.
_FAST, _SLOW, _BOTH = (np.stack(k, 1) for k in ((_C * _C, 2 * _C * _S, _S * _S), (_S * _S, -2 * _C * _S, _C * _C), (-_C * _S, _C * _C, -_S * _S, _C * _S)))


def _objectives(m: dict[str, np.ndarray], part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalue ratio and absolute correlation of the fast and the delayed slow component: arrays (windows, axes, lags); NaN without motion."""
    of = lambda turn, names: turn @ np.stack([m[name][part] for name in names], 1)
    ff, ss, fs = of(_FAST, ("xx", "xy", "yy")), of(_SLOW, ("uu", "uw", "ww")), of(_BOTH, ("xu", "xw", "yu", "yw"))
    total, root = ff + ss, ff - ss
    root *= root
    size = np.abs(fs, out=fs) * 2
    size *= size
    root += size
    np.sqrt(root, out=root)
    ss *= ff
    size = np.sqrt(np.maximum(ss, 0, out=ss), out=ss)
    ratio = total - root
    total += root
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio /= total
        fs /= size
    np.maximum(ratio, 0, out=ratio)
    for found, below in ((ratio, total), (fs, size)):
        if not (still := below > 0).all():
            found[~still] = np.nan
    return ratio, fs


def _extents(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A quarter of the ranges of axes and of lags that regions (windows, axes, lags) touch; NaN where one is empty."""
    out = []
    for over in (2, 1):
        touched = inside.any(axis=over)
        span = touched.shape[1] - 1 - touched[:, ::-1].argmax(axis=1) - touched.argmax(axis=1)
        out.append(np.where(touched.any(axis=1), span / 4, np.nan))
    return out[0], out[1]


def _extent(inside: np.ndarray) -> tuple[float, float]:
    """_extents() of one region (axes, lags)."""
    axes, lags = _extents(inside[None])
    return float(axes[0]), float(lags[0])


def _least(value: np.ndarray) -> np.ndarray:
    """The first place of each row's least value; NaN is no value, and a row of nothing else has place -1."""
    at = value.argmin(axis=1)
    if np.isnan(value[np.arange(len(value)), at]).any():
        held = np.where(np.isnan(value), np.inf, value)
        at = np.where(np.isnan(value).all(axis=1), -1, held.argmin(axis=1))
    return at


def spectral_freedoms(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Degrees of freedom of signals (rows of n samples, then zeros), each from its spectrum over the next power of two; NaN without motion."""
    out = np.full(len(t), np.nan)
    points = np.array([1 << (int(k) - 1).bit_length() for k in n])
    for m in np.unique(points):
        rows = np.flatnonzero(points == m)
        p = np.abs(np.fft.fft(t[rows, :m], int(m))) ** 2
        f2 = p.sum(axis=1) - (p[:, 0] - p[:, -1]) / 2
        f4 = 4 / 3 * (p**2).sum(axis=1) - (p[:, 0] ** 2 - p[:, -1] ** 2) / 3
        with np.errstate(divide="ignore", invalid="ignore"):
            out[rows] = np.where(f4 > 0, np.minimum(np.rint(2 * f2 * f2 / f4 - 1), n[rows]), np.nan)
    return out


def spectral_freedom(t: np.ndarray) -> float:
    """spectral_freedoms() of one signal."""
    return float(spectral_freedoms(np.asarray(t, float)[None], np.array([len(t)]))[0])


def dominant_period(x: np.ndarray, rate: float) -> float:
    """Of the strongest frequency above zero; NaN for fewer than two samples."""
    if len(x) < 2:
        return math.nan
    power = np.abs(np.fft.rfft(x))[1:] ** 2
    return len(x) / rate / (int(power.argmax()) + 1)


def longest_delays(xy: np.ndarray, lo: np.ndarray, hi: np.ndarray, rate: float, given: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Each window's longest delay and the dominant period it comes from: half of it, where no delay is given."""
    if given:
        return np.full(len(lo), given), np.full(len(lo), math.nan)
    periods = [[dominant_period(c[a:b], rate) for c in xy] for a, b in zip(lo, hi, strict=True)]
    known = [[p for p in two if not math.isnan(p)] for two in periods]
    period = np.array([sum(k) / len(k) if k else math.nan for k in known])
    return np.where(period > 0, period / 2, FALLBACK), period


def measured(xy: np.ndarray, rate: float, spans: list[tuple[float, float]], max_delay: float | None, gamma: float, back_azimuth: float) -> list[dict[str, Any]]:
    """Both methods' answers for each window (in seconds from the record's start) and the window's quality; None where there is none.

    Window bounds are cut off toward the first sample. The eigenvalue method's longest delay is
    rounded down to a sample, the correlation's up. A window without room for its delays, or not
    longer than them, has no answer. The confidence regions of the correlation are those up to its lower bound, as published.
    """
    lo, hi = (np.array([int(s[k] * rate) for s in spans], dtype=int) for k in (0, 1))
    out: list[dict[str, Any]] = [{"window": k, "ev": None, "rc": None, "q": None} for k in range(len(spans))]
    # A window that the record doesn't hold has no answer.
    held = np.flatnonzero((lo >= 0) & (hi <= xy.shape[1]) & (hi - lo > 1))
    if not len(held):
        return out
    delays, periods = longest_delays(xy, lo[held], hi[held], rate, max_delay)
    long = np.array([spans[k][1] - spans[k][0] for k in held]) > delays + 1e-6
    period_of = dict(zip(held.tolist(), periods.tolist(), strict=True))
    for delay in np.unique(delays[long]):
        own = held[long & (delays == delay)]
        lags = {"ev": int(delay * rate) + 1, "rc": math.ceil(delay * rate) + 1}
        for k in own.tolist():
            out[k]["period"] = period_of[k]
        fits = {name: own[hi[own] + n - 1 <= xy.shape[1]] for name, n in lags.items()}
        # The method with fewer lags is the first lags of the other.
        for group, names in ((fits["rc"], ("ev", "rc")), (np.setdiff1d(fits["ev"], fits["rc"]), ("ev",))):
            if not len(group):
                continue
            m = _covariances(xy, lo[group], hi[group], max(lags[n] for n in names))
            step = max(1, CELLS // (len(AXES) * max(lags[n] for n in names)))
            for start in range(0, len(group), step):
                part = slice(start, min(len(group), start + step))
                ratio, correlation = _objectives(m, part)
                few, ratio = group[part], ratio[..., : lags["ev"]]
                for k, c, found in zip(few, ratio, _least_ratios(ratio, xy, lo[few], hi[few]), strict=True):
                    out[k]["ev"] = _eigenvalue(c, found, rate)
                if "rc" in names:
                    for k, c, found in zip(few, correlation, _largest_correlations(correlation), strict=True):
                        out[k]["rc"] = _correlated(c, found, rate)
    for w in out:
        for method in ("ev", "rc"):
            if w[method]:
                w[method]["phi"] = (w[method]["axis"] + back_azimuth) % 180
        if w["ev"] and w["rc"] and not any(math.isnan(w[m][e]) for m in ("ev", "rc") for e in ("phi_err", "dt_err")):
            w["q"] = window_quality(w["rc"], w["ev"], gamma)
    return out


def _least_ratios(c: np.ndarray, xy: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple | None]:
    """(axis's place, lag, both errors, level, variance) of each window's least ratio, from (windows, axes, lags): None without motion.

    Ratios are compared to nine decimals.
    """
    value = np.rint(c * 1e9)
    place = _least(value.reshape(len(c), -1))
    a, lag = np.divmod(np.maximum(place, 0), c.shape[2])
    ratio = c[np.arange(len(c)), a, lag]
    # Windows as rows as long as the longest, with zeros behind the shorter ones.
    n = hi - lo
    at = np.arange(n.max())
    inside = at < n[:, None]
    own = np.minimum(lo[:, None] + at, hi[:, None] - 1)
    (x, y), (u, w) = xy[:, own], xy[:, own + lag[:, None]]
    cos, sin = _C[a][:, None], _S[a][:, None]
    t = np.where(inside, sin * (cos * x + sin * y) + cos * (cos * w - sin * u), 0.0)
    freedom = spectral_freedoms(t, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.where(freedom > 2, ratio * 0.05 ** (-2 / (freedom - 2)), np.nan)
        phi_err, lag_err = _extents(value <= np.rint(level * 1e9)[:, None, None])
        unit = t / np.abs(t).max(axis=1)[:, None]
        t_var = (np.where(inside, unit - (unit.sum(axis=1) / n)[:, None], 0.0) ** 2).sum(axis=1) / n
    rows = zip(*[v.tolist() for v in (a, lag, phi_err, lag_err, level, t_var)], strict=True)
    return [row if held else None for row, held in zip(rows, ((place >= 0) & ~np.isnan(freedom)).tolist(), strict=True)]


def _eigenvalue(c: np.ndarray, found: tuple | None, rate: float) -> dict[str, Any] | None:
    """The answer of a window from its ratios (axes, lags) and what _least_ratios() says of them."""
    if found is None:
        return None
    a, lag, phi_err, lag_err, level, t_var = found
    return {"axis": int(AXES[a]), "lag": lag, "dt": lag / rate, "phi_err": phi_err, "dt_err": lag_err / rate, "ratio": float(c[a, lag]), "level": level, "t_var": t_var}


def _largest_correlations(c: np.ndarray) -> list[tuple | None]:
    """(axis's place, lag, both errors, level) of each window's largest correlation, from (windows, axes, lags), as _least_ratios()."""
    value = np.rint(c * 1e9)
    place = _least(-value.reshape(len(c), -1))
    a, lag = np.divmod(np.maximum(place, 0), c.shape[2])
    best, size = c[np.arange(len(c)), a, lag], c.shape[1] * c.shape[2]
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.where((best < 1) & (size > 4), np.tanh(np.arctanh(best) - Z95 / math.sqrt(max(size - 4, 1))), np.nan)
        phi_err, lag_err = _extents(value <= np.rint(level * 1e9)[:, None, None])
    rows = zip(*[v.tolist() for v in (a, lag, phi_err, lag_err, level)], strict=True)
    return [row if held else None for row, held in zip(rows, (place >= 0).tolist(), strict=True)]


def _correlated(c: np.ndarray, found: tuple | None, rate: float) -> dict[str, Any] | None:
    """The answer of a window from its correlations (axes, lags) and what _largest_correlations() says of them."""
    if found is None:
        return None
    a, lag, phi_err, lag_err, level = found
    return {"axis": int(AXES[a]), "lag": lag, "dt": lag / rate, "phi_err": phi_err, "dt_err": lag_err / rate, "level": level}


def window_quality(rc: dict[str, Any], ev: dict[str, Any], gamma: float) -> dict[str, Any]:
    """q, delta, omega and class: geometry.quality_index() of two answers."""
    delta = 0.0 if ev["dt"] == 0 else rc["dt"] / ev["dt"]
    apart = abs(rc["phi"] - ev["phi"])
    omega = abs(90 - apart if apart > 45 else apart) / 45
    good, null = min(math.hypot(delta - 1, omega), 1.0), min(math.hypot(delta, omega - 1), 1.0)
    q = -(1 - null) if null < good else 1 - good
    return {"q": q, "delta": delta, "omega": omega, "class": quality_class(q, gamma)}


def quality_class(q: float, gamma: float) -> str:
    return "Good Split" if q >= gamma else "Good Null" if q <= -gamma else "Poor/Noise"


def corrected(zne: np.ndarray, phi: float, lag: int, lo: int, hi: int) -> dict[str, float]:
    """Source polarisation, and the correlations of fast with slow and of north with east after the correction."""
    _, n, e = zne
    c, s = math.cos(math.radians(phi)), math.sin(math.radians(phi))
    fast, slow = (c * n + s * e)[lo:hi], (c * e - s * n)[lo + lag : hi + lag]
    north, east = c * fast - s * slow, s * fast + c * slow

    def correlation(a: np.ndarray, b: np.ndarray) -> float:
        a, b = a - a.mean(), b - b.mean()
        size = math.sqrt(float(a @ a) * float(b @ b))
        return float(a @ b) / size if size > 0 else math.nan

    m = np.cov(north, east)
    spol = math.degrees(0.5 * math.atan2(2 * m[0, 1], m[0, 0] - m[1, 1])) % 180
    return {"spol": spol, "cc_fs": correlation(fast, slow), "cc_ne": correlation(north, east)}


def _spread(x: np.ndarray) -> np.ndarray:
    span = x.max() - x.min()
    return x / span if span > 0 else np.ones(len(x))


def _within(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of k clusters: its size, its mean and the sum of squares about it."""
    size = np.bincount(label, minlength=k)
    mean = np.stack([np.bincount(label, c, k) for c in x.T], 1) / size[:, None]
    return size, mean, np.bincount(label, ((x - mean[label]) ** 2).sum(axis=1), k)


def chosen(windows: list[dict[str, Any]], linkage: str, k_max: int, n_min: int, ccrit: float) -> dict[str, Any] | None:
    """The best window of the best cluster of the eigenvalue answers; None for fewer than three with errors.

    clustering.py has these steps as DataFrames, and says what they are.
    """
    valid = [w for w in windows if w["ev"] and not math.isnan(w["ev"]["phi_err"]) and not math.isnan(w["ev"]["dt_err"])]
    n = len(valid)
    if n < 3:
        return None
    value = lambda name: np.array([w["ev"][name] for w in valid], float)
    x = np.stack([_spread(value("dt")), _spread(value("phi"))], 1)
    errors = np.stack([_spread(value("dt_err")), _spread(value("phi_err"))], 1)
    merges = dendrogram(x, linkage)
    labels = {k: cut_labels(n, merges, k) for k in range(1, min(max(k_max, 2), n - 1) + 1)}
    sums = {k: _within(x, label, k) for k, label in labels.items()}
    most = k_max
    for k, (size, mean, own) in sums.items():
        a, b = np.triu_indices(k, 1)
        two = own[a] + own[b]
        # What both clusters are as one: their own sums, and the distance of their means.
        one = two + size[a] * size[b] / (size[a] + size[b]) * ((mean[a] - mean[b]) ** 2).sum(axis=1)
        a, b = two[one > 0], one[one > 0]
        if ((1 - a / b - 1 / math.pi) * math.sqrt(n / (1 - 4 / math.pi**2)) <= ccrit).any():
            most = min(most, k)
            break
    whole = float(sums[1][2][0])
    scores = {}
    for k in range(2, most + 1):
        if k in labels:
            left = float(sums[k][2].sum())
            scores[k] = (whole - left) / (k - 1) / (left / (n - k)) if left > 1e-12 else 1.0
    number = min(scores, key=lambda k: (-round(scores[k], 9), k)) if any(s > 0 for s in scores.values()) else 1
    label, (size, _, own) = labels[number], sums[number]
    groups = np.flatnonzero(size >= n_min).tolist() or list(range(number))
    with np.errstate(divide="ignore"):
        weights = np.where(errors > 0, 1 / errors**2, 0)
        variances = np.maximum(own / size, sum(1 / np.bincount(label, w, number) for w in weights.T)).tolist()
    best = min(groups, key=lambda j: (round(variances[j], 9), j))
    members = np.flatnonzero(label == best)
    at = members[int(np.argmin(np.round(errors[members].sum(axis=1), 9)))]
    return {"best": valid[at], "members": [valid[i] for i in members], "n_clusters": number, "n_in_cluster": len(members), "n_valid": n}


def agreed(found: list[dict[str, Any]], phi_tolerance: float, dt_tolerance: float) -> dict[str, Any] | None:
    """The mean of the answers that agree with the first, with the first one's other values; errors as root mean squares."""
    if not found:
        return None
    first = found[0]
    fold = lambda d: 180 - d if d > 90 else d
    near = [x for x in found if round(fold(abs(x["phi"] - first["phi"])), 9) <= phi_tolerance and round(abs(x["dt"] - first["dt"]), 9) <= dt_tolerance]
    mean = lambda name: sum(x[name] for x in near) / len(near)
    rms = lambda name: math.sqrt(sum(x[name] ** 2 for x in near) / len(near))
    return first | {"phi": mean("phi"), "dt": mean("dt"), "phi_err": rms("phi_err"), "dt_err": rms("dt_err"), "n_filters": len(near)}


def event_quality(choice: dict[str, Any], gamma: float, omega1: float, omega2: float) -> dict[str, Any] | None:
    """Over the cluster's windows that have a quality: their mean, the one of the largest size, and both weighed."""
    own = sorted((w for w in choice["members"] if w["q"]), key=lambda w: w["window"])
    if not own:
        return None
    mean = sum(w["q"]["q"] for w in own) / len(own)
    best = min(own, key=lambda w: (-round(abs(w["q"]["q"]), 9), w["window"]))["q"]
    final = omega1 * mean + omega2 * best["q"]
    return {"qmean": mean, "qbest": best["q"], "qfinal": final, "delta": best["delta"], "omega": best["omega"], "quality_class": quality_class(round(final, 9), gamma), "n_cluster_windows": len(own)}


def _number(x: float | None) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


def measure(zne: np.ndarray, pick: float, back_azimuth: float, incidence: float | None, config: Any) -> dict[str, Any]:
    """The result columns of a prepared record whose pick lies ``pick`` seconds after its start; Rejected where there are none.

    Bands, snr and their number are those of the first band, whichever band's cluster gives the quality.
    """
    sws, rate = config.sws, config.waveform.target_sampling_rate
    bands = ranked_bands(zne, rate, pick, sws.filter_bank, sws.snr_min)
    if not bands:
        raise Rejected("no band has a clear signal")
    max_delay = sws.max_delay_ms / 1000
    spans = lattice(pick, max_delay, sws.windows)
    if not spans:
        raise Rejected("no analysis windows")
    incidence = incidence if sws.rotation_mode == "LQT" else None
    ev_found, rc_found, notes, quality = [], [], [], None
    first = True
    for band in bands[: sws.consensus.n_best_filters if sws.consensus.enabled else 1]:
        windows = measured(in_ray_plane(band["zne"], back_azimuth, incidence), rate, spans, max_delay, sws.quality.gamma, back_azimuth)
        note = {"filter": f"{band['low']:.1f}-{band['high']:.1f} Hz", "snr": band["snr"], "score": band["score"], "n_windows_ev": sum(w["ev"] is not None for w in windows), "n_windows_rc": sum(w["rc"] is not None for w in windows), "clustering": None}
        notes.append(note)
        choice = chosen(windows, sws.cluster.linkage, sws.cluster.k_max, sws.cluster.n_min, sws.cluster.ccrit)
        if choice is None:
            continue
        best = choice["best"]
        lo, hi = (int(t * rate) for t in spans[best["window"]])
        ev = best["ev"]
        ev_found.append(ev | corrected(band["zne"], ev["phi"], ev["lag"], lo, hi) | {"n_clusters": choice["n_clusters"], "n_in_cluster": choice["n_in_cluster"], "period": best.get("period")})
        note["clustering"] = {"phi": ev["phi"], "dt_ms": ev["dt"] * 1000, "phi_err": ev["phi_err"], "dt_err_ms": ev["dt_err"] * 1000, "n_clusters": choice["n_clusters"], "n_in_cluster": choice["n_in_cluster"], "n_valid_measurements": choice["n_valid"], "window": list(spans[best["window"]])}
        if best["rc"]:
            rc_found.append(best["rc"] | corrected(band["zne"], best["rc"]["phi"], best["rc"]["lag"], lo, hi))
        if first:
            quality, first = event_quality(choice, sws.quality.gamma, sws.quality.omega1, sws.quality.omega2), False
    ev, rc = (agreed(x, sws.consensus.phi_tolerance, sws.consensus.dt_tolerance) for x in (ev_found, rc_found))
    if ev is None and rc is None:
        raise Rejected("no valid cluster")
    out: dict[str, Any] = {"n_windows": len(spans), "filter_low": float(bands[0]["low"]), "filter_high": float(bands[0]["high"]), "snr": bands[0]["snr"], "rotation_mode": sws.rotation_mode, "consensus_used": sws.consensus.enabled}
    for name, x in (("ev", ev), ("rc", rc)):
        if x:
            out |= {f"{name}_phi": _number(x["phi"]), f"{name}_phi_err": _number(x["phi_err"]), f"{name}_dt_ms": _number(x["dt"] * 1000), f"{name}_dt_err_ms": _number(x["dt_err"] * 1000), f"{name}_spol": _number(x["spol"]), f"{name}_cc_fs": _number(x["cc_fs"]), f"{name}_cc_ne": _number(x["cc_ne"])}
    out |= {"ev_linearity": _number(ev["ratio"]), "n_clusters": ev["n_clusters"], "n_in_cluster": ev["n_in_cluster"], "n_filters_used": ev["n_filters"], "dominant_period_s": _number(ev.get("period"))}
    if rc and quality:
        out |= quality
    out["meta_json"] = json.dumps({"filters": notes, "n_filters_passed_snr": len(bands), "n_windows_generated": len(spans)})
    return out


def guarded(work: Callable[[], dict[str, Any]]) -> dict[str, Any]:
    """What ``work`` gives; of a pick that is refused or fails, the reason alone."""
    try:
        return work() | {"error": None}
    except Rejected as e:
        return {"error": str(e)}
    except Exception as e:  # one pick's failure is no other's
        return {"error": f"{type(e).__name__}: {e}"}
