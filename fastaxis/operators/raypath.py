"""The earliest S ray through a layered sphere: travel time, takeoff and incidence; geodesics on the ellipsoid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Semi-major axis in metres and flattening of WGS84.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
#: Radius of the sphere in which rays are traced.
EARTH_KM = 6371.0


def inverse_geodesic(lat1, lon1, lat2, lon2) -> tuple[np.ndarray, np.ndarray]:
    """Distance in metres and bearing from the second point to the first, by Vincenty's iteration; NaN where it does not settle."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    b = AXIS * (1 - FLATTENING)
    u1, u2 = np.arctan((1 - FLATTENING) * np.tan(lat1)), np.arctan((1 - FLATTENING) * np.tan(lat2))
    span = lon2 - lon1
    lam = span.copy()
    settled = np.zeros(lam.shape, bool)
    for _ in range(200):
        sin_sigma = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
        cos_sigma = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
        sigma = np.arctan2(sin_sigma, cos_sigma)
        sin_alpha = np.where(sin_sigma > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(sin_sigma > 0, sin_sigma, 1), 0)
        cos2 = 1 - sin_alpha**2
        cos_mid = np.where(cos2 > 1e-15, cos_sigma - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2 > 1e-15, cos2, 1), 0)
        c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
        new = span + (1 - c) * FLATTENING * sin_alpha * (sigma + c * sin_sigma * (cos_mid + c * cos_sigma * (2 * cos_mid**2 - 1)))
        settled = np.abs(new - lam) < 1e-12
        lam = new
        if settled.all():
            break
    k = cos2 * (AXIS**2 - b**2) / b**2
    big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    delta = big_b * sin_sigma * (cos_mid + big_b / 4 * (cos_sigma * (2 * cos_mid**2 - 1) - big_b / 6 * cos_mid * (4 * sin_sigma**2 - 3) * (4 * cos_mid**2 - 3)))
    back = np.degrees(np.arctan2(np.cos(u1) * np.sin(lam), -np.sin(u1) * np.cos(u2) + np.cos(u1) * np.sin(u2) * np.cos(lam)) + np.pi) % 360
    return np.where(settled, b * big_a * (sigma - delta), np.nan), np.where(settled, back, np.nan)


class Rays:
    """S rays in a sphere of shells, each with a velocity that is a power of the radius.

    Within such a shell a ray's angle and time have closed forms in the shell's slowness u =
    radius / velocity, so that a whole batch of sources is traced by array arithmetic. A layer
    of the model (depth, velocity at its top and bottom) is a shell; thick layers are cut: those
    with a gradient as the model is linear between its depths, others to sample turning rays densely.
    """

    #: Largest thickness in km of a shell with a gradient, at the surface, and of any shell; samples of turning rays in a shell; rows traced at once.
    THICKNESS, UNIFORM, TURNS, ROWS = 5.0, 200.0, 16, 1000

    def __init__(self, model: np.ndarray, radius: float = EARTH_KM):
        edges: list[tuple[float, float, float, float]] = []
        for (z0, v0), (z1, v1) in zip(model[:-1], model[1:], strict=True):
            n = max(1, int(np.ceil((z1 - z0) / (self.UNIFORM if v0 == v1 else min(self.UNIFORM, self.THICKNESS + z0 / 10)))))
            cut = np.linspace(0, 1, n + 1)
            edges += [(z0 + (z1 - z0) * a, z0 + (z1 - z0) * b, v0 + (v1 - v0) * a, v0 + (v1 - v0) * b) for a, b in zip(cut[:-1], cut[1:], strict=True) if z1 > z0]
        if not edges:
            raise ValueError("a velocity model has at least one layer")
        top, bottom, v_top, v_bottom = np.array(edges, float).T
        self.radius, self.deepest = radius, min(float(bottom[-1]), radius - 1e-3)
        self.r_top, self.r_bottom = radius - top, np.maximum(radius - bottom, 1e-3)
        power = np.log(v_top / v_bottom) / np.log(self.r_top / self.r_bottom)
        # A shell of constant slowness has no closed form of this kind: it is bent a little.
        self.power = np.where(np.abs(1 - power) < 1e-6, power + 1e-6, power)
        self.v_top, self.e = v_top, 1 / (1 - self.power)
        self.u_top, self.u_bottom = self.r_top / v_top, self.slowness(np.arange(len(top)), self.r_bottom)
        self._tabulate()

    def slowness(self, shell: np.ndarray, r: np.ndarray) -> np.ndarray:
        return r / (self.v_top[shell] * (r / self.r_top[shell]) ** self.power[shell])

    @staticmethod
    def _angle(p: np.ndarray, u: np.ndarray) -> np.ndarray:
        return np.arccos(np.minimum(p / u, 1.0))

    @classmethod
    def _delay(cls, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Time less p times angle, whose derivative by p is minus the angle."""
        return np.sqrt(np.maximum(u * u - p * p, 0.0)) - p * cls._angle(p, u)

    def _tabulate(self) -> None:
        """Ray parameters that turn in each shell, falling; their angles from the surface to each shell and to the turning point."""
        low = np.minimum(self.u_top, self.u_bottom)
        above = np.minimum.accumulate(np.concatenate([[np.inf], low[:-1]]))
        p, shell = [np.zeros(0)], [np.zeros(0, int)]
        for k in range(len(low)):
            # A ray turns in a shell whose slowness falls below p on the way down, if it got there.
            lo, hi = self.u_bottom[k], min(self.u_top[k], above[k])
            if hi > lo:
                bend = (1 - np.cos(np.linspace(0, np.pi, self.TURNS))) / 2
                p.append(hi - (hi - lo) * np.clip(bend, 1e-9, 1 - 1e-9))
                shell.append(np.full(self.TURNS, k))
        self.p, self.turns = np.concatenate(p), np.concatenate(shell)
        q = self.p[:, None]
        angle = self.e * (self._angle(q, self.u_top) - self._angle(q, self.u_bottom))
        self.angle_to = np.hstack([np.zeros((len(self.p), 1)), np.cumsum(angle, 1)])
        self.whole_angle = self.angle_to[np.arange(len(self.p)), self.turns] + self.e[self.turns] * self._angle(self.p, self.u_top[self.turns])

    def _source(self, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shell and the slowness at a source; at a boundary, those of the shell above."""
        r = self.radius - np.clip(depth, 0.0, self.deepest)
        shell = np.clip(np.searchsorted(-self.r_bottom, -r), 0, len(self.r_top) - 1)
        return shell, self.slowness(shell, r)

    def _path(self, shell: np.ndarray, u_source: np.ndarray, turns: np.ndarray | None = None):
        """The angle and the delay, as functions of p, from sources up to the surface; with ``turns``, after going down to turn in those shells."""
        deepest = int((shell if turns is None else turns).max(initial=0)) + 1
        k, u_top, u_bottom, e = np.arange(deepest), self.u_top[:deepest], self.u_bottom[:deepest], self.e[:deepest]
        own = k == shell[:, None]
        bottom = np.where(own, u_source[:, None], u_bottom)
        up = np.where(k <= shell[:, None], e, 0.0)
        top = np.where(own, u_source[:, None], u_top)
        down = np.zeros_like(up) if turns is None else np.where((k >= shell[:, None]) & (k <= turns[:, None]), 2 * e, 0.0)

        def summed(part):
            def of(p: np.ndarray, rows=slice(None)) -> np.ndarray:
                q = p[:, None]
                out = (up[rows] * (part(q, u_top) - part(q, bottom[rows]))).sum(axis=1)
                # Where a ray turns, the part down to the slowness p is nothing.
                return out if turns is None else out + (down[rows] * (part(q, top[rows]) - part(q, u_bottom))).sum(axis=1)

            return of

        limit = np.where(k <= shell[:, None], np.minimum(u_top, bottom), np.inf).min(axis=1)
        return limit, summed(self._angle), summed(self._delay)

    @staticmethod
    def _solved(reach, angle: np.ndarray, short: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The p at which a path reaches its angle, between a p that falls short of it and one that doesn't.

        Chandrupatla's method: inverse quadratic interpolation where three points lie well for
        it, else a bisection. Only rows that are not settled are traced again.
        """
        row = np.arange(len(angle))
        out = (short + far) / 2
        tiny = np.finfo(float).tiny
        x1, x2 = far.astype(float), short.astype(float)
        # The ends have the signs they stand for: where rounding says otherwise, the search closes in on that end.
        f1, f2 = np.maximum(reach(x1) - angle, tiny), np.minimum(reach(x2) - angle, -tiny)
        width, t = np.abs(far - short) * 2.0**-48, np.full(len(angle), 0.5)
        for _ in range(100):
            if not len(row):
                break
            x = x1 + t * (x2 - x1)
            f = reach(x, row) - angle[row]
            same = (f < 0) == (f1 < 0)
            x3, f3 = np.where(same, x1, x2), np.where(same, f1, f2)
            x2, f2 = np.where(same, x2, x1), np.where(same, f2, f1)
            x1, f1 = x, f
            out[row] = np.where(np.abs(f1) <= np.abs(f2), x1, x2)
            span = np.abs(x2 - x1)
            least = np.maximum(width[row], 4e-16 * np.abs(x1))
            go = (span > 2 * least) & (f1 != 0)
            row, x1, x2, x3, f1, f2, f3, span, least = (v[go] for v in (row, x1, x2, x3, f1, f2, f3, span, least))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                xi, phi = (x1 - x2) / (x3 - x2), (f1 - f2) / (f3 - f2)
                bent = f1 / (f2 - f1) * f3 / (f2 - f3) + (x3 - x1) / (x2 - x1) * f1 / (f3 - f1) * f2 / (f3 - f2)
                t = np.where((phi * phi < xi) & ((1 - phi) ** 2 < 1 - xi) & np.isfinite(bent), bent, 0.5)
            t = np.clip(t, least / span, 1 - least / span)
        return out

    def upward(self, depth: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(p, seconds) of the rays that leave upward; NaN where none gets so far."""
        limit, reach, delay = self._path(*self._source(depth))
        possible = angle <= reach(limit)
        # Straight up every path is of no angle at a source on the surface: the ray is the vertical one.
        p = np.where(angle > 0, self._solved(reach, angle, np.zeros(len(depth)), limit), 0.0)
        return np.where(possible, p, np.nan), np.where(possible, delay(p) + p * angle, np.nan)

    def downward(self, depth: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(p, seconds) of the earliest rays that leave downward and turn; NaN where there is none.

        Ray parameters are bracketed along each branch of the table, which goes on into the next
        shell where the slowness does, and begins with the ray that leaves the source level.
        """
        found_p, found_t = np.full(len(depth), np.nan), np.full(len(depth), np.nan)
        if not len(self.p):
            return found_p, found_t
        shell, u_source = self._source(depth)
        q, u = self.p[None, :], u_source[:, None]
        valid = (q <= u) & (self.turns >= shell[:, None])
        part = self.angle_to[:, shell].T + self.e[shell][:, None] * (self._angle(q, self.u_top[shell][:, None]) - self._angle(q, u))
        beyond = np.where(valid, 2 * self.whole_angle - part - angle[:, None], np.nan)
        joined = (self.turns[1:] == self.turns[:-1]) | (np.abs(self.p[1:] - self.p[:-1]) <= 1e-6 * self.p[1:])
        row, at = np.nonzero((beyond[:, :-1] * beyond[:, 1:] <= 0) & joined)
        turns, one, two, rising = self.turns[at + 1], self.p[at], self.p[at + 1], beyond[row, at] < 0
        limit, reach, _ = self._path(shell, u_source)
        first = valid.argmax(axis=1)
        edge = beyond[np.arange(len(depth)), first]
        level = np.flatnonzero((limit >= u_source * (1 - 1e-12)) & valid.any(axis=1) & (self.turns[first] == shell) & ((reach(limit) - angle) * edge <= 0))
        row, turns = np.concatenate([row, level]), np.concatenate([turns, shell[level]])
        one, two = np.concatenate([one, limit[level]]), np.concatenate([two, self.p[first[level]]])
        rising = np.concatenate([rising, reach(limit)[level] < angle[level]])
        if not len(row):
            return found_p, found_t
        _, reach, delay = self._path(shell[row], u_source[row], turns)
        p = self._solved(reach, angle[row], np.where(rising, one, two), np.where(rising, two, one))
        time = delay(p) + p * angle[row]
        order = np.lexsort((time, row))
        best = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        found_p[row[best]], found_t[row[best]] = p[best], time[best]
        return found_p, found_t

    def first_arrival(self, depth: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seconds, takeoff, incidence) of the earliest S arrival at an angle in radians; degrees, takeoff from straight down."""
        out = np.full((3, len(depth)), np.nan)
        for lo in range(0, len(depth), self.ROWS):
            z, a = depth[lo : lo + self.ROWS], angle[lo : lo + self.ROWS]
            (p_up, t_up), (p_down, t_down) = self.upward(z, a), self.downward(z, a)
            up = ~(t_down < t_up) & ~np.isnan(t_up)
            p = np.where(up, p_up, p_down)
            leaving = np.degrees(np.arcsin(np.minimum(p / self._source(z)[1], 1.0)))
            out[:, lo : lo + self.ROWS] = np.where(up, t_up, t_down), np.where(up, 180 - leaving, leaving), np.degrees(np.arcsin(np.minimum(p / self.u_top[0], 1.0)))
        return tuple(out)


def great_circle(lat1, lon1, lat2, lon2) -> np.ndarray:
    """The angle between points on a sphere, in radians."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


OUTPUT = "s_travel_time_s double, takeoff_angle double, incidence_angle double, epi_distance_km double, hypo_distance_km double, backazimuth double, error string"


def screened(tasks: DataFrame, model: np.ndarray, max_incidence: float = 60.0, min_takeoff: float = 90.0) -> DataFrame:
    """Tasks with their geometry, or the reason why they lie outside the shear-wave window.

    tasks: event_latitude, event_longitude, event_depth_km, station_latitude, station_longitude and
    whatever else is carried along. Bounds themselves pass; null coordinates are a reason.
    """
    needed = ("event_latitude", "event_longitude", "event_depth_km", "station_latitude", "station_longitude")

    rays = Rays(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = pdf[list(needed)].notna().all(axis=1).to_numpy()
            made = {c.split()[0]: np.full(len(pdf), np.nan) for c in OUTPUT.split(", ")[:-1]}
            error = np.where(whole, None, "coordinates are missing").astype(object)
            part = pdf[whole]
            if len(part):
                place = [part[c].to_numpy(float) for c in (needed[0], needed[1], needed[3], needed[4])]
                depth = part["event_depth_km"].to_numpy(float)
                metres, back = inverse_geodesic(*place)
                time, takeoff, incidence = rays.first_arrival(depth, great_circle(*place))
                no_path, no_ray = np.isnan(metres), np.isnan(time)
                reason = np.full(len(part), None, object)
                for bad, says in ((takeoff < min_takeoff, lambda i: f"takeoff {takeoff[i]:.1f} is below {min_takeoff:.1f}"), (incidence > max_incidence, lambda i: f"incidence {incidence[i]:.1f} is above {max_incidence:.1f}"), (no_ray, lambda i: "no S arrival"), (no_path, lambda i: "no geodesic")):
                    for i in np.flatnonzero(bad):
                        reason[i] = says(i)
                values = (time, takeoff, incidence, metres / 1000, np.hypot(metres / 1000, depth), back)
                for name, v in zip(made, values, strict=True):
                    made[name][whole] = np.where(no_path, np.nan, v)
                error[whole] = reason
            yield pd.concat([pdf, pd.DataFrame(made | {"error": error}, index=pdf.index).astype(object).where(lambda x: x.notna(), None)], axis=1)

    names = [c.split()[0] for c in OUTPUT.split(", ")]
    kept = tasks.drop(*names)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", " + OUTPUT
    return kept.withColumns({c: F.col(c).cast("double") for c in needed}).mapInPandas(run, schema)
