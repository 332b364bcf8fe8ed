"""Angles, rotations, distances and splitting statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The one-sided 95 % point of the standard normal distribution.
Z95 = 1.6448536269514722


def rotate(a: Column, b: Column, degrees: Column) -> tuple[Column, Column]:
    """Clockwise rotation of (a, b): the components along and across the axis."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return c * a + s * b, c * b - s * a


def lqt(z: Column, n: Column, e: Column, back_azimuth: Column, incidence: Column) -> tuple[Column, Column, Column]:
    """Vertical, north and east to ray coordinates."""
    cb, sb = F.cos(F.radians(back_azimuth)), F.sin(F.radians(back_azimuth))
    ca, sa = F.cos(F.radians(incidence)), F.sin(F.radians(incidence))
    along = sb * e + cb * n
    return ca * z - sa * along, sa * z + ca * along, sb * n - cb * e


def axial(degrees: Column) -> Column:
    """An axis as an angle from 0 up to 180 degrees."""
    return F.pmod(degrees, F.lit(180.0))


def polarisation(var_n: Column, var_e: Column, cov_ne: Column) -> Column:
    """The azimuth of the larger principal axis of horizontal motion."""
    return axial(F.degrees(0.5 * F.atan2(2 * cov_ne, var_n - var_e)))


def eigenvalue_ratio(var_f: Column, var_s: Column, cov: Column) -> Column:
    """Smaller over larger eigenvalue of a 2 x 2 covariance matrix; null where both are 0."""
    mean, spread = var_f + var_s, F.sqrt((var_f - var_s) * (var_f - var_s) + 4 * cov * cov)
    return F.when(mean + spread > 0, (mean - spread) / (mean + spread))


def fisher_lower(r: Column, n: Column) -> Column:
    """Lower 95 % bound of a correlation from n points, by Fisher's transformation; null for |r| = 1 or n <= 3."""
    return F.when((F.abs(r) < 1) & (n > 3), F.tanh(F.atanh(r) - Z95 / F.sqrt(n - 3)))


def confidence_level(least: Column, n: Column) -> Column:
    """The 95 % contour of a minimised ratio for two parameters: the F quantile has a closed form then; null for n <= 2."""
    return F.when(n > 2, least * F.pow(F.lit(0.05), -2.0 / (n - 2)))


def quality_index(phi_rc: Column, dt_rc: Column, phi_ev: Column, dt_ev: Column, gamma: float) -> Column:
    """struct(q, delta, omega, class): nearness of the two methods' answers to a split (1, 0) or a null (0, 1).

    The angular difference is folded once, at 45 degrees; ratios are not bounded; distances
    are, at 1, and a tie counts as a split.
    """
    delta = F.when(dt_ev == 0, F.lit(0.0)).otherwise(F.try_divide(dt_rc, dt_ev))
    apart = F.abs(phi_rc - phi_ev)
    omega = F.abs(F.when(apart > 45, 90 - apart).otherwise(apart)) / 45.0
    split = F.least(F.sqrt((delta - 1) * (delta - 1) + omega * omega), F.lit(1.0))
    null = F.least(F.sqrt(delta * delta + (omega - 1) * (omega - 1)), F.lit(1.0))
    q = F.when(null < split, null - 1).otherwise(1 - split)
    return F.struct(q.alias("q"), delta.alias("delta"), omega.alias("omega"), quality_class(q, gamma).alias("class"))


def quality_class(q: Column, gamma: float) -> Column:
    return F.when(q >= gamma, F.lit("Good Split")).when(q <= -gamma, F.lit("Good Null")).when(q.isNotNull(), F.lit("Poor/Noise"))


def hypocentral(epicentral_km: Column, depth_km: Column) -> Column:
    return F.sqrt(epicentral_km * epicentral_km + depth_km * depth_km)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, 0 to 360 degrees."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def octaves(low: Column, high: Column) -> Column:
    return F.log2(F.try_divide(high, low))


def band_label(low: Column, high: Column) -> Column:
    return F.format_string("%.1f-%.1f Hz", low, high)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
