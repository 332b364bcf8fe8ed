"""The query interface over stored results: filters, order, limit, and the CSV and JSON forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fastaxis.functions.geometry import band_label, octaves

MAX_ROWS, DEFAULT_ROWS, LINEAR = 100_000, 10_000, 0.15
EQUAL = ("event_id", "network", "station", "quality_class", "status")
RANGES = ("event_latitude", "event_longitude", "event_depth_km", "magnitude", "station_latitude", "station_longitude", "epi_distance_km", "qfinal")
#: Columns of the CSV form in order, with the stored column each holds (fixed values; null: computed here).
CSV = {
    "id": "id", "event_id": "event_id", "event_origin_time_utc": "origin_time", "event_latitude_deg": "event_latitude", "event_longitude_deg": "event_longitude", "event_depth_km": "event_depth_km", "event_magnitude": "magnitude", "event_magnitude_type": "magnitude_type",
    "station_network_code": "network", "station_code": "station", "station_latitude_deg": "station_latitude", "station_longitude_deg": "station_longitude", "station_elevation_m": "station_elevation_m",
    "path_epicentral_km": "epi_distance_km", "path_backazimuth_deg": "backazimuth", "path_incidence_deg": "incidence_angle", "path_takeoff_deg": "takeoff_angle", "path_travel_time_P_s": None, "path_travel_time_S_s": "s_travel_time_s",
    "ev_phi_deg": "ev_phi", "ev_phi_err_deg": "ev_phi_err", "ev_dt_ms": "ev_dt_ms", "ev_dt_err_ms": "ev_dt_err_ms", "ev_spol_deg": "ev_spol", "ev_cc_fs": "ev_cc_fs", "ev_cc_ne": "ev_cc_ne", "ev_l_r": "ev_linearity", "ev_t_dominant_s": "dominant_period_s",
    "rc_phi_deg": "rc_phi", "rc_phi_err_deg": "rc_phi_err", "rc_dt_ms": "rc_dt_ms", "rc_dt_err_ms": "rc_dt_err_ms", "rc_spol_deg": "rc_spol", "rc_cc_fs": "rc_cc_fs", "rc_cc_ne": "rc_cc_ne", "rc_cc_fs_corr": "rc_cc_fs", "rc_t_dominant_s": "dominant_period_s",
    "qc_qfinal": "qfinal", "qc_qmean": "qmean", "qc_qbest": "qbest", "qc_n_windows": "n_cluster_windows", "qc_delta": "delta", "qc_omega": "omega", "qc_class": "quality_class",
    "linearity_test": None, "filter": None, "filter_snr": "snr", "filter_bandwidth_oct": None, "filter_score": None, "n_windows": "n_windows",
    "status": "status", "comment": "comment", "run_id": "run_id", "updated_utc": "updated_utc",
}


class InvalidQuery(ValueError):
    """A parameter that the interface does not know or accept."""


def matching(results: DataFrame, status: str | None = "ok", start_time: datetime | str | None = None, end_time: datetime | str | None = None, **given) -> DataFrame:
    """All rows that meet all given parameters.

    Equality by EQUAL, inclusive bounds min_ and max_ of RANGES and of the origin time. A row
    without a value never meets a bound on it. status None or "all" takes every row. The
    filters are plain comparisons, so they reach the scan.
    """
    if status not in (None, "all", "ok", "failed"):
        raise InvalidQuery("status must be ok, failed or all")
    bounds = {f"{side}_{c}": (c, side) for c in RANGES for side in ("min", "max")}
    if unknown := sorted(set(given) - set(EQUAL) - set(bounds)):
        raise InvalidQuery(f"unknown parameters: {', '.join(unknown)}")
    df = results
    if status not in (None, "all"):
        df = df.filter(F.col("status") == status)
    for name, value in given.items():
        if value is None:
            continue
        if name in EQUAL:
            df = df.filter(F.col(name) == value)
        else:
            column, side = bounds[name]
            df = df.filter(F.col(column) >= value if side == "min" else F.col(column) <= value)
    if start_time is not None:
        df = df.filter(F.col("origin_time") >= F.lit(start_time).cast("timestamp"))
    if end_time is not None:
        df = df.filter(F.col("origin_time") <= F.lit(end_time).cast("timestamp"))
    return df


def query_results(results: DataFrame, limit: int = DEFAULT_ROWS, **given) -> DataFrame:
    """Rows that meet all given parameters, as matching() takes them, newest first."""
    if not isinstance(limit, int) or not 1 <= limit <= MAX_ROWS:
        raise InvalidQuery(f"limit must be 1 to {MAX_ROWS}")
    tie = [c for c in ("event_id", "network", "station") if c in results.columns]
    return matching(results, **given).orderBy(F.desc_nulls_first("origin_time"), *tie).limit(limit)


def linearity(ratio: Column) -> Column:
    return F.when(ratio <= LINEAR, F.lit("linear")).when(ratio.isNotNull(), F.lit("non-linear"))


def filter_columns(low: Column, high: Column, snr: Column) -> dict[str, Column]:
    """Label, octaves and score of a band; null unless both corners are there."""
    both = low.isNotNull() & high.isNotNull()
    width = F.when(both, octaves(low, high))
    return {"filter": F.when(both, band_label(low, high)), "filter_bandwidth_oct": width, "filter_score": snr * width}


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def csv_rows(results: DataFrame) -> DataFrame:
    """The CSV form's columns; what a table lacks is null."""
    has = lambda c: F.col(c) if c in results.columns else F.lit(None)
    made = filter_columns(has("filter_low").cast("double"), has("filter_high").cast("double"), has("snr").cast("double"))
    made |= {"linearity_test": linearity(has("ev_linearity").cast("double")), "path_travel_time_P_s": F.lit(None).cast("double")}
    for name, column in CSV.items():
        if column is not None:
            made[name] = iso(has(column)) if column in ("origin_time", "updated_utc") and column in results.columns else has(column)
    return results.select(*[made[c].alias(c) for c in CSV])


def write_csv(results: DataFrame, path: str) -> None:
    csv_rows(results).withColumns({c: F.col(c).cast("string") for c in CSV}).write.csv(path, header=True, nullValue="", emptyValue="")


def json_rows(results: DataFrame, include_meta: bool = True) -> DataFrame:
    """One JSON object per row, nulls and all; times as ISO strings. Without ``include_meta`` the notes on filters stay out."""
    results = results if include_meta else results.drop("meta_json")
    times = {f.name: iso(F.col(f.name)) for f in results.schema if f.dataType.typeName() in ("timestamp", "timestamp_ntz")}
    shown = [times.get(c, F.col(c)).alias(c) for c in results.columns]
    return results.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def rendered(results: DataFrame, form: str = "csv", include_meta: bool = True) -> DataFrame:
    if form not in ("csv", "json"):
        raise InvalidQuery("format must be csv or json")
    return csv_rows(results) if form == "csv" else json_rows(results, include_meta)


def query_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= MAX_ROWS:
        raise InvalidQuery(f"limit must be 1 to {MAX_ROWS}")
    return runs.orderBy(F.desc("run_id")).limit(limit)
