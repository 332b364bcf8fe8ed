"""The pick pipeline: tasks in, one result per pick out, with its reason where there is no measurement.

Screens are expressions and a batch pass over rays; a pick's segments meet by one shuffle, and
everything from the record to the result is one pass over each pick's own samples. A pick that
is refused or fails keeps its id and the reason only; it never fails its batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.operators import enrich, raypath
from fastaxis.operators.measure import Rejected, Segment, guarded, measure, prepared
from fastaxis.plans.cutting import cut

#: What a measurement adds to its task.
PATH = "epi_distance_km double, hypo_distance_km double, backazimuth double, incidence_angle double, takeoff_angle double, s_travel_time_s double"
MEASURED = (
    "ev_phi double, ev_phi_err double, ev_dt_ms double, ev_dt_err_ms double, ev_spol double, ev_cc_fs double, ev_cc_ne double, ev_linearity double, "
    "rc_phi double, rc_phi_err double, rc_dt_ms double, rc_dt_err_ms double, rc_spol double, rc_cc_fs double, rc_cc_ne double, "
    "qfinal double, qmean double, qbest double, delta double, omega double, quality_class string, "
    "n_windows int, n_cluster_windows int, n_clusters int, n_in_cluster int, filter_low double, filter_high double, snr double, dominant_period_s double, "
    "rotation_mode string, consensus_used boolean, n_filters_used int, meta_json string"
)


#: Arrow's types of the answers' numbers.
_ARROW = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}


def _samples(data: pa.ListScalar) -> np.ndarray:
    return np.asarray(data.values.to_numpy(zero_copy_only=False) if data.is_valid else None, float)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def screened(tasks: DataFrame, model: np.ndarray, config: Any) -> DataFrame:
    """Tasks with their rays, and ``error``: the first reason against each before any waveform is read."""
    sws = config.sws
    listed = F.col("station").isin(*sws.blacklist_stations) if sws.blacklist_stations else F.lit(False)
    early = enrich.first_reason(station_is_blacklisted=listed, station_coordinates_are_missing=F.col("station_latitude").isNull() | F.col("station_longitude").isNull())
    # A refused task has no coordinates for the rays, so that none is traced for it.
    known = tasks.drop("error").withColumn("_early", early)
    hidden = [c for c in ("event_latitude", "event_longitude", "event_depth_km") if c in tasks.columns]
    rays = raypath.screened(known.withColumns({f"_{c}": F.col(c) for c in hidden}).withColumns({c: F.when(F.col("_early").isNull(), F.col(c)) for c in hidden}), model, sws.max_ain, sws.min_tkf)
    return rays.withColumns({c: F.col(f"_{c}") for c in hidden}).withColumn("error", F.coalesce("_early", "error")).drop("_early", *[f"_{c}" for c in hidden])


def results(tasks: DataFrame, fetch: Callable[[DataFrame], DataFrame], model: np.ndarray, config: Any) -> DataFrame:
    """(pick_id, PATH, MEASURED, error) of each task.

    tasks: pick_id (unique), pick_time, network, station, location, channel, the event's and the
    station's coordinates, and ``orientations``, a map from channel to (azimuth, dip) or null.
    ``fetch`` takes (pick, network, station, location, prefix, at) and gives (pick, channel,
    start in seconds, rate, data); several rows of a channel are segments.
    """
    found = cut(screened(tasks, model, config))
    inside = found.filter("error is null")
    wanted = inside.select(F.col("pick_id").alias("pick"), "network", "station", F.coalesce("location", F.lit("")).alias("location"), F.substring("channel", 1, 2).alias("prefix"), F.col("pick_time").alias("at"))
    records = fetch(wanted).select(F.col("pick").alias("pick_id"), F.col("channel").alias("_channel"), F.col("start").cast("double").alias("_start"), F.col("rate").cast("double").alias("_rate"), F.col("data").cast("array<double>").alias("_data"))
    path = _names(PATH)
    directions = F.transform(F.map_entries("orientations"), lambda x: F.struct(x["key"].alias("code"), x["value"]["azimuth"].cast("double").alias("azimuth"), x["value"]["dip"].cast("double").alias("dip")))
    tasked = inside.select("pick_id", (F.unix_micros(F.col("pick_time").cast("timestamp")) / 1e6).alias("_at"), directions.alias("_directions"), *path)
    wave = config.waveform

    def run(rows: pa.Table) -> pa.Table:
        one = rows.select(["pick_id", "_at", "_directions", *path]).slice(0, 1).to_pylist()[0]

        def work() -> dict[str, Any]:
            numbers = [rows[c].to_numpy().tolist() for c in ("_start", "_rate")]
            segments = [Segment(channel, start, rate, _samples(data)) for channel, start, rate, data in zip(rows["_channel"].to_pylist(), *numbers, rows["_data"], strict=True) if channel is not None]
            if not segments:
                raise Rejected("no waveform data")
            known = {d["code"]: (d["azimuth"], d["dip"]) for d in (one["_directions"] or []) if d["azimuth"] is not None and d["dip"] is not None}
            zne, start = prepared(segments, known, wave.min_gap, wave.target_sampling_rate, wave.decimate)
            at, back_azimuth, incidence = (math.nan if one[c] is None else one[c] for c in ("_at", "backazimuth", "incidence_angle"))
            return {c: one[c] for c in path} | measure(zne, at - start, back_azimuth, incidence, config)

        made = {"pick_id": one["pick_id"]} | guarded(work)
        own = {"key": rows.schema.field("pick_id").type, "string": rows.schema.field("_channel").type} | _ARROW
        return pa.table({c: pa.array([made.get(c)], own[name], from_pandas=True) for c, name in [("pick_id", "key"), *answers]})

    kind = dict(tasks.dtypes)["pick_id"]
    schema = f"pick_id {kind}, {PATH}, {MEASURED}, error string"
    answers = [c.split() for c in f"{PATH}, {MEASURED}, error string".split(", ")]
    # So many tasks as there are shuffle partitions, however few bytes the records have: a pick's measurement is long.
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    measured = tasked.repartition(parts, "pick_id").join(records.repartition(parts, "pick_id"), "pick_id", "left").groupBy("pick_id").applyInArrow(run, schema)
    refused = found.filter("error is not null").select("pick_id", "error")
    return measured.unionByName(refused, allowMissingColumns=True)


def measurer(fetch: Callable[[DataFrame], DataFrame], model: np.ndarray, config: Any) -> Callable[[DataFrame], DataFrame]:
    """The function by which a stream of tasks is measured: service.processor() takes it."""
    return lambda tasks: results(tasks, fetch, model, config)
