"""From fired events to stored results and comments: what a micro-batch runs."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fastaxis.operators import enrich, publish
from fastaxis.operators.outbox import Outbox
from fastaxis.operators.store import RESULTS, Store, canonical
from fastaxis.plans.cutting import cut
from fastaxis.sources import bus

log = logging.getLogger("fastaxis")

#: What a fired event's payload and the origin that fired with it hold.
EVENT = "event_id string, origin_id string, magnitude_id string"
ORIGIN = "origin_id string, origin_time timestamp, latitude double, longitude double, depth_km double"


@dataclass(frozen=True)
class Catalogue:
    """The tables that events refer to.

    origins (origin_id, origin_time, latitude, longitude, depth_km); magnitudes (magnitude_id,
    magnitude, magnitude_type); arrivals (origin_id, pick_id, phase, idx); picks (pick_id,
    network, station, location, channel, pick_time, hint); stations (network, station, start, end,
    latitude, longitude, elevation_m); published (pick_id) or None; channels (network, station,
    location, code, start, end, azimuth, dip) or None.
    """

    origins: DataFrame
    magnitudes: DataFrame
    arrivals: DataFrame
    picks: DataFrame
    stations: DataFrame
    published: DataFrame | None = None
    channels: DataFrame | None = None


def fired(batch: DataFrame) -> DataFrame:
    """(event_id, origin_id, magnitude_id, origin) of fired payloads and their companions; origin is null where none was announced."""
    read = batch.select(F.from_json("payload", EVENT).alias("e"), F.from_json(F.col("companion") if "companion" in batch.columns else F.lit(None).cast("string"), ORIGIN).alias("o"))
    # An origin without a place or a time can't be one.
    known = F.when(F.col("o.origin_time").isNotNull() & F.col("o.latitude").isNotNull() & F.col("o.longitude").isNotNull(), F.col("o"))
    events = read.select("e.event_id", F.coalesce("e.origin_id", "o.origin_id").alias("origin_id"), "e.magnitude_id", known.alias("origin"))
    return events.filter("event_id is not null").dropDuplicates(["event_id"])


def tasks(events: DataFrame, c: Catalogue, reprocess: bool = False) -> DataFrame:
    """One row per S pick of the events (event_id, origin_id, magnitude_id, and perhaps origin): pick, event, origin and station.

    The origin that was announced with an event is used; where none was, the catalogue's. An event without
    its origin has no row; a missing magnitude or station leaves nulls.
    """
    names = {"origin_time": "origin_time", "latitude": "event_latitude", "longitude": "event_longitude", "depth_km": "event_depth_km"}
    looked = events.join(c.origins.select("origin_id", *[F.col(k).alias(v) for k, v in names.items()]), "origin_id")
    if "origin" in events.columns:
        announced = events.filter("origin is not null").select("*", *[F.col(f"origin.{k}").alias(v) for k, v in names.items()])
        looked = looked.filter("origin is null").unionByName(announced).drop("origin")
    sourced = looked.join(c.magnitudes, "magnitude_id", "left")
    arrivals = enrich.last_arrivals(c.arrivals.withColumn("key", F.struct("origin_id", "pick_id")), "key", "idx", "phase").select("key.origin_id", "key.pick_id", "phase")
    picked = sourced.join(arrivals, "origin_id").join(c.picks, "pick_id").filter(enrich.is_s_phase(F.col("phase"), F.col("hint")))
    if c.published is not None and not reprocess:
        picked = enrich.unprocessed(picked, c.published, "pick_id")
    site = F.concat_ws(".", "network", "station")
    inventory = c.stations.select(site.alias("site"), "start", "end", F.col("latitude").alias("station_latitude"), F.col("longitude").alias("station_longitude"), F.col("elevation_m").alias("station_elevation_m"))
    placed = enrich.as_of(picked.withColumn("site", site), inventory, "site", "pick_time").drop("site", "start", "end")
    if c.channels is not None:
        at = placed.select(F.col("pick_id").alias("pick"), site.alias("station"), "location", F.substring("channel", 1, 2).alias("prefix"), F.col("pick_time").alias("at"))
        directions = enrich.orientations(at, c.channels.withColumn("station", F.concat_ws(".", "network", "station")))
        placed = placed.join(directions.withColumnRenamed("pick", "pick_id"), "pick_id", "left")
    else:
        placed = placed.withColumn("orientations", F.lit(None).cast("map<string,struct<azimuth:double,dip:double>>"))
    return placed.withColumn("seed_id", enrich.seed_id(*[F.col(x) for x in ("network", "station", "location", "channel")]))


def outcomes(found: DataFrame, measured: DataFrame, run_id: int) -> DataFrame:
    """The result rows of tasks: (pick_id, error and result columns) of ``measured`` beside them.

    Tasks without a measurement and measurements without a task are left out.
    """
    rows = found.drop("error", *[c for c in measured.columns if c != "pick_id"]).join(measured, "pick_id")
    status = F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("failed"))
    consensus = F.coalesce("consensus_used", F.lit(False)) if "consensus_used" in rows.columns else F.lit(False)
    return canonical(rows.withColumns({"status": status, "comment": F.col("error"), "run_id": F.lit(run_id).cast("long"), "consensus_used": consensus, "updated_utc": F.current_timestamp()}))


def derive(rows: DataFrame, store: Store, version: str, comments: Callable[[DataFrame], None]) -> None:
    """What follows from the outcomes of a batch: stored results and comments. Again, it changes neither."""
    store.upsert(rows)
    worth = publish.comments(rows.withColumn("error", F.when(F.col("status") != "ok", F.coalesce("comment", F.lit("failed")))), version, F.col("updated_utc"))
    if not worth.isEmpty():
        comments(worth)


def processor(catalogue: Callable[[], Catalogue], measure: Callable[[DataFrame], DataFrame], store: Store, run_id: int, version: str, comments_path: str, reprocess: bool = False, outbox: Outbox | None = None) -> Callable[[DataFrame, int], None]:
    """The function that a stream of fired events hands its batches to.

    The batch's payloads are JSON of event_id, origin_id and magnitude_id. ``measure`` takes the
    tasks and returns (pick_id, error, results), as picks.measurer() makes it; it gives each pick that it
    can't measure its reason. A batch that can't be measured as a whole is measured event by event, so that
    one event's failure keeps no other from the store; an event that fails alone goes to the log and is not
    tried again, as its key has fired.

    A batch is named by its stream and number, which a restarted stream repeats. Its outcomes are
    committed once, and store, counters and comments are derived from them: a batch that was lost at any
    step goes on from there when the stream is restarted. comments_path is a folder of the bus.
    """
    outbox = outbox or Outbox(store.spark, f"{store.path}/outcomes")
    none = store.spark.createDataFrame([], RESULTS)

    def measured(events: DataFrame) -> DataFrame | None:
        """The events' outcomes; None if two of them have a pick in common, as a measurement is known by its pick."""
        found = cut(tasks(events, catalogue(), reprocess))
        if found.isEmpty():
            return none
        if not found.groupBy("pick_id").count().filter("count > 1").isEmpty():
            return None
        return cut(outcomes(found, measure(found), run_id))

    def one_by_one(events: DataFrame) -> DataFrame:
        # A micro-batch holds the events of seconds.
        out = none
        for event in events.select("event_id").toLocalIterator():
            try:
                alone = measured(events.filter(F.col("event_id") == event.event_id))
                if alone is None:
                    raise ValueError("a pick occurs twice in the event")
                out = out.unionByName(alone)
            except Exception:
                log.exception("event %s failed", event.event_id)
        return out

    def run(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        name = f"{stream}-{number}"
        rows = outbox.committed(name)
        if rows is None:
            events = cut(fired(batch))
            if events.isEmpty():
                return
            try:
                found = measured(events)
            except Exception:
                log.exception("batch %s failed; its events are tried one by one", number)
                found = None
            rows = outbox.commit(name, one_by_one(events) if found is None else found)
        if not rows.isEmpty():
            derive(rows, store, version, lambda worth: bus.send(publish.as_messages(worth), comments_path, bus.COMMENTS, name))

    return run
