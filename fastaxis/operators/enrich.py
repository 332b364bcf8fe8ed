"""Joins and predicates that turn bus objects into measurement tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def phase_of(arrival_phase: Column, hint: Column) -> Column:
    """The arrival's phase if there is one, else the pick's hint, else an empty string."""
    return F.coalesce(F.when(arrival_phase != "", arrival_phase), hint, F.lit(""))


def is_s_phase(arrival_phase: Column, hint: Column) -> Column:
    return F.upper(phase_of(arrival_phase, hint)).startswith("S")


def last_arrivals(arrivals: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row per pick: of several arrivals the last."""
    return arrivals.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("a")).select(key, *[F.col(f"a.{v}").alias(v) for v in values])


def unprocessed(picks: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Picks that nothing was published for."""
    return picks.join(published.select(key), key, "left_anti")


def seed_id(net: Column, sta: Column, loc: Column, cha: Column) -> Column:
    """NET.STA.LOC.CHA; a missing part is empty, so that there are always four."""
    return F.concat_ws(".", *[F.coalesce(c, F.lit("")) for c in (net, sta, loc, cha)])


def seed_parts(seed: Column) -> Column:
    """struct(network, station, location, channel), null unless there are four parts."""
    p = F.split(seed, r"\.")
    return F.when(F.size(p) == 4, F.struct(*[F.element_at(p, i).alias(n) for i, n in enumerate(("network", "station", "location", "channel"), 1)]))


def as_of(events: DataFrame, epochs: DataFrame, key: str, at: str) -> DataFrame:
    """Left join with the epoch (key, start, end) that holds at an event's time; an open end holds for ever, both ends count.

    Of several epochs the last that began. Equality on the key lets Spark shuffle both sides
    by it (or broadcast the epochs if they are small); the interval is a condition of the
    same join. Equal events each keep their row.
    """
    others = [c for c in epochs.columns if c != key]
    right = epochs.select(F.col(key).alias("_key"), F.struct(*others).alias("_epoch"))
    holds = (F.col(key) == F.col("_key")) & (F.col("_epoch.start") <= F.col(at)) & (F.col("_epoch.end").isNull() | (F.col("_epoch.end") >= F.col(at)))
    # One epoch for each key and time; events are joined to it, so that equal ones stay apart.
    found = events.select(key, at).distinct().join(right, holds).groupBy(key, at).agg(F.max_by("_epoch", "_epoch.start").alias("_epoch"))
    return events.join(found, [key, at], "left").select(*events.columns, *[F.col(f"_epoch.{c}").alias(c) for c in others])


def orientations(picks: DataFrame, channels: DataFrame) -> DataFrame:
    """(pick, orientations): a map from channel code to (azimuth, dip) of the epochs that hold at the pick.

    picks: (pick, station, prefix, at); channels: (station, code, start, end, azimuth, dip); both
    with the sensor's location, of which none and a blank are the same. The location is equal and the
    code begins with the prefix; channels without a start or an orientation don't count; of one
    code the last epoch does.
    """
    place = lambda df: F.trim(F.coalesce(df["location"], F.lit(""))) if "location" in df.columns else F.lit("")
    c = channels.filter("start is not null and azimuth is not null and dip is not null").withColumn("_place", place(channels))
    p = picks.withColumn("_place", place(picks))
    holds = (p["station"] == c["station"]) & (p["_place"] == c["_place"]) & c["code"].startswith(p["prefix"]) & (c["start"] <= p["at"]) & (c["end"].isNull() | (c["end"] >= p["at"]))
    one = p.join(c, holds).groupBy(p["pick"], c["code"]).agg(F.max_by(F.struct("azimuth", "dip"), c["start"]).alias("o"))
    maps = one.groupBy("pick").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "o")))).alias("orientations"))
    return picks.select("pick").distinct().join(maps, "pick", "left")


def first_reason(**reasons: Column) -> Column:
    """The first reason against a pick, in the order given; null if nothing is against it."""
    return F.coalesce(*[F.when(c, F.lit(name.replace("_", " "))) for name, c in reasons.items()])


def rejected(df: DataFrame, reason: Column, key: str) -> DataFrame:
    """A rejected row keeps its key and the reason only; no row is dropped."""
    marked = df.withColumn("error", reason)
    return marked.select(key, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in df.columns if c != key], "error")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the last in the order."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")
