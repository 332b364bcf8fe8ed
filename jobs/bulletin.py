"""The bulletin of results: what an observatory hands out every month, and its stations' records.

    python -m jobs.bulletin --input TABLES --output FOLDER [--config FILE]

Reads the tables of results (or, with ``source: store``, the results table of a store), keeps the last
result of each event and station, and writes

* OUTPUT/bulletin: CSV in partitions (year, month) of the results that the settings choose, with the
  columns of the query interface's CSV form, numbers of the filter to six decimals;
* OUTPUT/stations: Parquet in partitions (year) of each station's counts, mean and best quality over all
  of its results.

A partition is replaced as a whole, so that a run over the same tables leaves the same files' rows,
and one that was lost is repeated. Partitions that the tables no longer have stay. A result without an
origin time belongs to no month: it is counted in the log and left out. Without results, nothing is
written but empty folders. The rows of a month are rebalanced, so that a hot one is several files.
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastaxis.functions import geometry as g
from fastaxis.operators import query
from fastaxis.operators.enrich import latest
from fastaxis.operators.store import Store
from fastaxis.plans.cutting import cut
from fastaxis.plans.views import RESULTS
from fastaxis.sources import tables
from jobs import common

log = logging.getLogger("jobs.bulletin")
CONFIG = Path(__file__).with_suffix(".yaml")
DEFAULTS: dict[str, Any] = {"source": "tables", "gamma": 0.75, "status": "ok", "min_magnitude": 1.0, "min_quality": 0.25, "start_time": "", "end_time": ""}
#: Columns of the bulletin, by the names of the CSV form, and their types when it is read back.
BULLETIN = (
    "event_id string, event_origin_time_utc string, event_latitude_deg double, event_longitude_deg double, event_depth_km double, event_magnitude double, station_network_code string, station_code string, station_latitude_deg double, station_longitude_deg double, path_epicentral_km double, "
    "ev_l_r double, linearity_test string, filter string, filter_snr double, filter_bandwidth_oct double, filter_score double, qc_qfinal double, qc_class string, status string"
)
STATIONS = "network string, station string, n_ok long, n_failed long, n_good_split long, n_good_null long, mean_qfinal double, best_event string, year int"
NUMBERS = ("filter_bandwidth_oct", "filter_score")


def results(spark: SparkSession, source: str, settings: dict[str, Any]) -> DataFrame:
    """The last result of each event and station, with its quality class."""
    if settings["source"] == "store":
        found = Store(spark, source).table("results")
        if found is None:
            raise common.SettingsError(f"{source}: no results are stored there")
        return latest(found, ["event_id", "network", "station"], F.desc_nulls_last("updated_utc"), F.desc("pick_id"))
    found = tables.results(spark, source).withColumn("quality_class", g.quality_class(F.col("qfinal"), settings["gamma"]))
    return latest(found, ["event_id", "network", "station"], F.desc_nulls_last("origin_time"), F.desc("magnitude"))


def bulletin(found: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """The chosen results in the CSV form, with year and month."""
    chosen = query.matching(found, status=settings["status"], min_magnitude=settings["min_magnitude"], start_time=settings["start_time"] or None, end_time=settings["end_time"] or None)
    # Good nulls are as sure as good splits: the bound is on the size of the quality.
    sure = chosen.filter((F.abs("qfinal") >= settings["min_quality"]) & F.col("origin_time").isNotNull())
    rows = query.csv_rows(sure)
    when = F.col("event_origin_time_utc")
    names = [c.split()[0] for c in BULLETIN.split(", ")]
    return rows.select(*[F.round(F.col(c), 6).alias(c) if c in NUMBERS else F.col(c) for c in names], F.substring(when, 1, 4).cast("int").alias("year"), F.substring(when, 6, 2).cast("int").alias("month"))


def stations(found: DataFrame) -> DataFrame:
    """Counts, mean quality (of whole millionths, so that no mean depends on an order) and best event of each station and year."""
    year = F.year("origin_time").alias("year")
    good = F.col("quality_class")
    millionths = F.round(F.col("qfinal") * 1_000_000).cast("long")
    best = F.max_by(F.col("event_id").cast("string"), F.when(F.col("qfinal").isNotNull(), F.struct("qfinal", F.col("event_id").cast("string"))))
    return found.filter("origin_time is not null").groupBy("network", "station", year).agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(good == "Good Split").alias("n_good_split"),
        F.count_if(good == "Good Null").alias("n_good_null"),
        F.try_divide(F.sum(millionths), F.count("qfinal") * F.lit(1_000_000.0)).alias("mean_qfinal"),
        best.alias("best_event"),
    )


def run(spark: SparkSession, source: str, output: str, settings: dict[str, Any] | None = None) -> tuple[int, int]:
    """Writes both outputs; the numbers of bulletin rows and of station rows."""
    settings = settings or common.settings(CONFIG, DEFAULTS)
    # Both outputs read the joined results: they are computed once.
    found = cut(results(spark, source, settings))
    read = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin_time").isNull()).alias("timeless")).first()
    log.info("%s: %s results read, %s of them without a time", source, read.n, read.timeless)
    rows, years = bulletin(found, settings), stations(found)
    common.replace_partitions(years, f"{output}/stations", "year")
    common.replace_partitions(rows, f"{output}/bulletin", "year", "month", form="csv", header=True, emptyValue="", nullValue="")
    wrote = rows.count(), years.count()
    log.info("%s: %s bulletin rows and %s station years written", output, *wrote)
    return wrote


def tables_of(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The bulletin and the stations as they stand."""
    rows = spark.read.schema(f"{BULLETIN}, year int, month int").csv(f"{output}/bulletin", header=True, nullValue="")
    return rows, spark.read.schema(STATIONS).parquet(f"{output}/stations")


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.bulletin", description=__doc__.split("\n\n")[0], allow_abbrev=False)
    p.add_argument("--input", required=True, help="folder of the tables of results, or of a store")
    p.add_argument("--output", required=True, help="folder of the bulletin and the stations")
    p.add_argument("--config", default=str(CONFIG), help="settings, a YAML file")
    args = p.parse_args(argv)
    try:
        settings = common.settings(args.config, DEFAULTS)
    except (OSError, ValueError) as e:
        p.error(str(e))
    spark = common.session("bulletin")
    try:
        run(spark, args.input, args.output, settings)
    finally:
        spark.stop()
    return 0


def job2_bulletin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulletin of all results after two runs, each row beside its station's year."""
    folder = common.new_folder(spark, "bulletin")
    for _ in range(2):
        run(spark, sf_dir, folder)
    rows, years = tables_of(spark, folder)
    return rows.join(years.withColumnsRenamed({"network": "station_network_code", "station": "station_code"}), ["station_network_code", "station_code", "year"], "full")


SQL = f"""WITH {RESULTS},
q AS (SELECT *, CASE WHEN qfinal >= 0.75 THEN 'Good Split' WHEN qfinal <= -0.75 THEN 'Good Null' WHEN qfinal IS NOT NULL THEN 'Poor/Noise' END AS class,
  CASE WHEN filter_low IS NOT NULL AND filter_high IS NOT NULL THEN log2(filter_high / filter_low) END AS width FROM v_results),
b AS (SELECT event_id::VARCHAR AS event_id, strftime(origin_time, '%Y-%m-%dT%H:%M:%S+00:00') AS event_origin_time_utc, event_latitude AS event_latitude_deg, event_longitude AS event_longitude_deg, event_depth_km, magnitude AS event_magnitude,
  network AS station_network_code, station AS station_code, station_latitude AS station_latitude_deg, station_longitude AS station_longitude_deg, epi_distance_km AS path_epicentral_km, ev_linearity AS ev_l_r,
  CASE WHEN ev_linearity <= 0.15 THEN 'linear' WHEN ev_linearity IS NOT NULL THEN 'non-linear' END AS linearity_test, CASE WHEN width IS NOT NULL THEN printf('%.1f-%.1f Hz', round(filter_low + 1e-9, 1), round(filter_high + 1e-9, 1)) END AS filter,
  snr AS filter_snr, round(width, 6) AS filter_bandwidth_oct, round(snr * width, 6) AS filter_score, qfinal AS qc_qfinal, class AS qc_class, status, year(origin_time)::INTEGER AS year, month(origin_time)::INTEGER AS month
  FROM q WHERE status = 'ok' AND magnitude >= 1 AND abs(qfinal) >= 0.25),
s AS (SELECT network AS station_network_code, station AS station_code, year(origin_time)::INTEGER AS year, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (class = 'Good Split') AS n_good_split, count(*) FILTER (class = 'Good Null') AS n_good_null,
  sum(round(qfinal * 1000000)::BIGINT)::DOUBLE / (count(qfinal) * 1000000.0::DOUBLE) AS mean_qfinal, (max(struct_pack(q := qfinal, e := event_id::VARCHAR)) FILTER (qfinal IS NOT NULL)).e AS best_event
  FROM q GROUP BY ALL)
SELECT * FROM b FULL JOIN s USING (station_network_code, station_code, year)"""

if __name__ == "__main__":
    sys.exit(main())
