"""The results store: Parquet tables of results and runs, with upserts by event and station."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fastaxis.operators.enrich import latest
from fastaxis.plans.cutting import cut

KEY = ["event_id", "network", "station"]
SCHEMAS = ("results", "runs")
#: The columns of the results table, in order: event, station, path, both methods, quality, processing, bookkeeping.
RESULTS = (
    "event_id string, origin_id string, origin_time timestamp, event_latitude double, event_longitude double, event_depth_km double, magnitude double, magnitude_type string, "
    "network string, station string, location string, channel string, station_latitude double, station_longitude double, station_elevation_m double, "
    "epi_distance_km double, hypo_distance_km double, backazimuth double, incidence_angle double, takeoff_angle double, s_travel_time_s double, "
    "ev_phi double, ev_phi_err double, ev_dt_ms double, ev_dt_err_ms double, ev_spol double, ev_cc_fs double, ev_cc_ne double, ev_linearity double, "
    "rc_phi double, rc_phi_err double, rc_dt_ms double, rc_dt_err_ms double, rc_spol double, rc_cc_fs double, rc_cc_ne double, "
    "qfinal double, qmean double, qbest double, delta double, omega double, quality_class string, "
    "n_windows int, n_cluster_windows int, n_clusters int, n_in_cluster int, filter_low double, filter_high double, snr double, dominant_period_s double, "
    "rotation_mode string, consensus_used boolean, n_filters_used int, pick_id string, run_id long, status string, comment string, meta_json string, updated_utc timestamp"
)
#: Hash partitions of the results; batches that a run remembers.
PARTITIONS, REMEMBERED = 64, 100


class Store:
    """Tables below one folder, in numbered versions.

    A version is a small manifest, renamed into place after all of its files are written; the
    highest manifest counts. A rename either happens or doesn't, and takes no number that is
    there already, so a job lost at any time leaves the version before it, and of two writers
    of one number the second fails. A manifest lists folders of Parquet files, one or more a
    partition; a write adds folders for the partitions it touches and lists the others again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def init(self) -> None:
        """Creates the store's folders; nothing happens to a store that is there."""
        for name in SCHEMAS:
            at, fs = self._fs(f"{self.path}/{name}/_versions")
            fs.mkdirs(at)

    def _version(self, name: str) -> int:
        """The number of the current version; 0 before the first write."""
        at, fs = self._fs(f"{self.path}/{name}/_versions")
        if not fs.exists(at):
            return 0
        return max((int(n) for x in fs.listStatus(at) if (n := x.getPath().getName()).isdigit()), default=0)

    def _manifest(self, name: str) -> tuple[int, dict[str, list[str]]]:
        number = self._version(name)
        if not number:
            return 0, {}
        at, fs = self._fs(f"{self.path}/{name}/_versions/{number}")
        stream = fs.open(at)
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, name: str, number: int, parts: dict[str, list[str]]) -> None:
        folder = f"{self.path}/{name}/_versions"
        draft, fs = self._fs(f"{folder}/_{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps(parts, sort_keys=True).encode())
        out.close()
        final, _ = self._fs(f"{folder}/{number}")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"version {number} of {name} was written by another job")

    def _read(self, name: str, parts: dict[str, list[str]]) -> DataFrame:
        folders = [f"{self.path}/{name}/{f}" for k in sorted(parts) for f in parts[k]]
        return self.spark.read.option("mergeSchema", True).parquet(*folders)

    def table(self, name: str) -> DataFrame | None:
        """The current version; None before the first write."""
        _, parts = self._manifest(name)
        return self._read(name, parts) if parts else None

    def _write(self, name: str, df: DataFrame, number: int, kept: dict[str, list[str]], by: Column | None = None) -> None:
        """A new version: the kept folders, and those of ``df``, one for each value of ``by``."""
        fresh = uuid.uuid4().hex
        df = df.withColumn("_part", by if by is not None else F.lit("all"))
        df.write.partitionBy("_part").parquet(f"{self.path}/{name}/{fresh}")
        at, fs = self._fs(f"{self.path}/{name}/{fresh}")
        made = {n.split("=", 1)[1]: [f"{fresh}/{n}"] for x in fs.listStatus(at) if (n := x.getPath().getName()).startswith("_part=")}
        self._commit(name, number + 1, kept | made)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions older than the last ``keep`` and the folders that no other version lists; how many folders went.

        Readers of a deleted version fail; writers that run meanwhile may lose their folders.
        """
        gone = 0
        for name in SCHEMAS:
            at, fs = self._fs(f"{self.path}/{name}/_versions")
            last = self._version(name)
            if not last:
                continue
            used = set()
            for x in fs.listStatus(at):
                n = x.getPath().getName()
                if n.isdigit() and int(n) > last - keep:
                    stream = fs.open(x.getPath())
                    used |= {f.split("/")[0] for folders in json.loads(bytes(stream.readAllBytes()).decode()).values() for f in folders}
                    stream.close()
                elif n.isdigit():
                    fs.delete(x.getPath(), False)
            root, _ = self._fs(f"{self.path}/{name}")
            for x in fs.listStatus(root):
                if x.getPath().getName() not in used | {"_versions"}:
                    fs.delete(x.getPath(), True)
                    gone += 1
        return gone

    def upsert(self, rows: DataFrame, order: str = "updated_utc") -> DataFrame:
        """Results after the rows: one per event and station, the last by ``order``; new rows win over stored ones.

        Partitions are hashes of the event, so that a batch rewrites those of its own events
        only; their number is a property of the store. The same rows again leave the same results.
        """
        rows = cut(rows)
        part = F.pmod(F.xxhash64("event_id"), F.lit(PARTITIONS)).cast("string")
        touched = {r[0] for r in rows.select(part).distinct().collect()}
        number, parts = self._manifest("results")
        mine = {k: v for k, v in parts.items() if k in touched}
        fresh = rows.withColumn("_new", F.lit(1))
        both = fresh.unionByName(self._read("results", mine).withColumn("_new", F.lit(0)), allowMissingColumns=True) if mine else fresh
        if touched or not parts:
            self._write("results", latest(both, KEY, F.desc("_new"), F.desc_nulls_last(order), F.desc("pick_id")).drop("_new"), number, {k: v for k, v in parts.items() if k not in touched}, part)
        return self.table("results")

    def _replace(self, name: str, df: DataFrame) -> None:
        number, _ = self._manifest(name)
        self._write(name, df.coalesce(1), number, {})

    def begin_run(self, version: str, config) -> int:
        """Registers a run with a snapshot of its configuration; the number of the run."""
        old = self.table("runs")
        number = 1 if old is None else (old.agg(F.max("run_id")).first()[0] or 0) + 1
        row = self.spark.range(1).select(F.lit(number).cast("long").alias("run_id"), F.current_timestamp().alias("started_utc"), F.lit(None).cast("timestamp").alias("finished_utc"), F.lit(version).alias("software_version"), F.lit(snapshot(config)).alias("config_json"), F.lit(0).cast("long").alias("n_ok"), F.lit(0).cast("long").alias("n_failed"))
        self._replace("runs", row if old is None else old.unionByName(row, allowMissingColumns=True))
        return number

    def count(self, run_id: int, rows: DataFrame, batch: str | None = None) -> None:
        """Adds the rows just written to the run's counters. A batch that is named counts once, however often it is written."""
        runs = self.table("runs")
        if "batches" not in runs.columns:
            runs = runs.withColumn("batches", F.array().cast("array<string>"))
        done = F.coalesce("batches", F.array().cast("array<string>"))
        mine = F.col("run_id") == run_id
        if batch is not None and not runs.filter(mine & F.array_contains(done, batch)).isEmpty():
            return
        ok = rows.agg(F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") != "ok")).first()
        add = lambda c, n: F.when(mine, F.col(c) + n).otherwise(F.col(c))
        # Only the last batches can be repeated: a stream goes on from its last unfinished one.
        noted = F.when(mine, F.slice(F.concat(F.array(F.lit(batch)), done), 1, REMEMBERED)).otherwise(done) if batch is not None else done
        self._replace("runs", runs.withColumns({"n_ok": add("n_ok", ok[0]), "n_failed": add("n_failed", ok[1]), "batches": noted}))


def canonical(rows: DataFrame) -> DataFrame:
    """The rows with the columns of the results table, in its order and types; what they lack is null, what is beyond is left out."""
    types = dict(c.split() for c in RESULTS.split(", "))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def connection(env: Mapping[str, str]) -> dict[str, str]:
    """The options by which spark.read.jdbc reaches a PostgreSQL store, from POSTGRES_* variables; unset ones have defaults."""
    get = lambda name, default: env.get(f"POSTGRES_{name}", default)
    url = f"jdbc:postgresql://{get('HOST', '127.0.0.1')}:{get('PORT', '5432')}/{quote(get('DB', 'fastaxis'), safe='')}"
    password = {"password": get("PASSWORD", "")} if get("PASSWORD", "") else {}
    return {"url": url, "user": get("USER", "fastaxis"), "driver": "org.postgresql.Driver"} | password


def snapshot(config) -> str:
    """The analysis settings as JSON: no connection, archive or logging settings."""
    kept = {k: v for k, v in config.to_dict().items() if k in ("waveform", "sws", "processing", "velocity_model")}
    return json.dumps(kept, sort_keys=True)


def run_counters(log: DataFrame, by: str = "run") -> DataFrame:
    """(by, n_ok, n_failed) of a log of writes."""
    return log.groupBy(by).agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") != "ok").alias("n_failed"))
