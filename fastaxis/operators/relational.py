"""The results store in a relational database: staged by Spark's JDBC writer, merged by one statement.

Executors write a batch's rows into a staging table of its own; then one transaction merges
it into the results and drops it. A batch that is lost before the commit leaves the results
as they were, and one that is written again leaves them as the first time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastaxis.operators.enrich import latest
from fastaxis.operators.store import KEY, RESULTS, canonical, connection, snapshot

#: Column types by database (fixed names). Keys and numbers of a run can be compared; other texts may be of any length.
TYPES = {
    "derby": {"key": "VARCHAR(512)", "string": "VARCHAR(32672)", "text": "CLOB", "double": "DOUBLE", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"},
    "postgresql": {"key": "TEXT", "string": "TEXT", "text": "TEXT", "double": "DOUBLE PRECISION", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE"},
}
#: Columns whose texts can be long.
LONG = ("comment", "meta_json", "config_json", "software_version")
RUNS = "run_id long, started_utc timestamp, finished_utc timestamp, software_version string, config_json string"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Database:
    """Tables ``results`` and ``runs`` of a database; the same calls as fastaxis.operators.store.Store.

    options: those of Spark's JDBC source but dbtable: url, driver, user, password and others.
    """

    def __init__(self, spark: SparkSession, options: Mapping[str, str]):
        self.spark, self.options = spark, dict(options)
        kind = self.options["url"].split(":")[1]
        if kind not in TYPES:
            raise ValueError(f"no column types are known for {kind}: {', '.join(TYPES)}")
        self.types = TYPES[kind]

    @classmethod
    def of(cls, spark: SparkSession, env: Mapping[str, str]) -> Database:
        """The database that POSTGRES_* variables name."""
        return cls(spark, connection(env))

    @contextmanager
    def _transaction(self) -> Iterator[object]:
        """A statement whose work is committed at the end, or undone."""
        jvm = self.spark._jvm
        given = jvm.java.util.Properties()
        for k, v in self.options.items():
            if k not in ("url", "driver"):
                given.setProperty(k, v)
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        driver = loader.loadClass(self.options["driver"]).newInstance()
        link = driver.connect(self.options["url"], given)
        try:
            link.setAutoCommit(False)
            statement = link.createStatement()
            yield statement
            link.commit()
        except BaseException:
            link.rollback()
            raise
        finally:
            link.close()

    def _types(self, fields: str, keys: list[str]) -> dict[str, str]:
        kinds = dict(c.split() for c in fields.split(", "))
        return {n: self.types["key" if n in keys and k == "string" else "text" if n in LONG else k] for n, k in kinds.items()}

    def _columns(self, fields: str, keys: list[str]) -> str:
        return ", ".join(f"{_quoted(n)} {t}{' NOT NULL' if n in keys else ''}" for n, t in self._types(fields, keys).items())

    def _staging(self) -> str:
        """The columns of a staging table: every text of any length, as Spark's writer binds them."""
        kinds = dict(c.split() for c in RESULTS.split(", "))
        return ", ".join(f"{_quoted(n)} {self.types['text' if k == 'string' else k]}" for n, k in kinds.items())

    def _exists(self, statement, name: str) -> bool:
        found = statement.getConnection().getMetaData().getTables(None, None, "%", None)
        while found.next():
            if found.getString("TABLE_NAME").lower() == name:
                return True
        return False

    def init(self) -> None:
        """Creates the tables; those that are there stay as they are."""
        with self._transaction() as s:
            for name, fields, keys in (("results", RESULTS, KEY), ("runs", RUNS, ["run_id"])):
                if not self._exists(s, name):
                    s.executeUpdate(f"CREATE TABLE {name} ({self._columns(fields, keys)}, PRIMARY KEY ({', '.join(map(_quoted, keys))}))")

    def table(self, name: str) -> DataFrame:
        """A table as it stands; filters and columns of a query reach the database."""
        return self.spark.read.format("jdbc").options(**self.options, dbtable=name).load()

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.write.format("jdbc").options(**self.options, dbtable=name).mode("append").save()

    def upsert(self, rows: DataFrame, order: str = "updated_utc") -> DataFrame:
        """Results after the rows: one per event and station, the last by ``order``; new rows win over stored ones.

        A key's part that is null is stored as an empty text, as keys hold no null.
        """
        mine = canonical(rows).withColumns({c: F.coalesce(c, F.lit("")) for c in KEY})
        mine = latest(mine, KEY, F.desc_nulls_last(order), F.desc("pick_id"))
        staged = f"staged_{uuid.uuid4().hex}"
        types = self._types(RESULTS, KEY)
        value = {c: f"n.{_quoted(c)}" if c in LONG else f"CAST(n.{_quoted(c)} AS {t})" for c, t in types.items()}
        with self._transaction() as s:
            s.executeUpdate(f"CREATE TABLE {staged} ({self._staging()})")
        try:
            self._append(mine, staged)
            same = " AND ".join(f"t.{_quoted(c)} = {value[c]}" for c in KEY)
            changed = ", ".join(f"{_quoted(c)} = {v}" for c, v in value.items() if c not in KEY)
            added = f"({', '.join(map(_quoted, value))}) VALUES ({', '.join(value.values())})"
            with self._transaction() as s:
                s.executeUpdate(f"MERGE INTO results t USING {staged} n ON {same} WHEN MATCHED THEN UPDATE SET {changed} WHEN NOT MATCHED THEN INSERT {added}")
        finally:
            with self._transaction() as s:
                s.executeUpdate(f"DROP TABLE {staged}")
        return self.table("results")

    def begin_run(self, version: str, config) -> int:
        """Registers a run with a snapshot of its configuration; the number of the run. Of two that begin at once the key lets one through."""
        number = (self.table("runs").agg(F.max("run_id")).first()[0] or 0) + 1
        row = self.spark.range(1).select(F.lit(number).cast("long").alias("run_id"), F.current_timestamp().alias("started_utc"), F.lit(None).cast("timestamp").alias("finished_utc"), F.lit(version).alias("software_version"), F.lit(snapshot(config)).alias("config_json"))
        self._append(row, "runs")
        return number
