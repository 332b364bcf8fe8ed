"""The outbox: what a batch of events came to, written once, and everything else derived from it.

A batch has a name that a repetition has too, and one folder of outcomes: the canonical result rows of
its picks, good or refused. Spark's writer marks the folder when it is complete; from then on the batch
is never measured again, and the store, the counters and the comments follow from the same rows however
often they are derived. An outcome keeps its time, so that a derived comment keeps its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastaxis.operators.store import RESULTS, Store, canonical, run_counters


class Outbox:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch={batch}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def committed(self, batch: str) -> DataFrame | None:
        """The outcomes of a batch; None if it has not been written to its end."""
        if not self._exists(f"{self._folder(batch)}/_SUCCESS"):
            return None
        return self.spark.read.schema(RESULTS).parquet(self._folder(batch))

    def commit(self, batch: str, rows: DataFrame) -> DataFrame:
        """Writes the outcomes of a batch, in place of what an earlier attempt left, and reads them back."""
        canonical(rows).write.mode("overwrite").parquet(self._folder(batch))
        return self.committed(batch)

    def table(self) -> DataFrame:
        """All outcomes, with the name of their batch."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], f"{RESULTS}, batch string")
        return self.spark.read.schema(f"{RESULTS}, batch string").parquet(self.path)

    def handled(self) -> DataFrame:
        """(key): the events that have outcomes."""
        return self.table().select(F.col("event_id").alias("key")).distinct()


def runs(store: Store, outbox: Outbox) -> DataFrame:
    """The registered runs with their counters, which count the outcomes: two columns of the outbox are read."""
    counts = run_counters(outbox.table().select("run_id", "status"), "run_id")
    rows = store.table("runs").drop("n_ok", "n_failed", "batches").join(counts, "run_id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_ok", "n_failed")})
