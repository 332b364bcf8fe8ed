"""Comments on picks: the published form of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = "#fastaxis/"
#: Published names of the result columns, and their decimals.
FIELDS = {"ev_phi_deg": ("ev_phi", 2), "ev_phi_err_deg": ("ev_phi_err", 2), "ev_dt_ms": ("ev_dt_ms", 2), "ev_dt_err_ms": ("ev_dt_err_ms", 2), "ev_spol_deg": ("ev_spol", 2), "qfinal": ("qfinal", 4), "qmean": ("qmean", 4), "qbest": ("qbest", 4), "omega": ("omega", 4), "delta": ("delta", 4)}


def publishable(results: DataFrame) -> DataFrame:
    return results.filter("error is null and quality_class is not null")


def comment_id(pick_id: Column, at: Column) -> Column:
    return F.concat(pick_id, F.lit(MARKER), F.date_format(at, "yyyyMMdd'T'HHmmss.SSSSSS'Z'"))


def payload(results: DataFrame, version: str, at: Column) -> Column:
    """The comment's text: provenance and rounded values, nulls kept; what is no finite number is null too."""
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    value = lambda c, n: F.round(finite(F.col(c)), n) if c in results.columns else F.lit(None).cast("double")
    provenance = F.struct(F.lit("fastaxis").alias("software"), F.lit(version).alias("version"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("stored_at"))
    splitting = F.struct(*[value(c, n).alias(name) for name, (c, n) in FIELDS.items()], F.col("quality_class").alias("class"))
    return F.to_json(F.struct(provenance.alias("provenance"), splitting.alias("splitting")), {"ignoreNullFields": "false"})


def comments(results: DataFrame, version: str, at: Column) -> DataFrame:
    """(pick_id, comment_id, text) of the results worth publishing."""
    rows = publishable(results)
    return rows.select("pick_id", comment_id(F.col("pick_id"), at).alias("comment_id"), payload(rows, version, at).alias("text"))


def as_messages(rows: DataFrame) -> DataFrame:
    """Comments as messages of the bus: the key is the pick, the object's id the comment's."""
    return rows.select(F.lit("Comment").alias("kind"), F.col("pick_id").alias("key"), F.col("comment_id").alias("object_id"), F.current_timestamp().alias("sent_at"), F.col("text").alias("payload"))


def commented(messages: DataFrame) -> DataFrame:
    """(pick_id): picks that this software's comments were published for, of messages of the bus."""
    return messages.filter((F.col("kind") == "Comment") & F.col("object_id").contains(MARKER)).select(F.col("key").alias("pick_id")).distinct()


def send(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Writes comments below a folder; without any, nothing is written and the answer is False.

    A batch that has a name has a folder of its own, which a repeated batch overwrites; others are added.
    """
    if rows.isEmpty():
        return False
    if batch is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
    return True
