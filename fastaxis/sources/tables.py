"""The driver tables as domain views. Each function reads only the columns it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, comp, data): records of three components, from consecutive vectors; records that lack one are left out."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("rec"), F.element_at(F.array(F.lit("Z"), F.lit("N"), F.lit("E")), (F.col("vec_id") % 3 + 1).cast("int")).alias("comp"), F.col("embedding").cast("array<double>").alias("data"))
    whole = v.groupBy("rec").agg(F.count("*").alias("n")).filter("n = 3").select("rec")
    return v.join(whole, "rec")


def horizontals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, n, e): one row per record with both horizontal components."""
    return traces(spark, sf_dir).filter("comp <> 'Z'").groupBy("rec").agg(F.max(F.when(F.col("comp") == "N", F.col("data"))).alias("n"), F.max(F.when(F.col("comp") == "E", F.col("data"))).alias("e"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, comp, i, v): the traces sample by sample."""
    return traces(spark, sf_dir).select("rec", "comp", F.posexplode("data").alias("i", "v"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of results: one row per order that has lines. Means are of whole hundredths, so that no sum depends on its order."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[(F.sum(F.round(F.col(c) * 100).cast("long")) / (F.count("*") * 100.0)).alias(k) for k, c in (("d", "l_discount"), ("t", "l_tax"), ("q", "l_quantity"))])
    wide = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(lines, o.o_orderkey == lines.l_orderkey)
    d, t = F.col("d"), F.col("t")
    failed = F.col("o_orderstatus") == "F"
    q = F.round((d - 0.05) * 20 - 2 * t, 6)
    return wide.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderdate").alias("origin_time"),
        F.col("n_name").alias("network"),
        F.concat(F.lit("S"), (F.col("c_custkey") % 7).cast("string")).alias("station"),
        (24 + (F.col("o_custkey") % 1000) / 100).alias("event_latitude"),
        (20 + (F.col("o_orderkey") % 800) / 100).alias("event_longitude"),
        F.round(F.col("q"), 6).alias("event_depth_km"),
        F.round(F.col("o_totalprice") / 100000, 7).alias("magnitude"),
        (35 + F.col("c_nationkey") / 10).alias("station_latitude"),
        (22 + (F.col("c_custkey") % 50) / 10).alias("station_longitude"),
        F.round(5 + (F.col("o_orderkey") % 997) / 10, 3).alias("epi_distance_km"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        F.when(~failed, q).alias("qfinal"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.round(0.5 + t * 10, 6)).alias("filter_low"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.round(4 + d * 40, 6)).alias("filter_high"),
        F.when(F.col("o_custkey") % 11 > 0, F.round(F.col("q") / 5, 6)).alias("snr"),
        F.when(F.col("o_custkey") % 5 > 0, F.round(t * 4, 6)).alias("ev_linearity"),
        F.col("o_orderpriority").alias("run"),
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window measurements of both methods, grouped; zeros and negative zeros included."""
    place = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("grp"),
        F.row_number().over(place).cast("long").alias("window_idx"),
        (F.col("l_partkey") % 180).cast("double").alias("phi"),
        F.abs("l_discount").alias("dt"),
        (F.col("l_tax") * 100).alias("phi_err"),
        (F.col("l_quantity") / 1000).alias("dt_err"),
        ((F.col("l_partkey") + F.col("l_linenumber") * 7) % 180).cast("double").alias("rc_phi"),
        (F.abs("l_discount") * F.col("l_linenumber") / 4).alias("rc_dt"),
        F.col("l_linenumber").cast("long").alias("cluster"),
    )


def bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a bus by time."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("key"), F.col("event_type").alias("phase"), F.col("value").alias("payload"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity epochs of channels: a customer's orders in turn, the last one open."""
    starts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("start")).agg(F.max("o_orderkey").alias("epoch"), F.max("o_totalprice").alias("azimuth"))
    return starts.withColumn("end", F.lead("start").over(Window.partitionBy("key").orderBy("start")))
