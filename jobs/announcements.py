"""Announced events, kept current: for each event the payload to measure, as messages arrive.

    python -m jobs.announcements --input MESSAGES --output FOLDER --checkpoint FOLDER [--config FILE]

Messages are Parquet rows of a key, an ordinal, a kind and a text. The first message of the opening kind
opens an event's window; the last text within the wait counts, later ones are late (the debounce of
fastaxis.streaming). A message is its key, ordinal and text: delivered again, it counts once. Messages
without a key or an ordinal can't be placed: they are counted in the log and left out. A null text is
one of the texts of its ordinal, the first in their order.

The input is a file stream with a checkpoint, so that a run takes only files that none took before.
Each batch first writes its messages of the opening kind below OUTPUT/messages, in the partitions
(block, batch); then the blocks it touched are derived again from all of their messages and replace
those below OUTPUT/announcements. A block is a range of keys: keys grow with time, so that new
messages touch the last blocks. A run that was lost in between leaves its batch to the next one, which
writes the same partitions again: nothing is counted twice, and no output depends on how messages were
divided into files and runs. A checkpoint that is lost costs only time, for the same reason.
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

from fastaxis.streaming.debounce import debounced_batch
from jobs import common

log = logging.getLogger("jobs.announcements")
CONFIG = Path(__file__).with_suffix(".yaml")
DEFAULTS: dict[str, Any] = {"key": "conv_id", "ordinal": "turn", "kind": "role", "text": "text", "opening_kind": "user", "seconds_per_ordinal": 30, "wait_seconds": 100, "block_keys": 100_000, "salts": 8}
ANNOUNCEMENTS = "key long, first_ordinal long, payload string, n_chars long, n_updates long, late long, block long"
MESSAGES = "key long, ordinal long, text string, digest string, block long, batch long"


def messages(rows: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """(key, ordinal, text, digest, block) of the messages that count."""
    name = lambda k: F.col(f"`{settings[k]}`")
    text = name("text").cast("string")
    counted = (name("kind") == settings["opening_kind"]) & name("key").isNotNull() & name("ordinal").isNotNull()
    placed = rows.filter(counted).select(name("key").cast("long").alias("key"), name("ordinal").cast("long").alias("ordinal"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    return placed.withColumn("block", F.floor(F.col("key") / settings["block_keys"]))


def announced(found: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """The announcements of the messages' keys: one row a key."""
    seconds = settings["seconds_per_ordinal"]
    once = found.dropDuplicates(["key", "ordinal", "digest"])
    timed = once.select(F.col("text").alias("event_id"), F.timestamp_seconds(F.col("ordinal") * seconds).alias("ts"), F.col("key"), F.col("text").alias("payload"))
    fired = debounced_batch(timed, settings["wait_seconds"], salts=settings["salts"])
    first = F.floor(F.unix_seconds("first_seen") / seconds)
    return fired.select("key", first.alias("first_ordinal"), "payload", F.length("payload").cast("long").alias("n_chars"), "n_updates", "late", F.floor(F.col("key") / settings["block_keys"]).alias("block"))


def process(output: str, settings: dict[str, Any], batch: DataFrame, number: int) -> int:
    """One batch of messages: kept, then the announcements of the blocks it touched derived again; how many messages it had."""
    spark = batch.sparkSession
    unplaced = F.col(f"`{settings['key']}`").isNull() | F.col(f"`{settings['ordinal']}`").isNull()
    read = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if(unplaced).alias("unplaced")).first()
    common.replace_partitions(messages(batch, settings).withColumn("batch", F.lit(number).cast("long")), f"{output}/messages", "block", "batch")
    held = spark.read.schema(MESSAGES).parquet(f"{output}/messages")
    mine = held.filter(F.col("batch") == number)
    log.info("batch %s: %s messages read, %s of them without key or ordinal; %s kept", number, read.n, read.unplaced, mine.count())
    # A touched block is a partition value of the batch just written: the join prunes the folders that are read.
    touched = mine.select("block").distinct()
    common.replace_partitions(announced(held.join(touched, "block", "left_semi"), settings), f"{output}/announcements", "block")
    wrote = table(spark, output).join(touched, "block", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late")).first()
    log.info("batch %s: %s announcements written, %s messages were late", number, wrote.n, wrote.late or 0)
    return read.n


def table(spark: SparkSession, output: str) -> DataFrame:
    """The announcements as they stand."""
    return spark.read.schema(ANNOUNCEMENTS).parquet(f"{output}/announcements")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, settings: dict[str, Any] | None = None) -> int:
    """Takes what is new in the source and waits for its end; the number of new messages."""
    settings = settings or common.settings(CONFIG, DEFAULTS)
    needed = [settings[k] for k in ("key", "ordinal", "kind", "text")]
    schema = spark.read.parquet(source).select(*[f"`{c}`" for c in needed]).schema
    # A pattern names a folder and a single file alike; the plain path of a file is no file stream's.
    path = source.rstrip("/")
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    # The folder is there from the first run on, also when nothing was announced.
    spark.createDataFrame([], ANNOUNCEMENTS).write.mode("append").partitionBy("block").parquet(f"{output}/announcements")
    taken: list[int] = []
    query = stream.writeStream.foreachBatch(lambda batch, number: taken.append(process(output, settings, batch, number))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s: %s new messages", source, sum(taken))
    return sum(taken)


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.announcements", description=__doc__.split("\n\n")[0], allow_abbrev=False)
    for name, said in (("input", "folder of messages"), ("output", "folder of messages kept and announcements"), ("checkpoint", "folder of the stream's checkpoint")):
        p.add_argument(f"--{name}", required=True, help=said)
    p.add_argument("--config", default=str(CONFIG), help="settings, a YAML file")
    args = p.parse_args(argv)
    try:
        settings = common.settings(args.config, DEFAULTS)
    except (OSError, ValueError) as e:
        p.error(str(e))
    spark = common.session("announcements")
    try:
        run(spark, args.input, args.output, args.checkpoint, settings)
    finally:
        spark.stop()
    return 0


def job1_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The announcements of all conversations after two runs over them."""
    folder = common.new_folder(spark, "announcements")
    for _ in range(2):
        run(spark, f"{sf_dir}/conversations.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return table(spark, f"{folder}/out")


SQL = """WITH m AS (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM m),
i AS (SELECT *, (turn - first) * 30 < 100 AS inside FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY inside DESC, turn DESC, text DESC NULLS LAST) AS rn FROM i),
n AS (SELECT conv_id, count(*) FILTER (inside) AS n_updates, count(*) FILTER (NOT inside) AS late FROM i GROUP BY conv_id)
SELECT conv_id AS key, first::BIGINT AS first_ordinal, text AS payload, length(text)::BIGINT AS n_chars, n_updates, late, floor(conv_id / 100000)::BIGINT AS block FROM r JOIN n USING (conv_id) WHERE rn = 1"""

if __name__ == "__main__":
    sys.exit(main())
