"""The bus: topics of messages, each a folder of JSON lines that Spark's file streams follow.

PATH/topic=NAME holds the messages of a topic, one JSON object a line with the fields of MESSAGE: a
kind (Event, Origin, ...), the key of the event that the object belongs to, the object's own id, when
it was sent, and the payload, a JSON text. A stream's checkpoint keeps its place in every topic it
follows. A line that isn't such an object has no kind: nothing takes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "kind string, key string, object_id string, sent_at timestamp, payload string"
#: Topics that events and origins come by, and the one that comments go to (fixed names).
EVENTS, ORIGINS, COMMENTS = "EVENT", "LOCATION", "PICK"


def folder(path: str, topic: str) -> str:
    return f"{path.rstrip('/')}/topic={topic}"


def follow(spark: SparkSession, path: str, topics: Sequence[str] = (EVENTS, ORIGINS), most_files: int | None = None) -> DataFrame:
    """The messages of several topics as one stream, with their topic; at most so many new files of each in one batch.

    Every topic is a source of its own, so that a busy one keeps no other waiting. A topic that
    nothing was sent to is an empty folder.
    """
    streams = []
    for topic in topics:
        send(spark.createDataFrame([], MESSAGE), path, topic)
        reader = spark.readStream.schema(MESSAGE).option("mode", "PERMISSIVE").option("recursiveFileLookup", True)
        reader = reader.option("maxFilesPerTrigger", most_files) if most_files else reader
        streams.append(reader.json(folder(path, topic)).withColumn("topic", F.lit(topic)))
    out = streams[0]
    for more in streams[1:]:
        out = out.unionByName(more)
    return out


def messages(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """All messages of a topic so far."""
    send(spark.createDataFrame([], MESSAGE), path, topic)
    return spark.read.schema(MESSAGE).option("recursiveFileLookup", True).json(folder(path, topic)).filter("kind is not null")


def send(rows: DataFrame, path: str, topic: str, batch: str | None = None) -> None:
    """Adds messages to a topic. A batch that has a name has a folder of its own: sent again, it takes the place of what was sent."""
    types = dict(c.split() for c in MESSAGE.split(", "))
    shaped = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    at = folder(path, topic)
    if batch is None:
        shaped.write.mode("append").json(at)
    else:
        shaped.write.mode("overwrite").json(f"{at}/batch={batch}")
