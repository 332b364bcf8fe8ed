"""The debounce as a stream, and as a batch."""

import json
import time

from pyspark.sql import functions as F

from fastaxis.sources import bus
from fastaxis.streaming import debounce


def write(folder, name, rows):
    (folder / f"{name}.tmp").write_text("\n".join(json.dumps(dict(zip(("kind", "key", "payload"), r, strict=True))) for r in rows))
    (folder / f"{name}.tmp").rename(folder / f"{name}.json")


def test_stream_fires_once_with_the_latest(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    write(source, "1", [("Event", "a", "first"), ("Origin", "z", "never"), ("Event", "b", "only")])
    stream = spark.readStream.schema("kind string, key string, payload string").json(str(source))
    q = debounce.run_batches(debounce.debounced(stream, 6.0), lambda df, _: seen.extend(map(tuple, df.select("key", "payload", "n_updates").collect())), f"file://{tmp_path}/checkpoint", every="200 milliseconds")
    try:
        time.sleep(2)
        write(source, "2", [("Event", "a", "second")])
        deadline = time.time() + 60
        while len(seen) < 2 and time.time() < deadline:
            time.sleep(0.3)
        write(source, "3", [("Event", "a", "too late")])
        time.sleep(4)
        assert sorted(seen) == [("a", "second", 2), ("b", "only", 1)]
        assert q.exception() is None
    finally:
        q.stop()


SCHEMA = "kind string, key string, object_id string, sent string, payload string"


def send(spark, path, topic, *rows):
    bus.send(spark.createDataFrame(list(rows), SCHEMA).withColumn("sent_at", F.col("sent").cast("timestamp")), path, topic)


def fired(stream, tmp_path, want, during=lambda: None, name="checkpoint", **more):
    """The rows (key, payload, companion, n_updates) that a stream fires, once there are as many as wanted, or in vain."""
    seen = []
    q = debounce.run_batches(debounce.debounced(stream, 5.0, **more), lambda df, _: seen.extend(map(tuple, df.select("key", "payload", "companion", "n_updates").collect())), f"file://{tmp_path}/{name}", every="200 milliseconds")
    try:
        time.sleep(2)
        during()
        deadline = time.time() + 60
        while len(seen) < want and time.time() < deadline:
            time.sleep(0.3)
        time.sleep(3)
        assert q.exception() is None
        return sorted(seen)
    finally:
        q.stop()


def test_origins_of_the_stream_fire_with_their_events(spark, tmp_path):
    path = f"file://{tmp_path}/bus"
    at = lambda n: f"2026-01-01 00:00:{n:02d}"
    named = lambda o: json.dumps({"origin_id": o})
    send(spark, path, bus.ORIGINS, ("Origin", "a", "o1", at(1), "o1 first"), ("Origin", "b", "o2", at(9), "o2 late"), ("Origin", "b", "o3", at(3), "o3 early"), ("Origin", "only", "o9", at(1), "no event"))
    send(spark, path, bus.EVENTS, ("Event", "a", "a", at(5), named("o1")), ("Event", "b", "b", at(5), "no json"), ("Event", "c", "c", at(5), named("o7")), ("Pick", "d", "d", at(5), "none"), ("Event", None, "e", at(5), "none"))
    (tmp_path / "bus" / "topic=EVENT" / "broken.json").write_text("neither\n[1]\n")

    def later():
        # A newer version of the origin; an older one comes too late; of the event's payloads the one sent last counts.
        send(spark, path, bus.ORIGINS, ("Origin", "a", "o1", at(8), "o1 second"), ("Origin", "a", "o4", at(9), "another"))
        send(spark, path, bus.ORIGINS, ("Origin", "a", "o1", at(2), "o1 older"))
        send(spark, path, bus.EVENTS, ("Event", "c", "c", at(4), named("o8")), ("Event", "b", "b", at(6), "no json 2"))

    got = fired(bus.follow(spark, path), tmp_path, 3, later)
    assert got == [("a", named("o1"), "o1 second", 1), ("b", "no json 2", "o2 late", 2), ("c", named("o7"), None, 2)]


def test_a_new_state_knows_what_is_done(spark, tmp_path):
    path = f"file://{tmp_path}/bus"
    send(spark, path, bus.EVENTS, *[("Event", k, k, None, f"{k} payload") for k in ("a", "b", "c")])
    handled = spark.createDataFrame([("a",), ("a",), ("c",), (None,), ("elsewhere",)], "key string")
    again = lambda: send(spark, path, bus.EVENTS, ("Event", "a", "a", None, "a again"))
    assert fired(bus.follow(spark, path), tmp_path, 1, again, handled=handled) == [("b", "b payload", None, 1)]
    # Nothing done yet: an empty outbox.
    assert [r[0] for r in fired(bus.follow(spark, path), tmp_path, 3, name="other", handled=handled.limit(0))] == ["a", "b", "c"]


def test_topics_are_followed_from_where_a_stream_was(spark, tmp_path):
    path, seen = f"file://{tmp_path}/bus", []

    def take():
        q = bus.follow(spark, path, most_files=1).writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.topic + r.key for r in df.collect()))).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    take()
    assert sum(seen, []) == []
    for k in ("1", "2", "3"):
        send(spark, path, bus.EVENTS, ("Event", k, k, None, ""))
    send(spark, path, bus.ORIGINS, ("Origin", "1", "o", None, ""))
    take()
    assert sorted(sum(seen, [])) == ["EVENT1", "EVENT2", "EVENT3", "LOCATION1"]
    send(spark, path, bus.ORIGINS, ("Origin", "4", "o", None, ""))
    bus.send(spark.createDataFrame([("Event", "5")], "kind string, key string"), path, bus.EVENTS, "run-7")
    seen.clear()
    take()
    assert sorted(sum(seen, [])) == ["EVENT5", "LOCATION4"]
    bus.send(spark.createDataFrame([("Event", "5")], "kind string, key string"), path, bus.EVENTS, "run-7")
    assert sorted(r.key for r in bus.messages(spark, path, bus.EVENTS).collect()) == ["1", "2", "3", "5"]


def test_batch_of_one_key_in_parts(spark):
    rows = [(k, f"2026-01-01 00:{k % 60:02d}:00", "hot" if k % 3 else f"k{k}", float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts string, key string, payload double").selectExpr("event_id", "cast(ts as timestamp) ts", "key", "payload")
    assert sorted(map(tuple, debounce.debounced_batch(df, 300.0).collect())) == sorted(map(tuple, debounce.debounced_batch(df, 300.0, salts=8).collect()))


def test_batch(spark):
    rows = [(1, "2026-01-01 00:00:00", "a", 1.0), (2, "2026-01-01 00:00:30", "a", 2.0), (3, "2026-01-01 00:01:00", "a", 3.0), (4, "2026-01-01 00:05:00", "b", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, key string, payload double").selectExpr("event_id", "cast(ts as timestamp) ts", "key", "payload")
    got = {r.key: (r.payload, r.n_updates, r.late) for r in debounce.debounced_batch(df, 60.0).collect()}
    assert got == {"a": (2.0, 2, 1), "b": (4.0, 1, 0)}
