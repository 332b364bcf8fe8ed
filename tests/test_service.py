"""A micro-batch of events, from payloads to store and comments."""

import dataclasses
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fastaxis.config import build
from fastaxis.operators import outbox, publish
from fastaxis.operators.store import RESULTS, Store
from fastaxis.plans import picks, service
from fastaxis.sources import bus


def catalogue(spark, published=("p5",)):
    t = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp") for c in cs})
    make = spark.createDataFrame
    return service.Catalogue(
        origins=t(make([("o1", "2026-01-01 00:00:00", 38.0, 23.0, 10.0), ("o2", "2026-01-02 00:00:00", 38.5, 23.0, 10.0)], "origin_id string, origin_time string, latitude double, longitude double, depth_km double"), "origin_time"),
        magnitudes=make([("m1", 3.5, "ML")], "magnitude_id string, magnitude double, magnitude_type string"),
        arrivals=make([("o1", "p1", "P", 0), ("o1", "p1", "S", 1), ("o1", "p2", "", 0), ("o1", "p3", "P", 0), ("o1", "p4", "Sg", 0), ("o1", "p5", "S", 0), ("o2", "p6", "S", 0)], "origin_id string, pick_id string, phase string, idx int"),
        picks=t(make([(p, "HL", s, None, "HHZ", "2026-01-01 00:00:05", "s") for p, s in (("p1", "ATH"), ("p2", "BAD"), ("p3", "ATH"), ("p4", "NEW"), ("p5", "ATH"), ("p6", "ATH"))], "pick_id string, network string, station string, location string, channel string, pick_time string, hint string"), "pick_time"),
        stations=t(make([("HL", "ATH", "2000-01-01", "2010-01-01", 1.0, 1.0, 1.0), ("HL", "ATH", "2010-01-01", None, 38.1, 23.1, 95.0), ("HL", "BAD", "2000-01-01", None, 38.2, 23.2, 5.0)], "network string, station string, start string, end string, latitude double, longitude double, elevation_m double"), "start", "end"),
        published=make([(p,) for p in published], "pick_id string"),
    )


def measured(tasks):
    error = F.when(F.col("station") == "BAD", F.lit("station is blacklisted")).when(F.col("station_latitude").isNull(), F.lit("station coordinates are missing"))
    return tasks.select("pick_id", error.alias("error"), F.when(error.isNull(), F.lit(40.0)).alias("ev_phi"), F.lit(0.9).alias("qfinal"), F.lit("Good Split").alias("quality_class"))


def announced(spark, *events, origin=None):
    return spark.createDataFrame([(json.dumps({"event_id": e, "origin_id": o, "magnitude_id": "m1"}), origin) for e, o in events], "payload string, companion string")


def state(spark, tmp_path, store):
    """Results, counters and comments as they stand."""
    rows = sorted((r.event_id, r.station, r.status, r.comment, r.ev_phi) for r in store.table("results").collect())
    counts = [(r.run_id, r.n_ok, r.n_failed) for r in outbox.runs(store, outbox.Outbox(spark, f"{store.path}/outcomes")).orderBy("run_id").collect()]
    sent = bus.messages(spark, f"file://{tmp_path}/bus", bus.COMMENTS).collect()
    return rows, counts, sorted((m.key, m.object_id) for m in sent)


def test_batch(spark, tmp_path):
    c, store = catalogue(spark), Store(spark, f"file://{tmp_path}/store")
    run = store.begin_run("1", build())
    seen, broken = [], []

    def measure(tasks):
        if broken and not tasks.filter(F.col("event_id") == broken[-1]).isEmpty():
            raise OSError("lost")
        seen.extend(tasks.select("pick_id", "seed_id", "station_latitude", "magnitude").collect())
        return measured(tasks)

    process = service.processor(lambda: c, measure, store, run, "1", f"file://{tmp_path}/bus")
    batch = announced(spark, ("ev1", "o1"), ("ev2", "lost"))
    process(batch, 0)
    assert ("p1", "HL.ATH..HHZ", 38.1, 3.5) in [tuple(r) for r in seen] and len(seen) == 3
    rows, counts, sent = state(spark, tmp_path, store)
    assert rows == [("ev1", "ATH", "ok", None, 40.0), ("ev1", "BAD", "failed", "station is blacklisted", None), ("ev1", "NEW", "failed", "station coordinates are missing", None)]
    assert counts == [(1, 1, 2)] and [p for p, _ in sent] == ["p1"]
    assert [r.pick_id for r in publish.commented(bus.messages(spark, f"file://{tmp_path}/bus", bus.COMMENTS)).collect()] == ["p1"]
    process(batch, 0)  # the batch again: nothing is measured, counts or appears twice, and the comment keeps its id
    assert state(spark, tmp_path, store) == (rows, counts, sent) and len(seen) == 3
    # Another batch of the same event is another write: counters count writes.
    process(batch, 1)
    assert state(spark, tmp_path, store)[:2] == (rows, [(1, 2, 4)])
    assert [c for c in store.table("results").columns] == [c.split()[0] for c in RESULTS.split(", ")]
    process(announced(spark), 7)
    process(spark.createDataFrame([("no json", None), (None, None), ("{}", "[]")], "payload string, companion string"), 8)
    assert outbox.Outbox(spark, f"{store.path}/outcomes").committed("direct-7") is None and state(spark, tmp_path, store)[0] == rows


def test_q22_an_event_that_fails_alone_is_lost_and_keeps_no_other(spark, tmp_path, caplog):
    store = Store(spark, f"file://{tmp_path}/store")
    run = store.begin_run("1", build())

    def measure(tasks):
        if not tasks.filter("event_id = 'ev9'").isEmpty():
            raise OSError("lost")
        return measured(tasks)

    process = service.processor(lambda: catalogue(spark), measure, store, run, "1", f"file://{tmp_path}/bus")
    for _ in range(2):
        process(announced(spark, ("ev8", "o1"), ("ev9", "o1")), 2)
    rows, counts, sent = state(spark, tmp_path, store)
    assert {r[0] for r in rows} == {"ev8"} and counts == [(1, 1, 2)] and [p for p, _ in sent] == ["p1"]
    assert caplog.text.count("event ev9 failed") == 1


@pytest.mark.parametrize("step,whole", [("commit", True), ("committed", False), ("upsert", True), ("stored", False), ("send", True), ("sent", False), ("commit", False)])
def test_a_batch_that_is_lost_at_any_step_goes_on(spark, tmp_path, monkeypatch, step, whole):
    """The process dies before or after each write; the restarted one, a run of its own, repeats the batch."""
    store = Store(spark, f"file://{tmp_path}/store")
    tries = []

    def measure(tasks):
        tries.append(1)
        if not whole and tasks.select("event_id").distinct().count() > 1:
            raise OSError("not as a whole")
        return measured(tasks)

    start = lambda: service.processor(lambda: catalogue(spark), measure, store, store.begin_run("1", build()), "1", f"file://{tmp_path}/bus")
    batch = announced(spark, ("ev1", "o1"), ("ev2", "o2"))
    owner, name, after = {"commit": (outbox.Outbox, "commit", False), "committed": (outbox.Outbox, "commit", True), "upsert": (Store, "upsert", False), "stored": (Store, "upsert", True), "send": (bus, "send", False), "sent": (bus, "send", True)}[step]
    real = getattr(owner, name)

    def dies(*given, **more):
        if after:
            real(*given, **more)
        raise SystemExit(step)

    with monkeypatch.context() as m:
        m.setattr(owner, name, dies)
        with pytest.raises(SystemExit):
            start()(batch, 0)
    before = len(tries)
    start()(batch, 0)
    rows, counts, sent = state(spark, tmp_path, store)
    assert [r[:3] for r in rows] == [("ev1", "ATH", "ok"), ("ev1", "BAD", "failed"), ("ev1", "NEW", "failed"), ("ev2", "ATH", "ok")]
    # Before its outcomes were committed a batch is measured again and belongs to the new run; after that it isn't.
    mine = (2, 2)
    assert counts == ([(1, 0, 0), (2, *mine)] if step == "commit" else [(1, *mine), (2, 0, 0)]) and (len(tries) > before) == (step == "commit")
    # Each comment is there once, and is that of the stored row.
    stored = store.table("results").filter("status = 'ok'").select("pick_id", publish.comment_id(F.col("pick_id"), F.col("updated_utc")))
    assert sent == sorted(map(tuple, stored.collect())) and [p for p, _ in sent] == ["p1", "p6"]


def test_two_events_may_share_a_pick(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    process = service.processor(lambda: catalogue(spark), measured, store, store.begin_run("1", build()), "1", f"file://{tmp_path}/bus")
    process(announced(spark, ("ev1", "o1"), ("ev2", "o1")), 0)
    rows, counts, sent = state(spark, tmp_path, store)
    assert [r[:3] for r in rows] == [(e, s, k) for e in ("ev1", "ev2") for s, k in (("ATH", "ok"), ("BAD", "failed"), ("NEW", "failed"))]
    assert counts == [(1, 2, 4)] and [p for p, _ in sent] == ["p1", "p1"]


def test_announced_origins_go_before_the_catalogue(spark):
    c = catalogue(spark, published=())
    origin = {"origin_id": "o1", "origin_time": "2026-01-01 00:00:02", "latitude": 39.0, "longitude": 24.0, "depth_km": 7.0}
    read = lambda batch: {(r.event_id, r.event_latitude, r.event_depth_km, str(r.origin_time)) for r in service.tasks(service.fired(batch), c).collect()}
    old, new = (38.0, 10.0, "2026-01-01 00:00:00"), (39.0, 7.0, "2026-01-01 00:00:02")
    assert read(announced(spark, ("e", "o1"))) == {("e", *old)}
    assert read(announced(spark, ("e", "o1"), origin=json.dumps(origin))) == {("e", *new)}
    # The payload names no origin: the one that came with it is meant. One without a place is none.
    assert read(announced(spark, ("e", None), origin=json.dumps(origin))) == {("e", *new)}
    assert read(announced(spark, ("e", "o1"), origin=json.dumps(origin | {"latitude": None}))) == {("e", *old)}
    assert read(announced(spark, ("e", "o1")).drop("companion")) == {("e", *old)} and read(announced(spark, ("e", "gone"))) == set()


def test_orientations_are_those_of_the_picks_location(spark):
    t = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp") for c in cs})
    c = catalogue(spark, published=())
    picks = t(spark.createDataFrame([(p, "HL", "ATH", loc, "HHZ", "2026-01-01 00:00:05", "S") for p, loc in (("p1", "00"), ("p2", "10"), ("p3", None), ("p4", "20"), ("p5", "  "))], "pick_id string, network string, station string, location string, channel string, pick_time string, hint string"), "pick_time")
    arrivals = c.arrivals.withColumn("phase", F.lit("S"))
    channels = t(spark.createDataFrame([("HL", "ATH", "00", "HHN", "2000-01-01", None, 0.0, 0.0), ("HL", "ATH", "10", "HHN", "2005-01-01", None, 45.0, 0.0), ("HL", "ATH", "", "HHN", "2001-01-01", None, 7.0, 0.0), ("HL", "ATH", None, "HHE", "2001-01-01", None, 97.0, 0.0)], "network string, station string, location string, code string, start string, end string, azimuth double, dip double"), "start", "end")
    found = service.tasks(service.fired(announced(spark, ("e", "o1"))), dataclasses.replace(c, picks=picks, arrivals=arrivals, channels=channels)).collect()
    got = {r.pick_id: None if r.orientations is None else {k: v.azimuth for k, v in r.orientations.items()} for r in found}
    assert got == {"p1": {"HHN": 0.0}, "p2": {"HHN": 45.0}, "p3": {"HHN": 7.0, "HHE": 97.0}, "p4": None, "p5": {"HHN": 7.0, "HHE": 97.0}}


def test_q26_comments_hold_null_where_a_value_is_not_a_number(spark):
    rows = spark.createDataFrame([("p1", float("nan"), float("inf"), 0.5, "Good Split", None)], "pick_id string, ev_phi double, delta double, qfinal double, quality_class string, error string")
    text = publish.comments(rows, "1", F.current_timestamp()).first().text
    splitting = json.loads(text, parse_constant=lambda x: pytest.fail(f"{x} in a comment"))["splitting"]
    assert splitting["ev_phi_deg"] is None and splitting["delta"] is None and splitting["qfinal"] == 0.5


def waves(spark, tmp_path):
    """Day-long nothing but for a split pulse at a known time: tasks, records and what was put in."""
    import numpy as np

    rate, n, rnd = 100.0, 7000, np.random.default_rng(2)
    rows, truth = [], {}
    for k, (axis, lag, polarisation) in enumerate([(30, 10, 75), (120, 16, 160), (75, 8, 20)]):
        t = np.arange(n) / rate
        spectrum = np.fft.fft(np.exp(-(((t - 10.12) / 0.12) ** 2)) * np.sin(2 * np.pi * 4 * (t - 10.12)))
        late = np.exp(-2j * np.pi * np.fft.fftfreq(n) * lag)
        alpha = np.radians(polarisation - axis)
        motion = np.exp(1j * np.radians(axis)) * (np.cos(alpha) * np.fft.ifft(spectrum).real + 1j * np.sin(alpha) * np.fft.ifft(spectrum * late).real)
        for channel, x in (("HHZ", 0.2 * rnd.normal(0, 0.01, n)), ("HHN", motion.real + rnd.normal(0, 0.004, n)), ("HHE", motion.imag + rnd.normal(0, 0.004, n))):
            x = x + np.exp(-(((t - 10.12) / 0.2) ** 2)) * 0.3 * (channel == "HHZ")
            rows.append((f"p{k}", channel, 990.0, rate, x.tolist()))
        truth[f"p{k}"] = (axis % 180, lag * 10.0)
    rows += [("p3", "HHZ", 990.0, rate, [1.0] * 10), ("p4", "HHZ", 990.0, rate, rnd.normal(0, 1, n).tolist()), ("p4", "HHN", 990.0, rate, rnd.normal(0, 1, n).tolist()), ("p4", "HHE", 990.0, rate, rnd.normal(0, 1, n).tolist())]
    return spark.createDataFrame(rows, "pick string, channel string, start double, rate double, data array<double>"), truth


@pytest.mark.parametrize("mode", ["ZRT", "LQT"])
def test_picks_from_records_to_rows(spark, tmp_path, mode):
    records, truth = waves(spark, tmp_path)
    task = lambda p, station, lat: (p, "1970-01-01 00:16:40", "XA", station, None, "HHZ", 38.0, 23.0, 20.0, lat, 23.01)
    tasks = spark.createDataFrame([*[task(f"p{k}", "S1", 38.02) for k in range(6)], task("p6", "BAD", 38.02), task("p7", "S2", None), task("p8", "S3", 40.0)], "pick_id string, at string, network string, station string, location string, channel string, event_latitude double, event_longitude double, event_depth_km double, station_latitude double, station_longitude double")
    tasks = tasks.withColumn("pick_time", F.col("at").cast("timestamp")).withColumn("orientations", F.lit(None).cast("map<string,struct<azimuth:double,dip:double>>")).drop("at")
    config = build({"sws": {"blacklist_stations": ["BAD"], "rotation_mode": mode, "filter_bank": [[1, 10], [0.5, 12]], "consensus": {"enabled": True, "n_best_filters": 2}, "max_delay_ms": 300}})
    model = np.array([(0.0, 3.0), (6371.0, 3.0)])
    made = {r.pick_id: r for r in picks.results(tasks, lambda wanted: records.join(wanted.select("pick"), "pick"), model, config).collect()}
    assert sorted(made) == [f"p{k}" for k in range(9)]
    back = made["p0"].backazimuth
    for p, (axis, lag) in truth.items():
        r = made[p]
        # T points the other way in ray coordinates, so that the axis is mirrored about the back azimuth there.
        want = axis if mode == "ZRT" else (2 * back - axis) % 180
        assert r.error is None and abs((r.ev_phi - want + 90) % 180 - 90) <= 6 and abs(r.ev_dt_ms - lag) <= 20, (p, r.ev_phi, want)
        assert r.n_windows == len(json.loads(r.meta_json)["filters"]) * 0 + json.loads(r.meta_json)["n_windows_generated"] and r.n_filters_used in (1, 2) and r.consensus_used
        assert (r.filter_low, r.filter_high) in ((1.0, 10.0), (0.5, 12.0)) and r.snr > 3 and 0 <= r.ev_spol < 180 and r.takeoff_angle > 90
        assert r.quality_class in ("Good Split", "Good Null", "Poor/Noise") and r.n_in_cluster >= 1 and r.dominant_period_s is None
    errors = {p: made[p].error for p in ("p3", "p4", "p5", "p6", "p7")}
    assert errors == {"p3": "fewer than three channels", "p4": "no band has a clear signal", "p5": "no waveform data", "p6": "station is blacklisted", "p7": "station coordinates are missing"}
    assert made["p8"].error.startswith("incidence") and all(made[p].backazimuth is None and made[p].ev_phi is None for p in (*errors, "p8"))
