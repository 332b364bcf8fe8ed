"""The command line."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from fastaxis import __main__ as cli
from fastaxis.operators import outbox, query
from fastaxis.operators.store import Store
from fastaxis.sources import bus


def written(tmp_path, text):
    (tmp_path / "c.yaml").write_text(text)
    return str(tmp_path / "c.yaml")


@pytest.mark.parametrize("name,flag,given,want", [("wait_time", "-w", "0", 0), ("wait_time", "--wait-time", "17", 17), ("host", "-H", "bus:4803", "bus:4803"), ("database", "--database", "pg://x", "pg://x")])
def test_the_command_line_wins(tmp_path, name, flag, given, want):
    config = written(tmp_path, "seiscomp: {wait_time: 44, host: a, database: b}")
    kept = cli.settings(cli.parser().parse_args(["--config", config]))
    assert (kept.seiscomp.wait_time, kept.seiscomp.host, kept.seiscomp.database) == (44, "a", "b")
    changed = cli.settings(cli.parser().parse_args(["--config", config, flag, given]))
    assert getattr(changed.seiscomp, name) == want


@pytest.mark.parametrize("given,said", [(["--config", "none.yaml"], "none.yaml"), (["--config", "bad.yaml"], "sws.snr_min"), (["--config", "good.yaml", "--bus", "x"], "--tables"), (["-w", "-1"], "at least 0"), (["-w", "soon"], "wait-time"), (["--wait", "3"], "--wait")])
def test_what_cannot_run_says_so(tmp_path, monkeypatch, capsys, given, said):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "bad.yaml").write_text("sws: {snr_min: -3}")
    (tmp_path / "good.yaml").write_text("logging: {level: warning}")
    with pytest.raises(SystemExit) as e:
        cli.main(given)
    assert e.value.code == 2 and said in capsys.readouterr().err


def test_logging_goes_where_the_settings_say(tmp_path):
    config = cli.settings(cli.parser().parse_args(["--config", written(tmp_path, f"logging: {{level: warning, file: {tmp_path}/log}}")]))
    root = logging.getLogger()
    before = root.handlers[:], root.level
    try:
        cli.start_logging(config)
        logging.getLogger("fastaxis.x").warning("heard")
        logging.getLogger("fastaxis.x").info("not heard")
        assert "WARNING fastaxis.x heard" in (tmp_path / "log").read_text() and "not heard" not in (tmp_path / "log").read_text()
    finally:
        root.handlers[:], root.level = before


def test_from_announcements_to_csv(spark, tmp_path):
    """The whole service, once: an event by the bus, its origin announced with it, rows in the store and their CSV form."""
    at = f"file://{tmp_path}"
    stamp = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp") for c in cs})
    tables = {
        "origins": stamp(spark.createDataFrame([("o9", "2026-01-01", 1.0, 1.0, 1.0)], "origin_id string, origin_time string, latitude double, longitude double, depth_km double"), "origin_time"),
        "magnitudes": spark.createDataFrame([("m1", 3.5, "ML")], "magnitude_id string, magnitude double, magnitude_type string"),
        "arrivals": spark.createDataFrame([("o1", "p1", "S", 1), ("o1", "p2", "S", 1)], "origin_id string, pick_id string, phase string, idx int"),
        "picks": stamp(spark.createDataFrame([("p1", "HL", "ATH", None, "HHZ", "2026-01-01 00:00:09", ""), ("p2", "HL", "BAD", None, "HHZ", "2026-01-01 00:00:09", "")], "pick_id string, network string, station string, location string, channel string, pick_time string, hint string"), "pick_time"),
        "stations": stamp(spark.createDataFrame([("HL", "ATH", "2000-01-01", None, 38.01, 23.0, 1.0), ("HL", "BAD", "2000-01-01", None, 38.0, 23.0, 1.0)], "network string, station string, start string, end string, latitude double, longitude double, elevation_m double"), "start", "end"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{at}/tables/{name}")
    (tmp_path / "model.nd").write_text("0 6 3.4 2.7\n6371 6 3.4 2.7\n")
    (tmp_path / "archive").mkdir()
    config = written(tmp_path, f"{{seiscomp: {{wait_time: 1}}, velocity_model: {{path: {at}/model.nd}}, sds: {{archive: {at}/archive}}, sws: {{blacklist_stations: [BAD]}}}}")
    args = cli.parser().parse_args(["--config", config, "--bus", f"{at}/bus", "--tables", f"{at}/tables", "--store", f"{at}/store", "--checkpoint", f"{at}/checkpoint", "--once"])
    origin = json.dumps({"origin_id": "o1", "origin_time": "2026-01-01 00:00:01", "latitude": 38.0, "longitude": 23.0, "depth_km": 20.0})
    event = json.dumps({"event_id": "ev1", "origin_id": "o1", "magnitude_id": "m1"})
    schema = "kind string, key string, object_id string, payload string"
    bus.send(spark.createDataFrame([("Origin", "ev1", "o1", origin)], schema), f"{at}/bus", bus.ORIGINS)
    bus.send(spark.createDataFrame([("Event", "ev1", "ev1", event), ("Focal", "ev1", "f", "{}")], schema), f"{at}/bus", bus.EVENTS)
    store = Store(spark, f"{at}/store")
    cli.run(spark, args, cli.settings(args))
    rows = {r.station: r for r in store.table("results").collect()}
    assert {k: (r.status, r.comment, r.event_depth_km, r.magnitude) for k, r in rows.items()} == {"ATH": ("failed", "no waveform data", 20.0, 3.5), "BAD": ("failed", "station is blacklisted", 20.0, 3.5)}
    query.write_csv(query.query_results(store.table("results"), status="all"), f"{at}/csv")
    lines = [r.value for r in spark.read.text(f"{at}/csv").collect()]
    assert sum(x.startswith("id,event_id,") for x in lines) >= 1 and sum("no waveform data" in x for x in lines) == 1
    counted = outbox.runs(store, outbox.Outbox(spark, f"{at}/store/outcomes")).collect()
    assert sum(r.n_failed for r in counted) == 2 and sum(r.n_ok for r in counted) == 0
    # A new checkpoint over the same bus: the outbox knows that the event is done.
    again = cli.parser().parse_args(["--config", config, "--bus", f"{at}/bus", "--tables", f"{at}/tables", "--store", f"{at}/store", "--checkpoint", f"{at}/checkpoint-2", "--once"])
    cli.run(spark, again, cli.settings(again))
    assert outbox.Outbox(spark, f"{at}/store/outcomes").table().count() == 2
