"""The jobs: two runs over growing input, runs that were lost, awkward rows, command lines."""

import logging
import random
import subprocess
import sys

import __spark_entry__
import oracle
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from fastaxis.operators.store import RESULTS, Store
from jobs import announcements, bulletin, common, registry

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, batch long, `a.b` string"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_job_meets_its_sql(spark, name):
    before = dict(spark.conf.getAll)
    assert oracle.difference(__spark_entry__.queries()[name](spark, DATA), __spark_entry__.oracle_sql()[name], oracle.connect(DATA)) == ""
    after = dict(spark.conf.getAll)
    assert {k: v for k, v in before.items() if after.get(k) != v} == {}


def plain(rows, seconds=30, wait=100, block=100_000):
    """Announcements by hand: {key: (first, payload, n_chars, n_updates, late, block)}."""
    by = {}
    for key, turn, role, text in {r[:4] for r in rows}:
        if role == "user" and key is not None and turn is not None:
            by.setdefault(key, []).append((turn, text is not None, text or "", text))
    out = {}
    for key, found in by.items():
        first = min(found)[0]
        inside = [m for m in found if (m[0] - first) * seconds < wait]
        text = max(inside)[3]
        out[key] = (first, text, None if text is None else len(text), len(inside), len(found) - len(inside), key // block)
    return out


def rows(seed, keys, hot=None):
    rnd = random.Random(seed)
    out = []
    for key in keys:
        turns = [rnd.randint(-3, 12) for _ in range(rnd.randint(1, 9))]
        out += [(key, t, rnd.choice(["user", "user", "assistant"]), rnd.choice([None, "", "é" * 3, f"text {rnd.randint(0, 99)}"])) for t in turns]
    out += [(hot, t, "user", f"{t}") for t in range(200)] if hot is not None else []
    out += [(None, 1, "user", "nowhere"), (keys[0], None, "user", "never"), (keys[0], 1, None, "nothing"), *out[:5]]
    return [(*r, 7, "x") for r in out]


def got(spark, out):
    return {r.key: tuple(r)[1:] for r in announcements.table(spark, out).collect()}


def add(spark, folder, found, parts=1):
    spark.createDataFrame(found, SCHEMA).repartition(parts).write.mode("append").parquet(folder)


def paths(tmp_path):
    return [f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint")]


def test_growing_messages(spark, tmp_path, caplog):
    source, out, checkpoint = paths(tmp_path)
    old = rows(1, [-5, 0, 1, 99_999, 100_000, 250_000], hot=42)
    add(spark, source, old, 3)
    with caplog.at_level(logging.INFO, "jobs"):
        assert announcements.run(spark, source, out, checkpoint) == len(old)
    assert f"{len(old)} messages read, 2 of them without key or ordinal" in caplog.text
    assert got(spark, out) == plain(old)
    untouched = {f for f in spark.read.parquet(f"{out}/announcements").inputFiles() if "block=2/" in f}
    # Nothing new; then more messages of old events and of new ones: only those are read.
    assert announcements.run(spark, source, out, checkpoint) == 0 and got(spark, out) == plain(old)
    new = rows(2, [0, 7, 100_000, 900_000], hot=42)
    add(spark, source, new)
    assert announcements.run(spark, source, out, checkpoint) == len(new)
    assert got(spark, out) == plain(old + new)
    assert untouched and untouched <= set(spark.read.parquet(f"{out}/announcements").inputFiles())
    # A lost checkpoint takes all messages again and changes nothing.
    assert announcements.run(spark, source, out, f"{checkpoint}-2") == len(old) + len(new)
    assert got(spark, out) == plain(old + new)


@pytest.mark.parametrize("lost", ["messages", "announcements"])
def test_a_lost_run_is_repeated(spark, tmp_path, monkeypatch, lost):
    source, out, checkpoint = paths(tmp_path)
    old, new = rows(3, [1, 2, 3]), rows(4, [2, 3, 4])
    add(spark, source, old)
    announcements.run(spark, source, out, checkpoint)
    add(spark, source, new)
    real = common.replace_partitions

    def breaks(df, path, *by, **more):
        if lost == "announcements":
            real(df, path, *by, **more)
        if path.endswith(lost):
            raise OSError("lost")
        real(df, path, *by, **more)

    with monkeypatch.context() as m:
        m.setattr(common, "replace_partitions", breaks)
        with pytest.raises(Exception, match="lost"):
            announcements.run(spark, source, out, checkpoint)
    announcements.run(spark, source, out, checkpoint)
    assert got(spark, out) == plain(old + new)
    held = spark.read.parquet(f"{out}/messages")
    assert held.count() == sum(r[2] == "user" and r[0] is not None and r[1] is not None for r in old + new)


def test_no_messages(spark, tmp_path):
    source, out, checkpoint = paths(tmp_path)
    add(spark, source, [])
    assert announcements.run(spark, source, out, checkpoint) == 0 and got(spark, out) == {}
    only = [(None, 1, "user", "x", 1, "x"), (3, 1, "assistant", "y", 1, "x")]
    add(spark, source, only)
    assert announcements.run(spark, source, out, checkpoint) == 2 and got(spark, out) == {}


def test_touched_blocks_prune_the_messages(spark, tmp_path):
    source, out, checkpoint = paths(tmp_path)
    add(spark, source, rows(5, [1, 150_000, 250_000]))
    announcements.run(spark, source, out, checkpoint)
    held = spark.read.schema(announcements.MESSAGES).parquet(f"{out}/messages")
    plan = held.join(held.filter("batch = 0").select("block").distinct(), "block", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_bulletin_twice_and_over_fewer_tables(spark, tmp_path, caplog):
    out = f"file://{tmp_path}/out"
    with caplog.at_level(logging.INFO, "jobs"):
        first = bulletin.run(spark, DATA, out)
    assert f"{first[0]} bulletin rows and {first[1]} station years written" in caplog.text
    before = [sorted(map(tuple, t.collect()), key=repr) for t in bulletin.tables_of(spark, out)]
    assert bulletin.run(spark, DATA, out) == first and [sorted(map(tuple, t.collect()), key=repr) for t in bulletin.tables_of(spark, out)] == before
    assert len(before[0]) == first[0] > 0 and len(before[1]) == first[1] > 0
    settings = common.settings(bulletin.CONFIG, bulletin.DEFAULTS) | {"min_magnitude": 2.5, "start_time": "1995-02-01"}
    some = bulletin.run(spark, DATA, out, settings)
    assert 0 < some[0] < first[0]


def test_bulletin_of_a_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    types = dict(c.split() for c in RESULTS.split(", "))
    given = [("e1", "HL", "ATH", "2026-01-01 00:00:05", 3.5, 0.9, "Good Split", "ok"), ("e2", "HL", "ATH", "2026-02-01 00:00:00", 4.2, -0.9, "Good Null", "ok"), ("e3", "HL", "ATH", None, 3.0, 0.5, "Poor/Noise", "ok"), ("e4", "HL", "NEW", "2026-02-03 00:00:00", 3.0, None, None, "failed"), ("e5", "HP", "X", "2026-02-03 00:00:00", None, 0.8, "Good Split", "ok")]
    names = ["event_id", "network", "station", "origin_time", "magnitude", "qfinal", "quality_class", "status"]
    df = spark.createDataFrame(given, "event_id string, network string, station string, at string, magnitude double, qfinal double, quality_class string, status string").toDF(*names)
    store.upsert(df.select(*[(F.col(c) if c in names else F.lit(None)).cast(t).alias(c) for c, t in types.items()]))
    out = f"file://{tmp_path}/out"
    settings = common.settings(bulletin.CONFIG, bulletin.DEFAULTS) | {"source": "store"}
    assert bulletin.run(spark, store.path, out, settings) == (2, 3)
    rows, stations = bulletin.tables_of(spark, out)
    assert [(r.event_id, r.year, r.month, r.qc_qfinal, r.filter, r.event_origin_time_utc) for r in rows.orderBy("event_id").collect()] == [("e1", 2026, 1, 0.9, None, "2026-01-01T00:00:05+00:00"), ("e2", 2026, 2, -0.9, None, "2026-02-01T00:00:00+00:00")]
    assert {r.station: (r.n_ok, r.n_failed, r.n_good_split, r.n_good_null, r.mean_qfinal, r.best_event) for r in stations.collect()} == {"ATH": (2, 0, 1, 1, 0.0, "e1"), "NEW": (0, 1, 0, 0, None, None), "X": (1, 0, 1, 0, 0.8, "e5")}
    with pytest.raises(common.SettingsError, match="no results"):
        bulletin.run(spark, f"file://{tmp_path}/none", out, settings)


def test_settings(tmp_path):
    at = tmp_path / "c.yaml"
    at.write_text("wait_seconds: 5\n")
    assert common.settings(at, announcements.DEFAULTS) == announcements.DEFAULTS | {"wait_seconds": 5}
    at.write_text("")
    assert common.settings(at, bulletin.DEFAULTS) == bulletin.DEFAULTS
    assert common.settings(announcements.CONFIG, announcements.DEFAULTS) == announcements.DEFAULTS and common.settings(bulletin.CONFIG, bulletin.DEFAULTS) == bulletin.DEFAULTS
    for bad in ("nothing: 1", "wait_seconds: soon", "wait_seconds: true", "- a"):
        at.write_text(bad)
        with pytest.raises(common.SettingsError):
            common.settings(at, announcements.DEFAULTS)


def test_command_lines(spark, tmp_path):
    source, out, checkpoint = paths(tmp_path)
    found = rows(6, [1, 2])
    add(spark, source, found)
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.announcements", "--input", source, "--output", out, "--checkpoint", checkpoint], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
    assert "0 new messages" in done.stderr and got(spark, out) == plain(found)
    done = subprocess.run([sys.executable, "-m", "jobs.bulletin", "--input", DATA, "--output", f"{out}-2"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and bulletin.tables_of(spark, f"{out}-2")[0].count() > 0
    for argv in (["--input", "x"], ["--input", "x", "--output", "y", "--config", f"{tmp_path}/none.yaml"]):
        with pytest.raises(SystemExit) as e:
            bulletin.main(argv)
        assert e.value.code == 2
