"""The relational store, on the embedded database that comes with Spark."""

import uuid
from types import SimpleNamespace

import pytest
from py4j.protocol import Py4JJavaError

from fastaxis.operators import outbox, query
from fastaxis.operators.relational import Database
from fastaxis.operators.store import RESULTS, canonical

NAMES = [c.split()[0] for c in RESULTS.split(", ")]


@pytest.fixture
def base(spark):
    made = Database(spark, {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    made.init()
    return made


def rows(spark, *given):
    """(event, network, station, status, q, comment, pick, second)"""
    df = spark.createDataFrame(given, "event_id string, network string, station string, status string, qfinal double, comment string, pick_id string, s int")
    return canonical(df.selectExpr("* except (s)", "timestamp_seconds(s) as updated_utc"))


def held(base):
    return {(r.event_id, r.network, r.station): (r.status, r.qfinal, r.comment) for r in base.table("results").collect()}


def test_rows_are_inserted_and_then_overwritten(spark, base):
    base.upsert(rows(spark, ("e1", "HL", "A", "ok", 0.5, None, "p1", 1), ("e1", "HL", "B", "ok", 0.9, None, "p2", 1)))
    base.upsert(rows(spark, ("e1", "HL", "B", "ok", -0.8, "again", "p3", 2), ("e2", "HL", "A", "failed", None, "no S arrival", "p4", 2)))
    assert held(base) == {("e1", "HL", "A"): ("ok", 0.5, None), ("e1", "HL", "B"): ("ok", -0.8, "again"), ("e2", "HL", "A"): ("failed", None, "no S arrival")}
    assert sorted(base.table("results").columns) == sorted(NAMES)


def test_a_batch_again_changes_nothing_and_of_equal_keys_the_last_counts(spark, base):
    batch = rows(spark, ("e", "N", "S", "ok", 0.1, None, "p1", 5), ("e", "N", "S", "ok", 0.2, None, "p2", 9), ("e", None, "S", "ok", 0.3, "x" * 100_000, "p3", 1))
    for _ in range(2):
        base.upsert(batch)
        assert held(base) == {("e", "N", "S"): ("ok", 0.2, None), ("e", "", "S"): ("ok", 0.3, "x" * 100_000)}


def test_tables_are_made_once_and_an_empty_batch_is_one(spark, base):
    base.upsert(rows(spark, ("e", "N", "S", "ok", 0.1, None, "p", 1)))
    base.init()
    base.upsert(rows(spark))
    assert len(held(base)) == 1


def test_a_merge_that_fails_leaves_results_and_no_staging(spark, base):
    base.upsert(rows(spark, ("e", "N", "S", "ok", 0.1, None, "p", 1)))
    with base._transaction() as s:
        s.executeUpdate('ALTER TABLE results ADD CONSTRAINT bounded CHECK ("qfinal" <= 1)')
    with pytest.raises(Py4JJavaError):
        base.upsert(rows(spark, ("e", "N", "S", "ok", 0.7, None, "p", 2), ("f", "N", "S", "ok", 7.0, None, "p", 2)))
    assert held(base) == {("e", "N", "S"): ("ok", 0.1, None)}
    with base._transaction() as s:
        found = s.getConnection().getMetaData().getTables(None, None, "STAGED%", None)
        assert not found.next()


def test_runs_are_numbered_and_filters_reach_the_database(spark, base):
    config = SimpleNamespace(to_dict=lambda: {"waveform": {"t_before": 5}, "postgres": {"password": "secret"}})
    assert [base.begin_run("3", config) for _ in range(2)] == [1, 2]
    assert {r.config_json for r in base.table("runs").collect()} == {'{"waveform": {"t_before": 5}}'}
    plan = base.table("results").filter("qfinal > 0.5").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(qfinal,0.5)" in plan and "ReadSchema: struct<event_id:string>" in plan


def test_queries_and_counters_read_it_as_any_store(spark, base, tmp_path):
    base.upsert(rows(spark, ("e1", "HL", "A", "ok", 0.5, None, "p1", 1), ("e2", "HL", "B", "ok", 0.9, None, "p2", 1), ("e3", "HL", "B", "failed", None, "late", "p3", 1)))
    assert [r.event_id for r in query.query_results(base.table("results"), min_qfinal=0.75, limit=5).collect()] == ["e2"]
    config = SimpleNamespace(to_dict=lambda: {})
    assert base.begin_run("3", config) == 1
    assert outbox.runs(base, outbox.Outbox(spark, f"{tmp_path}/outcomes")).count() == 1


def test_a_database_without_known_types_is_refused(spark):
    with pytest.raises(ValueError, match="derby"):
        Database(spark, {"url": "jdbc:mysql://x/y", "driver": "d"})


def test_variables_name_a_database(spark):
    made = Database.of(spark, {"POSTGRES_HOST": "db", "POSTGRES_DB": "a b", "POSTGRES_PASSWORD": "s"})
    assert made.options["url"] == "jdbc:postgresql://db:5432/a%20b" and made.options["password"] == "s" and made.types["text"] == "TEXT"
