"""Functions for SQL text equal the DataFrame operators."""

import itertools

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fastaxis.functions import geometry, surface
from fastaxis.operators import windows


@pytest.fixture(scope="module")
def sql(spark):
    surface.register(spark)
    surface.register(spark)
    return spark


def test_quality_equals_the_columns(sql):
    axes, delays = (0.0, 12.5, 44.0, 45.0, 46.0, 90.0, 135.0, None), (0.0, 0.1, 0.25, None)
    df = sql.createDataFrame(list(itertools.product(axes, delays, (0.0, 30.0, 91.0, None), delays)), "a double, b double, c double, d double")
    q = geometry.quality_index(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 0.75)
    both = sql.sql("SELECT q.q, q.delta, q.omega, q.class, quality_index(a, b, c, d) AS q2, delay_ratio(b, d) AS delta2, axis_difference(a, c) AS omega2, quality_class(quality_index(a, b, c, d), 0.75) AS class2 FROM {m}", m=df.withColumn("q", q))
    rows = both.collect()
    assert len(rows) == 8 * 4 * 4 * 4
    for r in rows:
        assert r["class"] == r.class2 and [r.q, r.delta, r.omega] == pytest.approx([r.q2, r.delta2, r.omega2], abs=1e-12, nan_ok=True) if r.q is not None else r.q2 is None


def test_rotations_equal_the_columns(sql):
    df = sql.createDataFrame([(1.0, 2.0, -0.5, 33.0, 20.0), (0.3, -1.0, 4.0, 250.0, 0.0), (None, 1.0, 1.0, 10.0, 5.0)], "z double, n double, e double, baz double, inc double")
    along, across = geometry.rotate(F.col("n"), F.col("e"), F.col("baz"))
    l, q, t = geometry.lqt(*map(F.col, ("z", "n", "e", "baz", "inc")))
    for r in sql.sql("SELECT *, rotated(n, e, baz) AS r, ray_coordinates(z, n, e, baz, inc) AS x, axial(baz) AS ax, octaves(0.5, 4) AS oct FROM {m}", m=df.select("*", along.alias("w1"), across.alias("w2"), l.alias("w3"), q.alias("w4"), t.alias("w5"), geometry.axial(F.col("baz")).alias("w6"))).collect():
        assert [r.r.along, r.r.across, r.x.t, r.ax, r.oct] == pytest.approx([r.w1, r.w2, r.w5, r.w6, 3.0])
        assert [r.x.l, r.x.q] == (pytest.approx([r.w3, r.w4]) if r.z is not None else [None, None])


def test_functions_are_inlined(sql):
    plan = sql.sql("SELECT id FROM range(9) WHERE quality_index(id, 1, 2, 1) > 0.5")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Filter" in plan and "Subquery" not in plan


def test_lattice_joins_laterally_and_equals_the_operator(sql):
    df = sql.createDataFrame([(1, 10.0), (2, -3.5), (3, None)], "pick int, at double")
    for text, given in (("", {}), (", max_delay => 0.2, nbeg => 3, tend1 => 0.3", {"max_delay": 0.2, "nbeg": 3, "tend1": 0.3})):
        got = sorted((r.pick, r.window_idx, round(r.t0, 9), round(r.t1, 9)) for r in sql.sql(f"SELECT pick, w.* FROM {{m}}, LATERAL window_lattice(at{text}) w", m=df).collect())
        want = sorted((k, r.window_idx, round(r.t0, 9), round(r.t1, 9)) for k, at in ((1, 10.0), (2, -3.5)) for r in windows.lattice(sql, at, **given).collect())
        assert got == want and got


def test_bands_equal_the_operator(sql):
    got = sql.sql("SELECT rate, b.* FROM VALUES (100), (20), (4), (NULL) AS r(rate), LATERAL band_bank(rate) b").collect()
    for rate in (100, 20, 4):
        want = {tuple(r) for r in windows.usable(windows.bank(sql), rate).collect()}
        assert {tuple(r)[1:] for r in got if r.rate == rate} == want
    assert not [r for r in got if r.rate is None]


@pytest.mark.parametrize(("text", "says"), [("window_lattice('x')", "must be a number"), ("window_lattice(1, steps => 2)", "no setting steps"), ("window_lattice(1, nbeg => t.v) ", "must be a constant"), ("band_bank('x')", "must be a number")])
def test_wrong_arguments_are_found_before_anything_runs(sql, text, says):
    with pytest.raises(AnalysisException, match=says):
        sql.sql(f"SELECT * FROM VALUES (1), (2) AS t(v), LATERAL {text}")
