"""The operators on made-up records with known answers."""

import math

import numpy as np
import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fastaxis.functions import geometry as g
from fastaxis.operators import clustering, enrich, grid, measure, publish, quality, query, raypath, store, waveform, windows
from fastaxis.plans import catalog, pipeline
from fastaxis.sources import velocity

RATE = 100.0


def chirp(n, centre, width=0.35, low=2.0, high=9.0):
    """A pulse with a Gaussian envelope that rises in frequency: samples, as a spectrum that can be shifted by any time."""
    t = np.arange(n) / RATE - centre
    return np.fft.fft(np.exp(-((t / width) ** 2)) * np.cos(2 * np.pi * (low + high) / 2 * t + np.pi * (high - low) * t * t))


def birefringent(axis, lag, polarisation, n=1024, centre=5.0):
    """North and east after a layer with this fast axis: motion as complex numbers, the slow part ``lag`` samples late.

    Noise-free, so that undoing axis and lag leaves the horizontal covariance singular.
    """
    spectrum = chirp(n, centre)
    late = np.exp(-2j * np.pi * np.fft.fftfreq(n) * lag)
    alpha = np.radians(polarisation - axis)
    parts = [np.fft.ifft(x).real for x in (spectrum, spectrum * late)]
    motion = np.exp(1j * np.radians(axis)) * (np.cos(alpha) * parts[0] + 1j * np.sin(alpha) * parts[1])
    return motion.real, motion.imag


def record(spark, rec, north, east, back_azimuth):
    """Radial and transverse of north and east: the motion turned by the back azimuth."""
    turned = (np.asarray(north) + 1j * np.asarray(east)) * np.exp(-1j * np.radians(back_azimuth))
    return spark.createDataFrame([(rec, turned.real.tolist(), turned.imag.tolist(), float(back_azimuth))], "rec long, x array<double>, y array<double>, back_azimuth double")


def between_axes(a, b):
    """The angle between two axes: half that of their doubled directions."""
    return abs(np.degrees(np.angle(np.exp(2j * np.radians(a - b))))) / 2


SPANS = [(k, 430 + 4 * k, 590 + 5 * k) for k in range(4)]


@pytest.mark.parametrize("seed", range(5))
def test_both_methods_undo_a_layer(spark, seed):
    """Axes and lags at random, the polarisation 25 to 65 degrees off the axis: both lie on the grid, so the minimum is the truth itself."""
    rnd = np.random.default_rng(100 + seed)
    turn = int(rnd.integers(0, 360))
    on_grid, lag = int(rnd.integers(-90, 90)), int(rnd.integers(4, 19))
    axis = on_grid + turn
    polarisation = axis + int(rnd.integers(25, 66)) * rnd.choice([-1, 1])
    windows_ = spark.createDataFrame(SPANS, "window_idx int, i0 int, i1 int")
    found = pipeline.measured(record(spark, seed, *birefringent(axis, lag, polarisation), turn), windows_, pipeline.Settings(max_lag=20)).collect()
    assert [r.window_idx for r in sorted(found, key=lambda r: r.window_idx)] == [w[0] for w in SPANS]
    for r in found:
        assert between_axes(r.phi, axis) < 1e-6 and r.dt == pytest.approx(lag / RATE)
        assert r.linearity == pytest.approx(0, abs=1e-6)  # one eigenvalue is gone
        assert between_axes(r.rc_phi, axis) <= 6 and abs(r.rc_dt * RATE - lag) <= 2 and r.cc > 0.97


def test_what_is_kept_has_no_rows_for_delays(spark, monkeypatch):
    """Checkpoints hold a row for each record or window, not for each delay."""
    rows, real = [], pipeline.cut

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(pipeline, "cut", counted)
    windows_ = spark.createDataFrame(SPANS, "window_idx int, i0 int, i1 int")
    found = pipeline.measured(record(spark, 1, *birefringent(10, 5, 50), 0), windows_, pipeline.Settings(max_lag=20))
    assert found.count() == len(SPANS) and rows and max(rows) <= len(SPANS)


def test_values_by_window(spark):
    """In the order of all windows, null where a record has none."""
    windows_ = spark.createDataFrame([(9, 0, 5), (4, 0, 6), (7, 1, 5)], "window_idx int, i0 int, i1 int")
    values = spark.createDataFrame([(1, 7, 0.5, 1.0), (1, 4, None, 2.0), (2, 9, 0.25, None)], "rec long, window_idx int, a double, b double")
    found = {r.rec: (r.a, r.b) for r in pipeline.by_window(values, windows_, "a", "b").collect()}
    assert found == {1: ([None, 0.5, None], [2.0, 1.0, None]), 2: ([None, None, 0.25], [None, None, None])}


def test_records_are_graded(spark):
    bounds = spark.createDataFrame([(3 * a + b, 436 + 3 * a, 584 + 4 * b) for a in range(4) for b in range(3)], "window_idx int, i0 int, i1 int")
    rnd = np.random.default_rng(9)
    split = [x + rnd.normal(0, 1e-3, len(x)) for x in birefringent(-35, 9, 12)]
    made = record(spark, 1, *split, 210).unionByName(record(spark, 2, np.zeros(1024), np.zeros(1024), 5))
    split, still = pipeline.results(made, bounds, pipeline.Settings(max_lag=20, k_max=4, n_min=3)).orderBy("rec").collect()
    assert split.quality_class == "Good Split" and split.error is None and split.n_cluster_windows >= 3
    assert between_axes(split.ev_phi, -35) <= 2 and split.ev_dt_ms == pytest.approx(90, abs=10)
    assert still.ev_phi is None and still.error == "no valid cluster"


def test_a_delayed_window_beyond_the_record_has_no_row(spark):
    r = record(spark, 1, *birefringent(10, 5, 50, n=600), 0)
    w = spark.createDataFrame([(0, 460, 595)], "window_idx int, i0 int, i1 int")
    lags = {x.lag for x in grid.lagged_sums(r, w, 12).collect()}
    assert lags == set(range(6))


@pytest.fixture(scope="module")
def ragged(spark):
    """Records of many lengths, some with missing samples and some whose components differ in length or are missing."""
    rnd, made = np.random.default_rng(3), []
    for rec in range(300):
        n = int(rnd.integers(0, 60))
        x, y = rnd.normal(0, 1, n).tolist(), rnd.normal(0, 1, n + int(rec % 5 == 0) * int(rnd.integers(-5, 6)) if n > 5 else n).tolist()
        if rec % 7 == 0 and n > 20:
            x[18:22] = [None] * len(x[18:22])
        made.append((rec, None if rec % 41 == 40 else x, None if rec % 43 == 42 else y, [float(rec), None, rec + 0.5]))
    return made, spark.createDataFrame(made, "rec long, x array<double>, y array<double>, level array<double>").repartition(3)


def test_lagged_sums_of_ragged_records(spark, ragged):
    """Against plain sums over each window: what lacks a factor is left out, and a sum of nothing is null."""
    spans, max_lag = [(4, 12, 40), (7, 10, 31), (9, 18, 21)], 6
    w = spark.createDataFrame(spans, "window_idx int, i0 int, i1 int")
    found = {(r.rec, r.window_idx, r.lag): r for r in grid.lagged_sums(ragged[1], w, max_lag, ("level",)).collect()}
    want = {(rec, k, lag): (x, y, level[spans.index((k, a, b))], a, b) for rec, x, y, level in ragged[0] if x is not None and y is not None for k, a, b in spans for lag in range(max_lag + 1) if b + lag <= len(x)}
    assert set(found) == set(want) and len(want) > 2000
    empty = 0
    for (rec, k, lag), (x, y, level, a, b) in want.items():
        r, y = found[rec, k, lag], y + [None] * 60
        at = {"x": x[a:b], "y": y[a:b], "u": x[a + lag : b + lag], "w": y[a + lag : b + lag]}
        assert r.n == b - a and r.level == level
        for name, names in grid._SUMS.items():
            terms = [math.prod(v) for v in zip(*[at[c] for c in names], strict=True) if None not in v]
            empty += not terms
            assert r[name] is None if not terms else r[name] == pytest.approx(math.fsum(terms), abs=1e-9)
    assert empty


def test_sums_take_no_memory_that_grows_with_the_records(spark):
    """Records are dealt out as single rows; what multiplies them is neither sorted nor held in hash maps, which spill."""
    r, w = record(spark, 1, *birefringent(10, 5, 50), 0), spark.createDataFrame(SPANS, "window_idx int, i0 int, i1 int")
    plan = grid.lagged_sums(r, w, 12)._jdf.queryExecution().sparkPlan().toString()
    after = plan[: plan.index("Exchange")] if "Exchange" in plan else plan
    assert "Sort " not in plan and "Window " not in plan and "keys=[rec" not in after


def test_cells_are_ordered_numbers(spark):
    """Least value, then first axis, then first lag, whatever the sign; a value that is no number comes last and stays one."""
    cells = [(0.25, 3, 7), (0.25, 3, 6), (0.25, -90, 40), (-0.999999999, 90, 0), (1.0000000004, 90, 262143), (0.0, -90, 0), (float("nan"), 5, 1)]
    made = spark.createDataFrame(cells, "v double, phi int, lag int").select("v", "phi", "lag", grid.cell(F.col("v")).alias("b"))
    back = made.select("b", "v", *[c.alias(n) for c, n in zip(grid.opened(F.col("b")), ("phi", "lag", "c"), strict=True)]).orderBy("b").collect()
    assert [(r.phi, r.lag) for r in back] == [c[1:] for c in sorted(cells[:-1], key=lambda c: (round(c[0], 9), *c[1:]))] + [(5, 1)]
    assert all(r.c == round(r.v, 9) for r in back[:-1]) and math.isnan(back[-1].c)


@pytest.mark.parametrize("search", ["ev", "rc", "both", "energy", "corrected"])
def test_no_sort_or_shuffle_sees_the_grid(spark, search):
    """What multiplies windows and delays by 181 axes is aggregated in hash maps, and is made once (twice for energies of any size)."""
    r, w = record(spark, 1, *birefringent(10, 5, 50), 0), spark.createDataFrame(SPANS, "window_idx int, i0 int, i1 int")
    sums = grid.lagged_sums(r, w, 12)
    m = grid.moments(sums)
    found = {
        "ev": lambda: grid.best(m, "c_", grid.ev_objective()),
        "rc": lambda: grid.best(m, "c_", grid.rc_objective(), largest=True),
        "both": lambda: grid.bests(m, "c_"),
        "energy": lambda: grid.least(sums, "", F.col("ss") * 1e12),
        "corrected": lambda: grid.at_best(m, "c_", grid.best(m, "c_", grid.ev_objective())),
    }[search]()
    assert found.count() == len(SPANS)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan
    assert plan.count("Range (-90, 91") == (2 if search == "energy" else 1)


@pytest.mark.parametrize("name", ["q_ev_grid", "q_rc_grid"])
def test_windows_without_motion_meet_the_sql(spark, tmp_path, name):
    """Still or constant components, wholly or up to the last samples: no ratio is made up where SQL has no number."""
    noise = lambda: rnd.normal(0, 1, 64).tolist()
    rnd, late = np.random.default_rng(4), [0.0] * 60 + [1.0, -1.0, 2.0, 0.5]
    records = [(noise(), noise()), ([0.0] * 64, [0.0] * 64), ([0.1] * 64, [0.1] * 64), (late, late), (noise(), [0.0] * 64), ([0.5] * 64, noise())]
    rows = [(3 * rec + k, v) for rec, pair in enumerate(records) for k, v in enumerate((noise(), *pair))]
    ids, vectors = zip(*rows, strict=True)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), f"{tmp_path}/embeddings.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert oracle.difference(found, catalog.ORACLE_SQL[name], oracle.connect(str(tmp_path))) == ""
    assert {r.rec for r in found.filter("isnan(c)").collect()} == {1, 2, 3}


@pytest.mark.parametrize("name", ["q_ev_grid", "q_rc_grid"])
def test_a_search_shuffles_one_row_for_each_window(spark, name):
    """From the sums on there is one shuffle, behind the partial hash aggregate of the grid, and no sort."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan[: plan.index("MapInArrow")].splitlines() if "Exchange" in x or "Aggregate" in x or "Sort" in x]
    assert ["Exchange" in x for x in lines] == [False, True, False] and all("HashAggregate" in x for x in lines[::2]) and "partial_min" in lines[2]


def test_energies_of_any_size_and_no_numbers(spark):
    m = [(1, 0, lag, *[1e9 * (lag + 1)] * 2, 0.0) for lag in (2, 1, 3)] + [(2, 0, 0, float("nan"), 1.0, 0.0)]
    sums = spark.createDataFrame([(rec, w, lag, xx, 0.0, yy, xx, xy, yy, 0.0, xy, xy, 0.0) for rec, w, lag, xx, yy, xy in m], "rec long, window_idx int, lag int, xx double, xy double, yy double, uu double, uw double, ww double, xu double, xw double, yu double, yw double")
    a, b = grid.least(sums, "", F.col("ff") * 1e6 + F.abs("phi")).orderBy("rec").collect()
    assert (a.phi, a.lag, a.c) == (min(range(-90, 91), key=lambda p: (2e15 * 1.0 + abs(p))), 1, 2e15) and math.isnan(b.c)
    e = grid.best(sums, "", grid.ev_objective()).orderBy("rec").collect()
    assert (e[0].phi, e[0].lag, e[0].c) == (-90, 1, 1.0) and math.isnan(e[1].c)


def test_lattice(spark):
    w = windows.lattice(spark, pick=5.0).orderBy("window_idx").collect()
    spans = [r.t1 - r.t0 for r in w]
    assert len(w) == 126 and all(s > 0.4 for s in spans) and spans == pytest.approx(sorted(spans))
    assert windows.lattice(spark, max_delay=2.0).count() == 0


def test_snr_and_bank(spark):
    """Steps of known height: noise of root mean square 0.5 on every component, then 4, 1 and 0.25 times as much."""
    n, rate_of = 1600, {1: 4.0, 2: 1.0, 3: 0.25}
    rows = []
    for rec, times in rate_of.items():
        for k, comp in enumerate("ZNE"):
            sign = np.where(np.arange(n) % 2 == 0, 1.0, -1.0) * (1 if k < 2 else -1)
            rows.append((rec, comp, (0.5 * sign * np.where(np.arange(n) >= 800, times, 1.0)).tolist()))
    flat = [(4, c, [0.0] * n) for c in "ZNE"]
    traces = spark.createDataFrame(rows + flat, "rec long, comp string, data array<double>")
    found = {r.rec: r.snr for r in waveform.snr(traces.select("rec", "comp", F.posexplode("data").alias("i", "v")), (700, 789), (800, 909)).collect()}
    assert found == pytest.approx(rate_of | {4: 0.0})
    assert waveform.snr(traces.select("rec", "comp", F.posexplode("data").alias("i", "v")), (700, 708), (800, 909)).agg(F.max("snr")).first()[0] == 0  # nine samples are too few
    edges = [(2.0, h) for h in (5.0, 44.9, 45.0, 45.1, 60.0)]  # nine tenths of the Nyquist frequency is 45 Hz, and is out
    assert [r.high for r in windows.usable(windows.bank(spark, edges), RATE).orderBy("high").collect()] == [5.0, 44.9]
    t = np.arange(2000) / RATE
    tone = spark.createDataFrame([(9, c, np.sin(2 * np.pi * f * t).tolist()) for c, f in zip("ZNE", (4.0, 7.0, 18.0), strict=True)], "rec long, comp string, data array<double>")
    passed = waveform.filtered(tone, windows.bank(spark, [(3, 9), (15, 22)]), RATE)
    peaks = {(r.comp, r.bank_idx): r.p for r in passed.select("comp", "bank_idx", waveform.peak(F.col("data")).alias("p")).collect()}
    assert all(peaks[c, 0] > 5 * peaks[c, 1] for c in "ZN") and peaks["E", 1] > 5 * peaks["E", 0]


def test_bandpass_response():
    n = 4096
    for f, want in ((5.0, 1.0), (1.0, 0.0), (30.0, 0.0), (3.0, 0.5), (8.0, 0.5)):  # twice half power at the corners
        x = np.sin(2 * np.pi * f * np.arange(n) / RATE)
        y = waveform.bandpass(x, 3.0, 8.0, RATE)
        assert np.abs(y[1000:3000]).max() == pytest.approx(want, abs=0.06)


@pytest.mark.parametrize("cycles", [3, 17, 100])
def test_dominant_period(spark, cycles):
    n = 640
    x = 7 + np.cos(2 * np.pi * cycles * np.arange(n) / n) + 0.3 * np.cos(2 * np.pi * 50 * np.arange(n) / n)
    s = spark.createDataFrame([(1, "N", x.tolist()), (2, "N", None)], "rec long, comp string, data array<double>").filter("data is not null")
    assert waveform.dominant_period(waveform.power_spectrum(s, n), n, RATE).first().period == pytest.approx(n / RATE / cycles)


def test_flags_and_orientation(spark):
    flat = [0.0] * 10
    rows = [(1, c, [1.0, -2.0]) for c in "ZNE"] + [(2, "Z", [1.0]), (2, "N", [1.0])] + [(3, "Z", [1.0]), (3, "N", flat), (3, "E", [1.0])] + [(4, "Z", [9.0]), (4, "N", [10.0]), (4, "E", [6.0])]
    traces = spark.createDataFrame(rows, "rec long, comp string, data array<double>")
    assert {r.rec: r.reason for r in waveform.quality_flags(traces, F.col("comp") != "Z").collect()} == {1: None, 2: "fewer than three channels", 3: "dead sensor", 4: "horizontal amplitudes differ"}
    turned = [(1, "HH1", 30.0, 0.0, [math.cos(math.radians(30))]), (1, "HH2", 120.0, 0.0, [-math.sin(math.radians(30))]), (1, "HHZ", 0.0, -90.0, [7.0]), (2, "HH1", 0.0, 0.0, [1.0]), (2, "HH2", 0.0, 0.0, [1.0]), (2, "HHZ", 0.0, -90.0, [1.0])]
    made = {r.rec: r for r in waveform.to_zne(spark.createDataFrame(turned, "rec long, code string, azimuth double, dip double, data array<double>")).collect()}
    assert (made[1].z[0], made[1].n[0], made[1].e[0]) == pytest.approx((7, 1, 0), abs=1e-9)
    assert made[2].n is None


def test_quality_index(spark):
    rows = [(40.0, 0.12, 41.0, 0.12, "Good Split"), (85.0, 0.001, 40.0, 0.12, "Good Null"), (60.0, 0.06, 40.0, 0.12, "Poor/Noise"), (10.0, 0.1, 180.0, 0.1, "Poor/Noise"), (40.0, 0.1, 40.0, 0.0, "Poor/Noise")]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want string")
    got = df.select("want", g.quality_index(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 0.75).alias("q")).collect()
    assert [r.q["class"] for r in got] == [r.want for r in got]
    assert got[3].q.omega == pytest.approx(80 / 45)  # folded once only, not around 180


def test_consensus(spark):
    rows = [(1, 0, 40.0, 0.120, 2.0, 0.004), (1, 1, 45.0, 0.125, 2.0, 0.004), (1, 2, 80.0, 0.300, 2.0, 0.004)]
    c = quality.consensus(spark.createDataFrame(rows, "grp long, window_idx long, phi double, dt double, phi_err double, dt_err double")).first()
    assert (c.phi, c.dt, c.n_used) == (42.5, pytest.approx(0.1225), 2)


@pytest.mark.parametrize("linkage", clustering.LINKAGES)
def test_dendrogram(linkage):
    rnd = np.random.default_rng(3)
    points = np.concatenate([rnd.normal(0, 0.1, (12, 2)), rnd.normal(5, 0.1, (9, 2)), rnd.normal((0, 9), 0.1, (4, 2))])
    merges = clustering.dendrogram(points, linkage)
    assert [m[2] for m in merges] == sorted(m[2] for m in merges) and merges[-1][3] == 25
    assert clustering.cut_labels(25, merges, 3).tolist() == [0] * 12 + [1] * 9 + [2] * 4
    assert clustering.cut_labels(25, merges, 1).tolist() == [0] * 25
    # By brute force: merge the nearest pair again and again.
    if linkage in ("single", "complete"):
        groups, heights = [[i] for i in range(25)], []
        d = np.linalg.norm(points[:, None] - points[None], axis=2)
        pick = np.min if linkage == "single" else np.max
        while len(groups) > 1:
            h, a, b = min((pick(d[np.ix_(x, y)]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
            heights.append(h)
            groups[a] += groups.pop(b)
        assert [m[2] for m in merges] == pytest.approx(heights)


def test_clusters_of_measurements(spark):
    """A tight group among scattered ones: the answer lies in the group, whichever comes first."""
    rnd = np.random.default_rng(77)
    tight = [(131 + rnd.uniform(-1, 1), 0.21 + rnd.uniform(-0.003, 0.003), rnd.uniform(1, 3), rnd.uniform(0.003, 0.006)) for _ in range(24)]
    loose = [(rnd.uniform(5, 60), rnd.uniform(0.02, 0.10), rnd.uniform(4, 9), rnd.uniform(0.01, 0.02)) for _ in range(9)]
    for rec, rows in ((3, loose + tight), (4, tight + loose)):
        m = spark.createDataFrame([(rec, k, *map(float, x)) for k, x in enumerate(rows)], "rec long, window_idx long, phi double, dt double, phi_err double, dt_err double")
        found = pipeline.clustered(m, pipeline.Settings(k_max=8, n_min=6)).collect()
        best = rows[found[0].best_window]
        assert best in tight and found[0].n_in_cluster >= 6 and all(rows[r.window_idx] in tight for r in found)
        in_arrays = measure.chosen([{"window": k, "ev": dict(zip(("phi", "dt", "phi_err", "dt_err"), x, strict=True))} for k, x in enumerate(rows)], "ward", 8, 6, 3.2)
        assert (in_arrays["best"]["window"], in_arrays["n_clusters"], in_arrays["n_in_cluster"]) == (found[0].best_window, found[0].n_clusters, found[0].n_in_cluster)
    assert pipeline.clustered(m.limit(2)).count() == 0


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    schema = "event_id string, network string, station string, pick_id string, qfinal double, status string, updated_utc timestamp"
    row = lambda q, status="ok", at="2026-01-01", e="ev1": spark.createDataFrame([(e, "HL", "ATH", "p", q, status, None)], schema).withColumn("updated_utc", F.lit(at).cast("timestamp"))
    from fastaxis.config import build

    run = s.begin_run("1", build())
    assert s.table("results") is None
    s.upsert(row(0.8))
    s.count(run, row(0.8))
    assert s.upsert(row(0.5, at="2025-01-01")).first().qfinal == 0.5  # the later write wins, whatever it says
    s.upsert(row(None, "failed", e="ev2"))
    s.count(run, row(None, "failed", e="ev2"))
    assert s.table("results").count() == 2
    s.init()
    s.count(run, row(0.1), "b1")
    s.count(run, row(0.1), "b1")
    r = query.query_runs(s.table("runs")).first()
    assert (r.n_ok, r.n_failed) == (2, 1)
    s.count(run, row(0.1).limit(0), "b2")
    assert (r.n_ok, r.n_failed, r.finished_utc) == (2, 1, None) and s.begin_run("1", build()) == 2


def test_store_survives_lost_writers(spark, tmp_path, monkeypatch):
    """A write that is lost before its manifest stands leaves the version before; of two writers of one version one fails."""
    make = lambda k, q: spark.createDataFrame([(f"e{k}", "XA", "S", f"p{k}", q)], "event_id string, network string, station string, pick_id string, qfinal double").withColumn("updated_utc", F.current_timestamp())
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.init()
    assert s.table("results") is None
    for k in range(6):
        s.upsert(make(k, 0.1))
    files = {p.name for p in (tmp_path / "store" / "results").rglob("*.parquet")}
    with monkeypatch.context() as m:
        m.setattr(store.Store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.upsert(make(2, 0.9))
    assert {r.event_id: r.qfinal for r in s.table("results").collect()} == {f"e{k}": 0.1 for k in range(6)}
    before = s._manifest("results")
    s.upsert(make(2, 0.5))
    assert {r.event_id: r.qfinal for r in s.table("results").collect()}["e2"] == 0.5
    # Only the partition of the event was written anew.
    after = s._manifest("results")[1]
    assert sum(after[k] != before[1].get(k) for k in after) == 1 and len(after) > 1 and files
    with pytest.raises(RuntimeError):
        s._commit("results", before[0] + 1, after)
    assert s.vacuum(keep=1) > 0 and s.table("results").count() == 6


def test_equal_picks_stay_apart(spark):
    picks = spark.createDataFrame([("XA.S", "2020-06-01"), ("XA.S", "2020-06-01"), (None, "2020-06-01")], "site string, at string")
    epochs = spark.createDataFrame([("XA.S", "2000-01-01", None, 7)], "site string, start string, end string, n int")
    assert sorted((r.site or "", r.n) for r in enrich.as_of(picks, epochs, "site", "at").collect()) == [("", None), ("XA.S", 7), ("XA.S", 7)]


def catalogue():
    """Sixty results with every combination of state, network and class, in an order that is not that of time."""
    out = []
    for k in range(60):
        failed, grade = k % 7 == 3, ("Good Split", "Good Null", "Poor/Noise")[k % 3]
        hour = (k * 37) % 60
        out.append((f"q{k:02d}", None if k % 20 == 13 else f"2023-05-{1 + hour // 24:02d} {hour % 24:02d}:00:00", -12.5 + 0.25 * k, 1.0 + (k * 11 % 40) / 10, "XA" if k % 2 else "XB", f"S{k % 5}", float(k * 13 % 90), None if failed else (k * 29 % 180) - 90.0, None if failed else (k * 17 % 41) / 20 - 1, None if failed else grade, "failed" if failed else "ok"))
    return out


FIELDS = "event_id t event_latitude magnitude network station epi_distance_km ev_phi qfinal quality_class status".split()


@pytest.fixture
def results(spark):
    df = spark.createDataFrame(catalogue(), "event_id string, t string, event_latitude double, magnitude double, network string, station string, epi_distance_km double, ev_phi double, qfinal double, quality_class string, status string")
    return df.withColumn("origin_time", F.col("t").cast("timestamp")).drop("t")


@pytest.mark.parametrize(
    ("given", "holds"),
    [
        ({}, lambda r: True),
        ({"network": "XA"}, lambda r: r["network"] == "XA"),
        ({"station": "S2", "network": "XB"}, lambda r: (r["station"], r["network"]) == ("S2", "XB")),
        ({"quality_class": "Poor/Noise"}, lambda r: r["quality_class"] == "Poor/Noise"),
        ({"start_time": "2023-05-02 06:00:00"}, lambda r: r["t"] is not None and r["t"] >= "2023-05-02 06:00:00"),
        ({"min_event_latitude": -5.0, "max_event_latitude": 0.0}, lambda r: -5 <= r["event_latitude"] <= 0),
        ({"min_magnitude": 3.3}, lambda r: r["magnitude"] >= 3.3),
        ({"min_qfinal": 0.2}, lambda r: r["qfinal"] is not None and r["qfinal"] >= 0.2),
        ({"max_epi_distance_km": 13.0}, lambda r: r["epi_distance_km"] <= 13),
    ],
    ids=lambda x: "-".join(x) if isinstance(x, dict) else "",
)
@pytest.mark.parametrize("status", ["ok", "failed", "all"])
def test_result_queries_select_what_holds(results, given, holds, status):
    rows = [dict(zip(FIELDS, r, strict=True)) for r in catalogue()]
    want = {r["event_id"]: r["t"] for r in rows if holds(r) and status in ("all", r["status"])}
    got = [r.event_id for r in query.query_results(results, status=status, **given).collect()]
    assert sorted(got) == sorted(want)
    times = [want[e] for e in got]
    dated = [t for t in times if t is not None]
    assert dated == sorted(dated, reverse=True)
    if status == "ok":
        assert [r.event_id for r in query.query_results(results, **given).collect()] == got
        assert [r.event_id for r in query.query_results(results, limit=2, **given).collect()] == got[:2]


@pytest.mark.parametrize("given", [{"limit": 0}, {"limit": 100_001}, {"status": "lost"}, {"colour": 1}])
def test_result_queries_reject(results, given):
    with pytest.raises(query.InvalidQuery):
        query.query_results(results, **given)


def test_forms(spark, results, tmp_path):
    query.write_csv(results, f"file://{tmp_path}/csv")
    text = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv").read_text().splitlines()
    assert text[0].split(",") == list(query.CSV) and len(query.CSV) == 54
    import json

    j = json.loads(query.rendered(results.filter("event_id = 'q03'"), "json").first().json)
    assert j["event_id"] == "q03" and j["ev_phi"] is None
    with pytest.raises(query.InvalidQuery):
        query.rendered(results, "xml")


def test_comments(spark, tmp_path):
    r = spark.createDataFrame([("p1", 0.81234567, "Good Split", None), ("p2", None, None, None), ("p3", None, None, "no signal")], "pick_id string, qfinal double, quality_class string, error string")
    c = publish.comments(r, "1", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    assert [x.pick_id for x in c.collect()] == ["p1"] and '"qfinal":0.8123' in c.first().text and '"ev_phi_deg":null' in c.first().text
    assert publish.send(c, f"file://{tmp_path}/c") and not publish.send(c.limit(0), f"file://{tmp_path}/c")


def test_inventory(spark):
    picks = spark.createDataFrame([("a", "ATH", "HH", "2020-06-01"), ("b", "ATH", "HH", "1990-01-01")], "pick string, station string, prefix string, at string").withColumn("at", F.col("at").cast("timestamp"))
    ch = spark.createDataFrame([("ATH", "HHZ", "2000-01-01", "2010-01-01", 0.0, -90.0), ("ATH", "HHZ", "2010-01-01", None, 1.0, -89.0), ("ATH", "HHN", "2010-01-01", "2020-06-01", 2.0, 0.0), ("ATH", "HHE", None, None, 90.0, 0.0), ("ATH", "BHE", "2000-01-01", None, 90.0, 0.0), ("ATH", "HH1", "2000-01-01", None, None, 0.0)], "station string, code string, start string, end string, azimuth double, dip double").withColumns({c: F.col(c).cast("timestamp") for c in ("start", "end")})
    got = {r.pick: r.orientations for r in enrich.orientations(picks, ch).collect()}
    assert {k: v.azimuth for k, v in got["a"].items()} == {"HHZ": 1.0, "HHN": 2.0} and got["b"] is None
    assert spark.range(1).select(enrich.seed_id(F.lit("HL"), F.lit("ATH"), F.lit(None), F.lit("HHZ")).alias("s")).first().s == "HL.ATH..HHZ"


def test_rays_in_a_uniform_sphere():
    """There all rays are chords."""
    rnd = np.random.default_rng(4)
    depth, angle = rnd.uniform(0, 700, 500), rnd.uniform(0, 1.2, 500)
    time, takeoff, incidence = raypath.Rays(np.array([(0, 4.0), (6371, 4.0)])).first_arrival(depth, angle)
    r = 6371 - depth
    chord = np.sqrt(6371**2 + r**2 - 2 * 6371 * r * np.cos(angle))
    assert time == pytest.approx(chord / 4, rel=1e-7)
    assert incidence == pytest.approx(np.degrees(np.arccos((6371 - r * np.cos(angle)) / chord)), abs=1e-3)
    assert takeoff == pytest.approx(np.degrees(np.arccos((r - 6371 * np.cos(angle)) / chord)), abs=1e-3)


def test_the_earliest_ray_wins():
    """Over a fast half-space, the ray that turns in it overtakes the direct one."""
    rays = raypath.Rays(np.array([(0, 2.0), (10, 2.0), (10, 6.0), (6371, 6.0)]))
    depth, angle = np.full(40, 5.0), np.linspace(0.0, 0.1, 40)
    (_, up), (_, down) = rays.upward(depth, angle), rays.downward(depth, angle)
    time, takeoff, _ = rays.first_arrival(depth, angle)
    both = np.fmin(up, down)
    assert time == pytest.approx(both) and takeoff[0] == pytest.approx(180)
    assert (takeoff[up < down] > 90).all() and (takeoff[down < up] < 90).all() and (down < up).any()
    assert (np.diff(time) > 0).all()
    # Linear in depth: the time to straight above is the integral of the slowness.
    linear = raypath.Rays(np.array([(0, 3.0), (100, 5.0)]))
    assert linear.first_arrival(np.array([80.0]), np.array([0.0]))[0][0] == pytest.approx(math.log(4.6 / 3.0) / 0.02, rel=1e-3)


def test_rays(spark, tmp_path):
    metres, back = raypath.inverse_geodesic([50.0663222], [-5.71475], [58.6440222], [-3.0700944])
    assert metres[0] == pytest.approx(969954.1, abs=1) and back[0] == pytest.approx(191.295, abs=0.1)
    (tmp_path / "m.nd").write_text("# a crust\n 0.0 4.8 2.7 2.7\n 4.0 4.8 2.7 2.7\nmantle\n 4.0 5.2 2.9 2.75\n 6371.0 7.0 3.9 3.3\n")
    model = velocity.profile(velocity.layers(spark, f"file://{tmp_path}/m.nd"))
    assert model.tolist() == [[0, 2.7], [4, 2.7], [4, 2.9], [6371, 3.9]]
    (tmp_path / "m.tvel").write_text("a model - P\n1 2 3 4\n 0.0 4.8 2.7 2.7\n 35.0 5.8 3.4 2.7\n")
    assert velocity.profile(velocity.layers(spark, f"file://{tmp_path}/m.tvel")).tolist() == [[0, 2.7], [35, 3.4]]
    with pytest.raises(ValueError):
        velocity.profile(velocity.layers(spark, f"file://{tmp_path}/m.tvel"), most=1)
    tasks = spark.createDataFrame([(1, 38.0, 23.0, 10.0, 38.05, 23.0), (2, 38.0, 23.0, 10.0, 39.5, 23.0), (3, 38.0, 23.0, 10.0, None, 23.0)], "id long, event_latitude double, event_longitude double, event_depth_km double, station_latitude double, station_longitude double")
    near, far, none = raypath.screened(tasks, model).orderBy("id").collect()
    assert near.error is None and near.takeoff_angle > 90 and near.backazimuth == pytest.approx(180, abs=0.1)
    assert "incidence" in far.error and "missing" in none.error


def test_closed_forms(spark):
    # The covariance eigenvalues do not change under rotation.
    rnd = np.random.default_rng(2)
    x, y = rnd.normal(size=50), rnd.normal(size=50) + 0.4
    v = np.linalg.eigvalsh(np.cov(x, y))
    df = spark.createDataFrame([(float(np.var(x, ddof=1)), float(np.var(y, ddof=1)), float(np.cov(x, y)[0, 1]))], "a double, b double, c double")
    assert df.select(g.eigenvalue_ratio(F.col("a"), F.col("b"), F.col("c")).alias("r")).first().r == pytest.approx(v[0] / v[1])
    r = spark.createDataFrame([(0.9, 20.0), (1.0, 20.0), (0.5, 2.0)], "r double, n double").select(g.fisher_lower(F.col("r"), F.col("n")).alias("l"), g.confidence_level(F.col("r"), F.col("n")).alias("c")).collect()
    assert r[0].l == pytest.approx(math.tanh(math.atanh(0.9) - 1.6448536269514722 / math.sqrt(17))) and r[1].l is None and r[2].l is None and r[2].c is None


@pytest.mark.parametrize("linkage", clustering.LINKAGES)
def test_many_dendrograms_at_once(linkage):
    """Groups merged together have the dendrograms and cuts of each alone, with points that coincide and distances that tie."""
    rnd = np.random.default_rng(8)
    for n in (1, 2, 3, 9, 30):
        points = np.concatenate([rnd.integers(0, 6, (12, n, 2)) / 5, rnd.normal(size=(12, n, 2))])
        pairs, heights = clustering.dendrograms(points, linkage)
        labels = clustering.labels_of_cuts(pairs, 6)
        assert sorted(labels) == list(range(2, min(6, n) + 1))
        for g, own in enumerate(points):
            merges = clustering.dendrogram(own, linkage)
            assert [m[2] for m in merges] == heights[g].tolist()
            assert all(clustering.cut_labels(n, merges, k).tolist() == label[g].tolist() for k, label in labels.items())


def test_cuts_of_groups_that_batches_divide(spark):
    """Groups of 1 to 9 rows, batches of four: a group's rows meet again, and none sees another's."""
    rnd = np.random.default_rng(2)
    groups = {g: rnd.integers(0, 5, (1 + g % 9, 2)) / 4 for g in range(25)}
    rows = [(g, k, *map(float, p)) for g, own in groups.items() for k, p in enumerate(own)]
    rnd.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        made = clustering.cuts(spark.createDataFrame([(int(g), int(w), x, y) for g, w, x, y in rows], "grp long, window_idx long, x double, y double"), "x", "y", 4)
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
        found = {(r.grp, r.k, r.window_idx): r.cluster for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for g, own in groups.items():
        merges = clustering.dendrogram(own) if len(own) > 1 else []
        for k in range(2, min(4, len(own)) + 1):
            want |= {(g, k, w): int(c) for w, c in enumerate(clustering.cut_labels(len(own), merges, k))}
    assert found == want


def test_short_records_are_filtered_as_long_ones(monkeypatch):
    """The product with a matrix is the transform's answer, of few rows at a time too."""
    x = np.random.default_rng(5).normal(size=(7, 64))
    for low, high in windows.FILTER_BANK[:4] + [(4.0, 10.0), (1.0, 20.0)]:
        made = waveform.bandpass(x, low, high, RATE)
        with monkeypatch.context() as patch:
            patch.setattr(waveform, "SHORT", 0)
            patch.setattr(waveform, "HELD", 1 << 14)
            assert np.allclose(waveform.bandpass(x, low, high, RATE), made, rtol=0, atol=1e-12)


def test_filtered_pieces_are_whole(spark):
    """Traces of several lengths leave in pieces: each row once, with its own band and answer."""
    rnd = np.random.default_rng(6)
    data = {(r, "N"): rnd.normal(size=n).tolist() for r, n in enumerate((64, 300, 64, 1, 64, 300))}
    traces = spark.createDataFrame([(r, c, v) for (r, c), v in data.items()], "rec long, comp string, data array<double>")
    found = waveform.filtered(traces, windows.bank(spark, [(1.0, 8.0), (2.0, 6.0)]), RATE).collect()
    assert len(found) == 12 and {(r.rec, r.bank_idx) for r in found} == {(r, b) for r in range(6) for b in range(2)}
    for r in found:
        assert np.allclose(r.data, waveform.bandpass(np.array(data[r.rec, r.comp]), r.low, r.high, RATE), rtol=0, atol=1e-12)


def test_windows_are_measured_together(monkeypatch):
    """A window's answer doesn't depend on the others, one without motion has none, and spectra are made for many windows at once."""
    xy = np.random.default_rng(3).normal(size=(2, 80))
    xy[:, :24] = 0
    spans = [(0.0, 0.2)] + [(0.2 + a / 50, 0.48 + b / 50) for a in range(5) for b in range(4)] + [(0.3, 0.9)]
    ask = lambda spans: measure.measured(xy, 100.0, spans, 0.03, 0.75, 30.0)
    monkeypatch.setattr(measure, "CELLS", 3 * 181 * 4, raising=False)
    alone = [ask([span])[0] for span in spans]
    pieces = ask(spans)
    monkeypatch.undo()
    calls, fft = [], np.fft.fft
    monkeypatch.setattr(np.fft, "fft", lambda *a, **k: calls.append(1) or fft(*a, **k))
    found = ask(spans)
    assert len(calls) <= 3
    assert found[0]["ev"] is found[0]["rc"] is found[-1]["ev"] is None and all(w["ev"] and w["rc"] for w in found[1:-1])
    for w, *others in zip(found, alone, pieces, strict=True):
        for other in others:
            for method in ("ev", "rc", "q"):
                assert (w[method] is None) == (other[method] is None)
                if w[method]:
                    assert {k: v for k, v in w[method].items() if isinstance(v, str)} == {k: v for k, v in other[method].items() if isinstance(v, str)}
                    assert {k: v for k, v in w[method].items() if not isinstance(v, str)} == pytest.approx({k: v for k, v in other[method].items() if not isinstance(v, str)}, abs=1e-9, nan_ok=True)


def test_picks_are_dealt_however_small(spark):
    """Measurements are spread over all shuffle partitions: they are long, and few bytes are no reason to do them in one task."""
    from fastaxis.plans import catalog

    plan = catalog.QUERIES["q_picks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    measured = plan[plan.index("FlatMapGroupsInArrow") :] if "FlatMapGroupsInArrow" in plan else plan
    assert measured.count("REPARTITION_BY_NUM") >= 1
