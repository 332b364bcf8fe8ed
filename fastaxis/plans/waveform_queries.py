"""Queries over traces: screening, preparation, windows and the grid searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fastaxis.functions import geometry as g
from fastaxis.functions import surface
from fastaxis.operators import grid, waveform, windows
from fastaxis.plans import pipeline
from fastaxis.plans.views import MEASURES, RESULTS, TRACES
from fastaxis.sources import tables

Q: dict = {}
SQL: dict[str, str] = {}
#: Delays searched and the analysis window of the single-window queries, in samples.
MAX_LAG, I0, I1 = 12, 16, 44


def q_snr(spark, sf_dir):
    found = waveform.snr(tables.samples(spark, sf_dir), noise=(4, 22), signal=(22, 44))
    return found.select("rec", F.round("snr", 6).alias("snr"))


SQL["q_snr"] = f"""WITH {TRACES}, p AS (SELECT rec, comp, sqrt(avg(v * v) FILTER (i BETWEEN 4 AND 22)) AS n, sqrt(avg(v * v) FILTER (i BETWEEN 22 AND 44)) AS s FROM v_samples GROUP BY rec, comp)
 SELECT rec, round(coalesce(avg(CASE WHEN n > 0 THEN s / n END), 0), 6) AS snr FROM p GROUP BY rec"""


def q_qc_flags(spark, sf_dir):
    return waveform.quality_flags(tables.traces(spark, sf_dir), F.col("comp") != "Z").select("rec", "n_channels", "reason")


SQL["q_qc_flags"] = f"""WITH {TRACES}, p AS (SELECT rec, comp, max(abs(v)) AS m FROM v_samples GROUP BY rec, comp), r AS (SELECT rec, count(DISTINCT comp) AS n_channels, min(m) AS lowest, min(m) FILTER (comp <> 'Z') AS h0, max(m) FILTER (comp <> 'Z') AS h1 FROM p GROUP BY rec)
 SELECT rec, n_channels, CASE WHEN n_channels < 3 THEN 'fewer than three channels' WHEN lowest <= 1e-6 THEN 'dead sensor' WHEN 100 - 100 * h0 / h1 > 30 THEN 'horizontal amplitudes differ' END AS reason FROM r"""


def q_sql_lattice(spark, sf_dir):
    """Every record's analysis windows, from SQL text: a lateral join with the lattice."""
    surface.register(spark)
    picks = tables.traces(spark, sf_dir).filter("comp = 'Z'").select("rec", (F.col("rec") % 50 / 10).alias("at"))
    return spark.sql("SELECT rec, window_idx, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM {p}, LATERAL window_lattice(at, max_delay => 0.4)", p=picks)


SQL["q_sql_lattice"] = f"""WITH {TRACES}, w AS (SELECT a, b, -0.1::DOUBLE - a * 0.05::DOUBLE AS t0, 0.1::DOUBLE + b * 0.01::DOUBLE AS t1 FROM range(10) x(a), range(20) y(b)), k AS (SELECT t0, t1, (row_number() OVER (ORDER BY round(t1 - t0, 9), a, b) - 1)::INTEGER AS window_idx FROM w WHERE t0 >= -0.5 - 1e-9 AND t1 <= 0.4 + 1e-9 AND t1 - t0 > 0.4 + 1e-6)
 SELECT rec, window_idx, round(t0 + rec % 50 / 10.0::DOUBLE, 6) AS t0, round(t1 + rec % 50 / 10.0::DOUBLE, 6) AS t1 FROM v_traces, k WHERE comp = 'Z'"""


def q_horizontal_spread(spark, sf_dir):
    return waveform.quality_flags(tables.traces(spark, sf_dir), F.col("comp") != "Z").select("rec", F.round("spread", 6).alias("spread"))


SQL["q_horizontal_spread"] = f"WITH {TRACES}, p AS (SELECT rec, comp, max(abs(v)) AS m FROM v_samples WHERE comp <> 'Z' GROUP BY rec, comp) SELECT rec, round(100 - 100 * min(m) / max(m), 6) AS spread FROM p GROUP BY rec"


def q_gaps(spark, sf_dir):
    """Gaps of a day or more between the segments that a user's events make."""
    b = tables.bus(spark, sf_dir)
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    found = waveform.gaps(b.select("key", t.alias("start"), (t + 3600 * F.abs("payload") / 10).alias("end")), 86_400.0)
    return found.groupBy("key").agg(F.count("*").alias("n_gaps"), F.round(F.max("gap"), 3).alias("longest"))


SQL["q_gaps"] = """WITH s AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + 3600 * abs(value) / 10 AS "end" FROM events), d AS (SELECT key, start - lag("end") OVER (PARTITION BY key ORDER BY start) AS gap FROM s)
 SELECT key, count(*) AS n_gaps, round(max(gap), 3) AS longest FROM d WHERE gap >= 86400 GROUP BY key"""


def q_detrend(spark, sf_dir):
    d = waveform.detrended(tables.samples(spark, sf_dir))
    return d.groupBy("rec", "comp").agg(F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 6).alias("rms"), F.round(F.max("v"), 6).alias("top"))


SQL["q_detrend"] = f"""WITH {TRACES}, l AS (SELECT rec, comp, regr_slope(v, i) AS a, regr_intercept(v, i) AS b FROM v_samples GROUP BY rec, comp), d AS (SELECT s.rec, s.comp, v - b - a * i AS v FROM v_samples s JOIN l ON s.rec = l.rec AND s.comp = l.comp)
 SELECT rec, comp, round(sqrt(avg(v * v)), 6) AS rms, round(max(v), 6) AS top FROM d GROUP BY rec, comp"""


def q_decimate(spark, sf_dir):
    d = waveform.decimated(tables.traces(spark, sf_dir), 3)
    return d.select("rec", "comp", F.size("data").cast("long").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


SQL["q_decimate"] = f"WITH {TRACES} SELECT rec, comp, count(*) AS n, round(sum(v), 6) AS total FROM v_samples WHERE i % 3 = 0 GROUP BY rec, comp"


def q_sampling_rate(spark, sf_dir):
    r = tables.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("rate")).withColumn("x", waveform.resampling(F.col("rate"), 100.0, True))
    return r.select("p_partkey", F.col("x.every").cast("long").alias("every"), F.col("x.reason").alias("reason"))


SQL["q_sampling_rate"] = """SELECT p_partkey, CASE WHEN p_size >= 10 AND p_size % 10 = 0 THEN (p_size // 10)::BIGINT END AS every,
 CASE WHEN p_size < 10 THEN 'sampling rate too low' WHEN p_size % 10 <> 0 THEN 'sampling rate is no multiple' END AS reason FROM part"""


def q_rotate2d(spark, sf_dir):
    s = tables.horizontals(spark, sf_dir).select("rec", F.explode(F.arrays_zip("n", "e")).alias("x"))
    along, across = g.rotate(F.col("x.n"), F.col("x.e"), F.pmod(F.col("rec") * 37, F.lit(360)).cast("double"))
    return s.select("rec", along.alias("r"), across.alias("t")).groupBy("rec").agg(F.round(F.sum(F.col("r") * F.col("r")), 6).alias("energy_r"), F.round(F.sum(F.col("t") * F.col("t")), 6).alias("energy_t"))


SQL["q_rotate2d"] = f"""WITH {TRACES}, x AS (SELECT *, radians((rec * 37) % 360) AS a FROM v_hor)
 SELECT rec, round(sum((cos(a) * n + sin(a) * e) ** 2), 6) AS energy_r, round(sum((cos(a) * e - sin(a) * n) ** 2), 6) AS energy_t FROM x GROUP BY rec"""


def q_rotate3d(spark, sf_dir):
    wide = tables.traces(spark, sf_dir).groupBy("rec").agg(*[F.max(F.when(F.col("comp") == c.upper(), F.col("data"))).alias(c) for c in "zne"])
    s = wide.select("rec", F.explode(F.arrays_zip("z", "n", "e")).alias("x"))
    l, q, t = g.lqt(F.col("x.z"), F.col("x.n"), F.col("x.e"), F.pmod(F.col("rec") * 37, F.lit(360)).cast("double"), (10 + F.col("rec") % 40).cast("double"))
    return s.select("rec", l.alias("l"), q.alias("q"), t.alias("t")).groupBy("rec").agg(*[F.round(F.sum(F.col(c) * F.col(c)), 6).alias(f"energy_{c}") for c in "lqt"])


SQL["q_rotate3d"] = f"""WITH {TRACES}, x AS (SELECT h.*, z.v AS z, radians((h.rec * 37) % 360) AS a, radians(10 + h.rec % 40) AS b FROM v_hor h JOIN v_samples z ON z.rec = h.rec AND z.i = h.i AND z.comp = 'Z')
 SELECT rec, round(sum((cos(b) * z - sin(b) * (sin(a) * e + cos(a) * n)) ** 2), 6) AS energy_l, round(sum((sin(b) * z + cos(b) * (sin(a) * e + cos(a) * n)) ** 2), 6) AS energy_q, round(sum((sin(a) * n - cos(a) * e) ** 2), 6) AS energy_t FROM x GROUP BY rec"""


def q_orient_zne(spark, sf_dir):
    """Three channels turned by record and dipping a little, brought back to vertical, north and east."""
    t = tables.traces(spark, sf_dir)
    turn = (F.col("rec") * 11 % 90).cast("double")
    az = F.when(F.col("comp") == "E", turn + 90).otherwise(turn)
    dip = F.when(F.col("comp") == "Z", F.lit(-90.0)).otherwise(F.lit(0.0))
    made = waveform.to_zne(t.select("rec", F.col("comp").alias("code"), az.alias("azimuth"), dip.alias("dip"), "data"))
    s = made.select("rec", F.explode(F.arrays_zip("z", "n", "e")).alias("x"))
    return s.groupBy("rec").agg(*[F.round(F.sum(F.col(f"x.{c}") * F.col(f"x.{c}")), 5).alias(f"energy_{c}") for c in "zne"])


SQL["q_orient_zne"] = f"""WITH {TRACES}, x AS (SELECT h.*, z.v AS z, radians(h.rec * 11 % 90) AS a FROM v_hor h JOIN v_samples z ON z.rec = h.rec AND z.i = h.i AND z.comp = 'Z')
 SELECT rec, round(sum(z * z), 5) AS energy_z, round(sum((cos(a) * n - sin(a) * e) ** 2), 5) AS energy_n, round(sum((sin(a) * n + cos(a) * e) ** 2), 5) AS energy_e FROM x GROUP BY rec"""


def q_windows(spark, sf_dir):
    w = windows.lattice(spark, pick=10.0)
    return w.select(F.col("window_idx").cast("long").alias("window_idx"), F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), windows.truncated(F.round("t0", 9), F.lit(100.0)).cast("long").alias("i0"))


SQL["q_windows"] = """WITH g AS (SELECT a, b, -0.1 - a * 0.05 AS t0, 0.1 + b * 0.01 AS t1 FROM range(10) x(a), range(20) y(b)), k AS (SELECT * FROM g WHERE t0 >= -0.5 - 1e-9 AND t1 <= 0.4 + 1e-9 AND t1 - t0 > 0.4 + 1e-6)
 SELECT row_number() OVER (ORDER BY round((t1 - t0)::DOUBLE, 9), a, b) - 1 AS window_idx, round((t0 + 10)::DOUBLE, 6) AS t0, round((t1 + 10)::DOUBLE, 6) AS t1, trunc(round((t0 + 10)::DOUBLE, 9) * 100)::BIGINT AS i0 FROM k"""


def q_filter_rank(spark, sf_dir):
    """Every result's bands: each of the bank with an snr that follows from the event."""
    r = tables.results(spark, sf_dir).select(F.col("event_id").alias("pick"), "snr").filter("snr is not null")
    bands = windows.usable(windows.bank(spark), 100.0)
    c = r.crossJoin(F.broadcast(bands)).withColumn("snr", F.col("snr") * (1 + (F.col("pick") * 7 + F.col("bank_idx") * 13) % 17 / 10))
    return windows.ranked(c, 3.0, best=3).select("pick", F.col("filter_rank").cast("long").alias("filter_rank"), F.col("bank_idx").cast("long").alias("bank_idx"), F.round("score", 6).alias("score"))


SQL["q_filter_rank"] = "WITH " + RESULTS + ", bank AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(windows.FILTER_BANK)) + """) t(bank_idx, low, high) WHERE high < 45),
 c AS (SELECT event_id AS pick, bank_idx, snr * (1 + (event_id * 7 + bank_idx * 13) % 17 / 10.0::DOUBLE) AS snr, low, high FROM v_results, bank WHERE snr IS NOT NULL), s AS (SELECT *, round(snr * log2(high / low), 9) AS score FROM c WHERE snr >= 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY pick ORDER BY score DESC, bank_idx) AS filter_rank FROM s) SELECT pick, filter_rank, bank_idx::BIGINT AS bank_idx, round(score, 6) AS score FROM k WHERE filter_rank <= 3"""


def _sums(spark, sf_dir, w=None):
    records = tables.horizontals(spark, sf_dir).select("rec", F.col("n").alias("x"), F.col("e").alias("y"))
    return grid.lagged_sums(records, windows.sample_windows(spark) if w is None else w, MAX_LAG)


def _one(spark):
    """The single analysis window (window_idx 0)."""
    return spark.range(1).select(F.lit(0).alias("window_idx"), F.lit(I0).alias("i0"), F.lit(I1).alias("i1"))


_WINDOWS = "w AS (SELECT a * 4 + b AS window_idx, 24 - (4 + 2 * a) AS i0, 24 + 12 + 4 * b AS i1 FROM range(5) x(a), range(4) y(b))"
_ONE = f"w AS (SELECT 0 AS window_idx, {I0} AS i0, {I1} AS i1)"
_LAGGED = f"""l AS (SELECT h.rec, w.window_idx, td, h.n AS x, h.e AS y, d.n AS u, d.e AS w FROM v_hor h, range({MAX_LAG + 1}) t(td), w, v_hor d WHERE h.i >= i0 AND h.i < i1 AND d.rec = h.rec AND d.i = h.i + td),
m AS (SELECT rec, window_idx, td, count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, var_samp(u) AS uu, var_samp(w) AS ww, covar_samp(u, w) AS uw, covar_samp(x, u) AS xu, covar_samp(x, w) AS xw, covar_samp(y, u) AS yu, covar_samp(y, w) AS yw FROM l GROUP BY rec, window_idx, td)"""
_ANGLES = "ang AS (SELECT phi, cos(radians(phi)) AS c, sin(radians(phi)) AS s FROM range(-90, 91) t(phi))"
_GRID = f"""{_ANGLES}, g AS (SELECT rec, window_idx, n, td, phi, c * c * xx + 2 * c * s * xy + s * s * yy AS ff, s * s * uu - 2 * c * s * uw + c * c * ww AS ss, -c * s * xu + c * c * xw - s * s * yu + c * s * yw AS fs FROM m, ang),
o AS (SELECT *, greatest((ff + ss - sqrt((ff - ss) ** 2 + 4 * fs * fs)) / (ff + ss + sqrt((ff - ss) ** 2 + 4 * fs * fs)), 0.0) AS ev, abs(fs) / sqrt(ff * ss) AS rc FROM g)"""


def q_lagged_moments(spark, sf_dir):
    m = grid.moments(_sums(spark, sf_dir))
    return m.select("rec", F.col("window_idx").cast("long").alias("window_idx"), F.col("lag").cast("long").alias("lag"), "n", *[F.round(f"c_{p}", 8).alias(p) for p in ("xx", "xy", "uu", "uw", "xw", "yu")])


SQL["q_lagged_moments"] = f"WITH {TRACES}, {_WINDOWS}, {_LAGGED} SELECT rec, window_idx, td AS lag, n, " + ", ".join(f"round({p}, 8) AS {p}" for p in ("xx", "xy", "uu", "uw", "xw", "yu")) + " FROM m"


def q_ev_grid(spark, sf_dir):
    b = grid.best(grid.moments(_sums(spark, sf_dir)), "c_", grid.ev_objective())
    return b.select("rec", *[F.col(c).cast("long").alias(c) for c in ("window_idx", "phi", "lag")], F.round("c", 6).alias("c"))


SQL["q_ev_grid"] = f"""WITH {TRACES}, {_WINDOWS}, {_LAGGED}, {_GRID}, b AS (SELECT rec, window_idx, min(struct_pack(c := round(ev, 9), phi := phi, td := td)) AS b FROM o GROUP BY rec, window_idx)
 SELECT rec, window_idx, b.phi AS phi, b.td AS lag, round(b.c, 6) AS c FROM b"""


def q_rc_grid(spark, sf_dir):
    b = grid.best(grid.moments(_sums(spark, sf_dir)), "c_", grid.rc_objective(), largest=True)
    return b.select("rec", *[F.col(c).cast("long").alias(c) for c in ("window_idx", "phi", "lag")], F.round("c", 6).alias("c"))


SQL["q_rc_grid"] = f"""WITH {TRACES}, {_WINDOWS}, {_LAGGED}, {_GRID}, b AS (SELECT rec, window_idx, min(struct_pack(c := round(-rc, 9), phi := phi, td := td)) AS b FROM o GROUP BY rec, window_idx)
 SELECT rec, window_idx, b.phi AS phi, b.td AS lag, round(-b.c, 6) AS c FROM b"""


def q_grid_me(spark, sf_dir):
    """Least transverse energy after correction, from sums that are not centred."""
    c, s = F.col("c"), F.col("s")
    energy = s * s * F.col("ff") + 2 * s * c * F.col("fs") + c * c * F.col("ss")
    b = grid.least(_sums(spark, sf_dir, _one(spark)), "", energy)
    return b.select("rec", *[F.col(x).cast("long").alias(x) for x in ("phi", "lag")], F.round("c", 6).alias("energy"))


SQL["q_grid_me"] = f"""WITH {TRACES}, {_ONE}, {_LAGGED}, {_ANGLES}, e AS (SELECT rec, td, phi, sum((s * (c * x + s * y) + c * (c * w - s * u)) ** 2) AS energy FROM l, ang GROUP BY rec, td, phi), b AS (SELECT rec, min(struct_pack(e := round(energy, 9), phi := phi, td := td)) AS b FROM e GROUP BY rec)
 SELECT rec, b.phi AS phi, b.td AS lag, round(b.e, 6) AS energy FROM b"""


def q_conf_extent(spark, sf_dir):
    moments = grid.moments(_sums(spark, sf_dir, _one(spark)))
    cells = grid.rotated(moments, "c_", grid.angles(spark))
    least = cells.groupBy("rec", "window_idx").agg((F.min(grid.billionths(grid.ev_objective())) / grid.DECIMALS).alias("c"))
    level = least.select("rec", "window_idx", g.confidence_level(F.col("c"), F.lit(20.0)).alias("level"))
    e = grid.extents(grid.rotated(moments.join(level, ["rec", "window_idx"]), "c_", grid.angles(spark)), ev=(grid.ev_objective(), "level"))
    return e.select("rec", F.round("ev_phi_err", 6).alias("phi_err"), F.round("ev_lag_err", 6).alias("lag_err"))


SQL["q_conf_extent"] = f"""WITH {TRACES}, {_ONE}, {_LAGGED}, {_GRID}, lv AS (SELECT rec, min(round(ev, 9)) * 0.05::DOUBLE ** (-2.0 / 18) AS level FROM o GROUP BY rec)
 SELECT o.rec, round((max(phi) - min(phi)) / 4.0::DOUBLE, 6) AS phi_err, round((max(td) - min(td)) / 4.0::DOUBLE, 6) AS lag_err FROM o JOIN lv ON o.rec = lv.rec WHERE round(ev, 9) <= round(level, 9) GROUP BY o.rec"""


def q_rc_extent(spark, sf_dir):
    """The correlation's bound takes cells at or below it, and the number of cells less one as points."""
    moments = grid.moments(_sums(spark, sf_dir, _one(spark)))
    cells = grid.rotated(moments, "c_", grid.angles(spark))
    top = cells.groupBy("rec", "window_idx").agg((F.max(grid.billionths(grid.rc_objective())) / grid.DECIMALS).alias("c"))
    level = top.select("rec", "window_idx", g.fisher_lower(F.col("c"), F.lit(181 * (MAX_LAG + 1) - 1)).alias("level"))
    e = grid.extents(grid.rotated(moments.join(level, ["rec", "window_idx"]), "c_", grid.angles(spark)), rc=(grid.rc_objective(), "level"))
    return e.select("rec", F.round("rc_phi_err", 6).alias("phi_err"), F.round("rc_lag_err", 6).alias("lag_err"))


SQL["q_rc_extent"] = f"""WITH {TRACES}, {_ONE}, {_LAGGED}, {_GRID}, lv AS (SELECT rec, tanh(atanh(max(round(rc, 9))) - 1.6448536269514722 / sqrt({181 * (MAX_LAG + 1) - 1 - 3}.0)) AS level FROM o GROUP BY rec)
 SELECT o.rec, round((max(phi) - min(phi)) / 4.0::DOUBLE, 6) AS phi_err, round((max(td) - min(td)) / 4.0::DOUBLE, 6) AS lag_err FROM o JOIN lv ON o.rec = lv.rec WHERE round(rc, 9) <= round(level, 9) GROUP BY o.rec"""


def q_fisher_ci(spark, sf_dir):
    li = tables.table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(F.corr("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n")).select("l_suppkey", "n", F.round(g.fisher_lower(F.col("r"), F.col("n")), 6).alias("low"))


SQL["q_fisher_ci"] = "WITH c AS (SELECT l_suppkey, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, n, CASE WHEN abs(r) < 1 AND n > 3 THEN round(tanh(atanh(r) - 1.6448536269514722 / sqrt(n - 3)), 6) END AS low FROM c"


def q_c95(spark, sf_dir):
    m = tables.measures(spark, sf_dir).groupBy("grp", "cluster").agg(F.min("dt_err").alias("c"), F.count("*").alias("n"))
    return m.select("grp", "cluster", F.round(g.confidence_level(F.col("c"), F.col("n").cast("double")), 6).alias("c95"))


SQL["q_c95"] = f"WITH {MEASURES} SELECT grp, cluster, CASE WHEN count(*) > 2 THEN round(min(dt_err) * 0.05::DOUBLE ** (-2.0 / (count(*) - 2)), 6) END AS c95 FROM v_measure GROUP BY grp, cluster"

_POWER = "f AS (SELECT rec, comp, k, sum(v * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, sum(v * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM v_samples, range(64) t(k) GROUP BY rec, comp, k), pw AS (SELECT rec, comp, k, re * re + im * im AS p FROM f)"


def q_ndf(spark, sf_dir):
    return waveform.degrees_of_freedom(waveform.power_spectrum(tables.traces(spark, sf_dir), 64), 64)


SQL["q_ndf"] = f"""WITH {TRACES}, {_POWER}, m AS (SELECT rec, comp, sum(p) AS p2, sum(p * p) AS p4, arg_min(p, k) AS a, arg_max(p, k) AS b FROM pw GROUP BY rec, comp)
 SELECT rec, comp, least(round_even(2 * (p2 - (a - b) / 2) ** 2 / (p4 * 4 / 3 - (a * a - b * b) / 3) - 1, 0), 64)::BIGINT AS ndf FROM m"""


def q_dominant_period(spark, sf_dir):
    d = waveform.dominant_period(waveform.power_spectrum(tables.traces(spark, sf_dir), 64), 64, 100.0)
    return d.select("rec", "comp", F.round("period", 6).alias("period"))


SQL["q_dominant_period"] = f"""WITH {TRACES}, {_POWER}, b AS (SELECT rec, comp, min(struct_pack(p := round(-p, 9), k := k)) AS b FROM pw WHERE k BETWEEN 1 AND 32 GROUP BY rec, comp)
 SELECT rec, comp, round(64 / 100.0::DOUBLE / b.k, 6) AS period FROM b"""


def q_spol(spark, sf_dir):
    m = grid.moments(_sums(spark, sf_dir)).filter("lag = 0")
    return m.select("rec", F.col("window_idx").cast("long").alias("window_idx"), F.round(g.polarisation(F.col("c_xx"), F.col("c_yy"), F.col("c_xy")), 4).alias("spol"))


SQL["q_spol"] = f"WITH {TRACES}, {_WINDOWS}, {_LAGGED} SELECT rec, window_idx, round((degrees(0.5 * atan2(2 * xy, xx - yy)) + 180) % 180, 4) AS spol FROM m WHERE td = 0"


def q_corrected_cc(spark, sf_dir):
    """Correlation of the fast and slow components at the best axis and delay."""
    moments = grid.moments(_sums(spark, sf_dir))
    joined = grid.at_best(moments, "c_", grid.best(moments, "c_", grid.ev_objective()))
    return joined.select("rec", F.col("window_idx").cast("long").alias("window_idx"), F.round(F.coalesce(F.try_divide("fs", F.sqrt(F.col("ff") * F.col("ss"))), F.lit(0.0)), 5).alias("cc_fs"))


SQL["q_corrected_cc"] = f"""WITH {TRACES}, {_WINDOWS}, {_LAGGED}, {_GRID}, b AS (SELECT rec, window_idx, min(struct_pack(c := round(ev, 9), phi := phi, td := td)) AS b FROM o GROUP BY rec, window_idx)
 SELECT o.rec, o.window_idx, round(coalesce(fs / sqrt(ff * ss), 0), 5) AS cc_fs FROM o JOIN b ON o.rec = b.rec AND o.window_idx = b.window_idx AND o.phi = b.b.phi AND o.td = b.b.td"""


def q_bandpass(spark, sf_dir):
    """Zero-phase band-passed traces: their largest amplitude in each band."""
    made = waveform.filtered(tables.traces(spark, sf_dir), windows.usable(windows.bank(spark), 100.0), 100.0)
    return made.select("rec", "comp", F.col("bank_idx").cast("long").alias("bank_idx"), F.round(waveform.peak(F.col("data")), 6).alias("peak"))


def _biquads() -> str:
    """(bank_idx, g, a1, a2, c1, c2): the gain and both sections' recursions of each usable band."""
    rows = []
    for i, (low, high) in enumerate(windows.FILTER_BANK):
        if high < 45:
            (b, a), (_, c) = waveform.butterworth(low, high, 100.0)
            rows.append(f"({i}, {b[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {a[2]!r}::DOUBLE, {c[1]!r}::DOUBLE, {c[2]!r}::DOUBLE)".replace("np.float64(", "(").replace("))", ")"))
    return "q AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(bank_idx, g, a1, a2, c1, c2))"


SQL["q_bandpass"] = f"""WITH RECURSIVE {TRACES}, {_biquads()},
 fwd AS (SELECT rec, comp, bank_idx, 0 AS i, 0::DOUBLE AS x1, 0::DOUBLE AS x2, 0::DOUBLE AS u1, 0::DOUBLE AS u2, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM v_traces, q
  UNION ALL SELECT rec, comp, bank_idx, i + 1, x, x1, u, u1, (u - u2) - c1 * w1 - c2 * w2, w1 FROM (SELECT f.*, data[i + 1] AS x, c1, c2, g * (data[i + 1] - x2) - a1 * u1 - a2 * u2 AS u FROM fwd f JOIN v_traces USING (rec, comp) JOIN q USING (bank_idx) WHERE i < 64)),
 half AS (SELECT rec, comp, bank_idx, list(w1 ORDER BY i DESC) AS data FROM fwd WHERE i > 0 GROUP BY ALL),
 bwd AS (SELECT rec, comp, bank_idx, 0 AS i, 0::DOUBLE AS x1, 0::DOUBLE AS x2, 0::DOUBLE AS u1, 0::DOUBLE AS u2, 0::DOUBLE AS w1, 0::DOUBLE AS w2 FROM v_traces, q
  UNION ALL SELECT rec, comp, bank_idx, i + 1, x, x1, u, u1, (u - u2) - c1 * w1 - c2 * w2, w1 FROM (SELECT f.*, data[i + 1] AS x, c1, c2, g * (data[i + 1] - x2) - a1 * u1 - a2 * u2 AS u FROM bwd f JOIN half USING (rec, comp, bank_idx) JOIN q USING (bank_idx) WHERE i < 64))
 SELECT rec, comp, bank_idx::BIGINT AS bank_idx, round(max(abs(w1)), 6) AS peak FROM bwd WHERE i > 0 GROUP BY rec, comp, bank_idx"""


def q_pick_pipeline(spark, sf_dir):
    """The whole pipeline over the records as radial and transverse components; the dendrogram and the spectrum have no SQL form."""
    turn = F.pmod(F.col("rec") * 37, F.lit(360)).cast("double")
    records = tables.horizontals(spark, sf_dir).select("rec", F.col("n").alias("x"), F.col("e").alias("y"), turn.alias("back_azimuth"))
    out = pipeline.results(records, windows.sample_windows(spark), pipeline.Settings(max_lag=MAX_LAG, k_max=6, n_min=3))
    return out.select("rec", *[F.round(c, 6).alias(c) for c in ("ev_phi", "ev_dt_ms", "ev_phi_err", "rc_phi", "rc_dt_ms", "qfinal")], "quality_class", "n_clusters", "n_in_cluster", "error")


def q_picks(spark, sf_dir):
    """Tasks to result rows over all records: rays, bands, both methods in every window, clusters, consensus, quality. Dendrograms and spectra have no SQL form."""
    import numpy as np

    from fastaxis.config import build
    from fastaxis.plans import picks

    traces = tables.traces(spark, sf_dir)
    near = F.pmod(F.col("rec") * 7, F.lit(20)) / 100
    tasks = traces.select("rec").distinct().select(
        F.col("rec").cast("string").alias("pick_id"), F.timestamp_seconds(F.lit(1000.24)).alias("pick_time"), F.lit("XA").alias("network"), F.concat(F.lit("S"), (F.col("rec") % 9).cast("string")).alias("station"), F.lit(None).cast("string").alias("location"), F.lit("HHZ").alias("channel"),
        F.lit(38.0).alias("event_latitude"), F.lit(23.0).alias("event_longitude"), (8 + F.col("rec") % 20).cast("double").alias("event_depth_km"), (38.0 + near).alias("station_latitude"), F.lit(23.01).alias("station_longitude"), F.lit(None).cast("map<string,struct<azimuth:double,dip:double>>").alias("orientations"),
    )
    records = traces.select(F.col("rec").cast("string").alias("pick"), F.concat(F.lit("HH"), "comp").alias("channel"), F.lit(1000.0).alias("start"), F.lit(100.0).alias("rate"), "data")
    config = build({"sws": {"snr_min": 0.5, "max_delay_ms": 120, "blacklist_stations": ["S8"], "consensus": {"enabled": True, "n_best_filters": 2}, "windows": {"tbeg0": -0.12, "tbeg1": -0.04, "dtbeg": 0.02, "nbeg": 5, "tend0": 0.12, "tend1": 0.24, "dtend": 0.04, "nend": 4}, "cluster": {"k_max": 6, "n_min": 3}}})
    out = picks.results(tasks, lambda wanted: records.join(wanted.select("pick"), "pick"), np.array([(0.0, 2.7), (4.0, 2.7), (4.0, 2.9), (6371.0, 2.9)]), config)
    return out.select("pick_id", *[F.round(c, 4).alias(c) for c in ("backazimuth", "ev_phi", "ev_dt_ms", "ev_spol", "ev_cc_fs", "rc_phi", "rc_dt_ms", "snr", "qfinal", "delta", "omega")], "quality_class", "n_windows", "n_clusters", "n_in_cluster", "n_filters_used", "error")


Q |= {k: v for k, v in list(globals().items()) if k.startswith("q_")}
