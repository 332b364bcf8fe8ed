"""Queries over the store of results, the bus and the inventory, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fastaxis.functions import geometry as g
from fastaxis.operators import enrich, publish, query, store
from fastaxis.plans.views import EPOCHS, RESULTS
from fastaxis.sources import tables
from fastaxis.streaming.debounce import debounced_batch

Q: dict = {}
SQL: dict[str, str] = {}


def q_results_filter(spark, sf_dir):
    r = tables.results(spark, sf_dir).withColumn("quality_class", g.quality_class(F.col("qfinal"), 0.75))
    found = query.query_results(r, limit=100_000, quality_class="Good Split", min_magnitude=1.0, max_event_latitude=32.0, min_station_latitude=35.5, start_time="1996-01-01", end_time="2000-12-31")
    return found.select("event_id", "origin_time", "network", "station", "magnitude", "qfinal")


SQL["q_results_filter"] = f"WITH {RESULTS} SELECT event_id, origin_time, network, station, magnitude, qfinal FROM v_results WHERE status = 'ok' AND qfinal >= 0.75 AND magnitude >= 1 AND event_latitude <= 32 AND station_latitude >= 35.5 AND origin_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31' ORDER BY origin_time DESC NULLS FIRST, event_id LIMIT 100000"


def q_results_topk(spark, sf_dir):
    return query.query_results(tables.results(spark, sf_dir), limit=500, status="all").select("event_id", "origin_time", "network", "station", "status")


SQL["q_results_topk"] = f"WITH {RESULTS} SELECT event_id, origin_time, network, station, status FROM v_results ORDER BY origin_time DESC NULLS FIRST, event_id, network, station LIMIT 500"


def q_results_csv(spark, sf_dir):
    r = tables.results(spark, sf_dir)
    rows = query.csv_rows(r.withColumn("quality_class", g.quality_class(F.col("qfinal"), 0.75)))
    keep = ["event_id", "event_origin_time_utc", "event_magnitude", "station_code", "path_travel_time_P_s", "ev_l_r", "linearity_test", "filter", "filter_snr", "qc_class", "status"]
    return rows.select(*keep, F.round("filter_bandwidth_oct", 6).alias("filter_bandwidth_oct"), F.round("filter_score", 6).alias("filter_score"))


SQL["q_results_csv"] = f"""WITH {RESULTS} SELECT event_id, strftime(origin_time, '%Y-%m-%dT%H:%M:%S+00:00') AS event_origin_time_utc, magnitude AS event_magnitude, station AS station_code,
  NULL::DOUBLE AS path_travel_time_P_s, ev_linearity AS ev_l_r, CASE WHEN ev_linearity <= 0.15 THEN 'linear' WHEN ev_linearity IS NOT NULL THEN 'non-linear' END AS linearity_test,
  CASE WHEN filter_low IS NOT NULL AND filter_high IS NOT NULL THEN printf('%.1f-%.1f Hz', round(filter_low + 1e-9, 1), round(filter_high + 1e-9, 1)) END AS filter, snr AS filter_snr,
  CASE WHEN qfinal >= 0.75 THEN 'Good Split' WHEN qfinal <= -0.75 THEN 'Good Null' WHEN qfinal IS NOT NULL THEN 'Poor/Noise' END AS qc_class, status,
  round(log2(filter_high / filter_low), 6) AS filter_bandwidth_oct, round(snr * log2(filter_high / filter_low), 6) AS filter_score FROM v_results"""


def q_runs_counters(spark, sf_dir):
    return store.run_counters(tables.results(spark, sf_dir))


SQL["q_runs_counters"] = f"WITH {RESULTS} SELECT run, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_failed FROM v_results GROUP BY run"


def q_runs_topk(spark, sf_dir):
    runs = store.run_counters(tables.results(spark, sf_dir).withColumn("run_id", F.year("origin_time").cast("long") * 100 + F.month("origin_time")), "run_id")
    return query.query_runs(runs, 25)


SQL["q_runs_topk"] = f"WITH {RESULTS} SELECT (year(origin_time) * 100 + month(origin_time))::BIGINT AS run_id, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status <> 'ok') AS n_failed FROM v_results GROUP BY 1 ORDER BY 1 DESC LIMIT 25"


def q_upsert_latest(spark, sf_dir):
    """One row per event day and station: later writes replace earlier ones."""
    r = tables.results(spark, sf_dir).withColumn("event", F.to_date("origin_time").cast("string"))
    return enrich.latest(r, ["event", "network", "station"], F.desc("event_id")).select("event", "network", "station", "event_id", "qfinal", "status")


SQL["q_upsert_latest"] = f"WITH {RESULTS} SELECT strftime(origin_time, '%Y-%m-%d') AS event, network, station, event_id, qfinal, status FROM v_results QUALIFY row_number() OVER (PARTITION BY strftime(origin_time, '%Y-%m-%d'), network, station ORDER BY event_id DESC) = 1"


def q_health(spark, sf_dir):
    return spark.sql("SELECT 1 AS healthy")


SQL["q_health"] = "SELECT 1::INTEGER AS healthy"


def q_s_phase_filter(spark, sf_dir):
    """Picks with their last arrival's phase; the hint stands in for a missing one."""
    picks = tables.bus(spark, sf_dir).select("event_id", "key", F.col("phase").alias("hint"))
    arrivals = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") == "P", F.lit("")).when(F.col("o_orderstatus") == "O", F.lit("sg")).otherwise(F.lit("Pn")).alias("arrival_phase"))
    joined = picks.join(enrich.last_arrivals(arrivals, "key", "idx", "arrival_phase"), "key", "left")
    return joined.filter(enrich.is_s_phase(F.col("arrival_phase"), F.col("hint"))).select("event_id", enrich.phase_of(F.col("arrival_phase"), F.col("hint")).alias("phase"))


SQL["q_s_phase_filter"] = """WITH a AS (SELECT o_custkey AS key, arg_max(CASE o_orderstatus WHEN 'P' THEN '' WHEN 'O' THEN 'sg' ELSE 'Pn' END, o_orderkey) AS phase FROM orders GROUP BY o_custkey),
 j AS (SELECT event_id, coalesce(nullif(a.phase, ''), event_type, '') AS phase FROM events LEFT JOIN a ON user_id = key) SELECT event_id, phase FROM j WHERE upper(phase) LIKE 'S%'"""


def q_anti_processed(spark, sf_dir):
    """Orders of which no returned line stands for a published result; all orders, all lines."""
    picks = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pick"), F.col("o_custkey").alias("station"))
    done = tables.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("pick"))
    return enrich.unprocessed(picks, done, "pick")


SQL["q_anti_processed"] = "SELECT o_orderkey AS pick, o_custkey AS station FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"


def q_inventory_interval(spark, sf_dir):
    picks = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pick"), (F.col("o_custkey")).alias("key"), F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 200 as int))").alias("at"))
    return enrich.as_of(picks, tables.epochs(spark, sf_dir), "key", "at").select("pick", "at", "epoch", "start", "end")


SQL["q_inventory_interval"] = f"""WITH {EPOCHS}, p AS (SELECT o_orderkey AS pick, o_custkey AS key, o_orderdate + to_days((o_orderkey % 200)::INTEGER) AS at FROM orders)
 SELECT pick, p.at AS at, arg_max(epoch, start) AS epoch, max(start) AS start, arg_max(struct_pack(e := "end"), start).e AS "end" FROM p LEFT JOIN v_epochs e ON p.key = e.key AND start <= p.at AND ("end" IS NULL OR "end" >= p.at) GROUP BY pick, p.at"""


def q_channel_map(spark, sf_dir):
    """Orientation maps: channels are parts of a supplier's nation by the first letters of their code."""
    s = tables.table(spark, sf_dir, "supplier")
    picks = s.select(F.col("s_suppkey").alias("pick"), F.col("s_nationkey").cast("string").alias("station"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 3 + 1).cast("string")).alias("prefix"), F.lit("1998-01-01").cast("timestamp").alias("at"))
    p = tables.table(spark, sf_dir, "part")
    channels = p.select((F.col("p_partkey") % 25).cast("string").alias("station"), F.col("p_brand").alias("code"), F.when(F.col("p_size") > 2, F.expr("timestamp'1996-01-01' + make_dt_interval(cast(p_partkey as int))")).alias("start"), F.when(F.col("p_size") % 2 == 0, F.expr("timestamp'1997-06-01' + make_dt_interval(cast(p_size * 10 as int))")).alias("end"), F.col("p_retailprice").alias("azimuth"), F.when(F.col("p_size") != 7, F.col("p_size").cast("double")).alias("dip"))
    maps = enrich.orientations(picks, channels)
    flat = F.transform(F.map_entries("orientations"), lambda e: F.concat_ws(":", e["key"], e["value"]["azimuth"].cast("decimal(18,2)").cast("string"), e["value"]["dip"].cast("int").cast("string")))
    return maps.select("pick", F.array_join(flat, ";").alias("orientations"))


SQL["q_channel_map"] = """WITH picks AS (SELECT s_suppkey AS pick, s_nationkey::VARCHAR AS station, 'Brand#' || (s_suppkey % 3 + 1) AS prefix FROM supplier),
 ch AS (SELECT (p_partkey % 25)::VARCHAR AS station, p_brand AS code, CASE WHEN p_size > 2 THEN TIMESTAMP '1996-01-01' + to_days(p_partkey::INTEGER) END AS start, CASE WHEN p_size % 2 = 0 THEN TIMESTAMP '1997-06-01' + to_days((p_size * 10)::INTEGER) END AS "end", p_retailprice AS az, CASE WHEN p_size <> 7 THEN p_size END AS dip FROM part),
 one AS (SELECT pick, code, arg_max(az, start) AS az, arg_max(dip, start) AS dip FROM picks p JOIN ch ON p.station = ch.station AND starts_with(code, prefix) AND start <= TIMESTAMP '1998-01-01' AND ("end" IS NULL OR "end" >= TIMESTAMP '1998-01-01') AND dip IS NOT NULL AND az IS NOT NULL GROUP BY pick, code)
 SELECT p.pick, string_agg(code || ':' || az::DECIMAL(18,2) || ':' || dip, ';' ORDER BY code) AS orientations FROM picks p LEFT JOIN one ON p.pick = one.pick GROUP BY p.pick"""


def q_seed_split(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", enrich.seed_id(F.substring("c_mktsegment", 1, 2), F.concat(F.lit("S"), F.col("c_custkey").cast("string")), F.when(F.col("c_custkey") % 3 > 0, F.lpad(F.col("c_nationkey").cast("string"), 2, "0")), F.concat(F.lit("HH"), F.substring("c_name", -1, 1))).alias("seed_id"))
    return c.withColumn("p", enrich.seed_parts(F.col("seed_id"))).select("c_custkey", "seed_id", "p.network", "p.station", "p.location", "p.channel")


SQL["q_seed_split"] = """WITH s AS (SELECT c_custkey, left(c_mktsegment, 2) || '.' || 'S' || c_custkey || '.' || CASE WHEN c_custkey % 3 > 0 THEN lpad(c_nationkey::VARCHAR, 2, '0') ELSE '' END || '.' || 'HH' || right(c_name, 1) AS seed_id FROM customer)
 SELECT c_custkey, seed_id, split_part(seed_id, '.', 1) AS network, split_part(seed_id, '.', 2) AS station, split_part(seed_id, '.', 3) AS location, split_part(seed_id, '.', 4) AS channel FROM s"""


def q_comment_json(spark, sf_dir):
    """Published comments, read back from their JSON."""
    r = tables.results(spark, sf_dir).select(F.col("event_id").cast("string").alias("pick_id"), "qfinal", (F.col("snr") + 0.0007).alias("ev_phi"), F.when(F.col("status") != "ok", F.lit("failed")).alias("error"), g.quality_class(F.col("qfinal"), 0.75).alias("quality_class"))
    c = publish.comments(r, "1", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    value = lambda path: F.get_json_object("text", path)
    return c.select("pick_id", "comment_id", value("$.splitting.qfinal").cast("double").alias("qfinal"), value("$.splitting.ev_phi_deg").cast("double").alias("ev_phi_deg"), value("$.splitting.class").alias("class"), value("$.provenance.stored_at").alias("stored_at"))


SQL["q_comment_json"] = f"""WITH {RESULTS} SELECT event_id::VARCHAR AS pick_id, event_id || '#fastaxis/20260102T030405.000000Z' AS comment_id, round(qfinal, 4) AS qfinal, round(snr + 0.0007::DOUBLE, 2) AS ev_phi_deg,
  CASE WHEN qfinal >= 0.75 THEN 'Good Split' WHEN qfinal <= -0.75 THEN 'Good Null' ELSE 'Poor/Noise' END AS class, '2026-01-02T03:04:05.000000' AS stored_at FROM v_results WHERE status = 'ok' AND qfinal IS NOT NULL"""


def q_results_json(spark, sf_dir):
    r = tables.results(spark, sf_dir).select("event_id", "origin_time", "network", "qfinal", "status")
    j = query.rendered(r, "json")
    value = lambda path: F.get_json_object("json", path)
    return j.select(value("$.event_id").cast("long").alias("event_id"), value("$.origin_time").alias("origin_time"), value("$.qfinal").cast("double").alias("qfinal"), F.contains("json", F.lit('"qfinal":null')).alias("null_kept"))


SQL["q_results_json"] = f"WITH {RESULTS} SELECT event_id, strftime(origin_time, '%Y-%m-%dT%H:%M:%S+00:00') AS origin_time, qfinal, qfinal IS NULL AS null_kept FROM v_results"


def q_debounce(spark, sf_dir):
    b = tables.bus(spark, sf_dir)
    return debounced_batch(b, 86_400.0).select("key", "first_seen", "payload", "n_updates", "late")


SQL["q_debounce"] = """WITH f AS (SELECT user_id AS key, min(ts) AS first_seen FROM events GROUP BY user_id), m AS (SELECT f.*, e.*, e.ts < f.first_seen + INTERVAL 1 DAY AS inside FROM events e JOIN f ON f.key = e.user_id)
 SELECT key, first_seen, arg_max(value, struct_pack(ts := ts, e := event_id)) FILTER (inside) AS payload, count(*) FILTER (inside) AS n_updates, count(*) FILTER (NOT inside) AS late FROM m GROUP BY key, first_seen"""


def q_reject_reason(spark, sf_dir):
    r = tables.results(spark, sf_dir).select("event_id", "station", "station_latitude", "snr", "magnitude", "event_depth_km", "epi_distance_km")
    reason = enrich.first_reason(station_is_blacklisted=F.col("station") == "S3", no_signal=F.col("snr").isNull(), shear_wave_window=F.degrees(F.atan2(F.col("epi_distance_km"), F.col("event_depth_km"))) > 60, snr_too_low=F.col("snr") < 3)
    out = enrich.rejected(r, reason, "event_id")
    return out.select("event_id", "station", "magnitude", "snr", "error")


SQL["q_reject_reason"] = f"""WITH {RESULTS}, e AS (SELECT *, CASE WHEN station = 'S3' THEN 'station is blacklisted' WHEN snr IS NULL THEN 'no signal' WHEN degrees(atan2(epi_distance_km, event_depth_km)) > 60 THEN 'shear wave window' WHEN snr < 3 THEN 'snr too low' END AS error FROM v_results)
 SELECT event_id, CASE WHEN error IS NULL THEN station END AS station, CASE WHEN error IS NULL THEN magnitude END AS magnitude, CASE WHEN error IS NULL THEN snr END AS snr, error FROM e"""


def q_hypo_distance(spark, sf_dir):
    r = tables.results(spark, sf_dir)
    return r.select("event_id", F.round(g.hypocentral(F.col("epi_distance_km"), F.col("event_depth_km")), 6).alias("hypo_distance_km"))


SQL["q_hypo_distance"] = f"WITH {RESULTS} SELECT event_id, round(sqrt(epi_distance_km * epi_distance_km + event_depth_km * event_depth_km), 6) AS hypo_distance_km FROM v_results"


def q_geodesic(spark, sf_dir):
    r = tables.results(spark, sf_dir)
    at = [F.col(c) for c in ("event_latitude", "event_longitude", "station_latitude", "station_longitude")]
    return r.select("event_id", F.round(g.haversine_km(*at), 5).alias("distance_km"), F.round(g.azimuth(*at[2:], *at[:2]), 5).alias("backazimuth"))


SQL["q_geodesic"] = f"""WITH {RESULTS}, p AS (SELECT event_id, radians(event_latitude) AS a, radians(event_longitude) AS b, radians(station_latitude) AS c, radians(station_longitude) AS d FROM v_results)
 SELECT event_id, round(2 * 6371.0 * asin(sqrt(least(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2, 1.0))), 5) AS distance_km,
  round((degrees(atan2(sin(b - d) * cos(a), cos(c) * sin(a) - sin(c) * cos(a) * cos(b - d))) + 360) % 360, 5) AS backazimuth FROM p"""

#: A crust of constant layers (depth in km, S velocity in km/s).
CRUST = [(0.0, 2.7), (4.0, 2.7), (4.0, 2.9), (8.0, 2.9), (8.0, 3.3), (30.0, 3.6), (30.0, 3.9), (6371.0, 3.9)]


def q_ray_screen(spark, sf_dir):
    """Travel times, angles and ellipsoidal distances of every result; rays and geodesics are iterations without an SQL form."""
    import numpy as np

    from fastaxis.operators import raypath

    r = tables.results(spark, sf_dir).select("event_id", "event_latitude", "event_longitude", "event_depth_km", (F.col("event_latitude") + F.col("epi_distance_km") / 1000).alias("station_latitude")).withColumn("station_longitude", F.col("event_longitude") + 0.01)
    out = raypath.screened(r, np.array(CRUST))
    return out.select("event_id", *[F.round(c, 4).alias(c) for c in ("s_travel_time_s", "takeoff_angle", "incidence_angle", "epi_distance_km", "backazimuth")], "error")


def q_ray_uniform(spark, sf_dir):
    """Rays of every result in a sphere of one velocity, where they are chords."""
    import numpy as np

    from fastaxis.operators import raypath

    r = tables.results(spark, sf_dir).select("event_id", "event_latitude", "event_longitude", "event_depth_km", (F.col("event_latitude") + F.col("epi_distance_km") / 1000).alias("station_latitude")).withColumn("station_longitude", F.col("event_longitude") + 0.01)
    out = raypath.screened(r, np.array([(0.0, 3.4), (6371.0, 3.4)]))
    return out.select("event_id", F.round("s_travel_time_s", 4).alias("s_travel_time_s"), F.round("takeoff_angle", 3).alias("takeoff_angle"), F.round("incidence_angle", 3).alias("incidence_angle"), F.col("error").isNull().alias("inside"))


SQL["q_ray_uniform"] = f"""WITH {RESULTS}, p AS (SELECT event_id, radians(event_latitude) AS a, radians(event_latitude + epi_distance_km / 1000) AS b, radians(0.01) AS l, 6371 - event_depth_km AS r FROM v_results),
 h AS (SELECT event_id, r, 2 * asin(sqrt(sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(l / 2) ** 2)) AS t FROM p),
 c AS (SELECT *, sqrt((6371 - r) ** 2 + 4 * 6371 * r * sin(t / 2) ** 2) AS s FROM h),
 x AS (SELECT event_id, s / 3.4 AS sec, degrees(atan2(6371 * sin(t), r - 6371 * cos(t))) AS k, degrees(atan2(r * sin(t), 6371 - r * cos(t))) AS i FROM c)
 SELECT event_id, round(sec, 4) AS s_travel_time_s, round(k, 3) AS takeoff_angle, round(i, 3) AS incidence_angle, i <= 60 AND k >= 90 AS inside FROM x"""


Q |= {k: v for k, v in list(globals().items()) if k.startswith("q_")}
