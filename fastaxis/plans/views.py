"""The domain views of fastaxis.sources.tables in DuckDB SQL, as common table expressions."""

TRACES = """
v_all AS (SELECT vec_id // 3 AS rec, CASE vec_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN 'N' ELSE 'E' END AS comp, embedding::DOUBLE[] AS data FROM embeddings),
v_traces AS (SELECT * FROM v_all WHERE rec IN (SELECT rec FROM v_all GROUP BY rec HAVING count(*) = 3)),
v_samples AS (SELECT rec, comp, unnest(range(len(data))) AS i, unnest(data) AS v FROM v_traces),
v_hor AS (SELECT n.rec, n.i, n.v AS n, e.v AS e FROM v_samples n JOIN v_samples e ON n.rec = e.rec AND n.i = e.i AND n.comp = 'N' AND e.comp = 'E')
"""

RESULTS = """
v_lines AS (SELECT l_orderkey, sum(round(l_discount * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) AS d, sum(round(l_tax * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) AS t, sum(round(l_quantity * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) AS q FROM lineitem GROUP BY l_orderkey),
v_results AS (
  SELECT o_orderkey AS event_id, o_orderdate AS origin_time, n_name AS network, 'S' || (c_custkey % 7) AS station,
    24 + (o_custkey % 1000) / 100.0::DOUBLE AS event_latitude, 20 + (o_orderkey % 800) / 100.0::DOUBLE AS event_longitude, round(q, 6) AS event_depth_km,
    round(o_totalprice / 100000, 7) AS magnitude, 35 + c_nationkey / 10.0::DOUBLE AS station_latitude, 22 + (c_custkey % 50) / 10.0::DOUBLE AS station_longitude,
    round(5 + (o_orderkey % 997) / 10.0::DOUBLE, 3) AS epi_distance_km,
    CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN o_orderstatus <> 'F' THEN round((d - 0.05::DOUBLE) * 20 - 2 * t, 6) END AS qfinal,
    CASE WHEN o_orderpriority <> '5-LOW' THEN round(0.5::DOUBLE + t * 10, 6) END AS filter_low,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN round(4 + d * 40, 6) END AS filter_high,
    CASE WHEN o_custkey % 11 > 0 THEN round(q / 5, 6) END AS snr, CASE WHEN o_custkey % 5 > 0 THEN round(t * 4, 6) END AS ev_linearity, o_orderpriority AS run
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN v_lines ON o_orderkey = l_orderkey)
"""

MEASURES = """
v_measure AS (
  SELECT l_suppkey AS grp, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS window_idx,
    (l_partkey % 180)::DOUBLE AS phi, abs(l_discount) AS dt, l_tax * 100 AS phi_err, l_quantity / 1000 AS dt_err,
    ((l_partkey + l_linenumber * 7) % 180)::DOUBLE AS rc_phi, abs(l_discount) * l_linenumber / 4 AS rc_dt, l_linenumber::BIGINT AS cluster
  FROM lineitem)
"""

EPOCHS = """
v_starts AS (SELECT o_custkey AS key, o_orderdate AS start, max(o_orderkey) AS epoch, max(o_totalprice) AS azimuth FROM orders GROUP BY ALL),
v_epochs AS (SELECT *, lead(start) OVER (PARTITION BY key ORDER BY start) AS "end" FROM v_starts)
"""
