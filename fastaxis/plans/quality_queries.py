"""Queries over window measurements: quality, consensus and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fastaxis.functions import geometry as g
from fastaxis.functions import surface
from fastaxis.operators import clustering, quality
from fastaxis.plans.views import MEASURES
from fastaxis.sources import tables

Q: dict = {}
SQL: dict[str, str] = {}
GAMMA = 0.75


def q_quality_index(spark, sf_dir):
    w = quality.window_quality(tables.measures(spark, sf_dir), GAMMA)
    return w.select("grp", "window_idx", F.round("qwin", 6).alias("qwin"), F.round("delta", 6).alias("delta"), F.round("omega", 6).alias("omega"), g.quality_class(F.round("qwin", 9), GAMMA).alias("class"))


_QUALITY = f"""{MEASURES}, d AS (SELECT *, CASE WHEN dt = 0 THEN 0 ELSE rc_dt / dt END AS delta, abs(CASE WHEN abs(rc_phi - phi) > 45 THEN 90 - abs(rc_phi - phi) ELSE abs(rc_phi - phi) END) / 45 AS omega FROM v_measure),
 e AS (SELECT *, least(sqrt((delta - 1) ** 2 + omega ** 2), 1.0) AS good, least(sqrt(delta ** 2 + (omega - 1) ** 2), 1.0) AS nul FROM d), x AS (SELECT *, CASE WHEN nul < good THEN nul - 1 ELSE 1 - good END AS qwin FROM e)"""
SQL["q_quality_index"] = f"WITH {_QUALITY} SELECT grp, window_idx, round(qwin, 6) AS qwin, round(delta, 6) AS delta, round(omega, 6) AS omega, CASE WHEN round(qwin, 9) >= 0.75 THEN 'Good Split' WHEN round(qwin, 9) <= -0.75 THEN 'Good Null' ELSE 'Poor/Noise' END AS class FROM x"


def q_sql_quality(spark, sf_dir):
    """The quality index from SQL text."""
    surface.register(spark)
    text = "SELECT grp, window_idx, quality_index(rc_phi, rc_dt, phi, dt) AS q, delay_ratio(rc_dt, dt) AS d, axis_difference(rc_phi, phi) AS o FROM {m}"
    return spark.sql(f"SELECT grp, window_idx, round(q, 6) AS qwin, round(d, 6) AS delta, round(o, 6) AS omega, quality_class(round(q, 9), {GAMMA}) AS class FROM ({text})", m=tables.measures(spark, sf_dir))


SQL["q_sql_quality"] = SQL["q_quality_index"]


def q_event_quality(spark, sf_dir):
    m = tables.measures(spark, sf_dir)
    w = quality.window_quality(m.filter("cluster = 1"), GAMMA)
    e = quality.event_quality(w, GAMMA)
    return e.select("grp", *[F.round(c, 6).alias(c) for c in ("qmean", "qbest", "qfinal", "delta", "omega")], "quality_class", "n_windows")


SQL["q_event_quality"] = f"""WITH {_QUALITY}, b AS (SELECT grp, avg(qwin) AS qmean, min(struct_pack(a := round(-abs(qwin), 9), i := window_idx, q := qwin, d := delta, o := omega)) AS b, count(*) AS n_windows FROM x WHERE cluster = 1 GROUP BY grp), f AS (SELECT *, qmean / 3 + b.q * 2 / 3 AS qfinal FROM b)
 SELECT grp, round(qmean, 6) AS qmean, round(b.q, 6) AS qbest, round(qfinal, 6) AS qfinal, round(b.d, 6) AS delta, round(b.o, 6) AS omega, CASE WHEN round(qfinal, 9) >= 0.75 THEN 'Good Split' WHEN round(qfinal, 9) <= -0.75 THEN 'Good Null' ELSE 'Poor/Noise' END AS quality_class, n_windows FROM f"""


def q_consensus(spark, sf_dir):
    c = quality.consensus(tables.measures(spark, sf_dir))
    return c.select("grp", *[F.round(x, 6).alias(x) for x in ("phi", "dt", "phi_err", "dt_err")], "n_used")


SQL["q_consensus"] = f"""WITH {MEASURES}, a AS (SELECT grp, arg_min(phi, window_idx) AS p0, arg_min(dt, window_idx) AS d0 FROM v_measure GROUP BY grp), n AS (SELECT m.* FROM v_measure m JOIN a ON m.grp = a.grp WHERE round(CASE WHEN abs(phi - p0) > 90 THEN 180 - abs(phi - p0) ELSE abs(phi - p0) END, 9) <= 15 AND round(abs(dt - d0), 9) <= 0.02)
 SELECT grp, round(avg(phi), 6) AS phi, round(avg(dt), 6) AS dt, round(sqrt(avg(phi_err * phi_err)), 6) AS phi_err, round(sqrt(avg(dt_err * dt_err)), 6) AS dt_err, count(*) AS n_used FROM n GROUP BY grp"""


def _scaled(spark, sf_dir):
    return clustering.scaled(tables.measures(spark, sf_dir), {"dt": "x", "phi": "y"})


_SCALED = f"{MEASURES}, z AS (SELECT *, CASE WHEN max(dt) OVER g > min(dt) OVER g THEN dt / (max(dt) OVER g - min(dt) OVER g) ELSE 1 END AS x, CASE WHEN max(phi) OVER g > min(phi) OVER g THEN phi / (max(phi) OVER g - min(phi) OVER g) ELSE 1 END AS y FROM v_measure WINDOW g AS (PARTITION BY grp))"


def q_z4(spark, sf_dir):
    return _scaled(spark, sf_dir).select("grp", "window_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


SQL["q_z4"] = f"WITH {_SCALED} SELECT grp, window_idx, round(x, 6) AS x, round(y, 6) AS y FROM z"


def _variances(spark, sf_dir):
    return clustering.cluster_variances(tables.measures(spark, sf_dir), ["grp", "cluster"], "dt", "phi", "dt_err", "phi_err")


_VARIANCES = f"""{MEASURES}, v AS (SELECT grp, cluster, count(*) AS n, var_pop(dt) + var_pop(phi) AS inside, sum(CASE WHEN dt_err > 0 THEN 1 / (dt_err * dt_err) ELSE 0 END) AS wx, sum(CASE WHEN phi_err > 0 THEN 1 / (phi_err * phi_err) ELSE 0 END) AS wy FROM v_measure GROUP BY grp, cluster),
 vv AS (SELECT *, CASE WHEN wx > 0 THEN 1 / wx ELSE 'infinity'::DOUBLE END + CASE WHEN wy > 0 THEN 1 / wy ELSE 'infinity'::DOUBLE END AS data FROM v)"""


def q_cluster_variance(spark, sf_dir):
    v = _variances(spark, sf_dir)
    finite = lambda c: F.when(F.col(c) < float("inf"), F.round(c, 6))
    return v.select("grp", "cluster", "n", F.round("inside", 6).alias("inside"), finite("data").alias("data"), finite("overall").alias("overall"))


SQL["q_cluster_variance"] = f"WITH {_VARIANCES} SELECT grp, cluster, n, round(inside, 6) AS inside, CASE WHEN data < 'infinity'::DOUBLE THEN round(data, 6) END AS data, CASE WHEN data < 'infinity'::DOUBLE THEN round(greatest(inside, data), 6) END AS overall FROM vv"


def q_best_cluster(spark, sf_dir):
    m = tables.measures(spark, sf_dir)
    chosen = clustering.chosen_cluster(_variances(spark, sf_dir), n_min=10)
    inside = m.join(chosen, ["grp", "cluster"], "left_semi")
    best = clustering.best_measurement(clustering.scaled(inside, {"dt_err": "ex", "phi_err": "ey"}), F.col("ex") + F.col("ey"))
    return chosen.join(best, "grp").select("grp", "cluster", "window_idx")


SQL["q_best_cluster"] = f"""WITH {_VARIANCES}, c AS (SELECT *, max(n >= 10) OVER (PARTITION BY grp) AS any_big FROM vv), k AS (SELECT grp, min(struct_pack(v := round(greatest(inside, data), 9), c := cluster)).c AS cluster FROM c WHERE n >= 10 OR NOT any_big GROUP BY grp),
 i AS (SELECT m.*, max(dt_err) OVER g - min(dt_err) OVER g AS rx, max(phi_err) OVER g - min(phi_err) OVER g AS ry FROM v_measure m JOIN k ON m.grp = k.grp AND m.cluster = k.cluster WINDOW g AS (PARTITION BY m.grp)),
 b AS (SELECT grp, min(struct_pack(e := round(CASE WHEN rx > 0 THEN dt_err / rx ELSE 1 END + CASE WHEN ry > 0 THEN phi_err / ry ELSE 1 END, 9), w := window_idx)).w AS window_idx FROM i GROUP BY grp) SELECT k.grp, k.cluster, b.window_idx FROM k JOIN b ON k.grp = b.grp"""


def _moments(spark, sf_dir):
    return clustering.cluster_moments(_scaled(spark, sf_dir), ["grp", "cluster"], "x", "y")


_MOMENTS = f"{_SCALED}, mo AS (SELECT grp, cluster, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS q FROM z GROUP BY grp, cluster)"


def q_duda_hart(spark, sf_dir):
    d = clustering.duda_hart(_moments(spark, sf_dir))
    return d.select("grp", "cluster", "cluster2", F.round("score", 5).alias("score"))


SQL["q_duda_hart"] = f"""WITH {_MOMENTS}, p AS (SELECT a.grp, a.cluster AS cluster, b.cluster AS cluster2, a.q - (a.sx ** 2 + a.sy ** 2) / a.n + b.q - (b.sx ** 2 + b.sy ** 2) / b.n AS s22, a.q + b.q - ((a.sx + b.sx) ** 2 + (a.sy + b.sy) ** 2) / (a.n + b.n) AS s21 FROM mo a JOIN mo b ON a.grp = b.grp AND a.cluster < b.cluster),
 t AS (SELECT grp, sum(n) AS n FROM mo GROUP BY grp) SELECT p.grp, cluster, cluster2, CASE WHEN s21 > 0 THEN round((1 - s22 / s21 - 1 / pi()) * sqrt(n / (1 - 4 / pi() ** 2)), 5) END AS score FROM p JOIN t ON p.grp = t.grp"""


def q_duda_hart_cut(spark, sf_dir):
    """Whether some pair of clusters scores at or below the critical value."""
    d = clustering.duda_hart(_moments(spark, sf_dir))
    return d.groupBy("grp").agg(F.max(F.round("score", 6) <= 3.2).alias("met"), F.count("*").alias("n_pairs"))


SQL["q_duda_hart_cut"] = SQL["q_duda_hart"].replace("WITH ", "WITH ", 1).replace("SELECT p.grp, cluster, cluster2, CASE WHEN s21 > 0 THEN round((1 - s22 / s21 - 1 / pi()) * sqrt(n / (1 - 4 / pi() ** 2)), 5) END AS score FROM p JOIN t ON p.grp = t.grp", "SELECT p.grp, max(round((1 - s22 / s21 - 1 / pi()) * sqrt(n / (1 - 4 / pi() ** 2)), 6) <= 3.2) AS met, count(*) AS n_pairs FROM p JOIN t ON p.grp = t.grp GROUP BY p.grp")


def q_calinski(spark, sf_dir):
    return clustering.calinski_harabasz(_moments(spark, sf_dir)).select("grp", F.round("score", 5).alias("score"))


SQL["q_calinski"] = f"""WITH {_MOMENTS}, t AS (SELECT grp, count(*) AS k, sum(n) AS n, sum(q - (sx ** 2 + sy ** 2) / n) AS inside, sum(q) - (sum(sx) ** 2 + sum(sy) ** 2) / sum(n) AS al FROM mo GROUP BY grp)
 SELECT grp, CASE WHEN k > 1 AND inside > 1e-12 AND n > k THEN round((al - inside) / (k - 1) / (inside / (n - k)), 5) END AS score FROM t"""


def q_agglomerative(spark, sf_dir):
    """Cuts of a Ward dendrogram for each run of 60 windows of a group of measurements, as a pick's windows are; no SQL form."""
    m = tables.measures(spark, sf_dir).withColumn("grp", F.col("grp") * 100 + F.floor(F.col("window_idx") / 60))
    labels = clustering.cuts(clustering.scaled(m, {"dt": "x", "phi": "y"}), "x", "y", k_max=6)
    return labels.groupBy("grp", "k", "cluster").agg(F.count("*").alias("n"), F.min("window_idx").alias("first"))


Q |= {k: v for k, v in list(globals().items()) if k.startswith("q_")}
