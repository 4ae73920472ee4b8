"""Queries of fitted models, whole jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, autoregression, evaluate, models, smoothing, trees
from ..streaming import revisions
from . import evaluation, pipelines, registry, views
from .catalog import places, places_sql, query, wide, wide_sql
from .queries_asof import REL
from .queries_evaluate import EXF, KPI, LB, PREDS, SHOCK, tasks
from .views import VIEWS_SQL as V


def _fitted(name: str, covariates: bool = False):
    def run(spark, d):
        q = views.qpanel(spark, d)
        if covariates:
            m = pipelines.factor_panel(views.mpanel(spark, d), 126)
            wide = m.groupBy("quarter_ord").pivot("variable", ["A_F", "N_O", "R_F"]).agg(F.first("x"))
            q = q.join(wide, "quarter_ord", "left")
        return models.fitted_forecasts(q, [name], 4, 12, ["A_F", "N_O", "R_F"] if covariates else None)

    return run


for _id, _name, _x in (
    ("m10_bvar_minnesota", "bvar_minnesota", True), ("m10_bvar_minnesota_growth", "bvar_minnesota_growth", True), ("m10_bvar_minnesota_20", "bvar_minnesota_20", True),
    ("m10_bvar_minnesota_growth_20", "bvar_minnesota_growth_20", True),
    ("m11_factor_pca_qd", "factor_pca_qd", True), ("m16_auto_arima", "auto_arima", False), ("m16_auto_arima_growth", "auto_arima_growth", False),
):
    query(_id)(_fitted(_name, _x))


P = 4
_X = ["1.0", *[f"l{k}" for k in range(1, P + 1)], "z"]
_SUMS = "[" + ", ".join("[" + ", ".join(f"sum(CASE WHEN ok THEN {_X[i]} * {_X[j]} END) OVER w" for j in range(P + 2)) + "]" for i in range(P + 1)) + "]"
#: Paths of an autoregression by normal equations and elimination.
AR = """
, base AS (SELECT series_id, quarter_ord, y, count(y) OVER w AS n, first_value(y) OVER w AS f, lag(y) OVER (PARTITION BY series_id ORDER BY quarter_ord) AS y1 FROM qpanel WINDOW w AS (PARTITION BY series_id ORDER BY quarter_ord ROWS UNBOUNDED PRECEDING)),
scaled AS (SELECT *, {z} AS z FROM base),
lagged AS (SELECT *, """ + ", ".join(f"lag(z, {k}) OVER o AS l{k}" for k in range(1, P + 1)) + """ FROM scaled WINDOW o AS (PARTITION BY series_id ORDER BY quarter_ord)),
marked AS (SELECT *, z IS NOT NULL AND """ + " AND ".join(f"l{k} IS NOT NULL" for k in range(1, P + 1)) + """ AS ok FROM lagged),
sums AS (SELECT *, """ + _SUMS + """ AS m FROM marked WINDOW w AS (PARTITION BY series_id ORDER BY quarter_ord ROWS UNBOUNDED PRECEDING)),
solving AS (SELECT series_id, quarter_ord, 1 AS k, m FROM sums WHERE n >= 12
  UNION ALL SELECT series_id, quarter_ord, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * (m[k][j] / m[k][k])) END) FROM solving WHERE k <= 5),
solved AS (SELECT s.*, g.m[1][6] AS b0, g.m[2][6] AS b1, g.m[3][6] AS b2, g.m[4][6] AS b3, g.m[5][6] AS b4 FROM marked s JOIN solving g ON g.series_id = s.series_id AND g.quarter_ord = s.quarter_ord AND g.k = 6),
p1 AS (SELECT *, b0 + b1 * z + b2 * l1 + b3 * l2 + b4 * l3 AS f1 FROM solved), p2 AS (SELECT *, b0 + b1 * f1 + b2 * z + b3 * l1 + b4 * l2 AS f2 FROM p1),
p3 AS (SELECT *, b0 + b1 * f2 + b2 * f1 + b3 * z + b4 * l1 AS f3 FROM p2), p4 AS (SELECT *, b0 + b1 * f3 + b2 * f2 + b3 * f1 + b4 * z AS f4 FROM p3),
path AS (SELECT *, unnest([1, 2, 3, 4]) AS h, unnest([f1, f2, f3, f4]) AS v, unnest([f1, f1 + f2, f1 + f2 + f3, f1 + f2 + f3 + f4]) AS total FROM p4)
"""
AR_ROWS = """SELECT '{name}' AS model, series_id, quarter_ord AS origin_ord, h, quarter_ord + h AS target_ord, round({back}, 0) AS y_hat, round(y, 0) AS last_y FROM path"""
RV = V.replace("WITH monthly", "WITH RECURSIVE monthly", 1)


def _ar_sql(name: str, z: str, back: str) -> str:
    return RV + (AR + AR_ROWS).replace("{name}", name).replace("{z}", z).replace("{back}", back)


SMOOTH = ", s AS (SELECT series_id, quarter_ord, y, row_number() OVER (PARTITION BY series_id ORDER BY quarter_ord) AS i FROM qpanel)"
_PATH = "SELECT '{0}' AS model, s.series_id, s.quarter_ord AS origin_ord, h, s.quarter_ord + h AS target_ord, round({1}, 0) AS y_hat, round(s.y, 0) AS last_y FROM {2} r JOIN s ON s.series_id = r.series_id AND s.i = r.i, (SELECT unnest([1, 2, 3, 4]) AS h) WHERE r.i >= 12"


def _smoothed(name: str):
    return lambda spark, d: smoothing.smoothed_forecasts(views.qpanel(spark, d), 4, 12, (name,))


query("m15_theta", RV + SMOOTH + """
, run AS (SELECT series_id, i, y AS level FROM s WHERE i = 1 UNION ALL SELECT s.series_id, s.i, level + 0.5 * (s.y - level) FROM run r JOIN s ON s.series_id = r.series_id AND s.i = r.i + 1),
sl AS (SELECT series_id, i, regr_slope(y, i) OVER (PARTITION BY series_id ORDER BY i) AS slope FROM s), both_ AS (SELECT run.series_id, run.i, level, slope FROM run JOIN sl USING (series_id, i))
""" + _PATH.format("theta", "level + slope / 2 * (h - 1 + 2)", "both_"), 0)(_smoothed("theta"))
query("m15_auto_ets", RV + SMOOTH + """
, gr AS (SELECT a, b[1] AS b, b[2] AS phi, row_number() OVER () AS k FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS a), (SELECT unnest([[0.0, 1.0], [0.1, 0.9], [0.1, 1.0], [0.3, 0.9]]::DOUBLE[][]) AS b)),
run AS (SELECT s.series_id, gr.k, CAST(1 AS BIGINT) AS i, s.y AS level, CASE WHEN b > 0 THEN (f.y - s.y) / 4 ELSE 0.0 END AS trend, CAST(0 AS DOUBLE) AS sse FROM s JOIN s f ON f.series_id = s.series_id AND f.i = 5, gr WHERE s.i = 1
  UNION ALL SELECT r.series_id, r.k, s.i, level + phi * trend + a * (s.y - level - phi * trend), phi * trend + a * b * (s.y - level - phi * trend), sse + pow(s.y - level - phi * trend, 2) FROM run r JOIN s ON s.series_id = r.series_id AND s.i = r.i + 1 JOIN gr ON gr.k = r.k),
rated AS (SELECT r.series_id, r.i, level, trend, phi, row_number() OVER (PARTITION BY r.series_id, r.i ORDER BY r.i * ln(sse / r.i + 1e-12) + 2 * p + 2 * p * (p + 1) / greatest(1.0, r.i - p - 1), r.k) AS place FROM (SELECT run.*, phi, CASE WHEN b > 0 THEN 4 ELSE 2 END AS p FROM run JOIN gr USING (k)) r),
best AS (SELECT * FROM rated WHERE place = 1)
""" + _PATH.format("auto_ets", "level + trend * list_sum(list_transform(range(1, h + 1), lambda j: pow(phi, j)))", "best"), 0)(_smoothed("auto_ets"))
_KALMAN = """
, gr AS (SELECT q1, q2, row_number() OVER () AS k FROM (SELECT unnest([0.01, 0.1, 1.0, 10.0]::DOUBLE[]) AS q1), (SELECT unnest([0.0, 0.001, 0.01, 0.1]::DOUBLE[]) AS q2)),
run AS (SELECT series_id, gr.k, CAST(0 AS BIGINT) AS i, y AS a0, CAST(0 AS DOUBLE) AS a1, CAST(1e7 AS DOUBLE) AS p00, CAST(0 AS DOUBLE) AS p01, CAST(1e7 AS DOUBLE) AS p11, CAST(0 AS DOUBLE) AS lik, CAST(0 AS DOUBLE) AS scale FROM s, gr WHERE s.i = 1
  UNION ALL SELECT series_id, k, i, a0 + k0 * e + a1 + k1 * e, a1 + k1 * e, p00 * (1 - k0) + 2 * p01 * (1 - k0) + (p11 - k1 * p01) + q1, p01 * (1 - k0) + p11 - k1 * p01, p11 - k1 * p01 + q2, lik - CASE WHEN i > 2 THEN 0.5 * ln(f) ELSE 0 END, scale + CASE WHEN i > 2 THEN e * e / f ELSE 0 END
  FROM (SELECT r.* EXCLUDE (i), s.i, q1, q2, p00 + 1 AS f, s.y - a0 AS e, p00 / (p00 + 1) AS k0, p01 / (p00 + 1) AS k1 FROM run r JOIN s ON s.series_id = r.series_id AND s.i = r.i + 1 JOIN gr ON gr.k = r.k)),
rated AS (SELECT *, row_number() OVER (PARTITION BY series_id, i ORDER BY 0.5 * greatest(1, i - 2) * ln(scale / greatest(1, i - 2) + 1e-12) - lik, k) AS place FROM run WHERE i > 0),
best AS (SELECT * FROM rated WHERE place = 1)
"""
query("m17_local_trend_ssm", RV + SMOOTH + _KALMAN + _PATH.format("local_trend_ssm", "a0 + a1 * (h - 1)", "best"), 0)(_smoothed("local_trend_ssm"))
query("m17_local_trend_ssm_growth")(_smoothed("local_trend_ssm_growth"))


@query("m08_ar4_growth", _ar_sql("ar4_growth", "ln(y / y1)", "y * exp(total)"), 0)
def m08(spark, d):
    return autoregression.ar_forecasts(views.qpanel(spark, d), 4, 12, ("ar4_growth",))


@query("m09_ar4", _ar_sql("ar4", "y / f", "v * f"), 0)
def m09(spark, d):
    return autoregression.ar_forecasts(views.qpanel(spark, d), 4, 12, ("ar4",))


_UNIT = "((('0x' || substr(md5('0|{0}|' || series_id || '|' || quarter_ord || '|' || h), 1, 10))::BIGINT + 0.5) / 1099511627776.0)"


@query("m07_random_models", V + f"""
, b AS (SELECT series_id, quarter_ord, y, count(y) OVER w AS n, avg(y) OVER w AS a, stddev_pop(y) OVER w AS sd, min(y) OVER w AS lo, max(y) OVER w AS hi FROM qpanel WINDOW w AS (PARTITION BY series_id ORDER BY quarter_ord ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, unnest([1, 2, 3, 4]) AS h FROM b WHERE n >= 8),
d AS (SELECT s.*, p.y AS picked FROM (SELECT *, CAST(floor({_UNIT.format(3)} * n) AS BIGINT) + 1 AS place FROM s) s JOIN b p ON p.series_id = s.series_id AND p.n = s.place)
SELECT 'random_normal' AS model, series_id, quarter_ord AS origin_ord, h, quarter_ord + h AS target_ord, round(a + sd * sqrt(-2 * ln({_UNIT.format(1)})) * cos(2 * pi() * {_UNIT.format(2)}), 1) AS y_hat, round(y, 1) AS last_y FROM d
UNION ALL SELECT 'random_uniform', series_id, quarter_ord, h, quarter_ord + h, round(lo + (hi - lo) * {_UNIT.format(4)}, 1), round(y, 1) FROM d UNION ALL SELECT 'random_permutation', series_id, quarter_ord, h, quarter_ord + h, round(picked, 1), round(y, 1) FROM d""", 1)
def m07(spark, d):
    return registry.forecast(views.qpanel(spark, d), list(registry.RANDOM))


@query("m12_mixed_frequency_factors")
def m12(spark, d):
    """Factors of month slots, as far as each quarter has them, in the ridge of the factor model."""
    from ..operators import features

    slots = features.month_slots(views.mpanel(spark, d), ["variable"], "month_date", "x")
    q = features.add_month_features(views.qpanel(spark, d), slots, ["A_F", "N_O", "R_F"])
    names = [f"{v}_m{k}" for v in ("A_F", "N_O", "R_F") for k in (1, 2, 3)]
    return models.fitted_forecasts(q, ["factor_pca_qd"], 4, 12, names)


def _trees(kind: str):
    """Trees over all series with the monthly quantities as covariates and the quarter of the year as what is known ahead."""

    def run(spark, d):
        q = views.qpanel(spark, d)
        wide = asof.quarterly_mean(views.mpanel(spark, d), ["variable"], "month_date", "x").groupBy("quarter_ord").pivot("variable", ["A_F", "N_O", "R_F"]).agg(F.first("x"))
        q = q.join(F.broadcast(wide), "quarter_ord", "left").withColumn("season", (F.col("quarter_ord") % 4).cast("double"))
        return trees.tree_forecasts(q, kind, covariates=["A_F", "N_O", "R_F"], known=["season"])

    return run


for _id, _kind in (("m13_random_forest", "random_forest"), ("m13_random_forest_growth", "random_forest_growth"), ("m14_boosted_trees", "xgboost"), ("m14_boosted_trees_growth", "xgboost_growth")):
    query(_id)(_trees(_kind))


@query("m21_growth_wrapper", V + """
, g0 AS (SELECT series_id, quarter_ord, y, lag(y) OVER (PARTITION BY series_id ORDER BY quarter_ord) AS y1 FROM qpanel),
g1 AS (SELECT *, 100 * (pow(y / y1, 4) - 1) AS g FROM g0 WHERE y > 0 AND y1 > 0),
g2 AS (SELECT *, count(g) OVER w AS n, first_value(g) OVER w AS f, avg(g) OVER w AS a FROM g1 WINDOW w AS (PARTITION BY series_id ORDER BY quarter_ord ROWS UNBOUNDED PRECEDING)),
st AS (SELECT *, unnest([1, 2, 3, 4]) AS h FROM g2 WHERE n >= 8),
pt AS (SELECT 'drift' AS model, *, g + h * (g - f) / (n - 1) AS v FROM st UNION ALL SELECT 'mean', *, a FROM st),
lv AS (SELECT *, CASE WHEN v > -100 THEN y * exp(sum(CASE WHEN v > -100 THEN ln(1 + v / 100) / 4 END) OVER (PARTITION BY model, series_id, quarter_ord ORDER BY h)) END AS level FROM pt)
SELECT model || '_on_growth' AS model, series_id, quarter_ord AS origin_ord, h, quarter_ord + h AS target_ord, round(coalesce(level, y), 2) AS y_hat, round(y, 2) AS last_y FROM lv""", 2)
def m21(spark, d):
    return registry.on_growth(views.qpanel(spark, d), ["drift", "mean"])


@query("m21_growth_wrapper_ar4")
def m21b(spark, d):
    return registry.on_growth(views.qpanel(spark, d), ["ar4"])


@query("m20_model_registry", V + PREDS + "SELECT model, series_id, origin_ord, h, target_ord, round(y_hat, 6) AS y_hat, round(last_y, 6) AS last_y FROM preds WHERE model IN ('naive_last', 'drift', 'seasonal_naive')", 6)
def m20(spark, d):
    """Models by other names and twice, as the registry finds them."""
    return registry.forecast(views.qpanel(spark, d), ["naive", "Last", "drift", "snaive", "drift"])


def _half_way(panel, horizon, origins):
    """A model of a user by DataFrame operations: half-way between the last two values."""
    from pyspark.sql import Window

    from ..operators import baselines

    before = F.lag("y").over(Window.partitionBy("series_id").orderBy("quarter_ord"))
    at = baselines.at_origins(panel.withColumn("b", before).where("b IS NOT NULL"), origins)
    h = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long")))
    rows = at.select("series_id", F.col("quarter_ord").alias("origin_ord"), "y", "b", h.alias("h"))
    return rows.select(F.lit("half_way").alias("model"), "series_id", "origin_ord", "h", (F.col("origin_ord") + F.col("h")).alias("target_ord"), ((F.col("y") + F.col("b")) / 2).alias("y_hat"), F.col("y").alias("last_y"))


def _plus_steps(history):
    """A model of a user of one origin's history: the last value and the step."""
    import pandas as pd

    return pd.DataFrame({"h": [1, 2], "y_hat": [history["y"].iloc[-1] + h for h in (1, 2)]})


@query("u01_register_model", V + """
, o AS (SELECT series_id, quarter_ord, y, lag(y) OVER w AS b, count(y) OVER w AS n FROM qpanel WINDOW w AS (PARTITION BY series_id ORDER BY quarter_ord)), st AS (SELECT *, unnest([1, 2]) AS h FROM o)
SELECT 'half_way' AS model, series_id, quarter_ord AS origin_ord, h, quarter_ord + h AS target_ord, round((y + b) / 2, 3) AS y_hat, round(y, 3) AS last_y FROM st WHERE b IS NOT NULL
UNION ALL SELECT 'plus_steps', series_id, quarter_ord, h, quarter_ord + h, round(y + h, 3), round(y, 3) FROM st WHERE n >= 8""", 3)
def u01(spark, d):
    """Two models of a user, one by DataFrame operations and one by a function of each history."""
    for name, fn, kind in (("half_way", _half_way, "frame"), ("plus_steps", _plus_steps, "pandas")):
        if name not in registry.OWN:
            registry.register_model(name, fn, kind)
    return registry.forecast(views.qpanel(spark, d), ["half_way", "plus_steps"], 2)


@query("f08_factor_panel", V + """
, q AS (SELECT variable, (year(month_date) - 1970) * 4 + quarter(month_date) - 1 AS quarter_ord, avg(x) AS x FROM mpanel WHERE year(month_date) <> 1998 GROUP BY 1, 2),
g AS (SELECT a.quarter_ord, b.variable FROM (SELECT DISTINCT quarter_ord FROM q WHERE quarter_ord <= 120) a CROSS JOIN (SELECT DISTINCT variable FROM q WHERE quarter_ord <= 120) b)
SELECT variable, quarter_ord, round(coalesce(last_value(x IGNORE NULLS) OVER w, first_value(x IGNORE NULLS) OVER f, 0.0), 4) AS x FROM g LEFT JOIN q USING (variable, quarter_ord)
WINDOW w AS (PARTITION BY variable ORDER BY quarter_ord ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY variable ORDER BY quarter_ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def f08(spark, d):
    return pipelines.factor_panel(views.mpanel(spark, d), 120, [1998])


@query("j15_window_provenance", V + """
, w AS (SELECT DISTINCT series_id AS task, quarter_ord - 100 AS window_idx, obs_date AS cutoff FROM qpanel),
dd AS (SELECT DISTINCT asof_date FROM versions)
SELECT task, window_idx, CAST(cutoff AS VARCHAR) AS cutoff, CAST(coalesce((SELECT max(asof_date) FROM dd WHERE asof_date <= cutoff), (SELECT min(asof_date) FROM dd)) AS VARCHAR) AS vintage_date,
  (SELECT max(asof_date) FROM dd WHERE asof_date <= cutoff) IS NULL AS used_fallback, CASE WHEN (SELECT max(asof_date) FROM dd WHERE asof_date <= cutoff) IS NULL THEN 'earliest' ELSE 'panel' END AS source FROM w""")
def j15(spark, d):
    w = views.qpanel(spark, d).select(F.col("series_id").alias("task"), (F.col("quarter_ord") - 100).alias("window_idx"), F.col("obs_date").alias("cutoff"))
    days = views.versions(spark, d).select("asof_date").distinct()
    return pipelines.provenance(w, days)


@query("j16_covariate_frame", V + """
, p AS (SELECT CASE WHEN month_date < DATE '1999-01-01' THEN '1999-01' ELSE '2001-01' END AS vintage, variable AS series_id, month_date AS obs_date, x AS value FROM mpanel)
SELECT vintage, series_id, CAST(obs_date AS VARCHAR) AS obs_date, round(value, 4) AS value FROM p WHERE vintage = '1999-01'""")
def j16(spark, d):
    p = views.mpanel(spark, d).select(F.when(F.col("month_date") < F.lit("1999-01-01"), "1999-01").otherwise("2001-01").alias("vintage"), F.col("variable").alias("series_id"), F.col("month_date").alias("obs_date"), F.col("x").alias("value"))
    return pipelines.covariate_frame(p, "2000-06")


@query("v13_latest_forecast", V + KPI + """
, l AS (SELECT series_id, max(quarter_ord) AS lo FROM qpanel GROUP BY 1),
p AS (SELECT p.* FROM preds p JOIN l ON l.series_id = p.series_id AND p.origin_ord = lo WHERE model IN ('drift', 'seasonal_naive')),
b AS (SELECT *, coalesce(lag(y_hat) OVER (PARTITION BY model, series_id ORDER BY h), last_y) AS b FROM p)
SELECT model, series_id, target_ord, CAST(last_day(make_date(1970 + target_ord // 4, (target_ord % 4) * 3 + 3, 1)) AS VARCHAR) AS target_end, h, round(y_hat, 6) AS y_hat, round(100 * (y_hat / b - 1), 2) AS qoq, round(CASE WHEN y_hat > 0 AND b > 0 THEN 100 * (pow(y_hat / b, 4) - 1) END, 2) AS saar FROM b""", 6)
def v13(spark, d):
    return pipelines.latest_forecast(views.qpanel(spark, d), ["drift", "seasonal_naive"]).withColumns({c: F.round(c, 2) for c in ("qoq", "saar")})


@query("v12_nowcast_trace", V + REL + """
, cuts AS (SELECT DISTINCT asof_date AS cutoff FROM versions WHERE asof_date BETWEEN DATE '1998-01-31' AND DATE '1998-12-31'),
known AS (SELECT cutoff, series_id, (year(obs_date) - 1970) * 4 + quarter(obs_date) - 1 AS quarter_ord, arg_max(value, asof_date) AS y FROM versions, cuts WHERE asof_date <= cutoff GROUP BY 1, 2, 3),
tr AS (SELECT * FROM known WHERE quarter_ord < 115),
a AS (SELECT series_id, cutoff, count(*) AS n, max(quarter_ord) AS lo, arg_max(y, quarter_ord) AS y, arg_min(y, quarter_ord) AS f FROM tr GROUP BY 1, 2),
p AS (SELECT a.*, 115 - lo AS h FROM a WHERE n >= 8 AND 115 - lo BETWEEN 1 AND 4),
fr AS (SELECT series_id, first_date FROM rel WHERE quarter_ord = 115)
SELECT 'drift' AS model, p.series_id, CAST(cutoff AS VARCHAR) AS cutoff, h, round(y + h * (y - f) / (n - 1), 6) AS y_hat,
  coalesce(cutoff = max(CASE WHEN cutoff < first_date THEN cutoff END) OVER (PARTITION BY p.series_id), false) AS last_before FROM p LEFT JOIN fr ON fr.series_id = p.series_id""", 6)
def v12(spark, d):
    return pipelines.nowcast_trace(views.versions(spark, d), 115, ["drift"], "1998-01-31", "1998-12-31")


#: Records of the evaluation on two stages, whose windows train on what was known by each cutoff.
E15 = REL + """
, tr AS (SELECT series_id, stage, quarter_ord AS q, value AS y FROM stages WHERE stage IN ('first', 'third')),
nn AS (SELECT *, row_number() OVER (PARTITION BY series_id, stage ORDER BY q) AS i, count(*) OVER (PARTITION BY series_id, stage) AS n FROM tr),
cut AS (SELECT series_id, stage, i - n + 4 + 8 - 1 AS window_idx, q AS origin, CAST(last_day(make_date(1970 + q // 4, (q % 4) * 3 + 3, 1)) AS DATE) AS cutoff FROM nn WHERE i - n + 4 + 8 - 1 BETWEEN 0 AND 7),
dd AS (SELECT DISTINCT asof_date FROM versions),
cho AS (SELECT *, (SELECT max(asof_date) FROM dd WHERE asof_date <= cutoff) IS NULL AS early, coalesce((SELECT max(asof_date) FROM dd WHERE asof_date <= cutoff), (SELECT min(asof_date) FROM dd)) AS vint FROM cut),
known AS (SELECT vint, series_id, (year(obs_date) - 1970) * 4 + quarter(obs_date) - 1 AS q, arg_max(value, asof_date) AS value FROM versions JOIN (SELECT DISTINCT vint FROM cho) ON asof_date <= vint GROUP BY 1, 2, 3),
hist15 AS (SELECT c.series_id, c.stage, c.window_idx, c.origin, t.q, coalesce(k.value, t.y) AS y FROM cho c JOIN tr t ON t.series_id = c.series_id AND t.stage = c.stage AND t.q <= c.origin LEFT JOIN known k ON k.vint = c.vint AND k.series_id = c.series_id AND k.q = t.q),
ag AS (SELECT series_id, stage, window_idx, origin, count(*) AS n, arg_min(y, q) AS f, avg(y) AS a, list(y ORDER BY q DESC) AS l FROM hist15 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 8),
st AS (SELECT *, l[1] AS y, unnest([1, 2, 3, 4]) AS h FROM ag),
made AS (SELECT 'naive_last' AS model, *, y AS y_hat FROM st UNION ALL SELECT 'drift', *, y + h * (y - f) / (n - 1) FROM st UNION ALL SELECT 'mean', *, a FROM st UNION ALL SELECT 'seasonal_naive', *, l[5 - h] FROM st),
rec AS (SELECT m.model, m.series_id, m.stage, m.window_idx, m.origin, m.h, m.origin + m.h AS target, m.y_hat, t.y AS y_true, m.y AS last_y, m.y_hat - t.y AS e FROM made m JOIN tr t ON t.series_id = m.series_id AND t.stage = m.stage AND t.q = m.origin + m.h),
tk AS (SELECT stage, series_id || '__' || stage || '_h' || h AS task, model, sqrt(avg(e * e)) AS metric FROM rec GROUP BY 1, 2, 3)
"""


def _evaluated(spark, d) -> dict:
    return evaluation.run(views.versions(spark, d), ["naive_last", "drift", "mean", "seasonal_naive"], "naive_last", ["first", "third"], shock=SHOCK)


@query("e15_evaluation_pipeline", V + E15 + """
, wr AS (SELECT stage, model, count(*) AS n_tasks, avg(CASE WHEN metric = best THEN 1.0 ELSE 0.0 END) AS win_rate FROM (SELECT *, min(metric) OVER (PARTITION BY task) AS best FROM tk) GROUP BY 1, 2),
mm AS (SELECT t.stage, t.model, avg(t.metric) AS mean_metric, 1 - avg(t.metric) / avg(b.metric) AS skill FROM tk t JOIN tk b ON b.task = t.task AND b.model = 'naive_last' GROUP BY 1, 2)
SELECT mm.stage, mm.model, round(mean_metric, 2) AS mean_metric, round(skill, 4) AS skill, n_tasks, round(win_rate, 4) AS win_rate FROM mm JOIN wr USING (stage, model)""")
def e15(spark, d):
    return _evaluated(spark, d)["leaderboard"].withColumn("mean_metric", F.round("mean_metric", 2))


@query("e15_records", V + E15 + "SELECT model, series_id, stage, window_idx, origin AS origin_ord, h, target AS target_ord, round(y_hat, 6) AS y_hat, round(y_true, 6) AS y_true, round(last_y, 6) AS last_y, CAST(vint AS VARCHAR) AS vintage_date, CASE WHEN early THEN 'earliest' ELSE 'panel' END AS source FROM rec JOIN (SELECT series_id, stage, window_idx, vint, early FROM cho) USING (series_id, stage, window_idx)", 6)
def e15b(spark, d):
    return _evaluated(spark, d)["records"]


@query("e15_window_vintages", V + E15 + "SELECT series_id, stage, window_idx, origin AS origin_ord, CAST(cutoff AS VARCHAR) AS cutoff, CAST(vint AS VARCHAR) AS vintage_date, CASE WHEN early THEN 'earliest' ELSE 'panel' END AS source FROM cho")
def e15c(spark, d):
    return _evaluated(spark, d)["window_vintages"]


_END = "CAST(last_day(make_date(1970 + CAST({0} AS BIGINT) // 4, (CAST({0} AS BIGINT) % 4) * 3 + 3, 1)) AS VARCHAR)"


@query("e15_exchange", V + E15 + f"""
SELECT {_END.format("target")} AS date, {_END.format("(origin + 1)")} AS vintage_date, 'y_' || series_id || '__' || stage AS variable, 'Q' AS frequency, h - 1 AS forecast_horizon, round(y_hat, 6) AS value, model AS source, 'levels' AS metric FROM rec
UNION ALL SELECT {_END.format("quarter_ord")}, {_END.format("rq")}, 'y_' || series_id || '__' || stage, 'Q', quarter_ord - rq, round(value, 6), 'outturn', 'levels' FROM (SELECT *, (year(release_date) - 1970) * 4 + quarter(release_date) - 1 AS rq FROM stages WHERE stage IN ('first', 'third'))""", 6)
def e15d(spark, d):
    """Forecasts and outturns in the exchange schema, the latter with the source "outturn"."""
    out = _evaluated(spark, d)
    return out["forecasts"].unionByName(out["outturns"].withColumn("source", F.lit("outturn")))


REALTIME_MODELS = ["naive_last", "mean", "drift", "seasonal_naive", "rw_drift_log", "mean_growth"]


@query("e16_realtime_backtest", V + LB + REL + """
, picked AS (SELECT CASE model WHEN 'drift' THEN 'rw_drift_log' WHEN 'mean' THEN 'mean_growth' ELSE model END AS model, row_number() OVER (ORDER BY skill DESC, model) AS r FROM lb WHERE skill > 0.0 AND model <> 'naive_last'),
members AS (SELECT DISTINCT ensemble, model FROM picked, (SELECT unnest(['ensemble_top3', 'ensemble_top5']) AS ensemble, unnest([3, 5]) AS k) WHERE r <= k),
dd AS (SELECT DISTINCT asof_date FROM versions),
og AS (SELECT series_id, quarter_ord AS target, first_date - 1 AS origin, (SELECT max(asof_date) FROM dd WHERE asof_date <= first_date - 1) AS vint FROM rel),
known AS (SELECT o.series_id, o.target, o.origin, o.vint, (year(v.obs_date) - 1970) * 4 + quarter(v.obs_date) - 1 AS q, arg_max(v.value, v.asof_date) AS y FROM og o JOIN versions v ON v.series_id = o.series_id AND v.asof_date <= o.vint GROUP BY 1, 2, 3, 4, 5),
kl AS (SELECT *, lag(y) OVER (PARTITION BY series_id, target ORDER BY q) AS y1 FROM known WHERE q < target),
ag AS (SELECT series_id, target, origin, vint, count(*) AS n, max(q) AS lastq, arg_min(y, q) AS f, avg(y) AS a, avg(CASE WHEN y > 0 AND y1 > 0 THEN 100 * (pow(y / y1, 4) - 1) END) AS ga, list(y ORDER BY q DESC) AS l FROM kl GROUP BY 1, 2, 3, 4 HAVING count(*) >= 8),
st AS (SELECT *, l[1] AS y, unnest([1, 2]) AS h FROM ag),
made AS (SELECT 'naive_last' AS model, *, y AS y_hat FROM st UNION ALL SELECT 'mean', *, a FROM st UNION ALL SELECT 'drift', *, y + h * (y - f) / (n - 1) FROM st UNION ALL SELECT 'seasonal_naive', *, l[5 - h] FROM st
  UNION ALL SELECT 'rw_drift_log', *, CASE WHEN y > 0 AND f > 0 THEN exp(ln(y) + h * (ln(y) - ln(f)) / (n - 1)) ELSE y END FROM st UNION ALL SELECT 'mean_growth', *, coalesce(y * pow(CASE WHEN ga > -100 THEN 1 + ga / 100 END, h / 4.0), y) FROM st),
lev AS (SELECT *, coalesce(lag(y_hat) OVER (PARTITION BY model, series_id, target ORDER BY h), y) AS level_before FROM made),
gr AS (SELECT *, CASE WHEN y_hat > 0 AND level_before > 0 THEN 100 * (pow(y_hat / level_before, 4) - 1) END AS g_hat FROM lev),
sc AS (SELECT g.model, g.series_id, g.origin, g.vint, g.lastq AS origin_ord, g.lastq + g.h AS target_ord, g.h, s.stage, g.y_hat, g.level_before, g.g_hat, s.value AS y_true, (year(s.release_date) - year(g.origin)) * 12 + month(s.release_date) - month(g.origin) AS months
  FROM gr g JOIN stages s ON s.series_id = g.series_id AND s.quarter_ord = g.lastq + g.h AND s.stage IN ('first', 'third')),
en AS (SELECT m.ensemble AS model, series_id, origin, any_value(vint) AS vint, any_value(origin_ord) AS origin_ord, target_ord, h, stage, avg(level_before) AS level_before, avg(g_hat) AS g_hat, any_value(y_true) AS y_true, any_value(months) AS months FROM sc JOIN members m USING (model) GROUP BY ALL),
al AS (SELECT model, series_id, origin, vint, origin_ord, target_ord, h, stage, y_hat, level_before, g_hat, y_true, months FROM sc UNION ALL
  SELECT model, series_id, origin, vint, origin_ord, target_ord, h, stage, CASE WHEN level_before > 0 AND g_hat > -100 THEN level_before * pow(1 + g_hat / 100, 0.25) END, level_before, g_hat, y_true, months FROM en)
SELECT model, series_id, CAST(origin AS VARCHAR) AS origin, CAST(vint AS VARCHAR) AS vintage_date, origin_ord, target_ord, h, stage, """ + places_sql("y_hat") + " AS y_hat, " + places_sql("level_before") + " AS level_before, " + wide_sql("g_hat") + """ AS g_hat, round(y_true, 6) AS y_true, months,
  CASE WHEN months <= 0 THEN '<=0' WHEN months = 1 THEN '1' WHEN months <= 3 THEN '2-3' WHEN months <= 6 THEN '4-6' ELSE '7+' END AS bucket FROM al""", 6)
def e16(spark, d):
    """The models, and the means in growth of the best three and five of the evaluation's leaderboard."""
    board = evaluate.leaderboard(tasks(spark, d), "seasonal_naive")
    r = pipelines.realtime_backtest(views.versions(spark, d), REALTIME_MODELS, members=pipelines.leaderboard_members(board))
    return r.withColumns({"y_hat": places("y_hat"), "level_before": places("level_before"), "g_hat": wide(F.col("g_hat"))})


@query("e16_realtime_autoregressions")
def e16c(spark, d):
    return pipelines.realtime_backtest(views.versions(spark, d), ["naive_last", "ar4", "ar4_growth"])


@query("e16_realtime_metrics", V + REL + """
, dd AS (SELECT DISTINCT asof_date FROM versions),
origins AS (SELECT series_id, quarter_ord AS target, first_date - 1 AS origin, (SELECT max(asof_date) FROM dd WHERE asof_date <= first_date - 1) AS vintage FROM rel),
known AS (SELECT o.series_id, o.target, o.origin, (year(v.obs_date) - 1970) * 4 + quarter(v.obs_date) - 1 AS q, arg_max(v.value, v.asof_date) AS y FROM origins o JOIN versions v ON v.series_id = o.series_id AND v.asof_date <= o.vintage GROUP BY 1, 2, 3, 4),
hist AS (SELECT series_id, target, origin, count(*) AS n, max(q) AS last, arg_max(y, q) AS y, arg_min(y, q) AS f, avg(y) AS a FROM known WHERE q < target GROUP BY 1, 2, 3 HAVING count(*) >= 8),
steps AS (SELECT *, unnest([1, 2]) AS h FROM hist),
made AS (SELECT 'naive_last' AS model, series_id, origin, h, last + h AS target_ord, y AS y_hat FROM steps UNION ALL SELECT 'drift', series_id, origin, h, last + h, y + h * (y - f) / (n - 1) FROM steps UNION ALL SELECT 'mean', series_id, origin, h, last + h, a FROM steps),
scored AS (SELECT m.*, rel.first_release AS y_true, (year(first_date) - year(origin)) * 12 + month(first_date) - month(origin) AS months FROM made m JOIN rel ON rel.series_id = m.series_id AND rel.quarter_ord = m.target_ord),
each_ AS (SELECT model, h, CASE WHEN months <= 0 THEN '<=0' WHEN months = 1 THEN '1' WHEN months <= 3 THEN '2-3' WHEN months <= 6 THEN '4-6' ELSE '7+' END AS bucket, series_id, target_ord, avg(y_hat - y_true) AS e, avg(CASE WHEN y_hat > 0 AND y_true > 0 THEN ln(y_hat / y_true) END) AS le FROM scored GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT model, h, bucket, count(e) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, sqrt(avg(le * le)) AS rmse_log FROM each_ GROUP BY 1, 2, 3)
SELECT m.model, m.h, m.bucket, m.n, round(m.rmse, 2) AS rmse, round(m.mae, 2) AS mae, round(m.rmse_log, 4) AS rmse_log, round(CASE WHEN b.rmse > 0 THEN m.rmse / b.rmse END, 4) AS rel_rmse FROM m LEFT JOIN m b ON b.model = 'naive_last' AND b.h = m.h AND b.bucket = m.bucket""")
def e16b(spark, d):
    r = pipelines.realtime_backtest(views.versions(spark, d), ["naive_last", "drift", "mean"])
    out = evaluate.relative_metrics(r.where("stage = 'first'"), "naive_last", "bucket")
    return out.withColumns({"rmse": F.round("rmse", 2), "mae": F.round("mae", 2)})


_QEND = "CAST(last_day(make_date(1970 + CAST({0} AS BIGINT) // 4, (CAST({0} AS BIGINT) % 4) * 3 + 3, 1)) AS VARCHAR)"


@query("e14_extra_benchmarks", RV + PREDS + AR.replace("{z}", "y / f") + f"""
SELECT {_QEND.format("target_ord")} AS date, {_QEND.format("(origin_ord + 1)")} AS vintage_date, 'y_' || series_id AS variable, 'Q' AS frequency, h - 1 AS forecast_horizon, round(y_hat, 0) AS value, model AS source, 'levels' AS metric FROM records WHERE model = 'naive_last'
UNION ALL SELECT {_QEND.format("(p.quarter_ord + h)")}, {_QEND.format("(p.quarter_ord + 1)")}, 'y_' || p.series_id, 'Q', h - 1, round(v * f, 0), 'ar4', 'levels' FROM path p JOIN qpanel q ON q.series_id = p.series_id AND q.quarter_ord = p.quarter_ord + h""", 0)
def e14(spark, d):
    """A random walk and an autoregression as two more sources of the exchange table."""
    from ..operators import baselines

    q = views.qpanel(spark, d)
    both = registry.forecast(q, ["naive_last"]).unionByName(registry.forecast(q, ["ar4"], 4, 12))
    return evaluate.exchange_forecasts(baselines.with_truth(both, q))


def _stream(spark, d):
    """versions as files of a stream; those of June come again later with another value."""
    base = views.scratch(spark, "stream")
    v = views.versions(spark, d).select("series_id", "obs_date", "asof_date", "value", F.col("asof_date").cast("timestamp").alias("arrival"))
    again = v.where("month(asof_date) = 6").withColumns({"value": F.col("value") * 2, "arrival": F.col("arrival") + F.expr("INTERVAL 1 DAY")})
    for rows in (v, again):
        rows.repartitionByRange(2, "asof_date").write.mode("append").parquet(f"{base}/in")
    return revisions.read_stream(spark, f"{base}/in", 1), base


@query("st1_streaming_ingest", V + "SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, CAST(asof_date AS VARCHAR) AS asof_date, round(value, 4) AS value FROM versions")
def st1(spark, d):
    stream, base = _stream(spark, d)
    revisions.ingest_stream(stream, f"{base}/store", f"{base}/checkpoint", "3650 days").awaitTermination()
    return revisions.stored(spark, f"{base}/store").select("series_id", "obs_date", "asof_date", "value")


@query("st2_high_water", V + "SELECT series_id, CAST(max(asof_date) AS VARCHAR) AS max_asof, count(*) + count(CASE WHEN month(asof_date) = 6 THEN 1 END) AS n FROM versions GROUP BY 1")
def st2(spark, d):
    stream, base = _stream(spark, d)
    revisions.high_water_stream(stream, f"{base}/marks", f"{base}/checkpoint").awaitTermination()
    return revisions.high_water_marks(spark, f"{base}/marks")


LATE = """
, again AS (SELECT series_id, obs_date, asof_date, value * 2 AS value FROM versions WHERE month(asof_date) = 6),
marks AS (SELECT series_id, max(asof_date) AS mark FROM versions GROUP BY 1),
late AS (SELECT a.*, mark FROM again a JOIN marks USING (series_id) WHERE a.asof_date <= mark - 7)"""


def _late(spark, d) -> str:
    """A folder with what a stream of three arrivals leaves: versions up to 1997, the later ones, and those of June once more."""
    base = views.scratch(spark, "late")
    v = views.versions(spark, d).select("series_id", "obs_date", "asof_date", "value", F.col("asof_date").cast("timestamp").alias("arrival"))
    for rows in (v.where("asof_date < '1998-01-01'"), v.where("asof_date >= '1998-01-01'"), v.where("month(asof_date) = 6").withColumn("value", F.col("value") * 2)):
        rows.write.mode("append").parquet(f"{base}/in")
        revisions.late_rows_stream(revisions.read_stream(spark, f"{base}/in", 1000), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return f"{base}/out"


@query("st2_late_rows", V + LATE + " SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, CAST(asof_date AS VARCHAR) AS asof_date, round(value, 4) AS value, CAST(mark AS VARCHAR) AS mark FROM late")
def st2b(spark, d):
    return revisions.late_table(spark, _late(spark, d)).select("series_id", "obs_date", "asof_date", "value", "mark")


@query("st2_late_marks", V + LATE + """
, n AS (SELECT series_id, CAST(sum(k) AS BIGINT) AS n FROM (SELECT series_id, count(*) AS k FROM versions GROUP BY 1 UNION ALL SELECT series_id, count(*) FROM again GROUP BY 1) GROUP BY 1)
SELECT series_id, CAST(mark AS VARCHAR) AS max_asof, n, coalesce(k, 0) AS late FROM marks JOIN n USING (series_id) LEFT JOIN (SELECT series_id, count(*) AS k FROM late GROUP BY 1) USING (series_id)""")
def st2c(spark, d):
    return revisions.late_marks(spark, _late(spark, d))


@query("st3_latest_snapshot", V + "SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, CAST(max(asof_date) AS VARCHAR) AS asof_used, round(arg_max(value, asof_date), 4) AS value FROM versions GROUP BY 1, 2")
def st3(spark, d):
    stream, base = _stream(spark, d)
    revisions.latest_snapshot_stream(stream, f"{base}/snapshot", f"{base}/checkpoint").awaitTermination()
    return revisions.latest_snapshot(spark, f"{base}/snapshot")


@query("st4_day_delta", V + """
, a AS (SELECT series_id, obs_date, arg_max(value, asof_date) AS v FROM versions WHERE asof_date <= DATE '1998-03-31' GROUP BY 1, 2), b AS (SELECT series_id, obs_date, arg_max(value, asof_date) AS v FROM versions WHERE asof_date < DATE '1998-03-31' GROUP BY 1, 2)
SELECT a.series_id, CAST(a.obs_date AS VARCHAR) AS obs_date, round(b.v, 4) AS before, round(a.v, 4) AS after FROM a LEFT JOIN b ON a.series_id = b.series_id AND a.obs_date = b.obs_date WHERE a.v IS DISTINCT FROM b.v""")
def st4(spark, d):
    return revisions.day_delta(views.versions(spark, d), "1998-03-31")
