"""Queries of scoring, comparison and exchange, over the baseline backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines, evaluate, releases
from . import views
from .catalog import places, query, wide, wide_sql
from .queries_asof import REL
from .views import VIEWS_SQL as V

SHOCK = (113, 114)
#: Steps of the baseline backtest.
HORIZON = 4

PREDS = """
, hist AS (SELECT series_id, quarter_ord, y, lag(y, 1) OVER o AS y1, lag(y, 2) OVER o AS y2, lag(y, 3) OVER o AS y3, first_value(y) OVER w AS f, count(y) OVER w AS n, avg(y) OVER w AS a
  FROM qpanel WINDOW o AS (PARTITION BY series_id ORDER BY quarter_ord), w AS (PARTITION BY series_id ORDER BY quarter_ord ROWS UNBOUNDED PRECEDING)),
hist1 AS (SELECT *, CASE WHEN y > 0 AND y1 > 0 THEN 100 * (pow(y / y1, 4) - 1) END AS g FROM hist),
hist2 AS (SELECT *, avg(g) OVER (PARTITION BY series_id ORDER BY quarter_ord ROWS UNBOUNDED PRECEDING) AS ag FROM hist1),
o AS (SELECT *, unnest(range(1, 5)) AS h FROM hist2 WHERE n >= 8),
preds AS (
  SELECT 'naive_last' AS model, series_id, quarter_ord AS origin_ord, h, quarter_ord + h AS target_ord, y AS y_hat, y AS last_y FROM o
  UNION ALL SELECT 'mean', series_id, quarter_ord, h, quarter_ord + h, a, y FROM o
  UNION ALL SELECT 'drift', series_id, quarter_ord, h, quarter_ord + h, y + h * (y - f) / (n - 1), y FROM o
  UNION ALL SELECT 'seasonal_naive', series_id, quarter_ord, h, quarter_ord + h, CASE (h - 1) % 4 WHEN 0 THEN y3 WHEN 1 THEN y2 WHEN 2 THEN y1 ELSE y END, y FROM o
  UNION ALL SELECT 'naive_last_growth', series_id, quarter_ord, h, quarter_ord + h, coalesce(y * pow(CASE WHEN g > -100 THEN 1 + g / 100 END, h / 4.0), y), y FROM o
  UNION ALL SELECT 'mean_growth', series_id, quarter_ord, h, quarter_ord + h, coalesce(y * pow(CASE WHEN ag > -100 THEN 1 + ag / 100 END, h / 4.0), y), y FROM o
  UNION ALL SELECT 'rw_drift_log', series_id, quarter_ord, h, quarter_ord + h, CASE WHEN y > 0 AND f > 0 THEN exp(ln(y) + h * (ln(y) - ln(f)) / (n - 1)) ELSE y END, y FROM o),
records AS (SELECT p.*, q.y AS y_true, p.y_hat - q.y AS e FROM preds p JOIN qpanel q ON q.series_id = p.series_id AND q.quarter_ord = p.target_ord)
"""
KPI = PREDS + """
, kb AS (SELECT *, coalesce(lag(y_hat) OVER w, last_y) AS level_before, coalesce(lag(y_true) OVER w, last_y) AS true_before FROM records WINDOW w AS (PARTITION BY model, series_id, origin_ord ORDER BY h)),
kpi AS (SELECT *, CASE WHEN y_hat > 0 AND level_before > 0 THEN 100 * (pow(y_hat / level_before, 4) - 1) END AS g_hat, CASE WHEN y_true > 0 AND true_before > 0 THEN 100 * (pow(y_true / true_before, 4) - 1) END AS g_true FROM kb)
"""
TASKS = PREDS + ", tasks AS (SELECT series_id || '_h' || CAST(h AS VARCHAR) AS task, model, sqrt(avg(e * e)) AS metric FROM records GROUP BY 1, 2)"


def rounded(df: DataFrame, name: str = "y_hat") -> DataFrame:
    return df.withColumn(name, places(name))


def forecasts(spark, d) -> DataFrame:
    return baselines.baseline_forecasts(views.qpanel(spark, d))


def records(spark, d) -> DataFrame:
    return baselines.with_truth(forecasts(spark, d), views.qpanel(spark, d))


def tasks(spark, d) -> DataFrame:
    return evaluate.task_metrics(records(spark, d))


@query("m01_baseline_forecasts", V + PREDS + "SELECT model, series_id, origin_ord, h, target_ord, CASE WHEN model IN ('naive_last', 'mean', 'drift', 'seasonal_naive') THEN round(y_hat, 6) ELSE round(y_hat, 2) END AS y_hat, round(last_y, 2) AS last_y FROM preds", 6)
def m01(spark, d):
    return rounded(forecasts(spark, d))


for _model, _name in (("mean", "m02_mean"), ("drift", "m03_drift"), ("seasonal_naive", "m04_seasonal_naive"), ("mean_growth", "m05_mean_growth"), ("rw_drift_log", "m06_log_drift")):

    def _one(spark, d, _model=_model):
        return rounded(baselines.baseline_forecasts(views.qpanel(spark, d), models=(_model,))).select("series_id", "origin_ord", "h", "y_hat")

    query(_name, V + PREDS + f"SELECT series_id, origin_ord, h, CASE WHEN model IN ('naive_last', 'mean', 'drift', 'seasonal_naive') THEN round(y_hat, 6) ELSE round(y_hat, 2) END AS y_hat FROM preds WHERE model = '{_model}'", 6)(_one)


@query("e02_prediction_records", V + PREDS + "SELECT model, series_id, origin_ord, h, target_ord, CASE WHEN model IN ('naive_last', 'mean', 'drift', 'seasonal_naive') THEN round(y_hat, 6) ELSE round(y_hat, 2) END AS y_hat, round(last_y, 2) AS last_y, round(y_true, 2) AS y_true FROM records", 6)
def e02(spark, d):
    return rounded(records(spark, d))


@query("e01_prediction_violations", V + PREDS + """
, broken AS (SELECT model, series_id, origin_ord, h, CASE WHEN origin_ord % 7 = 0 AND h = 2 THEN NULL ELSE y_hat END AS v FROM preds WHERE NOT (origin_ord % 5 = 0 AND h = 4))
SELECT model, series_id, origin_ord, count(DISTINCT h) AS steps, CAST(sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM broken GROUP BY 1, 2, 3 HAVING count(DISTINCT h) <> 4 OR sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) > 0""")
def e01(spark, d):
    f = forecasts(spark, d).where("NOT (origin_ord % 5 = 0 AND h = 4)")
    return evaluate.violations(f.withColumn("y_hat", F.when((F.col("origin_ord") % 7 == 0) & (F.col("h") == 2), F.lit(float("inf"))).otherwise(F.col("y_hat"))), 4)


@query("e03_level_kpi", V + KPI + "SELECT model, series_id, origin_ord, h, CASE WHEN model IN ('naive_last', 'mean', 'drift', 'seasonal_naive') THEN round(level_before, 6) ELSE round(level_before, 2) END AS level_before, " + wide_sql("g_hat") + " AS g_hat, " + wide_sql("g_true") + " AS g_true FROM kpi", 6)
def e03(spark, d):
    k = rounded(evaluate.level_kpi(records(spark, d)), "level_before")
    return k.select("model", "series_id", "origin_ord", "h", "level_before", wide(F.col("g_hat")).alias("g_hat"), wide(F.col("g_true")).alias("g_true"))


@query("a04_point_errors", V + PREDS + "SELECT model, count(e) AS n, round(avg(abs(e)), 2) AS mae, round(avg(e * e) / 1e9, 2) AS mse, round(avg(CASE WHEN target_ord NOT BETWEEN 113 AND 114 THEN e * e END) / 1e9, 2) AS mse_ex, round(sqrt(avg(e * e)), 2) AS rmse, count(CASE WHEN target_ord NOT BETWEEN 113 AND 114 THEN e END) AS n_ex, round(avg(CASE WHEN target_ord NOT BETWEEN 113 AND 114 THEN abs(e) END), 2) AS mae_ex, round(sqrt(avg(CASE WHEN target_ord NOT BETWEEN 113 AND 114 THEN e * e END)), 2) AS rmse_ex FROM records GROUP BY 1", 2)
def a04(spark, d):
    """Mean squares are shown in units of 1e9."""
    return evaluate.point_errors(records(spark, d), ["model"], SHOCK).withColumns({c: F.col(c) / 1e9 for c in ("mse", "mse_ex")})


@query("e08_leaderboard_ex_shock", V + PREDS + """
, m AS (SELECT model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, sqrt(avg(CASE WHEN target_ord NOT BETWEEN 113 AND 114 THEN e * e END)) AS rmse_ex FROM records GROUP BY 1)
SELECT model, round(rmse, 2) AS rmse, round(rmse_ex, 2) AS rmse_ex, row_number() OVER (ORDER BY rmse_ex, rmse, mae, model) AS rank FROM m""", 2)
def e08(spark, d):
    return evaluate.leaderboard_ex_shock(records(spark, d), SHOCK).select("model", "rmse", "rmse_ex", "rank")


@query("a05_kpi_tables", V + KPI + """
, p AS (SELECT *, g_hat - g_true AS ge, CASE WHEN target_ord < 113 THEN 'pre' WHEN target_ord <= 114 THEN 'shock' ELSE 'post' END AS period FROM kpi)
SELECT model, h, coalesce(period, 'all') AS period, count(e) AS n, round(sqrt(avg(e * e)), 1) AS rmse, round(avg(abs(e)), 1) AS mae FROM p GROUP BY GROUPING SETS ((model, h), (model, h, period))""", 1)
def a05(spark, d):
    return evaluate.kpi_tables(records(spark, d), SHOCK).drop("rmse_saar", "mae_saar")


BUCKET = "CASE WHEN target_ord - origin_ord <= 0 THEN '<=0' WHEN target_ord - origin_ord = 1 THEN '1' WHEN target_ord - origin_ord <= 3 THEN '2-3' ELSE '4-6' END"


@query("a06_realtime_metrics", V + PREDS + """
, m AS (SELECT model, h, count(e) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, sqrt(avg(CASE WHEN y_hat > 0 AND y_true > 0 THEN pow(ln(y_hat / y_true), 2) END)) AS rl FROM records GROUP BY 1, 2)
SELECT m.model, m.h, m.n, round(m.rmse, 2) AS rmse, round(m.mae, 2) AS mae, round(m.rl, 4) AS rmse_log, round(m.rmse / b.rmse, 4) AS rel_rmse FROM m LEFT JOIN m b ON b.model = 'naive_last' AND b.h = m.h""")
def a06(spark, d):
    m = evaluate.relative_metrics(records(spark, d), "naive_last")
    return m.withColumns({"rmse": F.round("rmse", 2), "mae": F.round("mae", 2)})


@query("a06_bucketed_metrics", V + PREDS + f"""
, r AS (SELECT model, h, {BUCKET} AS bucket, series_id, target_ord, avg(e) AS e FROM records GROUP BY 1, 2, 3, 4, 5),
m AS (SELECT model, h, bucket, count(e) AS n, sqrt(avg(e * e)) AS rmse FROM r GROUP BY 1, 2, 3)
SELECT m.model, m.h, m.bucket, m.n, round(m.rmse, 2) AS rmse, round(m.rmse / b.rmse, 4) AS rel_rmse FROM m LEFT JOIN m b ON b.model = 'mean' AND b.h = m.h AND b.bucket = m.bucket""")
def a06b(spark, d):
    from ..functions.scalars import release_bucket

    r = records(spark, d).withColumn("bucket", release_bucket(F.col("target_ord") - F.col("origin_ord")))
    return evaluate.relative_metrics(r, "mean", "bucket").select("model", "h", "bucket", "n", F.round("rmse", 2).alias("rmse"), "rel_rmse")


@query("a07_window_means", V + PREDS + "SELECT model, count(r) AS windows, round(avg(r), 2) AS rmse, round(avg(m), 2) AS mae FROM (SELECT model, series_id, origin_ord, sqrt(avg(e * e)) AS r, avg(abs(e)) AS m FROM records GROUP BY 1, 2, 3) GROUP BY 1", 2)
def a07(spark, d):
    return evaluate.window_means(records(spark, d))


@query("e04_win_rates", V + TASKS + "SELECT model, count(*) AS n_tasks, round(avg(CASE WHEN metric = best THEN 1.0 ELSE 0.0 END), 4) AS win_rate FROM (SELECT *, min(metric) OVER (PARTITION BY task) AS best FROM tasks) GROUP BY 1")
def e04(spark, d):
    return evaluate.win_rates(tasks(spark, d))


LB = TASKS + """
, wr AS (SELECT model, count(*) AS n_tasks, avg(CASE WHEN metric = best THEN 1.0 ELSE 0.0 END) AS win_rate FROM (SELECT *, min(metric) OVER (PARTITION BY task) AS best FROM tasks) GROUP BY 1),
mm AS (SELECT t.model, avg(t.metric) AS mean_metric, 1 - avg(t.metric) / avg(b.metric) AS skill FROM tasks t JOIN tasks b ON b.task = t.task AND b.model = 'seasonal_naive' GROUP BY 1),
lb AS (SELECT mm.model, mean_metric, skill, n_tasks, win_rate FROM mm JOIN wr USING (model))
"""


@query("e05_leaderboard", V + LB + "SELECT model, round(mean_metric, 2) AS mean_metric, round(skill, 4) AS skill, n_tasks, round(win_rate, 4) AS win_rate FROM lb")
def e05(spark, d):
    return evaluate.leaderboard(tasks(spark, d), "seasonal_naive").withColumn("mean_metric", F.round("mean_metric", 2))


@query("k02_top_models", V + LB + "SELECT model, round(skill, 4) AS skill FROM lb WHERE model <> 'naive_last' ORDER BY lb.skill DESC, model LIMIT 3")
def k02(spark, d):
    return evaluate.top_models(evaluate.leaderboard(tasks(spark, d), "seasonal_naive"), 3, exclude=["naive_last"]).select("model", "skill")


@query("e06_pairwise", V + TASKS + "SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, round(avg(CASE WHEN a.metric < b.metric THEN 1.0 WHEN a.metric = b.metric THEN 0.5 ELSE 0.0 END), 4) AS win_rate, round(avg(b.metric - a.metric), 2) AS mean_diff FROM tasks a JOIN tasks b ON a.task = b.task AND a.model <> b.model GROUP BY 1, 2")
def e06(spark, d):
    return evaluate.pairwise(tasks(spark, d)).withColumn("mean_diff", F.round("mean_diff", 2))


@query("r07_metric_matrix", V + TASKS + "SELECT task, model, round(metric, 2) AS metric FROM tasks", 2)
def r07(spark, d):
    return tasks(spark, d)


@query("m18_ensemble", V + PREDS + """
, w AS (SELECT * FROM (VALUES ('mean3', 'naive_last', 1.0), ('mean3', 'drift', 1.0), ('mean3', 'mean', 1.0), ('skill2', 'drift', 0.7), ('skill2', 'seasonal_naive', 0.3)) t(ensemble, model, weight))
SELECT ensemble AS model, series_id, origin_ord, h, round(sum(weight * y_hat) / sum(weight), 6) AS y_hat FROM preds JOIN w USING (model) GROUP BY 1, 2, 3, 4""", 6)
def m18(spark, d):
    w = spark.createDataFrame([("mean3", "naive_last", 1.0), ("mean3", "drift", 1.0), ("mean3", "mean", 1.0), ("skill2", "drift", 0.7), ("skill2", "seasonal_naive", 0.3)], "ensemble string, model string, weight double")
    return baselines.ensemble(forecasts(spark, d), w).select("model", "series_id", "origin_ord", "h", "y_hat")


@query("m19_growth_ensemble", V + KPI + """
, g AS (SELECT series_id, origin_ord, h, avg(g_hat) AS g, avg(level_before) AS lb FROM kpi WHERE model IN ('drift', 'mean_growth', 'rw_drift_log') GROUP BY 1, 2, 3)
SELECT series_id, origin_ord, h, round(g, 2) AS g_hat, round(CASE WHEN g > -100 THEN lb * pow(1 + g / 100, 0.25) END, 2) AS y_hat FROM g""", 2)
def m19(spark, d):
    return baselines.growth_ensemble(evaluate.level_kpi(records(spark, d)), ["drift", "mean_growth", "rw_drift_log"], "top3").select("series_id", "origin_ord", "h", "g_hat", "y_hat")


@query("v11_scoring_rows", V + KPI + REL + """
SELECT k.model, k.series_id, k.origin_ord, k.h, s.stage, """ + wide_sql("k.g_hat") + """ AS g_hat, round(s.value, 2) AS truth,
  (year(s.release_date) - 1970) * 12 + month(s.release_date) - 1 - (k.origin_ord * 3 + 2) AS months
FROM kpi k JOIN stages s ON s.series_id = k.series_id AND s.quarter_ord = k.target_ord WHERE k.model IN ('drift', 'naive_last')""", 2)
def v11(spark, d):
    k = evaluate.level_kpi(records(spark, d)).where("model IN ('drift', 'naive_last')")
    s = releases.stage_rows(releases.releases(views.versions(spark, d))).withColumnRenamed("quarter_ord", "target_ord")
    months = (F.year("release_date") - 1970) * 12 + F.month("release_date") - 1 - (F.col("origin_ord") * 3 + 2)
    return k.join(s, ["series_id", "target_ord"]).select("model", "series_id", "origin_ord", "h", "stage", wide(F.col("g_hat")).alias("g_hat"), F.col("value").alias("truth"), months.cast("long").alias("months"))


@query("j11_truth_check", V + PREDS + """
, t AS (SELECT series_id, quarter_ord, CASE WHEN quarter_ord = 110 THEN y + 1 ELSE y END AS y FROM qpanel WHERE quarter_ord <> 111)
SELECT count(*) AS n, round(max(abs(r.y_true - t.y)), 4) AS max_diff, round(avg(abs(r.y_true - t.y)), 4) AS mean_diff, CAST(sum(CASE WHEN t.y IS NULL OR abs(r.y_true - t.y) > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS bad
FROM records r LEFT JOIN t ON t.series_id = r.series_id AND t.quarter_ord = r.target_ord""")
def j11(spark, d):
    t = views.qpanel(spark, d).where("quarter_ord <> 111").withColumn("y", F.when(F.col("quarter_ord") == 110, F.col("y") + 1).otherwise(F.col("y")))
    return evaluate.truth_check(records(spark, d), t)


QEND = "CAST(last_day(make_date(1970 + CAST({0} AS BIGINT) // 4, (CAST({0} AS BIGINT) % 4) * 3 + 3, 1)) AS VARCHAR)"
EXF = f", exf AS (SELECT {QEND.format('target_ord')} AS date, {QEND.format('(origin_ord + 1)')} AS vintage_date, 'y_' || series_id AS variable, 'Q' AS frequency, h - 1 AS forecast_horizon, y_hat AS value, model AS source, 'levels' AS metric FROM records)"
EXO = REL + f", exq AS (SELECT *, (year(release_date) - 1970) * 4 + quarter(release_date) - 1 AS q FROM stages), exo AS (SELECT {QEND.format('quarter_ord')} AS date, {QEND.format('q')} AS vintage_date, 'y_' || series_id AS variable, 'Q' AS frequency, quarter_ord - q AS forecast_horizon, value, 'levels' AS metric FROM exq)"


@query("e09_exchange_forecasts", V + PREDS + EXF + "SELECT date, vintage_date, variable, frequency, forecast_horizon, CASE WHEN source IN ('naive_last', 'mean', 'drift', 'seasonal_naive') THEN round(value, 6) ELSE round(value, 2) END AS value, source, metric FROM exf", 6)
def e09(spark, d):
    return evaluate.exchange_forecasts(records(spark, d)).withColumn("value", places("value", "source"))


@query("e09_exchange_outturns", V + EXO + "SELECT date, vintage_date, variable, frequency, forecast_horizon, round(value, 2) AS value, metric FROM exo", 2)
def e09b(spark, d):
    return evaluate.exchange_outturns(releases.stage_rows(releases.releases(views.versions(spark, d))))


@query("e10_accuracy", V + PREDS + EXF + EXO + """
, k AS (SELECT *, dense_rank() OVER (PARTITION BY variable, date ORDER BY vintage_date) - 1 AS k FROM exo), t AS (SELECT variable, date, max(value) AS t FROM k WHERE k = 1 GROUP BY 1, 2)
SELECT source, forecast_horizon, count(*) AS n, round(avg(value - t), 2) AS bias, round(avg(abs(value - t)), 2) AS mae, round(sqrt(avg(pow(value - t, 2))), 2) AS rmse FROM exf JOIN t USING (variable, date) GROUP BY 1, 2""", 2)
def e10(spark, d):
    out = evaluate.exchange_outturns(releases.stage_rows(releases.releases(views.versions(spark, d))))
    return evaluate.accuracy(evaluate.exchange_forecasts(records(spark, d)), out, 1)


DIFF = PREDS + """
, dif AS (SELECT a.model, a.h, a.origin_ord, avg(b.e * b.e - a.e * a.e) / 1e12 AS d FROM records a JOIN records b ON b.model = 'naive_last' AND b.series_id = a.series_id AND b.origin_ord = a.origin_ord AND b.h = a.h WHERE a.model <> 'naive_last' GROUP BY 1, 2, 3)
"""


def _dm_sql(by: str, source: str) -> str:
    return f"""
, c AS (SELECT *, count(*) OVER g AS n, d - avg(d) OVER g AS c, avg(d) OVER g AS mean_d FROM {source} WINDOW g AS (PARTITION BY {by})),
s AS (SELECT *, c * c + 2 * (CASE WHEN h > 1 THEN coalesce(c * lag(c, 1) OVER w, 0) ELSE 0 END + CASE WHEN h > 2 THEN coalesce(c * lag(c, 2) OVER w, 0) ELSE 0 END + CASE WHEN h > 3 THEN coalesce(c * lag(c, 3) OVER w, 0) ELSE 0 END) AS s FROM c WINDOW w AS (PARTITION BY {by} ORDER BY origin_ord)),
m AS (SELECT {by}, max(n) AS n, max(mean_d) AS mean_d, avg(s) AS lrv FROM s GROUP BY ALL)
SELECT {by}, n, round(mean_d, 4) AS mean_d, round(CASE WHEN lrv > 0 AND n > 1 THEN mean_d / sqrt(lrv / n) * sqrt(greatest(0.0, (n + 1 - 2 * h + h * (h - 1) / n) / n)) END, 3) AS dm FROM m"""


def _differences(spark, d):
    return evaluate.loss_differences(records(spark, d), "naive_last").withColumn("d", F.col("d") / 1e12)


@query("e11_diebold_mariano", V + DIFF + _dm_sql("model, h", "dif"))
def e11(spark, d):
    return evaluate.diebold_mariano(_differences(spark, d), lags=HORIZON - 1).drop("p_value").withColumn("dm", F.round("dm", 3))


RUNS = """
, num AS (SELECT *, row_number() OVER (PARTITION BY model, h ORDER BY origin_ord) AS i, count(*) OVER (PARTITION BY model, h) AS cnt FROM dif),
roll AS (SELECT model, h, origin_ord, d, least(40, cnt - 1) AS width, unnest(range(greatest(i, least(40, cnt - 1)), least(cnt, i + least(40, cnt - 1) - 1) + 1)) AS window_end FROM num WHERE cnt > 1)"""


@query("e12_rolling_diebold_mariano", V + DIFF + RUNS + _dm_sql("model, h, window_end", "roll"))
def e12(spark, d):
    return evaluate.rolling_diebold_mariano(_differences(spark, d), lags=HORIZON - 1).drop("p_value").withColumn("dm", F.round("dm", 3))


@query("e13_fluctuation", V + DIFF + RUNS + """
, x AS (SELECT model, h, max(abs(m) * sqrt(width) / sd) AS s FROM (SELECT model, h, window_end, avg(d) AS m, max(width) AS width FROM roll GROUP BY 1, 2, 3) JOIN (SELECT model, h, nullif(stddev_pop(d), 0) AS sd FROM dif GROUP BY 1, 2) USING (model, h) GROUP BY 1, 2)
SELECT model, h, round(s, 3) AS max_stat, s > 2.77 AS rejects FROM x""", 3)
def e13(spark, d):
    return evaluate.fluctuation(_differences(spark, d))


@query("w09_moving_error", V + PREDS + "SELECT model, h, origin_ord, CASE WHEN model IN ('naive_last', 'mean', 'drift', 'seasonal_naive') THEN round(e, 6) ELSE round(e, 2) END AS error, CASE WHEN model IN ('naive_last', 'mean', 'drift', 'seasonal_naive') THEN round(avg(e) OVER (PARTITION BY model, h ORDER BY origin_ord ROWS 3 PRECEDING), 6) ELSE round(avg(e) OVER (PARTITION BY model, h ORDER BY origin_ord ROWS 3 PRECEDING), 2) END AS moving FROM (SELECT model, h, origin_ord, avg(e) AS e FROM records GROUP BY 1, 2, 3)", 6)
def w09(spark, d):
    return rounded(rounded(evaluate.moving_error(records(spark, d)), "error"), "moving")


@query("r08_hedgehog", V + PREDS + """
, p AS (SELECT model, series_id, origin_ord, target_ord AS quarter_ord, y_hat AS value FROM records UNION ALL SELECT model, series_id, origin_ord, origin_ord, max(last_y) FROM records GROUP BY 1, 2, 3)
SELECT p.model, p.series_id, p.origin_ord, p.quarter_ord, CASE WHEN p.model IN ('naive_last', 'mean', 'drift', 'seasonal_naive') THEN round(p.value, 6) ELSE round(p.value, 2) END AS value, round(q.y, 2) AS actual FROM p LEFT JOIN qpanel q ON q.series_id = p.series_id AND q.quarter_ord = p.quarter_ord""", 6)
def r08b(spark, d):
    return rounded(evaluate.hedgehog(records(spark, d), views.qpanel(spark, d)), "value")


@query("r08_error_histogram", V + PREDS + "SELECT model, CAST(CASE WHEN r < -0.5 THEN 0 WHEN r >= 0.5 THEN 11 ELSE floor((r + 0.5) / 1.0 * 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM (SELECT model, e / y_true AS r FROM records WHERE y_true <> 0) GROUP BY 1, 2")
def r08(spark, d):
    return evaluate.error_histogram(records(spark, d), -0.5, 0.5, 10)


TIMES = ", tm AS (SELECT event_type AS model, user_id % 7 AS windows, value AS prep_s, value * 2 AS infer_s, CASE WHEN event_id % 10 <> 0 THEN value END AS metric, user_id % 3 = 0 AS overlap FROM events)"


def _times(spark, d):
    e = views.table(spark, d, "events")
    return e.select(F.col("event_type").alias("model"), (F.col("user_id") % 7).alias("windows"), F.col("value").alias("prep_s"), (F.col("value") * 2).alias("infer_s"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("metric"), (F.col("user_id") % 3 == 0).alias("overlap"))


@query("a08_timing_report", V + TIMES + "SELECT model, max(windows) AS windows, round(avg(prep_s), 2) AS prep_s, round(sum(infer_s), 2) AS infer_s, round(sum(infer_s) / max(windows), 2) AS per_window_s FROM tm GROUP BY 1 ORDER BY sum(infer_s) DESC, 1 LIMIT 10", 2)
def a08(spark, d):
    return evaluate.timing_report(_times(spark, d))


@query("a09_runtime_medians", V + TIMES + "SELECT model, round(quantile_cont(prep_s, 0.5), 3) AS prep_s, round(quantile_cont(infer_s, 0.5), 3) AS infer_s, round(avg(CAST(overlap AS INT)), 3) AS overlap, CAST(sum(CAST(metric IS NULL AS INT)) AS BIGINT) AS failed FROM tm GROUP BY 1", 3)
def a09(spark, d):
    return evaluate.runtime_medians(_times(spark, d))


@query("a10_calibration", V + """
, t AS (SELECT quarter_ord, y AS t FROM qpanel WHERE series_id = 'N1'), b AS (SELECT series_id, y AS value, t, t / y AS r FROM qpanel JOIN t USING (quarter_ord) WHERE y <> 0 AND t <> 0),
m AS (SELECT series_id, quantile_cont(r, 0.5) AS r, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 8),
x AS (SELECT b.series_id, max(m.r) AS r, max(n) AS n, quantile_cont(abs((value - t) / t), 0.5) AS e1, quantile_cont(abs((m.r * value - t) / t), 0.5) AS er FROM b JOIN m ON m.series_id = b.series_id GROUP BY 1)
SELECT series_id, round(CASE WHEN er < e1 THEN r ELSE 1.0 END, 4) AS scale, round(least(e1, er), 4) AS error, n FROM x""")
def a10(spark, d):
    q = views.qpanel(spark, d).withColumnRenamed("y", "value")
    return evaluate.calibration(q.select("series_id", "quarter_ord", "value"), q.where("series_id = 'N1'").select("quarter_ord", "value"), ["quarter_ord"])


@query("a11_covariate_diagnostics", V + """
, m AS (SELECT variable, quantile_cont(x, 0.5) AS med, count(x) AS n, stddev_pop(x) AS sd, arg_max(x, month_date) AS l, avg(CASE WHEN month_date >= DATE '2001-01-01' THEN CAST(x IS NULL AS INT) END) AS tail FROM mpanel GROUP BY 1),
d AS (SELECT variable, quantile_cont(abs(x - med), 0.5) AS mad FROM mpanel JOIN m USING (variable) GROUP BY 1),
z AS (SELECT variable, tail, abs(l - med) / CASE WHEN mad > 1e-9 THEN mad ELSE sd END AS z FROM m JOIN d USING (variable) WHERE n >= 20)
SELECT variable, round(tail, 4) AS tail_missing, round(z, 4) AS robust_z, coalesce(z >= 8, false) AS suspect FROM z ORDER BY z DESC NULLS LAST, variable LIMIT 10""")
def a11(spark, d):
    return evaluate.covariate_diagnostics(views.mpanel(spark, d), F.col("month_date") >= F.lit("2001-01-01").cast("date"))


@query("w05_last_before_release", V + PREDS + REL + """
, c AS (SELECT p.model, p.series_id, p.target_ord, p.origin_ord, p.y_hat, row_number() OVER (PARTITION BY p.model, p.series_id, p.target_ord ORDER BY p.origin_ord DESC) AS r
  FROM preds p JOIN rel ON rel.series_id = p.series_id AND rel.quarter_ord = p.target_ord WHERE make_date(1970 + p.origin_ord // 4, (p.origin_ord % 4) * 3 + 3, 1) < first_date)
SELECT model, series_id, target_ord, origin_ord, CASE WHEN model IN ('naive_last', 'mean', 'drift', 'seasonal_naive') THEN round(y_hat, 6) ELSE round(y_hat, 2) END AS y_hat FROM c WHERE r = 1""", 6)
def w05(spark, d):
    from ..functions.scalars import quarter_start
    from ..operators import ingest

    rel = releases.releases(views.versions(spark, d)).select("series_id", F.col("quarter_ord").alias("target_ord"), "first_date")
    f = forecasts(spark, d).join(rel, ["series_id", "target_ord"]).where(F.add_months(quarter_start(F.col("origin_ord")), 2) < F.col("first_date"))
    return ingest.keep_last(rounded(f), ["model", "series_id", "target_ord"], ["origin_ord"]).select("model", "series_id", "target_ord", "origin_ord", "y_hat")


@query("k04_last_origins", V + PREDS + "SELECT DISTINCT series_id, origin_ord FROM (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY origin_ord DESC) AS r FROM preds) WHERE r <= 3")
def k04(spark, d):
    from pyspark.sql import Window

    r = F.dense_rank().over(Window.partitionBy("series_id").orderBy(F.desc("origin_ord")))
    return forecasts(spark, d).select("series_id", "origin_ord").distinct().withColumn("r", r).where("r <= 3").drop("r")


DRAWS = """
, best AS (SELECT *, min(metric) OVER (PARTITION BY task) AS best FROM tasks),
stat AS (SELECT 'mean' AS statistic, model, '' AS other, task, metric AS num, 1.0::DOUBLE AS den FROM tasks UNION ALL SELECT 'win_rate', model, '', task, CASE WHEN metric = best THEN 1.0 ELSE 0.0 END, 1.0 FROM best
  UNION ALL SELECT 'skill', t.model, '', t.task, t.metric, b.metric FROM tasks t JOIN tasks b ON b.task = t.task AND b.model = 'seasonal_naive' UNION ALL SELECT 'difference', t.model, b.model, t.task, b.metric - t.metric, 1.0 FROM tasks t JOIN tasks b ON b.task = t.task AND b.model <> t.model),
placed AS (SELECT *, row_number() OVER (PARTITION BY statistic, model, other ORDER BY task) - 1 AS i, count(*) OVER (PARTITION BY statistic, model, other) AS n FROM stat),
times AS (SELECT n, b, ('0x' || substr(md5('0|' || b || '|' || j), 1, 8))::BIGINT % n AS i, count(*) AS times FROM (SELECT n, b, unnest(range(1, n + 1)) AS j FROM (SELECT DISTINCT n FROM placed), (SELECT unnest(range(1, 2001)) AS b)) GROUP BY 1, 2, 3),
drawn AS (SELECT statistic, model, other, b, sum(times * num) / sum(times * den) AS r FROM placed JOIN times USING (n, i) GROUP BY 1, 2, 3, 4),
whole AS (SELECT statistic, model, other, sum(num) / sum(den) AS r FROM placed GROUP BY 1, 2, 3),
ends AS (SELECT statistic, model, other, quantile_cont(CASE WHEN statistic = 'skill' THEN 1 - r ELSE r END, 0.025) AS low, quantile_cont(CASE WHEN statistic = 'skill' THEN 1 - r ELSE r END, 0.975) AS high FROM drawn GROUP BY 1, 2, 3)
SELECT statistic, model, other, round(CASE WHEN statistic = 'skill' THEN 1 - r ELSE r END, 3) + 0.0 AS value, round(low, 3) + 0.0 AS low, round(high, 3) + 0.0 AS high FROM whole JOIN ends USING (statistic, model, other)"""


@query("e07_bootstrap_intervals", V + TASKS + DRAWS, 3)
def e07(spark, d):
    return evaluate.bootstrap(tasks(spark, d), "seasonal_naive")


@query("k02_models_over_threshold", V + LB + "SELECT model, round(skill, 4) AS skill FROM lb WHERE skill > 0.0 AND model <> 'naive_last' ORDER BY lb.skill DESC, model LIMIT 5")
def k02b(spark, d):
    return evaluate.top_models(evaluate.leaderboard(tasks(spark, d), "seasonal_naive"), 5, exclude=["naive_last"], over=0.0).select("model", "skill")


@query("e10_accuracy_same_dates", V + PREDS + EXF + EXO + """
, late AS (SELECT * FROM exf WHERE source <> 'mean' OR date >= '1999-01-01'), span AS (SELECT variable, forecast_horizon, max(lo) AS lo, min(hi) AS hi FROM (SELECT variable, forecast_horizon, source, min(date) AS lo, max(date) AS hi FROM late GROUP BY 1, 2, 3) GROUP BY 1, 2),
k AS (SELECT *, dense_rank() OVER (PARTITION BY variable, date ORDER BY vintage_date) - 1 AS k FROM exo), t AS (SELECT variable, date, max(value) AS t FROM k WHERE k = 1 GROUP BY 1, 2)
SELECT source, forecast_horizon, count(*) AS n, round(avg(value - t), 2) AS bias, round(avg(abs(value - t)), 2) AS mae, round(sqrt(avg(pow(value - t, 2))), 2) AS rmse FROM late JOIN span USING (variable, forecast_horizon) JOIN t USING (variable, date) WHERE date BETWEEN lo AND hi GROUP BY 1, 2""", 2)
def e10b(spark, d):
    """One source begins later than the others, which are cut to its range."""
    out = evaluate.exchange_outturns(releases.stage_rows(releases.releases(views.versions(spark, d))))
    late = evaluate.exchange_forecasts(records(spark, d)).where("source <> 'mean' OR date >= date'1999-01-01'")
    return evaluate.accuracy(late, out, 1, same_dates=True)


@query("e11_dm_p_values")
def e11p(spark, d):
    return evaluate.diebold_mariano(_differences(spark, d))
