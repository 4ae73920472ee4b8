"""Queries of as-of snapshots, vintage selection, ingest, releases, origins and features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, evaluate, features, ingest, releases
from . import views
from .catalog import query, wide, wide_sql
from .views import VIEWS_SQL as V

DAY = "1999-06-30"
SERIES = [f"N{i}" for i in range(25)]
NAMES = ", ".join(f"'{s}'" for s in SERIES)
SNAP = f"""
, gaps AS (SELECT series_id, obs_date, asof_date, CASE WHEN (year(asof_date) * 12 + month(asof_date)) % 7 <> 0 THEN value END AS value FROM versions),
snap AS (SELECT series_id, obs_date, arg_max(value, asof_date) AS value, max(asof_date) AS asof_used FROM gaps WHERE asof_date <= DATE '{DAY}' GROUP BY 1, 2)
"""


def _gaps(spark, d):
    return views.versions(spark, d).withColumn("value", F.when((F.year("asof_date") * 12 + F.month("asof_date")) % 7 != 0, F.col("value")))


@query("j01_asof_snapshot_long", V + SNAP + "SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, round(value, 4) AS value, CAST(asof_used AS VARCHAR) AS asof_used FROM snap")
def j01(spark, d):
    return asof.snapshot_long(_gaps(spark, d), DAY)


@query("r01_snapshot_wide", V + f"""
SELECT CAST(obs_date AS VARCHAR) AS obs_date, {', '.join(f"round(max(CASE WHEN series_id = '{s}' THEN value END), 4) AS {s}" for s in SERIES)} FROM
(SELECT series_id, obs_date, arg_max(value, asof_date) AS value FROM versions WHERE asof_date <= DATE '{DAY}' AND series_id IN ({NAMES}) GROUP BY 1, 2) GROUP BY 1""")
def r01(spark, d):
    return asof.snapshot_wide(views.versions(spark, d), DAY, SERIES)


CUTS = "(SELECT unnest([DATE '1996-03-15', DATE '1997-12-31', DATE '1999-06-30', DATE '2000-02-29', DATE '2005-01-01']) AS cutoff)"


def _cuts(spark):
    return spark.createDataFrame([("1996-03-15",), ("1997-12-31",), ("1999-06-30",), ("2000-02-29",), ("2005-01-01",)], "cutoff string")


@query("j02_batched_snapshots", V + SNAP + f"SELECT CAST(cutoff AS VARCHAR) AS cutoff, series_id, CAST(obs_date AS VARCHAR) AS obs_date, round(arg_max(value, asof_date), 4) AS value, CAST(max(asof_date) AS VARCHAR) AS asof_used FROM gaps, {CUTS} WHERE asof_date <= cutoff GROUP BY 1, 2, 3")
def j02(spark, d):
    return asof.snapshots(_gaps(spark, d), _cuts(spark))


ORIGINS = "o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS origin FROM orders), days AS (SELECT DISTINCT asof_date FROM versions)"


def _origins(spark, d):
    days = views.versions(spark, d).select("asof_date").distinct()
    return views.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("origin")).distinct(), days


@query("j03_vintage_backward", V + f", {ORIGINS} SELECT CAST(origin AS VARCHAR) AS origin, CAST((SELECT max(asof_date) FROM days WHERE asof_date <= origin) AS VARCHAR) AS vintage_date FROM o")
def j03(spark, d):
    return asof.select_vintage(*_origins(spark, d))


@query("j03_vintage_calendar", V + "SELECT strftime(asof_date, '%Y-%m') AS vintage, CAST(asof_date AS VARCHAR) AS asof_date, CAST(lead(asof_date) OVER (ORDER BY asof_date) AS VARCHAR) AS next_asof_date FROM (SELECT DISTINCT asof_date FROM versions)")
def j03b(spark, d):
    return asof.calendar(views.versions(spark, d).select(F.date_format("asof_date", "yyyy-MM").alias("vintage"), "asof_date"))


@query("j04_vintage_forward", V + f", {ORIGINS} SELECT CAST(origin AS VARCHAR) AS origin, CAST((SELECT min(asof_date) FROM days WHERE asof_date >= origin) AS VARCHAR) AS vintage_date FROM o")
def j04(spark, d):
    return asof.select_vintage(*_origins(spark, d), direction="forward")


@query("j05_vintage_with_fallback", V + f", {ORIGINS} SELECT CAST(origin AS VARCHAR) AS origin, CAST(coalesce((SELECT max(asof_date) FROM days WHERE asof_date <= origin), (SELECT min(asof_date) FROM days)) AS VARCHAR) AS vintage_date, (SELECT max(asof_date) FROM days WHERE asof_date <= origin) IS NULL AS used_fallback FROM o")
def j05(spark, d):
    return asof.select_vintage(*_origins(spark, d), fallback=True)


@query("j03_asof_join", V + """
, o AS (SELECT o_orderkey, 'N' || c_nationkey AS series_id, CAST(o_orderdate AS DATE) AS origin FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT series_id, asof_date, sum(cents) AS c FROM monthly GROUP BY 1, 2)
SELECT o_orderkey, CAST(asof_date AS VARCHAR) AS matched_ts, CAST(c AS BIGINT) AS matched FROM o ASOF LEFT JOIN m ON o.series_id = m.series_id AND o.origin >= m.asof_date""")
def j03c(spark, d):
    customers = views.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("series_id"))
    o = views.table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "series_id", F.to_date("o_orderdate").alias("origin"))
    v = views.versions(spark, d)
    w = Window.partitionBy("series_id", "obs_date").orderBy("asof_date")
    cents = F.round((F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0))) * 100).cast("long")
    m = v.withColumn("c", cents).groupBy("series_id", "asof_date").agg(F.sum("c").alias("c"))
    return asof.asof_join(o, m, ["series_id"], "origin", "asof_date", "c").select("o_orderkey", "matched_ts", "matched")


VP = """
, cuts AS (SELECT DISTINCT asof_date AS vintage_date FROM versions),
vp AS (SELECT vintage_date, series_id, (year(obs_date) - 1970) * 4 + quarter(obs_date) - 1 AS quarter_ord, arg_max(value, asof_date) AS value FROM versions, cuts WHERE asof_date <= vintage_date GROUP BY 1, 2, 3)
"""


def _vp(spark, d):
    v = views.versions(spark, d)
    p = asof.snapshots(v, v.select(F.col("asof_date").alias("cutoff")).distinct())
    return p.select(F.col("cutoff").alias("vintage_date"), "series_id", S.quarter_ord(F.col("obs_date")).alias("quarter_ord"), "value")


@query("s05_vintage_panel", V + VP + "SELECT CAST(vintage_date AS VARCHAR) AS vintage_date, series_id, quarter_ord, round(value, 4) AS value FROM vp")
def s05(spark, d):
    return ingest.keep_last(_vp(spark, d), ["vintage_date", "series_id", "quarter_ord"], ["value"])


@query("j06_same_vintage_growth", V + VP + """
SELECT CAST(a.vintage_date AS VARCHAR) AS vintage_date, a.series_id, a.quarter_ord, round(a.value, 4) AS level, round(b.value, 4) AS level_before
FROM vp a LEFT JOIN vp b ON a.vintage_date = b.vintage_date AND a.series_id = b.series_id AND b.quarter_ord = a.quarter_ord - 1""")
def j06(spark, d):
    p = _vp(spark, d)
    return asof.same_vintage_growth(p, p.select("series_id", "vintage_date", "quarter_ord"))


@query("j07_asof_overlay", V + SNAP + """
SELECT q.series_id, q.quarter_ord, round(coalesce(s.value, q.y), 4) AS y, s.value IS NOT NULL AND s.value IS DISTINCT FROM q.y AS changed
FROM qpanel q LEFT JOIN snap s ON q.series_id = s.series_id AND q.obs_date = s.obs_date""")
def j07(spark, d):
    base = views.qpanel(spark, d).select("series_id", "quarter_ord", "obs_date", "y")
    return asof.overlay(base, asof.snapshot_long(_gaps(spark, d), DAY), ["series_id", "obs_date"], "y").select("series_id", "quarter_ord", "y", "changed")


WIN = f"""
, nq AS (SELECT series_id, quarter_ord, obs_date, y, row_number() OVER (PARTITION BY series_id ORDER BY quarter_ord) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM qpanel),
win AS (SELECT series_id, i - n + 2 + 6 - 1 AS window_idx, quarter_ord AS cutoff_ts FROM nq WHERE i - n + 2 + 6 - 1 BETWEEN 0 AND 5)
"""


def _windows(spark, d):
    q = views.qpanel(spark, d)
    return q, releases.rolling_windows(q, 6, 2, ["series_id"], "quarter_ord")


@query("v10_rolling_windows", V + WIN + "SELECT series_id, window_idx, cutoff_ts FROM win")
def v10(spark, d):
    return _windows(spark, d)[1]


@query("w08_usable_windows", V + WIN + "SELECT series_id, max(window_idx) - coalesce(max(CASE WHEN (cutoff_ts + CAST(substr(series_id, 2) AS INT)) % 4 = 0 THEN window_idx END), -1) AS usable FROM win GROUP BY 1")
def w08(spark, d):
    k = F.regexp_extract("series_id", "([0-9]+)", 1).cast("int")
    return releases.usable_windows(_windows(spark, d)[1].withColumn("ok", (F.col("cutoff_ts") + k) % 4 != 0), ["series_id"])


@query("j08_window_history_swap", V + VP + WIN + """
, wv AS (SELECT series_id, window_idx, cutoff_ts, (SELECT max(vintage_date) FROM cuts WHERE vintage_date <= make_date(1970 + (cutoff_ts // 4), (cutoff_ts % 4) * 3 + 1, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY) AS vintage_date FROM win)
SELECT wv.series_id, window_idx, q.quarter_ord, round(coalesce(vp.value, q.y), 4) AS y FROM wv JOIN qpanel q ON q.series_id = wv.series_id AND q.quarter_ord <= cutoff_ts
LEFT JOIN vp ON vp.series_id = wv.series_id AND vp.vintage_date = wv.vintage_date AND vp.quarter_ord = q.quarter_ord""")
def j08(spark, d):
    q, w = _windows(spark, d)
    v = views.versions(spark, d)
    dated = asof.select_vintage(w.withColumn("origin", S.quarter_end(F.col("cutoff_ts"))), v.select("asof_date"))
    p = asof.snapshots(v, dated.select(F.col("vintage_date").alias("cutoff")))
    p = p.select(F.col("cutoff").alias("vintage_date"), "series_id", S.quarter_ord(F.col("obs_date")).alias("quarter_ord"), "value")
    rows = dated.join(q.select("series_id", "quarter_ord", "y"), "series_id").where("quarter_ord <= cutoff_ts")
    return asof.swap_history(rows, p).select("series_id", "window_idx", "quarter_ord", "y")


@query("j09_covariates_by_quarter", V + """
, h AS (SELECT variable, month_date, CASE WHEN month(month_date) % 5 <> 0 THEN x END AS x FROM mpanel)
SELECT variable, (year(month_date) - 1970) * 4 + quarter(month_date) - 1 AS quarter_ord, arg_max(x, month_date) AS x FROM h GROUP BY 1, 2""")
def j09(spark, d):
    m = views.mpanel(spark, d).withColumn("x", F.when(F.month("month_date") % 5 != 0, F.col("x")))
    return asof.quarterly_last(m, ["variable"], "month_date", ["x"])


REL = """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, obs_date ORDER BY asof_date) AS n FROM versions),
rel AS (SELECT series_id, obs_date, (year(obs_date) - 1970) * 4 + quarter(obs_date) - 1 AS quarter_ord,
  max(CASE WHEN n = 1 THEN value END) AS first_release, max(CASE WHEN n = 1 THEN asof_date END) AS first_date, max(CASE WHEN n = 2 THEN value END) AS second_release, max(CASE WHEN n = 2 THEN asof_date END) AS second_date,
  max(CASE WHEN n = 3 THEN value END) AS third_release, max(CASE WHEN n = 3 THEN asof_date END) AS third_date, arg_max(value, asof_date) AS latest_release, max(asof_date) AS latest_date FROM ranked GROUP BY 1, 2),
stages AS (SELECT series_id, quarter_ord, obs_date, 'first' AS stage, first_release AS value, first_date AS release_date FROM rel UNION ALL SELECT series_id, quarter_ord, obs_date, 'second', second_release, second_date FROM rel WHERE second_release IS NOT NULL
  UNION ALL SELECT series_id, quarter_ord, obs_date, 'third', third_release, third_date FROM rel WHERE third_release IS NOT NULL UNION ALL SELECT series_id, quarter_ord, obs_date, 'latest', latest_release, latest_date FROM rel),
growth AS (SELECT s.*, v.value AS level_before, CASE WHEN s.value > 0 AND v.value > 0 THEN 100 * (pow(s.value / v.value, 4) - 1) END AS saar
  FROM stages s LEFT JOIN versions v ON v.series_id = s.series_id AND v.asof_date = s.release_date AND (year(v.obs_date) - 1970) * 4 + quarter(v.obs_date) = s.quarter_ord)
"""


def _rel(spark, d):
    return releases.releases(views.versions(spark, d))


@query("v01_releases", V + REL + "SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, quarter_ord, " + ", ".join(f"round({s}_release, 4) AS {s}_release, CAST({s}_date AS VARCHAR) AS {s}_date" for s in releases.STAGES) + " FROM rel")
def v01(spark, d):
    return _rel(spark, d)


@query("r06_stage_rows", V + REL + "SELECT series_id, quarter_ord, CAST(obs_date AS VARCHAR) AS obs_date, stage, round(value, 4) AS value, CAST(release_date AS VARCHAR) AS release_date FROM stages")
def r06(spark, d):
    return releases.stage_rows(_rel(spark, d))


@query("r06_stage_columns", V + REL + "SELECT series_id, quarter_ord, CAST(obs_date AS VARCHAR) AS obs_date, " + ", ".join(f"round({s}_release, 4) AS {s}_release, CAST({s}_date AS VARCHAR) AS {s}_date" for s in releases.STAGES) + " FROM rel")
def r06b(spark, d):
    return releases.stage_columns(releases.stage_rows(_rel(spark, d)))


@query("v02_same_release_growth", V + REL + "SELECT series_id, quarter_ord, CAST(obs_date AS VARCHAR) AS obs_date, stage, round(value, 2) AS value, CAST(release_date AS VARCHAR) AS release_date, round(level_before, 2) AS level_before, " + wide_sql("saar") + " AS saar FROM growth", 2)
def v02(spark, d):
    return releases.same_release_growth(views.versions(spark, d)).withColumn("saar", wide(F.col("saar")))


@query("v03_panel_growth", V + REL + VP + """
, pick AS (SELECT g.series_id, g.quarter_ord, stage, g.value, (SELECT min(vintage_date) FROM cuts WHERE vintage_date >= release_date) AS vintage_date FROM stages g)
SELECT p.series_id, p.quarter_ord, stage, CAST(p.vintage_date AS VARCHAR) AS vintage_date, round(a.value, 2) AS level, round(b.value, 2) AS level_before, round(a.value / p.value, 4) AS ratio
FROM pick p LEFT JOIN vp a ON a.series_id = p.series_id AND a.vintage_date = p.vintage_date AND a.quarter_ord = p.quarter_ord LEFT JOIN vp b ON b.series_id = p.series_id AND b.vintage_date = p.vintage_date AND b.quarter_ord = p.quarter_ord - 1""", 4)
def v03(spark, d):
    rows = releases.stage_rows(_rel(spark, d))
    p = _vp(spark, d)
    days = views.versions(spark, d).select("asof_date").distinct()
    picked = asof.select_vintage(rows, days, "release_date", "forward")
    g = asof.same_vintage_growth(p, picked)
    return g.select("series_id", "quarter_ord", "stage", "vintage_date", F.round("level", 2).alias("level"), F.round("level_before", 2).alias("level_before"), (F.col("level") / F.col("value")).alias("ratio"))


@query("v04_latest_growth_and_lags", V + REL + """
SELECT series_id, quarter_ord, round(latest_prev, 2) AS latest_prev, round(CASE WHEN latest_release > 0 AND latest_prev > 0 THEN 100 * (pow(latest_release / latest_prev, 4) - 1) END, 2) AS latest_saar,
  datediff('day', e, first_date) AS first_lag_days, datediff('day', e, second_date) AS second_lag_days, datediff('day', e, third_date) AS third_lag_days
FROM (SELECT *, lag(latest_release) OVER (PARTITION BY series_id ORDER BY obs_date) AS latest_prev, last_day(obs_date + INTERVAL 2 MONTH) AS e FROM rel)""", 2)
def v04(spark, d):
    return releases.latest_growth(_rel(spark, d)).select("series_id", "quarter_ord", "latest_prev", "latest_saar", "first_lag_days", "second_lag_days", "third_lag_days")


@query("v05_validation_flags", V + REL + """
, g1 AS (SELECT *, value * (1 + (quarter_ord % 5 - 2) * 0.011) AS panel_level, lag(saar) OVER (PARTITION BY series_id, stage ORDER BY quarter_ord) AS s1, quarter_ord IN (113, 114) OR quarter_ord - 1 IN (113, 114) AS shock FROM growth),
f AS (SELECT series_id, quarter_ord, stage, 'growth' AS flag FROM g1 WHERE NOT shock AND abs(saar) > 400 UNION ALL SELECT series_id, quarter_ord, stage, 'change' FROM g1 WHERE NOT shock AND quarter_ord >= 104 AND abs(saar - s1) > 300
  UNION ALL SELECT series_id, quarter_ord, stage, 'ratio' FROM g1 WHERE quarter_ord >= 108 AND NOT panel_level / value BETWEEN 0.98 AND 1.02 UNION ALL SELECT series_id, quarter_ord, stage, 'missing' FROM g1 WHERE level_before IS NULL)
SELECT * FROM f""")
def v05(spark, d):
    g = releases.same_release_growth(views.versions(spark, d)).withColumn("panel_level", F.col("value") * (1 + (F.col("quarter_ord") % 5 - 2) * F.lit(0.011)))
    return releases.validation_flags(g, [113, 114], 108, 104, 400.0, 300.0)


@query("v06_release_export", V + REL + "SELECT series_id, quarter_ord, stage, CAST(release_date AS VARCHAR) AS release_date, " + wide_sql("saar") + " AS saar, round(level_before, 2) AS level_before FROM growth", 2)
def v06(spark, d):
    return releases.export(releases.same_release_growth(views.versions(spark, d))).withColumn("saar", wide(F.col("saar")))


@query("s12_valid_origins", V + REL + "SELECT series_id, quarter_ord, datediff('day', obs_date, first_date) AS lag_days, coalesce(first_release IS NOT NULL AND datediff('day', obs_date, first_date) BETWEEN 60 AND 200, false) AS valid_origin FROM rel")
def s12(spark, d):
    return releases.valid_origins(_rel(spark, d)).select("series_id", "quarter_ord", "lag_days", "valid_origin")


@query("v07_quarterly_origins", V + REL + "SELECT series_id, quarter_ord AS target_ord, quarter_ord - 1 AS observed_ord, CAST(first_date - 1 AS VARCHAR) AS origin FROM rel")
def v07(spark, d):
    return releases.quarterly_origins(_rel(spark, d))


@query("v08_monthly_origins", V + VP + "SELECT series_id, CAST(vintage_date AS VARCHAR) AS vintage_date, max(quarter_ord) AS observed_ord FROM vp GROUP BY 1, 2")
def v08(spark, d):
    return releases.monthly_origins(_vp(spark, d))


@query("v09_training_sets", V + VP + """
, o AS (SELECT series_id, vintage_date, max(quarter_ord) - 2 AS observed_ord FROM vp GROUP BY 1, 2),
t AS (SELECT o.series_id, o.vintage_date, observed_ord, p.quarter_ord, CASE WHEN p.quarter_ord <= observed_ord THEN value END AS value FROM o JOIN vp p ON o.series_id = p.series_id AND o.vintage_date = p.vintage_date WHERE p.quarter_ord <= observed_ord + 1)
SELECT series_id, CAST(vintage_date AS VARCHAR) AS vintage_date, observed_ord, quarter_ord, round(value, 4) AS value, n_train FROM (SELECT *, count(value) OVER (PARTITION BY series_id, vintage_date, observed_ord) AS n_train FROM t) WHERE n_train >= 8""")
def v09(spark, d):
    p = _vp(spark, d)
    o = releases.monthly_origins(p).withColumn("observed_ord", F.col("observed_ord") - 2)
    return releases.training_sets(o, p, 1, 8)


@query("j10_truth_overlay", V + REL + "SELECT r.series_id, r.quarter_ord, round(ln(third_release), 4) AS y FROM rel r JOIN qpanel q ON q.series_id = r.series_id AND q.quarter_ord = r.quarter_ord WHERE third_release > 0")
def j10(spark, d):
    return releases.truth_overlay(views.qpanel(spark, d).select("series_id", "quarter_ord", "y"), _rel(spark, d), "third", "log_level")


@query("w03_growth_delta", V + REL + "SELECT series_id, quarter_ord, stage, " + wide_sql("dd") + " AS delta FROM (SELECT *, saar - lag(saar) OVER (PARTITION BY series_id, stage ORDER BY quarter_ord) AS dd FROM growth)", 2)
def w03(spark, d):
    w = Window.partitionBy("series_id", "stage").orderBy("quarter_ord")
    x = F.col("saar") - F.lag("saar").over(w)
    return releases.same_release_growth(views.versions(spark, d)).select("series_id", "quarter_ord", "stage", wide(x).alias("delta"))


@query("k03_worst_offenders", V + REL + "SELECT series_id, quarter_ord, round(dl, 2) AS revision FROM (SELECT series_id, quarter_ord, latest_release - first_release AS dl FROM rel) ORDER BY abs(dl) DESC, series_id, quarter_ord LIMIT 5", 2)
def k03(spark, d):
    r = _rel(spark, d).select("series_id", "quarter_ord", (F.col("latest_release") - F.col("first_release")).alias("revision"))
    return evaluate.worst(r, ["series_id", "quarter_ord"], "revision")


INGEST = """
, stored AS (SELECT series_id, obs_date, asof_date, value FROM versions WHERE month(asof_date) % 2 = 0),
batch AS (SELECT series_id, obs_date, asof_date, value * 10 AS value, 1 AS arrival FROM versions UNION ALL SELECT series_id, obs_date, asof_date, value * 3, 2 FROM versions WHERE month(asof_date) % 3 = 0),
clean AS (SELECT series_id, obs_date, asof_date, arg_max(value, arrival) AS value FROM batch GROUP BY 1, 2, 3),
after AS (SELECT * FROM stored UNION ALL SELECT c.* FROM clean c ANTI JOIN stored s ON c.series_id = s.series_id AND c.obs_date = s.obs_date AND c.asof_date = s.asof_date)
"""


def _ingested(spark, d):
    v = views.versions(spark, d)
    batch = v.withColumns({"value": F.col("value") * 10, "arrival": F.lit(1)}).unionByName(v.where("month(asof_date) % 3 = 0").withColumns({"value": F.col("value") * 3, "arrival": F.lit(2)}))
    return ingest.ingest(v.where("month(asof_date) % 2 = 0"), batch)


@query("s06_version_ingest", V + INGEST + "SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, CAST(asof_date AS VARCHAR) AS asof_date, round(value, 4) AS value FROM after")
def s06(spark, d):
    return _ingested(spark, d).drop("arrival")


@query("a03_high_water", V + INGEST + "SELECT series_id, CAST(max(asof_date) AS VARCHAR) AS max_asof FROM after GROUP BY 1")
def a03(spark, d):
    return asof.high_water(_ingested(spark, d))


@query("s07_alias_upsert", "SELECT user_id, event_type, round(arg_max(value, event_id), 4) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def s07(spark, d):
    return ingest.upsert_latest(views.table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@query("a01_quarterly_mean", V + "SELECT variable, (year(month_date) - 1970) * 4 + quarter(month_date) - 1 AS quarter_ord, round(avg(x), 4) AS x, count(x) AS n FROM mpanel GROUP BY 1, 2")
def a01(spark, d):
    return asof.quarterly_mean(views.mpanel(spark, d), ["variable"], "month_date", "x")


@query("a02_asof_dates", V + f"SELECT DISTINCT CAST(asof_date AS VARCHAR) AS asof_date FROM versions WHERE series_id IN ({NAMES}) AND asof_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
def a02(spark, d):
    return asof.asof_dates(views.versions(spark, d), SERIES, "1997-01-01", "1999-12-31")


@query("a12_panel_statistics", V + VP + "SELECT count(*) AS n_rows, count(DISTINCT vintage_date) AS n_vintages, count(DISTINCT series_id) AS n_variables, min(quarter_ord) AS first_ts, max(quarter_ord) AS last_ts FROM vp")
def a12(spark, d):
    return evaluate.panel_statistics(_vp(spark, d), "vintage_date", "series_id", "quarter_ord")


@query("j12_coverage", V + SNAP + """
, t AS (SELECT series_id, obs_date FROM qpanel WHERE obs_date IN (SELECT obs_date FROM snap WHERE value IS NOT NULL)),
f AS (SELECT series_id, obs_date FROM snap WHERE value IS NOT NULL)
SELECT t.series_id, count(*) AS cells, count(f.series_id) AS present, round(100.0 * count(f.series_id) / count(*), 4) AS pct FROM t LEFT JOIN f ON t.series_id = f.series_id AND t.obs_date = f.obs_date GROUP BY 1 ORDER BY pct, 1 LIMIT 20""")
def j12(spark, d):
    return evaluate.coverage(views.qpanel(spark, d).withColumnRenamed("y", "value"), asof.snapshot_long(_gaps(spark, d), DAY))


@query("j13_changed_cells", V + "SELECT count(*) AS n, CAST(sum(CAST(a.value IS DISTINCT FROM b.value AS INT)) AS BIGINT) AS changed FROM (SELECT series_id, obs_date, arg_max(value, asof_date) AS value FROM versions WHERE asof_date <= DATE '1998-06-30' GROUP BY 1, 2) a JOIN (SELECT series_id, obs_date, arg_max(value, asof_date) AS value FROM versions WHERE asof_date <= DATE '1999-06-30' GROUP BY 1, 2) b USING (series_id, obs_date)")
def j13(spark, d):
    v = views.versions(spark, d)
    return evaluate.changed_cells(asof.snapshot_long(v, "1998-06-30"), asof.snapshot_long(v, DAY), ["series_id", "obs_date"])


@query("j14_restore_levels", V + SNAP + "SELECT q.series_id, q.quarter_ord, round(s.value, 4) AS y FROM qpanel q LEFT JOIN snap s ON q.series_id = s.series_id AND q.obs_date = s.obs_date")
def j14(spark, d):
    snap = asof.snapshot_long(_gaps(spark, d), DAY).select("series_id", "obs_date", F.col("value").alias("_v"))
    out = views.qpanel(spark, d).join(snap, ["series_id", "obs_date"], "left")
    return out.select("series_id", "quarter_ord", F.col("_v").alias("y"))


@query("f01_select_covariates", V + """
, h AS (SELECT variable, CASE WHEN month(month_date) % 5 <> 0 OR variable <> 'N_F' THEN x END AS x, month_date FROM mpanel WHERE variable <> 'N_F' OR year(month_date) = 1995)
, n AS (SELECT variable, count(x) AS n FROM h GROUP BY 1)
SELECT variable, rank FROM (SELECT variable, row_number() OVER (ORDER BY CASE WHEN variable = 'R_O' THEN 0 ELSE 1 END, variable) AS rank FROM n WHERE n >= 8 OR variable = 'R_O') WHERE rank <= 4""")
def f01(spark, d):
    m = views.mpanel(spark, d).where("variable <> 'N_F' OR year(month_date) = 1995")
    m = m.withColumn("x", F.when((F.month("month_date") % 5 != 0) | (F.col("variable") != "N_F"), F.col("x")))
    return features.select_covariates(m, required=["R_O"], cap=4)


@query("f03_preferred_covariates", V + "SELECT variable, rank FROM (SELECT variable, row_number() OVER (ORDER BY CASE variable WHEN 'N_O' THEN 1 WHEN 'A_F' THEN 2 ELSE 1000 END, variable) AS rank FROM (SELECT variable, count(x) AS n FROM mpanel GROUP BY 1) WHERE n >= 24) WHERE rank <= 3")
def f03(spark, d):
    return features.select_covariates(views.mpanel(spark, d), preferred=["N_O", "A_F"], least=24, cap=3)


@query("f04_lag_matrix", V + "SELECT series_id, quarter_ord, round(y, 4) AS y, round(lag(y, 1) OVER w, 4) AS y_lag1, round(lag(y, 2) OVER w, 4) AS y_lag2 FROM qpanel WINDOW w AS (PARTITION BY series_id ORDER BY quarter_ord)")
def f04(spark, d):
    return features.lag_matrix(views.qpanel(spark, d).select("series_id", "quarter_ord", "y"), ["series_id"], "quarter_ord", "y", 2)


@query("f05_future_covariates", V + """
, k AS (SELECT series_id, 118 AS cutoff_ord, unnest(range(0, 5)) AS h FROM (SELECT DISTINCT series_id FROM qpanel)),
j AS (SELECT k.*, x FROM k LEFT JOIN (SELECT series_id, quarter_ord, y AS x FROM qpanel WHERE quarter_ord <= 118 + CAST(substr(series_id, 2) AS INT) % 3) q ON q.series_id = k.series_id AND q.quarter_ord = cutoff_ord + h)
SELECT series_id, cutoff_ord, h, round(x, 4) AS x FROM (SELECT series_id, cutoff_ord, h, last_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY h ROWS UNBOUNDED PRECEDING) AS x FROM j) WHERE h > 0""")
def f05(spark, d):
    q = views.qpanel(spark, d)
    k = F.regexp_extract("series_id", "([0-9]+)", 1).cast("int")
    known = q.where(F.col("quarter_ord") <= 118 + k % 3).select("series_id", "quarter_ord", F.col("y").alias("x"))
    return features.future_covariates(q.select("series_id").distinct().withColumn("cutoff_ord", F.lit(118).cast("long")), known, 4)


@query("f06_shock_adjustment", V + """
, c AS (SELECT series_id, avg(CASE WHEN quarter_ord NOT IN (113, 114) THEN y END) AS calm, count(*) AS n, count(CASE WHEN quarter_ord IN (113, 114) THEN 1 END) AS k FROM qpanel GROUP BY 1)
SELECT q.series_id, quarter_ord, round(CASE WHEN quarter_ord IN (113, 114) AND n >= greatest(8, k + 2) THEN y - calm ELSE 0 END, 2) AS effect, round(y - CASE WHEN quarter_ord IN (113, 114) AND n >= greatest(8, k + 2) THEN y - calm ELSE 0 END, 2) AS adjusted FROM qpanel q JOIN c ON q.series_id = c.series_id""", 2)
def f06(spark, d):
    return features.shock_adjusted(views.qpanel(spark, d), ["series_id"], "quarter_ord", "y", [113, 114]).select("series_id", "quarter_ord", "effect", "adjusted")


SLOT = "SELECT variable, (year(month_date) - 1970) * 4 + quarter(month_date) - 1 AS quarter_ord, " + ", ".join(f"max(CASE WHEN (month(month_date) - 1) % 3 = {k - 1} THEN x END) AS m{k}" for k in (1, 2, 3)) + " FROM mpanel WHERE month_date <= DATE '1999-05-01' GROUP BY 1, 2"


@query("r04_month_slots", V + SLOT)
def r04(spark, d):
    return features.month_slots(views.mpanel(spark, d).where("month_date <= date'1999-05-01'"), ["variable"], "month_date", "x")


@query("f07_month_features", V + f", s AS ({SLOT}) SELECT series_id, q.quarter_ord, a.m1 AS A_F_m1, a.m2 AS A_F_m2, a.m3 AS A_F_m3 FROM qpanel q LEFT JOIN (SELECT * FROM s WHERE variable = 'A_F') a ON a.quarter_ord = q.quarter_ord")
def f07(spark, d):
    slots = features.month_slots(views.mpanel(spark, d).where("month_date <= date'1999-05-01'"), ["variable"], "month_date", "x")
    return features.add_month_features(views.qpanel(spark, d).select("series_id", "quarter_ord"), slots, ["A_F"])


@query("r03_sequence_round_trip", V + "SELECT series_id, quarter_ord, round(y, 4) AS y FROM qpanel")
def r03(spark, d):
    seq = features.to_sequence(views.qpanel(spark, d), "series_id", "quarter_ord", ["y"])
    return features.from_sequence(seq, "series_id", "quarter_ord", ["y"])


@query("r05_sequence_rows", V + "SELECT series_id, count(*) AS n, min(quarter_ord) AS first_ord, max(quarter_ord) AS last_ord, round(arg_max(y, quarter_ord), 4) AS last_y FROM qpanel GROUP BY 1")
def r05(spark, d):
    s = features.to_sequence(views.qpanel(spark, d), "series_id", "quarter_ord", ["y"])
    return s.select("series_id", F.size("y").alias("n"), F.element_at("quarter_ord", 1).alias("first_ord"), F.element_at("quarter_ord", -1).alias("last_ord"), F.element_at("y", -1).alias("last_y"))


@query("v14_asof_quarterly_panel", V + f"""
, snap AS (SELECT series_id, obs_date, arg_max(value, asof_date) AS value FROM versions WHERE asof_date <= DATE '{DAY}' GROUP BY 1, 2),
a AS (SELECT series_id, (year(obs_date) - 1970) * 4 + quarter(obs_date) - 1 AS quarter_ord, avg(value) AS y FROM snap GROUP BY 1, 2)
SELECT series_id, quarter_ord, round(y, 4) AS y, round(CASE WHEN y > 0 THEN ln(y) END, 4) AS log_y, round(100 * (y / lag(y) OVER (PARTITION BY series_id ORDER BY quarter_ord) - 1), 4) AS qoq FROM a""")
def v14(spark, d):
    q = asof.quarterly_mean(asof.snapshot_long(views.versions(spark, d), DAY), ["series_id"], "obs_date", "value").withColumnRenamed("value", "y")
    b = F.lag("y").over(Window.partitionBy("series_id").orderBy("quarter_ord"))
    t = S.target_transforms(F.col("y"), b)
    return q.select("series_id", "quarter_ord", "y", t["log_level"].alias("log_y"), t["qoq"].alias("qoq"))


@query("k05_union_by_name", V + "SELECT series_id AS name, quarter_ord, round(y, 4) AS y, NULL::DOUBLE AS x FROM qpanel UNION ALL SELECT variable, NULL, NULL, x FROM mpanel")
def k05(spark, d):
    q = views.qpanel(spark, d).select(F.col("series_id").alias("name"), "quarter_ord", "y")
    return q.unionByName(views.mpanel(spark, d).select(F.col("variable").alias("name"), "x"), allowMissingColumns=True)


@query("k06_common_periods", V + "SELECT CAST(obs_date AS VARCHAR) AS day FROM qpanel INTERSECT SELECT CAST(month_date AS VARCHAR) FROM mpanel")
def k06(spark, d):
    return views.qpanel(spark, d).select(F.col("obs_date").alias("day")).intersect(views.mpanel(spark, d).select(F.col("month_date").alias("day")))


@query("k07_new_asof_dates", V + "SELECT CAST(asof_date AS VARCHAR) AS asof_date FROM (SELECT DISTINCT asof_date FROM versions) WHERE asof_date NOT IN (SELECT asof_date FROM versions WHERE series_id = 'N1')")
def k07(spark, d):
    v = views.versions(spark, d).select("series_id", "asof_date")
    return v.select("asof_date").distinct().join(v.where("series_id = 'N1'"), "asof_date", "left_anti")


@query("p12_pick_source_series", """
WITH n AS (SELECT DISTINCT p_partkey % 13 AS g, 'S' || CAST(p_partkey % 7 AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '_gdp' WHEN p_partkey % 5 = 0 THEN '' ELSE 'x' END AS name FROM part),
r AS (SELECT g, name, CASE WHEN upper(name) = 'S3' THEN 0 WHEN upper(name) = 'GDP' THEN 1 WHEN contains(upper(name), 'S3') THEN 1000 WHEN contains(upper(name), 'GDP') THEN 1001 END AS rank FROM n)
SELECT g, name FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank, name) AS k FROM r WHERE rank IS NOT NULL) WHERE k = 1""")
def p12(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, "_gdp").when(k % 5 == 0, "").otherwise("x")
    names = views.table(spark, d, "part").select((k % 13).alias("g"), F.concat(F.lit("S"), (k % 7).cast("string"), tail).alias("name")).distinct()
    return features.pick_sources(names, ["s3", "gdp"], ["g"])


@query("p14_vintage_labels", V + """
SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, CASE quarter_ord % 3 WHEN 0 THEN strftime(obs_date, '%Y-%m') WHEN 1 THEN '2030-05' ELSE strftime(obs_date + INTERVAL 1 MONTH, '%Y-%m') END AS label FROM qpanel""")
def p14(spark, d):
    q = F.col("quarter_ord") % 3
    path = F.when(q == 0, F.concat(F.lit("/data/panel_"), F.date_format("obs_date", "yyyy"), F.lit("m"), F.month("obs_date").cast("string"), F.lit(".csv"))).otherwise("/data/latest.csv")
    return views.qpanel(spark, d).select("series_id", "obs_date", S.vintage_label(path, F.when(q == 1, "2030-05"), F.add_months("obs_date", 1)).alias("label"))


@query("r02_item_frame", V + """
SELECT quarter_ord, round(max(CASE WHEN series_id = 'N1' THEN y END), 4) AS target, round(max(CASE WHEN series_id = 'N3' THEN y * 2 END), 4) AS N3, round(max(CASE WHEN series_id = 'N5' THEN y END), 4) AS N5
FROM qpanel GROUP BY 1 HAVING max(CASE WHEN series_id = 'N1' THEN y END) IS NOT NULL""")
def r02(spark, d):
    q = views.qpanel(spark, d).select("quarter_ord", F.col("series_id").alias("item"), F.col("y").alias("value"), F.lit(1).alias("arrival"))
    again = q.where("item = 'N3'").withColumns({"value": F.col("value") * 2, "arrival": F.lit(2)})
    return features.item_frame(q.unionByName(again), "N1", ["N3", "N5"], "quarter_ord", "arrival")


@query("f02_mixed_selection", V + """
, m AS (SELECT variable, 'M' AS frequency, 0 AS o, ascii(variable) AS pos FROM mpanel GROUP BY 1 HAVING count(x) >= 8), q AS (SELECT series_id AS variable, 'Q' AS frequency, 1 AS o, CAST(substr(series_id, 2) AS INT) AS pos FROM qpanel GROUP BY 1 HAVING count(y) >= 8),
b AS (SELECT *, frequency = 'Q' AND row_number() OVER (PARTITION BY frequency ORDER BY pos, variable) = 1 AS f FROM (SELECT * FROM m UNION ALL SELECT * FROM q)),
k AS (SELECT *, row_number() OVER (ORDER BY f DESC, o, pos, variable) AS r FROM b)
SELECT variable, frequency, row_number() OVER (ORDER BY o, pos, variable) AS rank FROM k WHERE r <= 5""")
def f02(spark, d):
    m = views.mpanel(spark, d).select("variable", F.ascii("variable").alias("pos"), "x")
    q = views.qpanel(spark, d).select(F.col("series_id").alias("variable"), F.regexp_extract("series_id", "([0-9]+)", 1).cast("int").alias("pos"), F.col("y").alias("x"))
    return features.mixed_selection(m, q, 5)
