"""Queries of column expressions and of transforms in order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import sequence as Q
from ..operators import asof
from . import views
from .catalog import query
from .views import VIEWS_SQL as V

SHOCK = (113, 114)  # 1998Q2 and 1998Q3, as quarters since 1970


@query("p01_quarter_keys", V + """
SELECT quarter_ord, CAST(obs_date AS VARCHAR) AS obs_date, CAST(1970 + quarter_ord // 4 AS VARCHAR) || 'Q' || CAST(quarter_ord % 4 + 1 AS VARCHAR) AS label,
       CAST(obs_date AS VARCHAR) AS q_start, CAST(last_day(obs_date + INTERVAL 2 MONTH) AS VARCHAR) AS q_end
FROM (SELECT DISTINCT quarter_ord, obs_date FROM qpanel)""")
def p01(spark, d):
    q = views.qpanel(spark, d).select("quarter_ord", "obs_date").distinct()
    k = F.col("quarter_ord")
    return q.select("quarter_ord", "obs_date", S.quarter_label(k).alias("label"), S.quarter_start(k).alias("q_start"), S.quarter_end(k).alias("q_end"))


@query("p02_finite_numbers", """
SELECT event_id, CASE WHEN isfinite(x) THEN round(x, 4) END AS x FROM (
  SELECT event_id, TRY_CAST(CASE event_id % 5 WHEN 0 THEN '.' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS x FROM events)""")
def p02(spark, d):
    k = F.col("event_id") % 5
    text = F.when(k == 0, ".").when(k == 1, "NaN").when(k == 2, "Infinity").otherwise(F.col("value").cast("string"))
    return views.table(spark, d, "events").select("event_id", S.finite(text).alias("x"))


@query("p03_last_business_day", V + """
SELECT CAST(asof_date AS VARCHAR) AS asof_date, CAST(asof_date - CASE isodow(asof_date) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS VARCHAR) AS business_day
FROM (SELECT DISTINCT asof_date FROM versions)""")
def p03(spark, d):
    return views.versions(spark, d).select("asof_date").distinct().select("asof_date", S.last_business_day(F.col("asof_date")).alias("business_day"))


@query("p04_saar_growth", V + """
SELECT series_id, quarter_ord, round(CASE WHEN y > 0 AND b > 0 THEN 100 * (pow(y / b, 4) - 1) END, 4) AS saar
FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY quarter_ord) AS b FROM qpanel)""")
def p04(spark, d):
    w = Window.partitionBy("series_id").orderBy("quarter_ord")
    return views.qpanel(spark, d).select("series_id", "quarter_ord", S.saar_growth(F.col("y"), F.lag("y").over(w)).alias("saar"))


@query("p05_target_transforms", V + """
SELECT series_id, quarter_ord, round(y, 4) AS level, round(CASE WHEN y > 0 THEN ln(y) END, 4) AS log_level, round(CASE WHEN b <> 0 THEN 100 * (y / b - 1) END, 4) AS qoq, round(CASE WHEN b <> 0 THEN 100 * (pow(y / b, 4) - 1) END, 4) AS saar
FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY quarter_ord) AS b FROM qpanel)""")
def p05(spark, d):
    w = Window.partitionBy("series_id").orderBy("quarter_ord")
    b = views.qpanel(spark, d).withColumn("b", F.lag("y").over(w))
    return b.select("series_id", "quarter_ord", *[c.alias(n) for n, c in S.target_transforms(F.col("y"), F.col("b")).items()])


@query("p06_months_to_release", V + """
, m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN (year(l) - year(o_orderdate)) * 12 + month(l) - month(o_orderdate) - 2 END AS months
  FROM (SELECT o_orderkey, o_orderdate, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS l FROM orders))
SELECT CASE WHEN months IS NULL THEN 'unknown' WHEN months <= 0 THEN '<=0' WHEN months = 1 THEN '1' WHEN months <= 3 THEN '2-3' WHEN months <= 6 THEN '4-6' ELSE '7+' END AS bucket, count(*) AS n, coalesce(CAST(sum(months) AS BIGINT), 0) AS months FROM m GROUP BY 1""")
def p06(spark, d):
    last = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("l"))
    m = views.table(spark, d, "orders").join(last, "o_orderkey", "left").select(F.when(F.col("o_orderkey") % 11 != 0, S.months_to_release(F.col("o_orderdate"), F.col("l")) - 2).alias("months"))
    return m.groupBy(S.release_bucket(F.col("months")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("months"), F.lit(0)).alias("months"))


@query("p07_period_slices", V + """
SELECT CASE WHEN quarter_ord < 113 THEN 'pre' WHEN quarter_ord <= 114 THEN 'shock' ELSE 'post' END AS period, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM qpanel GROUP BY 1""")
def p07(spark, d):
    return views.qpanel(spark, d).groupBy(S.period_slice(F.col("quarter_ord"), *SHOCK).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("p08_shock_dummies", V + """
SELECT series_id, quarter_ord, CAST(quarter_ord = 113 AS DOUBLE) AS shock_113, CAST(quarter_ord = 114 AS DOUBLE) AS shock_114 FROM qpanel""")
def p08(spark, d):
    return views.qpanel(spark, d).select("series_id", "quarter_ord", *S.shock_dummies(F.col("quarter_ord"), list(SHOCK)))


@query("p09_exclude_years", V + "SELECT series_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM qpanel WHERE year(obs_date) NOT IN (1997, 1998) GROUP BY 1")
def p09(spark, d):
    return Q.without_years(views.qpanel(spark, d), "obs_date", [1997, 1998]).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query("p09_exclude_years_sequence", V + "SELECT series_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM qpanel WHERE year(obs_date) NOT IN (1997, 1998) GROUP BY 1")
def p09b(spark, d):
    seq = views.qpanel(spark, d).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("obs_date", "cents"))).alias("r")).select("series_id", F.col("r.obs_date").alias("t"), F.col("r.cents").alias("v"))
    kept = Q.without_years_in_arrays(seq, "t", "v", [1997, 1998])
    return kept.select("series_id", F.size("t").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("cents"))


@query("p10_alias_candidates", """
WITH n AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN '^S ' || CAST(p_partkey % 97 AS VARCHAR) || 'x' WHEN 1 THEN 'S' || CAST(p_partkey % 97 AS VARCHAR) WHEN 2 THEN 'PART ' || CAST(p_partkey % 97 AS VARCHAR) ELSE '^P' || CAST(p_partkey % 97 AS VARCHAR) END AS name FROM part),
c AS (SELECT name, unnest([CASE WHEN name = 'S5' THEN 'FIVE' END, name, replace(name, ' ', ''), ltrim_hat, regexp_replace(name, 'x$', ''), regexp_replace(ltrim_hat, 'x$', '')]) AS cand, unnest(range(6)) AS pos FROM (SELECT name, regexp_replace(replace(name, ' ', ''), '^\\^', '') AS ltrim_hat FROM n)),
f AS (SELECT name, cand, min(pos) AS pos FROM c WHERE cand IS NOT NULL AND cand <> '' GROUP BY 1, 2)
SELECT name, cand AS candidate, row_number() OVER (PARTITION BY name ORDER BY pos) - 1 AS place FROM f""")
def p10(spark, d):
    k = F.col("p_partkey")
    n = (k % 97).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("^S "), n, F.lit("x"))).when(k % 4 == 1, F.concat(F.lit("S"), n)).when(k % 4 == 2, F.concat(F.lit("PART "), n)).otherwise(F.concat(F.lit("^P"), n))
    names = views.table(spark, d, "part").select(name.alias("name")).distinct()
    return names.select("name", F.posexplode(S.alias_candidates(F.col("name"), {"S5": "FIVE"})).alias("place", "candidate"))


@query("p11_resolve_variables", V + """
, a AS (SELECT variable_name, series_id, u FROM (VALUES ('alpha', 'N3', 1), ('alpha', 'N4', 2), ('N7', 'N8', 2)) t(variable_name, series_id, u)),
vars AS (SELECT unnest(['alpha', 'N7', ' N 9', '^N10x', 'nothing']) AS variable),
av AS (SELECT DISTINCT series_id FROM qpanel),
c AS (SELECT variable, series_id, u AS pr FROM vars JOIN a ON variable = variable_name
  UNION ALL SELECT variable, series_id, 1000 + pos FROM (SELECT variable, unnest([variable, replace(variable, ' ', ''), h, regexp_replace(variable, 'x$', ''), regexp_replace(h, 'x$', '')]) AS cand, unnest(range(5)) AS pos FROM (SELECT variable, regexp_replace(replace(variable, ' ', ''), '^\\^', '') AS h FROM vars)) JOIN av ON cand = series_id)
SELECT variable, arg_min(c.series_id, pr) AS series_id FROM vars LEFT JOIN c USING (variable) GROUP BY 1""")
def p11(spark, d):
    aliases = spark.createDataFrame([("alpha", "us", "N3"), ("alpha", "world", "N4"), ("N7", "world", "N8")], "variable_name string, universe string, series_id string")
    variables = spark.createDataFrame([("alpha",), ("N7",), (" N 9",), ("^N10x",), ("nothing",)], "variable string")
    return asof.resolve(variables, aliases, views.qpanel(spark, d).select("series_id"), ["us", "world"])


@query("p15_constructed_series", V + """
, w AS (SELECT month_date, max(CASE WHEN variable = 'A_F' THEN x END) AS a, max(CASE WHEN variable = 'R_F' THEN x END) AS r, max(CASE WHEN variable = 'N_O' THEN x END) AS n FROM mpanel GROUP BY 1)
SELECT CAST(month_date AS VARCHAR) AS month_date, round(a - r, 4) AS spread, round(CASE WHEN r <> 0 THEN 100 * a / r END, 4) AS ratio, round(a + r + n, 4) AS total, round(CASE WHEN a + r <> 0 THEN 100 * a / (a + r) END, 4) AS share FROM w""")
def p15(spark, d):
    m = views.mpanel(spark, d).groupBy("month_date").pivot("variable", ["A_F", "R_F", "N_O"]).agg(F.first("x"))
    a, r, n = F.col("A_F"), F.col("R_F"), F.col("N_O")
    return m.select("month_date", S.spread(a, r).alias("spread"), S.ratio(a, r).alias("ratio"), (a + r + n).alias("total"), S.ratio(a, a + r).alias("share"))


@query("p16_level_from_growth", V + """
SELECT series_id, quarter_ord, round(CASE WHEN g > -100 THEN y / pow(1 + g / 100, 0.25) END, 2) AS level_before
FROM (SELECT *, CASE WHEN y > 0 AND b > 0 THEN 100 * (pow(y / b, 4) - 1) END AS g FROM (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY quarter_ord) AS b FROM qpanel))""", 2)
def p16(spark, d):
    w = Window.partitionBy("series_id").orderBy("quarter_ord")
    g = S.saar_growth(F.col("y"), F.lag("y").over(w))
    return views.qpanel(spark, d).withColumn("g", g).select("series_id", "quarter_ord", S.level_before(F.col("y"), F.col("g")).alias("level_before"))


CODES = """
, c AS (SELECT p.series_id, quarter_ord, tcode, y, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, CASE WHEN y > 0 THEN ln(y) END AS g, min(y) OVER (PARTITION BY p.series_id) AS low FROM qpanel p JOIN tcodes t ON p.series_id = t.series_id WINDOW w AS (PARTITION BY p.series_id ORDER BY quarter_ord)),
c2 AS (SELECT *, lag(g, 1) OVER w AS g1, lag(g, 2) OVER w AS g2 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY quarter_ord)),
t AS (SELECT series_id, quarter_ord, y, CASE tcode WHEN 1 THEN y WHEN 2 THEN y - y1 WHEN 3 THEN y - 2 * y1 + y2 WHEN 4 THEN g WHEN 5 THEN g - g1 WHEN 6 THEN g - 2 * g1 + g2 WHEN 7 THEN (y / y1 - 1) - (y1 / y2 - 1) END AS x,
  CASE WHEN tcode IN (1, 2, 3, 7) OR low > 4000000 THEN 1 END AS strict_ok FROM c2)
"""


@query("t01_transform_codes", V + CODES + "SELECT series_id, quarter_ord, round(x, 4) AS transformed FROM t")
def t01(spark, d):
    p = views.qpanel(spark, d)
    return Q.transform_codes(p.join(views.tcodes(p), "series_id"), ["series_id"], "quarter_ord", "y").select("series_id", "quarter_ord", "transformed")


@query("t02_strict_transform_codes", V + CODES + "SELECT series_id, quarter_ord, round(CASE WHEN strict_ok = 1 THEN x END, 4) AS transformed FROM t")
def t02(spark, d):
    p = views.qpanel(spark, d)
    return Q.transform_codes(p.join(views.tcodes(p), "series_id"), ["series_id"], "quarter_ord", "y", strict=True, tiny=4000000).select("series_id", "quarter_ord", "transformed")


MASK = """
, dd AS (SELECT variable, month_date, x - lag(x) OVER (PARTITION BY variable ORDER BY month_date) AS x FROM mpanel),
mq AS (SELECT variable, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM dd GROUP BY 1),
masked AS (SELECT variable, month_date, coalesce(abs(x - q2) > 1.5 * (q3 - q1), false) AS masked, x FROM dd JOIN mq USING (variable))
"""


def _masked(spark, d):
    w = Window.partitionBy("variable").orderBy("month_date")
    return Q.mask_outliers(views.mpanel(spark, d).withColumn("x", F.col("x") - F.lag("x").over(w)), ["variable"], "x", 1.5)


@query("t03_outlier_mask", V + MASK + "SELECT variable, CAST(month_date AS VARCHAR) AS month_date, masked, CASE WHEN NOT masked THEN round(x, 4) END AS x FROM masked")
def t03(spark, d):
    return _masked(spark, d).select("variable", "month_date", "masked", "x")


@query("t04_drop_first_rows", V + "SELECT variable, CAST(month_date AS VARCHAR) AS month_date, x FROM (SELECT *, dense_rank() OVER (PARTITION BY variable ORDER BY month_date) AS r FROM mpanel) WHERE r > 2")
def t04(spark, d):
    return Q.drop_first(views.mpanel(spark, d), ["variable"], "month_date", 2)


@query("t05_processed_panel", V + MASK + "SELECT variable, count(*) AS n_rows, CAST(sum(CAST(masked AS INT)) AS BIGINT) AS masked, count(CASE WHEN NOT masked THEN x END) AS kept FROM (SELECT *, dense_rank() OVER (PARTITION BY variable ORDER BY month_date) AS r FROM masked) WHERE r > 2 GROUP BY 1")
def t05(spark, d):
    p = Q.drop_first(_masked(spark, d), ["variable"], "month_date", 2)
    return p.groupBy("variable").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("masked").cast("long")).alias("masked"), F.count("x").alias("kept"))


@query("t06_processed_latest_snapshot", V + MASK + "SELECT variable, CAST(month_date AS VARCHAR) AS month_date, CASE WHEN NOT masked THEN round(x, 4) END AS x FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY month_date DESC) AS r, dense_rank() OVER (PARTITION BY variable ORDER BY month_date) AS a FROM masked) WHERE a > 2 AND r <= 12")
def t06(spark, d):
    w = Window.partitionBy("variable").orderBy(F.desc("month_date"))
    p = Q.drop_first(_masked(spark, d), ["variable"], "month_date", 2)
    return p.withColumn("r", F.row_number().over(w)).where("r <= 12").select("variable", "month_date", "x")


FILL = """
, holes AS (SELECT series_id, quarter_ord, CASE WHEN quarter_ord % 3 <> 0 AND quarter_ord > 102 THEN y END AS x, CASE WHEN quarter_ord % 5 <> 0 THEN y END AS t FROM qpanel)
"""


def _holes(spark, d):
    q = F.col("quarter_ord")
    return views.qpanel(spark, d).select("series_id", "quarter_ord", F.when((q % 3 != 0) & (q > 102), F.col("y")).alias("x"), F.when(q % 5 != 0, F.col("y")).alias("t"))


FILLED = "coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY quarter_ord ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY quarter_ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("t07_fill_both_ways", V + FILL + f"SELECT series_id, quarter_ord, round({FILLED}, 4) AS x FROM holes")
def t07(spark, d):
    return Q.fill_both_ways(_holes(spark, d), ["series_id"], "quarter_ord", ["x"]).select("series_id", "quarter_ord", "x")


@query("t08_valid_target", V + FILL + f"SELECT series_id, quarter_ord, round(t, 4) AS t, round({FILLED}, 4) AS x FROM holes WHERE t IS NOT NULL")
def t08(spark, d):
    return Q.valid_target(_holes(spark, d), ["series_id"], "quarter_ord", "t", ["x"]).select("series_id", "quarter_ord", "t", "x")


@query("t09_longest_block", V + """
, g AS (SELECT series_id, quarter_ord FROM qpanel WHERE (quarter_ord + CAST(substr(series_id, 2) AS INT)) % 9 <> 4),
i AS (SELECT *, quarter_ord - row_number() OVER (PARTITION BY series_id ORDER BY quarter_ord) AS island, count(*) OVER (PARTITION BY series_id) AS n FROM g),
s AS (SELECT series_id, island, count(*) AS c FROM i GROUP BY 1, 2),
b AS (SELECT series_id, arg_max(island, c * 100000 + island) AS island FROM s GROUP BY 1)
SELECT i.series_id, quarter_ord FROM i JOIN b ON i.series_id = b.series_id WHERE n < 20 OR i.island = b.island""")
def t09(spark, d):
    k = F.regexp_extract("series_id", "([0-9]+)", 1).cast("int")
    gaps = views.qpanel(spark, d).where((F.col("quarter_ord") + k) % 9 != 4).select("series_id", "quarter_ord")
    return Q.longest_block(gaps, ["series_id"], "quarter_ord")


@query("t10_regular_quarters", V + """
, g AS (SELECT series_id, obs_date, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) - 1 AS step, min(obs_date) OVER (PARTITION BY series_id) AS f FROM qpanel WHERE year(obs_date) <> 1997)
SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, step, CAST(CAST(f + to_months(CAST(3 * step AS INT)) AS DATE) AS VARCHAR) AS regular_ts FROM g""")
def t10(spark, d):
    return Q.regular_quarters(Q.without_years(views.qpanel(spark, d), "obs_date", [1997]), ["series_id"], "obs_date").select("series_id", "obs_date", "step", "regular_ts")


@query("t11_levels_from_growth", V + """
, g AS (SELECT series_id, quarter_ord, CASE WHEN quarter_ord % 7 <> 3 THEN 100 * (pow(y / lag(y) OVER (PARTITION BY series_id ORDER BY quarter_ord), 4) - 1) END AS g FROM qpanel),
s AS (SELECT *, CASE WHEN g > -100 THEN ln(1 + g / 100) / 4 END AS s FROM g)
SELECT series_id, quarter_ord, round(CASE WHEN s IS NOT NULL THEN 100.0 * exp(sum(s) OVER (PARTITION BY series_id ORDER BY quarter_ord ROWS UNBOUNDED PRECEDING)) END, 4) AS level FROM s""")
def t11(spark, d):
    w = Window.partitionBy("series_id").orderBy("quarter_ord")
    g = F.when(F.col("quarter_ord") % 7 != 3, 100 * (F.pow(F.col("y") / F.lag("y").over(w), 4) - 1))
    return Q.levels_from_growth(views.qpanel(spark, d).withColumn("g", g), ["series_id"], "quarter_ord", "g", F.lit(100.0)).select("series_id", "quarter_ord", "level")


@query("t12_month_end_average", """
SELECT event_type, CAST(last_day(ts) AS VARCHAR) AS month_end, round(avg(value), 3) AS value FROM events GROUP BY 1, 2""", 3)
def t12(spark, d):
    return Q.monthly_average(views.table(spark, d, "events"), ["event_type"], "ts", "value")


@query("t12_frequency", V + """
, g AS (SELECT 'q' AS k, series_id AS s, obs_date AS t FROM qpanel UNION ALL SELECT 'm', variable, month_date FROM mpanel),
h AS (SELECT k, s, datediff('day', lag(t) OVER (PARTITION BY k, s ORDER BY t), t) AS gap FROM g)
SELECT k, s, CASE WHEN quantile_cont(CAST(gap AS DOUBLE), 0.5) >= 80 THEN 'Q' ELSE 'M' END AS frequency FROM h GROUP BY 1, 2""")
def t12b(spark, d):
    q = views.qpanel(spark, d).select(F.lit("q").alias("k"), F.col("series_id").alias("s"), F.col("obs_date").alias("t"))
    m = views.mpanel(spark, d).select(F.lit("m").alias("k"), F.col("variable").alias("s"), F.col("month_date").alias("t"))
    return Q.frequency(q.unionByName(m), ["k", "s"], "t")


@query("t13_stitch", V + """
, a AS (SELECT series_id, quarter_ord, y FROM qpanel WHERE quarter_ord < 115), b AS (SELECT series_id, quarter_ord, y * 2 AS y FROM qpanel WHERE quarter_ord >= 110)
SELECT series_id, quarter_ord, round(coalesce(b.y, a.y), 4) AS y FROM a FULL JOIN b USING (series_id, quarter_ord)""")
def t13(spark, d):
    p = views.qpanel(spark, d)
    return Q.stitch(p.where("quarter_ord < 115"), p.where("quarter_ord >= 110").withColumn("y", F.col("y") * 2), ["series_id", "quarter_ord"], "y")
