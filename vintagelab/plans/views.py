"""Views on the test tables that behave like economic data: revisions, panels, releases and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import quarter_ord
from ..sources.files import scratch, staged  # noqa: F401 - queries and jobs take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column) -> Column:
    """Money as whole cents, so that sums don't depend on their order."""
    return F.floor(c * 100 + 0.5).cast("long")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, obs_date, asof_date, value): revenue of a nation's orders of a quarter, as known after each month's shipments."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("shipped"), cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cents"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("ordered"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("series_id"))
    sold = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("shipped >= ordered").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    monthly = sold.groupBy("series_id", F.trunc("ordered", "quarter").alias("obs_date"), F.last_day("shipped").alias("asof_date")).agg(F.sum("cents").alias("cents"))
    upto = Window.partitionBy("series_id", "obs_date").orderBy("asof_date").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select("series_id", "obs_date", "asof_date", (F.sum("cents").over(upto).cast("double") / 100.0).alias("value"))


def qpanel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, quarter_ord, obs_date, cents, y): a nation's orders by quarter; the last quarter is partial and left out."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("ordered"), cents(F.col("o_totalprice")).alias("cents"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("series_id"))
    sums = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("series_id", F.trunc("ordered", "quarter").alias("obs_date")).agg(F.sum("cents").alias("cents"))
    return sums.where("obs_date < date'2001-07-01'").select("series_id", quarter_ord(F.col("obs_date")).alias("quarter_ord"), "obs_date", "cents", (F.col("cents").cast("double") / 100.0).alias("y"))


def mpanel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variable, month_date, x): monthly shipped quantity by return flag and line status."""
    items = table(spark, sf_dir, "lineitem")
    by = [F.concat_ws("_", "l_returnflag", "l_linestatus").alias("variable"), F.trunc("l_shipdate", "month").alias("month_date")]
    return items.groupBy(*by).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("x"))


def tcodes(panel: DataFrame) -> DataFrame:
    """(series_id, tcode): a transform code from 1 to 7 for each series, by its number."""
    number = F.regexp_extract("series_id", "([0-9]+)", 1).cast("int")
    return panel.select("series_id").distinct().select("series_id", (number % 7 + 1).cast("int").alias("tcode"))


VIEWS_SQL = """
WITH monthly AS (
  SELECT 'N' || c_nationkey AS series_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS obs_date, CAST(last_day(l_shipdate) AS DATE) AS asof_date,
         sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) GROUP BY 1, 2, 3),
versions AS (SELECT series_id, obs_date, asof_date, CAST(sum(cents) OVER (PARTITION BY series_id, obs_date ORDER BY asof_date) AS DOUBLE) / 100.0 AS value FROM monthly),
qpanel AS (
  SELECT 'N' || c_nationkey AS series_id, (year(o_orderdate) - 1970) * 4 + quarter(o_orderdate) - 1 AS quarter_ord, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS obs_date,
         sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS cents, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS y
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1, 2, 3),
mpanel AS (
  SELECT l_returnflag || '_' || l_linestatus AS variable, CAST(date_trunc('month', l_shipdate) AS DATE) AS month_date, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS x
  FROM lineitem GROUP BY 1, 2),
tcodes AS (SELECT DISTINCT series_id, CAST(CAST(substr(series_id, 2) AS INT) % 7 + 1 AS INT) AS tcode FROM qpanel)
"""
