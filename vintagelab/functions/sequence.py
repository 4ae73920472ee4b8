"""Transforms of a series in order, each one pass over windows of (group, time); long form does all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def _ordered(by: Keys, ts: str):
    return Window.partitionBy(*by).orderBy(ts)


def transform_codes(df: DataFrame, by: Keys, ts: str, y: str, code: str = "tcode", strict: bool = False, tiny: float = 1e-6) -> DataFrame:
    """df with `transformed`: codes 1 to 7 are the level, its first and second difference, log, and the log's; 7 is the change of
    the growth rate. Lags are by row. A log of what isn't positive is null; strict: a series with any value up to tiny has none."""
    w = _ordered(by, ts)
    v, c = F.col(y), F.col(code)
    log = F.when(v > 0, F.log(v))
    df = df.withColumns({"_y1": F.lag(v, 1).over(w), "_y2": F.lag(v, 2).over(w), "_g": log})
    df = df.withColumns({"_g1": F.lag("_g", 1).over(w), "_g2": F.lag("_g", 2).over(w)})
    y1, y2, g, g1, g2 = (F.col(n) for n in ("_y1", "_y2", "_g", "_g1", "_g2"))
    rate, rate1 = F.try_divide(v, y1) - 1, F.try_divide(y1, y2) - 1
    logs = F.when(c == 4, g).when(c == 5, g - g1).when(c == 6, g - 2 * g1 + g2)
    if strict:
        logs = F.when(F.min(v).over(Window.partitionBy(*by)) > tiny, logs)
    out = F.when(c == 1, v).when(c == 2, v - y1).when(c == 3, v - 2 * y1 + y2).when(c.isin(4, 5, 6), logs).when(c == 7, rate - rate1)
    return df.withColumn("transformed", out).drop("_y1", "_y2", "_g", "_g1", "_g2")


def mask_outliers(df: DataFrame, by: Keys, y: str, width: float = 10.0) -> DataFrame:
    """df with y null where it is further than width interquartile ranges from its group's median, and `masked`."""
    q = df.groupBy(*by).agg(F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    far = F.coalesce(F.abs(F.col(y) - F.col("_q")[1]) > width * (F.col("_q")[2] - F.col("_q")[0]), F.lit(False))
    return df.join(q, by).withColumn("masked", far).withColumn(y, F.when(~F.col("masked"), F.col(y))).drop("_q")


def drop_first(df: DataFrame, by: Keys, ts: str, n: int) -> DataFrame:
    """df without the first n times of each group."""
    return df.withColumn("_at", F.dense_rank().over(_ordered(by, ts))).where(F.col("_at") > n).drop("_at")


def fill_both_ways(df: DataFrame, by: Keys, ts: str, columns: list[str], zero: bool = False) -> DataFrame:
    """df with nulls filled from before, then from after, then (zero) by 0."""
    before = _ordered(by, ts).rowsBetween(Window.unboundedPreceding, 0)
    after = _ordered(by, ts).rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after), *([F.lit(0.0)] if zero else [])) for c in columns}
    return df.withColumns(filled)


def valid_target(df: DataFrame, by: Keys, ts: str, y: str, covariates: list[str]) -> DataFrame:
    """Rows whose target is a finite number; then covariates filled both ways among them."""
    from .scalars import finite

    return fill_both_ways(df.withColumn(y, finite(F.col(y))).where(F.col(y).isNotNull()), by, ts, covariates)


def longest_block(df: DataFrame, by: Keys, q: str, least: int = 20) -> DataFrame:
    """Each group's longest run of consecutive quarters, the later of equals; groups under `least` rows stay whole."""
    w, g = _ordered(by, q), Window.partitionBy(*by)
    df = df.withColumn("_new", F.coalesce((F.col(q) - F.lag(q).over(w) != 1).cast("int"), F.lit(1)))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(*by, "_island")), "_all": F.count(F.lit(1)).over(g)})
    df = df.withColumn("_best", F.max(F.struct("_n", "_island")).over(g))
    return df.where((F.col("_all") < least) | (F.col("_island") == F.col("_best._island"))).drop("_new", "_island", "_n", "_all", "_best")


def regular_quarters(df: DataFrame, by: Keys, ts: str) -> DataFrame:
    """df with step (0, 1, ...) and regular_ts: its times laid at a quarter's distance from the first, in order."""
    w = _ordered(by, ts)
    df = df.withColumns({"step": (F.row_number().over(w) - 1).cast("long"), "_first": F.min(ts).over(Window.partitionBy(*by))})
    return df.withColumn("regular_ts", F.add_months("_first", (F.col("step") * 3).cast("int"))).drop("_first")


def levels_from_growth(df: DataFrame, by: Keys, ts: str, growth: str, start: Column) -> DataFrame:
    """df with `level`: start times the running product of quarterly factors of annualised growth; a null step, or one of -100 or
    less, gives null, and the level goes on after it."""
    g = F.col(growth)
    step = F.when(g > -100, F.log(1 + g / 100) / 4)
    run = F.sum(step).over(_ordered(by, ts).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("level", F.when(step.isNotNull(), start * F.exp(run)))


def monthly_average(df: DataFrame, by: Keys, date: str, y: str) -> DataFrame:
    """Mean by month end."""
    return df.groupBy(*by, F.last_day(date).alias("month_end")).agg(F.avg(y).alias(y))


def frequency(df: DataFrame, by: Keys, date: str) -> DataFrame:
    """Q where the median gap between dates is 80 days or more, else M."""
    gap = F.datediff(F.col(date), F.lag(date).over(_ordered(by, date)))
    gaps = df.select(*by, date).distinct().withColumn("_gap", gap)
    return gaps.groupBy(*by).agg(F.when(F.percentile("_gap", 0.5) >= 80, "Q").otherwise("M").alias("frequency"))


def stitch(base: DataFrame, new: DataFrame, key: Keys, y: str) -> DataFrame:
    """Both histories; the new one wins where both have the key."""
    both = base.select(*key, y, F.lit(0).alias("_p")).unionByName(new.select(*key, y, F.lit(1).alias("_p")))
    return both.groupBy(*key).agg(F.max_by(y, "_p").alias(y))


def without_years(df: DataFrame, date: str, years: list[int]) -> DataFrame:
    return df.where(~F.year(date).isin(years))


def without_years_in_arrays(df: DataFrame, times: str, values: str, years: list[int]) -> DataFrame:
    """Sequence form of without_years: both arrays lose the same places."""
    kept = F.filter(F.arrays_zip(F.col(times).alias("t"), F.col(values).alias("v")), lambda x: ~F.year(x["t"]).isin(years))
    return df.withColumn("_kept", kept).withColumns({times: F.col("_kept.t"), values: F.col("_kept.v")}).drop("_kept")
