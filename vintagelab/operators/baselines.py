"""Baseline forecasts of every series from every origin at once: running windows, no loop over origins, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODELS = ("naive_last", "mean", "drift", "seasonal_naive", "naive_last_growth", "mean_growth", "rw_drift_log")


def _steps(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))


def at_origins(df: DataFrame, origins: DataFrame | None, quarter: str = "quarter_ord") -> DataFrame:
    """The rows of the origins asked for; all of them without any."""
    return df if origins is None else df.join(origins.select("series_id", F.col("origin_ord").alias(quarter)), ["series_id", quarter], "left_semi")


def baseline_forecasts(panel: DataFrame, horizon: int = 4, least: int = 8, models: tuple[str, ...] = MODELS, origins: DataFrame | None = None) -> DataFrame:
    """(model, series_id, origin_ord, h, target_ord, y_hat, last_y) of panel rows (series_id, quarter_ord, y), from each row with
    `least` rows up to it, or from those of the origins (series_id, origin_ord) asked for. The history at an origin is the frame that ends there, so no later value is seen."""
    o = Window.partitionBy("series_id").orderBy("quarter_ord")
    w = o.rowsBetween(Window.unboundedPreceding, 0)
    y = F.col("y")
    df = panel.select("series_id", "quarter_ord", "y").withColumns({"y1": F.lag("y", 1).over(o), "y2": F.lag("y", 2).over(o), "y3": F.lag("y", 3).over(o), "first": F.first("y").over(w), "n": F.count("y").over(w), "avg": F.avg("y").over(w)})
    df = df.withColumn("g", F.when((y > 0) & (F.col("y1") > 0), 100 * (F.pow(y / F.col("y1"), 4) - 1)))
    df = at_origins(df.withColumn("avg_g", F.avg("g").over(w)).where(F.col("n") >= least), origins)
    h, n = F.col("h"), F.col("n")
    drift = y + h * (y - F.col("first")) / (n - 1)
    grow = lambda g: y * F.pow(F.when(g > -100, 1 + g / 100), h / 4)
    rules = {
        "naive_last": y,
        "mean": F.col("avg"),
        "drift": drift,
        "seasonal_naive": F.get(F.array("y3", "y2", "y1", "y"), ((h - 1) % 4).cast("int")),
        "naive_last_growth": F.coalesce(grow(F.col("g")), y),
        "mean_growth": F.coalesce(grow(F.col("avg_g")), y),
        "rw_drift_log": F.when((y > 0) & (F.col("first") > 0), F.exp(F.log(y) + h * (F.log(y) - F.log("first")) / (n - 1))).otherwise(y),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), rules[m].alias("y_hat")) for m in models]))
    return _steps(df, horizon).select("series_id", F.col("quarter_ord").alias("origin_ord"), "h", (F.col("quarter_ord") + h).alias("target_ord"), y.alias("last_y"), rows.alias("r")).select("r.model", "series_id", "origin_ord", "h", "target_ord", "r.y_hat", "last_y")


def _unit(seed: int, k: int) -> Column:
    """A number between 0 and 1 from the hash of (seed, k, series, origin, step)."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(k)), "series_id", F.col("quarter_ord").cast("string"), F.col("h").cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("long") + 0.5) / float(1 << 40)


def random_forecasts(panel: DataFrame, horizon: int = 4, least: int = 8, seed: int = 0, origins: DataFrame | None = None) -> DataFrame:
    """random_normal, random_uniform and random_permutation: draws from hashes of (seed, series, origin, step), so that a task
    that runs again draws the same. A permutation takes a value of the history by its place, which is joined, so that no row
    carries its history."""
    w = Window.partitionBy("series_id").orderBy("quarter_ord").rowsBetween(Window.unboundedPreceding, 0)
    known = panel.where("y IS NOT NULL").select("series_id", "quarter_ord", "y")
    df = known.withColumns({"n": F.count("y").over(w), "avg": F.avg("y").over(w), "sd": F.stddev_pop("y").over(w), "lo": F.min("y").over(w), "hi": F.max("y").over(w)})
    places = df.select("series_id", F.col("n").alias("at"), F.col("y").alias("picked"))
    normal = F.sqrt(-2 * F.log(_unit(seed, 1))) * F.cos(2 * 3.141592653589793 * _unit(seed, 2))
    made = _steps(at_origins(df.where(F.col("n") >= least), origins), horizon).withColumns({"normal": F.col("avg") + F.col("sd") * normal, "uniform": F.col("lo") + (F.col("hi") - F.col("lo")) * _unit(seed, 4), "at": F.floor(_unit(seed, 3) * F.col("n")) + 1})
    made = made.join(places, ["series_id", "at"])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(v).alias("y_hat")) for m, v in (("random_normal", "normal"), ("random_uniform", "uniform"), ("random_permutation", "picked"))]))
    return made.select("series_id", F.col("quarter_ord").alias("origin_ord"), "h", (F.col("quarter_ord") + F.col("h")).alias("target_ord"), F.col("y").alias("last_y"), rows.alias("r")).select("r.model", "series_id", "origin_ord", "h", "target_ord", "r.y_hat", "last_y")


def with_truth(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """forecasts with y_true of the target quarter; targets without one are dropped."""
    truth = panel.select("series_id", F.col("quarter_ord").alias("target_ord"), F.col("y").alias("y_true"))
    return forecasts.join(truth, ["series_id", "target_ord"])


def ensemble(forecasts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of each ensemble of members (ensemble, model, weight): weighted means over the members that have a finite forecast."""
    ok = forecasts.where(F.col("y_hat").isNotNull() & ~F.isnan("y_hat") & (F.abs("y_hat") < float("inf")))
    key = ["series_id", "origin_ord", "h", "target_ord"]
    sums = ok.join(members, "model").groupBy("ensemble", *key).agg((F.sum(F.col("weight") * F.col("y_hat")) / F.sum("weight")).alias("y_hat"), F.max("last_y").alias("last_y"))
    return sums.withColumnRenamed("ensemble", "model").select("model", *key, "y_hat", "last_y")


def growth_ensemble(rows: DataFrame, models: list[str], name: str) -> DataFrame:
    """The mean growth of the models per (series, origin, step), with the level rebuilt from the mean earlier level."""
    out = rows.where(F.col("model").isin(models)).groupBy("series_id", "origin_ord", "h", "target_ord").agg(F.avg("g_hat").alias("g_hat"), F.avg("level_before").alias("level_before"))
    level = F.when(F.col("g_hat") > -100, F.col("level_before") * F.pow(1 + F.col("g_hat") / 100, 0.25))
    return out.withColumns({"model": F.lit(name), "y_hat": level})
