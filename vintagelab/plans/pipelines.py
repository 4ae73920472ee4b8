"""Whole jobs: window evaluation, realtime backtest, nowcast trace and the one-shot forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quarter_end, quarter_ord, release_bucket, saar_growth
from ..operators import asof, baselines, evaluate, releases
from . import views
from .evaluation import StrictError
from .registry import canonical, forecast


def provenance(windows: DataFrame, vintages: DataFrame, strict: bool = False) -> DataFrame:
    """windows (task, window_idx, cutoff) with their vintage_date, its source and used_fallback; strict: an error if a window has
    no vintage early enough."""
    out = asof.select_vintage(windows, vintages, "cutoff", fallback=True)
    out = out.withColumn("source", F.when(F.col("used_fallback"), "earliest").otherwise("panel"))
    if strict and not out.where("used_fallback").isEmpty():
        raise StrictError("windows without a vintage at or before their cutoff")
    return out


def without_provenance(records: DataFrame, windows: DataFrame) -> DataFrame:
    """(task, window_idx) of records that no provenance row covers."""
    return records.select("task", "window_idx").distinct().join(windows.select("task", "window_idx"), ["task", "window_idx"], "left_anti")


def covariate_frame(long: DataFrame, vintage: str | None, codes: DataFrame | None = None) -> DataFrame:
    """(series_id, obs_date, value[, transformed]) of one vintage of a panel (vintage, series_id, obs_date, value): the one asked
    for, else the latest before it, else the earliest; the latest without asking."""
    from ..functions.sequence import transform_codes

    names = long.select("vintage").distinct()
    at_or_before = names.where(F.col("vintage") <= F.lit(vintage)) if vintage else names
    picked = names.agg(F.min("vintage").alias("lo")).crossJoin(at_or_before.agg(F.max("vintage").alias("hi"))).select(F.coalesce("hi", "lo").alias("vintage"))
    one = long.join(F.broadcast(picked), "vintage", "left_semi")
    if codes is None:
        return one
    return transform_codes(one.join(codes, "series_id"), ["series_id"], "obs_date", "value")


def factor_panel(monthly: DataFrame, cutoff_ord: int, years: list[int] | None = None) -> DataFrame:
    """(variable, quarter_ord, x): quarterly means up to the cutoff, years left out, gaps filled both ways and then by 0, on the grid
    of all quarters of all variables."""
    from ..functions.sequence import fill_both_ways, without_years

    kept = without_years(monthly, "month_date", years or [0])
    q = asof.quarterly_mean(kept, ["variable"], "month_date", "x").where(F.col("quarter_ord") <= cutoff_ord)
    grid = q.select("quarter_ord").distinct().join(q.select("variable").distinct())
    return fill_both_ways(grid.join(q, ["variable", "quarter_ord"], "left"), ["variable"], "quarter_ord", ["x"], zero=True).select("variable", "quarter_ord", "x")


#: The model that the realtime job runs in place of one of the evaluation, where it has a form of its own in growth.
REALTIME = {"drift": "rw_drift_log", "mean": "mean_growth", "ar4": "ar4_growth", "random_forest": "random_forest_growth", "xgboost": "xgboost_growth", "bvar_minnesota": "bvar_minnesota_growth", "bvar_minnesota_20": "bvar_minnesota_growth_20"}
ENSEMBLES = {"ensemble_top3": 3, "ensemble_top5": 5}


def leaderboard_members(board: DataFrame, threshold: float = 0.0, exclude: tuple[str, ...] = ("naive_last",)) -> DataFrame:
    """(ensemble, model): of a board (model, skill) the models of a skill over the threshold, the best 3 and the best 5, under their
    realtime names, each once. Ensembles and the models to exclude have no place."""
    fit = board.where((F.col("skill") > threshold) & ~F.lower("model").isin([x.lower() for x in exclude]) & ~F.lower("model").startswith("ensemble"))
    best = fit.orderBy(F.desc("skill"), "model").limit(max(ENSEMBLES.values())).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("skill"), "model")))
    named = F.col("model")
    for own, realtime in REALTIME.items():
        named = F.when(F.col("model") == own, realtime).otherwise(named)
    of = F.explode(F.array(*[F.struct(F.lit(e).alias("ensemble"), F.lit(k).alias("k")) for e, k in ENSEMBLES.items()]))
    return best.select(named.alias("model"), "_r", of.alias("e")).where("_r <= e.k").select("e.ensemble", "model").distinct()


def with_ensembles(rows: DataFrame, members: DataFrame, key: list[str]) -> DataFrame:
    """rows of a backtest with those of ensembles: over the members (ensemble, model) that a key has, the mean growth, on the mean level
    before it; other columns are the same for all models of a key."""
    own = ["model", "y_hat", "level_before", "g_hat"]
    held = rows.join(F.broadcast(members), "model")
    rest = [F.first(c).alias(c) for c in rows.columns if c not in (*own, *key)]
    made = held.groupBy("ensemble", *key).agg(F.avg("g_hat").alias("g_hat"), F.avg("level_before").alias("level_before"), *rest)
    level = F.when((F.col("level_before") > 0) & (F.col("g_hat") > -100), F.col("level_before") * F.pow(1 + F.col("g_hat") / 100, 0.25))
    return rows.unionByName(made.withColumnRenamed("ensemble", "model").withColumn("y_hat", level).select(rows.columns))


def realtime_backtest(versions: DataFrame, names: list[str], horizon: int = 2, least: int = 8, stages: tuple[str, ...] = ("first", "third"), members: DataFrame | None = None) -> DataFrame:
    """(model, series_id, origin, vintage_date, target_ord, h, stage, y_hat, level_before, g_hat, y_true, months, bucket).

    Each first release has an origin the day before it; models see the last vintage then and quarters before the target only.
    All origins are keys of one job; truth comes from releases, of which no model sees any. members (ensemble, model), as
    leaderboard_members() gives them, add ensembles in growth. The versions, and with members the scored rows, are written to the
    shared folder once, as several parts of the job read them."""
    names = canonical(names)
    versions = views.staged(versions.select("series_id", "obs_date", "asof_date", "value"), "backtest-versions")
    wide = releases.releases(versions)
    v = versions.withColumn("asof_date", F.last_day("asof_date"))
    days = v.select("asof_date").distinct()
    origins = asof.select_vintage(releases.quarterly_origins(wide), days).where("vintage_date IS NOT NULL")
    panel = asof.snapshots(versions, origins.select(F.col("vintage_date").alias("cutoff"))).select("series_id", F.col("cutoff").alias("vintage_date"), quarter_ord(F.col("obs_date")).alias("quarter_ord"), "value")
    train = releases.training_sets(origins, panel, 0, least)
    key = F.concat_ws("|", "series_id", "target_ord")
    keyed = train.select(key.alias("series_id"), "quarter_ord", F.col("value").alias("y"))
    last = train.groupBy(key.alias("series_id")).agg(F.max("quarter_ord").alias("origin_ord"))
    made = forecast(keyed, names, horizon, least, origins=last)
    made = evaluate.level_kpi(made.withColumn("y_true", F.lit(None).cast("double")))
    made = made.withColumns({"first_target": F.split_part("series_id", F.lit("|"), F.lit(-1)).cast("long"), "series_id": F.regexp_replace("series_id", "\\|[^|]*$", "")})
    origin = origins.select("series_id", F.col("target_ord").alias("first_target"), "origin", "vintage_date")
    truth = releases.stage_rows(wide).where(F.col("stage").isin(list(stages))).select("series_id", F.col("quarter_ord").alias("target_ord"), "stage", F.col("value").alias("truth"), "release_date")
    out = made.drop("y_true", "g_true").join(origin, ["series_id", "first_target"]).join(truth, ["series_id", "target_ord"])
    months = ((F.year("release_date") - F.year("origin")) * 12 + F.month("release_date") - F.month("origin")).cast("long")
    out = out.select("model", "series_id", "origin", "vintage_date", "origin_ord", "target_ord", "h", "stage", "y_hat", "level_before", "g_hat", F.col("truth").alias("y_true"), months.alias("months"), release_bucket(months).alias("bucket"))
    if members is None:
        return out
    return with_ensembles(views.staged(out, "backtest-scored"), members, ["series_id", "origin", "h", "target_ord", "stage"])


def window_evaluation(panel: DataFrame, names: list[str], baseline: str, shock: tuple[int, int], windows: int = 8, horizon: int = 4, least: int = 8, snapshot: bool = False, allow_snapshot: bool = False) -> dict[str, DataFrame]:
    """records, leaderboard, pairwise, kpi and point errors of models over each series' last `windows` rolling windows.

    snapshot says that the panel is one vintage, whose later revisions leak; that is an error unless allowed."""
    if snapshot and not allow_snapshot:
        raise StrictError("an evaluation on one snapshot sees later revisions; allow it on purpose")
    cut = releases.rolling_windows(panel, windows, horizon, ["series_id"], "quarter_ord").withColumnRenamed("cutoff_ts", "origin_ord")
    rows = forecast(panel, names, horizon, least, origins=cut).join(cut, ["series_id", "origin_ord"])
    records = baselines.with_truth(rows, panel)
    tasks = evaluate.task_metrics(records)
    return {"records": records, "leaderboard": evaluate.leaderboard(tasks, baseline), "pairwise": evaluate.pairwise(tasks), "kpi": evaluate.kpi_tables(records, shock), "errors": evaluate.point_errors(records, ["model"], shock)}


def nowcast_trace(versions: DataFrame, target_ord: int, names: list[str], start: str, end: str, least: int = 8) -> DataFrame:
    """(model, series_id, cutoff, h, y_hat, last_before): a forecast of the target quarter from what was known on each as-of date from
    start to end, all dates in one job; last_before marks each model's last one before the first release."""
    days = versions.where(F.col("asof_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(F.col("asof_date").alias("cutoff")).distinct()
    known = asof.snapshots(versions, days).withColumn("quarter_ord", quarter_ord(F.col("obs_date"))).where(F.col("quarter_ord") < target_ord)
    key = F.concat_ws("|", "series_id", "cutoff")
    panel = known.select(key.alias("series_id"), "quarter_ord", F.col("value").alias("y"))
    last = panel.groupBy("series_id").agg(F.max("quarter_ord").alias("origin_ord"))
    made = forecast(panel, names, 4, least, origins=last).where(F.col("target_ord") == target_ord)
    made = made.withColumns({"cutoff": F.split_part("series_id", F.lit("|"), F.lit(2)).cast("date"), "series_id": F.split_part("series_id", F.lit("|"), F.lit(1))})
    first = releases.releases(versions).where(F.col("quarter_ord") == target_ord).select("series_id", "first_date")
    out = made.join(first, "series_id", "left")
    early = F.when(F.col("cutoff") < F.col("first_date"), F.col("cutoff"))
    w = Window.partitionBy("model", "series_id")
    return out.withColumn("last_before", F.coalesce(F.col("cutoff") == F.max(early).over(w), F.lit(False))).select("model", "series_id", "cutoff", "h", "y_hat", "last_before")


def latest_forecast(panel: DataFrame, names: list[str], horizon: int = 4, least: int = 8) -> DataFrame:
    """(model, series_id, target_ord, target_end, h, y_hat, qoq, saar): paths from each series' last observed quarter."""
    last = panel.where("y IS NOT NULL").groupBy("series_id").agg(F.max("quarter_ord").alias("origin_ord"))
    made = forecast(panel, names, horizon, least, origins=last)
    before = F.coalesce(F.lag("y_hat").over(Window.partitionBy("model", "series_id").orderBy("h")), F.col("last_y"))
    made = made.withColumn("_b", before)
    return made.select("model", "series_id", "target_ord", quarter_end(F.col("target_ord")).alias("target_end"), "h", "y_hat", (100 * (F.col("y_hat") / F.col("_b") - 1)).alias("qoq"), saar_growth(F.col("y_hat"), F.col("_b")).alias("saar"))


