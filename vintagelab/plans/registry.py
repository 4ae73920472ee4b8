"""Models by name: which job makes each one's forecasts, and the sets in use."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import levels_from_growth
from ..operators import autoregression, baselines, models, smoothing, trees

RANDOM = ("random_normal", "random_uniform", "random_permutation")
TREES = trees.KINDS
#: Other names of a model.
ALIASES = {"naive": "naive_last", "last": "naive_last", "snaive": "seasonal_naive", "rw_drift": "rw_drift_log", "gbt": "xgboost", "rf": "random_forest", "ets": "auto_ets", "arima": "auto_arima", "bvar_minnesota_8": "bvar_minnesota", "bvar_minnesota_growth_8": "bvar_minnesota_growth"}
SETS = {
    "smoke": ["naive_last", "drift", "seasonal_naive"],
    "fast": [*baselines.MODELS, "ar4", "ar4_growth", "theta"],
    "standard": [*baselines.MODELS, "ar4", "ar4_growth", "auto_ets", "theta", "auto_arima", "local_trend_ssm", "bvar_minnesota", "factor_pca_qd"],
    "full": [*baselines.MODELS, *RANDOM, *autoregression.MODELS, *smoothing.MODELS, *models.REGISTRY, *TREES],
}


#: Models of users by name: ("frame" or "pandas", function).
OWN: dict[str, tuple[str, Callable]] = {}


def register_model(name: str, fn: Callable, kind: str = "pandas") -> None:
    """Adds a model under a name that isn't taken.

    "pandas": fn(history) gets the rows (series_id, quarter_ord, y and covariates) up to one origin in order and returns rows
    (h, y_hat); Spark runs it for each series and origin. "frame": fn(panel, horizon, origins) returns the columns of forecast() by
    DataFrame operations alone; origins is None for all."""
    if kind not in ("pandas", "frame"):
        raise ValueError(f"no such kind of model: {kind}")
    if name != name.lower() or name in ALIASES or name in {*baselines.MODELS, *RANDOM, *TREES, *autoregression.MODELS, *smoothing.MODELS, *models.REGISTRY, *OWN}:
        raise ValueError(f"the name is taken, or isn't in lower case: {name}")
    OWN[name] = (kind, fn)


def _by_origin(panel: DataFrame, name: str, fn: Callable, horizon: int, least: int, origins: DataFrame | None) -> DataFrame:
    """Forecasts of a function of each origin's history."""
    known = panel.where("y IS NOT NULL")
    counted = known.select("series_id", F.col("quarter_ord").alias("origin_ord"), F.count("y").over(Window.partitionBy("series_id").orderBy("quarter_ord")).alias("_n"))
    asked = baselines.at_origins(counted.where(F.col("_n") >= least), origins, "origin_ord").drop("_n")
    rows = known.join(asked, "series_id").where("quarter_ord <= origin_ord")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="origin_ord").sort_values("quarter_ord", ignore_index=True)
        made = fn(pdf)
        h = made["h"].to_numpy()
        if sorted(h) != list(range(1, horizon + 1)):
            raise ValueError(f"{name} must give the steps 1 to {horizon}, and gave {sorted(h)}")
        return pd.DataFrame({"model": name, "series_id": key[0], "origin_ord": key[1], "h": h, "target_ord": key[1] + h, "y_hat": made["y_hat"].to_numpy(float), "last_y": pdf["y"].iloc[-1]})

    return rows.groupBy("series_id", "origin_ord").applyInPandas(run, "model string, series_id string, origin_ord long, h long, target_ord long, y_hat double, last_y double")


def canonical(names: list[str]) -> list[str]:
    """Names without aliases and repeats, in order; an unknown one is an error."""
    out = list(dict.fromkeys(ALIASES.get(n.lower(), n.lower()) for n in names))
    known = {*baselines.MODELS, *RANDOM, *TREES, *autoregression.MODELS, *smoothing.MODELS, *models.REGISTRY, *OWN}
    if unknown := [n for n in out if n not in known]:
        raise ValueError(f"unknown models: {unknown}")
    return out


def forecast(panel: DataFrame, names: list[str], horizon: int = 4, least: int = 8, covariates: list[str] | None = None, origins: DataFrame | None = None) -> DataFrame:
    """(model, series_id, origin_ord, h, target_ord, y_hat, last_y) of any models over all series and origins, or over the origins
    (series_id, origin_ord) asked for."""
    names, parts = canonical(names), []
    if base := tuple(n for n in names if n in baselines.MODELS):
        parts.append(baselines.baseline_forecasts(panel, horizon, least, base, origins))
    if any(n in RANDOM for n in names):
        parts.append(baselines.random_forecasts(panel, horizon, least, origins=origins).where(F.col("model").isin(names)))
    if own := tuple(n for n in names if n in autoregression.MODELS):
        parts.append(autoregression.ar_forecasts(panel, horizon, max(least, 8), own, origins=origins))
    if smooth := tuple(n for n in names if n in smoothing.MODELS):
        parts.append(smoothing.smoothed_forecasts(panel, horizon, max(least, 8), smooth, origins))
    if fitted := [n for n in names if n in models.REGISTRY]:
        parts.append(models.fitted_forecasts(panel, fitted, horizon, max(least, 8), covariates, origins).drop("error"))
    for n in names:
        if n in OWN:
            kind, fn = OWN[n]
            parts.append(fn(panel, horizon, origins) if kind == "frame" else _by_origin(panel, n, fn, horizon, least, origins))
        if n in TREES:
            parts.append(trees.tree_forecasts(panel, n, horizon, max(least, 8), origins=origins, covariates=covariates))
    columns = ["model", "series_id", "origin_ord", "h", "target_ord", "y_hat", "last_y"]
    return reduce(DataFrame.unionByName, [p.select(columns) for p in parts])


def on_growth(panel: DataFrame, names: list[str], horizon: int = 4, least: int = 8) -> DataFrame:
    """Any models on annualised growth instead of levels, recomposed: a path that is null is the last growth compounded, and
    without one the last level."""
    from ..functions.scalars import saar_growth

    w = Window.partitionBy("series_id").orderBy("quarter_ord")
    growth = panel.select("series_id", "quarter_ord", F.col("y").alias("_level"), saar_growth(F.col("y"), F.lag("y").over(w)).alias("y"))
    made = forecast(growth.where("y IS NOT NULL").drop("_level"), names, horizon, least)
    level = growth.select("series_id", F.col("quarter_ord").alias("origin_ord"), "_level")
    made = made.join(level, ["series_id", "origin_ord"]).withColumn("g", F.coalesce("y_hat", "last_y"))
    out = levels_from_growth(made, ["model", "series_id", "origin_ord"], "h", "g", F.col("_level"))
    return out.select(F.concat("model", F.lit("_on_growth")).alias("model"), "series_id", "origin_ord", "h", "target_ord", F.coalesce("level", "_level").alias("y_hat"), F.col("_level").alias("last_y"))
