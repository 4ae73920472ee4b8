"""Pooled trees over all series: one table of what was known at each origin, walked forward step by step.

A row of the table is an origin: the last values of its series, the series' statistics up to it, the covariates up to it, and those
that are known ahead of the quarter to forecast. Trees are refitted at a few cutoffs, each time on rows whose next value was known
by the cutoff, and score the origins from there up to the next cutoff. A path is `horizon` passes, each of which puts its forecast
in front of the next one's lags; covariates that aren't known ahead are carried on. The table is written to the shared folder
once: each fit and each cutoff's origins read it several times, and what it comes from must not be read as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import staged

KINDS = ("random_forest", "xgboost", "random_forest_growth", "xgboost_growth")


def origin_table(panel: DataFrame, growth: bool, lags: int, horizon: int, covariates: list[str], known: list[str]) -> tuple[DataFrame, list[str]]:
    """(table, features): a row per (series_id, quarter_ord) with a value and `lags` values up to it.

    What a tree learns is z: a level less the series' mean so far, in standard deviations so far, or (growth) a log difference.
    Features are l1, l2, ... (z now and before), s1 and s2 (statistics so far: for levels the mean in deviations and the last
    change, for growth its mean and deviation), c{i}_{k} (a covariate k - 1 rows before, the last one known where it is null, 0
    before all) and a{i} (a covariate known ahead, of the next row). next is z of the next row, a{i}_{h} a covariate h rows on."""
    w = Window.partitionBy("series_id").orderBy("quarter_ord")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.select("series_id", "quarter_ord", "y", *dict.fromkeys([*covariates, *known]))
    rows = rows.withColumns({f"_x{i}": F.coalesce(F.last(c, True).over(past), F.lit(0.0)) for i, c in enumerate(covariates)})
    rows = rows.withColumns({f"a{i}_{h}": F.lead(c, h).over(w) for i, c in enumerate(known) for h in range(1, horizon + 1)} | {f"_k{i}": F.last(c, True).over(past) for i, c in enumerate(known)})
    for i in range(len(known)):  # the last one known is carried on
        for h in range(1, horizon + 1):
            rows = rows.withColumn(f"a{i}_{h}", F.coalesce(f"a{i}_{h}", f"a{i}_{h - 1}" if h > 1 else f"_k{i}", F.lit(0.0)))
    rows = rows.where("y IS NOT NULL")
    y = F.col("y")
    rows = rows.withColumns({"first": F.first("y").over(past), "n": F.count("y").over(past)})
    if growth:
        rows = rows.withColumn("g", F.when((y > 0) & (F.lag("y").over(w) > 0), F.log(y / F.lag("y").over(w))))
        rows = rows.withColumns({"centre": F.lit(0.0), "scale": F.lit(1.0), "s1": F.coalesce(F.avg("g").over(past), F.lit(0.0)), "s2": F.coalesce(F.stddev_pop("g").over(past), F.lit(0.0))})
        z: Column = F.col("g")
        lagged = {f"l{k}": F.lag("g", k - 1).over(w) if k > 1 else z for k in range(1, lags + 1)} | {"next": F.lead("g").over(w)}
    else:
        sd = F.stddev_pop("y").over(past)
        rows = rows.withColumns({"centre": F.avg("y").over(past), "scale": F.when(sd > 0, sd).otherwise(F.when(y != 0, F.abs(y)).otherwise(1.0))})
        scaled = lambda c: (c - F.col("centre")) / F.col("scale")
        lagged = {f"l{k}": scaled(F.lag("y", k - 1).over(w)) if k > 1 else scaled(y) for k in range(1, lags + 1)}
        lagged |= {"next": scaled(F.lead("y").over(w)), "s1": F.col("centre") / F.col("scale"), "s2": F.coalesce((y - F.lag("y").over(w)) / F.col("scale"), F.lit(0.0))}
    rows = rows.withColumns(lagged | {f"c{i}_{k}": F.coalesce(F.lag(f"_x{i}", k - 1).over(w), F.lit(0.0)) if k > 1 else F.col(f"_x{i}") for i in range(len(covariates)) for k in range(1, lags + 1)})
    features = [*[f"l{k}" for k in range(1, lags + 1)], "s1", "s2", *[f"c{i}_{k}" for i in range(len(covariates)) for k in range(1, lags + 1)], *[f"a{i}" for i in range(len(known))]]
    rows = rows.withColumns({f"a{i}": F.col(f"a{i}_1") for i in range(len(known))})
    return rows.where(F.col(f"l{lags}").isNotNull()), features


def tree_forecasts(panel: DataFrame, kind: str = "random_forest", horizon: int = 4, least: int = 12, refits: int = 4, lags: int = 4, seed: int = 7, origins: DataFrame | None = None, covariates: list[str] | None = None, known: list[str] | None = None) -> DataFrame:
    """(model, series_id, origin_ord, h, target_ord, y_hat, last_y) of pooled random forests or boosted trees, on levels or (kind
    with _growth) on growth, from each row with `least` values up to it or from the origins asked for.

    panel has (series_id, quarter_ord, y), `covariates`, of which no value after an origin is used, and `known`, whose values are
    known ahead (a calendar) and may stand in rows without y. Where nothing could be learnt by a cutoff, and where a path isn't
    finite, its origins' paths are drift."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if kind not in KINDS:
        raise ValueError(f"no such trees: {kind}; there are {', '.join(KINDS)}")
    growth, covariates, known = kind.endswith("_growth"), covariates or [], known or []
    table, features = origin_table(panel, growth, lags, horizon, covariates, known)
    if origins is None:
        table = table.withColumn("asked", F.lit(True))
    else:
        some = origins.select("series_id", F.col("origin_ord").alias("quarter_ord"), F.lit(True).alias("asked")).distinct()
        table = table.join(some, ["series_id", "quarter_ord"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    table = staged(table, "tree-origins")
    pack = VectorAssembler(inputCols=features, outputCol="features")
    lo, hi = table.where(F.col("n") >= least).agg(F.min("quarter_ord"), F.max("quarter_ord")).first()
    cuts = sorted({lo + (hi - lo) * k // refits for k in range(refits)}) if lo is not None else [0]
    parts = []
    for at, cut in enumerate(cuts):
        learn = table.where((F.col("quarter_ord") < cut) & F.col("next").isNotNull()) if lo is not None else table.limit(0)
        fit = None
        if not learn.isEmpty():
            learner = RandomForestRegressor if kind.startswith("random_forest") else GBTRegressor
            learn = learn.repartition("series_id").sortWithinPartitions("series_id", "quarter_ord")  # files have no order, and draws and sums follow it
            fit = learner(featuresCol="features", labelCol="next", predictionCol="p", seed=seed, maxDepth=4).fit(pack.transform(learn))
        now = table.where(F.col("asked") & (F.col("n") >= least) & (F.col("quarter_ord") >= cut) & (F.col("quarter_ord") < (cuts[at + 1] if at + 1 < len(cuts) else (hi or 0) + 1)))
        now = now.withColumns({"sum": F.lit(0.0), "path": F.array().cast("array<double>")})
        for h in range(1, horizon + 1):
            now = now.withColumns({f"a{i}": F.col(f"a{i}_{h}") for i in range(len(known))})
            now = fit.transform(pack.transform(now)).drop("features") if fit else now.withColumn("p", F.lit(None).cast("double"))
            total = F.col("sum") + F.col("p")
            level = F.col("y") * F.exp(total) if growth else F.col("centre") + F.col("scale") * F.col("p")
            shifted = {"sum": total, "path": F.array_append("path", level), "l1": F.col("p")} | {f"l{k}": F.col(f"l{k - 1}") for k in range(2, lags + 1)}
            shifted |= {"s2": F.col("p") - F.col("l1")} if not growth else {}
            shifted |= {f"c{i}_{k}": F.col(f"c{i}_{k - 1}") for i in range(len(covariates)) for k in range(2, lags + 1)}
            now = now.withColumns(shifted).drop("p")
        parts.append(now.select("series_id", F.col("quarter_ord").alias("origin_ord"), F.col("y").alias("last_y"), "first", "n", F.posexplode("path").alias("at", "v")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    h = (F.col("at") + 1).cast("long")
    sound = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    drift = F.col("last_y") + h * F.coalesce(F.try_divide(F.col("last_y") - F.col("first"), F.col("n") - 1), F.lit(0.0))
    return out.select(F.lit(kind).alias("model"), "series_id", "origin_ord", h.alias("h"), (F.col("origin_ord") + h).alias("target_ord"), F.coalesce(sound, drift).alias("y_hat"), "last_y")
