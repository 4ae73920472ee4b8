"""Autoregressions of every series from every origin at once: least squares from running sums of products, no Python.

The normal equations of an origin are sums over the rows up to it, so one pass of windows gives those of all origins; the small
system of each row is solved, and its path iterated, by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .baselines import at_origins

MODELS = ("ar4", "ar4_growth")
#: A pivot below this share of its diagonal means that the lags are collinear.
TINY = 1e-11


def solved(system: Column, size: int) -> Column:
    """The solution of a positive definite system, given as rows of an array with the right side last; null where a pivot is tiny."""

    def eliminate(rows: Column, k: Column) -> Column:
        row, own = F.get(rows, k), F.get(F.get(system, k), k)
        pivot = F.when(F.abs(F.get(row, k)) > TINY * F.abs(own), F.get(row, k))

        def step(other: Column, i: Column) -> Column:
            scaled = F.transform(row, lambda x: x / pivot)
            less = F.zip_with(other, scaled, lambda x, s: x - F.get(other, k) * s)
            return F.when(i == k, scaled).otherwise(less)

        return F.transform(rows, step)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), system, eliminate)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def ar_forecasts(panel: DataFrame, horizon: int = 4, least: int = 8, names: tuple[str, ...] = MODELS, p: int = 4, origins: DataFrame | None = None) -> DataFrame:
    """(model, series_id, origin_ord, h, target_ord, y_hat, last_y) of AR(p) with a constant on levels (ar4) or on log differences
    (ar4_growth), iterated, from each row with `least` values up to it or from the origins asked for.

    Rows without y don't count; a growth needs two positive levels. Where lags are collinear, as in a constant or a straight series,
    the path is drift (of logs for ar4_growth); with fewer than p rows to learn from, or a path that isn't finite, the last value
    is carried on. Levels are taken relative to the series' first one, and they and growth less their first value, which changes no
    forecast and keeps the sums well scaled where a series varies little about a high level."""
    o = Window.partitionBy("series_id").orderBy("quarter_ord")
    past = o.rowsBetween(Window.unboundedPreceding, 0)
    y, before = F.col("y"), F.lag("y").over(o)
    base = panel.where("y IS NOT NULL").select("series_id", "quarter_ord", "y").withColumns({"n": F.count("y").over(past), "_first": F.first("y").over(past), "_before": before})
    base = base.withColumn("_unit", F.when(F.col("_first") != 0, F.abs("_first")).otherwise(1.0))
    parts = []
    for name in names:
        growth = name.endswith("_growth")
        z = F.when((y > 0) & (F.col("_before") > 0), F.log(y / F.col("_before"))) if growth else y / F.col("_unit")
        lags = base.withColumn("z", z).withColumn("_shift", F.first("z", True).over(past)).withColumn("z", F.col("z") - F.col("_shift"))
        lags = lags.withColumns({f"_l{k}": F.lag("z", k).over(o) for k in range(1, p + 1)})
        whole = F.col("z").isNotNull()
        for k in range(1, p + 1):
            whole = whole & F.col(f"_l{k}").isNotNull()
        x = [F.when(whole, F.lit(1.0)), *[F.when(whole, F.col(f"_l{k}")) for k in range(1, p + 1)], F.when(whole, F.col("z"))]
        sums = {f"_s{i}_{j}": F.sum(x[i] * x[j]).over(past) for i in range(p + 1) for j in range(i, p + 2)}
        made = at_origins(lags.withColumns({**sums, "_rows": F.count(F.when(whole, 1)).over(past)}).where(F.col("n") >= least), origins)
        system = F.array(*[F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") for j in range(p + 2)]) for i in range(p + 1)])
        recent = F.array("z", *[f"_l{k}" for k in range(1, p)])
        made = made.withColumns({"_system": system, "_recent": recent}).withColumn("_b", F.when(F.col("_rows") >= p, solved(F.col("_system"), p + 1)))
        weights = F.slice("_b", 2, p)
        after = lambda state, _: F.concat(F.array(F.aggregate(F.zip_with(weights, F.slice(state, 1, p), lambda b, v: b * v), F.get("_b", F.lit(0)), lambda s, v: s + v)), state)  # noqa: B023, E731
        made = made.withColumn("_path", F.slice(F.reverse(F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_recent"), after)), p + 1, horizon))
        rows = made.select("series_id", F.col("quarter_ord").alias("origin_ord"), y.alias("last_y"), "n", "_rows", "_first", "_unit", "_shift", "_path", F.posexplode(F.coalesce("_path", F.array_repeat(F.lit(None).cast("double"), horizon))).alias("_at", "_v"))
        h = (F.col("_at") + 1).cast("long")
        level = F.when(F.col("_rows") >= p, F.coalesce(_level(growth), _drift(growth, h)))
        level = F.when(~F.isnan(level) & (F.abs(level) < float("inf")), level)
        parts.append(rows.select(F.lit(name).alias("model"), "series_id", "origin_ord", h.alias("h"), (F.col("origin_ord") + h).alias("target_ord"), F.coalesce(level, "last_y").alias("y_hat"), "last_y"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _level(growth: bool) -> Column:
    """The level at a step of a path: of growth, the last level times the exponential of the growth so far."""
    if not growth:
        return (F.col("_v") + F.col("_shift")) * F.col("_unit")
    so_far = F.aggregate(F.slice("_path", F.lit(1), F.col("_at") + 1), F.lit(0.0), lambda s, v: s + v + F.col("_shift"))
    return F.col("last_y") * F.exp(so_far)


def _drift(growth: bool, h: Column) -> Column:
    """The mean change so far, carried on."""
    last, first, steps = F.col("last_y"), F.col("_first"), F.col("n") - 1
    if not growth:
        return last + h * (last - first) / steps
    return F.when((last > 0) & (first > 0), last * F.exp(h * F.log(last / first) / steps))
