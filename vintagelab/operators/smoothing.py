"""Exponential smoothing, theta and local-trend models of every series from every origin at once, by array functions alone.

A series' history is one array. A fold over it leaves the filter's state after each value, for each point of a grid, so the states
at all origins come from one pass; at each origin the point with the best criterion gives the path.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODELS = ("auto_ets", "theta", "local_trend_ssm", "local_trend_ssm_growth")
#: Smoothing of the level with (smoothing of the trend, damping).
LEVELS, TRENDS = (0.1, 0.3, 0.5, 0.7, 0.9), ((0.0, 1.0), (0.1, 0.9), (0.1, 1.0), (0.3, 0.9))
#: Variances of the level and of the trend, in variances of the noise.
LEVEL_NOISE, TREND_NOISE = (0.01, 0.1, 1.0, 10.0), (0.0, 0.001, 0.01, 0.1)
THETA = 0.5
_TINY = 1e-12


def _struct(**fields: Column | float) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(k) for k, x in fields.items()])


def _grid(points: Sequence[dict[str, float]]) -> Column:
    return F.array(*[_struct(k=float(k), **p) for k, p in enumerate(points)])


def _states(values: Column, start: dict[str, Column | float], step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """The state after each of the values, from a start."""
    names = list(start)
    empty = F.array().cast("array<struct<" + ",".join(f"{n}:double" for n in names) + ">>")

    def one(acc: Column, v: Column) -> Column:
        now = _struct(**step(acc["now"], v))
        return F.transform(F.array(now), lambda s: F.struct(s.alias("now"), F.array_append(acc["out"], s).alias("out")))[0]

    return F.aggregate(values, F.struct(_struct(**{n: (x if isinstance(x, Column) else F.lit(float(x))) for n, x in start.items()}).alias("now"), empty.alias("out")), one, lambda acc: acc["out"])


def _ets(y: Column, least: int, horizon: int) -> Column:
    """Simple or damped-trend smoothing, by corrected AIC; the trend begins with the mean change to the fifth value."""
    points = _grid([{"a": a, "b": b, "phi": phi} for a in LEVELS for b, phi in TRENDS])

    def run(g: Column) -> Column:
        def step(s: Column, v: Column) -> dict[str, Column]:
            forecast = s["level"] + g["phi"] * s["trend"]
            e = v - forecast
            return {"level": forecast + g["a"] * e, "trend": g["phi"] * s["trend"] + g["a"] * g["b"] * e, "sse": s["sse"] + e * e}

        first = F.get(y, F.lit(0))
        return _states(F.slice(y, 2, F.size(y)), {"level": first, "trend": F.when(g["b"] > 0, (F.get(y, F.lit(4)) - first) / 4).otherwise(0.0), "sse": 0.0}, step)

    def best(runs: Column, n: Column) -> Column:
        def rated(r: Column, g: Column) -> Column:
            s, k = F.get(r, n - 2), F.when(g["b"] > 0, 4).otherwise(2)
            aic = n * F.log(s["sse"] / n + _TINY) + 2 * k + 2 * k * (k + 1) / F.greatest(F.lit(1), n - k - 1)
            return _struct(aic=aic, k=g["k"], level=s["level"], trend=s["trend"], phi=g["phi"])

        return F.array_min(F.zip_with(runs, points, rated))

    damp = lambda s, h: F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.lit(0.0), lambda t, i: t + F.pow(s["phi"], i))
    path = lambda s: F.array(*[s["level"] + s["trend"] * damp(s, h) for h in range(1, horizon + 1)])
    return _paths(F.transform(points, run), y, least, best, path)


def _theta(y: Column, least: int, horizon: int) -> Column:
    """Simple smoothing and half of the least-squares trend."""
    first = F.get(y, F.lit(0))

    def step(s: Column, v: Column) -> dict[str, Column]:
        return {"level": s["level"] + THETA * (v - s["level"]), "t": s["t"] + 1, "sum": s["sum"] + v - first, "moment": s["moment"] + (s["t"] + 1) * (v - first)}

    runs = F.array(_states(F.slice(y, 2, F.size(y)), {"level": first, "t": 0.0, "sum": 0.0, "moment": 0.0}, step))

    def best(runs: Column, n: Column) -> Column:
        s = F.get(F.get(runs, F.lit(0)), n - 2)
        return _struct(level=s["level"], slope=(s["moment"] - (n - 1) / 2 * s["sum"]) / (n * (n * n - 1) / 12.0))

    path = lambda s: F.array(*[s["level"] + s["slope"] / 2 * (h - 1 + 1 / THETA) for h in range(1, horizon + 1)])
    return _paths(runs, y, least, best, path)


def _local_trend(y: Column, least: int, horizon: int) -> Column:
    """A local linear trend by Kalman filter, with the noise's variance concentrated out of the likelihood."""
    points = _grid([{"q1": q1, "q2": q2} for q1 in LEVEL_NOISE for q2 in TREND_NOISE])

    def run(g: Column) -> Column:
        def step(s: Column, v: Column) -> dict[str, Column]:
            f, e, counts = s["p00"] + 1.0, v - s["a0"], s["n"] > 1
            k0, k1 = s["p00"] / f, s["p01"] / f
            p00, p01, p11 = s["p00"] * (1 - k0), s["p01"] * (1 - k0), s["p11"] - k1 * s["p01"]
            a1 = s["a1"] + k1 * e
            return {
                "a0": s["a0"] + k0 * e + a1, "a1": a1, "p00": p00 + 2 * p01 + p11 + g["q1"], "p01": p01 + p11, "p11": p11 + g["q2"], "n": s["n"] + 1,
                "like": F.when(counts, s["like"] - 0.5 * F.log(f)).otherwise(s["like"]), "scale": F.when(counts, s["scale"] + e * e / f).otherwise(s["scale"]),
            }

        return _states(y, {"a0": F.get(y, F.lit(0)), "a1": 0.0, "p00": 1e7, "p01": 0.0, "p11": 1e7, "n": 0.0, "like": 0.0, "scale": 0.0}, step)

    def best(runs: Column, n: Column) -> Column:
        free = F.greatest(F.lit(1), n - 2)

        def rated(r: Column, g: Column) -> Column:
            s = F.get(r, n - 1)
            return _struct(loss=0.5 * free * F.log(s["scale"] / free + _TINY) - s["like"], k=g["k"], a0=s["a0"], a1=s["a1"])

        return F.array_min(F.zip_with(runs, points, rated))

    path = lambda s: F.array(*[s["a0"] + s["a1"] * (h - 1) for h in range(1, horizon + 1)])
    return _paths(F.transform(points, run), y, least, best, path)


def _paths(runs: Column, y: Column, least: int, best: Callable[[Column, Column], Column], path: Callable[[Column], Column]) -> Column:
    """(n, path) from each n values, n from `least` on."""
    counts = F.when(F.size(y) >= least, F.sequence(F.lit(least), F.size(y))).otherwise(F.array().cast("array<int>"))
    each = lambda r: F.transform(counts, lambda n: F.transform(F.array(best(r, n)), lambda s: F.struct(n.alias("n"), path(s).alias("path")))[0])
    return F.transform(F.array(runs), each)[0]


def smoothed_forecasts(panel: DataFrame, horizon: int = 4, least: int = 8, names: Sequence[str] = MODELS, origins: DataFrame | None = None) -> DataFrame:
    """(model, series_id, origin_ord, h, target_ord, y_hat, last_y) of the models named, from each row with `least` values up to it or
    from the origins asked for.

    Rows without y don't count. A path that isn't finite is drift; local_trend_ssm_growth works on log differences and carries the
    last value on where a value up to the origin isn't positive or there are fewer than nine. A history is one array of its
    series' row, which bounds a series to what a row can hold."""
    if least < 5:
        raise ValueError("smoothing needs five values or more before an origin")
    known = panel.where("y IS NOT NULL").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("quarter_ord", F.col("y").cast("double").alias("y")))).alias("_r"))
    known = known.select("series_id", F.transform("_r", lambda r: r["quarter_ord"]).alias("_q"), F.transform("_r", lambda r: r["y"]).alias("_y"))
    y, parts = F.col("_y"), []
    logs = F.transform(F.sequence(F.lit(1), F.size(y) - 1), lambda i: F.when((F.get(y, i) > 0) & (F.get(y, i - 1) > 0), F.log(F.get(y, i) / F.get(y, i - 1))))
    for name in names:
        growth = name.endswith("_growth")
        rule = {"auto_ets": _ets, "theta": _theta, "local_trend_ssm": _local_trend, "local_trend_ssm_growth": _local_trend}[name]
        rows = known.where(F.size(y) >= least).withColumn("_z", logs if growth else y)
        rows = rows.withColumn("_positive", F.coalesce(F.nullif(F.array_position(F.transform(y, lambda v: v <= 0), F.lit(True)) - 1, F.lit(-1)), F.size(y).cast("long")))
        rows = rows.select("series_id", "_q", "_y", "_positive", F.explode(rule(F.col("_z"), least - growth, horizon)).alias("p"))
        n = F.col("p.n") + F.lit(int(growth))
        rows = rows.select("series_id", F.get("_q", n - 1).alias("origin_ord"), F.get("_y", n - 1).alias("last_y"), F.get("_y", F.lit(0)).alias("_first"), n.alias("_n"), ((n >= 9) & (n <= F.col("_positive"))).alias("_sound"), F.posexplode("p.path").alias("_at", "_v"), F.col("p.path").alias("_path"))
        if origins is not None:
            rows = rows.join(origins.select("series_id", "origin_ord").distinct(), ["series_id", "origin_ord"], "left_semi")
        h = (F.col("_at") + 1).cast("long")
        level = F.col("_v")
        if growth:
            so_far = F.aggregate(F.slice("_path", F.lit(1), F.col("_at") + 1), F.lit(0.0), lambda s, v: s + v)
            level = F.when(F.col("_sound"), F.col("last_y") * F.exp(so_far)).otherwise(F.col("last_y"))
        drift = F.col("last_y") + h * (F.col("last_y") - F.col("_first")) / F.greatest(F.lit(1), F.col("_n") - 1)
        sound = F.when(~F.isnan(level) & (F.abs(level) < float("inf")), level)
        parts.append(rows.select(F.lit(name).alias("model"), "series_id", "origin_ord", h.alias("h"), (F.col("origin_ord") + h).alias("target_ord"), F.coalesce(sound, drift).alias("y_hat"), "last_y"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
