"""Fitted models, one Spark task per group of series: a function forecasts a series from all its origins.

Series, not origins, are the groups, so a history is shipped once and every origin takes its prefix. Functions get an array of
past targets (and aligned covariates with their future values) and return `horizon` values; one that fails or has a short
history falls back to drift. Own methods are added by register().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Forecast = Callable[[np.ndarray, int, np.ndarray | None, np.ndarray | None], np.ndarray]
REGISTRY: dict[str, Forecast] = {}


def register(name: str, fn: Forecast) -> None:
    """Adds a model: fn(past, horizon, past covariates or None, future covariates or None) -> forecasts."""
    REGISTRY[name] = fn


def drift(y: np.ndarray, horizon: int) -> np.ndarray:
    slope = (y[-1] - y[0]) / max(1, len(y) - 1)
    return y[-1] + slope * np.arange(1, horizon + 1)


def _ols(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(x, y, rcond=None)[0]


def on_growth(model: Callable[..., np.ndarray], covariates: bool = False) -> Forecast:
    """A model of log differences, recomposed to levels; with covariates it gets these too."""

    def run(y, horizon, x=None, fx=None):
        if (y <= 0).any() or len(y) < 9:
            return np.full(horizon, y[-1])
        more = (x[1:] if x is not None else None, fx) if covariates else ()
        return y[-1] * np.exp(np.cumsum(model(np.diff(np.log(y)), horizon, *more)))

    return run


def auto_ar(y: np.ndarray, horizon: int) -> np.ndarray:
    """AR(p), p up to 8, on levels or differences, by corrected AIC."""
    best = (np.inf, None)
    for d in (0, 1):
        z = np.diff(y, n=d)
        for p in range(0, min(8, len(z) // 4) + 1):
            rows = np.column_stack([np.ones(len(z) - p), *(z[p - k : len(z) - k] for k in range(1, p + 1))])
            b = _ols(rows, z[p:])
            n, k = len(z) - p, p + 2
            aic = np.log(((z[p:] - rows @ b) ** 2).mean() + 1e-12) + (2 * k + 2 * k * (k + 1) / max(1, n - k - 1)) / n
            if aic < best[0]:
                best = (aic, (d, p, b))
    d, p, b = best[1]
    past = list(np.diff(y, n=d))
    for _ in range(horizon):
        past.append(b[0] + sum(b[k] * past[-k] for k in range(1, p + 1)))
    tail = np.array(past[-horizon:])
    return y[-1] + np.cumsum(tail) if d else tail


def minnesota(y: np.ndarray, horizon: int, x: np.ndarray | None, fx: np.ndarray | None, most: int = 7, strength: float = 6.0, own: float = 1.0) -> np.ndarray:
    """A VAR(2) of the target and its first `most` covariates, each equation a ridge regression to a Minnesota prior whose penalty
    is strength times the squared weight of a coefficient; known future covariates are used as they are."""
    if x is not None:
        x, fx = x[:, :most], fx[:, :most] if fx is not None else None
    z = np.column_stack([y, x]) if x is not None and x.size else y[:, None]
    mean, sd = z.mean(axis=0), z.std(axis=0) + 1e-9
    z = (z - mean) / sd
    t, k = z.shape
    if t < 10:
        return drift(y, horizon)
    rows = np.column_stack([np.ones(t - 2), z[1:-1], z[:-2]])
    coefficients = []
    for i in range(k):
        w, prior = [0.2], [0.0]
        for lag in (1, 2):
            decay = lag**1.5
            for j in range(k):
                w.append((0.3 if lag == 1 else 1.0) * decay if i == j else 2.0 * decay)
                prior.append(own if i == j and lag == 1 else 0.0)
        lam, prior = strength * np.array(w) ** 2, np.array(prior)
        coefficients.append(np.linalg.solve(rows.T @ rows + np.diag(lam), rows.T @ z[2:, i] + lam * prior))
    b, past = np.array(coefficients), [z[-2], z[-1]]
    for h in range(horizon):
        new = b @ np.concatenate(([1.0], past[-1], past[-2]))
        if fx is not None and k > 1:
            new[1:] = (fx[h] - mean[1:]) / sd[1:]
        past.append(new)
    return np.array([v[0] for v in past[2:]]) * sd[0] + mean[0]


def factors(y: np.ndarray, horizon: int, x: np.ndarray | None, fx: np.ndarray | None, count: int = 6, lags: int = 2, alpha: float = 1.0) -> np.ndarray:
    """Principal components of the standardised covariates; ridge on lags and factors, iterated."""
    if len(y) < 12:
        return drift(y, horizon)
    m, s = y.mean(), y.std() + 1e-9
    z = (y - m) / s
    parts = np.zeros((len(y) + horizon, 0))
    if x is not None and x.size:
        every = np.vstack([x, fx])
        std = (every - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
        _, _, v = np.linalg.svd(std[: len(y)], full_matrices=False)
        parts = std @ v[:count].T
    rows = np.column_stack([*(z[lags - k : len(z) - k] for k in range(1, lags + 1)), parts[lags : len(y)]])
    cm, ym = rows.mean(axis=0), z[lags:].mean()
    b = np.linalg.solve((rows - cm).T @ (rows - cm) + alpha * np.eye(rows.shape[1]), (rows - cm).T @ (z[lags:] - ym))
    past = list(z)
    for h in range(horizon):
        past.append(ym + (np.concatenate((past[: -lags - 1 : -1], parts[len(y) + h])) - cm) @ b)
    return np.array(past[len(y) :]) * s + m


for _name, _fn in {
    "auto_arima": lambda y, h, x, fx: auto_ar(y, h),
    "auto_arima_growth": on_growth(auto_ar),
    "bvar_minnesota": minnesota,
    "bvar_minnesota_20": lambda y, h, x, fx: minnesota(y, h, x, fx, 19, 7.0),
    "bvar_minnesota_growth": on_growth(lambda g, h, x, fx: minnesota(g, h, x, fx, own=0.0), covariates=True),
    "bvar_minnesota_growth_20": on_growth(lambda g, h, x, fx: minnesota(g, h, x, fx, 19, 7.0, 0.0), covariates=True),
    "factor_pca_qd": factors,
}.items():
    register(_name, _fn)


def fitted_forecasts(panel: DataFrame, names: list[str], horizon: int = 4, least: int = 12, covariates: list[str] | None = None, origins: DataFrame | None = None) -> DataFrame:
    """(model, series_id, origin_ord, h, target_ord, y_hat, last_y, error) of registered models from every origin of every series,
    or from the origins (series_id, origin_ord) asked for, so that a model is fitted for these alone.

    panel has (series_id, quarter_ord, y) and the covariates, whose values after an origin are carried on from it. A model that
    fails gives drift and its error's text; groups are series, whose histories are short."""
    columns = list(covariates or [])
    chosen = {n: REGISTRY[n] for n in names}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["y"]).sort_values("quarter_ord")
        y, q = pdf["y"].to_numpy(float), pdf["quarter_ord"].to_numpy()
        x = pdf[columns].ffill().bfill().fillna(0.0).to_numpy(float) if columns else None
        out = []
        asked = pdf["asked"].to_numpy(bool)
        for at in range(least, len(y) + 1):
            if not asked[at - 1]:
                continue
            past = x[:at] if x is not None else None
            future = np.repeat(past[-1:], horizon, axis=0) if past is not None else None
            for name, fn in chosen.items():
                error = None
                try:
                    path = np.asarray(fn(y[:at], horizon, past, future), float)
                    if path.shape != (horizon,) or not np.isfinite(path).all():
                        raise ValueError("no finite path of the full horizon")
                except (ValueError, np.linalg.LinAlgError, ZeroDivisionError) as e:
                    path, error = drift(y[:at], horizon), str(e)
                out += [(name, pdf["series_id"].iloc[0], q[at - 1], h + 1, q[at - 1] + h + 1, path[h], y[at - 1], error) for h in range(horizon)]
        return pd.DataFrame(out, columns=["model", "series_id", "origin_ord", "h", "target_ord", "y_hat", "last_y", "error"])

    rows = panel.select("series_id", "quarter_ord", "y", *columns)
    if origins is None:
        rows = rows.withColumn("asked", F.lit(True))
    else:
        some = origins.select("series_id", F.col("origin_ord").alias("quarter_ord"), F.lit(True).alias("asked")).distinct()
        rows = rows.join(some, ["series_id", "quarter_ord"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    return rows.groupBy("series_id").applyInPandas(run, "model string, series_id string, origin_ord long, h long, target_ord long, y_hat double, last_y double, error string")
