"""Smoothing models from array folds against the recursions written out in NumPy."""

import numpy as np
import pytest

from vintagelab.operators import smoothing


def exponential(y, horizon):
    best, n = (np.inf, None), len(y)
    for a in smoothing.LEVELS:
        for b, phi in smoothing.TRENDS:
            level, trend, sse = y[0], (y[4] - y[0]) / 4 if b else 0.0, 0.0
            for v in y[1:]:
                forecast = level + phi * trend
                e = v - forecast
                sse, level, trend = sse + e * e, forecast + a * e, phi * trend + a * b * e
            k = 4 if b else 2
            aic = n * np.log(sse / n + 1e-12) + 2 * k + 2 * k * (k + 1) / max(1, n - k - 1)
            if aic < best[0]:
                best = (aic, level + np.cumsum(phi ** np.arange(1, horizon + 1)) * trend)
    return best[1]


def theta(y, horizon):
    level = y[0]
    for v in y[1:]:
        level += 0.5 * (v - level)
    return level + np.polyfit(np.arange(len(y)), y, 1)[0] / 2 * (np.arange(horizon) + 2)


def local_trend(y, horizon):
    best = (-np.inf, None)
    t = np.array([[1.0, 1.0], [0.0, 1.0]])
    for q1 in smoothing.LEVEL_NOISE:
        for q2 in smoothing.TREND_NOISE:
            a, p, like, scale = np.array([y[0], 0.0]), np.diag([1e7, 1e7]), 0.0, 0.0
            for n, v in enumerate(y):
                f, e = p[0, 0] + 1.0, v - a[0]
                if n > 1:
                    like, scale = like - 0.5 * np.log(f), scale + e * e / f
                k = p[:, 0] / f
                a, p = t @ (a + k * e), t @ (p - np.outer(k, p[0])) @ t.T + np.diag([q1, q2])
            free = max(1, len(y) - 2)
            like -= 0.5 * free * np.log(scale / free + 1e-12)
            if like > best[0]:
                best = (like, a)
    return best[1][0] + best[1][1] * np.arange(horizon)


def growth(y, horizon):
    if min(y) <= 0 or len(y) < 9:
        return np.full(horizon, y[-1])
    return y[-1] * np.exp(np.cumsum(local_trend(np.diff(np.log(y)), horizon)))


BY_HAND = {"auto_ets": exponential, "theta": theta, "local_trend_ssm": local_trend, "local_trend_ssm_growth": growth}


@pytest.mark.parametrize("name", smoothing.MODELS)
def test_all_origins_equal_the_recursion(spark, name):
    rng = np.random.default_rng(8)
    paths = {"walk": 100 + np.cumsum(rng.normal(0.5, 1, 26)), "noise": 50 + rng.normal(0, 3, 20), "curve": 5 * np.exp(np.cumsum(rng.normal(0.02, 0.03, 22))), "sign": rng.normal(0, 1, 14), "short": np.arange(6.0)}
    rows = [(s, 10 + 2 * i, float(v)) for s, y in paths.items() for i, v in enumerate(y)] + [("walk", 99, None), ("none", 1, None)]
    p = spark.createDataFrame(rows, "series_id string, quarter_ord long, y double").repartition(3)
    got = {(r.series_id, r.origin_ord, r.h): (r.y_hat, r.last_y, r.target_ord) for r in smoothing.smoothed_forecasts(p, 3, 8, (name,)).collect()}
    want = {(s, 10 + 2 * (n - 1)): BY_HAND[name](y[:n], 3) for s, y in paths.items() for n in range(8, len(y) + 1)}
    assert set(got) == {(*k, h) for k in want for h in (1, 2, 3)}
    for (s, q), path in want.items():
        assert [got[s, q, h][0] for h in (1, 2, 3)] == pytest.approx(list(path), rel=1e-6, abs=1e-8), (s, q)
        assert got[s, q, 2][1:] == (paths[s][(q - 10) // 2], q + 2)


def test_asked_origins_and_odd_tables(spark):
    p = spark.createDataFrame([("flat", q, 7.0) for q in range(15)] + [("line", q, 2.0 * q) for q in range(15)], "series_id string, quarter_ord long, y double")
    some = spark.createDataFrame([("line", 14), ("line", 14), ("flat", 9), ("none", 3)], "series_id string, origin_ord long")
    got = smoothing.smoothed_forecasts(p, 2, 8, origins=some).collect()
    assert len(got) == 2 * 2 * 4 and all(r.y_hat == pytest.approx(7.0) for r in got if r.series_id == "flat")
    assert all(abs(r.y_hat - 2.0 * (14 + r.h)) < 1.1 for r in got if r.series_id == "line" and r.model in ("auto_ets", "local_trend_ssm"))
    long = spark.createDataFrame([("line", q, 100 + 1.5 * q) for q in range(40)], "series_id string, quarter_ord long, y double")
    end = spark.createDataFrame([("line", 39)], "series_id string, origin_ord long")
    assert all(abs(r.y_hat - (100 + 1.5 * (39 + r.h))) < 0.5 for r in smoothing.smoothed_forecasts(long, 4, 8, ("local_trend_ssm",), end).collect())
    assert smoothing.smoothed_forecasts(p.limit(0)).count() == 0
    with pytest.raises(ValueError, match="five values"):
        smoothing.smoothed_forecasts(p, least=3)
