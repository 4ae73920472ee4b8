"""Diebold-Mariano tests over runs, from running sums, against each run taken by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagelab.operators import evaluate


def by_hand(d, h):
    n, c = len(d), np.array(d) - np.mean(d)
    lrv = sum(c * c) / n + 2 * sum(float(c[k:] @ c[:-k]) / n for k in range(1, min(h, n)))
    if lrv <= 1e-10 * np.mean(c * c) or n < 2:
        return np.mean(d), None
    return np.mean(d), np.mean(d) / np.sqrt(lrv / n) * np.sqrt(max(0.0, (n + 1 - 2 * h + h * (h - 1) / n) / n))


@pytest.mark.parametrize("window", [3, 8, 40])
def test_runs_equal_each_run_by_itself(spark, window):
    rng = np.random.default_rng(window)
    series = {("a", 1): rng.normal(0.3, 1, 60), ("a", 4): rng.normal(-2, 1, 60), ("b", 2): rng.normal(1e6, 1, 41), ("b", 3): rng.normal(0, 1, 9), ("c", 9): rng.normal(0, 1, 30), ("d", 2): np.array([1.0, 2.0]), ("d", 3): np.array([5.0]), ("e", 2): np.concatenate((np.zeros(50), [7.0, -7.0])), ("f", 1): np.full(20, 3.0)}
    rows = [(m, h, 10 + 2 * i, float(x)) for (m, h), d in series.items() for i, x in enumerate(d)]
    df = spark.createDataFrame(rows, "model string, h long, origin_ord long, d double").repartition(3)
    got = {(r.model, r.h, r.window_end): r for r in evaluate.rolling_diebold_mariano(df, window).collect()}
    want = {}
    for (m, h), d in series.items():
        width = min(window, len(d) - 1)
        for end in range(width, len(d) + 1) if width else []:
            want[m, h, end] = (width, *by_hand(d[end - width : end], h))
    assert set(got) == set(want)
    for key, (n, mean, dm) in want.items():
        r = got[key]
        assert r.n == n and r.mean_d == pytest.approx(mean, rel=1e-7, abs=1e-9), key
        assert (r.dm is None) == (dm is None) and (dm is None or r.dm == pytest.approx(dm, rel=1e-4, abs=1e-7)), (key, r, dm)
    whole = {(r.model, r.h): r for r in evaluate.diebold_mariano(df).collect()}
    for (m, h), d in series.items():
        mean, dm = by_hand(d, h)
        assert whole[m, h].n == len(d) and (whole[m, h].dm is None) == (dm is None) and (dm is None or whole[m, h].dm == pytest.approx(dm, rel=1e-6))
    top = {(r.model, r.h): r.max_stat for r in evaluate.fluctuation(df, window).collect()}
    for (m, h), d in series.items():
        width = min(window, len(d) - 1)
        if width and np.std(d) > 0:
            best = max(abs(np.mean(d[e - width : e])) * np.sqrt(width) / np.std(d) for e in range(width, len(d) + 1))
            assert top[m, h] == pytest.approx(best, rel=1e-7)


def test_plans_keep_a_row_per_origin(spark):
    df = spark.createDataFrame([("a", 1, i, float(i % 3)) for i in range(50)], "model string, h long, origin_ord long, d double")
    for out in (evaluate.diebold_mariano(df), evaluate.rolling_diebold_mariano(df), evaluate.fluctuation(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "collect_list" not in plan
    assert evaluate.rolling_diebold_mariano(df.limit(0)).count() == 0


def test_steps_with_more_lags_end_with_an_error(spark):
    df = spark.createDataFrame([("a", 20, i, float(i % 3)) for i in range(50)], "model string, h long, origin_ord long, d double")
    with pytest.raises(Exception, match="steps of up to 13 can be tested"):
        evaluate.diebold_mariano(df).collect()
    assert evaluate.diebold_mariano(df, lags=19).where(F.col("n") == 50).count() == 1
