"""Pooled trees: what was known at an origin, and nothing after it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagelab.operators import trees


@pytest.fixture(scope="module")
def panel(spark):
    """20 series that follow a covariate with a lag of one row, and a season known ahead."""
    rng = np.random.default_rng(3)
    rows = []
    for s in range(20):
        x = rng.normal(0, 1, 40)
        y = 100.0 * (s + 1)
        for q in range(40):
            if q:
                y *= np.exp(0.02 * x[q - 1] + (0.05 if q % 4 == 0 else -0.01))
            rows.append((f"S{s}", q, float(y), float(x[q]), float(q % 4)))
    return spark.createDataFrame(rows, "series_id string, quarter_ord long, y double, x double, season double").repartition(2, "series_id").cache()


OPTIONS = {"horizon": 4, "least": 16, "refits": 2}


def rows(df):
    return {(r.series_id, r.origin_ord, r.h): r.y_hat for r in df.collect()}


@pytest.mark.parametrize("kind", trees.KINDS)
def test_covariates_change_the_forecast_for_the_better(panel, kind):
    truth = {(r.series_id, r.quarter_ord): r.y for r in panel.collect()}
    plain = rows(trees.tree_forecasts(panel, kind, **OPTIONS))
    told = rows(trees.tree_forecasts(panel, kind, covariates=["x"], known=["season"], **OPTIONS))
    assert set(plain) == set(told) == {(f"S{s}", q, h) for s in range(20) for q in range(15, 40) for h in range(1, 5)}
    error = lambda got: np.mean([abs(np.log(v / truth[s, q + h])) for (s, q, h), v in got.items() if h == 1 and (s, q + h) in truth and v > 0])
    assert plain != told and error(told) < error(plain)


def test_no_row_after_a_cutoff_is_used(panel):
    """Values after the last refit, and covariates after an origin, change no forecast from an origin before them."""
    late = panel.withColumns({"y": F.when(F.col("quarter_ord") > 30, F.col("y") * 7).otherwise(F.col("y")), "x": F.when(F.col("quarter_ord") > 30, 99.0).otherwise(F.col("x"))})
    for kind in ("random_forest", "xgboost_growth"):
        a = rows(trees.tree_forecasts(panel, kind, covariates=["x"], known=["season"], **OPTIONS))
        b = rows(trees.tree_forecasts(late, kind, covariates=["x"], known=["season"], **OPTIONS))
        assert all(b[k] == pytest.approx(v, rel=1e-12) for k, v in a.items() if k[1] <= 30) and any(b[k] != v for k, v in a.items() if k[1] > 31)


def test_known_values_in_rows_without_a_target_are_used(spark, panel):
    more = spark.createDataFrame([(f"S{s}", q, None, None, float(q % 4)) for s in range(20) for q in range(40, 44)], panel.schema)
    told = trees.origin_table(panel.unionByName(more), True, 4, 4, ["x"], ["season"])[0].where("series_id = 'S3' AND quarter_ord = 39").first()
    assert [told[f"a0_{h}"] for h in range(1, 5)] == [0.0, 1.0, 2.0, 3.0]
    carried = trees.origin_table(panel, True, 4, 4, ["x"], ["season"])[0].where("series_id = 'S3' AND quarter_ord = 39").first()
    assert [carried[f"a0_{h}"] for h in range(1, 5)] == [3.0] * 4
    with pytest.raises(ValueError, match="no such trees"):
        trees.tree_forecasts(panel, "bush")


def test_odd_series_give_finite_paths(spark):
    flat = [("flat", q, 5.0) for q in range(20)] + [("minus", q, -1.0 - q) for q in range(20)] + [("short", q, 1.0) for q in range(3)] + [("gaps", q, None if q % 5 == 2 else float(q)) for q in range(30)]
    df = spark.createDataFrame(flat, "series_id string, quarter_ord long, y double")
    for kind in ("random_forest", "random_forest_growth"):
        got = rows(trees.tree_forecasts(df, kind, 2, 10, refits=1))
        assert {k[0] for k in got} >= {"flat", "gaps"} and all(np.isfinite(v) for v in got.values())
    assert rows(trees.tree_forecasts(df.limit(0), "random_forest", 2)) == {}


@pytest.mark.parametrize("kind", ["random_forest", "xgboost"])
def test_sources_are_read_once_however_often_trees_are_fitted(spark, panel, kind):
    read, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(tally):
        def seen(v):
            tally.add(1)
            return v

        return F.udf(seen, "string").asNondeterministic()

    source = panel.withColumn("series_id", counted(read)("series_id"))
    origins = spark.createDataFrame([("S3", 20), ("S3", 20), ("S4", 39), ("S5", 3), ("S99", 20)], "series_id string, origin_ord long")
    some = rows(trees.tree_forecasts(source, kind, origins=origins.withColumn("series_id", counted(asked)("series_id")), covariates=["x"], known=["season"], **OPTIONS))
    assert (read.value, asked.value) == (800, 5)
    every = rows(trees.tree_forecasts(panel, kind, covariates=["x"], known=["season"], **OPTIONS))
    assert set(some) == {(s, q, h) for s, q in (("S3", 20), ("S4", 39)) for h in range(1, 5)} and all(every[k] == v for k, v in some.items())
