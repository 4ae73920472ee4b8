"""The window evaluation by stages, its guards, and ensembles of the realtime job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vintagelab.plans import evaluation, pipelines

D = dt.date.fromisoformat


@pytest.fixture(scope="module")
def history(spark):
    """24 quarters, each released 35 days after its end, revised 30 and 60 days later, when the quarter before is revised, too."""
    rows = []
    for i in range(24):
        start = dt.date(2015 + i // 4, i % 4 * 3 + 1, 1)
        end = dt.date(2015 + (i + 1) // 4, (i + 1) % 4 * 3 + 1, 1) - dt.timedelta(1)
        for s, scale in (("A", 1.0), ("B|x", 3.0)):
            rows += [(s, start, end + dt.timedelta(35 + 30 * k), scale * (100 + 1.5 * i + (i % 3) + 0.1 * k)) for k in range(3)]
            if i:
                before = dt.date(2015 + (i - 1) // 4, (i - 1) % 4 * 3 + 1, 1)
                rows += [(s, before, end + dt.timedelta(35 + 30 * k), scale * (100 + 1.5 * (i - 1) + ((i - 1) % 3) + 0.3)) for k in range(3)]
    return spark.createDataFrame(rows, "series_id string, obs_date date, asof_date date, value double").dropDuplicates(["series_id", "obs_date", "asof_date"])


def test_metrics_and_stages_are_resolved():
    assert [evaluation.resolve_metric(t) for t in ("level", "log_level", "qoq", "saar")] == ["level", "level", "release_qoq", "release_saar"]
    assert evaluation.resolve_metric("saar", "Panel_SAAR ") == "panel_saar" and evaluation.resolve_metric("saar", "level") == "level"
    for transform, metric in (("level", "release_saar"), ("saar", "release_qoq"), ("qoq", "panel_saar"), ("level", "other"), ("cubes", "auto")):
        with pytest.raises(ValueError):
            evaluation.resolve_metric(transform, metric)
    assert evaluation.resolve_stages("level") == ["first"] and evaluation.resolve_stages("level", ["Third", "first", "third"]) == ["third", "first"]
    assert evaluation.resolve_stages("level", "latest") == ["latest"]
    with pytest.raises(ValueError, match="not latest"):
        evaluation.resolve_stages("release_saar", ["first", "latest"])
    assert [evaluation.exchange_label(t) for t in evaluation.TRANSFORMS] == ["levels", "levels", "pop", "pop"] and evaluation.exchange_label("level", "yoy") == "yoy"


def test_windows_train_on_their_vintage_alone(history):
    out = evaluation.run(history, ["naive_last", "drift"], "naive_last", ["first", "third"], windows=3, horizon=2)
    records = out["records"].collect()
    assert {r.stage for r in records} == {"first", "third"} and {r.series_id for r in records} == {"A", "B|x"} and {r.window_idx for r in records} == {0, 1, 2}
    seen = {(r.series_id, r.obs_date, r.asof_date): r.value for r in history.collect()}
    for r in records:
        year, q = 1970 + r.origin_ord // 4, r.origin_ord % 4
        obs = dt.date(year, q * 3 + 1, 1)
        known = [(a, v) for (s, o, a), v in seen.items() if s == r.series_id and o == obs and a <= r.vintage_date]
        # At a quarter's end nothing of it is published; then the stage's own truth stands in.
        truth = [v for (s, o, a), v in sorted(seen.items()) if s == r.series_id and o == obs]
        assert r.last_y == pytest.approx(max(known)[1] if known else truth[0 if r.stage == "first" else 2])
        assert r.source == "panel" and r.vintage_date <= dt.date(year + (q == 3), (q * 3 + 3) % 12 + 1, 1)
    guards = out["guards"].get
    assert guards == {"records": len(records), "earliest": 0, "leaks": 0, "not_finite": 0}
    board = out["leaderboard"].collect()
    assert {(r.stage, r.model) for r in board} == {(s, m) for s in ("first", "third") for m in ("naive_last", "drift")} and all(r.skill == 0 for r in board if r.model == "naive_last")
    assert out["pairwise"].count() == 4 and out["kpi"].count() > 0 and out["errors"].count() == 4
    assert out["window_vintages"].count() == 12 and out["outturns"].count() == 2 * 24 * 2
    assert out["forecasts"].where("metric <> 'levels' OR forecast_horizon < 0").count() == 0


@pytest.mark.parametrize("metric", ["release_saar", "panel_saar", "level"])
def test_growth_is_scored_on_growth(history, metric):
    out = evaluation.run(history, ["mean"], "naive_last", ["first", "second"], "saar", metric, windows=2, horizon=1)
    records = out["records"].collect()
    assert len(records) == 2 * 2 * 2 * 2 and all(abs(r.y_true) < 20 and r.y_hat is not None for r in records) and "kpi" not in out
    assert {r.metric for r in out["forecasts"].select("metric").distinct().collect()} == {"pop"}


def test_guards_of_the_evaluation(history):
    with pytest.raises(pipelines.StrictError):
        evaluation.run(history, ["drift"], historical=False)
    out = evaluation.run(history, ["drift"], historical=False, allow_snapshot=True, windows=2)
    assert {r.source for r in out["records"].collect()} == {"snapshot"}
    late = history.where("asof_date >= '2020-06-01'")
    early = evaluation.run(late.unionByName(history.where("asof_date < '2020-06-01'").withColumn("asof_date", F.date_add("asof_date", 2000))), ["drift"], windows=8, horizon=1)
    assert early["records"].where("source = 'earliest'").count() == early["guards"].get["earliest"] > 0
    strict = evaluation.run(late.unionByName(history.where("asof_date < '2020-06-01'").withColumn("asof_date", F.date_add("asof_date", 2000))), ["drift"], windows=8, horizon=1, strict=True)
    with pytest.raises(Exception, match="no vintage at or before the window's cutoff"):
        strict["records"].collect()
    with pytest.raises(ValueError, match="unknown models"):
        evaluation.run(history, ["nothing"])


def test_members_come_from_the_leaderboard(spark):
    board = spark.createDataFrame([("drift", 0.5), ("Ensemble_all", 0.9), ("naive_last", 0.8), ("mean", 0.4), ("rw_drift_log", 0.3), ("seasonal_naive", 0.2), ("ar4", 0.1), ("theta", 0.05), ("worst", -1.0), ("none", None)], "model string, skill double")
    got = {}
    for r in pipelines.leaderboard_members(board).collect():
        got.setdefault(r.ensemble, set()).add(r.model)
    assert got == {"ensemble_top3": {"rw_drift_log", "mean_growth"}, "ensemble_top5": {"rw_drift_log", "mean_growth", "seasonal_naive", "ar4_growth"}}
    assert pipelines.leaderboard_members(board, 0.45).count() == 2 and pipelines.leaderboard_members(board, 2.0).count() == 0


def test_ensembles_of_the_backtest(spark, history):
    members = spark.createDataFrame([("ensemble_top3", "drift"), ("ensemble_top3", "mean"), ("ensemble_top3", "absent")], "ensemble string, model string")
    rows = pipelines.realtime_backtest(history, ["naive_last", "drift", "mean"], members=members).collect()
    key = lambda r: (r.series_id, r.origin, r.h, r.target_ord, r.stage)
    by = {}
    for r in rows:
        by.setdefault(key(r), {})[r.model] = r
    assert {r.series_id for r in rows} == {"A", "B|x"} and all(set(x) == {"naive_last", "drift", "mean", "ensemble_top3"} for x in by.values())
    for x in by.values():
        e, a, b = x["ensemble_top3"], x["drift"], x["mean"]
        assert e.g_hat == pytest.approx((a.g_hat + b.g_hat) / 2) and e.level_before == pytest.approx((a.level_before + b.level_before) / 2)
        assert e.y_hat == pytest.approx(e.level_before * (1 + e.g_hat / 100) ** 0.25) and (e.y_true, e.months, e.vintage_date) == (a.y_true, a.months, a.vintage_date)
