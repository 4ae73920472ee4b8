"""Known answers: the small cases that the engine's semantics are pinned by."""

import datetime as dt
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintagelab.functions import scalars as S
from vintagelab.functions import sequence as Q
from vintagelab.operators import asof, autoregression, baselines, evaluate, features, ingest, models, releases
from vintagelab.plans import pipelines, registry
from vintagelab.sources import files
from vintagelab.streaming import revisions

D = dt.date.fromisoformat


@pytest.fixture(scope="module")
def versions(spark):
    rows = [("Y", D("2020-01-01"), D("2020-02-01"), 100.0), ("Y", D("2020-01-01"), D("2020-03-01"), 101.0), ("Y", D("2020-04-01"), D("2020-05-01"), 102.0)]
    return spark.createDataFrame(rows, "series_id string, obs_date date, asof_date date, value double")


def test_snapshot_takes_the_latest_version_known(versions):
    one = asof.snapshot_long(versions, "2020-02-15").collect()
    assert [(r.value, r.asof_used) for r in one] == [(100.0, D("2020-02-01"))]
    two = asof.snapshot_long(versions, "2020-03-15").collect()
    assert [(r.value, r.asof_used) for r in two] == [(101.0, D("2020-03-01"))]
    assert asof.snapshot_long(versions, "2020-01-15").count() == 0
    assert {r.value for r in asof.snapshot_long(versions, "2030-01-01", ["Y"], "2020-02-01", "2020-12-31").collect()} == {102.0}


def test_snapshot_skips_null_values_but_not_their_dates(spark, versions):
    more = versions.unionByName(spark.createDataFrame([("Y", D("2020-01-01"), D("2020-04-01"), None)], versions.schema))
    r = asof.snapshot_long(more, "2020-04-15").first()
    assert (r.value, r.asof_used) == (101.0, D("2020-04-01"))


def test_batched_snapshots_equal_single_ones(spark, versions):
    days = ["2020-01-15", "2020-02-01", "2020-03-01", "2020-03-31", "2021-01-01"]
    many = asof.snapshots(versions, spark.createDataFrame([(x,) for x in days], "cutoff string")).collect()
    for x in days:
        want = {(r.series_id, r.obs_date, r.value) for r in asof.snapshot_long(versions, x).collect()}
        assert {(r.series_id, r.obs_date, r.value) for r in many if r.cutoff == D(x)} == want


def test_ingest_keeps_the_last_of_a_batch_and_the_first_of_the_store(spark):
    cols = "series_id string, obs_date date, asof_date date, value string, arrival int"
    batch = spark.createDataFrame([("A", D("2021-01-01"), D("2021-02-01"), "1", 1), ("A", D("2021-01-01"), D("2021-02-01"), "2", 2), (None, D("2021-01-01"), D("2021-02-01"), "3", 3), ("B", D("2021-01-01"), D("2021-02-01"), ".", 4)], cols)
    stored = ingest.clean_batch(batch)
    assert {(r.series_id, r.value) for r in stored.collect()} == {("A", 2.0), ("B", None)}
    assert ingest.new_versions(stored, batch).count() == 0
    assert ingest.ingest(stored, batch).count() == 2 and asof.high_water(stored).first().max_asof == D("2021-02-01")
    with pytest.raises(ValueError):
        ingest.clean_batch(batch.drop("value"))


def test_overlay_replaces_where_the_snapshot_has_values(spark):
    base = spark.createDataFrame([(0, 90.0), (1, None), (2, 5.0)], "quarter_ord int, y double")
    snap = spark.createDataFrame([(0, 100.0), (1, 101.0), (2, None)], "quarter_ord int, value double")
    got = {r.quarter_ord: (r.y, r.changed) for r in asof.overlay(base, snap, ["quarter_ord"], "y").collect()}
    assert got == {0: (100.0, True), 1: (101.0, True), 2: (5.0, False)}


def test_releases_growth_comes_from_one_vintage(spark):
    q1, q2 = D("2024-01-01"), D("2024-04-01")
    rows = [("G", q1, D("2024-04-25"), 100.0), ("G", q1, D("2024-07-25"), 101.0), ("G", q2, D("2024-07-25"), 110.0), ("G", q1, D("2024-08-29"), 102.0), ("G", q2, D("2024-08-29"), 111.0), ("G", q1, D("2024-09-26"), 103.0), ("G", q2, D("2024-09-26"), 112.0)]
    v = spark.createDataFrame(rows, "series_id string, obs_date date, asof_date date, value double")
    got = {(r.quarter_ord, r.stage): r for r in releases.same_release_growth(v).collect()}
    for stage, a, b in (("first", 110, 101), ("second", 111, 102), ("third", 112, 103)):
        assert math.isclose(got[217, stage].saar, 100 * ((a / b) ** 4 - 1))
    assert got[216, "first"].saar is None


def test_a_level_break_is_no_growth(spark):
    rows = [("G", D("2024-01-01"), D("2024-04-25"), 100.0), ("G", D("2024-01-01"), D("2024-07-25"), 110.0), ("G", D("2024-04-01"), D("2024-07-25"), 110.0)]
    v = spark.createDataFrame(rows, "series_id string, obs_date date, asof_date date, value double")
    got = {(r.quarter_ord, r.stage): r for r in releases.same_release_growth(v).collect()}
    assert got[217, "first"].saar == 0.0
    assert 100 * ((110 / got[216, "first"].value) ** 4 - 1) > 40


def test_growth_algebra(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 101.5), (3, 103.0), (4, 104.1)], "t int, y double")
    from pyspark.sql import Window

    w = Window.orderBy("t")
    g = df.withColumn("g", S.saar_growth(F.col("y"), F.lag("y").over(w))).withColumn("k", F.lit(1))
    back = Q.levels_from_growth(g, ["k"], "t", "g", F.lit(100.0)).orderBy("t").collect()
    assert back[0].level is None and all(math.isclose(r.level, r.y) for r in back[1:])
    one = df.select(S.saar_growth(F.lit(101.0), F.lit(100.0)).alias("a"), S.saar_growth(F.lit(1.0), F.lit(-1.0)).alias("b")).first()
    assert math.isclose(one.a, 100 * (1.01**4 - 1)) and one.b is None
    gap = spark.createDataFrame([(1, 1, 10.0), (1, 2, None), (1, 3, -100.0), (1, 4, 10.0)], "k int, t int, g double")
    lv = [r.level for r in Q.levels_from_growth(gap, ["k"], "t", "g", F.lit(1.0)).orderBy("t").collect()]
    assert lv[1] is None and lv[2] is None and math.isclose(lv[3], 1.1**0.5)


def test_vintage_selection(spark):
    v = spark.createDataFrame([(D(x),) for x in ("2024-01-31", "2024-02-29", "2024-03-29")], "asof_date date")
    o = spark.createDataFrame([(D("2024-03-15"),), (D("2024-02-29"),), (D("2023-12-31"),)], "origin date")
    back = {r.origin: r.vintage_date for r in asof.select_vintage(o, v).collect()}
    assert back == {D("2024-03-15"): D("2024-02-29"), D("2024-02-29"): D("2024-02-29"), D("2023-12-31"): None}
    fall = {r.origin: (r.vintage_date, r.used_fallback) for r in asof.select_vintage(o, v, fallback=True).collect()}
    assert fall[D("2023-12-31")] == (D("2024-01-31"), True) and not fall[D("2024-03-15")][1]
    forward = {r.origin: r.vintage_date for r in asof.select_vintage(o, v, direction="forward").collect()}
    assert forward[D("2024-02-29")] == D("2024-02-29") and forward[D("2024-03-15")] == D("2024-03-29")
    days = spark.createDataFrame([(D("2024-03-31"),), (D("2024-06-01"),), (D("2024-08-15"),)], "d date").select(S.last_business_day(F.col("d")).alias("b")).collect()
    assert [r.b for r in days] == [D("2024-03-29"), D("2024-06-28"), D("2024-08-30")]


def test_transform_rows_and_panels_from_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "2024-01.csv").write_text("sasdate,y,x\nTransform:,5,2\n01/01/2023,100,10\n04/01/2023,110,10.5\nnotes,1,2\n")
    (tmp_path / "2024m02.csv").write_text("sasdate,y,x\ntcode,5,999\n1/1/2023,100,10\n4/1/2023,.,10.5\n")
    (tmp_path / "2024-13.csv").write_text("sasdate,y\n")
    found = files.discover(spark, str(tmp_path)).orderBy("vintage").collect()
    assert [r.vintage for r in found] == ["2024-01", "2024-02"]
    raw = files.read_vintage_csv(spark, [r.path for r in found])
    assert {(r.vintage, r.series_id, r.tcode) for r in files.transform_code_rows(raw).collect()} == {("2024-01", "y", 5), ("2024-01", "x", 2), ("2024-02", "y", 5)}
    assert files.metadata_rows(raw).count() == 3
    p = {(r.vintage, r.series_id, str(r.obs_date)): (r.value, r.transformed) for r in files.build_panel(raw, target="y").collect()}
    assert p["2024-01", "y", "2023-04-01"] == (110.0, 110.0) and p["2024-01", "x", "2023-01-01"][1] is None and p["2024-01", "x", "2023-04-01"][1] == 0.5
    assert p["2024-02", "y", "2023-04-01"] == (None, None) and p["2024-02", "x", "2023-04-01"] == (10.5, 10.5)


def test_files_of_different_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "2020-01.csv").write_text("sasdate,A,B\ntransform,1,5\n1/1/2019,1,10\n")
    (tmp_path / "2020-02.csv").write_text("sasdate,B,A,C\r\ntransform,5,1,2\r\n1/1/2019,11,2,7\r\n4/1/2019,12,3,9\r\n")
    raw = files.read_vintage_csv(spark, [str(p) for p in tmp_path.iterdir()])
    got = {(r.vintage, r.series_id, str(r.obs_date)): r.value for r in files.data_rows(raw).collect() if r.value is not None}
    assert got == {("2020-01", "A", "2019-01-01"): 1.0, ("2020-01", "B", "2019-01-01"): 10.0, **{("2020-02", k, d): v for k, d, v in [("A", "2019-01-01", 2.0), ("B", "2019-01-01", 11.0), ("C", "2019-01-01", 7.0), ("A", "2019-04-01", 3.0), ("B", "2019-04-01", 12.0), ("C", "2019-04-01", 9.0)]}}
    assert {(r.vintage, r.series_id): r.tcode for r in files.transform_code_rows(raw).collect()} == {("2020-01", "A"): 1, ("2020-01", "B"): 5, ("2020-02", "A"): 1, ("2020-02", "B"): 5, ("2020-02", "C"): 2}
    p = {(r.vintage, r.series_id, str(r.obs_date)): r.transformed for r in files.build_panel(raw, target="A").collect()}
    assert p["2020-02", "C", "2019-04-01"] == 2.0 and abs(p["2020-02", "B", "2019-04-01"] - math.log(12 / 11)) < 1e-12 and p["2020-02", "A", "2019-04-01"] == 3.0


def test_batched_snapshots_equal_single_ones_with_nulls(spark):
    rows = [("A", "2020-01-01", "2020-02-01", 100.0), ("A", "2020-01-01", "2020-03-01", None), ("A", "2020-01-01", "2020-05-20", 101.0), ("A", "2020-04-01", "2020-05-01", None), ("B", "2019-01-01", "2019-03-15", 1.0), ("B", "2019-01-01", "2021-01-01", 2.0)]
    v = spark.createDataFrame(rows, "series_id string, obs_date string, asof_date string, value double").selectExpr("series_id", "date(obs_date) obs_date", "date(asof_date) asof_date", "value")
    days = ["2019-01-01", "2019-03-15", "2020-02-15", "2020-03-15", "2020-05-01", "2020-05-19", "2020-05-20", "2022-01-01", "2022-01-02"]
    got = sorted(map(str, asof.snapshots(v, spark.createDataFrame([(d,) for d in days * 2], "cutoff string")).collect()))
    want = [asof.snapshot_long(v, d).selectExpr(f"date'{d}' as cutoff", "series_id", "obs_date", "value", "asof_used").collect() for d in days]
    assert got == sorted(str(r) for w in want for r in w) and any("date(2020, 3, 15)" in g and "100.0" in g for g in got)
    assert asof.snapshots(v, spark.createDataFrame([], "cutoff string")).count() == 0


def test_asked_origins_alone_are_forecast(spark):
    panel = spark.createDataFrame([(s, q, 100.0 + q * (1 + (s == "B")) + q % 3) for s in "AB" for q in range(24)], "series_id string, quarter_ord long, y double")
    origins = spark.createDataFrame([("A", 23), ("B", 20), ("B", 2)], "series_id string, origin_ord long")
    names = ["drift", "mean_growth", "random_normal", "ar4", "random_forest"]
    every, some = registry.forecast(panel, names, 2), registry.forecast(panel, names, 2, origins=origins)
    assert sorted(map(str, some.collect())) == sorted(map(str, every.join(origins, ["series_id", "origin_ord"], "left_semi").select(every.columns).collect())) and some.count() == 2 * 2 * len(names)


def test_diebold_mariano_takes_all_lags(spark):
    rng = random.Random(2)
    for n, h in ((30, 12), (14, 12), (25, 1)):
        d = [rng.gauss(0.2, 1) for _ in range(n)]
        got = evaluate.diebold_mariano(spark.createDataFrame([("m", h, i, x) for i, x in enumerate(d)], "model string, h long, origin_ord long, d double")).first()
        c = [x - sum(d) / n for x in d]
        lrv = (sum(x * x for x in c) + 2 * sum(c[i] * c[i - k] for k in range(1, h) for i in range(k, n))) / n
        small = math.sqrt(max(0.0, (n + 1 - 2 * h + h * (h - 1) / n) / n))
        assert got.n == n and (got.dm is None if lrv <= 0 else abs(got.dm - sum(d) / n / math.sqrt(lrv / n) * small) < 1e-9)


def test_wide_vintage_columns_and_payloads(spark, tmp_path):
    wide = spark.createDataFrame([("2024-01-01", "100", "."), ("2024-04-01", None, "111")], "observation_date string, GDP_20240425 string, GDP_20240725 string")
    assert {(str(r.obs_date), str(r.asof_date), r.value) for r in files.wide_to_versions(wide).collect()} == {("2024-01-01", "2024-04-25", 100.0), ("2024-04-01", "2024-07-25", 111.0)}
    lines = [
        {"series_id": "A", "observations": [{"date": "2020-01-01", "realtime_start": "2020-02-01", "value": "1.5"}, {"date": "2020-04-01", "value": "2"}, {"date": "2020-07-01", "value": "."}]},
        {"series_id": "B", "vintage_date": "2021-05-01", "observations": [{"date": "2021-01-01", "B_20210501": "7"}]},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {(r.series_id, str(r.obs_date), str(r.asof_date), r.value) for r in files.read_payloads(spark, str(tmp_path / "p.jsonl")).collect()}
    assert got == {("A", "2020-01-01", "2020-02-01", 1.5), ("A", "2020-04-01", "2020-04-01", 2.0), ("B", "2021-01-01", "2021-05-01", 7.0)}


def test_sinks_round_trip(spark, tmp_path, versions):
    for kind in ("parquet", "csv", "jsonl"):
        files.save(versions, str(tmp_path / f"v.{kind}"), ["series_id"])
        assert files.load(spark, str(tmp_path / f"v.{kind}")).count() == 3


def test_truth_overlay_drops_missing(spark):
    wide = spark.createDataFrame([("A", 1, 100.0), ("A", 2, None), ("A", 3, 121.0)], "series_id string, quarter_ord int, first_release double")
    frame = spark.createDataFrame([("A", q, 0.0) for q in (1, 2, 3)], "series_id string, quarter_ord int, y double")
    got = {r.quarter_ord: r.y for r in releases.truth_overlay(frame, wide, "first", "log_level").collect()}
    assert got == {1: pytest.approx(math.log(100)), 3: pytest.approx(math.log(121))}


def test_truth_check_counts_missing_and_differing(spark):
    r = spark.createDataFrame([("A", 1, 5.0), ("A", 2, 6.0), ("A", 3, 7.0)], "series_id string, target_ord int, y_true double")
    t = spark.createDataFrame([("A", 1, 5.0), ("A", 2, 6.5)], "series_id string, quarter_ord int, y double")
    got = evaluate.truth_check(r, t).first()
    assert (got.n, got.max_diff, got.bad) == (3, 0.5, 2)


def test_shock_adjustment_equals_least_squares(spark):
    y = [100.0, 101.0, 102.0, 103.0, 104.0, 105.0, 106.0, 132.0]
    df = spark.createDataFrame([("A", 194 + i, v) for i, v in enumerate(y)], "series_id string, quarter_ord int, y double")
    got = features.shock_adjusted(df, ["series_id"], "quarter_ord", "y", [201]).orderBy("quarter_ord").collect()
    x = np.column_stack([np.ones(8), np.eye(8)[7]])
    beta = np.linalg.lstsq(x, np.array(y), rcond=None)[0]
    assert got[-1].effect == pytest.approx(beta[1]) and got[-1].adjusted < y[-1]
    assert [r.adjusted for r in features.shock_adjusted(df, ["series_id"], "quarter_ord", "y", [300]).orderBy("quarter_ord").collect()] == y


def test_leaderboard_without_shocks_ranks_the_calm_model_first(spark):
    rows = [("m1", 1, 10.0, 10.1), ("m1", 2, 10.0, 30.0), ("m1", 3, 10.0, 30.0), ("m2", 1, 10.0, 12.0), ("m2", 2, 10.0, 10.0), ("m2", 3, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "model string, target_ord int, y_true double, y_hat double")
    assert [r.model for r in evaluate.leaderboard_ex_shock(df, (2, 3)).orderBy("rank").collect()] == ["m1", "m2"]


def test_exchange_horizons(spark):
    r = spark.createDataFrame([("m", "A", 200, 1, 201, 5.0)], "model string, series_id string, origin_ord long, h long, target_ord long, y_hat double")
    got = evaluate.exchange_forecasts(r).first()
    assert (str(got.date), got.forecast_horizon, str(got.vintage_date)) == ("2020-06-30", 0, "2020-06-30")
    s = spark.createDataFrame([("A", 200, 5.0, D("2020-04-29")), ("A", 201, 6.0, None)], "series_id string, quarter_ord long, value double, release_date date")
    assert sorted((str(x.date), str(x.vintage_date), x.forecast_horizon) for x in evaluate.exchange_outturns(s).collect()) == [("2020-03-31", "2020-06-30", -1), ("2020-06-30", "2020-09-30", -1)]


def test_ragged_edge_covariates_are_carried(spark):
    cov = spark.createDataFrame([("A", q, x) for q, x in ((1, 4.0), (2, 4.1), (3, 4.2), (4, 4.3), (5, None))], "series_id string, quarter_ord long, x double")
    cut = spark.createDataFrame([("A", 3)], "series_id string, cutoff_ord long")
    assert [r.x for r in features.future_covariates(cut, cov, 2).orderBy("h").collect()] == [4.3, 4.3]


def test_longest_block(spark):
    q = [*range(0, 10), *range(12, 24), *range(30, 42)]
    df = spark.createDataFrame([("A", x) for x in q] + [("B", x) for x in (1, 5, 9)], "k string, q long")
    got = sorted((r.k, r.q) for r in Q.longest_block(df, ["k"], "q").collect())
    assert got == [("A", x) for x in range(30, 42)] + [("B", x) for x in (1, 5, 9)]


def test_sequence_padding(spark):
    df = spark.createDataFrame([("A", [1, 2, 3], [1.0, 2.0]), ("B", [1, 2], [1.0, 2.0, 3.0])], "k string, t array<int>, y array<double>")
    got = sorted((r.k, r.t, r.y) for r in features.from_sequence(df, "k", "t", ["y"]).collect())
    assert got == [("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 2.0), ("B", 1, 1.0), ("B", 2, 2.0)]


def line(n, slope=2.0):
    return np.arange(n) * slope + 50.0


@pytest.mark.parametrize("name", sorted(models.REGISTRY))
def test_models_give_finite_full_paths(name):
    rng = np.random.default_rng(1)
    y = line(40) + rng.normal(0, 0.1, 40)
    x = np.column_stack([np.sin(np.arange(40)), np.cos(np.arange(40))])
    path = np.asarray(models.REGISTRY[name](y, 4, x, x[:4]))
    assert path.shape == (4,) and np.isfinite(path).all() and np.abs(path - line(44)[40:]).max() < 40


def test_models_know_simple_series():
    assert np.allclose(models.auto_ar(line(40), 4), line(44)[40:], atol=1e-3)
    assert np.allclose(models.drift(line(5), 2), line(7)[5:])


def test_registry_and_own_models(spark):
    assert registry.canonical(["naive", "last", "drift", "gbt"]) == ["naive_last", "drift", "xgboost"]
    with pytest.raises(ValueError):
        registry.canonical(["no such model"])
    models.register("twice_last", lambda y, h, x, fx: np.full(h, 2 * y[-1]))
    models.register("broken", lambda y, h, x, fx: np.full(h + 1, 1.0))
    p = spark.createDataFrame([("A", q, float(q)) for q in range(1, 15)], "series_id string, quarter_ord long, y double")
    got = models.fitted_forecasts(p, ["twice_last", "broken"], 2, 12).collect()
    assert {r.y_hat / r.last_y for r in got if r.model == "twice_last"} == {2.0}
    assert all(r.error and r.y_hat == r.last_y + r.h for r in got if r.model == "broken")
    del models.REGISTRY["twice_last"], models.REGISTRY["broken"]


@pytest.fixture(scope="module")
def history(spark):
    """16 quarters from 2020Q1, first released 35 days after their end, revised by 0.1 and 0.2 after 30 and 60 days more."""
    rows = []
    for i in range(16):
        start = dt.date(2020 + i // 4, i % 4 * 3 + 1, 1)
        end = dt.date(2020 + (i + 1) // 4, (i + 1) % 4 * 3 + 1, 1) - dt.timedelta(1)
        rows += [("G", start, end + dt.timedelta(35 + 30 * k), 100 + 1.25 * i + 0.1 * k) for k in range(3)]
    return spark.createDataFrame(rows, "series_id string, obs_date date, asof_date date, value double")


def test_backtest_has_no_look_ahead(history):
    got = pipelines.realtime_backtest(history, ["naive_last", "drift"], 2, 4, ("first", "second", "third")).collect()
    assert {r.stage for r in got} == {"first", "second", "third"} and all(r.origin_ord < r.target_ord for r in got)
    assert all(r.vintage_date <= r.origin for r in got)
    one = next(r for r in got if r.model == "naive_last" and r.target_ord == 210 and r.h == 1 and r.stage == "first")
    assert one.y_true == pytest.approx(100 + 1.25 * 10) and one.y_hat == pytest.approx(100 + 1.25 * 9 + 0.2, abs=0.11) and one.months == 0


def test_training_rows_never_pass_the_observed_quarter(spark):
    p = spark.createDataFrame([("A", D("2024-01-31"), q, float(q)) for q in range(10)], "series_id string, vintage_date date, quarter_ord long, value double")
    o = spark.createDataFrame([("A", D("2024-01-31"), 6)], "series_id string, vintage_date date, observed_ord long")
    got = releases.training_sets(o, p, 1, 5).collect()
    assert max(r.quarter_ord for r in got if r.value is not None) == 6 and max(r.quarter_ord for r in got) == 7
    assert releases.training_sets(o, p, 1, 8).count() == 0


def test_guards(spark):
    p = spark.createDataFrame([("A", q, float(q)) for q in range(30)], "series_id string, quarter_ord long, y double")
    with pytest.raises(pipelines.StrictError):
        pipelines.window_evaluation(p, ["drift"], "drift", (1, 2), snapshot=True)
    out = pipelines.window_evaluation(p, ["drift", "naive_last"], "naive_last", (1, 2), snapshot=True, allow_snapshot=True)
    assert out["leaderboard"].where("model = 'drift'").first().win_rate == 1.0 and out["records"].select("origin_ord").distinct().count() == 8
    w = spark.createDataFrame([("t", 0, D("2020-01-01")), ("t", 1, D("2021-01-01"))], "task string, window_idx long, cutoff date")
    v = spark.createDataFrame([(D("2020-06-30"),)], "asof_date date")
    assert {r.window_idx: r.source for r in pipelines.provenance(w, v).collect()} == {0: "earliest", 1: "panel"}
    with pytest.raises(pipelines.StrictError):
        pipelines.provenance(w, v, strict=True)
    assert [r.window_idx for r in pipelines.without_provenance(w, w.where("window_idx = 1")).collect()] == [0]


def test_streaming_ingest_keeps_first_writers_and_is_idempotent(spark, tmp_path):
    t = dt.datetime(2021, 2, 1)
    def put(name, rows):
        spark.createDataFrame(rows, revisions.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    put("a", [("A", D("2021-01-01"), D("2021-02-01"), 1.0, t)])
    stream = lambda: spark.readStream.schema(revisions.SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for _ in range(2):
        revisions.ingest_stream(stream(), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    put("b", [("A", D("2021-01-01"), D("2021-02-01"), 9.0, t + dt.timedelta(1)), ("B", D("2021-01-01"), D("2021-02-01"), 2.0, t + dt.timedelta(1))])
    revisions.ingest_stream(stream(), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.series_id, r.value) for r in revisions.stored(spark, str(tmp_path / "store")).collect()) == [("A", 1.0), ("B", 2.0)]
    marks = asof.high_water(revisions.stored(spark, str(tmp_path / "store")))
    late = spark.createDataFrame([("A", D("2021-01-01"), D("2021-01-20"), 1.0, t), ("A", D("2021-01-01"), D("2021-02-20"), 1.0, t)], revisions.SCHEMA)
    assert revisions.late_rows(late, marks).count() == 1


def test_results_do_not_depend_on_partitions(spark, versions):
    a = sorted(map(str, releases.releases(versions.repartition(7)).collect()))
    assert a == sorted(map(str, releases.releases(versions.coalesce(1)).collect()))


def test_ensembles_renormalise_over_present_members(spark):
    f = spark.createDataFrame([("a", "S", 1, 1, 2, 10.0, 1.0), ("b", "S", 1, 1, 2, float("nan"), 1.0), ("c", "S", 1, 1, 2, 40.0, 1.0)], "model string, series_id string, origin_ord long, h long, target_ord long, y_hat double, last_y double")
    m = spark.createDataFrame([("e", "a", 1.0), ("e", "b", 5.0), ("e", "c", 2.0)], "ensemble string, model string, weight double")
    assert baselines.ensemble(f, m).first().y_hat == 30.0


def test_stage_names(spark):
    df = spark.createDataFrame([(x,) for x in ("First Release", "2nd", "third_estimate", "latest", "odd")], "s string")
    assert [r[0] for r in df.select(S.normalised_stage(F.col("s"))).collect()] == ["first", "second", "third", "latest", None]
    assert df.select(S.item_id(F.lit("GDP"), F.lit("first"), F.lit("saar"))).first()[0] == "GDP__first__saar"


def test_autoregressions_equal_least_squares_at_every_origin(spark):
    rng = np.random.default_rng(4)
    paths = {"A": 100 + np.cumsum(rng.normal(0.5, 1, 40)), "B": 5 * np.exp(np.cumsum(rng.normal(0.01, 0.02, 30)))}
    rows = [(s, q, float(v)) for s, y in paths.items() for q, v in enumerate(y)] + [("A", 40, None), ("A", 41, None)]
    p = spark.createDataFrame(rows, "series_id string, quarter_ord long, y double")
    got = {(r.model, r.series_id, r.origin_ord, r.h): r.y_hat for r in autoregression.ar_forecasts(p, 3, 14).collect()}

    def path(z):
        x = np.column_stack([np.ones(len(z) - 4), *(z[4 - k : len(z) - k] for k in range(1, 5))])
        b, out = np.linalg.lstsq(x, z[4:], rcond=None)[0], list(z)
        for _ in range(3):
            out.append(b[0] + sum(b[k] * out[-k] for k in range(1, 5)))
        return np.array(out[len(z) :])

    assert len(got) == 2 * 3 * sum(len(y) - 13 for y in paths.values())
    for s, y in paths.items():
        for n in range(14, len(y) + 1):
            want = {"ar4": path(y[:n]), "ar4_growth": y[n - 1] * np.exp(np.cumsum(path(np.diff(np.log(y[:n])))))}
            for m, values in want.items():
                assert [got[m, s, n - 1, h] for h in (1, 2, 3)] == pytest.approx(values, rel=1e-7)


def test_autoregressions_of_odd_series(spark):
    rows = [("line", q, 2.0 * q + 1) for q in range(20)] + [("flat", q, 7.0) for q in range(20)] + [("zero", q, 0.0) for q in range(20)] + [("minus", q, -3.0 - q) for q in range(20)] + [("short", q, 1.0 + q * q) for q in range(5)]
    p = spark.createDataFrame(rows, "series_id string, quarter_ord long, y double")
    last = spark.createDataFrame([(s, 19) for s in ("line", "flat", "zero", "minus")] + [("short", 4)], "series_id string, origin_ord long")
    got = {(r.model, r.series_id, r.h): r.y_hat for r in autoregression.ar_forecasts(p, 2, 2, origins=last).collect()}
    assert [got["ar4", "line", h] for h in (1, 2)] == pytest.approx([41.0, 43.0]) and got["ar4", "minus", 1] == pytest.approx(-23.0)
    assert {got[m, "flat", 2] for m in autoregression.MODELS} == {7.0} and {got[m, "zero", 2] for m in autoregression.MODELS} == {0.0}
    assert got["ar4_growth", "minus", 2] == -22.0 and {got[m, "short", 1] for m in autoregression.MODELS} == {17.0}
    assert autoregression.ar_forecasts(p.where("false")).count() == 0


def test_bootstrap_gives_intervals_of_every_statistic(spark):
    rows = [(f"t{i}", m, v) for i in range(30) for m, v in (("base", 2.0 + i), ("half", 1.0 + i / 2), ("other", None if i == 3 else 2.0 + i))]
    tasks = spark.createDataFrame(rows, "task string, model string, metric double")
    got = {(r.statistic, r.model, r.other): r for r in evaluate.bootstrap(tasks, "base", 200, 1).collect()}
    assert got["skill", "half", ""][3:] == pytest.approx((0.5, 0.5, 0.5)) and got["win_rate", "half", ""][3:] == (1.0, 1.0, 1.0)
    mean = got["mean", "base", ""]
    assert mean.value == 16.5 and mean.low < 16.5 < mean.high and mean.high - mean.low < 8
    assert got["difference", "base", "other"][3:] == (0.0, 0.0, 0.0) and got["difference", "half", "base"].low > 0
    again = {(r.statistic, r.model, r.other): r for r in evaluate.bootstrap(tasks.repartition(5), "base", 200, 1).collect()}
    assert all(again[k][3:] == pytest.approx(got[k][3:]) for k in got) and len(got) == 3 + 3 + 3 + 6


def test_growth_of_first_releases_and_own_lags(spark):
    wide = spark.createDataFrame([("A", 1, D("2020-04-01"), 100.0, D("2020-07-30"), 7), ("A", 2, D("2020-07-01"), 110.0, None, 90)], "series_id string, quarter_ord long, obs_date date, first_release double, first_date date, lag_days long")
    assert [r.valid_origin for r in releases.valid_origins(wide).orderBy("quarter_ord").collect()] == [False, False]
    assert [r.valid_origin for r in releases.valid_origins(wide.drop("lag_days")).orderBy("quarter_ord").collect()] == [True, False]
    growth = [r.first_growth for r in releases.first_growth(wide).orderBy("quarter_ord").collect()]
    assert growth[0] is None and growth[1] == pytest.approx(100 * (1.1**4 - 1))
    assert [r.first_growth for r in releases.first_growth(wide.withColumn("first_saar", F.lit("2.5"))).collect()] == [2.5, 2.5]


def test_streams_keep_marks_and_snapshots(spark, tmp_path):
    t = dt.datetime(2021, 2, 1)
    for k, rows in enumerate(([("A", D("2021-01-01"), D("2021-02-01"), 1.0, t)], [("A", D("2021-01-01"), D("2021-02-01"), 9.0, t + dt.timedelta(1)), ("A", D("2021-01-01"), D("2021-03-01"), None, t), ("B", D("2021-01-01"), D("2021-02-01"), 2.0, t)])):
        spark.createDataFrame(rows, revisions.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = lambda: spark.readStream.schema(revisions.SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        revisions.high_water_stream(stream(), str(tmp_path / "m"), str(tmp_path / "mc")).awaitTermination()
        revisions.latest_snapshot_stream(stream(), str(tmp_path / "s"), str(tmp_path / "sc")).awaitTermination()
    assert sorted((r.series_id, r.max_asof, r.n) for r in revisions.high_water_marks(spark, str(tmp_path / "m")).collect()) == [("A", D("2021-03-01"), 3), ("B", D("2021-02-01"), 1)]
    assert sorted((r.series_id, r.value, r.asof_used) for r in revisions.latest_snapshot(spark, str(tmp_path / "s")).collect()) == [("A", 1.0, D("2021-03-01")), ("B", 2.0, D("2021-02-01"))]


def test_users_models_run_by_origin_or_as_frames(spark):
    p = spark.createDataFrame([(s, q, float(q)) for s in "AB" for q in range(1, 15)] + [("A", 15, None)], "series_id string, quarter_ord long, y double")
    registry.register_model("mean_of_two", lambda pdf: pd.DataFrame({"h": [1, 2], "y_hat": [pdf.y.tail(2).mean()] * 2}))
    registry.register_model("twice", lambda df, horizon, origins: baselines.baseline_forecasts(df, horizon, 8, ("naive_last",), origins).withColumns({"model": F.lit("twice"), "y_hat": F.col("y_hat") * 2}), "frame")
    try:
        got = registry.forecast(p, ["mean_of_two", "twice"], 2).collect()
        assert sum(r.model == "mean_of_two" for r in got) == 2 * 2 * 7 and {r.y_hat - r.last_y for r in got if r.model == "mean_of_two"} == {-0.5}
        assert {r.y_hat / r.last_y for r in got if r.model == "twice" and r.last_y} == {2.0}
        some = spark.createDataFrame([("B", 10)], "series_id string, origin_ord long")
        assert {(r.series_id, r.origin_ord) for r in registry.forecast(p, ["mean_of_two"], 2, origins=some).collect()} == {("B", 10)}
        for name in ("twice", "drift", "naive"):
            with pytest.raises(ValueError):
                registry.register_model(name, None)
    finally:
        registry.OWN.clear()


def test_minnesota_penalty_by_hand():
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=30))
    z = (y - y.mean()) / (y.std() + 1e-9)
    x, target = np.column_stack([np.ones(28), z[1:-1], z[:-2]]), z[2:]
    d = 6.0 * np.diag([0.2**2, 0.3**2, (2**1.5) ** 2])
    b = np.linalg.solve(x.T @ x + d, x.T @ target + d @ np.array([0.0, 1.0, 0.0]))
    assert models.minnesota(y, 1, None, None)[0] == pytest.approx(b @ np.array([1.0, z[-1], z[-2]]) * (y.std() + 1e-9) + y.mean())
    more = rng.normal(size=(30, 9))
    assert np.allclose(models.minnesota(y, 2, more, more[:2]), models.minnesota(y, 2, more[:, :7], more[:2, :7]))
