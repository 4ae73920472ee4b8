"""The as-of join cuts a key into buckets of time; vintages are found by the month's index."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vintagelab.operators import asof, autoregression


def brute(left, right, back):
    out = []
    for i, k, t in left:
        ok = [(rt, v) for rk, rt, v in right if rk == k and rt is not None and t is not None and (rt <= t if back else rt >= t)]
        if not ok:
            out.append((i, None, None))
            continue
        at = max(r[0] for r in ok) if back else min(r[0] for r in ok)
        values = [v for rt, v in ok if rt == at]
        out.append((i, at, max((v for v in values if v is not None), default=None)))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("width", [1, 30, 92, 100_000])
def test_asof_join_equals_brute_force(spark, direction, width):
    rng = random.Random(width)
    day = lambda: dt.date(2019, 1, 1) + dt.timedelta(rng.randrange(900))
    left = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *[day() for _ in range(20)]])) for i in range(300)]
    right = [(rng.choice(["hot", "hot", "a", "only", None]), rng.choice([None, *[day() for _ in range(20)]]), rng.choice([float(rng.randrange(9)), float(rng.randrange(9)), None])) for i in range(120)]
    # a null key equals a null key; of equal times the greatest value counts, a null one last
    l = spark.createDataFrame(left, "id long, k string, t date").repartition(4)  # noqa: E741
    r = spark.createDataFrame(right, "k string, at date, v double").repartition(4)
    got = sorted((x.id, x.matched_ts, x.matched) for x in asof.asof_join(l, r, ["k"], "t", "at", "v", direction, width).collect())
    assert got == brute(left, right, direction == "backward")


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join_of_numbers_and_timestamps(spark, direction):
    rng = random.Random(6)
    left, right = [(i, "k", rng.randrange(1000)) for i in range(200)], [("k", rng.randrange(1000), float(i)) for i in range(60)]
    l = spark.createDataFrame(left, "id long, k string, t long")  # noqa: E741
    r = spark.createDataFrame(right, "k string, at long, v double")
    want = brute(left, right, direction == "backward")
    assert sorted((x.id, x.matched_ts, x.matched) for x in asof.asof_join(l, r, ["k"], "t", "at", "v", direction, 10).collect()) == want
    stamp = lambda df, c: df.withColumn(c, F.timestamp_seconds(F.col(c) * 9000))
    got = asof.asof_join(stamp(l, "t"), stamp(r, "at"), ["k"], "t", "at", "v", direction, 3).select("id", (F.unix_seconds("matched_ts") / 9000).cast("long"), "matched")
    assert sorted(map(tuple, got.collect())) == want
    assert asof.asof_join(l.limit(0), r, ["k"], "t", "at", "v", direction).count() == 0
    assert [x.matched for x in asof.asof_join(l, r.limit(0), ["k"], "t", "at", "v", direction).collect()] == [None] * 200


def test_a_hot_series_spreads_over_tasks(spark):
    days = spark.range(0, 4000).select(F.lit("hot").alias("k"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.col("id").cast("double").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = asof.asof_join(days.select("k", F.col("d").alias("t")), days, ["k"], "t", "d", "v")
        rows = [r.n for r in out.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("matched").alias("n")).collect()]
        assert sum(rows) == 4000 and len(rows) >= 12 and max(rows) < 1000
        assert out.where("matched_ts <> t OR matched IS NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_vintages_are_found_by_month(spark):
    rng = random.Random(9)
    days = sorted({dt.date(2018, 3, 1) + dt.timedelta(rng.randrange(1500)) for _ in range(60)})
    origins = [dt.date(2017, 11, 1) + dt.timedelta(11 * i) for i in range(180)] + days + [None]
    o = spark.createDataFrame([(x,) for x in origins], "origin date")
    v = spark.createDataFrame([(x,) for x in days * 2], "asof_date date")
    for direction, pick in (("backward", lambda x: max((d for d in days if d <= x), default=None)), ("forward", lambda x: min((d for d in days if d >= x), default=None))):
        got = {r.origin: r.vintage_date for r in asof.select_vintage(o, v, direction=direction).collect()}
        assert got == {x: x and pick(x) for x in origins}
    empty = asof.select_vintage(o, v.limit(0)).collect()
    assert len(empty) == len(origins) and all(r.vintage_date is None for r in empty)
    assert asof.select_vintage(o.where("origin >= '2018-06-01'"), v, strict=True).count() > 100
    with pytest.raises(Exception, match="no vintage for the origin 2017-11-01"):
        asof.select_vintage(o.where("origin < '2018-06-01'").orderBy("origin").coalesce(1), v, strict=True).collect()


def test_autoregression_of_a_high_level_equals_least_squares(spark):
    """Levels about a million with a deviation of one: without centring, the normal equations lose the variation."""
    import numpy as np

    rng = np.random.default_rng(5)
    paths = {"high": 1e6 + rng.normal(0, 1, 160), "growing": 1e9 * np.exp(np.cumsum(rng.normal(0.006, 1e-4, 120))), "low": 1e-7 * (3 + rng.normal(0, 1, 60))}
    p = spark.createDataFrame([(s, q, float(v)) for s, y in paths.items() for q, v in enumerate(y)], "series_id string, quarter_ord long, y double")
    last = spark.createDataFrame([(s, len(y) - 1) for s, y in paths.items()], "series_id string, origin_ord long")
    got = {(r.model, r.series_id, r.h): r.y_hat for r in autoregression.ar_forecasts(p, 4, 12, origins=last).collect()}

    def path(z):
        c = z - z.mean()
        x = np.column_stack([np.ones(len(c) - 4), *(c[4 - k : len(c) - k] for k in range(1, 5))])
        b, out = np.linalg.lstsq(x, c[4:], rcond=None)[0], list(c)
        for _ in range(4):
            out.append(b[0] + sum(b[k] * out[-k] for k in range(1, 5)))
        return np.array(out[len(c) :]) + z.mean()

    for s, y in paths.items():
        assert [got["ar4", s, h] for h in range(1, 5)] == pytest.approx(path(y), rel=1e-9)
        if s != "low":
            assert [got["ar4_growth", s, h] for h in range(1, 5)] == pytest.approx(y[-1] * np.exp(np.cumsum(path(np.diff(np.log(y))))), rel=1e-9)
