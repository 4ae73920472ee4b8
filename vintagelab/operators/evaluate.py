"""Scoring and comparison: error metrics, leaderboards, pairwise and Diebold-Mariano tests, exchange tables.

Records are (model, series_id, origin_ord, h, target_ord, y_hat, y_true, last_y)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quarter_end, saar_growth



def error() -> Column:
    return F.col("y_hat") - F.col("y_true")


def _finite(e: Column) -> Column:
    return F.when(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")), e)


def _metrics(e: Column, suffix: str = "") -> list[Column]:
    return [F.count(e).cast("long").alias(f"n{suffix}"), F.avg(F.abs(e)).alias(f"mae{suffix}"), F.avg(e * e).alias(f"mse{suffix}"), F.sqrt(F.avg(e * e)).alias(f"rmse{suffix}")]


def point_errors(records: DataFrame, by: list[str], shock: tuple[int, int] | None = None) -> DataFrame:
    """MAE, MSE and RMSE of finite errors, over all rows and (with shock) without the shock quarters: one aggregation."""
    e = _finite(error())
    out = _metrics(e)
    if shock:
        out += _metrics(F.when(~F.col("target_ord").between(*shock), e), "_ex")
    return records.groupBy(*by).agg(*out)


def leaderboard_ex_shock(records: DataFrame, shock: tuple[int, int]) -> DataFrame:
    """point_errors by model with a rank: RMSE without shocks, then RMSE, MSE, MAE and name, nulls last."""
    m = point_errors(records, ["model"], shock)
    order = [F.asc_nulls_last(c) for c in ("rmse_ex", "rmse", "mse", "mae", "model")]
    return m.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def kpi_tables(records: DataFrame, shock: tuple[int, int]) -> DataFrame:
    """Counts, RMSE and MAE of level and of growth on the previous step, by (model, h) and by (model, h, period)."""
    from ..functions.scalars import period_slice

    k = level_kpi(records).withColumn("period", period_slice(F.col("target_ord"), *shock))
    e, g = _finite(error()), _finite(F.col("g_hat") - F.col("g_true"))
    out = [F.count(e).cast("long").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(g * g)).alias("rmse_saar"), F.avg(F.abs(g)).alias("mae_saar")]
    sets = k.groupingSets([["model", "h"], ["model", "h", "period"]], "model", "h", "period").agg(*out)
    return sets.withColumn("period", F.coalesce("period", F.lit("all")))


def level_kpi(records: DataFrame) -> DataFrame:
    """records with g_hat and g_true: annualised growth on the own previous step (the last observed value at the first step) and
    of the truth on the true previous one."""
    w = Window.partitionBy("model", "series_id", "origin_ord").orderBy("h")
    before, true_before = F.coalesce(F.lag("y_hat").over(w), F.col("last_y")), F.coalesce(F.lag("y_true").over(w), F.col("last_y"))
    return records.withColumns({"level_before": before, "g_hat": saar_growth(F.col("y_hat"), before), "g_true": saar_growth(F.col("y_true"), true_before)})


def relative_metrics(records: DataFrame, baseline: str, bucket: str | None = None) -> DataFrame:
    """RMSE and MAE by model and horizon, log versions, and RMSE relative to the baseline's; with a bucket, errors are averaged
    within the target quarter first."""
    rows = records.withColumn("e", _finite(error())).withColumn("le", F.when((F.col("y_hat") > 0) & (F.col("y_true") > 0), F.log(F.col("y_hat") / F.col("y_true"))))
    by = ["model", "h", *([bucket] if bucket else [])]
    if bucket:
        rows = rows.groupBy(*by, "series_id", "target_ord").agg(F.avg("e").alias("e"), F.avg("le").alias("le"))
    m = rows.groupBy(*by).agg(F.count("e").cast("long").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("le") * F.col("le"))).alias("rmse_log")).where("n > 0")
    base = m.where(F.col("model") == baseline).select(*by[1:], F.col("rmse").alias("_b"))
    return m.join(base, by[1:], "left").withColumn("rel_rmse", F.when(F.col("_b") > 0, F.col("rmse") / F.col("_b"))).drop("_b")


def window_means(records: DataFrame) -> DataFrame:
    """Per model the mean over windows of each window's RMSE and MAE."""
    e = _finite(error())
    each = records.groupBy("model", "series_id", "origin_ord").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return each.groupBy("model").agg(F.count("rmse").cast("long").alias("windows"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"))


def task_metrics(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, task, model, metric): a task is a series and a horizon (of a stage, or whatever `by` names), the metric its RMSE."""
    e, by = _finite(error()), by or []
    task = F.concat_ws("_h", F.concat_ws("__", "series_id", *by), "h").alias("task")
    return records.groupBy(*by, task, "model").agg(F.sqrt(F.avg(e * e)).alias("metric"))


def win_rates(tasks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of tasks in which the model's metric is the least; all ties win, null metrics don't count."""
    best = tasks.where("metric IS NOT NULL").withColumn("_m", F.min("metric").over(Window.partitionBy("task")))
    return best.groupBy(*(by or []), "model").agg(F.count(F.lit(1)).cast("long").alias("n_tasks"), F.avg((F.col("metric") == F.col("_m")).cast("double")).alias("win_rate"))


def leaderboard(tasks: DataFrame, baseline: str, by: list[str] | None = None) -> DataFrame:
    """n_tasks, mean metric, win rate, and skill = 1 - mean / baseline's mean on the tasks that both have; with `by` (columns that the
    task determines, such as its stage) a board for each."""
    by = by or []
    base = tasks.where((F.col("model") == baseline) & F.col("metric").isNotNull()).select("task", F.col("metric").alias("_b"))
    both = tasks.join(base, "task", "left")
    has = F.col("metric").isNotNull() & F.col("_b").isNotNull()
    mean = both.groupBy(*by, "model").agg(F.avg("metric").alias("mean_metric"), (1 - F.avg(F.when(has, F.col("metric"))) / F.avg(F.when(has, F.col("_b")))).alias("skill"))
    return mean.join(win_rates(tasks, by), [*by, "model"])


def pairwise(tasks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ordered pairs of models: win rate (ties half) and mean difference b - a over common tasks; with `by` (columns that the task
    determines) for each."""
    by = by or []
    a = tasks.where("metric IS NOT NULL").select(*by, "task", F.col("model").alias("model_a"), F.col("metric").alias("_a"))
    b = tasks.where("metric IS NOT NULL").select("task", F.col("model").alias("model_b"), F.col("metric").alias("_b"))
    win = F.when(F.col("_a") < F.col("_b"), 1.0).when(F.col("_a") == F.col("_b"), 0.5).otherwise(0.0)
    return a.join(b, "task").where("model_a <> model_b").groupBy(*by, "model_a", "model_b").agg(F.count(F.lit(1)).cast("long").alias("n"), F.avg(win).alias("win_rate"), F.avg(F.col("_b") - F.col("_a")).alias("mean_diff"))


def _ratios(tasks: DataFrame, baseline: str) -> DataFrame:
    """(statistic, model, other, task, num, den): every compared statistic as a ratio of sums over tasks. other is the second model of
    a pair, else empty."""
    known = tasks.where("metric IS NOT NULL").select("task", "model", "metric")
    one, none = F.lit(1.0), F.lit("")
    best = known.withColumn("_m", F.min("metric").over(Window.partitionBy("task")))
    base = known.where(F.col("model") == baseline).select("task", F.col("metric").alias("_b"))
    second = known.select("task", F.col("model").alias("other"), F.col("metric").alias("_b"))
    rows = [
        known.select(F.lit("mean").alias("statistic"), "model", none.alias("other"), "task", F.col("metric").alias("num"), one.alias("den")),
        best.select(F.lit("win_rate"), "model", none, "task", (F.col("metric") == F.col("_m")).cast("double"), one),
        known.join(base, "task").select(F.lit("skill"), "model", none, "task", "metric", "_b"),
        known.join(second, "task").where("model <> other").select(F.lit("difference"), "model", "other", "task", F.col("_b") - F.col("metric"), one),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


#: Draws that one task makes of a group at a time, and bytes of their counts that it remembers for the next group of that size.
BLOCK, KEPT = 250, 64 << 20


def _times(n: int, draws: range, seed: int) -> Iterator[np.ndarray]:
    """For each draw how often it takes each of n places: the j-th pick of draw b is a hash of (seed, b, j)."""
    for b in draws:
        picks = [int(hashlib.md5(f"{seed}|{b}|{j}".encode()).hexdigest()[:8], 16) for j in range(1, n + 1)]
        yield np.bincount(np.array(picks, np.int64) % n, minlength=n)


def bootstrap(tasks: DataFrame, baseline: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(statistic, model, other, value, low, high): 95 % percentile intervals of the mean metric, the win rate, the skill against the
    baseline and the mean difference of pairs (other's metric less model's).

    A draw takes as many tasks of a group as it has, by hashes of (seed, draw, place), so that a task that runs again draws the
    same. Draws are made where they are used: a group's rows go, in the order of their places, to a task for each BLOCK of draws,
    which counts how often each place is taken and sums with those counts; groups of one size follow each other and share the
    counts. Rows are the tasks' times the blocks. A skill without a baseline above zero is null."""
    group = ["statistic", "model", "other"]
    w = Window.partitionBy(*group)
    rows = _ratios(tasks, baseline).withColumns({"i": F.row_number().over(w.orderBy("task")) - 1, "n": F.count(F.lit(1)).over(w)})
    blocks = -(-draws // BLOCK)
    dealt = rows.select("n", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), *group, "i", F.col("num").cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    dealt = dealt.repartition("n", "block", *group).sortWithinPartitions("n", "block", *group, "i")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, held, key = (None, None), [], None

        def sums() -> Iterator[tuple]:
            nonlocal shared
            n, block = key[:2]
            span = range(block * BLOCK + 1, min(draws, (block + 1) * BLOCK) + 1)
            if shared[0] != (n, block):
                counts = _times(n, span, seed)
                shared = ((n, block), np.stack(list(counts)) if n * len(span) * 8 <= KEPT else None)
            values = np.array(held)
            each = shared[1] if shared[1] is not None else _times(n, span, seed)
            yield from ((*key[2:], *(times @ values).tolist()) for times in each)

        def ratios() -> Iterator[tuple]:
            nonlocal key, held
            for batch in batches:
                for *k, _, num, den in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if k != key:
                        if held:
                            yield from sums()
                        key, held = k, []
                    held.append((num, den))
            if held:
                yield from sums()

        rows, schema = ratios(), pa.schema([("statistic", pa.string()), ("model", pa.string()), ("other", pa.string()), ("num", pa.float64()), ("den", pa.float64())])
        while some := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    drawn = dealt.mapInArrow(made, "statistic string, model string, other string, num double, den double").withColumn("r", F.try_divide("num", "den"))
    whole = rows.groupBy(*group).agg(F.try_divide(F.sum("num"), F.sum("den")).alias("r"))
    value = F.when(F.col("statistic") == "skill", 1 - F.col("r")).otherwise(F.col("r"))
    q = drawn.groupBy(*group).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return whole.join(q, group).select(*group, value.alias("value"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def violations(forecasts: DataFrame, horizon: int, allow_null: bool = False) -> DataFrame:
    """(model, series_id, origin_ord, steps, bad) where there aren't exactly `horizon` steps, or a value is infinite or null."""
    bad = F.isnan("y_hat") | (F.abs("y_hat") == float("inf"))
    bad = F.coalesce(bad, F.lit(not allow_null))
    m = forecasts.groupBy("model", "series_id", "origin_ord").agg(F.countDistinct("h").cast("long").alias("steps"), F.sum(bad.cast("long")).alias("bad"))
    return m.where((F.col("steps") != horizon) | (F.col("bad") > 0))


def exchange_forecasts(records: DataFrame, variable: str = "y", metric: str = "levels") -> DataFrame:
    """The exchange schema of forecasts: target and vintage as quarter ends, forecast_horizon one less than the step."""
    return records.select(quarter_end(F.col("target_ord")).alias("date"), quarter_end(F.col("origin_ord") + 1).alias("vintage_date"), F.concat_ws("_", F.lit(variable), "series_id").alias("variable"), F.lit("Q").alias("frequency"), (F.col("h") - 1).alias("forecast_horizon"), F.col("y_hat").alias("value"), F.col("model").alias("source"), F.lit(metric).alias("metric"))


def exchange_outturns(stage_rows: DataFrame, variable: str = "y", metric: str = "levels") -> DataFrame:
    """The exchange schema of outturns; the vintage is the quarter end of the release, or of the next quarter without one."""
    q = (F.year("release_date") - 1970) * 4 + F.quarter("release_date") - 1
    q = F.coalesce(q, F.col("quarter_ord") + 1)
    return stage_rows.select(quarter_end(F.col("quarter_ord")).alias("date"), quarter_end(q).alias("vintage_date"), F.concat_ws("_", F.lit(variable), "series_id").alias("variable"), F.lit("Q").alias("frequency"), (F.col("quarter_ord") - q).cast("long").alias("forecast_horizon"), "value", F.lit(metric).alias("metric"))


def accuracy(forecasts: DataFrame, outturns: DataFrame, k: int = 0, same_dates: bool = False) -> DataFrame:
    """Bias, MAE, RMSE and count by source and horizon against the outturn k vintages after the first; with same_dates only over the
    range of dates, for each variable and horizon, that all its sources cover."""
    if same_dates:
        by = ["variable", "forecast_horizon"]
        spans = forecasts.groupBy(*by, "source").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
        common = spans.groupBy(*by).agg(F.max("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
        forecasts = forecasts.join(common, by).where(F.col("date").between(F.col("_lo"), F.col("_hi")))
    w = Window.partitionBy("variable", "date").orderBy("vintage_date")
    truth = outturns.withColumn("_k", F.dense_rank().over(w) - 1).where(F.col("_k") == k).groupBy("variable", "date").agg(F.max("value").alias("_t"))
    e = F.col("value") - F.col("_t")
    return forecasts.join(truth, ["variable", "date"]).groupBy("source", "forecast_horizon").agg(F.count(e).cast("long").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def _normal_tail(z: Column) -> Column:
    """Two-sided tail probability of the standard normal, by a published rational approximation (error under 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def loss_differences(records: DataFrame, benchmark: str) -> DataFrame:
    """(model, h, origin_ord, d): mean over series of the benchmark's squared error less the model's."""
    e = records.withColumn("e2", _finite(error()) * error())
    base = e.where(F.col("model") == benchmark).select("series_id", "origin_ord", "h", F.col("e2").alias("_b"))
    return e.where(F.col("model") != benchmark).join(base, ["series_id", "origin_ord", "h"]).groupBy("model", "h", "origin_ord").agg(F.avg(F.col("_b") - F.col("e2")).alias("d"))


#: Lags that the tests below keep; a step with more of them ends with an error that says so.
LAGS = 12


def _centred(differences: DataFrame, lags: int) -> DataFrame:
    """differences with n, i (the place by origin, from 1), mean_d and c (d less it) of their model and step, and c1, c2, ... the c of
    so many origins before."""
    g = Window.partitionBy("model", "h")
    w = g.orderBy("origin_ord")
    c = differences.withColumns({"n": F.count(F.lit(1)).over(g), "i": F.row_number().over(w), "mean_d": F.avg("d").over(g)}).withColumn("c", F.col("d") - F.col("mean_d"))
    return c.withColumns({f"c{k}": F.lag("c", k).over(w) for k in range(1, lags + 1)})


def _known(lags: int) -> Column:
    """True, or an error where a step needs more lags."""
    return F.when(F.col("h") - 1 > lags, F.raise_error(F.concat(F.lit(f"steps of up to {lags + 1} can be tested, here is one of "), F.col("h").cast("string"))).cast("boolean")).otherwise(True)


def _tested(m: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean_d, dm, p_value) from n, mean_d and lrv, with the small-sample correction."""
    n, h = F.col("n"), F.col("h")
    small = F.sqrt(F.greatest(F.lit(0.0), (n + 1 - 2 * h + h * (h - 1) / n) / n))
    dm = F.when((F.col("lrv") > 0) & (n > 1), F.col("mean_d") / F.sqrt(F.col("lrv") / n) * small)
    return m.withColumn("dm", dm).select(*by, "n", "mean_d", "dm", _normal_tail(F.col("dm")).alias("p_value"))


def diebold_mariano(differences: DataFrame, lags: int = LAGS) -> DataFrame:
    """(model, h, n, mean_d, dm, p_value): Diebold-Mariano with the small-sample correction; the long-run variance takes
    autocovariances up to h - 1, each from one lag of a window."""
    terms = F.col("c") * F.col("c")
    for k in range(1, lags + 1):
        terms = terms + F.when(F.col("h") > k, 2 * F.col("c") * F.coalesce(f"c{k}", F.lit(0.0))).otherwise(0.0)
    m = _centred(differences, lags).where(_known(lags)).groupBy("model", "h").agg(F.max("n").alias("n"), F.max("mean_d").alias("mean_d"), F.avg(terms).alias("lrv"))
    return _tested(m, ["model", "h"])


#: A long-run variance below this share of a run's mean square is what running sums leave of zero.
NOTHING = 1e-10


def _runs(differences: DataFrame, window: int, lags: int) -> DataFrame:
    """A row per run of `window` origins (of one less than there are, where a model and step has fewer), at its last origin: n (its
    width), window_end (its last place), mean_d, square (mean of c * c) and lrv.

    Sums of a run are differences of sums up to its ends: of c, and of c times its k-th lag. So each origin is one row, whatever
    the window; sums at places that the window fixes are lags, the others are the first few of a model and step."""
    g = Window.partitionBy("model", "h")
    w = g.orderBy("origin_ord")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    c = _centred(differences, lags).withColumn("_p0", F.sum(F.col("c") * F.col("c")).over(upto))
    c = c.withColumns({"_s": F.sum("c").over(upto), **{f"_p{k}": F.sum(F.coalesce(F.col("c") * F.col(f"c{k}"), F.lit(0.0))).over(upto) for k in range(1, lags + 1)}})
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.col("i"), F.col("n")
    width = F.least(F.lit(window), n - 1)

    def start(name: str, k: int) -> Column:
        """The sum up to the place k after the one before the run."""
        far = F.coalesce(F.lag(name, window - k).over(w), F.lit(0.0)) if k < window else F.col(name)
        at = lambda j: F.nth_value(name, j).over(whole) if j else F.lit(0.0)
        return F.when(n > window, far).otherwise(F.when(i == n, at(k + 1)).otherwise(at(k)))

    before = {"_s": start("_s", 0), "_q": start("_p0", 0)}
    for k in range(1, lags + 1):
        before |= {f"_a{k}": start(f"_p{k}", k), f"_b{k}": start("_s", k), f"_e{k}": F.lag("_s", k).over(w)}
    r = c.withColumns({f"{name}_0": x for name, x in before.items()}).withColumn("width", width).where((F.col("width") > 0) & (i >= F.col("width")))
    mean = (F.col("_s") - F.col("_s_0")) / F.col("width")
    square = (F.col("_p0") - F.col("_q_0")) / F.col("width")
    lrv = square - mean * mean
    for k in range(1, lags + 1):
        # The products of deviations from the run's mean, over the pairs that lie in the run.
        pairs = F.col("width") - k
        cross = F.col(f"_p{k}") - F.col(f"_a{k}_0") - mean * (F.col("_s") - F.col(f"_b{k}_0") + F.coalesce(f"_e{k}_0", F.lit(0.0)) - F.col("_s_0")) + pairs * mean * mean
        lrv = lrv + F.when((F.col("h") > k) & (pairs > 0), 2 * cross / F.col("width")).otherwise(0.0)
    r = r.select("model", "h", i.cast("long").alias("window_end"), "origin_ord", F.col("width").cast("long").alias("n"), (F.col("mean_d") + mean).alias("mean_d"), square.alias("square"), lrv.alias("lrv"))
    return r.withColumn("lrv", F.when(F.abs("lrv") > NOTHING * F.col("square"), F.col("lrv")).otherwise(0.0))


def rolling_diebold_mariano(differences: DataFrame, window: int = 40, lags: int = LAGS) -> DataFrame:
    """(model, h, window_end, n, mean_d, dm, p_value): the statistic over each run of `window` origins, of fewer where there are fewer,
    from running sums."""
    return _tested(_runs(differences.where(_known(lags)), window, lags), ["model", "h", "window_end"])


def fluctuation(differences: DataFrame, window: int = 40, critical: float = 2.77) -> DataFrame:
    """(model, h, max_stat, rejects): the largest standardised mean over runs as in rolling_diebold_mariano() against a critical
    value; scaled by the whole sample's variance."""
    whole = differences.groupBy("model", "h").agg(F.stddev_pop("d").alias("sd"))
    stat = F.when(F.col("sd") > 0, F.abs("mean_d") * F.sqrt("n") / F.col("sd"))
    return _runs(differences, window, 0).join(whole, ["model", "h"]).groupBy("model", "h").agg(F.max(stat).alias("max_stat")).withColumn("rejects", F.col("max_stat") > critical)


def moving_error(records: DataFrame, k: int = 4) -> DataFrame:
    """(model, h, origin_ord, error, moving): mean error by origin and its moving average over k origins."""
    each = records.groupBy("model", "h", "origin_ord").agg(F.avg(_finite(error())).alias("error"))
    return each.withColumn("moving", F.avg("error").over(Window.partitionBy("model", "h").orderBy("origin_ord").rowsBetween(-(k - 1), 0)))


def error_histogram(records: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """(model, bin, n): relative errors in equal bins, 0 and bins + 1 for what is outside."""
    e = F.when(F.col("y_true") != 0, error() / F.col("y_true"))
    bin_ = F.when(e < low, 0).when(e >= high, bins + 1).otherwise(F.floor((e - low) / (high - low) * bins) + 1).cast("long")
    return records.where(e.isNotNull()).groupBy("model", bin_.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def top_models(board: DataFrame, k: int, by: str = "skill", exclude: list[str] | None = None, over: float | None = None) -> DataFrame:
    """The k best models by skill (or win rate, then mean metric), some left out; with `over` only those of a greater skill."""
    if over is not None:
        board = board.where(F.col("skill") > over)
    order = [F.desc("skill"), F.asc("model")] if by == "skill" else [F.desc("win_rate"), F.asc("mean_metric"), F.asc("model")]
    return board.where(~F.col("model").isin(exclude or [""])).orderBy(*order).limit(k)


def worst(rows: DataFrame, by: list[str], measure: str, k: int = 5) -> DataFrame:
    """The k rows of largest absolute measure, one of each `by`."""
    one = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs(F.col(measure)))))
    return rows.where(F.col(measure).isNotNull()).withColumn("_r", one).where("_r = 1").drop("_r").orderBy(F.desc(F.abs(F.col(measure))), *by).limit(k)


def truth_check(records: DataFrame, truth: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: rows checked, largest and mean absolute difference to the truth, and bad ones (over tolerance, or missing)."""
    d = F.abs(F.col("y_true") - F.col("_t"))
    both = records.join(truth.select("series_id", F.col("quarter_ord").alias("target_ord"), F.col("y").alias("_t")), ["series_id", "target_ord"], "left")
    return both.agg(F.count(F.lit(1)).cast("long").alias("n"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.sum(F.coalesce((d > tolerance).cast("long"), F.lit(1).cast("long"))).alias("bad"))


def timing_report(timings: DataFrame, k: int = 10) -> DataFrame:
    """Per model, from rows (model, windows, prep_s, infer_s): most windows, mean preparation, inference and its share a window;
    the k slowest."""
    m = timings.groupBy("model").agg(F.max("windows").alias("windows"), F.avg("prep_s").alias("prep_s"), F.sum("infer_s").alias("infer_s"))
    return m.withColumn("per_window_s", F.try_divide("infer_s", "windows")).orderBy(F.desc("infer_s"), "model").limit(k)


def runtime_medians(timings: DataFrame) -> DataFrame:
    """Median preparation and inference times per model, how many metrics are null, and the share of tasks whose data the model was
    trained on (a flag `overlap`, null where the rows have none)."""
    overlap = F.avg(F.col("overlap").cast("double")) if "overlap" in timings.columns else F.lit(None).cast("double")
    return timings.groupBy("model").agg(F.percentile("prep_s", 0.5).alias("prep_s"), F.percentile("infer_s", 0.5).alias("infer_s"), overlap.alias("overlap"), F.sum(F.col("metric").isNull().cast("long")).alias("failed"))


def calibration(constructed: DataFrame, template: DataFrame, key: list[str], least: int = 8) -> DataFrame:
    """(series_id, scale, error, n): of scale 1 and the median ratio, that with the smaller median relative error, for candidates
    (series_id, value) against the template's value on `least` or more common non-zero points."""
    both = constructed.join(template.select(*key, F.col("value").alias("_t")), key).where("value <> 0 AND _t <> 0")
    ratio = both.groupBy("series_id").agg(F.percentile(F.col("_t") / F.col("value"), 0.5).alias("_r"), F.count(F.lit(1)).cast("long").alias("n")).where(F.col("n") >= least)
    err = lambda s: F.abs((s * F.col("value") - F.col("_t")) / F.col("_t"))
    m = both.join(ratio, "series_id").groupBy("series_id").agg(F.percentile(err(F.lit(1.0)), 0.5).alias("_e1"), F.percentile(err(F.col("_r")), 0.5).alias("_er"), F.max("_r").alias("_r"), F.max("n").alias("n"))
    return m.select("series_id", F.when(F.col("_er") < F.col("_e1"), F.col("_r")).otherwise(1.0).alias("scale"), F.least("_e1", "_er").alias("error"), "n")


def covariate_diagnostics(long: DataFrame, tail_from: Column, least: int = 20, z_limit: float = 8.0, k: int = 10) -> DataFrame:
    """(variable, tail_missing, robust_z): share of missing values in the tail, and the last value's distance from the median in
    median absolute deviations (standard deviations where those are tiny); the k most suspect."""
    med = long.groupBy("variable").agg(F.percentile("x", 0.5).alias("_m"), F.count("x").alias("n"), F.stddev_pop("x").alias("_sd"), F.expr("max_by(x, month_date) FILTER (WHERE x IS NOT NULL)").alias("_last"), F.avg(F.when(tail_from, F.col("x").isNull().cast("double"))).alias("tail_missing"))
    mad = long.join(med.select("variable", "_m"), "variable").groupBy("variable").agg(F.percentile(F.abs(F.col("x") - F.col("_m")), 0.5).alias("_mad"))
    scale = F.when(F.col("_mad") > 1e-9, F.col("_mad")).otherwise(F.col("_sd"))
    out = med.join(mad, "variable").where(F.col("n") >= least).withColumn("robust_z", F.when(scale > 0, F.abs(F.col("_last") - F.col("_m")) / scale))
    return out.withColumn("suspect", F.coalesce(F.col("robust_z") >= z_limit, F.lit(False))).select("variable", "tail_missing", "robust_z", "suspect").orderBy(F.desc_nulls_last("robust_z"), "variable").limit(k)


def panel_statistics(panel: DataFrame, vintage: str, variable: str, ts: str) -> DataFrame:
    return panel.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.countDistinct(vintage).cast("long").alias("n_vintages"), F.countDistinct(variable).cast("long").alias("n_variables"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def coverage(template: DataFrame, fetched: DataFrame, k: int = 20) -> DataFrame:
    """(series_id, cells, present, pct): the template's non-null cells that the fetched panel has too, on dates that both have; the k
    largest gaps."""
    t, f = template.where("value IS NOT NULL").select("series_id", "obs_date"), fetched.where("value IS NOT NULL").select("series_id", "obs_date")
    t = t.join(f.select("obs_date").distinct(), "obs_date", "left_semi")
    m = t.join(f.withColumn("_p", F.lit(1)), ["series_id", "obs_date"], "left").groupBy("series_id").agg(F.count(F.lit(1)).cast("long").alias("cells"), F.count("_p").cast("long").alias("present"))
    return m.withColumn("pct", 100.0 * F.col("present") / F.col("cells")).orderBy("pct", "series_id").limit(k)


def changed_cells(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """One row: cells that both panels have, and how many differ (nulls compare as values)."""
    both = before.select(*key, F.col("value").alias("_a")).join(after.select(*key, F.col("value").alias("_b")), key)
    return both.agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum((~F.col("_a").eqNullSafe(F.col("_b"))).cast("long")).alias("changed"))


def hedgehog(records: DataFrame, panel: DataFrame) -> DataFrame:
    """(model, series_id, origin_ord, quarter_ord, value, actual): each forecast path, begun at its last observed value, beside what
    came (the table behind a hedgehog chart)."""
    path = records.select("model", "series_id", "origin_ord", F.col("target_ord").alias("quarter_ord"), F.col("y_hat").alias("value"))
    start = records.groupBy("model", "series_id", "origin_ord").agg(F.max("last_y").alias("value")).withColumn("quarter_ord", F.col("origin_ord"))
    return path.unionByName(start).join(panel.select("series_id", "quarter_ord", F.col("y").alias("actual")), ["series_id", "quarter_ord"], "left")
