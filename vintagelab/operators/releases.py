"""First, second, third and latest releases, growth from one vintage, validation, and forecast origins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import level_before, quarter_ord, saar_growth

STAGES = ("first", "second", "third", "latest")


def releases(versions: DataFrame) -> DataFrame:
    """(series_id, obs_date, quarter_ord, {stage}_release, {stage}_date): the 1st, 2nd, 3rd and last non-null version of each
    observation; equal values count as releases. One window per observation, no join."""
    w = Window.partitionBy("series_id", "obs_date").orderBy("asof_date")
    ranked = versions.where(F.col("value").isNotNull()).withColumn("_n", F.row_number().over(w))
    picks = []
    for n, stage in enumerate(STAGES[:3], 1):
        picks += [F.max(F.when(F.col("_n") == n, F.col("value"))).alias(f"{stage}_release"), F.max(F.when(F.col("_n") == n, F.col("asof_date"))).alias(f"{stage}_date")]
    picks += [F.max_by("value", "asof_date").alias("latest_release"), F.max("asof_date").alias("latest_date")]
    return ranked.groupBy("series_id", "obs_date").agg(*picks).withColumn("quarter_ord", quarter_ord(F.col("obs_date")))


def stage_rows(wide: DataFrame) -> DataFrame:
    """(series_id, quarter_ord, obs_date, stage, value, release_date): a row per stage that has a release."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"{s}_release").alias("value"), F.col(f"{s}_date").alias("release_date")) for s in STAGES]))
    return wide.select("series_id", "quarter_ord", "obs_date", rows.alias("r")).select("series_id", "quarter_ord", "obs_date", "r.*").where("value IS NOT NULL")


def stage_columns(rows: DataFrame) -> DataFrame:
    """stage_rows() turned back."""
    picks = [F.max(F.when(F.col("stage") == s, F.col(c))).alias(n) for s in STAGES for c, n in (("value", f"{s}_release"), ("release_date", f"{s}_date"))]
    return rows.groupBy("series_id", "quarter_ord", "obs_date").agg(*picks)


def same_release_growth(versions: DataFrame) -> DataFrame:
    """stage_rows() with level_before, the quarter before as it stood in the stage's own vintage (its version of that very
    as-of date), and saar; null unless both are positive."""
    rows = stage_rows(releases(versions))
    before = versions.select("series_id", (quarter_ord(F.col("obs_date")) + 1).alias("quarter_ord"), F.col("asof_date").alias("release_date"), F.col("value").alias("level_before"))
    out = rows.join(before, ["series_id", "quarter_ord", "release_date"], "left")
    return out.withColumn("saar", saar_growth(F.col("value"), F.col("level_before")))


def latest_growth(wide: DataFrame) -> DataFrame:
    """wide with latest_prev (by row), latest_saar and the days from the quarter's end to each release."""
    w = Window.partitionBy("series_id").orderBy("obs_date")
    end = F.last_day(F.add_months("obs_date", 2))
    out = wide.withColumn("latest_prev", F.lag("latest_release").over(w)).withColumn("latest_saar", saar_growth(F.col("latest_release"), F.col("latest_prev")))
    return out.withColumns({f"{s}_lag_days": F.datediff(f"{s}_date", end).cast("long") for s in STAGES[:3]})


def validation_flags(growth: DataFrame, shock: list[int], ratio_from: int, delta_from: int, abs_limit: float = 15.0, delta_limit: float = 12.0) -> DataFrame:
    """A row per flag of stage growth rows (series_id, quarter_ord, stage, value, level_before, saar, panel_level).

    Growth over abs_limit; its change over delta_limit from delta_from on, shock quarters and those after them excepted; a
    panel level outside 0.98 to 1.02 of the release from ratio_from on; a missing level before."""
    w = Window.partitionBy("series_id", "stage").orderBy("quarter_ord")
    calm = ~(F.col("quarter_ord").isin(shock) | (F.col("quarter_ord") - 1).isin(shock))
    ratio = F.col("panel_level") / F.col("value")
    rules = {
        "growth": calm & (F.abs("saar") > abs_limit),
        "change": calm & (F.col("quarter_ord") >= delta_from) & (F.abs(F.col("saar") - F.col("_s1")) > delta_limit),
        "ratio": (F.col("quarter_ord") >= ratio_from) & ~ratio.between(0.98, 1.02),
        "missing": F.col("level_before").isNull(),
    }
    flags = F.explode(F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda f: f.isNotNull()))
    return growth.withColumn("_s1", F.lag("saar").over(w)).select("series_id", "quarter_ord", "stage", flags.alias("flag"))


def export(growth: DataFrame) -> DataFrame:
    """(series_id, quarter_ord, stage, release_date, saar, level_before), the level backed out of growth where it isn't known."""
    back = F.coalesce("level_before", level_before(F.col("value"), F.col("saar")))
    return growth.select("series_id", "quarter_ord", "stage", "release_date", "saar", back.alias("level_before"))


def valid_origins(wide: DataFrame, least: int = 60, most: int = 200) -> DataFrame:
    """wide with lag_days (its own where it has them) and valid_origin: a first release with a value and a date, least to most days
    after the quarter began."""
    lag = F.col("lag_days").cast("long") if "lag_days" in wide.columns else F.datediff("first_date", F.col("obs_date")).cast("long")
    known = F.col("first_release").isNotNull() & F.col("first_date").isNotNull()
    return wide.withColumn("lag_days", lag).withColumn("valid_origin", F.coalesce(known & F.col("lag_days").between(least, most), F.lit(False)))


def first_growth(wide: DataFrame, column: str = "first_saar") -> DataFrame:
    """wide with first_growth, the annualised growth that the first release told: the column where the table has it, else, as a
    makeshift that mixes vintages, that of the first release on the quarter before's."""
    if column in wide.columns:
        return wide.withColumn("first_growth", F.col(column).try_cast("double"))
    w = Window.partitionBy("series_id").orderBy("quarter_ord")
    return wide.withColumn("first_growth", saar_growth(F.col("first_release"), F.lag("first_release").over(w)))


def quarterly_origins(wide: DataFrame) -> DataFrame:
    """(series_id, target_ord, observed_ord, origin): the day before each first release, when the quarter before is observed."""
    return wide.where("first_date IS NOT NULL").select("series_id", F.col("quarter_ord").alias("target_ord"), (F.col("quarter_ord") - 1).alias("observed_ord"), F.date_sub("first_date", 1).alias("origin"))


def monthly_origins(panel: DataFrame) -> DataFrame:
    """(series_id, vintage_date, observed_ord) from a vintage panel: the last quarter with a value."""
    return panel.groupBy("series_id", "vintage_date").agg(F.max(F.when(F.col("value").isNotNull(), F.col("quarter_ord"))).alias("observed_ord"))


def training_sets(origins: DataFrame, panel: DataFrame, ragged: int = 0, least: int = 0) -> DataFrame:
    """Rows of the panel (series_id, vintage_date, quarter_ord, value) that each origin (series_id, vintage_date, observed_ord) may
    train on: up to the observed quarter, and `ragged` quarters more with the target masked. Origins with fewer than `least`
    observed values are left out. No training row has a target after the observed quarter."""
    joined = origins.join(panel, ["series_id", "vintage_date"]).where(F.col("quarter_ord") <= F.col("observed_ord") + ragged)
    masked = joined.withColumn("value", F.when(F.col("quarter_ord") <= F.col("observed_ord"), F.col("value")))
    n = F.count("value").over(Window.partitionBy("series_id", "vintage_date", "observed_ord"))
    return masked.withColumn("n_train", n).where(F.col("n_train") >= least)


def rolling_windows(panel: DataFrame, windows: int, horizon: int, by: list[str], ts: str) -> DataFrame:
    """(by, window_idx, cutoff_ts): the cutoff's place is n - horizon - (windows - 1 - window_idx), counted from 1; step 1."""
    n = Window.partitionBy(*by)
    numbered = panel.select(*by, ts).distinct().withColumns({"_i": F.row_number().over(n.orderBy(ts)), "_n": F.count(F.lit(1)).over(n)})
    idx = F.col("_i") - F.col("_n") + horizon + windows - 1
    return numbered.withColumn("window_idx", idx.cast("long")).where((F.col("window_idx") >= 0) & (F.col("window_idx") < windows)).select(*by, "window_idx", F.col(ts).alias("cutoff_ts"))


def usable_windows(windows: DataFrame, by: list[str]) -> DataFrame:
    """(by, usable): windows in a row from the last one back that are `ok`."""
    return windows.groupBy(*by).agg((F.max("window_idx") - F.coalesce(F.max(F.when(~F.col("ok"), F.col("window_idx"))), F.lit(-1))).alias("usable"))


def truth_overlay(frame: DataFrame, wide: DataFrame, stage: str, metric: str = "level") -> DataFrame:
    """frame (series_id, quarter_ord, ...) with y from the stage's release, transformed by metric; rows without one are dropped."""
    from ..functions.scalars import target_transforms

    w = Window.partitionBy("series_id").orderBy("quarter_ord")
    truth = wide.select("series_id", "quarter_ord", F.col(f"{stage}_release").alias("_y")).where("_y IS NOT NULL").withColumn("_b", F.lag("_y").over(w))
    truth = truth.select("series_id", "quarter_ord", target_transforms(F.col("_y"), F.col("_b"))[metric].alias("y")).where("y IS NOT NULL")
    return frame.drop("y").join(truth, ["series_id", "quarter_ord"])
