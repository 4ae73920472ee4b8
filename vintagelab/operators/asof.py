"""What was known when: snapshots of versioned observations, vintage selection and as-of overlays.

versions have (series_id, obs_date, asof_date, value): a value of an observation date as published on an as-of date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _versions_upto(versions: DataFrame, cutoff: str | Column | None, series: Sequence[str] | DataFrame | None, start: str | None, end: str | None) -> DataFrame:
    if cutoff is not None:
        versions = versions.where(F.col("asof_date") <= (F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff))
    if start:
        versions = versions.where(F.col("obs_date") >= F.lit(start).cast("date"))
    if end:
        versions = versions.where(F.col("obs_date") <= F.lit(end).cast("date"))
    if isinstance(series, DataFrame):
        return versions.join(series.select("series_id").distinct(), "series_id", "left_semi")
    return versions.where(F.col("series_id").isin(list(series))) if series is not None else versions


def snapshot_long(versions: DataFrame, cutoff: str, series: Sequence[str] | DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(series_id, obs_date, value, asof_used): the last non-null value of each observation known on the cutoff; asof_used is the
    last as-of date, that of a null value included. Filters reach the scan; one shuffle on (series, observation)."""
    known = _versions_upto(versions, cutoff, series, start, end)
    value = F.expr("max_by(value, asof_date) FILTER (WHERE value IS NOT NULL)")
    return known.groupBy("series_id", "obs_date").agg(value.alias("value"), F.max("asof_date").alias("asof_used"))


def snapshot_wide(versions: DataFrame, cutoff: str, series: Sequence[str]) -> DataFrame:
    """A column per series named, so the pivot needs no pass to find them."""
    return snapshot_long(versions, cutoff, series).groupBy("obs_date").pivot("series_id", list(series)).agg(F.first("value"))


def intervals(versions: DataFrame) -> DataFrame:
    """versions with the last non-null value up to each one as its value, and valid_to: the as-of date that ends it (null for the
    last)."""
    w = Window.partitionBy("series_id", "obs_date").orderBy("asof_date")
    return versions.withColumns({"value": F.last("value", True).over(w), "valid_to": F.lead("asof_date").over(w)})


def _month(c: Column) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("int")


def _indexed(days: DataFrame) -> DataFrame:
    """A calendar's row _days with its first and last month, and how many days lie before each month from the first to the one after
    the last."""
    days = days.select("_days", _month(F.array_min("_days")).alias("_first"), _month(F.array_max("_days")).alias("_last"))
    return days.withColumn("_before", F.transform(F.sequence("_first", F.col("_last") + 1), lambda m: F.size(F.filter("_days", lambda d: _month(d) < m))))


def snapshots(versions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, series_id, obs_date, value, asof_used) for many cutoffs (column cutoff) at once: for each what snapshot_long() gives.

    The distinct cutoffs, days of a calendar, are one row: a sorted array, and how many of them lie before each month. A version
    takes from it the slice of the months in which it is valid and makes rows of the cutoffs inside alone, so nothing is joined
    and the work is that of the result."""
    days = cutoffs.select(F.col("cutoff").cast("date").alias("cutoff")).agg(F.array_sort(F.collect_set("cutoff")).alias("_days")).where(F.size("_days") > 0)
    held = intervals(versions).crossJoin(F.broadcast(_indexed(days)))
    held = held.withColumn("_from", F.greatest(_month(F.col("asof_date")), F.col("_first")))
    held = held.withColumn("_to", F.least(F.coalesce(_month(F.col("valid_to")), F.col("_last")), F.col("_last"))).where("_from <= _to")
    at, end = F.get("_before", F.col("_from") - F.col("_first")), F.get("_before", F.col("_to") - F.col("_first") + 1)
    inside = F.filter(F.slice("_days", at + 1, end - at), lambda d: (d >= F.col("asof_date")) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))))
    return held.select(F.explode(inside).alias("cutoff"), "series_id", "obs_date", "value", F.col("asof_date").alias("asof_used"))


def _bucket(df: DataFrame, ts: str, width: int) -> Column:
    """The run of `width` units in which a time is: days of a date or timestamp, else units of a number."""
    kind = df.schema[ts].dataType
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(ts) / width).cast("long")
    day = F.unix_date(F.col(ts).cast("date"))
    return F.floor(day / width).cast("long")


def _number(df: DataFrame, ts: str) -> Column:
    """A right row's time as a number, by which times can be ordered the other way."""
    at = F.col("_r.ts")
    return at if isinstance(df.schema[ts].dataType, T.NumericType) else F.unix_micros(at.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, value: str, direction: str = "backward", width: int = 92) -> DataFrame:
    """left with `matched_ts` and `matched`: right's nearest row at or before left_ts (backward), or at or after it (forward).

    A key's time is cut into buckets of `width` days (units, where times are numbers), and a bucket is what a task sorts, so a key
    with any number of rows spreads over its buckets. A small table has the last (forward: the first) right row of each bucket; a
    window over it carries that row to the key's next buckets, where it enters the stream of both sides ahead of (behind) all
    others. Right rows without a time match nothing and left rows without one get none; of right rows at one time that with the
    greatest value counts; null keys are equal."""
    back = direction == "backward"
    r = right.where(F.col(right_ts).isNotNull()).select(*by, _bucket(right, right_ts, width).alias("_b"), F.col(right_ts).alias("_ts"), F.struct(F.col(right_ts).alias("ts"), F.col(value).alias("v")).alias("_r"))
    l = left.select(*by, _bucket(left, left_ts, width).alias("_b"), F.col(left_ts).alias("_ts"), F.struct("*").alias("_l"))  # noqa: E741
    nearest = F.max("_r") if back else F.max_by("_r", F.struct(-_number(right, right_ts), F.col("_r")))
    both = r.select(*by, "_b", "_r").unionByName(l.where("_b IS NOT NULL").select(*by, "_b", F.lit(None).cast(r.schema["_r"].dataType).alias("_r")))
    known = both.groupBy(*by, "_b").agg(nearest.alias("_r"))
    w = Window.partitionBy(*by).orderBy("_b")
    carried = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if back else F.first("_r", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    far = known.select(*by, "_b", carried.alias("_r")).where("_r IS NOT NULL").withColumns({"_ts": F.col("_r.ts"), "_side": F.lit(0 if back else 2)})
    stream = r.withColumn("_side", F.lit(0 if back else 2)).unionByName(far).unionByName(l.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    within = Window.partitionBy(*by, "_b").orderBy("_ts", "_side", F.col("_r.v") if back else F.col("_r.v").desc())
    picked = F.last("_r", True).over(within.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("_r", True).over(within.rowsBetween(0, Window.unboundedFollowing))
    return stream.withColumn("_m", picked).where("_l IS NOT NULL").select("_l.*", F.col("_m.ts").alias("matched_ts"), F.col("_m.v").alias("matched"))


def _days(vintages: DataFrame) -> DataFrame:
    """One row with the sorted array of distinct as-of days: a calendar, which has a few hundred days a year at most."""
    return vintages.agg(F.array_sort(F.collect_set("asof_date")).alias("_days"))


def calendar(vintages: DataFrame) -> DataFrame:
    """(vintage, asof_date, next_asof_date) from rows with vintage and asof_date."""
    days = vintages.select("vintage", "asof_date").distinct()
    after = F.get(F.col("_days"), F.array_position("_days", F.col("asof_date")).cast("int"))
    return days.crossJoin(F.broadcast(_days(vintages))).select("vintage", "asof_date", after.alias("next_asof_date"))


def select_vintage(origins: DataFrame, vintages: DataFrame, origin: str = "origin", direction: str = "backward", fallback: bool = False, strict: bool = False) -> DataFrame:
    """origins with vintage_date: the last vintage at or before the origin (or the next at or after it).

    fallback: the earliest vintage where none is early enough, and used_fallback; otherwise null, for the caller to count, or with
    strict an error as the job reads that origin. The calendar is one row, so origins aren't shuffled; with it goes how many of its
    days lie before each month, so that an origin looks at its own month's days alone."""
    days, at = F.col("_days"), F.col(origin).cast("date")
    place = F.least(F.greatest(_month(at) - F.col("_first"), F.lit(0)), F.size("_before") - 1)
    early = F.get("_before", place)
    near = F.slice(days, early + 1, F.coalesce(F.get("_before", place + 1), F.size(days)) - early)
    if direction == "backward":
        found = F.coalesce(F.array_max(F.filter(near, lambda d: d <= at)), F.when(_month(at) >= F.col("_first"), F.get(days, early - 1)))
    else:
        found = F.coalesce(F.array_min(F.filter(near, lambda d: d >= at)), F.get(days, early + F.size(near)))
    out = origins.crossJoin(F.broadcast(_indexed(_days(vintages)))).withColumn("vintage_date", F.when(at.isNotNull(), found)).drop("_first", "_last", "_before")
    if strict:
        missing = F.concat(F.lit("no vintage for the origin "), F.coalesce(F.col(origin).cast("string"), F.lit("null")))
        out = out.withColumn("vintage_date", F.coalesce("vintage_date", F.raise_error(missing).cast("date")))
    if fallback:
        out = out.withColumns({"used_fallback": F.col("vintage_date").isNull(), "vintage_date": F.coalesce("vintage_date", F.array_min(days))})
    return out.drop("_days")


def same_vintage_growth(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (series_id, vintage_date, quarter_ord) with level and level_before, both from that one vintage of the panel."""
    at = panel.select("series_id", "vintage_date", "quarter_ord", F.col("value").alias("level"))
    before = panel.select("series_id", "vintage_date", (F.col("quarter_ord") + 1).alias("quarter_ord"), F.col("value").alias("level_before"))
    key = ["series_id", "vintage_date", "quarter_ord"]
    return wanted.join(at, key, "left").join(before, key, "left")


def overlay(base: DataFrame, snapshot: DataFrame, key: list[str], y: str) -> DataFrame:
    """base with y replaced by the snapshot's value where that isn't null, and `changed`."""
    new = snapshot.select(*key, F.col("value").alias("_new"))
    out = base.join(new, key, "left").withColumn("changed", F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(y)))
    return out.withColumn(y, F.coalesce("_new", y)).drop("_new")


def swap_history(windows: DataFrame, panel: DataFrame) -> DataFrame:
    """Training rows of windows (series_id, window_idx, cutoff, quarter_ord, y, vintage_date): y from the window's vintage where the
    panel (series_id, vintage_date, quarter_ord, value) has it, else as given."""
    new = panel.select("series_id", "vintage_date", "quarter_ord", F.col("value").alias("_new"))
    return windows.join(new, ["series_id", "vintage_date", "quarter_ord"], "left").withColumn("y", F.coalesce("_new", "y")).drop("_new")


def quarterly_last(df: DataFrame, by: list[str], date: str, columns: list[str]) -> DataFrame:
    """The last non-null value of each column in each quarter."""
    q = ((F.year(date) - 1970) * 4 + F.quarter(date) - 1).cast("long").alias("quarter_ord")
    return df.groupBy(*by, q).agg(*[F.expr(f"max_by(`{c}`, `{date}`) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in columns])


def quarterly_mean(df: DataFrame, by: list[str], date: str, y: str) -> DataFrame:
    """Mean by quarter of what there is."""
    q = ((F.year(date) - 1970) * 4 + F.quarter(date) - 1).cast("long").alias("quarter_ord")
    return df.groupBy(*by, q).agg(F.avg(y).alias(y), F.count(y).alias("n"))


def asof_dates(versions: DataFrame, series: Sequence[str], start: str, end: str) -> DataFrame:
    """Distinct as-of dates of the series from start to end, both days included."""
    return versions.where(F.col("series_id").isin(list(series)) & F.col("asof_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("asof_date").distinct()


def high_water(versions: DataFrame) -> DataFrame:
    return versions.groupBy("series_id").agg(F.max("asof_date").alias("max_asof"))


def resolve(variables: DataFrame, aliases: DataFrame, available: DataFrame, universes: Sequence[str]) -> DataFrame:
    """variables (variable) with series_id: the alias of the first universe that has one, else the first candidate name that is
    available; null where there is none."""
    from ..functions.scalars import alias_candidates

    rank = F.array_position(F.array(*map(F.lit, universes)), F.col("universe")).cast("int")
    named = aliases.where(F.col("universe").isin(list(universes))).select(F.col("variable_name").alias("variable"), F.col("series_id").alias("found"), rank.alias("priority"))
    tried = variables.select("variable", F.posexplode(alias_candidates(F.col("variable"))).alias("at", "found")).join(available.select(F.col("series_id").alias("found")).distinct(), "found", "left_semi")
    both = named.select("variable", "found", "priority").unionByName(tried.select("variable", "found", (F.col("at") + 1000).alias("priority")))
    best = both.groupBy("variable").agg(F.min_by("found", "priority").alias("series_id"))
    return variables.select("variable").distinct().join(best, "variable", "left")
