"""Covariates: selection, lags, future values, month slots and shock adjustment, all in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_covariates(long: DataFrame, required: list[str] | None = None, preferred: list[str] | None = None, least: int = 8, cap: int = 120, by: list[str] | None = None, name: str = "variable", value: str = "x") -> DataFrame:
    """(by, variable, rank): required ones first, then preferred in their order, then by name; at least `least` values, `cap` at most."""
    by = by or []
    n = long.groupBy(*by, name).agg(F.count(value).alias("n"))
    place = F.array_position(F.array(*map(F.lit, preferred or [""])), F.col(name))
    order = [F.when(F.col(name).isin(required or []), 0).otherwise(1), F.when(place > 0, place).otherwise(1 << 30), F.col(name)]
    kept = n.where((F.col("n") >= least) | F.col(name).isin(required or []))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= cap).select(*by, name, "rank")


def lag_matrix(df: DataFrame, by: list[str], ts: str, y: str, lags: int, covariates: list[str] | None = None) -> DataFrame:
    """df with y_lag1.. and, for each covariate, its lags."""
    w = Window.partitionBy(*by).orderBy(ts)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in [y, *(covariates or [])] for k in range(1, lags + 1)})


def future_covariates(cutoffs: DataFrame, covariates: DataFrame, horizon: int) -> DataFrame:
    """(series_id, cutoff_ord, h, x): the covariate known for the quarter, else the last known value carried on."""
    steps = cutoffs.select("series_id", "cutoff_ord", F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("h")).withColumn("quarter_ord", F.col("cutoff_ord") + F.col("h"))
    known = steps.join(covariates.select("series_id", "quarter_ord", "x"), ["series_id", "quarter_ord"], "left")
    w = Window.partitionBy("series_id", "cutoff_ord").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return known.withColumn("x", F.last("x", True).over(w)).where("h > 0").select("series_id", "cutoff_ord", F.col("h").cast("long").alias("h"), "x")


def shock_adjusted(df: DataFrame, by: list[str], q: str, y: str, shock: list[int], least: int = 8) -> DataFrame:
    """df with effect and adjusted: the least-squares effect of a dummy per shock quarter, taken off the target.

    With each quarter once in a group, the intercept is the mean of the other rows and each effect what is left; groups with
    fewer than max(least, active + 2) rows stay as they are."""
    hit = F.col(q).isin(shock) & F.col(y).isNotNull()
    g = df.groupBy(*by).agg(F.avg(F.when(~hit, F.col(y))).alias("_calm"), F.count(y).alias("_n"), F.sum(hit.cast("int")).alias("_k"))
    effect = F.when(hit & (F.col("_n") >= F.greatest(F.lit(least), F.col("_k") + 2)), F.col(y) - F.col("_calm")).otherwise(0.0)
    return df.join(g, by).withColumn("effect", effect).withColumn("adjusted", F.col(y) - F.col("effect")).drop("_calm", "_n", "_k")


def month_slots(df: DataFrame, by: list[str], date: str, x: str) -> DataFrame:
    """(by, quarter_ord, m1, m2, m3): the last value of each month of the quarter; null where there is none yet."""
    q = ((F.year(date) - 1970) * 4 + F.quarter(date) - 1).cast("long").alias("quarter_ord")
    slot = (F.month(date) - 1) % 3 + 1
    return df.groupBy(*by, q).agg(*[F.max_by(F.when(slot == k, F.col(x)), F.when((slot == k) & F.col(x).isNotNull(), F.col(date))).alias(f"m{k}") for k in (1, 2, 3)])


def add_month_features(frame: DataFrame, slots: DataFrame, variables: list[str]) -> DataFrame:
    """frame with the slots of each variable joined by quarter, null kept."""
    names = [f"{v}_m{k}" for v in variables for k in (1, 2, 3)]
    wide = slots.groupBy("quarter_ord").agg(*[F.max(F.when(F.col("variable") == n.rsplit("_", 1)[0], F.col(n.rsplit("_", 1)[1]))).alias(n) for n in names])
    return frame.join(wide, "quarter_ord", "left")


def to_sequence(df: DataFrame, item: str, ts: str, columns: list[str]) -> DataFrame:
    """A row per item with arrays in time order (an export form)."""
    rows = F.sort_array(F.collect_list(F.struct(ts, *columns)))
    return df.groupBy(item).agg(rows.alias("_r")).select(item, *[F.col(f"_r.{c}").alias(c) for c in [ts, *columns]])


def from_sequence(df: DataFrame, item: str, ts: str, columns: list[str]) -> DataFrame:
    """Sequence rows back to long form; shorter arrays are padded with their last value, longer ones cut."""
    n = F.size(ts)
    fit = lambda c: F.when(F.size(c) >= n, F.slice(c, 1, n)).otherwise(F.concat(F.col(c), F.array_repeat(F.element_at(c, -1), n - F.size(c))))
    return df.select(item, F.inline(F.arrays_zip(F.col(ts).alias(ts), *[fit(c).alias(c) for c in columns])))


def pick_sources(names: DataFrame, preferences: list[str], by: list[str], name: str = "name") -> DataFrame:
    """(by, name): each group's name of least source_rank, the least name of equals; groups without any are left out."""
    from ..functions.scalars import source_rank

    ranked = names.withColumn("_rank", source_rank(F.col(name), preferences)).where("_rank IS NOT NULL")
    return ranked.groupBy(*by).agg(F.min_by(name, F.struct("_rank", name)).alias(name))


def item_frame(long: DataFrame, target: str, covariates: list[str], ts: str, arrival: str) -> DataFrame:
    """(ts, target, covariates...) of rows (ts, item, value): the last value of each item and time, the target's rows kept, the
    other items as columns of a list given beforehand."""
    last = long.groupBy(ts, "item").agg(F.max_by("value", arrival).alias("value"))
    wide = last.groupBy(ts).pivot("item", [target, *covariates]).agg(F.first("value"))
    return wide.withColumnRenamed(target, "target").where("target IS NOT NULL")


def mixed_selection(monthly: DataFrame, quarterly: DataFrame, cap: int, least: int = 8) -> DataFrame:
    """(variable, frequency, rank): monthly covariates first, then quarterly ones, `cap` in all, of which one at least is quarterly
    where there is any. Inputs have (variable, pos, x); their order is that of pos."""
    def count(df: DataFrame, kind: str, order: int) -> DataFrame:
        return df.groupBy("variable").agg(F.count("x").alias("n"), F.min("pos").alias("pos")).where(F.col("n") >= least).select("variable", F.lit(kind).alias("frequency"), F.lit(order).alias("_o"), "pos")

    both = count(monthly, "M", 0).unionByName(count(quarterly, "Q", 1))
    within = Window.partitionBy("frequency").orderBy("pos", "variable")
    first_quarterly = (F.col("frequency") == "Q") & (F.row_number().over(within) == 1)
    ranked = both.withColumn("_first", first_quarterly).withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_first").cast("int")), "_o", "pos", "variable")))
    kept = ranked.where(F.col("_r") <= cap)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_o", "pos", "variable")).cast("long")).select("variable", "frequency", "rank")
