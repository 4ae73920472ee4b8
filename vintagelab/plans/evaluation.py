"""The window evaluation as one job: release stages are keys of its plan, histories are swapped for those of each window's vintage,
guards are observed by the job itself, and all its tables come from the same records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import quarter_end, quarter_ord, target_transforms
from ..operators import asof, baselines, evaluate, releases
from .registry import canonical, forecast

#: Target transforms with the truth that "auto" pairs them with, and the label of the exchange tables.
TRANSFORMS = {"level": ("level", "levels"), "log_level": ("level", "levels"), "qoq": ("release_qoq", "pop"), "saar": ("release_saar", "pop")}
#: Growth truths with the only transform that has their scale.
GROWTH = {"release_qoq": "qoq", "release_saar": "saar", "panel_saar": "saar"}
EXCHANGE = ("levels", "pop", "yoy")


class StrictError(ValueError):
    """A guard of a pipeline failed."""


def resolve_metric(transform: str, requested: str = "auto") -> str:
    """The truth that a target transform is scored on: "level" (the stage's level, transformed), "release_qoq" or "release_saar"
    (growth within the stage's own vintage) or "panel_saar" (growth within the panel's vintage after it)."""
    if transform not in TRANSFORMS:
        raise ValueError(f"no such target transform: {transform}; there are {sorted(TRANSFORMS)}")
    metric = TRANSFORMS[transform][0] if requested == "auto" else requested.strip().lower()
    if metric != "level" and metric not in GROWTH:
        raise ValueError(f"no such release metric: {requested}")
    if metric in GROWTH and GROWTH[metric] != transform:
        raise ValueError(f"{metric} needs the target transform {GROWTH[metric]}, so that targets and truth are on one scale")
    return metric


def resolve_stages(metric: str, stages: str | Sequence[str] | None = None) -> list[str]:
    """Stages in order without repeats ("first" by default); growth has the first three alone."""
    asked = [stages] if isinstance(stages, str) else list(stages or ["first"])
    asked = list(dict.fromkeys(s.strip().lower() for s in asked))
    allowed = releases.STAGES[:3] if metric in GROWTH else releases.STAGES
    if wrong := [s for s in asked if s not in allowed]:
        raise ValueError(f"{metric} has the stages {', '.join(allowed)}, not {', '.join(wrong)}")
    return asked


def exchange_label(transform: str, requested: str = "auto") -> str:
    """The exchange tables' name of what is forecast: levels, pop or yoy."""
    asked = requested.strip().lower()
    return asked if asked in EXCHANGE else TRANSFORMS[transform][1] if asked == "auto" else "levels"


def _growth(y: Column, before: Column, metric: str) -> Column:
    return F.when((y > 0) & (before > 0), target_transforms(y, before)[GROWTH[metric]])


def truth(versions: DataFrame, stages: Sequence[str], transform: str, metric: str) -> DataFrame:
    """(series_id, stage, quarter_ord, y, release_date) of all the stages at once; quarters without a truth are left out."""
    if metric == "level":
        rows = releases.stage_rows(releases.releases(versions)).where(F.col("stage").isin(list(stages)))
        before = F.lag("value").over(Window.partitionBy("series_id", "stage").orderBy("quarter_ord"))
        rows = rows.withColumn("y", target_transforms(F.col("value"), before)[transform])
    elif metric == "panel_saar":
        rows = releases.stage_rows(releases.releases(versions)).where(F.col("stage").isin(list(stages)))
        rows = asof.select_vintage(rows, versions.select("asof_date").distinct(), "release_date", "forward")
        panel = asof.snapshots(versions, rows.select(F.col("vintage_date").alias("cutoff"))).select("series_id", F.col("cutoff").alias("vintage_date"), quarter_ord(F.col("obs_date")).alias("quarter_ord"), "value")
        rows = asof.same_vintage_growth(panel, rows.drop("value", "obs_date")).withColumn("y", _growth(F.col("level"), F.col("level_before"), metric))
    else:
        rows = releases.same_release_growth(versions).where(F.col("stage").isin(list(stages)))
        rows = rows.withColumn("y", _growth(F.col("value"), F.col("level_before"), metric))
    return rows.where("y IS NOT NULL").select("series_id", "stage", "quarter_ord", "y", "release_date")


def run(versions: DataFrame, names: Sequence[str], baseline: str = "naive_last", stages: str | Sequence[str] | None = None, transform: str = "level", metric: str = "auto", windows: int = 8, horizon: int = 4, least: int = 8, shock: tuple[int, int] = (0, -1), historical: bool = True, allow_snapshot: bool = False, strict: bool = False, variable: str = "y", label: str = "auto") -> dict[str, DataFrame | Observation]:
    """The tables of an evaluation of models on the last `windows` rolling windows of every series and stage.

    versions are (series_id, obs_date, asof_date, value). A window trains on its stage's truths up to its cutoff, each replaced by
    what the window's vintage (the last one by the end of the cutoff's quarter, else the earliest) has, and is scored on the
    truths after it. historical=False trains on the truths themselves, which later revisions have reached; that is an error unless
    allowed. With strict, a window without a vintage early enough is an error of the job that meets it.

    Returns records, window_vintages, leaderboard and pairwise (by stage), kpi, errors, forecasts and outturns (exchange tables), and
    guards, an Observation that the first action on any table but window_vintages and outturns fills: records, windows that took
    the earliest vintage, records whose origin isn't before their target, and those whose forecast isn't finite."""
    if not historical and not allow_snapshot:
        raise StrictError("an evaluation on one snapshot sees later revisions; allow it on purpose")
    metric = resolve_metric(transform, metric)
    stages = resolve_stages(metric, stages)
    names = canonical([*names, baseline])
    key = ["series_id", "stage"]
    known = truth(versions, stages, transform, metric)
    cut = releases.rolling_windows(known, windows, horizon, key, "quarter_ord").withColumnRenamed("cutoff_ts", "origin_ord")
    cut = cut.withColumn("cutoff", quarter_end(F.col("origin_ord")).cast("date"))
    days = versions.select("asof_date").distinct()
    chosen = asof.select_vintage(cut, days, "cutoff", fallback=True)
    if strict:
        told = F.concat(F.lit("no vintage at or before the window's cutoff: "), F.concat_ws(" ", *key, F.col("window_idx").cast("string")))
        chosen = chosen.withColumn("vintage_date", F.when(F.col("used_fallback"), F.raise_error(told).cast("date")).otherwise(F.col("vintage_date")))
    source = F.when(~F.lit(historical), "snapshot").when(F.col("used_fallback"), "earliest").otherwise("panel")
    chosen = chosen.withColumn("source", source)
    train = known.select(*key, "quarter_ord", "y").join(chosen, key).where("quarter_ord <= origin_ord")
    if historical:
        panel = asof.snapshots(versions, chosen.select(F.col("vintage_date").alias("cutoff"))).withColumn("quarter_ord", quarter_ord(F.col("obs_date")))
        before = F.lag("value").over(Window.partitionBy("cutoff", "series_id").orderBy("quarter_ord"))
        panel = panel.select("series_id", F.col("cutoff").alias("vintage_date"), "quarter_ord", target_transforms(F.col("value"), before)[transform].alias("value"))
        train = asof.swap_history(train, panel)
    whole = F.concat_ws("|", *key, F.col("window_idx").cast("string"))
    made = forecast(train.select(whole.alias("series_id"), "quarter_ord", "y"), names, horizon, least, origins=chosen.select(whole.alias("series_id"), "origin_ord"))
    part = lambda k: F.split_part("_key", F.lit("|"), F.lit(k))
    made = made.withColumnRenamed("series_id", "_key").withColumns({"series_id": F.regexp_replace("_key", r"\|[^|]*\|[^|]*$", ""), "stage": part(-2), "window_idx": part(-1).cast("long")}).drop("_key")
    facts = chosen.select(*key, "window_idx", "vintage_date", "source", "used_fallback")
    scored = made.join(known.select(*key, F.col("quarter_ord").alias("target_ord"), F.col("y").alias("y_true")), [*key, "target_ord"]).join(facts, [*key, "window_idx"])
    finite = F.col("y_hat").isNotNull() & ~F.isnan("y_hat") & (F.abs("y_hat") < float("inf"))
    guards = Observation("guards")
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    seen = scored.observe(guards, F.count(F.lit(1)).alias("records"), count(F.col("used_fallback"), "earliest"), count(F.col("origin_ord") >= F.col("target_ord"), "leaks"), count(~finite, "not_finite"))
    records = seen.select("model", *key, "window_idx", "origin_ord", "h", "target_ord", "y_hat", "y_true", "last_y", "vintage_date", "source")
    tasks = evaluate.task_metrics(records, ["stage"])
    staged = F.concat_ws("__", "series_id", "stage")
    levels = transform == "level"
    out = {
        "records": records,
        "window_vintages": chosen.select(*key, "window_idx", "origin_ord", "cutoff", "vintage_date", "source"),
        "leaderboard": evaluate.leaderboard(tasks, baseline, ["stage"]),
        "pairwise": evaluate.pairwise(tasks, ["stage"]),
        "errors": evaluate.point_errors(records, ["stage", "model"], shock),
        "forecasts": evaluate.exchange_forecasts(records.withColumn("series_id", staged), variable, exchange_label(transform, label)),
        "outturns": evaluate.exchange_outturns(known.select(staged.alias("series_id"), "quarter_ord", "release_date", F.col("y").alias("value")), variable, exchange_label(transform, label)),
        "guards": guards,
    }
    if levels:
        out["kpi"] = evaluate.kpi_tables(records.withColumn("series_id", staged), shock)
    return out
