"""Column expressions: periods, growth, stages, aliases and number cleaning. All of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_ord(date: Column) -> Column:
    """Quarters since 1970Q1."""
    return ((F.year(date) - 1970) * 4 + F.quarter(date) - 1).cast("long")


def quarter_label(q: Column) -> Column:
    """1998Q2 of a quarter's ordinal."""
    return F.concat((F.floor(q / 4) + 1970).cast("string"), F.lit("Q"), (F.pmod(q, F.lit(4)) + 1).cast("string"))


def quarter_start(q: Column) -> Column:
    return F.make_date((F.floor(q / 4) + 1970).cast("int"), (F.pmod(q, F.lit(4)) * 3 + 1).cast("int"), F.lit(1))


def quarter_end(q: Column) -> Column:
    return F.last_day(F.add_months(quarter_start(q), 2))


def finite(c: Column) -> Column:
    """The number, or null where it is none or infinite; text is tried as a number."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def last_business_day(date: Column) -> Column:
    """The last Monday to Friday of the date's month, without holidays."""
    end = F.last_day(date)
    late = F.weekday(end)  # 0 is Monday
    return F.date_sub(end, F.when(late == 5, 1).when(late == 6, 2).otherwise(0))


def saar_growth(y: Column, before: Column) -> Column:
    """Annualised growth in percent; null unless both levels are finite and positive."""
    return F.when((y > 0) & (before > 0) & (y < float("inf")) & (before < float("inf")), 100 * (F.pow(y / before, 4) - 1))


def level_before(y: Column, growth: Column) -> Column:
    """The earlier level that annualised growth in percent implies."""
    return F.when(growth > -100, y / F.pow(1 + growth / 100, 0.25))


def months_to_release(origin: Column, release: Column) -> Column:
    """Calendar months from origin to release."""
    return ((F.year(release) - F.year(origin)) * 12 + F.month(release) - F.month(origin)).cast("long")


def release_bucket(months: Column) -> Column:
    return F.when(months.isNull(), "unknown").when(months <= 0, "<=0").when(months == 1, "1").when(months <= 3, "2-3").when(months <= 6, "4-6").otherwise("7+")


def period_slice(q: Column, shock_from: int, shock_to: int) -> Column:
    """pre, shock or post, by the shock's first and last quarter."""
    return F.when(q.isNull(), "unknown").when(q < shock_from, "pre").when(q <= shock_to, "shock").otherwise("post")


def shock_dummies(q: Column, quarters: list[int]) -> list[Column]:
    """1.0 in each shock quarter, else 0.0."""
    return [(q == k).cast("double").alias(f"shock_{k}") for k in quarters]


def alias_candidates(name: Column, manual: dict[str, str] | None = None) -> Column:
    """Names to try for a variable in order: its manual alias, itself, and itself without blanks, a leading ^ or a trailing x."""
    manual = manual or {}
    mapped = F.create_map(*[F.lit(x) for kv in manual.items() for x in kv])[name] if manual else F.lit(None).cast("string")
    bare = F.regexp_replace(name, r"\s+", "")
    hatless = F.regexp_replace(bare, r"^\^", "")
    tail = lambda c: F.regexp_replace(c, "x$", "")
    every = F.array(mapped, name, bare, hatless, tail(name), tail(hatless))
    return F.array_distinct(F.filter(every, lambda c: c.isNotNull() & (c != "")))


def normalised_stage(c: Column) -> Column:
    """first, second, third or latest of the names in use for them."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+(release|estimate)$", "")
    return F.when(k.isin("first", "1", "1st", "advance"), "first").when(k.isin("second", "2", "2nd"), "second").when(k.isin("third", "3", "3rd", "final"), "third").when(k.isin("latest", "current", "revised"), "latest")


def item_id(series: Column, stage: Column, metric: Column) -> Column:
    return F.concat_ws("__", series, stage, metric)


def spread(a: Column, b: Column) -> Column:
    return a - b


def ratio(a: Column, b: Column, scale: float = 100.0) -> Column:
    """scale * a / b; null where b is 0."""
    return F.when(b != 0, scale * a / b)


def target_transforms(y: Column, before: Column) -> dict[str, Column]:
    """The four targets: level, log level (null where not positive), and growth, plain and annualised, without a sign guard."""
    step = F.when(before != 0, y / before)
    return {"level": y, "log_level": F.when(y > 0, F.log(y)), "qoq": 100 * (step - 1), "saar": 100 * (F.pow(step, 4) - 1)}


def source_rank(name: Column, preferences: list[str]) -> Column:
    """How well a column name fits a list of preferences: the place of an exact one (case aside), then 1000 + that of one that is
    contained; null where none fits. The least rank, then the least name, is the source."""
    upper, rank = F.upper(F.trim(name)), F.lit(None).cast("int")
    for at in range(len(preferences) - 1, -1, -1):
        rank = F.when(upper.contains(preferences[at].upper()), 1000 + at).otherwise(rank)
    for at in range(len(preferences) - 1, -1, -1):
        rank = F.when(upper == preferences[at].upper(), at).otherwise(rank)
    return rank


def vintage_label(path: Column, manifest: Column, last_date: Column) -> Column:
    """YYYY-MM of a file's name, else of the manifest's entry, else of the last date of the data."""
    from ..sources.files import vintage_of

    return F.coalesce(vintage_of(path), F.when(manifest.rlike(r"^\d{4}-\d{2}$"), manifest), F.date_format(last_date, "yyyy-MM"))
