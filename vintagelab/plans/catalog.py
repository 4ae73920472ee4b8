"""Every registered query of the library with the SQL that it must equal, over the views of views.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def finish(df: DataFrame, digits: int = 4) -> DataFrame:
    """df with dates as text, whole numbers as long and doubles rounded: the types that the SQL gives."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("date").cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


RATIONAL = ("naive_last", "mean", "drift", "seasonal_naive")


def places(name: str, model: str = "model") -> Column:
    """A column rounded for comparison: to 6 places for models of sums and quotients, whose values lie half-way between two
    roundings to cents so often that the last bit of a sum would decide; to 2 for those of powers."""
    return F.when(F.col(model).isin(*RATIONAL), F.round(name, 6)).otherwise(F.round(name, 2)).alias(name)


def places_sql(x: str, model: str = "model") -> str:
    return f"CASE WHEN {model} IN {RATIONAL} THEN round({x}, 6) ELSE round({x}, 2) END"


#: Growth compounded four times may be huge: up to each bound it is rounded to hundredths of the unit before.
TIERS = ((1e6, 1.0), (1e12, 1e6), (1e18, 1e12))


def wide(x: Column) -> Column:
    """A growth of any size rounded for comparison to eight digits or more."""
    out = F.when(F.abs(x) < TIERS[0][0], F.round(x, 2))
    for bound, unit in TIERS[1:]:
        out = out.when(F.abs(x) < bound, F.round(x / unit, 2) * unit)
    return out.otherwise(F.round(x / 1e18, 2) * 1e18)


def wide_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e6 THEN round({x}, 2) WHEN abs({x}) < 1e12 THEN round({x} / 1e6, 2) * 1e6 WHEN abs({x}) < 1e18 THEN round({x} / 1e12, 2) * 1e12 ELSE round({x} / 1e18, 2) * 1e18 END + 0.0"


def query(name: str, sql: str | None = None, digits: int = 4) -> Callable[[Query], Query]:
    """Registers a query under a name, with its SQL where SQL can express it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir), digits)
        if sql:
            SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    from . import queries_asof, queries_evaluate, queries_models, queries_scalar, queries_sources  # noqa: F401  (they register theirs)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: baseline backtest and leaderboard over all series and origins."""
    return queries()["e05_leaderboard"](spark, sf_dir)
