"""Storing versions: the first writer of a key wins; aliases and metadata: the last one does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite

KEY = ["series_id", "obs_date", "asof_date"]


def clean_batch(batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Rows with a whole key, values as numbers, and of a key that comes twice the row that arrived last."""
    missing = {*KEY, "value", arrival} - set(batch.columns)
    if missing:
        raise ValueError(f"a batch of versions needs the columns {sorted(missing)}")
    w = Window.partitionBy(*KEY).orderBy(F.desc(arrival))
    whole = batch.dropna(subset=KEY).withColumn("value", finite(F.col("value")))
    return whole.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def new_versions(stored: DataFrame, batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The batch's rows whose key isn't stored; stored rows are never changed."""
    return clean_batch(batch, arrival).join(stored.select(*KEY), KEY, "left_anti")


def ingest(stored: DataFrame, batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """stored and what is new in the batch."""
    return stored.unionByName(new_versions(stored, batch, arrival), allowMissingColumns=True)


def upsert_latest(rows: DataFrame, key: list[str], updated: str) -> DataFrame:
    """The last update of each key (aliases, metadata)."""
    w = Window.partitionBy(*key).orderBy(F.desc(updated))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in a total order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
