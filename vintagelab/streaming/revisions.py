"""Arriving revisions: first-writer-wins ingest, high-water marks, latest snapshots and per-day deltas, as Structured Streaming."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import KEY, new_versions
from . import changes

SCHEMA = "series_id string, obs_date date, asof_date date, value double, arrival timestamp"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table in a folder, an empty one at first."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """What the ingest has committed, an empty table at first."""
    return _read(spark, folder, SCHEMA + ", batch_id long, asof_year int")


def ingest_stream(stream: DataFrame, folder: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """Appends each key's first row to the folder, partitioned by batch and by the year of the as-of date.

    Within the watermark repeats are dropped by state; older ones by the anti-join on what is committed of the batch's years, which
    is all that a batch reads of the store. A batch that runs again replaces its own partition, so it is written once."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        years = [r[0] for r in batch.select(F.year("asof_date")).distinct().toLocalIterator()]
        before = stored(spark, folder).where((F.col("batch_id") != batch_id) & F.col("asof_year").isin(years or [-1]))
        fresh = new_versions(before, batch).select(*KEY, "value", "arrival", F.year("asof_date").alias("asof_year"))
        fresh.write.mode("overwrite").partitionBy("asof_year").parquet(f"{folder}/batch_id={batch_id}")

    once = stream.withWatermark("arrival", late).dropDuplicatesWithinWatermark(KEY)
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MARKS = "series_id string, max_asof date, n long"
SNAPSHOT = "series_id string, obs_date date, value double, asof_used date"
LATE = "series_id string, obs_date date, asof_date date, value double, arrival timestamp, mark date"


def _keep_up(changed: DataFrame, folder: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Keeps the last row of each key that a stream of changes gives, to be read by changes.current()."""
    write = lambda batch, batch_id: changes.append(batch, batch_id, folder, key)
    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def high_water_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps each series' last as-of date and rows seen, to be read by high_water_marks()."""
    return _keep_up(stream.groupBy("series_id").agg(F.max("asof_date").alias("max_asof"), F.count(F.lit(1)).alias("n")), folder, checkpoint, ["series_id"])


def high_water_marks(spark: SparkSession, folder: str) -> DataFrame:
    return changes.current(spark, folder, MARKS, ["series_id"])


def late_rows_stream(stream: DataFrame, folder: str, checkpoint: str, lookback_days: int = 7) -> StreamingQuery:
    """Keeps each series' mark, rows and late rows (read by late_marks()), and the late rows themselves in a side table (late_table()).

    A row is late if it is at or before its series' mark of the batches before, less the lookback: what a sync from there would
    not see. The mark is the key's state, so a batch reads nothing but its own rows, and these pass through in pieces; a batch
    that runs again replaces its late rows and is counted once."""
    back = dt.timedelta(lookback_days)

    def keyed(key, pieces, state):
        mark, n, late = state.get if state.exists else (None, 0, 0)
        after = mark
        for rows in pieces:
            n += len(rows)
            dates = rows["asof_date"].dropna()
            if len(dates):
                after = max(x for x in (after, dates.max()) if x is not None)
            if mark is not None:
                old = rows[rows["asof_date"].map(lambda d: d is not None and d <= mark - back)]
                late += len(old)
                if len(old):
                    yield old.assign(series_id=key[0], mark=mark, n=-1, late=-1)[_COLUMNS]
        state.update((after, n, late))
        yield pd.DataFrame([[key[0], _NO_DAY, _NO_DAY, 0.0, pd.Timestamp(0), after, n, late]], columns=_COLUMNS)  # a mark's own row

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            rows.where("n < 0").select(*_COLUMNS[:6]).write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
            changes.append(rows.where("n >= 0").select("series_id", F.col("mark").alias("max_asof"), "n", "late"), batch_id, f"{folder}/marks", ["series_id"])
        finally:
            rows.unpersist()

    state = "mark date, n long, late long"
    out = stream.select(*_COLUMNS[:5]).groupBy("series_id").applyInPandasWithState(keyed, f"{LATE}, n long, late long", state, "append", "NoTimeout")
    return out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_NO_DAY = dt.date(1970, 1, 1)
_COLUMNS = ["series_id", "obs_date", "asof_date", "value", "arrival", "mark", "n", "late"]


def late_marks(spark: SparkSession, folder: str) -> DataFrame:
    """(series_id, max_asof, n, late): each series' mark, rows and late rows."""
    return changes.current(spark, f"{folder}/marks", f"{MARKS}, late long", ["series_id"])


def late_table(spark: SparkSession, folder: str) -> DataFrame:
    """The late rows, each with the mark that it was behind and its batch."""
    return _read(spark, f"{folder}/late", f"{LATE}, batch_id long")


def late_rows(batch: DataFrame, marks: DataFrame, lookback_days: int = 7) -> DataFrame:
    """Rows at or before their series' mark less the lookback: what a sync from there would not see."""
    joined = batch.join(marks, "series_id", "left")
    return joined.where(F.col("asof_date") <= F.date_sub("max_asof", lookback_days)).drop("max_asof", "n")


def latest_snapshot_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last non-null value of each observation as revisions arrive, to be read by latest_snapshot(). Of rows with one
    as-of date the first to arrive counts, as in the store; of those that arrive together the greatest value."""
    value = F.expr("max_by(value, struct(asof_date, -unix_micros(arrival), value)) FILTER (WHERE value IS NOT NULL)")
    return _keep_up(stream.groupBy("series_id", "obs_date").agg(value.alias("value"), F.max("asof_date").alias("asof_used")), folder, checkpoint, ["series_id", "obs_date"])


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return changes.current(spark, folder, SNAPSHOT, ["series_id", "obs_date"])


def day_delta(versions: DataFrame, day: str) -> DataFrame:
    """(series_id, obs_date, before, after): observations whose known value a day's as-of rows change, from the touched keys alone."""
    from ..operators.asof import snapshot_long

    at = F.lit(day).cast("date")
    touched = versions.where(F.col("asof_date") == at).select("series_id", "obs_date").distinct()
    held = versions.join(touched, ["series_id", "obs_date"], "left_semi")
    after = snapshot_long(held, day).select("series_id", "obs_date", F.col("value").alias("after"))
    before = snapshot_long(held.where(F.col("asof_date") < at), day).select("series_id", "obs_date", F.col("value").alias("before"))
    return after.join(before, ["series_id", "obs_date"], "left").where(~F.col("after").eqNullSafe(F.col("before"))).select("series_id", "obs_date", "before", "after")
