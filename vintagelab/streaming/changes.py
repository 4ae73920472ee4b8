"""Tables of the rows that each batch of a stream changes, merged as they grow, so that reading one costs what its live keys do.

A batch's rows are a part of level 0; FAN parts of a level are merged into one of the next, which keeps the last row of each key.
A manifest names the parts that count: it is written once for each batch, as the last step, by a rename, so a batch that ended half
way leaves nothing that is read, and one that is committed isn't written again when the stream replays it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import keep_last
from ..sources import files

#: Parts of a level that are merged.
FAN = 8


def manifest(spark: SparkSession, folder: str) -> dict:
    """The last committed manifest: upto (the last batch), parts (path, level) and dropped (paths that it no longer names)."""
    names = [n for n in files.names_in(spark, f"{folder}/manifests") if n.endswith(".json")]
    return json.loads(files.text_of(spark, f"{folder}/manifests/{names[-1]}")) if names else {"upto": -1, "parts": [], "dropped": []}


def _commit(spark: SparkSession, folder: str, batch_id: int, what: dict) -> None:
    files.commit_text(spark, f"{folder}/manifests/{batch_id:012d}.json", json.dumps(what))


def _read(spark: SparkSession, parts: list[dict], schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[p["path"] for p in parts]) if parts else spark.createDataFrame([], schema)


def append(batch: DataFrame, batch_id: int, folder: str, key: list[str], fan: int = FAN) -> None:
    """Adds a batch's rows, merges what has grown and commits both; nothing if the batch is committed. What a commit no longer names
    is deleted by the one after it, so that a reader of the manifest before finds its parts."""
    spark = batch.sparkSession
    before = manifest(spark, folder)
    if batch_id <= before["upto"]:
        return
    part = f"{folder}/parts/{batch_id:012d}-{uuid.uuid4().hex}"
    rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
    rows.write.parquet(part)
    parts, dropped = [*before["parts"], {"path": part, "level": 0}], []
    level = 0
    while sum(p["level"] == level for p in parts) >= fan:
        some = [p for p in parts if p["level"] == level]
        merged = f"{folder}/parts/{batch_id:012d}-{level + 1}-{uuid.uuid4().hex}"
        keep_last(_read(spark, some, rows.schema), key, ["batch_id"]).write.parquet(merged)
        dropped += [p["path"] for p in some]
        parts = [*(p for p in parts if p["level"] != level), {"path": merged, "level": level + 1}]
        level += 1
    _commit(spark, folder, batch_id, {"upto": batch_id, "parts": parts, "dropped": dropped})
    for old in before["dropped"]:
        files.removed(spark, old)


def current(spark: SparkSession, folder: str, schema: str, key: list[str]) -> DataFrame:
    """The last row of each key; an empty table before the first batch."""
    parts = manifest(spark, folder)["parts"]
    return keep_last(_read(spark, parts, f"{schema}, batch_id long"), key, ["batch_id"]).drop("batch_id")
