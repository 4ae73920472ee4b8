"""Vintage files in, panels and results out. Everything is read by Spark's readers, so any store it knows will do."""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; a local one where that is unset and all
    runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for jobs that use it several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(spark: SparkSession, path: str):
    """(the Hadoop path, its file system), for the few small files that Spark's writers don't make."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where it isn't there."""
    at, fs = store(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def removed(spark: SparkSession, path: str) -> None:
    at, fs = store(spark, path)
    fs.delete(at, True)


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file as a whole or not at all, under a name of its own that is then changed; an error if the path is taken."""
    draft, fs = store(spark, f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    at, _ = store(spark, path)
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise FileExistsError(f"{path} is there already, or its store renames no files")


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


#: File names that tell of a vintage: 2024-01, 2024_1, 2024m1 or 202401 before the ending.
PERIODS = (r"(\d{4})-(\d{1,2})", r"(\d{4})_(\d{1,2})", r"(\d{4})[mM](\d{1,2})", r"(\d{4})(\d{2})")
TCODE_KEYS = ("transform", "transformation", "tcode", "tcodes")


def vintage_of(path: Column) -> Column:
    """YYYY-MM of a file's name, by the first pattern that gives a month from 1 to 12; null without one."""
    name = F.regexp_extract(path, r"([^/]+)\.[A-Za-z]+$", 1)
    found = []
    for p in PERIODS:
        year, month = F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 2).try_cast("int")
        found.append(F.when(month.between(1, 12), F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"))))
    return F.coalesce(*found)


def discover(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(vintage, path) of the vintage files below a folder; of two for a period the later path counts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path")
    w = Window.partitionBy("vintage").orderBy(F.desc("path"))
    return files.withColumn("vintage", vintage_of(F.col("path"))).where("vintage IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("vintage", "path")


def _cells(line: Column) -> Column:
    """The cells of a line of CSV, blank ones as null; quotes around a cell go, doubled ones in it are single."""
    quoted = F.regexp_extract_all(line, F.lit('("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1))
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    cells = F.when(line.contains('"'), F.transform(quoted, bare)).otherwise(F.split(line, ","))
    return F.transform(cells, lambda c: F.nullif(c, F.lit("")))


def read_vintage_csv(spark: SparkSession, paths: list[str], date: str = "sasdate") -> DataFrame:
    """The lines of files with any headers, in one scan: `date` (the first cell), _path, vintage and cells, an array of (series_id,
    value) with an entry for each column that any of the files has, null where the line's file hasn't.

    A file's header is its line that begins with `date`; it never comes to the driver. The headers are a table of a row per file,
    with the place in it of each name of the one row of all names, and each line is joined with its file's. A file without a
    header is an error that names it. Cells can be quoted, but hold no line break."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("_path"), F.regexp_replace("value", "^\\ufeff", "").alias("line")).where("line != ''")
    lines = text.select("_path", _cells(F.col("line")).alias("all"))
    heads = lines.where(F.get("all", F.lit(0)) == date).groupBy("_path").agg(F.max("all").alias("head"))
    names = heads.select(F.explode(F.slice("head", 2, F.size("head"))).alias("name")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    placed = heads.crossJoin(F.broadcast(names)).select("_path", F.transform("names", lambda n: (F.array_position("head", n) - 1).cast("int")).alias("places"))
    body = lines.where(F.coalesce(F.get("all", F.lit(0)) != date, F.lit(True))).join(placed, "_path", "left").crossJoin(F.broadcast(names))
    missing = F.raise_error(F.concat(F.lit(f"no line of this file begins with {date}: "), "_path")).cast("array<int>")
    places = F.coalesce("places", missing)
    cells = F.zip_with("names", places, lambda n, k: F.struct(n.alias("series_id"), F.when(k > 0, F.get("all", k)).alias("value")))
    return body.select(F.get("all", F.lit(0)).alias(date), "_path", vintage_of(F.col("_path")).alias("vintage"), cells.alias("cells"))


def _long(raw: DataFrame, date: str, keys: list[str], value: str) -> DataFrame:
    """raw by (keys, series_id, value): of lines with cells, or of a frame with a column per series."""
    if "cells" in raw.columns:
        return raw.select(*keys, F.inline("cells").alias("series_id", value))
    names = [c for c in raw.columns if c not in (date, "_path", "vintage", *keys)]
    return raw.unpivot(keys, names, "series_id", value)


def data_rows(raw: DataFrame, date: str = "sasdate") -> DataFrame:
    """(vintage, obs_date, series_id, value) of the rows whose first column is a date M/d/yyyy; numbers are tried, not trusted. raw is
    what read_vintage_csv() gives, or a frame with `date`, vintage and a column of text per series."""
    from ..functions.scalars import finite

    dated = raw.withColumn("obs_date", F.try_to_timestamp(F.col(date), F.lit("M/d/yyyy")).cast("date")).where("obs_date IS NOT NULL")
    return _long(dated, date, ["vintage", "obs_date"], "value").withColumn("value", finite(F.col("value")))


def transform_code_rows(raw: DataFrame, date: str = "sasdate") -> DataFrame:
    """(vintage, series_id, tcode): codes 1 to 7 of the row whose key is one of TCODE_KEYS."""
    key = F.regexp_replace(F.lower(F.trim(F.col(date))), r":$", "")
    long = _long(raw.where(key.isin(*TCODE_KEYS)), date, ["vintage"], "tcode")
    code = F.col("tcode").try_cast("double")
    return long.withColumn("tcode", F.when(code == F.floor(code), code.cast("int"))).where(F.col("tcode").between(1, 7))


def metadata_rows(raw: DataFrame, date: str = "sasdate") -> DataFrame:
    """The rows of a template that aren't data."""
    return raw.where(F.try_to_timestamp(F.col(date), F.lit("M/d/yyyy")).isNull())


def build_panel(raw: DataFrame, target: str | None = None, transform: bool = True, latest_codes: bool = False, date: str = "sasdate") -> DataFrame:
    """(vintage, obs_date, series_id, value, transformed) of all vintages at once: each series by its code in its own file, or by
    the latest file's; the target stays a level."""
    from ..functions.sequence import transform_codes

    long = data_rows(raw, date)
    if not transform:
        return long
    codes = transform_code_rows(raw, date)
    if latest_codes:
        last = codes.agg(F.max("vintage").alias("vintage"))
        codes = codes.join(last, "vintage", "left_semi").drop("vintage")
        coded = long.join(codes, "series_id", "left")
    else:
        coded = long.join(codes, ["vintage", "series_id"], "left")
    code = F.when(F.col("series_id") == F.lit(target), 1).otherwise(F.coalesce("tcode", F.lit(1)))
    return transform_codes(coded.withColumn("tcode", code), ["vintage", "series_id"], "obs_date", "value").drop("tcode")


def wide_to_versions(wide: DataFrame, date: str = "observation_date", keys: list[str] | None = None) -> DataFrame:
    """(series_id, obs_date, asof_date, value) of columns SERIES_YYYYMMDD; with `keys` (series_id) the table names its series itself,
    and what stands before the date in a column's name doesn't matter."""
    from ..functions.scalars import finite

    keys = keys or []
    names = [c for c in wide.columns if c not in (date, *keys)]
    long = wide.select(*keys, F.col(date).cast("date").alias("obs_date"), *[F.col(c).cast("string").alias(c) for c in names]).unpivot([*keys, "obs_date"], names, "name", "value")
    asof = F.try_to_timestamp(F.regexp_extract("name", r"_(\d{8})$", 1), F.lit("yyyyMMdd")).cast("date")
    series = F.col("series_id") if "series_id" in keys else F.regexp_extract("name", r"^(.*)_\d{8}$", 1).alias("series_id")
    return long.select(series, "obs_date", asof.alias("asof_date"), finite(F.col("value")).alias("value")).where("asof_date IS NOT NULL AND value IS NOT NULL")


PAYLOAD = "series_id string, vintage_date string, observations array<map<string,string>>"


def payload_versions(lines: DataFrame) -> DataFrame:
    """Versions from JSON payloads (schema PAYLOAD): the as-of date is realtime_start, else the payload's vintage date, else the
    observation's date; the value is `value` or the key SERIES_YYYYMMDD; '.' and blanks are dropped."""
    from ..functions.scalars import finite

    o = lines.select("series_id", "vintage_date", F.explode("observations").alias("o"))
    value = F.coalesce(F.col("o")["value"], F.get(F.map_values(F.map_filter("o", lambda k, v: k.rlike(r"_\d{8}$"))), F.lit(0)))
    obs = F.col("o")["date"].try_cast("date")
    asof = F.coalesce(F.col("o")["realtime_start"].try_cast("date"), F.col("vintage_date").try_cast("date"), obs)
    return o.select("series_id", obs.alias("obs_date"), asof.alias("asof_date"), finite(value).alias("value")).where("obs_date IS NOT NULL AND value IS NOT NULL")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return payload_versions(spark.read.schema(PAYLOAD).json(path))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or JSON lines by the path's ending."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return spark.read.json(path) if kind in ("json", "jsonl") else spark.read.parquet(path)


def save(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """Writes Parquet, CSV or JSON lines by the path's ending, partitioned by `by` (a vintage, a model)."""
    kind = path.rsplit(".", 1)[-1].lower()
    w = df.write.mode(mode).partitionBy(*(by or []))
    if kind == "csv":
        w.option("header", "true").csv(path)
    elif kind in ("json", "jsonl"):
        w.json(path)
    else:
        w.parquet(path)


def save_bundle(tables: dict[str, DataFrame], folder: str, metadata: dict | None = None, formats: dict[str, str] | None = None) -> dict:
    """Writes several tables as one bundle with the run's metadata, and returns its manifest.

    Each table (Parquet, or csv or json by `formats`) goes to a folder of the run; a manifest, renamed to its place as the last step,
    names them with their rows, which the writing jobs count, and their schemas. A run that fails leaves no manifest, and what it
    wrote is deleted; a later bundle in the folder takes the place of the ones before, whole."""
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    what: dict = {"run": run, "written": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "metadata": metadata or {}, "tables": {}}
    try:
        for name, df in tables.items():
            kind = (formats or {}).get(name, "parquet")
            seen, path = Observation(f"bundle-{run}-{name}"), f"{folder}/runs/{run}/{name}.{kind}"
            save(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
            what["tables"][name] = {"path": f"runs/{run}/{name}.{kind}", "rows": seen.get["rows"], "schema": df.schema.jsonValue()}
        number = len([n for n in names_in(spark, f"{folder}/manifests") if n.endswith(".json")])
        commit_text(spark, f"{folder}/manifests/{number:06d}.json", json.dumps(what, sort_keys=True, default=str))
    except BaseException:
        removed(spark, f"{folder}/runs/{run}")
        raise
    return what


def load_bundle(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, tables by name) of the last whole bundle in a folder; an error where there is none."""
    names = [n for n in names_in(spark, f"{folder}/manifests") if n.endswith(".json") and not n.startswith(".")]
    if not names:
        raise FileNotFoundError(f"no bundle in {folder}")
    what, tables = json.loads(text_of(spark, f"{folder}/manifests/{names[-1]}")), {}
    for name, t in what["tables"].items():
        schema, path = T.StructType.fromJson(t["schema"]), f"{folder}/{t['path']}"
        kind = path.rsplit(".", 1)[-1]
        reader = spark.read.schema(schema)
        tables[name] = reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path) if kind == "json" else reader.parquet(path)
    return what, tables
