"""Queries of files in and out: each writes what it reads, from the test tables, to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import item_id, normalised_stage
from ..operators import asof, baselines, evaluate, releases
from ..sources import files
from . import queries_evaluate, views
from .catalog import query
from .queries_asof import REL
from .queries_evaluate import LB
from .views import VIEWS_SQL as V

ALL = "SELECT series_id, CAST(obs_date AS VARCHAR) AS obs_date, CAST(asof_date AS VARCHAR) AS asof_date, round(value, 4) AS value FROM versions"


def _write_named(rows) -> None:
    """Writes the content of each row (path, content) to its path."""
    for row in rows:
        store, path = fs.FileSystem.from_uri(row.path if "://" in row.path else f"file://{row.path}")
        store.create_dir(path.rsplit("/", 1)[0])
        with store.open_output_stream(path) as out:
            out.write(row.content.encode())


def vintage_files(spark, d) -> str:
    """A folder with a CSV file of each month's snapshot: a row of transform codes, then a row per quarter and a column for each
    series that has a value by then, so that headers differ between files."""
    v = views.versions(spark, d)
    snap = asof.snapshots(v, v.select(F.col("asof_date").alias("cutoff")).distinct()).where("value IS NOT NULL").join(views.tcodes(v), "series_id")
    names = snap.groupBy("cutoff").agg(F.array_sort(F.collect_set(F.struct("series_id", "tcode"))).alias("names"))
    cells = snap.groupBy("cutoff", "obs_date").agg(F.map_from_entries(F.collect_list(F.struct("series_id", F.col("value").cast("string")))).alias("m"))
    line = F.concat_ws(",", F.date_format("obs_date", "M/d/yyyy"), F.array_join(F.transform("names", lambda n: F.coalesce(F.try_element_at("m", n["series_id"]), F.lit(""))), ","))
    lines = cells.join(names, "cutoff").select("cutoff", "names", F.struct("obs_date", line.alias("line")).alias("l"))
    texts = lines.groupBy("cutoff").agg(F.first("names").alias("names"), F.array_sort(F.collect_list("l")).alias("ls"))
    head = F.array(F.concat_ws(",", F.lit("sasdate"), "names.series_id"), F.concat_ws(",", F.lit("Transform:"), F.transform("names", lambda n: n["tcode"].cast("string"))))
    folder = views.scratch(spark, "vintages")
    path = F.concat(F.lit(f"{folder}/panel_"), F.date_format("cutoff", "yyyy-MM"), F.lit(".csv"))
    texts.select(path.alias("path"), F.array_join(F.concat(head, "ls.line"), "\n").alias("content")).foreachPartition(_write_named)
    return folder


def _raw(spark, d) -> DataFrame:
    found = files.discover(spark, vintage_files(spark, d)).select("path")
    return files.read_vintage_csv(spark, [r.path for r in found.toLocalIterator()])


CELLS = """
, days AS (SELECT DISTINCT asof_date AS cutoff FROM versions), snap AS (SELECT cutoff, series_id, obs_date, arg_max(value, asof_date) AS value FROM versions, days WHERE asof_date <= cutoff GROUP BY 1, 2, 3),
every AS (SELECT DISTINCT series_id FROM versions), grid AS (SELECT cutoff, obs_date, series_id FROM (SELECT DISTINCT cutoff, obs_date FROM snap), every),
cells AS (SELECT strftime(cutoff, '%Y-%m') AS vintage, obs_date, series_id, value, tcode FROM grid LEFT JOIN snap USING (cutoff, obs_date, series_id) JOIN tcodes USING (series_id))
"""


@query("s01_file_discovery", V + "SELECT DISTINCT strftime(asof_date, '%Y-%m') AS vintage, 'panel_' || strftime(asof_date, '%Y-%m') || '.csv' AS file FROM versions")
def s01(spark, d):
    return files.discover(spark, vintage_files(spark, d)).select("vintage", F.substring_index("path", "/", -1).alias("file"))


@query("s02_vintage_csv_scan", V + CELLS + "SELECT vintage, CAST(obs_date AS VARCHAR) AS obs_date, series_id, round(value, 4) AS value FROM cells")
def s02(spark, d):
    return files.data_rows(_raw(spark, d))


@query("s03_transform_code_rows", V + CELLS + "SELECT DISTINCT strftime(cutoff, '%Y-%m') AS vintage, series_id, tcode FROM snap JOIN tcodes USING (series_id)")
def s03(spark, d):
    return files.transform_code_rows(_raw(spark, d))


@query("s04_panel_build", V + CELLS + """
, known AS (SELECT c.vintage, c.obs_date, c.series_id, c.value, CASE WHEN k.series_id IS NULL THEN 1 ELSE c.tcode END AS tcode
  FROM cells c LEFT JOIN (SELECT DISTINCT strftime(cutoff, '%Y-%m') AS vintage, series_id FROM snap) k ON k.vintage = c.vintage AND k.series_id = c.series_id),
l AS (SELECT *, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b FROM known WINDOW w AS (PARTITION BY vintage, series_id ORDER BY obs_date))
SELECT vintage, CAST(obs_date AS VARCHAR) AS obs_date, series_id, round(value, 2) AS value, round(CASE tcode WHEN 1 THEN value WHEN 2 THEN value - a WHEN 3 THEN value - 2 * a + b WHEN 4 THEN ln(value) WHEN 5 THEN ln(value) - ln(a)
  WHEN 6 THEN ln(value) - 2 * ln(a) + ln(b) ELSE (value / a - 1) - (a / b - 1) END, 3) + 0.0 AS transformed FROM l""", 3)
def s04(spark, d):
    return files.build_panel(_raw(spark, d)).withColumn("value", F.round("value", 2))


@query("s14_template_split", V + "SELECT DISTINCT strftime(asof_date, '%Y-%m') AS vintage, 'Transform:' AS label FROM versions")
def s14(spark, d):
    return files.metadata_rows(_raw(spark, d)).select("vintage", F.col("sasdate").alias("label"))


@query("s09_api_payloads", V + ALL)
def s09(spark, d):
    """Payloads of a series and vintage; those of its even months give realtime_start with each observation."""
    v = views.versions(spark, d)
    text = lambda c: F.col(c).cast("string")
    own = F.map_from_arrays(F.array(*[F.lit(k) for k in ("date", "realtime_start", "value")]), F.array(text("obs_date"), text("asof_date"), text("value")))
    bare = F.map_from_arrays(F.array(F.lit("date"), F.lit("value")), F.array(text("obs_date"), text("value")))
    o = F.when(F.month("asof_date") % 2 == 0, own).otherwise(bare)
    folder = views.scratch(spark, "payloads") + ".json"
    files.save(v.groupBy("series_id", text("asof_date").alias("vintage_date")).agg(F.collect_list(o).alias("observations")), folder)
    return files.read_payloads(spark, folder)


@query("s10_panel_sinks", V + f", a AS ({ALL}) SELECT f AS format, a.* FROM a, (SELECT unnest(['csv', 'json', 'parquet']) AS f)")
def s10(spark, d):
    v, out = views.versions(spark, d), []
    for kind in ("csv", "json", "parquet"):
        path = f"{views.scratch(spark, 'panel')}.{kind}"
        files.save(v, path, ["series_id"])
        out.append(files.load(spark, path).select(F.lit(kind).alias("format"), "series_id", F.col("obs_date").cast("date").alias("obs_date"), F.col("asof_date").cast("date").alias("asof_date"), F.col("value").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, out)


@query("s11_dataset_load", "SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def s11(spark, d):
    return files.load(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("s08_wide_versions", V + ALL)
def s08(spark, d):
    """A wide table of a series a file with a column per vintage, written as CSV and turned into versions again."""
    v = views.versions(spark, d)
    vintages = [r[0] for r in v.select(F.date_format("asof_date", "yyyyMMdd")).distinct().orderBy(F.col("date_format(asof_date, yyyyMMdd)")).collect()]
    wide = v.withColumn("vintage", F.date_format("asof_date", "yyyyMMdd")).groupBy("series_id", F.col("obs_date").alias("observation_date")).pivot("vintage", vintages).agg(F.first("value"))
    folder = views.scratch(spark, "wide") + ".csv"
    named = wide.select("series_id", "observation_date", *[F.col(x).alias(f"VALUE_{x}") for x in vintages])
    files.save(named, folder, ["series_id"])
    back = files.load(spark, folder)
    return files.wide_to_versions(back, "observation_date", ["series_id"])


@query("s13_result_bundle", V + LB + """
SELECT 'leaderboard' AS name, 'csv' AS kind, (SELECT count(*) FROM lb) AS n_rows, 0 AS differing UNION ALL SELECT 'pairwise', 'json', (SELECT count(*) FROM (SELECT DISTINCT a.model AS x, b.model AS y FROM tasks a JOIN tasks b ON a.task = b.task AND a.model <> b.model)), 0
UNION ALL SELECT 'records', 'parquet', (SELECT count(*) FROM records), 0""")
def s13(spark, d):
    """A bundle of an evaluation's tables, written, read again and compared with what was written."""
    r = queries_evaluate.records(spark, d)
    t = evaluate.task_metrics(r)
    tables = {"records": r, "leaderboard": evaluate.leaderboard(t, "seasonal_naive"), "pairwise": evaluate.pairwise(t)}
    folder = views.scratch(spark, "bundle")
    files.save_bundle(tables, folder, {"baseline": "seasonal_naive", "models": list(baselines.MODELS)}, {"leaderboard": "csv", "pairwise": "json"})
    told, read = files.load_bundle(spark, folder)
    out = []
    for name, one in tables.items():
        rounded = lambda df: df.select(*[F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
        apart = rounded(one).exceptAll(rounded(read[name])).union(rounded(read[name]).exceptAll(rounded(one)))
        kind = told["tables"][name]["path"].rsplit(".", 1)[-1]
        out.append(apart.agg(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(told["tables"][name]["rows"]).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("differing")))
    return reduce(DataFrame.unionByName, out)


@query("s12_first_growth", V + REL + ", b AS (SELECT *, lag(first_release) OVER (PARTITION BY series_id ORDER BY quarter_ord) AS p FROM rel) SELECT series_id, quarter_ord, round(first_release / p, 6) AS ratio, first_release > 0 AND p > 0 AS known FROM b WHERE p IS NOT NULL", 6)
def s12b(spark, d):
    """Growth is compared as the ratio of the levels that it stands for."""
    g = releases.first_growth(releases.releases(views.versions(spark, d)))
    return g.where("first_growth IS NOT NULL").select("series_id", "quarter_ord", F.round(F.pow(1 + F.col("first_growth") / 100, 0.25), 6).alias("ratio"), F.lit(True).alias("known"))


@query("p13_item_ids", V + REL + "SELECT DISTINCT series_id || '__' || stage || '__levels' AS item_id, stage FROM stages")
def p13(spark, d):
    rows = releases.stage_rows(releases.releases(views.versions(spark, d)))
    told = F.when(F.col("stage") == "first", "Advance Estimate").when(F.col("stage") == "second", " 2nd release").when(F.col("stage") == "third", "final").otherwise("CURRENT")
    stage = normalised_stage(told)
    return rows.select(item_id(F.col("series_id"), stage, F.lit("levels")).alias("item_id"), stage.alias("stage")).distinct()
