"""Change tables that are merged as they grow, and late rows in a stream."""

import datetime as dt
import random

import pytest

from vintagelab.streaming import changes, revisions

D = dt.date.fromisoformat
SCHEMA = "k string, v long"


def test_reads_stay_in_proportion_to_live_keys(spark, tmp_path):
    folder, want = f"file://{tmp_path}/t", {}
    rng = random.Random(1)
    assert changes.current(spark, folder, SCHEMA, ["k"]).count() == 0
    for batch in range(40):
        rows = [(f"k{rng.randrange(6)}", batch * 10 + j) for j in range(3)]
        rows = list(dict(rows).items())
        want |= dict(rows)
        changes.append(spark.createDataFrame(rows, SCHEMA), batch, folder, ["k"], fan=3)
        parts = changes.manifest(spark, folder)["parts"]
        levels = {p["level"] for p in parts}
        assert all(sum(p["level"] == lv for p in parts) < 3 for lv in levels) and len(levels) <= 4
    assert {r.k: r.v for r in changes.current(spark, folder, SCHEMA, ["k"]).collect()} == want
    read = spark.read.schema(SCHEMA).parquet(*[p["path"] for p in parts]).count()
    on_disk = len(list((tmp_path / "t" / "parts").iterdir()))
    assert read <= 6 * 8 and on_disk <= len(parts) + 12


def test_a_batch_replayed_during_a_merge_is_written_once(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    frame = lambda b: spark.createDataFrame([("a", b), (f"b{b}", b)], SCHEMA)
    for b in range(2):
        changes.append(frame(b), b, folder, ["k"], fan=3)
    shown = lambda: {r.k: r.v for r in changes.current(spark, folder, SCHEMA, ["k"]).collect()}
    before = shown()

    def broken(*_):
        raise RuntimeError("lost before the commit")

    commit = changes._commit
    monkeypatch.setattr(changes, "_commit", broken)
    with pytest.raises(RuntimeError):
        changes.append(frame(2), 2, folder, ["k"], fan=3)  # the merge is written, the manifest isn't
    assert shown() == before
    monkeypatch.setattr(changes, "_commit", commit)
    changes.append(frame(2), 2, folder, ["k"], fan=3)
    after = shown()
    assert after == {"a": 2, "b0": 0, "b1": 1, "b2": 2} and [p["level"] for p in changes.manifest(spark, folder)["parts"]] == [1]
    changes.append(spark.createDataFrame([("a", 99)], SCHEMA), 2, folder, ["k"], fan=3)
    assert shown() == after  # committed batches aren't written again
    changes.append(frame(3), 3, folder, ["k"], fan=3)
    assert shown() == {**after, "a": 3, "b3": 3}


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    t = dt.datetime(2021, 1, 1)
    row = lambda s, asof, v: (s, D("2020-01-01"), asof and D(asof), v, t)
    arrivals = [
        [row("A", "2021-02-01", 1.0), row("A", "2021-03-01", 2.0), row("B", "2021-03-01", 3.0)],
        [row("A", "2021-02-20", 4.0), row("A", "2021-02-23", 5.0), row("A", "2021-05-01", 6.0), row("C", "2020-01-01", 7.0)],
        [row("A", "2021-04-23", 8.0), row("A", None, 9.0), row("A", "2021-04-24", None), row("B", "2021-02-22", 10.0), row("C", None, 11.0)],
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, revisions.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        revisions.late_rows_stream(revisions.read_stream(spark, f"{tmp_path}/in", 10), f"file://{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    late = sorted((r.series_id, r.value, str(r.mark)) for r in revisions.late_table(spark, f"file://{tmp_path}/out").where("value IS NOT NULL").collect())
    assert late == [("A", 4.0, "2021-03-01"), ("A", 8.0, "2021-05-01"), ("B", 10.0, "2021-03-01")]
    assert revisions.late_table(spark, f"file://{tmp_path}/out").where("value IS NULL").count() == 1
    marks = {r.series_id: (str(r.max_asof), r.n, r.late) for r in revisions.late_marks(spark, f"file://{tmp_path}/out").collect()}
    assert marks == {"A": ("2021-05-01", 8, 3), "B": ("2021-03-01", 2, 1), "C": ("2020-01-01", 2, 0)}
