"""Vintage files of many headers are one scan."""

import pytest

from vintagelab.sources import files


def write(folder, n, width=5):
    """n files, each of which has some of the columns, in an order of its own."""
    want = {}
    for k in range(n):
        vintage = f"{2000 + k // 12}-{k % 12 + 1:02d}"
        names = [f"S{(k * 3 + j) % (width + 2)}" for j in range(width)]
        lines = ["sasdate," + ",".join(names), "Transform:," + ",".join(str(j % 7 + 1) for j in range(width))]
        for q in range(3):
            values = [None if (k + q + j) % 5 == 0 else float(k * 100 + q * 10 + j) for j in range(width)]
            lines.append(f"{q * 3 + 1}/1/1999," + ",".join("" if v is None else str(v) for v in values))
            want |= {(vintage, f"1999-{q * 3 + 1:02d}-01", name): v for name, v in zip(names, values)}
        (folder / f"{vintage}.csv").write_text(("\r\n" if k % 2 else "\n").join(lines))
    return want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_plan_does_not_grow_with_the_files(spark, tmp_path):
    sizes = []
    for n in (2, 40):
        folder = tmp_path / str(n)
        folder.mkdir()
        want = write(folder, n)
        raw = files.read_vintage_csv(spark, [str(p) for p in folder.iterdir()])
        rows = files.data_rows(raw)
        sizes.append(plan(rows).count("\n"))
        got = {(r.vintage, str(r.obs_date), r.series_id): r.value for r in rows.collect()}
        names = {k[2] for k in want}
        assert len(got) == n * 3 * len(names) and {k: v for k, v in got.items() if k in want} == want and all(v is None for k, v in got.items() if k not in want)
        assert files.transform_code_rows(raw).count() == n * 5 and files.metadata_rows(raw).count() == n
        assert "Union" not in plan(rows)
    assert sizes[0] == sizes[1]


def test_quoted_cells_marks_and_missing_headers(spark, tmp_path):
    (tmp_path / "2001-01.csv").write_text('﻿sasdate,"A, seasonal","B ""x"""\n"1/1/2000","1,5",2\n\n4/1/2000,3\nnotes,,\n', encoding="utf-8")
    raw = files.read_vintage_csv(spark, [str(tmp_path / "2001-01.csv")])
    got = {(str(r.obs_date), r.series_id): r.value for r in files.data_rows(raw).collect()}
    assert got == {("2000-01-01", "A, seasonal"): None, ("2000-01-01", 'B "x"'): 2.0, ("2000-04-01", "A, seasonal"): 3.0, ("2000-04-01", 'B "x"'): None}
    assert [r.sasdate for r in files.metadata_rows(raw).collect()] == ["notes"]
    (tmp_path / "2001-02.csv").write_text("date,A\n1/1/2000,1\n")
    with pytest.raises(Exception, match="no line of this file begins with sasdate: .*2001-02.csv"):
        files.data_rows(files.read_vintage_csv(spark, [str(p) for p in tmp_path.iterdir()])).collect()


def test_frames_with_a_column_per_series_are_read_too(spark):
    wide = spark.createDataFrame([("2001-01", "Transform:", "5", "2"), ("2001-01", "1/1/2000", "10", "x")], "vintage string, sasdate string, A string, B string")
    assert {(r.series_id, r.value) for r in files.data_rows(wide).collect()} == {("A", 10.0), ("B", None)}
    assert {(r.series_id, r.tcode) for r in files.transform_code_rows(wide).collect()} == {("A", 5), ("B", 2)}
