"""Bundles of results are there whole or not at all; bootstrap draws are made where they are used."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagelab.operators import evaluate
from vintagelab.sources import files


def test_a_bundle_comes_back_as_it_was(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    a = spark.createDataFrame([(1, "x", 1.5), (2, None, None)], "i long, s string, v double")
    b = a.where("i = 1").select(F.col("s"), F.lit("2020-01-01").cast("date").alias("d"))
    told = files.save_bundle({"a": a, "b": b, "c": a.limit(0)}, folder, {"models": ["drift"], "stage": "first"}, {"b": "csv", "a": "json"})
    what, tables = files.load_bundle(spark, folder)
    assert what == told and what["metadata"] == {"models": ["drift"], "stage": "first"} and {n: t["rows"] for n, t in what["tables"].items()} == {"a": 2, "b": 1, "c": 0}
    assert sorted(map(tuple, tables["a"].collect()), key=str) == sorted(map(tuple, a.collect()), key=str) and tables["b"].collect() == b.collect() and tables["c"].count() == 0
    files.save_bundle({"a": b}, folder)
    again, tables = files.load_bundle(spark, folder)
    assert again["run"] != told["run"] and list(tables) == ["a"] and tables["a"].count() == 1


def test_a_failed_write_leaves_no_half_bundle(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    good = spark.range(3)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("c"))
    with pytest.raises(Exception, match="lost"):
        files.save_bundle({"good": good, "bad": bad}, folder)
    with pytest.raises(FileNotFoundError):
        files.load_bundle(spark, folder)
    assert os.listdir(tmp_path / "b" / "runs") == []
    files.save_bundle({"good": good}, folder)
    with pytest.raises(Exception, match="lost"):
        files.save_bundle({"good": good.limit(1), "bad": bad}, folder)
    assert files.load_bundle(spark, folder)[1]["good"].count() == 3


def test_a_small_file_is_committed_once(spark, tmp_path):
    path = f"file://{tmp_path}/m/1.json"
    files.commit_text(spark, path, "é\none")
    with pytest.raises(FileExistsError):
        files.commit_text(spark, path, "two")
    assert files.text_of(spark, path) == "é\none" and files.names_in(spark, f"file://{tmp_path}/m") == ["1.json"] and files.names_in(spark, f"file://{tmp_path}/none") == []


@pytest.mark.parametrize("kept", [64 << 20, 0])
def test_bootstrap_equals_draws_by_hand(spark, monkeypatch, kept):
    monkeypatch.setattr(evaluate, "BLOCK", 16)
    monkeypatch.setattr(evaluate, "KEPT", kept)
    rng = np.random.default_rng(2)
    metric = {(f"t{i:02d}", m): float(rng.uniform(1, 3)) for i in range(9) for m in ("base", "own", "some") if m != "some" or i < 5}
    tasks = spark.createDataFrame([(t, m, v) for (t, m), v in metric.items()], "task string, model string, metric double").repartition(3)
    got = {(r.statistic, r.model, r.other): (r.value, r.low, r.high) for r in evaluate.bootstrap(tasks, "base", 50, 3).collect()}

    def by_hand(pairs, skill=False):
        x, n = np.array(pairs), len(pairs)
        out = []
        for b in range(1, 51):
            i = [int(hashlib.md5(f"3|{b}|{j}".encode()).hexdigest()[:8], 16) % n for j in range(1, n + 1)]
            r = x[i, 0].sum() / x[i, 1].sum()
            out.append(1 - r if skill else r)
        whole = x[:, 0].sum() / x[:, 1].sum()
        return (1 - whole if skill else whole, *np.percentile(out, [2.5, 97.5]))

    of = lambda m: sorted(t for t, x in metric if x == m)
    for m in ("base", "own", "some"):
        assert got["mean", m, ""] == pytest.approx(by_hand([(metric[t, m], 1.0) for t in of(m)]))
        assert got["skill", m, ""] == pytest.approx(by_hand([(metric[t, m], metric[t, "base"]) for t in of(m)], True))
        best = {t: min(v for (x, _), v in metric.items() if x == t) for t in of(m)}
        assert got["win_rate", m, ""] == pytest.approx(by_hand([(float(metric[t, m] == best[t]), 1.0) for t in of(m)]))
    assert got["difference", "own", "some"] == pytest.approx(by_hand([(metric[t, "some"] - metric[t, "own"], 1.0) for t in of("some")]))
    assert len(got) == 3 * 3 + 6 and evaluate.bootstrap(tasks.limit(0), "base", 50).count() == 0
