"""Curves, multi-information, readers, sinks and running tables against known answers and plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.operators import curves
from lagweave.sources import networks
from lagweave.streaming import running


def test_scaling_region_of_a_bent_line(spark):
    y = [2.0 + 0.5 * x if x <= 8 else 6.0 for x in range(1, 13)]
    y[0] = 2.2
    rows = [("a", float(x), v) for x, v in enumerate(y, 1)] + [("short", 1.0, 1.0), ("short", 2.0, 2.0)]
    got = curves.scaling_region(spark.createDataFrame(rows, "process string, x double, y double"), ["process"]).collect()
    assert [r.process for r in got] == ["a"]
    fits = [np.polyfit(range(i + 1, j + 1), y[i:j], 1)[0] for i in range(12) for j in range(i + 3, 13)]
    assert got[0].fits == len(fits) and (abs(got[0].slope - 0.5) < 0.02 or abs(got[0].slope) < 0.02)


def test_line_fits_weights(spark):
    y = [1.0, 2.5, 2.9, 4.2]
    rows = [("a", float(x), v) for x, v in enumerate(y)]
    got = {(r.start, r.stop): r for r in curves.line_fits(spark.createDataFrame(rows, "p string, x double, y double"), ["p"]).collect()}
    assert set(got) == {(0, 2), (1, 3), (0, 3)}
    for (a, b), r in got.items():
        x = np.arange(a, b + 1)
        k, c = np.polyfit(x, y[int(a) : int(b) + 1], 1)
        error = np.sqrt(np.mean((np.array(y[int(a) : int(b) + 1]) - c - k * x) ** 2)) + 1e-12 * max(1, max(np.abs(y)))
        assert r.slope == pytest.approx(k) and r.intercept == pytest.approx(c)
        assert r.weight == pytest.approx(np.hypot(b - a, k * (b - a)) / error**2, rel=1e-6)


def test_stationarity_tells_a_change(spark):
    rng = np.random.default_rng(0)
    same, turned = rng.normal(size=1200), np.concatenate([np.arange(600.0), rng.normal(size=600)])
    rows = [(0, t, p, float(v)) for p, x in (("same", same), ("turned", turned)) for t, v in enumerate(x)] + [(0, t, "short", 1.0) for t in range(8)]
    got = {r.process: r for r in curves.stationarity(spark.createDataFrame(rows, "trial long, t long, process string, value double")).collect()}
    assert set(got) == {"same", "turned"}
    assert got["same"].p > 0.001 and got["turned"].p < 1e-6 and got["same"].dof == 15


def test_multi_information_of_copies_and_xor(spark):
    bits = [(i >> 1 & 1, i & 1) for i in range(4)]
    rows = [("xor", a, b, a ^ b) for a, b in bits] + [("copy", a, a, a) for a in (0, 1)]
    got = {r.k: r for r in curves.multi_information(spark.createDataFrame(rows, "k string, a int, b int, c int"), ["k"], ["a", "b", "c"]).collect()}
    assert (got["xor"].total_correlation, got["xor"].dual_total_correlation, got["xor"].coinformation) == pytest.approx((1, 2, -1))
    assert (got["copy"].total_correlation, got["copy"].dual_total_correlation, got["copy"].coinformation) == pytest.approx((2, 1, 1))


def test_rivers(spark, tmp_path):
    lines = ["time,12,13.0,Rhine"] + [f"2020-01-01 00:{15 * k:02d}:00,{v}" for k, v in enumerate(["1,2,", "3,,5", "5,6,7", ",8,9"])]
    (tmp_path / "r.csv").write_text("\n".join(lines) + "\n")
    long = networks.read_rivers(spark, str(tmp_path / "r.csv"))
    got = {(r.process, r.t): r.value for r in long.collect()}
    assert len(got) == 12 and got["12", 1] == 3 and got["13", 1] is None and got["Rhine", 0] is None
    arcs = spark.createDataFrame([("12", "13"), ("13", "Rhine")], "source string, target string")
    rows, inside = networks.subset(long, arcs, ["12", "13"])
    assert {(r.process, r.t): r.value for r in rows.collect()} == {("12", 0): 1, ("12", 1): 3, ("12", 2): 5, ("13", 0): 2, ("13", 1): 4, ("13", 2): 6}
    assert [tuple(r) for r in inside.collect()] == [("12", "13")]
    assert {r.t for r in networks.subset(long, arcs, ["12", "13"], gaps="drop")[0].collect()} == {0, 2}
    blocks = networks.subset(long, arcs, ["12", "13"], block=2)[0]
    assert {(r.process, r.t): r.value for r in blocks.collect()} == {("12", 0): 2, ("12", 1): 5, ("13", 0): 2, ("13", 1): 7}
    with pytest.raises(ValueError):
        networks.subset(long, arcs, ["12"], gaps="keep")


def test_grown_sets_hang_together(spark):
    arcs = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("x", "y")], "source string, target string")
    for seed in range(4):
        assert sorted(networks.grow(arcs, 4, seed)) == ["a", "b", "c", "d"]
    assert networks.grow(arcs, 3, 1) == networks.grow(arcs, 3, 1)
    with pytest.raises(ValueError):
        networks.grow(arcs, 5)


def test_arrays(spark, tmp_path):
    x = np.arange(24.0).reshape(2, 3, 4)
    m = np.zeros((4, 4))
    m[0, 1] = m[1, 1] = m[2, 0] = 1
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "m.npy", m)
    series, arcs = networks.read_arrays(spark, str(tmp_path / "x.npy"), str(tmp_path / "m.npy"))
    assert {(r.trial, r.t, r.process): r.value for r in series.collect()} == {(i, j, str(k)): x[i, j, k] for i in range(2) for j in range(3) for k in range(2)}
    assert [(r.source, r.target) for r in arcs.collect()] == [(0, 1)]
    turned = networks.read_arrays(spark, str(tmp_path / "x.npy"), str(tmp_path / "m.npy"), forward=False)[1]
    assert [(r.source, r.target) for r in turned.collect()] == [(1, 0)]
    whole = networks.read_arrays(spark, str(tmp_path / "x.npy"), str(tmp_path / "m.npy"), residuals=False)[1]
    assert {(r.source, r.target) for r in whole.collect()} == {(0, 1), (2, 0)}


def test_uploads_and_viewer_lines(spark):
    edges = spark.createDataFrame([("a", "b", 0.5, True), ("b", "c", -0.2, False)], "source string, target string, weight double, significant boolean")
    up = json.loads(networks.upload([edges.withColumnRenamed("weight", "score")], "abc", model="m"))
    assert up == {"method_sha": "abc", "model": "m", "scores": [[0, 0.5, 0, 0, 0, 0, 0, 0, 0]]}
    places = spark.createDataFrame([("a", 1, 2, 3), ("b", 0, 0, 0), ("c", 9, 9, 9)], "process string, x int, y int, z int").withColumn("process", F.col("process"))
    nodes, rows = networks.viewer_lines(edges, places)
    assert nodes.orderBy("k").first().line == "1.000\t2.000\t3.000\t1\t1\ta"
    assert [r.line for r in rows.orderBy("k").collect()] == ["0.000000\t0.500000\t0.000000"] + ["0.000000\t0.000000\t0.000000"] * 2


def test_running_tables_over_several_batches(spark, tmp_path):
    at = str(tmp_path / "in")
    for k, rows in enumerate([[("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 10:30:00")], [("a", "2024-01-01 08:30:00"), ("a", "2024-01-01 09:30:00"), ("b", "2024-01-01 12:00:00")]]):
        spark.createDataFrame(rows, "event_type string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(at)
        (tmp_path / f"pause{k}").touch()
    counted = running.Running(spark, "event_type string, n long", running.add_counts(["event_type"]))
    stream = running.events_stream(spark, at, files=1)
    assert {tuple(r) for r in counted.drain(stream).collect()} == {("a", 3), ("b", 2)} and counted.batch == 1
    # a batch that is run again gives the same table
    counted(spark.createDataFrame([("a",)] * 2 + [("b",)], "event_type string"), 1)
    assert {tuple(r) for r in counted.version(1).collect()} == {("a", 3), ("b", 2)}


def test_late_rows_are_counted_apart(spark):
    late = running.Running(spark, "event_type string, seen timestamp, n long, late long", running.count_late("1 HOUR"))
    for k, rows in enumerate([[("a", "2024-01-01 10:00:00")], [("a", "2024-01-01 08:30:00"), ("a", "2024-01-01 09:30:00"), ("b", "2024-01-01 01:00:00")]]):
        late(spark.createDataFrame(rows, "event_type string, ts string").withColumn("ts", F.to_timestamp("ts")), k)
    assert {(r.event_type, r.n, r.late) for r in late.version(1).collect()} == {("a", 3, 1), ("b", 1, 0)}
