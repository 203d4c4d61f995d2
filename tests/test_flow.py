"""Queries against their SQL, and kernels against known answers."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from lagweave.operators import align, channels, decide, delays, encode, kernels, network, spikes
from lagweave.plans import catalogue, further, models, planted, steps  # noqa: F401  (they add to the catalogue)
from lagweave.sources import dynamics, motifs, series
from lagweave.streaming import hourly

SF = "/root/testdata/sf0.001"
LINES = sorted(set(catalogue.ORACLES) - {"fold_scores"})


def rounded(v):
    return float(f"{v:.6g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "lineitem", "nation"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", LINES)
def test_matches_sql(spark, con, name):
    want = con.sql(catalogue.ORACLES[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    a = sorted((tuple(rounded(r[c]) for c in key) for r in got.collect()), key=repr)
    b = sorted((tuple(rounded(r[want.columns.index(c)]) for c in key) for r in want.fetchall()), key=repr)
    assert a == b


def test_equal_frequency_adds_rows_in_their_order(spark, tmp_path):
    """Days with the same sum in cents, whose last bits differ by the order of adding, over files of two sizes: the SQL on one thread reads these in the order of their names."""
    folder, c = tmp_path / "lineitem.parquet", duckdb.connect(config={"threads": 1})
    folder.mkdir()
    rng = np.random.default_rng(12)
    cents, mix = rng.integers(0, 11, 300) / 100, rng.permutation(12000)
    amounts, days = np.concatenate([rng.permutation(cents) for _ in range(40)])[mix], np.repeat(np.arange(40), 300)[mix]
    rows = pd.DataFrame({"l_quantity": 1.0, "l_extendedprice": amounts * 10000, "l_discount": amounts, "l_shipdate": pd.Timestamp("1995-01-01") + pd.to_timedelta(days, "D")})
    for name, part in (("a", rows[:3000]), ("b", rows[3000:])):
        c.sql(f"copy (select * replace (l_shipdate::timestamp as l_shipdate) from part) to '{folder}/{name}.parquet' (format parquet)")
    c.sql(f"create view lineitem as select * from '{folder}/*.parquet'")
    want = c.sql(catalogue.ORACLES["encode_equal_frequency"])
    got = catalogue.QUERIES["encode_equal_frequency"](spark, str(tmp_path))
    found = {tuple(r[k] for k in want.columns) for r in got.collect()}
    want = set(want.fetchall())
    assert len({code for _, _, process, code in want if process == "discount"}) > 1
    assert len(want) == 120 and found == want


def xor(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2, (2, n))
    y = np.r_[0, (a ^ b)[:-1]]
    return np.column_stack([a, b, y])


def test_layers_of_motifs():
    rng = np.random.default_rng(2)
    y, x, w = rng.integers(0, 2, (3, 6000))
    copy = kernels.layers(kernels.joint(x, x, w))
    assert copy["intrinsic"] > 0.95 and copy["synergistic"] < 0.02 and copy["shared"] < 0.02
    synergy = kernels.layers(kernels.joint(x ^ w, x, w))
    assert synergy["synergistic"] > 0.95 and synergy["intrinsic"] < 0.02
    shared = kernels.layers(kernels.joint(w, w, w))
    assert shared["shared"] > 0.95 and shared["te"] < 0.02


def test_gradient_of_a_garbled_context():
    rng = np.random.default_rng(9)
    p, theta = rng.dirichlet(np.ones(24)).reshape(2, 3, 4), rng.normal(size=(4, 3))
    garbled = kernels.Garbled(p)
    value, slope = garbled.at(theta)
    q = np.exp(theta) / np.exp(theta).sum(1, keepdims=True)
    assert math.isclose(value, kernels.mutual(np.einsum("yxw,wz->yxz", p, q)), rel_tol=1e-9)
    for at in np.ndindex(theta.shape):
        step = np.zeros_like(theta)
        step[at] = 1e-6
        assert math.isclose((garbled.at(theta + step)[0] - garbled.at(theta - step)[0]) / 2e-6, slope[at], rel_tol=1e-4, abs_tol=1e-9)


def test_neighbours_match_brute_force():
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(700, 2)), 2)
    d = np.abs(x[:, None] - x[None]).max(axis=2)
    radius = np.sort(d, axis=1)[:, 4]
    tree = kernels.Sorted(x)
    assert np.array_equal(tree.neighbour(4), radius)
    assert np.array_equal(tree.within(radius), np.maximum((d < radius[:, None]).sum(1), 1))
    one, r = rng.normal(size=700), rng.random(700)
    assert np.array_equal(kernels.Sorted(one[:, None]).within(r), (np.abs(one[:, None] - one[None]) < r[:, None]).sum(1))


def test_shuffles_stay_within_strata():
    rng = np.random.default_rng(11)
    y, z = rng.integers(0, 5, 500), rng.integers(0, 7, 500)
    new = kernels.shuffled(y, kernels.strata(z), rng)
    assert (new != y).any() and all(sorted(new[z == k]) == sorted(y[z == k]) for k in range(7))


def test_layer_bounds():
    rng = np.random.default_rng(3)
    for _ in range(15):
        p = rng.dirichlet(np.full(2 * 3 * 3, 0.5)).reshape(2, 3, 3)
        s = kernels.layers(p)
        assert -1e-9 <= s["intrinsic"] <= min(s["te"], s["tdmi"]) + 1e-9
        assert math.isclose(s["te"], s["intrinsic"] + s["synergistic"]) and math.isclose(s["tdmi"], s["intrinsic"] + s["shared"])


def test_parents_of_a_chain():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2, 3000)
    flip = lambda v: np.where(rng.random(len(v)) < 0.1, 1 - v, v)
    b = flip(np.r_[0, a[:-1]])
    c = flip(np.r_[0, 0, b[:-2]])
    found = kernels.select_parents(np.column_stack([a, b, c]), 2, seed=1)
    assert found["sources"] == [(1, 2)] and found["omnibus_p"] < 0.05
    assert kernels.select_parents(np.column_stack([a, b, c]), 1, seed=1)["sources"] == [(0, 1)]


def test_no_flow_between_independent_series():
    rng = np.random.default_rng(5)
    hits = sum(kernels.permutation_test(*rng.integers(0, 2, (3, 400)), 99, k)[1] <= 0.05 for k in range(40))
    assert hits <= 6


def test_closed_forms():
    assert math.isclose(kernels.capacity(np.array([[0.9, 0.1], [0.1, 0.9]])), 1 + 0.9 * math.log2(0.9) + 0.1 * math.log2(0.1), abs_tol=1e-6)
    assert math.isclose(kernels.capacity(np.array([[1.0, 0.0], [0.5, 0.5]])), math.log2(5 / 4), abs_tol=1e-6)
    rng = np.random.default_rng(6)
    x, e = rng.normal(size=(2, 1500))
    y = 0.6 * x + 0.8 * e
    truth = -0.5 * math.log2(1 - 0.36)
    assert abs(kernels.ksg(x, y) - truth) < 0.06
    z = rng.normal(size=1500)
    assert abs(kernels.ksg(x + z, y + z, z) - truth) < 0.09
    s = np.column_stack([x, np.r_[0, x[:-1]] + 0.5 * e])
    te, f = kernels.granger(s, 1, 0)
    assert abs(te - 0.5 * math.log2(1 + 4)) < 0.1 and f > 100 and kernels.granger(s, 0, 1)[0] < 0.01
    assert kernels.coherence(x, 2 * x)[1].min() > 0.999


def test_network_of_xor(spark):
    rows = [(0, t, p, int(v)) for t, r in enumerate(xor(1200)) for p, v in zip("aby", r, strict=True)]
    symbols = spark.createDataFrame(rows, "trial long, t long, process string, code int")
    found = {(r.source, r.target) for r in network.infer(symbols, max_lag=1, n_perm=60).collect() if r.synergistic > 0.5}
    assert found == {("a", "y"), ("b", "y")}


def test_spike_bins_and_gaps(spark):
    spikes = spark.createDataFrame([(0, x) for x in (0.0, 0.012, 0.013, 0.049, 0.051, -0.01)], "neuron int, ts double")
    got = {r.t: r.n for r in series.spike_bins(spikes, 0.005, 0.0, 0.05).collect()}
    assert len(got) == 10 and {k: v for k, v in got.items() if v} == {0: 1, 2: 2, 9: 1}
    samples = spark.createDataFrame([(0, t, "x", v) for t, v in enumerate([1.0, None, 2.0, 3.0, 4.0, None])], "trial long, t long, process string, value double")
    assert sorted(r.t for r in series.split_gaps(samples, 2).collect()) == [2, 3, 4]
    assert {r.t: r.value for r in series.interpolate(samples).collect()} == {0: 1.0, 1: 1.5, 2: 2.0, 3: 3.0, 4: 4.0, 5: None}


def test_spike_bins_reach_the_last_spike(spark):
    spikes = spark.createDataFrame([("a", 0.0), ("a", 7.0), ("b", 10.0)], "neuron string, ts double")
    got = {(r.process, r.t): r.n for r in series.spike_bins(spikes, 5.0).collect()}
    assert len(got) == 6 and {k: v for k, v in got.items() if v} == {("a", 0): 1, ("a", 1): 1, ("b", 2): 1}
    assert series.spike_bins(spikes.where("false"), 5.0).count() == 0


def test_spike_bin_dense_counts_every_event(spark):
    rows = catalogue.QUERIES["spike_bin_dense"](spark, SF).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_windows_do_not_cross_trials(spark):
    rows = [(k, t, "x", float(t % 5)) for k in (0, 1) for t in range(10 + 5 * k)]
    got = encode.ordinal(spark.createDataFrame(rows, "trial long, t long, process string, value double"), 3, 2).collect()
    assert len(got) == 6 + 11 and min(r.t for r in got) == 4


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = hourly.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    a, b = (sorted(map(tuple, f.collect())) for f in (spark.table("hourly_counts"), hourly.windowed_counts(events)))
    assert a == b and len(a) > 0


def test_growing_edges():
    assert spikes.growing_edges(8, 4) == [0, 2, 4, 6, 8] and spikes.growing_edges(4, 4, 2.0) == [0, 1, 2, 3, 4]
    for window, depth, growth in ((8, 3, 0.35), (20, 5, 0.5), (7, 6, 1.0)):
        edges = spikes.growing_edges(window, depth, growth)
        assert edges[0] == 0 and edges[-1] == window and all(a < b for a, b in zip(edges, edges[1:], strict=False))
    with pytest.raises(ValueError):
        spikes.growing_edges(2, 3)


def test_candidate_lags(spark):
    assert delays.lags(10, 3) == [1, 4, 7, 10] and delays.lags(100, 2, 1, True)[0] == 1 and delays.lags(100, 2, 1, True)[-1] == 100
    rows = spark.createDataFrame([("a", 7, 1, 3, 1), ("b", 2, 3, 1, 1), ("c", 4, 2, 1, 2)], "process string, max_lag int, min_lag int, tau int, lag_step int")
    got = sorted((r.process, r.lag) for r in delays.candidate_lags(rows).collect())
    assert got == [("a", 1), ("a", 4), ("a", 7), ("c", 2), ("c", 4)]


def test_spike_encoders_against_loops(spark):
    rng = np.random.default_rng(12)
    x = (rng.random(400) < 0.2).astype(float)
    df = spark.createDataFrame([(0, t, "n", float(v)) for t, v in enumerate(x)], "trial long, t long, process string, value double")
    at = np.flatnonzero(x)
    edges = [0, 1, 3, 8]
    got = {r.t: r.code for r in spikes.exponential_bins(df, edges).collect()}
    assert got == {t: sum(int(x[t - edges[j + 1] + 1 : t - edges[j] + 1].any()) << j for j in range(3)) for t in range(7, 400)}
    gaps, since = np.diff(at), [t - at[at <= t][-1] for t in range(at[0], 400)]
    a, b = (np.quantile(v, [1 / 3, 2 / 3], method="inverted_cdf") for v in ([v for v in since if v < 20], gaps))
    got = {r.t: r.code for r in spikes.spike_intervals(df, 2, 3, 20).collect()}
    for t in range(19, 400):
        seen = at[at <= t]
        whole = len(seen) > 1 and t - seen[-2] < 20
        assert got[t] == (3 * np.searchsorted(a, t - seen[-1], "right") + np.searchsorted(b, seen[-1] - seen[-2], "right") if whole else 9)


def test_motifs_are_what_they_say(spark):
    wide = lambda name: {p: np.array(v) for p, v in _columns(motifs.MOTIFS[name].table(spark, 3000)).items()}
    m = wide("xor_synergy")
    assert (m["y"][1:] == m["a"][:-1] ^ m["b"][:-1]).all() and 0.45 < m["a"].mean() < 0.55
    m = wide("switching_coupling")
    for k in range(6):
        s, d = ("x", "y") if k % 2 == 0 else ("y", "x")
        agree = (m[d][500 * k + 1 : 500 * k + 500] == m[s][500 * k : 500 * k + 499]).mean()
        assert 0.85 < agree < 0.95
    assert abs((wide("chain")["c"][3:] == wide("chain")["a"][:-3]).mean() - 0.905) < 0.03


def _columns(df):
    out = {}
    for r in df.orderBy("t").collect():
        out.setdefault(r.process, []).append(r.code)
    return out


def test_dynamics():
    rng = np.random.default_rng(13)
    x = dynamics.var_process(4000, np.array([[[0.5, 0.0], [0.6, 0.3]]]), 1.0, rng)
    past, now = x[:-1], x[1:]
    assert np.allclose(np.linalg.lstsq(past, now, rcond=None)[0].T, [[0.5, 0.0], [0.6, 0.3]], atol=0.08)
    cells = dynamics.automaton(50, 7, rng, 90, 0.0)
    assert (cells[1:] == np.roll(cells[:-1], 1, axis=1) ^ np.roll(cells[:-1], -1, axis=1)).all()
    for step in (dynamics.logistic, dynamics.tent):
        y = dynamics.coupled_maps(500, np.array([[0, 0.0], [0.3, 0]]), step, rng)
        assert 0 <= y.min() and y.max() <= 1 and y.std() > 0.1
        assert np.allclose(y[1:, 0], step(y[:-1, 0])) and np.allclose(y[1:, 1], 0.7 * step(y[:-1, 1]) + 0.3 * step(y[:-1, 0]))
    z = dynamics.lorenz96(300, 6, rng)
    assert np.isfinite(z).all() and 1 < z.std() < 10
    fired = dynamics.spiking(6000, np.array([[0.0, 0.0], [3.0, 0.0]]), rng)
    after = fired[1:, 1][fired[:-1, 0] == 1].mean()
    assert after > 3 * fired[:, 1].mean() and not (fired[1:] & fired[:-1]).any()


def test_simulated_repetitions_differ(spark):
    rows = dynamics.simulate(spark, lambda rng: rng.normal(size=(20, 2)), 3, 5)
    again = dynamics.simulate(spark, lambda rng: rng.normal(size=(20, 2)), 3, 5)
    values = sorted((r.trial, r.t, r.process, r.value) for r in rows.collect())
    assert len(values) == 120 and len({v[3] for v in values}) == 120 and values == sorted((r.trial, r.t, r.process, r.value) for r in again.collect())


def test_closure_of_a_long_path(spark):
    arcs = spark.createDataFrame([(k, k + 1) for k in range(70)], "source long, target long")
    assert decide.closure(arcs).count() == 71 * 70 // 2


def test_average_precision_counts_ties_against(spark):
    rows = spark.createDataFrame([(3.0, True), (2.0, False), (2.0, True), (1.0, False)], "s double, t boolean")
    r = decide.average_precision(rows, "s", rows["t"]).first()
    assert r.p == 2 and math.isclose(r.ap, (1 + 2 / 3) / 2)


def test_merging_contexts_keeps_information(spark):
    rows = [("e", y, x, w, n) for w, law in enumerate([(4, 2, 1, 1), (1, 5, 1, 1), (8, 4, 2, 2)]) for (y, x), n in zip(((0, 0), (0, 1), (1, 0), (1, 1)), law, strict=True)]
    table = spark.createDataFrame(rows, "k string, y int, x int, w int, n long")
    mapping = channels.laws(table, ["k"])
    assert {r.w: r.cluster for r in mapping.collect()} == {0: 0, 1: 1, 2: 0}
    assert {(r.y, r.x, r.w): r.n for r in channels.merged(table, mapping, ["k"]).collect()}[0, 0, 0] == 12


def test_longer_windows(spark):
    rows = [(0, t, p, t * (1 if p == "a" else 100)) for t in range(6) for p in "ab"]
    got = {(r.source, r.t): (r.y, r.w, r.x) for r in align.windowed_pairs(spark.createDataFrame(rows, "trial long, t long, process string, code int"), 2, 2, 2).collect()}
    assert got["b", 5] == (5, [4, 3], [300, 200]) and ("b", 2) not in got and ("b", 3) in got
