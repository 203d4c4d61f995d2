"""Decompositions, machines, histograms, spectra, families and regimes against known answers."""

import math
from collections import Counter

import numpy as np

from lagweave.operators import adaptive, families, info, machine, pid, posterior, regimes, spectral
from lagweave.plans import models


def gate(f):
    n = np.zeros((2, 2, 2), int)
    for a in (0, 1):
        for b in (0, 1):
            n[f(a, b), a, b] += 100
    return n


def test_pid_of_gates():
    for m in pid.REDUNDANCY:
        x = pid.parts(gate(lambda a, b: a ^ b) / 400, m)
        assert abs(x["synergy"] - 1) < 1e-6 and x["redundancy"] < 1e-6
    u = pid.parts(gate(lambda a, b: a) / 400)
    assert abs(u["unique1"] - 1) < 1e-6 and abs(u["synergy"]) < 1e-6
    copied = np.zeros((2, 2, 2), int)
    copied[0, 0, 0] = copied[1, 1, 1] = 50
    assert abs(pid.parts(copied / 100)["redundancy"] - 1) < 1e-6
    a = pid.parts(gate(lambda a, b: a & b) / 400)  # known: 0.311 redundant, 0.5 synergistic
    assert abs(a["redundancy"] - 0.3113) < 2e-3 and abs(a["synergy"] - 0.5) < 2e-3 and abs(a["unique1"]) < 2e-3


def test_synergy_null_keeps_margins():
    n = gate(lambda a, b: a ^ b) + 3
    drawn = pid.without_interaction(n, np.random.default_rng(0))
    assert (drawn.sum(1) == n.sum(1)).all() and (drawn.sum(2) == n.sum(2)).all()
    assert pid.synergy_test(n, draws=19) == 0.05


def test_hyperedges(spark):
    n = gate(lambda a, b: a ^ b)
    rows = [("a", "b", "y", int(y), int(i), int(j), int(n[y, i, j])) for y, i, j in np.argwhere(n)]
    cells = spark.createDataFrame(rows, "source1 string, source2 string, target string, y int, x1 int, x2 int, n long")
    found = pid.hyperedges(cells, draws=19)
    r = found.first()
    assert r.kind == "synergistic" and r.p == 0.05
    assert {tuple(e) for e in pid.hypergraph(found).collect()} == {("a", "a+b>y"), ("b", "a+b>y"), ("a+b>y", "y")}


def counts(x, length):
    table = {}
    for w, n in Counter(tuple(x[i : i + length + 1]) for i in range(len(x) - length)).items():
        table.setdefault(w[:-1], np.zeros(2))[w[-1]] += n
    return table


def test_machines_of_known_processes():
    rng = np.random.default_rng(0)
    m = machine.measures(counts(rng.integers(0, 2, 20000).tolist(), 3))
    assert m["states"] == 1 and m["rate"] > 0.999 and m["complexity"] == 0
    golden, x = [0], 0
    for _ in range(20000):
        x = int(rng.random() < 0.5) if golden[-1] == 0 else 0
        golden.append(x)
    m = machine.measures(counts(golden, 3))
    assert m["states"] == 2 and abs(m["rate"] - 2 / 3) < 0.01 and abs(m["complexity"] - 0.918) < 0.01 and abs(m["excess"] - 0.252) < 0.02
    m = machine.measures(counts([0, 1] * 500, 2))
    assert m["states"] == 2 and m["rate"] == 0 and abs(m["complexity"] - 1) < 1e-3


def test_chi_squared_tail():
    assert math.isclose(machine.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(machine.chi2_sf(2.0, 2), math.exp(-1), rel_tol=1e-9)
    assert math.isclose(machine.chi2_sf(30.0, 2), math.exp(-15), rel_tol=1e-9)
    assert math.isclose(machine.chi2_sf(18.307038053275146, 10), 0.05, rel_tol=1e-9)


def test_words_skip_gaps_and_trials(spark):
    rows = [(0, 0, "p", 0), (0, 1, "p", 1), (0, 3, "p", 0), (0, 4, "p", 1), (1, 0, "p", 1)]
    got = machine.words(spark.createDataFrame(rows, "trial long, t long, process string, code int"), 2).collect()
    assert [(r.word, r.n) for r in got] == [([0, 1], 2)]


def test_regret_and_histogram():
    exact = math.log(sum(math.comb(6, h) * (h / 6) ** h * ((6 - h) / 6) ** (6 - h) for h in range(7)))
    assert math.isclose(adaptive.regrets(6, 2)[1], exact, rel_tol=1e-12)
    three = sum(math.factorial(6) / math.factorial(a) / math.factorial(b) / math.factorial(6 - a - b) * (a / 6) ** a * (b / 6) ** b * ((6 - a - b) / 6) ** (6 - a - b) for a in range(7) for b in range(7 - a))
    assert math.isclose(adaptive.regrets(6, 3)[2], math.log(three), rel_tol=1e-9)
    rng = np.random.default_rng(0)
    assert adaptive.cuts(rng.random(2000))[0] == []
    found, _ = adaptive.cuts(np.r_[rng.random(500), 10 + rng.random(500)])
    assert len(found) == 2 and 0.9 < found[0] < 1.1 and 9.9 < found[1] < 10.1
    assert adaptive.cuts(np.array([]))[0] == adaptive.cuts(np.ones(9))[0] == []


def test_backbone_of_a_chain():
    rng = np.random.default_rng(2)
    a, e, g = rng.normal(size=(3, 4000))
    b = np.r_[0, a[:-1]] + e
    x = np.column_stack([a, b, np.r_[0, b[:-1]] + g])
    assert spectral.backbone_test(x, 0, 1, 64, 19)["p"] == 0.05
    far = spectral.backbone_test(x, 0, 2, 64, 19)
    assert far["rate"] > 0.1 and far["conditional_rate"] < 0.05 and far["p"] > 0.05
    s = spectral.spectrum(x, 64)
    assert abs(spectral.rate(spectral.coherence(s, 0, 1)) - 0.5) < 0.08  # white input at equal power: log2(2) / 2


def test_drawn_series_have_the_spectra_given():
    rng = np.random.default_rng(3)
    e = rng.normal(size=(60_000, 3))
    x = np.column_stack([e[:, 0], np.r_[0, e[:-1, 0]] + e[:, 1], e[:, 2] + 0.5 * e[:, 1]])
    s = spectral.spectrum(x, 32)
    low = spectral.factor(s)
    assert np.allclose(low @ low.conj().transpose(0, 2, 1), s, atol=1e-6)
    again = spectral.spectrum(spectral.draw(s, 60_000, rng), 32)
    assert np.abs(again - s).max() < 0.25
    cut = spectral.spectrum(spectral.draw(spectral.unlinked(s, 0, 1, False), 60_000, rng), 32)
    assert spectral.rate(spectral.coherence(cut, 0, 1)) < 0.01 < spectral.rate(spectral.coherence(s, 0, 1))


def test_families():
    assert [len(families.graphs(n)) for n in (2, 3, 4)] == [3, 25, 543]
    chain = frozenset({(0, 1), (1, 2)})
    fits = lambda g: {s for s in families.statements(3) if families.separated(g, *s)}
    assert fits(chain) == {(0, 2, frozenset({1}))}
    found = families.explanations(3, fits(chain))
    assert len(found["graphs"]) == 3 and found["arrows"] == [] and found["links"] == [(0, 1), (1, 2)]
    collider = families.explanations(3, fits(frozenset({(0, 1), (2, 1)})))
    assert collider["graphs"] == [[(0, 1), (2, 1)]] and collider["arrows"] == [(0, 1), (2, 1)]


def test_families_of_five_processes(spark):
    assert len(families.graphs(5)) == 29281
    rng = np.random.default_rng(9)
    a, b, d, e = rng.integers(0, 2, (4, 4000))
    c = np.where(rng.random(4000) < 0.9, e, d)
    rows = [(0, t, p, int(v)) for p, x in zip("abcde", (a, b, c, d, e), strict=True) for t, v in enumerate(x)]
    symbols = spark.createDataFrame(rows, "trial long, t long, process string, code int")
    r = models.explaining(symbols).first()
    assert r.status == "complete" and "c-e" in r.links
    more = symbols.union(symbols.where("process = 'a'").replace("a", "f", "process"))
    assert [(r.status, r.graphs) for r in models.explaining(more).collect()] == [("too large", None)]


def test_regimes_are_found(spark):
    rng, x = np.random.default_rng(4), [0]
    for t in range(1, 1200):
        x.append(x[-1] ^ int(rng.random() < (0.1 if (t // 300) % 2 else 0.7)))
    symbols = spark.createDataFrame([(0, t, "p", v) for t, v in enumerate(x)], "trial long, t long, process string, code int")
    got = {r.window: r.regime for r in regimes.infer(symbols, window=100).collect()}
    assert [got[k] for k in range(12)] == [1] * 3 + [0] * 3 + [1] * 3 + [0] * 3


def test_o_information_rate_of_copies_and_parity(spark):
    """Three copies of a fair coin carry one bit of redundancy a step, a parity of two coins one bit of synergy."""
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 2, (2, 4001))
    rows = []
    for key, cols in (("copy", (x, x, x)), ("parity", (x, y, x ^ y))):
        for t in range(1, 4001):
            rows.append((key, *[int(c[t]) for c in cols], *[int(c[t - 1]) for c in cols]))
    got = {r.k: r.rate for r in info.o_information_rate(spark.createDataFrame(rows, "k string, a int, b int, c int, pa int, pb int, pc int"), ["k"], ["a", "b", "c"], ["pa", "pb", "pc"]).collect()}
    assert abs(got["copy"] - 1) < 0.01 and abs(got["parity"] + 1) < 0.01


def test_posterior_of_layers(spark):
    """A source copied by the target is intrinsic flow; the parity of source and past is synergistic."""
    for kind, f in (("intrinsic", lambda x, w: x), ("synergistic", lambda x, w: x ^ w)):
        rows = [("s", "t", f(x, w), x, w, 400) for x in (0, 1) for w in (0, 1)]
        r = posterior.layer_posterior(spark.createDataFrame(rows, "source string, target string, y int, x int, w int, n long"), size=20).first()
        assert r.N == 1600 and r[f"{kind}_low"] <= r[f"{kind}_mean"] <= r[f"{kind}_high"] and r[f"{kind}_mean"] > 0.95
        assert r.shared_dominant is False or r.intrinsic_mean < 0.01
