"""Queries of models on top of count tables: decompositions, machines, regimes, spectra, families; registered in the catalogue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators import adaptive, align, decide, families, info, machine, network, pid, posterior, regimes, spectral
from lagweave.plans.catalogue import _NEEDS, _SQL, ev_hour, ev_pairs, ev_symbols, query
from lagweave.sources.tables import table

_SQL["lag0"] = "lag0 AS (SELECT a.process AS i, b.process AS j, a.code AS y, b.code AS x, wa.code AS wi, wb.code AS wj FROM sym a JOIN sym b ON a.trial = b.trial AND a.t = b.t AND a.process < b.process JOIN sym wa ON wa.trial = a.trial AND wa.process = a.process AND wa.t = a.t - 1 JOIN sym wb ON wb.trial = b.trial AND wb.process = b.process AND wb.t = b.t - 1)"

_NEEDS["lag0"] = ["sym"]


def simultaneous(symbols: DataFrame) -> DataFrame:
    """Realizations (i, j, y, x, wi, wj) of all pairs at one time, each with its own last symbol."""
    own = align.pairs(symbols, [0])  # y: target now, x: source now, w: the target's last symbol
    last = symbols.select("trial", (F.col("t") + 1).alias("t"), F.col("process").alias("source"), F.col("code").alias("wj"))
    return own.join(last, ["trial", "t", "source"]).where("target < source").select(F.col("target").alias("i"), F.col("source").alias("j"), "y", "x", F.col("w").alias("wi"), "wj")


def _part(columns: str) -> str:
    """SQL of the sum of n log2 n over the cells of some columns, for each pair."""
    return f"(SELECT i, j, sum(n * log2(n)) AS s, sum(n) AS total FROM (SELECT i, j, {columns}, count(*) AS n FROM lag0 GROUP BY ALL) GROUP BY i, j)"


@query(
    "lag0_exchange",
    f"SELECT i, j, a.total::BIGINT AS \"N\", round((a.s + d.s - b.s - c.s) / a.total, 9) AS cmi FROM {_part('y, x, wi, wj')} a JOIN {_part('y, wi, wj')} b USING (i, j) JOIN {_part('x, wi, wj')} c USING (i, j) JOIN {_part('wi, wj')} d USING (i, j)",
    ("lag0",),
)
def lag0_exchange(s: SparkSession, d: str) -> DataFrame:
    cells = info.counts(simultaneous(ev_symbols(s, d)), ["i", "j"], ["y", "x", "wi", "wj"])
    return info.conditional_mi(cells, ["i", "j"], w=["wi", "wj"]).select("i", "j", "N", F.round("cmi", 9).alias("cmi"))


_SQL["tri"] = """tri AS (SELECT a.process AS a, b.process AS b, c.process AS c, a.code AS an, b.code AS bn, c.code AS cn, wa.code AS ap, wb.code AS bp, wc.code AS cp
    FROM sym a JOIN sym b ON a.trial = b.trial AND a.t = b.t AND a.process < b.process JOIN sym c ON a.trial = c.trial AND a.t = c.t AND b.process < c.process
    JOIN sym wa ON wa.trial = a.trial AND wa.process = a.process AND wa.t = a.t - 1 JOIN sym wb ON wb.trial = b.trial AND wb.process = b.process AND wb.t = b.t - 1 JOIN sym wc ON wc.trial = c.trial AND wc.process = c.process AND wc.t = c.t - 1)"""
_NEEDS["tri"] = ["sym"]


def _rate_sql() -> str:
    """A row for each cell of each marginal with its sign, summed up."""
    rows = []
    for outer, ends in ((1, "np"), (-1, "p")):
        for members, sign in (("abc", 1), ("a", 1), ("b", 1), ("c", 1), ("bc", -1), ("ac", -1), ("ab", -1)):
            rows.append(f"SELECT a, b, c, {outer * sign} AS sign, count(*) AS n FROM tri GROUP BY a, b, c, {', '.join(m + e for m in members for e in ends)}")
    return f"SELECT a, b, c, max(total)::BIGINT AS \"N\", round(-sum(sign * n * log2(n)) / max(total), 9) AS rate FROM ({' UNION ALL '.join(rows)}) JOIN (SELECT a, b, c, count(*) AS total FROM tri GROUP BY ALL) USING (a, b, c) GROUP BY a, b, c"


@query("o_information_rate", _rate_sql(), ("tri",))
def o_information_rate(s: SparkSession, d: str) -> DataFrame:
    symbols = ev_symbols(s, d)
    before = symbols.select("trial", "process", (F.col("t") + 1).alias("t"), F.col("code").alias("p"))
    one = symbols.join(before, ["trial", "process", "t"])
    a, b, c = (one.select("trial", "t", F.col("process").alias(x), F.col("code").alias(f"{x}n"), F.col("p").alias(f"{x}p")) for x in "abc")
    triples = a.join(b, ["trial", "t"]).where("a < b").join(c, ["trial", "t"]).where("b < c")
    return info.o_information_rate(triples, ["a", "b", "c"], ["an", "bn", "cn"], ["ap", "bp", "cp"]).select("a", "b", "c", "N", F.round("rate", 9).alias("rate"))


@query(
    "log_log_slope",
    "SELECT l_returnflag AS flag, count(*) AS n, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 8) AS slope FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1",
)
def log_log_slope(s: SparkSession, d: str) -> DataFrame:
    """The exponent by which one quantity scales with another: the slope of their logarithms."""
    rows = table(s, d, "lineitem").where("l_quantity > 0 and l_extendedprice > 0")
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(F.log("l_extendedprice"), F.log("l_quantity")), 8).alias("slope"))


@query(
    "entropy_jackknife_shrink",
    """SELECT process, round(max(nn) * (log2(max(nn)) - max(s) / max(nn)) - (max(nn) - 1) / max(nn) * sum(n * (log2(nn - 1) - (s - n * log2(n) + CASE WHEN n > 1 THEN (n - 1) * log2(n - 1) ELSE 0 END) / (nn - 1))), 6) AS jackknife,
      round(sum(-p * log2(p)), 6) AS shrink
    FROM (SELECT *, lam / k + (1 - lam) * n / nn AS p FROM (SELECT *, CASE WHEN k > 1 AND sq > 1 / k THEN least(1.0, (1 - sq) / ((nn - 1) * (sq - 1 / k))) ELSE 1 END AS lam
      FROM (SELECT *, sum(n) OVER w AS nn, count(*) OVER w AS k, sum(n * log2(n)) OVER w AS s, sum(n * n) OVER w / (sum(n) OVER w) ** 2 AS sq
        FROM (SELECT process, value, count(*)::DOUBLE AS n FROM hour GROUP BY ALL) WINDOW w AS (PARTITION BY process)))) GROUP BY process""",
    ("hour",),
)
def entropy_jackknife_shrink(s: SparkSession, d: str) -> DataFrame:
    cells = ev_hour(s, d).groupBy("process", "value").agg(F.count(F.lit(1)).alias("n"))
    return info.more_entropies(cells, ["process"]).select("process", F.round("jackknife", 6).alias("jackknife"), F.round("shrink", 6).alias("shrink"))


def _evidence(context: str) -> str:
    return f"""(SELECT source, target, sum(lgamma(a) - lgamma(a + nc) + cell) AS e FROM (SELECT source, target, 1.0 / count(*) OVER (PARTITION BY source, target) AS a, nc, ns FROM (SELECT source, target, {context}, sum(n) AS nc, list(n) AS ns FROM (SELECT source, target, {context}, y, sum(n) AS n FROM cnt WHERE lag = 1 GROUP BY ALL) GROUP BY source, target, {context})), LATERAL (SELECT list_sum(list_transform(ns, lambda m: lgamma(a / 2 + m) - lgamma(a / 2))) AS cell) GROUP BY source, target)"""


@query("log_bayes_factor", f"SELECT source, target, round(f.e - p.e, 5) AS log_bf FROM {_evidence('x, w')} f JOIN {_evidence('w')} p USING (source, target)", ("cnt",))
def log_bayes_factor(s: SparkSession, d: str) -> DataFrame:
    cells = info.counts(ev_pairs(s, d), ["source", "target"], ["y", "x", "w"])
    return info.log_bayes_factor(cells, ["source", "target"], 2).select("source", "target", F.round("log_bf", 5).alias("log_bf"))


@query(
    "markov_words",
    "SELECT a.process, a.code AS c0, b.code AS c1, c.code AS c2, count(*) AS n FROM sym a JOIN sym b ON a.trial = b.trial AND a.process = b.process AND b.t = a.t + 1 JOIN sym c ON a.trial = c.trial AND a.process = c.process AND c.t = a.t + 2 GROUP BY ALL",
    ("sym",),
)
def markov_words(s: SparkSession, d: str) -> DataFrame:
    w = machine.words(ev_symbols(s, d), 3)
    return w.select("process", *[F.col("word")[k].alias(f"c{k}") for k in range(3)], "n")


@query(
    "regime_transitions",
    "SELECT a.trial, floor(a.t / 72)::BIGINT AS \"window\", a.process, b.code AS w, a.code AS y, count(*) AS n FROM sym a JOIN sym b ON a.trial = b.trial AND a.process = b.process AND b.t = a.t - 1 AND floor(a.t / 72) = floor(b.t / 72) WHERE floor(a.t / 72) IN (SELECT floor(t / 72) FROM sym WHERE process = a.process GROUP BY 1 HAVING count(*) = 72) GROUP BY ALL",
    ("sym",),
)
def regime_transitions(s: SparkSession, d: str) -> DataFrame:
    return regimes.transitions(ev_symbols(s, d), 72).select("trial", "window", "process", "w", "y", "n")


# The queries below have no SQL twin; tests hold their kernels against known answers.


@query("infer_regimes")
def infer_regimes(s: SparkSession, d: str) -> DataFrame:
    return regimes.infer(ev_symbols(s, d))


def source_pairs(s: SparkSession, d: str) -> DataFrame:
    """Count tables (y, x1, x2) of all pairs of sources of each target, both one step before."""
    one = ev_pairs(s, d).select("target", "trial", "t", "y", F.col("source").alias("source1"), F.col("x").alias("x1"))
    two = one.select("target", "trial", "t", F.col("source1").alias("source2"), F.col("x1").alias("x2"))
    both = one.join(two, ["target", "trial", "t"]).where("source1 < source2")
    return info.counts(both, ["source1", "source2", "target"], ["y", "x1", "x2"])


@query("pid_hyperedges")
def pid_hyperedges(s: SparkSession, d: str) -> DataFrame:
    return decide.adjust(pid.hyperedges(source_pairs(s, d)), family=["target"])


@query("pid_hypergraph")
def pid_hypergraph(s: SparkSession, d: str) -> DataFrame:
    return pid.hypergraph(pid.hyperedges(source_pairs(s, d), "mmi", draws=0))


@query("layer_posterior")
def layer_posterior(s: SparkSession, d: str) -> DataFrame:
    return posterior.layer_posterior(info.counts(ev_pairs(s, d), ["source", "target"], ["y", "x", "w"]))


@query("epsilon_machines")
def epsilon_machines(s: SparkSession, d: str) -> DataFrame:
    return machine.machines(ev_symbols(s, d))


@query("mdl_histograms")
def mdl_histograms(s: SparkSession, d: str) -> DataFrame:
    return adaptive.histograms(ev_hour(s, d))


@query("infer_backbone")
def infer_backbone(s: SparkSession, d: str) -> DataFrame:
    def kernel(m, names, target):
        return [{"a": names[p], "b": names[target], **spectral.backbone_test(m, p, target, draws=49, seed=31 * target + p)} for p in range(target)]

    tests = network.per_target(ev_hour(s, d), kernel, "a string, b string, rate double, conditional_rate double, p double", "value")
    return decide.adjust(tests, dependent=True).withColumn("linked", F.col("q") <= 0.05)


@query("lag0_families")
def lag0_families(s: SparkSession, d: str) -> DataFrame:
    """Graphs over all processes that explain their simultaneous independences, by G tests at 0.01 of counts of (symbols now, symbols before); the status 'too large' and no graphs beyond five processes."""
    return explaining(ev_symbols(s, d))


def explaining(symbols: DataFrame) -> DataFrame:
    schema = "graphs long, arrows array<string>, links array<string>, possible array<string>, status string"
    names = [r.process for r in symbols.select("process").distinct().orderBy("process").limit(families.MAX_NODES + 1).collect()]
    if len(names) > families.MAX_NODES:  # graphs are not listed for so many nodes
        return symbols.sparkSession.createDataFrame([(None, None, None, None, "too large")], schema)
    wide = symbols.where(F.col("process").isin(names)).groupBy("trial", "t").pivot("process", names).agg(F.first("code"))
    cells = wide.dropna().groupBy(*[F.col(f"`{n}`").alias(f"v{k}") for k, n in enumerate(names)]).agg(F.count(F.lit(1)).alias("n"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        independent = {t for t in families.statements(len(names)) if families.g_independent(f, *t)}
        found = families.explanations(len(names), independent)
        show = lambda arcs, by: [f"{names[a]}{by}{names[b]}" for a, b in arcs]
        return pd.DataFrame([{"graphs": len(found["graphs"]), "arrows": show(found["arrows"], ">"), "links": show(found["links"], "-"), "possible": show(found["possible"], "-"), "status": "complete"}])

    return cells.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, schema)  # at most alphabet ** 5 rows
