"""Queries on networks with known truth: the series themselves, their transfer entropies, and the arcs that inference finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.operators import align, decide, info, network
from lagweave.plans.catalogue import _NEEDS, _SQL, EDGE, query
from lagweave.sources.motifs import MOTIFS, Motif

STEPS = 3000


def _cmi_sql(motif: Motif, n: int) -> str:
    """The shared views of lagged pairs, counts and information, over a motif in place of the event log."""
    return f"WITH sym AS ({motif.sql(n)}),\n" + ",\n".join(_SQL[v] for v in ("pairs", "cnt", "cmi")) + "\n"


def scores(spark: SparkSession, motif: Motif, n: int = STEPS, lags: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    return info.conditional_mi(info.counts(align.pairs(motif.table(spark, n), list(lags)), EDGE, ["y", "x", "w"]), EDGE)


def _register(name: str, motif: Motif) -> None:
    @query(f"gen_{name}", motif.sql(STEPS))
    def _(s, d):
        return motif.table(s, STEPS)

    if not motif.truth:
        return

    @query(f"te_{name}", _cmi_sql(motif, STEPS) + 'SELECT source, target, lag, "N", round(cmi, 9) AS te, round(cmi + corr, 9) AS te_mm FROM cmi')
    def _(s, d):
        return scores(s, motif).select(*EDGE, "N", F.round("cmi", 9).alias("te"), F.round("cmi_mm", 9).alias("te_mm"))

    truth = ", ".join(f"('{a}', '{b}', {lag})" for a, b, lag in motif.truth)

    @query(
        f"rank_{name}",
        _cmi_sql(motif, STEPS)
        + f"""SELECT sum(y)::BIGINT AS p, count(*) AS n, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) AS auroc, round(sum(CASE WHEN y = 1 THEN hits / k END) / sum(y), 9) AS ap FROM (
          SELECT *, sum(y) OVER (ORDER BY te DESC, y ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER (ORDER BY te DESC, y) AS k, rank() OVER (ORDER BY te) + (count(*) OVER (PARTITION BY te) - 1) / 2 AS r FROM (
            SELECT round(cmi, 12) AS te, (g.source IS NOT NULL)::INT AS y FROM cmi LEFT JOIN (VALUES {truth}) g(source, target, lag) ON g.source = cmi.source AND g.target = cmi.target AND g.lag = cmi.lag))""",
    )
    def _(s, d):
        """How well single lagged scores rank the planted arcs."""
        planted = s.createDataFrame(motif.truth, "source string, target string, lag int").withColumn("true", F.lit(True))
        rows = scores(s, motif).withColumn("cmi", F.round("cmi", 12)).join(F.broadcast(planted), EDGE, "left").withColumn("true", F.coalesce("true", F.lit(False)))
        ap = decide.average_precision(rows, "cmi", F.col("true"))
        return decide.roc_auc(rows, "cmi", F.col("true")).join(ap, "p").select("p", "n", F.round("auroc", 9).alias("auroc"), F.round("ap", 9).alias("ap"))


for _name, _motif in MOTIFS.items():
    _register(_name, _motif)


@query("score_edges", _cmi_sql(MOTIFS["chain"], STEPS) + "SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM (SELECT count(*) FILTER (WHERE f AND g) AS tp, count(*) FILTER (WHERE f AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT f) AS fn FROM (SELECT source, target, bool_or(round(cmi + corr, 9) > 0.01) AS f, (source, target) IN (('a', 'b'), ('b', 'c')) AS g FROM cmi GROUP BY source, target))")
def _(s, d):
    """Pairs of a chain whose corrected transfer entropy passes a hundredth of a bit at any lag, against those that were planted: the indirect one passes too."""
    found = scores(s, MOTIFS["chain"]).where(F.round("cmi_mm", 9) > 0.01).select("source", "target").distinct()
    return decide.score_edges(found, s.createDataFrame([(a, b) for a, b, _ in MOTIFS["chain"].truth], "source string, target string"))


def _find(name: str, max_lag: int, n: int) -> None:
    motif = MOTIFS[name]

    @query(f"infer_{name}", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {lag})" for a, b, lag in motif.truth) + ") v(source, target, lag)")
    def _(s, d):
        """The arcs that selection with pair search finds at a level of 0.002, low enough for no false one among the few dozen tests of all motifs to be expected; the SQL has those that were planted."""
        found = network.infer(motif.table(s, n), max_lag=max_lag, n_perm=499, alpha=0.002)
        return found.select("source", "target", F.explode("lags").alias("lag"))


for _name, _lag in (("xor_synergy", 2), ("or_gate", 2), ("asymmetric_interaction", 2), ("common_driver", 2), ("chain", 2)):
    _find(_name, _lag, 2000)


_SQL["planted"] = "planted AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{a}', '{b}', {k})" for n, m in MOTIFS.items() for a, b, k in m.truth) + ") v(motif, source, target, lag))"
_NEEDS["planted"] = []


def arcs(spark: SparkSession) -> DataFrame:
    """(motif, source, target, lag) of all planted arcs."""
    return spark.createDataFrame([(n, a, b, k) for n, m in MOTIFS.items() for a, b, k in m.truth], "motif string, source string, target string, lag int")


@query("hidden_drivers", "SELECT a.motif, a.source AS driver, a.target AS a, b.target AS b FROM planted a JOIN planted b ON a.motif = b.motif AND a.source = b.source AND a.target <> b.target WHERE NOT EXISTS (SELECT 1 FROM planted c WHERE c.motif = a.motif AND c.source = a.target AND c.target = b.target) AND NOT EXISTS (SELECT 1 FROM planted c WHERE c.motif = a.motif AND c.source = b.target AND c.target = a.target)", ("planted",))
def _(s, d):
    """Pairs that a hidden driver would confound: its children without an arc between them."""
    return decide.confounded(arcs(s), ["motif"])


_SQL["anc"] = "anc AS (SELECT DISTINCT motif, source, target FROM (WITH RECURSIVE c(motif, source, target) AS (SELECT motif, source, target FROM planted UNION SELECT c.motif, c.source, p.target FROM c JOIN planted p ON p.motif = c.motif AND p.source = c.target) SELECT * FROM c))"
_NEEDS["anc"] = ["planted"]
_SQL["node"] = "node AS (SELECT motif, source AS p FROM planted UNION SELECT motif, target FROM planted)"
_NEEDS["node"] = ["planted"]


@query(
    "relations",
    """SELECT a.motif, a.p AS z, b.p AS source, c.p AS target, CASE WHEN EXISTS (SELECT 1 FROM anc x WHERE x.motif = a.motif AND x.source = a.p AND x.target = b.p) AND EXISTS (SELECT 1 FROM anc x WHERE x.motif = a.motif AND x.source = a.p AND x.target = c.p) THEN 'confounded'
      WHEN EXISTS (SELECT 1 FROM anc x WHERE x.motif = a.motif AND x.source = b.p AND x.target = a.p) AND EXISTS (SELECT 1 FROM anc x WHERE x.motif = a.motif AND x.source = a.p AND x.target = c.p) THEN 'mediated' ELSE 'explained' END AS relation
    FROM node a JOIN node b ON a.motif = b.motif AND a.p <> b.p JOIN node c ON c.motif = a.motif AND c.p <> a.p AND c.p <> b.p""",
    ("anc", "node"),
)
def _(s, d):
    """How a third process stands to a source and a target in the planted networks."""
    planted = arcs(s)
    nodes = planted.select("motif", F.col("source").alias("p")).union(planted.select("motif", "target")).distinct()
    z, a, b = (nodes.withColumnRenamed("p", c) for c in ("z", "source", "target"))
    triples = z.join(a, "motif").where("z != source").join(b, "motif").where("target != z and target != source")
    return decide.relation(triples, decide.closure(planted, ["motif"]), ["motif"])


@query("components", "SELECT motif, p, least(p, coalesce(m, p)) AS root FROM node LEFT JOIN (SELECT motif, a, min(b) AS m FROM (WITH RECURSIVE e(motif, a, b) AS (SELECT motif, source, target FROM planted UNION SELECT motif, target, source FROM planted), c(motif, a, b) AS (SELECT motif, a, b FROM e UNION SELECT c.motif, c.a, e.b FROM c JOIN e ON e.motif = c.motif AND e.a = c.b) SELECT * FROM c) GROUP BY ALL) r USING (motif) WHERE r.a = p", ("node",))
def _(s, d):
    """The connected parts of the planted networks, each by its first process."""
    planted = arcs(s)
    both = planted.select("motif", "source", "target").union(planted.select("motif", F.col("target").alias("source"), F.col("source").alias("target")))
    reach = decide.closure(both, ["motif"])
    return reach.groupBy("motif", F.col("source").alias("p")).agg(F.min("target").alias("m")).select("motif", "p", F.least("p", "m").alias("root"))


@query("conditioning_sets", "SELECT DISTINCT a.motif, a.p AS i, b.p AS j, v.source AS process, v.lag FROM node a JOIN node b ON a.motif = b.motif AND a.p < b.p JOIN (SELECT motif, source, target, lag FROM planted UNION ALL SELECT motif, p, p, 1 FROM node) v ON v.motif = a.motif AND (v.target = a.p OR v.target = b.p)", ("node",))
def _(s, d):
    """The lagged variables that a pair is conditioned on: both pasts and all parents of either."""
    planted = arcs(s)
    nodes = planted.select("motif", F.col("source").alias("p")).union(planted.select("motif", "target")).distinct()
    variables = planted.select("motif", "target", F.col("source").alias("process"), "lag").union(nodes.select("motif", "p", "p", F.lit(1)))
    pairs = nodes.withColumnRenamed("p", "i").join(nodes.withColumnRenamed("p", "j"), "motif").where("i < j")
    each = pairs.withColumn("target", F.explode(F.array("i", "j")))
    return each.join(variables, ["motif", "target"]).select("motif", "i", "j", "process", "lag").distinct()


@query("source_sets", "SELECT a.motif, a.target, a.source AS first, b.source AS second, NULL::VARCHAR AS third FROM planted a JOIN planted b ON a.motif = b.motif AND a.target = b.target AND a.source < b.source UNION ALL SELECT a.motif, a.target, a.source, b.source, c.source FROM planted a JOIN planted b ON a.motif = b.motif AND a.target = b.target AND a.source < b.source JOIN planted c ON a.motif = c.motif AND a.target = c.target AND b.source < c.source", ("planted",))
def _(s, d):
    """All sets of two or three parents of a target."""
    parents = arcs(s).select("motif", "target", "source")
    a, b, c = (parents.withColumnRenamed("source", x) for x in ("first", "second", "third"))
    two = a.join(b, ["motif", "target"]).where("first < second")
    three = two.join(c, ["motif", "target"]).where("second < third")
    return two.withColumn("third", F.lit(None).cast("string")).unionByName(three)


@query("ring_graph", "SELECT ((t + k + 10) % 10)::BIGINT AS source, t AS target FROM (SELECT range AS t FROM range(10)) r, (VALUES (-2), (-1), (1)) v(k)")
def _(s, d):
    """Who drives whom on a ring of oscillators: the two behind and the one ahead."""
    return s.range(10).withColumnRenamed("id", "target").withColumn("k", F.explode(F.array(F.lit(-2), F.lit(-1), F.lit(1)))).select(F.pmod(F.col("target") + F.col("k"), F.lit(10)).alias("source"), "target")


_DRAW = "substr(md5(concat('3-arc-', CAST(a AS STRING), '-', CAST(b AS STRING))), 1, 8)"


@query("random_graph", f"SELECT a AS source, b AS target, (1 + ascii(substr(md5(concat('3-lag-', CAST(a AS STRING), '-', CAST(b AS STRING))), 1, 1)) % 5)::INT AS lag FROM (SELECT x.range AS a, y.range AS b FROM range(60) x, range(60) y) WHERE a <> b AND {_DRAW} < '{round(3 / 59 * 2**32):08x}'")
def _(s, d):
    """A digraph of 60 nodes with three arcs into each in the mean, and a lag from 1 to 5 for each arc."""
    n = s.range(60)
    pairs = n.withColumnRenamed("id", "a").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long")))).where("a != b")
    lag = F.expr("1 + ascii(substr(md5(concat('3-lag-', CAST(a AS STRING), '-', CAST(b AS STRING))), 1, 1)) % 5").cast("int")
    return pairs.where(F.expr(_DRAW) < f"{round(3 / 59 * 2**32):08x}").select(F.col("a").alias("source"), F.col("b").alias("target"), lag.alias("lag"))
