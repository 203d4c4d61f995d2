"""Registered queries and, under the same keys, the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagweave.functions.special import xlog2x
from lagweave.operators import align, decide, encode, info, kernels, network
from lagweave.sources import series
from lagweave.sources.tables import placed, table
from lagweave.streaming import hourly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Views shared by the SQL twins.
_SQL = {
    "raw": "raw AS (SELECT event_type AS process, floor(date_diff('second', (SELECT date_trunc('day', min(ts)::TIMESTAMP)::TIMESTAMP FROM events), ts::TIMESTAMP) / 3600)::BIGINT AS t, value FROM events)",
    "spine": "spine AS (SELECT process, t FROM (SELECT DISTINCT event_type AS process FROM events), (SELECT unnest(range(0, (SELECT floor(max(t) / 24)::BIGINT * 24 + 24 FROM raw))) AS t))",
    "hour": "hour AS (SELECT 0::BIGINT AS trial, s.t, s.process, coalesce(c.n, 0)::DOUBLE AS value FROM spine s LEFT JOIN (SELECT process, t, count(*) AS n FROM raw GROUP BY ALL) c USING (process, t))",
    "val": "val AS (SELECT 0::BIGINT AS trial, s.t, s.process, c.v AS value FROM spine s LEFT JOIN (SELECT process, t, avg(value) AS v FROM raw GROUP BY ALL) c USING (process, t))",
    "day": "day AS (SELECT 0::BIGINT AS trial, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::BIGINT AS t, v.process, sum(CASE v.process WHEN 'quantity' THEN l_quantity WHEN 'price' THEN l_extendedprice ELSE l_discount END) AS value FROM lineitem, (VALUES ('quantity'), ('price'), ('discount')) v(process) GROUP BY ALL)",
    "sym": "sym AS (SELECT trial, t, process, (value > level)::INT AS code FROM hour JOIN (SELECT process, quantile_cont(value, 0.5) AS level FROM hour GROUP BY 1) USING (process))",
    "pairs": "pairs AS (SELECT b.process AS source, a.process AS target, lg.lag, a.trial, a.t, a.code AS y, b.code AS x, w.code AS w FROM sym a JOIN sym w ON w.trial = a.trial AND w.process = a.process AND w.t = a.t - 1 JOIN (VALUES (1), (2), (3), (4), (5)) lg(lag) ON true JOIN sym b ON b.trial = a.trial AND b.t = a.t - lg.lag AND b.process <> a.process)",
    "cnt": "cnt AS (SELECT source, target, lag, y, x, w, count(*) AS n FROM pairs GROUP BY ALL)",
    "cmi": """cmi AS (SELECT source, target, lag, sum(n)::BIGINT AS "N",
      (sum(n * log2(n)) + sum(CASE WHEN rw = 1 THEN nw * log2(nw) ELSE 0 END) - sum(CASE WHEN ryw = 1 THEN nyw * log2(nyw) ELSE 0 END) - sum(CASE WHEN rxw = 1 THEN nxw * log2(nxw) ELSE 0 END)) / sum(n) AS cmi,
      (sum((ryw = 1)::INT) + sum((rxw = 1)::INT) - count(*) - sum((rw = 1)::INT)) / (2 * sum(n) * ln(2)) AS corr
      FROM (SELECT *, sum(n) OVER (PARTITION BY source, target, lag, w) AS nw, row_number() OVER (PARTITION BY source, target, lag, w) AS rw,
        sum(n) OVER (PARTITION BY source, target, lag, y, w) AS nyw, row_number() OVER (PARTITION BY source, target, lag, y, w) AS ryw,
        sum(n) OVER (PARTITION BY source, target, lag, x, w) AS nxw, row_number() OVER (PARTITION BY source, target, lag, x, w) AS rxw FROM cnt) GROUP BY ALL)""",
}
_NEEDS = {"hour": ["raw", "spine"], "val": ["raw", "spine"], "sym": ["hour"], "pairs": ["sym"], "cnt": ["pairs"], "cmi": ["cnt"]}


def _with(*views: str) -> str:
    order: list[str] = []

    def add(v: str) -> None:
        for x in _NEEDS.get(v, []):
            add(x)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return "WITH " + ",\n".join(_SQL[v] for v in order) + "\n"


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()) -> Callable:
    """Register a query with its SQL twin, which may use the shared views."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = (_with(*views) if views else "") + oracle
        return f

    return register


def ev_hour(spark: SparkSession, d: str) -> DataFrame:
    return series.binned(table(spark, d, "events"), F.count(F.lit(1)).cast("double"))


def ev_spikes(spark: SparkSession, d: str) -> DataFrame:
    return series.seconds(table(spark, d, "events")).select(F.col("event_type").alias("neuron"), F.col("s").cast("double").alias("ts"))


def ev_value(spark: SparkSession, d: str) -> DataFrame:
    return series.binned(table(spark, d, "events"), F.avg("value"), empty=None)


def li_day(spark: SparkSession, d: str, in_order: bool = False) -> DataFrame:
    """Daily sums. `in_order` adds the rows of a day one by one as the files have them, not in parts: days with the same sum in cents differ in their last bits by the order of adding, and an edge between them tells them apart. It costs a shuffle and a sort of all rows."""
    rows = table(spark, d, "lineitem")
    if in_order:
        rows = placed(rows)
    rows = rows.select(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("t"), "l_quantity", "l_extendedprice", "l_discount", *["place"] * in_order)
    if in_order:
        rows = rows.repartition("t").sortWithinPartitions("place")
    sums = rows.groupBy("t").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.sum("l_discount").alias("discount"))
    if in_order:
        sums = sums.repartition("t")  # an exchange that all readers of the sums share
    return sums.unpivot(["t"], ["quantity", "price", "discount"], "process", "value").select(F.lit(0).cast("long").alias("trial"), "t", "process", "value")


def ev_symbols(spark: SparkSession, d: str) -> DataFrame:
    return encode.threshold(ev_hour(spark, d), quantile=0.5)


def ev_pairs(spark: SparkSession, d: str, lags: tuple[int, ...] = (1,)) -> DataFrame:
    return align.pairs(ev_symbols(spark, d), list(lags))


EDGE = ["source", "target", "lag"]


@query("scan_events_binned", "SELECT trial, t, process, value FROM hour", ("hour",))
def _(s, d):
    return ev_hour(s, d)


@query("scan_events_mean", "SELECT trial, t, process, round(value, 6) AS value FROM val", ("val",))
def _(s, d):
    return ev_value(s, d).withColumn("value", F.round("value", 6))


@query("scan_daily_sums", "SELECT trial, t, process, round(value, 4) AS value FROM day", ("day",))
def _(s, d):
    return li_day(s, d).withColumn("value", F.round("value", 4))


@query(
    "spike_bin_dense",
    "WITH e AS (SELECT event_type AS neuron, date_diff('second', (SELECT date_trunc('day', min(ts)::TIMESTAMP)::TIMESTAMP FROM events), ts::TIMESTAMP) AS s FROM events) SELECT p.neuron AS process, b.t, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT neuron FROM e) p, (SELECT unnest(range(0, (SELECT greatest(ceil(max(s) / 600.0 + 1 - 1e-9), 1)::BIGINT FROM e))) AS t) b LEFT JOIN (SELECT neuron, floor(s / 600.0 + 1e-9)::BIGINT AS t, count(*) AS n FROM e GROUP BY ALL) c ON c.neuron = p.neuron AND c.t = b.t",
)
def _(s, d):
    """All events in bins of ten minutes."""
    return series.spike_bins(ev_spikes(s, d), 600.0)


@query(
    "gap_split",
    "SELECT trial, piece, t, size FROM (SELECT *, count(*) OVER (PARTITION BY trial, piece) AS size FROM (SELECT *, sum(bad) OVER (PARTITION BY trial ORDER BY t)::BIGINT AS piece FROM (SELECT trial, t, max((value IS NULL)::INT) AS bad FROM val GROUP BY ALL)) WHERE bad = 0) WHERE size >= 2",
    ("val",),
)
def _(s, d):
    return series.split_gaps(ev_value(s, d), 2)


@query(
    "interpolate_gaps",
    "SELECT trial, t, process, round(coalesce(value, v0 + (v1 - v0) * (t - t0) / (t1 - t0)), 6) AS value FROM (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(value IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1, first_value(value IGNORE NULLS) OVER a AS v1 FROM val WINDOW b AS (PARTITION BY trial, process ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY trial, process ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    ("val",),
)
def _(s, d):
    return series.interpolate(ev_value(s, d)).withColumn("value", F.round("value", 6))


@query("resample_blocks", "SELECT trial, floor(t / 4)::BIGINT AS t, process, CASE WHEN count(value) = 4 THEN round(avg(value), 6) END AS value FROM val GROUP BY trial, floor(t / 4), process HAVING count(*) = 4", ("val",))
def _(s, d):
    return series.block_means(ev_value(s, d), 4).withColumn("value", F.round("value", 6))


@query("encode_identity", "SELECT trial, t, process, (dense_rank() OVER (PARTITION BY process ORDER BY value) - 1)::INT AS code FROM hour", ("hour",))
def _(s, d):
    return encode.identity(ev_hour(s, d))


@query("encode_equal_frequency", "SELECT trial, t, process, len(list_filter(e, lambda q: q <= value))::INT AS code FROM day JOIN (SELECT process, quantile_cont(value, [0.25, 0.5, 0.75]) AS e FROM day GROUP BY 1) USING (process)", ("day",))
def _(s, d):
    return encode.equal_frequency(li_day(s, d, in_order=True), 4)


@query("encode_equal_width", "SELECT trial, t, process, ((a + (b - a) * 0.25 <= value)::INT + (a + (b - a) * 0.5 <= value)::INT + (a + (b - a) * 0.75 <= value)::INT) AS code FROM day JOIN (SELECT process, min(value) AS a, max(value) AS b FROM day GROUP BY 1) USING (process)", ("day",))
def _(s, d):
    return encode.equal_width(li_day(s, d), 4)


@query("encode_threshold", "SELECT trial, t, process, (value > l)::INT AS code FROM day JOIN (SELECT process, quantile_cont(value, 0.9) AS l FROM day GROUP BY 1) USING (process)", ("day",))
def _(s, d):
    return encode.threshold(li_day(s, d))


_ORD = """ord AS (SELECT trial, t, process, v0, v1, v2,
  9 * ((v1 < v0)::INT + (v2 < v0)::INT) + 3 * ((v0 <= v1)::INT + (v2 < v1)::INT) + ((v0 <= v2)::INT + (v1 <= v2)::INT) AS code
  FROM (SELECT *, lag(value, 2) OVER w AS v0, lag(value, 1) OVER w AS v1, value AS v2 FROM hour WINDOW w AS (PARTITION BY trial, process ORDER BY t)) WHERE v0 IS NOT NULL)"""
_SQL["ord"] = _ORD
_NEEDS["ord"] = ["hour"]


@query("encode_ordinal", "SELECT trial, t, process, code FROM ord", ("ord",))
def _(s, d):
    return encode.ordinal(ev_hour(s, d)).drop("weight")


@query(
    "weighted_permutation_entropy",
    "SELECT process, round(-sum(p * log2(p)) / log2(6), 6) AS wpe FROM (SELECT process, sum(v) / sum(sum(v)) OVER (PARTITION BY process) AS p FROM (SELECT process, code, ((v0 - m) ** 2 + (v1 - m) ** 2 + (v2 - m) ** 2) / 3 AS v FROM (SELECT *, (v0 + v1 + v2) / 3 AS m FROM ord)) GROUP BY process, code) WHERE p > 0 GROUP BY process",
    ("ord",),
)
def _(s, d):
    cells = encode.ordinal(ev_hour(s, d)).groupBy("process", "code").agg(F.sum("weight").alias("v"))
    p = F.col("v") / F.sum("v").over(Window.partitionBy("process"))
    return cells.select("process", p.alias("p")).where("p > 0").groupBy("process").agg(F.round(-F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(6)), 6).alias("wpe"))


@query("rank_average", "SELECT trial, t, process, round((rank() OVER (PARTITION BY process ORDER BY value) + (count(*) OVER (PARTITION BY process, value) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY process), 9) AS rank FROM hour", ("hour",))
def _(s, d):
    return encode.average_ranks(ev_hour(s, d)).withColumn("rank", F.round("rank", 9))


@query("rank_bins", "SELECT trial, t, process, least(floor(r * 4), 3)::INT AS code FROM (SELECT trial, t, process, (rank() OVER (PARTITION BY process ORDER BY value) + (count(*) OVER (PARTITION BY process, value) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY process) AS r FROM hour)", ("hour",))
def _(s, d):
    return encode.average_ranks(ev_hour(s, d)).select("trial", "t", "process", F.least(F.floor(F.col("rank") * 4), F.lit(3)).cast("int").alias("code"))


@query("screen_ties", "SELECT process, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS missing, round(avg((value = past)::INT), 9) AS ties FROM (SELECT *, lag(value) OVER (PARTITION BY trial, process ORDER BY t) AS past FROM hour) GROUP BY 1", ("hour",))
def _(s, d):
    rows = ev_hour(s, d).withColumn("past", F.lag("value").over(Window.partitionBy("trial", "process").orderBy("t")))
    return rows.groupBy("process").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.round(F.avg((F.col("value") == F.col("past")).cast("int")), 9).alias("ties"))


@query("align_lags", "SELECT * FROM pairs", ("pairs",))
def _(s, d):
    return ev_pairs(s, d, (1, 2, 3, 4, 5))


@query("common_sample_set", "SELECT source, target, lag, count(*) AS n, min(t) AS first FROM pairs WHERE t >= 5 GROUP BY ALL", ("pairs",))
def _(s, d):
    return align.common_sample(ev_pairs(s, d, (1, 2, 3, 4, 5)), 5).groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))


@query("split_time", "SELECT trial, part, t - CASE part WHEN 1 THEN h ELSE 0 END AS t, process, code FROM (SELECT *, (t >= h)::INT AS part FROM sym, (SELECT floor((max(t) + 1) / 2)::BIGINT AS h FROM sym))", ("sym",))
def _(s, d):
    return align.split_time(ev_symbols(s, d), 0.5)


@query("regime_windows", "SELECT trial, floor(t / 100)::BIGINT AS \"window\", t % 100 AS t, process, code FROM sym WHERE t < (SELECT floor((max(t) + 1) / 100) * 100 FROM sym)", ("sym",))
def _(s, d):
    return align.windows(ev_symbols(s, d), 100)


@query("count_table", "SELECT * FROM cnt", ("cnt",))
def _(s, d):
    return info.counts(ev_pairs(s, d, (1, 2, 3, 4, 5)), EDGE, ["y", "x", "w"])


@query("cmi_plugin", 'SELECT source, target, lag, "N", round(cmi, 9) AS cmi FROM cmi', ("cmi",))
def _(s, d):
    return info.conditional_mi(info.counts(ev_pairs(s, d, (1, 2, 3, 4, 5)), EDGE, ["y", "x", "w"]), EDGE).select(*EDGE, "N", F.round("cmi", 9).alias("cmi"))


@query("cmi_miller_madow", "SELECT source, target, lag, round(cmi + corr, 9) AS cmi FROM cmi", ("cmi",))
def _(s, d):
    return info.conditional_mi(info.counts(ev_pairs(s, d, (1, 2, 3, 4, 5)), EDGE, ["y", "x", "w"]), EDGE).select(*EDGE, F.round("cmi_mm", 9).alias("cmi"))


@query("te_pairs", "SELECT source, target, round(cmi, 9) AS te FROM cmi WHERE lag = 1", ("cmi",))
def te_pairs(s, d):
    return info.conditional_mi(info.counts(ev_pairs(s, d), EDGE, ["y", "x", "w"]), EDGE).select("source", "target", F.round("cmi", 9).alias("te"))


@query("te_lag_grid", "SELECT target, source, max_by(lag, (round(cmi, 12), -lag)) AS lag, round(max(cmi), 9) AS te FROM cmi GROUP BY ALL", ("cmi",))
def _(s, d):
    grid = info.conditional_mi(info.counts(ev_pairs(s, d, (1, 2, 3, 4, 5)), EDGE, ["y", "x", "w"]), EDGE)
    return grid.groupBy("source", "target").agg(F.max_by("lag", F.struct(F.round("cmi", 12), -F.col("lag"))).alias("lag"), F.round(F.max("cmi"), 9).alias("te"))


@query("pair_pool_topk", "SELECT target, source, lag FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(cmi, 12) DESC, lag, source) AS r FROM cmi) WHERE r <= 3", ("cmi",))
def _(s, d):
    grid = info.conditional_mi(info.counts(ev_pairs(s, d, (1, 2, 3, 4, 5)), EDGE, ["y", "x", "w"]), EDGE)
    return grid.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round("cmi", 12)), "lag", "source"))).where("r <= 3").select("target", "source", "lag")


_MI = "round((sum(n * log2(n)) - sum(CASE WHEN ra = 1 THEN na * log2(na) ELSE 0 END) - sum(CASE WHEN rb = 1 THEN nb * log2(nb) ELSE 0 END)) / sum(n) + log2(sum(n)), 9)"


@query(
    "tdmi_pairs",
    f"SELECT source, target, {_MI} AS tdmi FROM (SELECT *, sum(n) OVER (PARTITION BY source, target, y) AS na, row_number() OVER (PARTITION BY source, target, y) AS ra, sum(n) OVER (PARTITION BY source, target, x) AS nb, row_number() OVER (PARTITION BY source, target, x) AS rb FROM (SELECT source, target, y, x, sum(n) AS n FROM cnt WHERE lag = 1 GROUP BY ALL)) GROUP BY ALL",
    ("cnt",),
)
def _(s, d):
    return info.conditional_mi(info.counts(ev_pairs(s, d), EDGE, ["y", "x"]), EDGE, w=[]).select("source", "target", F.round("cmi", 9).alias("tdmi"))


@query(
    "ais_nodes",
    f"SELECT process, {_MI} AS ais FROM (SELECT *, sum(n) OVER (PARTITION BY process, y) AS na, row_number() OVER (PARTITION BY process, y) AS ra, sum(n) OVER (PARTITION BY process, x) AS nb, row_number() OVER (PARTITION BY process, x) AS rb FROM (SELECT a.process, a.code AS y, b.code AS x, count(*) AS n FROM sym a JOIN sym b ON a.trial = b.trial AND a.process = b.process AND b.t = a.t - 1 GROUP BY ALL)) GROUP BY ALL",
    ("sym",),
)
def _(s, d):
    rows = ev_symbols(s, d).select("process", F.col("code").alias("y"), F.lag("code").over(Window.partitionBy("trial", "process").orderBy("t")).alias("x")).where("x is not null")
    return info.conditional_mi(info.counts(rows, ["process"], ["y", "x"]), ["process"], w=[]).select("process", F.round("cmi", 9).alias("ais"))


@query(
    "entropy_estimators",
    """SELECT process, "N", "K", round((ln("N") - s / "N") / ln(2), 8) AS plugin, round((ln("N") - s / "N" + ("K" - 1) / (2 * "N")) / ln(2), 8) AS miller_madow, round(z / ln(2), 8) AS zhang, round((ln("N") - g / "N") / ln(2), 8) AS grassberger
    FROM (SELECT process, max(nn)::BIGINT AS "N", count(*) AS "K", sum(n * ln(n)) AS s, sum(n / nn * list_sum(list_transform(range(n, nn::BIGINT), lambda k: 1.0 / k))) AS z,
      sum(n * (-0.5772156649015329 - ln(2) + coalesce(list_sum(list_transform(range(0, n // 2), lambda k: 2.0 / (2 * k + 1))), 0))) AS g
      FROM (SELECT process, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY process) AS nn FROM hour GROUP BY process, value) GROUP BY process)""",
    ("hour",),
)
def _(s, d):
    cells = ev_hour(s, d).groupBy("process", "value").agg(F.count(F.lit(1)).alias("n"))
    out = info.entropies(cells, ["process"])
    return out.select("process", "N", "K", *[F.round(c, 8).alias(c) for c in ("plugin", "miller_madow", "zhang", "grassberger")])


@query(
    "entropy_chao_wang_jost",
    """SELECT process, round((z + CASE WHEN f1 > 0 AND a < 1 THEN f1 / nn * list_sum(list_transform(range(0, 20000), lambda j: pow(1 - a, j + 1) / (nn + j))) ELSE 0 END) / ln(2), 6) AS h
    FROM (SELECT *, CASE WHEN f2 > 0 THEN 2 * f2 / ((nn - 1) * f1 + 2 * f2) WHEN f1 > 0 THEN 2 / ((nn - 1) * (f1 - 1) + 2) ELSE 1 END AS a
      FROM (SELECT process, max(nn) AS nn, count(*) FILTER (WHERE n = 1) AS f1, count(*) FILTER (WHERE n = 2) AS f2, sum(n / nn * list_sum(list_transform(range(n, nn::BIGINT), lambda k: 1.0 / k))) AS z
        FROM (SELECT process, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY process) AS nn FROM hour GROUP BY process, value) GROUP BY process))""",
    ("hour",),
)
def _(s, d):
    cells = ev_hour(s, d).groupBy("process", "value").agg(F.count(F.lit(1)).alias("n"))
    return info.entropies(cells, ["process"]).select("process", F.round("chao_wang_jost", 6).alias("h"))


@query(
    "g_stat",
    "SELECT source, target, round(2 * sum(n) * ln(2) * (" + _MI.removeprefix("round(").removesuffix(", 9)") + "), 5) AS g, ((count(DISTINCT y) - 1) * (count(DISTINCT x) - 1))::BIGINT AS dof FROM (SELECT *, sum(n) OVER (PARTITION BY source, target, y) AS na, row_number() OVER (PARTITION BY source, target, y) AS ra, sum(n) OVER (PARTITION BY source, target, x) AS nb, row_number() OVER (PARTITION BY source, target, x) AS rb FROM (SELECT source, target, y, x, sum(n) AS n FROM cnt WHERE lag = 1 GROUP BY ALL)) GROUP BY ALL",
    ("cnt",),
)
def _(s, d):
    table_ = info.counts(ev_pairs(s, d), EDGE, ["y", "x"])
    dof = table_.groupBy(*EDGE).agg(((F.count_distinct("y") - 1) * (F.count_distinct("x") - 1)).alias("dof"))
    g = info.conditional_mi(table_, EDGE, w=[])
    return g.join(dof, EDGE).select("source", "target", F.round(2 * F.col("N") * info.LN2 * F.col("cmi"), 5).alias("g"), "dof")


@query("channel_matrix", "SELECT source, target, x, y, round(n / sum(n) OVER (PARTITION BY source, target, x), 9) AS q FROM (SELECT source, target, x, y, sum(n) AS n FROM cnt WHERE lag = 1 GROUP BY ALL)", ("cnt",))
def _(s, d):
    rows = info.counts(ev_pairs(s, d), EDGE, ["y", "x"])
    return rows.select("source", "target", "x", "y", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*EDGE, "x")), 9).alias("q"))


_TYPES = ("click", "error", "purchase", "signup", "view")
_SQL["wide"] = "wide AS (SELECT t, " + ", ".join(f"max(code) FILTER (WHERE process = '{p}') AS {p}" for p in _TYPES) + " FROM sym GROUP BY t)"
_NEEDS["wide"] = ["sym"]
_H = "(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM wide GROUP BY {}))"


@query(
    "oinfo_grouping_sets",
    "SELECT round(3 * " + _H.format(", ".join(_TYPES)) + " + " + " + ".join(_H.format(p) + " - " + _H.format(", ".join(q for q in _TYPES if q != p)) for p in _TYPES) + ", 9) AS omega",
    ("wide",),
)
def _(s, d):
    wide = ev_symbols(s, d).groupBy("t").pivot("process", list(_TYPES)).agg(F.max("code"))
    sets = {"all": list(_TYPES)} | {f"one_{p}": [p] for p in _TYPES} | {f"not_{p}": [q for q in _TYPES if q != p] for p in _TYPES}
    cells = info.marginals(wide.groupBy(*_TYPES).agg(F.count(F.lit(1)).alias("n")), [], sets)
    h = cells.groupBy("part").agg((F.log2(F.sum("n")) - F.sum(xlog2x(F.col("n").cast("double"))) / F.sum("n")).alias("h"))
    weight = F.when(F.col("part") == "all", len(_TYPES) - 2).when(F.col("part").startswith("one_"), 1).otherwise(-1)
    return h.agg(F.round(F.sum(weight * F.col("h")), 9).alias("omega"))


_SHIFT = "(SELECT source, target, k, (sum(n * log2(n)) - sum(CASE WHEN ra = 1 THEN na * log2(na) ELSE 0 END) - sum(CASE WHEN rb = 1 THEN nb * log2(nb) ELSE 0 END)) / sum(n) + log2(sum(n)) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY source, target, k, y) AS na, row_number() OVER (PARTITION BY source, target, k, y) AS ra, sum(n) OVER (PARTITION BY source, target, k, x) AS nb, row_number() OVER (PARTITION BY source, target, k, x) AS rb FROM (SELECT b.process AS source, a.process AS target, k.k, a.code AS y, b.code AS x, count(*) AS n FROM sym a JOIN (SELECT unnest(range(0, 20)) AS k) k ON true JOIN sym b ON b.process <> a.process AND b.t = (a.t + (SELECT max(t) FROM sym) + 36 * k.k) % (SELECT max(t) + 1 FROM sym) GROUP BY ALL)) GROUP BY ALL)"


def shift_null(spark: SparkSession, d: str, shifts: int = 20, step: int = 36) -> DataFrame:
    """Time-delayed mutual information of all pairs against circular shifts of the source: the observed value, and the share of shifts that reach it."""
    sym = ev_symbols(spark, d)
    moved = sym.select(F.col("process").alias("source"), F.col("code").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))).alias("k"), "t")
    steps = sym.agg((F.max("t") + 1).alias("steps"))
    moved = moved.crossJoin(F.broadcast(steps)).withColumn("t", F.pmod(F.col("t") + 1 - step * F.col("k"), F.col("steps"))).drop("steps")
    rows = sym.select(F.col("process").alias("target"), F.col("code").alias("y"), "t").join(moved, "t").where("source != target")
    keys = ["source", "target", "k"]
    mi = info.conditional_mi(info.counts(rows, keys, ["y", "x"]), keys, w=[])
    both = mi.groupBy("source", "target").agg(F.max(F.when(F.col("k") == 0, F.col("cmi"))).alias("tdmi"), F.array_agg(F.when(F.col("k") > 0, F.col("cmi"))).alias("null"))
    p = (1 + F.size(F.filter("null", lambda v: v >= F.col("tdmi") - 1e-9))) / shifts
    return both.select("source", "target", F.round("tdmi", 9).alias("tdmi"), F.round(p, 9).alias("p"))


_SQL["shift"] = f"shift AS (SELECT source, target, round(max(mi) FILTER (WHERE k = 0), 9) AS tdmi, round((1 + count(*) FILTER (WHERE k > 0 AND mi >= m0 - 1e-9)) / 20, 9) AS p FROM (SELECT *, max(CASE WHEN k = 0 THEN mi END) OVER (PARTITION BY source, target) AS m0 FROM {_SHIFT}) GROUP BY source, target)"
_NEEDS["shift"] = ["sym"]


@query("shift_null_pvalue", "SELECT * FROM shift", ("shift",))
def _(s, d):
    return shift_null(s, d)


_ADJ = "SELECT source, target, p, round(least(1, min(p * m * {c} / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM (SELECT source, target, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, source, target) AS r FROM (SELECT DISTINCT p, source, target FROM shift))"


@query("bh_adjust", _ADJ.format(c="1"), ("shift",))
def _(s, d):
    return decide.adjust(shift_null(s, d).select("source", "target", "p")).withColumn("q", F.round("q", 9))


@query("by_adjust", _ADJ.format(c="list_sum(list_transform(range(1, m + 1), lambda k: 1.0 / k))"), ("shift",))
def _(s, d):
    return decide.adjust(shift_null(s, d).select("source", "target", "p"), dependent=True).withColumn("q", F.round("q", 9))


@query("ebh_select", "SELECT source, target, e, r <= max(CASE WHEN e >= m / (0.5 * r) THEN r ELSE 0 END) OVER () AS selected FROM (SELECT source, target, round(1 / p, 9) AS e, count(*) OVER () AS m, row_number() OVER (ORDER BY 1 / p DESC, source, target) AS r FROM shift)", ("shift",))
def _(s, d):
    return decide.e_bh(shift_null(s, d).select("source", "target", F.round(1 / F.col("p"), 9).alias("e")), alpha=0.5, ties=["source", "target"])


@query(
    "acf_delay",
    "SELECT process, coalesce(min(CASE WHEN r < exp(-1) THEN lag END), 20)::INT AS delay FROM (SELECT a.process, g.lag, sum((a.value - m.m) * (b.value - m.m)) / max(m.v) AS r FROM hour a JOIN (SELECT process, avg(value) AS m, sum((value - a) ** 2) AS v FROM (SELECT *, avg(value) OVER (PARTITION BY process) AS a FROM hour) GROUP BY process) m USING (process) JOIN (SELECT unnest(range(1, 21)) AS lag) g ON true JOIN hour b ON b.process = a.process AND b.t = a.t - g.lag GROUP BY ALL) GROUP BY process",
    ("hour",),
)
def _(s, d):
    x = ev_hour(s, d)
    centred = x.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy("process")))
    by = Window.partitionBy("trial", "process").orderBy("t")
    lags = centred.select("process", "c", *[F.lag("c", k).over(by).alias(f"l{k}") for k in range(1, 21)])
    r = lags.groupBy("process").agg(*[(F.sum(F.col("c") * F.col(f"l{k}")) / F.sum(F.col("c") ** 2)).alias(f"r{k}") for k in range(1, 21)])
    return r.select("process", F.coalesce(*[F.when(F.col(f"r{k}") < F.exp(F.lit(-1.0)), F.lit(k)) for k in range(1, 21)], F.lit(20)).alias("delay"))


@query(
    "te_gaussian",
    "SELECT source, target, round(-0.5 * log2(1 - ((ryx - ryw * rxw) / sqrt((1 - ryw ** 2) * (1 - rxw ** 2))) ** 2), 9) AS te FROM (SELECT b.process AS source, a.process AS target, corr(a.value, b.value) AS ryx, corr(a.value, w.value) AS ryw, corr(b.value, w.value) AS rxw FROM hour a JOIN hour w ON w.process = a.process AND w.t = a.t - 1 JOIN hour b ON b.t = a.t - 1 AND b.process <> a.process GROUP BY ALL)",
    ("hour",),
)
def _(s, d):
    rows = align.pairs(ev_hour(s, d).withColumnRenamed("value", "code"), [1])
    r = rows.groupBy("source", "target").agg(F.corr("y", "x").alias("ryx"), F.corr("y", "w").alias("ryw"), F.corr("x", "w").alias("rxw"))
    partial = (F.col("ryx") - F.col("ryw") * F.col("rxw")) / F.sqrt((1 - F.col("ryw") ** 2) * (1 - F.col("rxw") ** 2))
    return r.select("source", "target", F.round(-0.5 * F.log2(1 - partial**2), 9).alias("te"))


@query("union_edges", "SELECT source, target, sum((lag = 1)::INT) > 0 AS first, sum((lag = 2)::INT) > 0 AS second FROM cmi WHERE lag <= 2 AND round(cmi, 9) > 0.0005 GROUP BY ALL", ("cmi",))
def _(s, d):
    grid = info.conditional_mi(info.counts(ev_pairs(s, d, (1, 2)), EDGE, ["y", "x", "w"]), EDGE).where(F.round("cmi", 9) > 0.0005)
    one, two = (grid.where(F.col("lag") == k).select("source", "target", F.lit(True).alias(n)) for k, n in ((1, "first"), (2, "second")))
    return one.join(two, ["source", "target"], "full_outer").select("source", "target", F.coalesce("first", F.lit(False)).alias("first"), F.coalesce("second", F.lit(False)).alias("second"))


@query(
    "window_features",
    f"SELECT \"window\", source, target, {_MI} AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY \"window\", source, target, y) AS na, row_number() OVER (PARTITION BY \"window\", source, target, y) AS ra, sum(n) OVER (PARTITION BY \"window\", source, target, x) AS nb, row_number() OVER (PARTITION BY \"window\", source, target, x) AS rb FROM (SELECT floor(a.t / 100)::BIGINT AS \"window\", b.process AS source, a.process AS target, a.code AS y, b.code AS x, count(*) AS n FROM sym a JOIN sym b ON b.process <> a.process AND b.t = a.t - 1 AND floor(b.t / 100) = floor(a.t / 100) WHERE a.t < (SELECT floor((max(t) + 1) / 100) * 100 FROM sym) GROUP BY ALL)) GROUP BY ALL",
    ("sym",),
)
def _(s, d):
    w = align.windows(ev_symbols(s, d), 100).select(F.col("window").alias("trial"), "t", "process", "code")
    a = w.select("trial", "t", F.col("process").alias("target"), F.col("code").alias("y"))
    b = w.select("trial", (F.col("t") + 1).alias("t"), F.col("process").alias("source"), F.col("code").alias("x"))
    rows = a.join(b, ["trial", "t"]).where("source != target")
    keys = ["trial", "source", "target"]
    return info.conditional_mi(info.counts(rows, keys, ["y", "x"]), keys, w=[]).select(F.col("trial").alias("window"), "source", "target", F.round("cmi", 9).alias("mi"))


@query(
    "fold_scores",
    "SELECT process, round(1 - sum(l) / sum(l0), 9) AS r FROM (SELECT v.process, -ln((coalesce(c.n, 0) + 0.5) / (coalesce(cx.n, 0) + 1)) AS l, -ln((cy.n + 0.5) / (ct.n + 1)) AS l0 FROM (SELECT a.process, a.t, a.code AS y, b.code AS x, floor(a.t / 144) AS f FROM sym a JOIN sym b ON a.process = b.process AND b.t = a.t - 1) v, LATERAL (SELECT count(*) AS n FROM (SELECT a.process, a.code AS y, b.code AS x, floor(a.t / 144) AS f FROM sym a JOIN sym b ON a.process = b.process AND b.t = a.t - 1) u WHERE u.process = v.process AND u.f <> v.f AND u.y = v.y AND u.x = v.x) c, LATERAL (SELECT count(*) AS n FROM (SELECT a.process, b.code AS x, floor(a.t / 144) AS f FROM sym a JOIN sym b ON a.process = b.process AND b.t = a.t - 1) u WHERE u.process = v.process AND u.f <> v.f AND u.x = v.x) cx, LATERAL (SELECT count(*) AS n FROM (SELECT a.process, a.code AS y, floor(a.t / 144) AS f FROM sym a WHERE a.t > 0) u WHERE u.process = v.process AND u.f <> v.f AND u.y = v.y) cy, LATERAL (SELECT count(*) AS n FROM (SELECT a.process, floor(a.t / 144) AS f FROM sym a WHERE a.t > 0) u WHERE u.process = v.process AND u.f <> v.f) ct) GROUP BY process",
    ("sym",),
)
def _(s, d):
    """Blocked cross-validation: log loss of the next symbol given the last, against the marginal's, by counts outside the fold (Krichevsky-Trofimov)."""
    rows = ev_symbols(s, d).withColumn("x", F.lag("code").over(Window.partitionBy("trial", "process").orderBy("t"))).where("x is not null").select("process", F.col("code").alias("y"), "x", F.floor(F.col("t") / 144).alias("f"))
    cells = rows.groupBy("process", "f", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("process", *c))
    out = cells.select("process", "n", (over("y", "x") - over("f", "y", "x")).alias("c"), (over("x") - over("f", "x")).alias("cx"), (over("y") - over("f", "y")).alias("cy"), (over() - over("f")).alias("ct"))
    loss = -F.log((F.col("c") + 0.5) / (F.col("cx") + 1)) * F.col("n")
    base = -F.log((F.col("cy") + 0.5) / (F.col("ct") + 1)) * F.col("n")
    return out.groupBy("process").agg(F.round(1 - F.sum(loss) / F.sum(base), 9).alias("r"))


@query(
    "dag_closure",
    "SELECT DISTINCT a AS source, b AS target FROM (WITH RECURSIVE c(a, b) AS (SELECT n_regionkey, n_nationkey FROM nation WHERE n_regionkey < n_nationkey UNION SELECT c.a, n.n_nationkey FROM c JOIN nation n ON n.n_regionkey = c.b AND n.n_regionkey < n.n_nationkey) SELECT a, b FROM c)",
)
def _(s, d):
    """Transitive closure of an acyclic relation by repeated squaring, until no arc is added."""
    arcs = table(s, d, "nation").where("n_regionkey < n_nationkey").select(F.col("n_regionkey").alias("source"), F.col("n_nationkey").alias("target")).distinct()
    return decide.closure(arcs)


@query("stream_hourly_counts", "SELECT (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return hourly.windowed_counts(table(s, d, "events")).select(F.floor(F.col("start").cast("long") / 3600).alias("hour"), "event_type", "n")


# Kernels below have no SQL twin; tests hold them against known answers.


@query("edge_permutation_tests")
def _(s, d):
    return decide.adjust(network.edge_tests(ev_pairs(s, d)))


@query("infer_network")
def _(s, d):
    return network.infer(ev_symbols(s, d))


@query("ksg_nodes")
def _(s, d):
    """Nearest-neighbour information that each process's last value has about the target's next, its own last value given."""

    def kernel(m, names, target):
        m = m.astype(float) + 1e-10 * np.random.default_rng(0).normal(size=m.shape)
        m = (m - m.mean(0)) / m.std(0)
        return [{"source": names[p], "target": names[target], "cmi": kernels.ksg(m[1:, target], m[:-1, p], m[:-1, target])} for p in range(len(names)) if p != target]

    return network.per_target(ev_hour(s, d), kernel, "source string, target string, cmi double", "value")


@query("granger_var")
def _(s, d):
    def kernel(m, names, target):
        return [dict(zip(("source", "target", "te", "f"), (names[p], names[target], *kernels.granger(m, target, p)), strict=True)) for p in range(len(names)) if p != target]

    return network.per_target(ev_hour(s, d), kernel, "source string, target string, te double, f double", "value")


@query("coherence_pairs")
def _(s, d):
    def kernel(m, names, target):
        out = []
        for p in range(target):
            f, c = kernels.coherence(m[:, p], m[:, target])
            out += [{"a": names[p], "b": names[target], "frequency": float(x), "coherence": float(v)} for x, v in zip(f, c, strict=True)]
        return out

    return network.per_target(ev_hour(s, d), kernel, "a string, b string, frequency double, coherence double", "value")


@query("channel_capacity")
def _(s, d):
    def run(f):
        q = f.pivot_table(index="x", columns="y", values="n", fill_value=0, aggfunc="sum").to_numpy(float)
        return pd.DataFrame({"source": [f["source"].iloc[0]], "target": [f["target"].iloc[0]], "capacity": [kernels.capacity(q / q.sum(1, keepdims=True))]})

    return info.counts(ev_pairs(s, d), EDGE, ["y", "x"]).groupBy("source", "target").applyInPandas(run, "source string, target string, capacity double")
