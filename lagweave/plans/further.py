"""Queries of curves, multi-information, score matrices and running tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagweave.operators import curves, info
from lagweave.plans.catalogue import _NEEDS, _SQL, ORACLES, QUERIES, ev_hour, ev_symbols, query
from lagweave.sources import networks
from lagweave.streaming import running

LONGEST = 8


def _words(k: int) -> str:
    parts = ["code::VARCHAR", *[f"lag(code, {j}) OVER w" for j in range(1, k)]]
    return f"SELECT process, {k} AS x, concat_ws(' ', {', '.join(parts)}) AS word, row_number() OVER w AS r FROM sym WINDOW w AS (PARTITION BY trial, process ORDER BY t)"


_SQL["curve"] = "curve AS (SELECT process, x::DOUBLE AS x, log2(sum(n)) - sum(n * log2(n)) / sum(n) + (count(*) - 1) / (2 * sum(n) * ln(2)) AS y FROM (SELECT process, x, word, count(*) AS n FROM (" + " UNION ALL ".join(map(_words, range(1, LONGEST + 1))) + ") WHERE r >= x GROUP BY ALL) GROUP BY process, x HAVING x <= 3 OR count(*) <= sum(n) / 5)"
_SQL["stretch"] = """cut AS (SELECT a.process, a.x AS start, b.x AS stop, regr_slope(p.y, p.x) AS slope, regr_intercept(p.y, p.x) AS intercept, max(abs(p.y)) AS top FROM curve a JOIN curve b ON a.process = b.process AND a.x < b.x JOIN curve p ON p.process = a.process AND p.x BETWEEN a.x AND b.x GROUP BY ALL HAVING count(*) >= 3),
stretch AS (SELECT c.process, start, stop, slope, intercept, (stop - start) * sqrt(1 + slope ** 2) / (sqrt(avg((p.y - intercept - slope * p.x) ** 2)) + 1e-12 * greatest(1, top)) ** 2 AS weight FROM cut c JOIN curve p ON p.process = c.process AND p.x BETWEEN start AND stop GROUP BY c.process, start, stop, slope, intercept, top),
binned AS (SELECT *, least(floor((slope - min(slope) OVER w) / (max(slope) OVER w - min(slope) OVER w) * 50), 49)::INT AS bin FROM stretch WINDOW w AS (PARTITION BY process)),
mode AS (SELECT process, max_by(bin, (w, -bin)) AS bin FROM (SELECT process, bin, sum(weight) AS w FROM binned GROUP BY ALL) GROUP BY process)"""
_NEEDS |= {"curve": ["sym"], "stretch": ["curve"]}


def _quantile(value: str, near: bool, q: float) -> str:
    rows = "binned JOIN mode USING (process, bin)" if near else "binned"
    share = f"sum(weight) OVER (PARTITION BY process ORDER BY {value}, weight, start, stop ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY process)"
    steps = f"SELECT process, {value} AS v, share, lag(share) OVER w AS b, lag({value}) OVER w AS l FROM (SELECT *, {share} AS share FROM {rows}) WINDOW w AS (PARTITION BY process ORDER BY {value}, weight, start, stop)"
    return f"(SELECT process, min_by(coalesce(l + ({q} - b) / (share - b) * (v - l), v), (share, v)) AS q FROM ({steps}) WHERE share >= {q} GROUP BY process)"


@query("block_entropy_curve", "SELECT process, x, round(y, 9) AS y FROM curve", ("curve",))
def _(s, d):
    return curves.block_entropy_curve(ev_symbols(s, d), LONGEST).withColumn("y", F.round("y", 9))


@query(
    "block_entropy_scaling",
    "SELECT process, n AS fits, round(a.q, 6) AS slope, round(b.q, 6) AS intercept, round(c.q, 6) AS start, round(e.q, 6) AS stop, round(f.q, 6) AS slope_low, round(g.q, 6) AS slope_high FROM (SELECT process, count(*) AS n FROM stretch GROUP BY 1) JOIN "
    + " JOIN ".join(f"{_quantile(v, near, q)} {name} USING (process)" for name, v, near, q in (("a", "slope", True, 0.5), ("b", "intercept", True, 0.5), ("c", "start", True, 0.5), ("e", "stop", True, 0.5), ("f", "slope", False, 0.25), ("g", "slope", False, 0.75))),
    ("stretch",),
)
def _(s, d):
    """Entropy rate (slope) and excess entropy (intercept) of each process."""
    out = curves.scaling_region(curves.block_entropy_curve(ev_symbols(s, d), LONGEST), ["process"])
    return out.select("process", "fits", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "start", "stop", "slope_low", "slope_high")])


@query("permutation_entropy", "SELECT process, sum(n)::BIGINT AS \"N\", round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS h FROM (SELECT process, code, count(*) AS n FROM ord GROUP BY ALL) GROUP BY process", ("ord",))
def _(s, d):
    cells = QUERIES["encode_ordinal"](s, d).groupBy("process", "code").agg(F.count(F.lit(1)).alias("n"))
    return info.entropies(cells, ["process"]).select("process", "N", F.round("plugin", 9).alias("h"))


@query(
    "stationarity",
    """SELECT process, round(greatest(2 * sum(n * ln(n * total / row_n / col_n)), 0), 6) AS g, ((count(DISTINCT segment) - 1) * (count(DISTINCT pattern) - 1))::BIGINT AS dof FROM (SELECT *, sum(n) OVER (PARTITION BY process) AS total, sum(n) OVER (PARTITION BY process, segment) AS row_n, sum(n) OVER (PARTITION BY process, pattern) AS col_n
    FROM (SELECT process, k // size AS segment, 4 * (a <= b)::INT + 2 * (b <= c)::INT + (a <= c)::INT AS pattern, count(*) AS n FROM (SELECT process, row_number() OVER w - 1 AS k, (count(*) OVER (PARTITION BY process)) // 4 AS size, value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c FROM hour WINDOW w AS (PARTITION BY process ORDER BY t)) WHERE k // size < 4 AND k % size % 3 = 0 AND k % size + 2 < size GROUP BY ALL)) GROUP BY process""",
    ("hour",),
)
def _(s, d):
    return curves.stationarity(ev_hour(s, d)).select("process", F.round("g", 6).alias("g"), "dof")


def _multi_sql() -> str:
    """A row for each cell of each marginal with its signs in the three measures."""
    signs = {"an": (1, 0, 1), "bn": (1, 0, 1), "cn": (1, 0, 1), "an, bn": (0, 1, -1), "an, cn": (0, 1, -1), "bn, cn": (0, 1, -1), "an, bn, cn": (-1, -2, 1)}
    rows = " UNION ALL ".join(f"SELECT a, b, c, {t} AS t, {u} AS u, {v} AS v, count(*) AS n FROM tri GROUP BY a, b, c, {m}" for m, (t, u, v) in signs.items())
    total = "max(total)"
    measure = lambda k, c, name: f"round({k} * log2({total}) - sum({c} * n * log2(n)) / {total}, 9) AS {name}"
    return f"SELECT a, b, c, {total}::BIGINT AS \"N\", {measure(2, 't', 'total_correlation')}, {measure(1, 'u', 'dual_total_correlation')}, {measure(1, 'v', 'coinformation')} FROM ({rows}) JOIN (SELECT a, b, c, count(*) AS total FROM tri GROUP BY ALL) USING (a, b, c) GROUP BY a, b, c"


_SQL["tri_now"] = "tri AS (SELECT a.process AS a, b.process AS b, c.process AS c, a.code AS an, b.code AS bn, c.code AS cn FROM sym a JOIN sym b ON a.trial = b.trial AND a.t = b.t AND a.process < b.process JOIN sym c ON a.trial = c.trial AND a.t = c.t AND b.process < c.process)"
_NEEDS["tri_now"] = ["sym"]


@query("multi_information", _multi_sql(), ("tri_now",))
def _(s, d):
    a, b, c = (ev_symbols(s, d).select("trial", "t", F.col("process").alias(x), F.col("code").alias(f"{x}n")) for x in "abc")
    triples = a.join(b, ["trial", "t"]).where("a < b").join(c, ["trial", "t"]).where("b < c")
    names = ("total_correlation", "dual_total_correlation", "coinformation")
    return curves.multi_information(triples, ["a", "b", "c"], ["an", "bn", "cn"]).select("a", "b", "c", "N", *[F.round(x, 9).alias(x) for x in names])


@query("score_matrix", f"SELECT source, list(te ORDER BY target) AS scores FROM (SELECT source, target, greatest(te, 0) AS te FROM ({ORACLES['te_pairs']}) UNION ALL SELECT DISTINCT source, source, 0 FROM ({ORACLES['te_pairs']})) GROUP BY source")
def _(s, d):
    return networks.score_rows(QUERIES["te_pairs"](s, d), "te")


@query("stream_event_bins", "SELECT (epoch(date_trunc('hour', ts)) / 3600)::BIGINT AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    """Counts by hour and type, kept by a stream over the event files."""
    rows = running.events_stream(s, f"{d}/events.parquet*").select(F.floor(F.col("ts").cast("timestamp").cast("long") / 3600).alias("hour"), "event_type")
    return running.Running(s, "hour long, event_type string, n long", running.add_counts(["hour", "event_type"])).drain(rows)


@query("stream_count_table", "SELECT event_type AS x, floor(value / 25)::BIGINT AS y, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    """The joint counts of type and size, kept by a stream over the event files."""
    rows = running.events_stream(s, f"{d}/events.parquet*").select(F.col("event_type").alias("x"), F.floor(F.col("value") / 25).alias("y"))
    return running.Running(s, "x string, y long, n long", running.add_counts(["x", "y"])).drain(rows)
