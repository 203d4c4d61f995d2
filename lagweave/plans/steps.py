"""Queries of single steps: spike encoders, delays, contexts, gradients, folds, each with its SQL."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.special import xlog2x
from lagweave.operators import align, channels, decide, delays, encode, info, spikes
from lagweave.plans.catalogue import _NEEDS, _SQL, _TYPES, EDGE, ORACLES, QUERIES, ev_hour, ev_pairs, ev_symbols, query, shift_null
from lagweave.sources.tables import table

# Spikes in bins of ten minutes.
_SQL["ind"] = "ind AS (SELECT 0::BIGINT AS trial, t, process, (n > 0)::INT AS code FROM (" + ORACLES["spike_bin_dense"] + "))"
_SQL["isi"] = "isi AS (SELECT * FROM (SELECT trial, t, process, t - lag(t) OVER (PARTITION BY process ORDER BY t) AS interval FROM ind WHERE code = 1) WHERE interval IS NOT NULL)"
_SQL["last"] = """last AS (SELECT i.trial, i.t, i.process, s0, s1, s2, s3 FROM (SELECT *, last_value(CASE WHEN code = 1 THEN t END IGNORE NULLS) OVER (PARTITION BY process ORDER BY t ROWS UNBOUNDED PRECEDING) AS s0 FROM ind) i
  LEFT JOIN (SELECT process, t, lag(t) OVER w AS s1, lag(t, 2) OVER w AS s2, lag(t, 3) OVER w AS s3 FROM ind WHERE code = 1 WINDOW w AS (PARTITION BY process ORDER BY t)) p ON p.process = i.process AND p.t = i.s0)"""
_NEEDS |= {"ind": [], "isi": ["ind"], "last": ["ind"]}


def ev_bins(spark, d: str) -> DataFrame:
    return QUERIES["spike_bin_dense"](spark, d).select(F.lit(0).cast("long").alias("trial"), "t", "process", F.col("n").cast("double").alias("value"))


@query("spike_indicator", "SELECT * FROM ind", ("ind",))
def _(s, d):
    return spikes.indicator(ev_bins(s, d))


@query("spike_pooled_intervals", "SELECT * FROM isi", ("isi",))
def _(s, d):
    return spikes.intervals(ev_bins(s, d))


_over = "OVER (PARTITION BY process ORDER BY t ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"


@query(
    "encode_exponential_bins",
    "SELECT trial, t, process, code FROM (SELECT trial, t, process, (max(code) " + _over.format(0, 0) + " + 2 * max(code) " + _over.format(2, 1) + " + 4 * max(code) " + _over.format(7, 3) + ")::INT AS code, row_number() OVER (PARTITION BY process ORDER BY t) AS k FROM ind) WHERE k >= 8",
    ("ind",),
)
def _(s, d):
    return spikes.exponential_bins(ev_bins(s, d), spikes.growing_edges(8, 3, 0.35))


@query(
    "encode_spike_intervals",
    """SELECT l.trial, l.t, l.process, (CASE WHEN t - s1 < 50 THEN 3 * ((t - s0 >= a[1])::INT + (t - s0 >= a[2])::INT) + (s0 - s1 >= b[1])::INT + (s0 - s1 >= b[2])::INT ELSE 9 END)::INT AS code FROM last l
    JOIN (SELECT process, quantile_disc(t - s0, [1 / 3, 2 / 3]) AS a FROM last WHERE t - s0 < 50 GROUP BY 1) e ON e.process = l.process JOIN (SELECT process, quantile_disc(interval, [1 / 3, 2 / 3]) AS b FROM isi GROUP BY 1) g ON g.process = l.process WHERE t >= 49""",
    ("isi", "last"),
)
def _(s, d):
    return spikes.spike_intervals(ev_bins(s, d), 2, 3, 50)


@query(
    "encode_ordinal_intervals",
    """SELECT trial, t, process, (CASE WHEN t - s3 < 50 THEN 9 * ((i1 < i0)::INT + (i2 < i0)::INT) + 3 * ((i0 <= i1)::INT + (i2 < i1)::INT) + (i0 <= i2)::INT + (i1 <= i2)::INT ELSE 27 END)::INT AS code
    FROM (SELECT *, s2 - s3 AS i0, s1 - s2 AS i1, s0 - s1 AS i2 FROM last) WHERE t >= 49""",
    ("last",),
)
def _(s, d):
    return spikes.ordinal_intervals(ev_bins(s, d), 3, 50)


# Delays.
_SQL["lag20"] = "lag20 AS (SELECT unnest(range(1, 21)) AS lag)"
_SQL["ami"] = """ami AS (SELECT process, lag, round(ln(1.0 * max(nn)) / ln(2) + (sum(n * log2(n)) - sum(CASE WHEN ra = 1 THEN na * log2(na) ELSE 0 END) - sum(CASE WHEN rb = 1 THEN nb * log2(nb) ELSE 0 END)) / max(nn)
  + (sum((ra = 1)::INT) + sum((rb = 1)::INT) - count(*) - 1) / (2 * max(nn) * ln(2)), 12) AS mi FROM (SELECT *, sum(n) OVER k AS nn, sum(n) OVER a AS na, row_number() OVER a AS ra, sum(n) OVER b AS nb, row_number() OVER b AS rb
  FROM (SELECT x.process, lag, x.code AS a, y.code AS b, count(*) AS n FROM eight x JOIN lag20 ON true JOIN eight y ON y.process = x.process AND y.t = x.t - lag GROUP BY ALL)
  WINDOW k AS (PARTITION BY process, lag), a AS (PARTITION BY process, lag, a), b AS (PARTITION BY process, lag, b)) GROUP BY process, lag)"""
_SQL["eight"] = "eight AS (SELECT trial, t, process, len(list_filter(e, lambda q: q <= value)) AS code FROM hour JOIN (SELECT process, quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM hour GROUP BY 1) USING (process))"
_SQL["bend"] = """z AS (SELECT process, t, (value - avg(value) OVER (PARTITION BY process)) / stddev_pop(value) OVER (PARTITION BY process) AS z FROM hour),
zz AS (SELECT a.process, lag, a.t, a.z AS x, b.z AS y FROM z a JOIN lag20 ON true JOIN z b ON b.process = a.process AND b.t = a.t + lag),
tri AS (SELECT process, lag, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS "by", lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy FROM zz WINDOW w AS (PARTITION BY process, lag ORDER BY t)),
area AS (SELECT process, lag, 2 * abs((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) AS a, sqrt((ax - bx) ** 2 + (ay - "by") ** 2) * sqrt((bx - cx) ** 2 + ("by" - cy) ** 2) * sqrt((ax - cx) ** 2 + (ay - cy) ** 2) AS s FROM tri),
mean AS (SELECT process, lag, avg(CASE WHEN s > 1e-12 THEN a / s END) AS m FROM area GROUP BY ALL),
bend AS (SELECT process, lag, round((coalesce(lag(m) OVER w, m) + m + coalesce(lead(m) OVER w, m)) / 3, 9) AS curvature FROM mean WINDOW w AS (PARTITION BY process ORDER BY lag))"""
_NEEDS |= {"lag20": [], "eight": ["hour"], "ami": ["eight", "lag20"], "bend": ["hour", "lag20"]}


def _first(view: str, value: str) -> str:
    return f"SELECT process, coalesce(min(lag) FILTER (WHERE {value} < before AND {value} <= after), min_by(lag, ({value}, lag)))::INT AS delay FROM (SELECT *, lag({value}) OVER w AS before, lead({value}) OVER w AS after FROM {view} WINDOW w AS (PARTITION BY process ORDER BY lag)) GROUP BY process"


@query("auto_mi_curve", "SELECT process, lag::INT AS lag, round(mi, 9) AS mi FROM ami", ("ami",))
def _(s, d):
    return delays.auto_mi(ev_hour(s, d)).withColumn("mi", F.round("mi", 9))


@query("auto_mi_delay", _first("ami", "mi"), ("ami",))
def _(s, d):
    return delays.first_minimum(delays.auto_mi(ev_hour(s, d)), "mi", ["process"])


@query("curvature_delay", _first("bend", "curvature"), ("bend",))
def _(s, d):
    return delays.first_minimum(delays.curvature(ev_hour(s, d)), "curvature", ["process"])


@query("curvature_curve", "SELECT process, lag::INT AS lag, round(curvature, 7) AS curvature FROM bend", ("bend",))
def _(s, d):
    return delays.curvature(ev_hour(s, d)).withColumn("curvature", F.round("curvature", 7))


@query("delay_candidates", f"SELECT process, list_sort(list_distinct([1, a.delay, b.delay, c.delay])) AS delays FROM ({_first('ami', 'mi')}) a JOIN ({_first('bend', 'curvature')}) b USING (process) JOIN ({ORACLES['acf_delay'][ORACLES['acf_delay'].index('SELECT process, coalesce(min(CASE'):]}) c USING (process)", ("ami", "bend"))
def _(s, d):
    x = ev_hour(s, d)
    a = delays.first_minimum(delays.auto_mi(x), "mi", ["process"]).withColumnRenamed("delay", "a")
    b = delays.first_minimum(delays.curvature(x), "curvature", ["process"]).withColumnRenamed("delay", "b")
    return a.join(b, "process").join(QUERIES["acf_delay"](s, d), "process").select("process", F.array_sort(F.array_distinct(F.array(F.lit(1), "a", "b", "delay"))).alias("delays"))


# Lags, contexts, containers.
@query("lag_matrix", "SELECT trial, t, process, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3 FROM hour WINDOW w AS (PARTITION BY trial, process ORDER BY t) QUALIFY l3 IS NOT NULL", ("hour",))
def _(s, d):
    by = Window.partitionBy("trial", "process").orderBy("t")
    return ev_hour(s, d).select("trial", "t", "process", "value", *[F.lag("value", k).over(by).alias(f"l{k}") for k in (1, 2, 3)]).where("l3 is not null")


@query("candidate_lags", "SELECT process, unnest(range(1, max_lag + 1, greatest(tau, 1)))::INT AS lag FROM (SELECT process, delay AS tau, 3 * delay + 4 AS max_lag FROM (" + ORACLES["acf_delay"] + "))")
def _(s, d):
    """The lag grid of each process, its correlation time apart."""
    e = QUERIES["acf_delay"](s, d).select("process", F.col("delay").alias("tau"), (3 * F.col("delay") + 4).alias("max_lag"), F.lit(1).alias("min_lag"), F.lit(1).alias("lag_step"))
    return delays.candidate_lags(e)


@query("lag_budget", "SELECT max(max_lag)::INT AS source_max, count(*) AS processes, sum(ceil(max_lag / tau))::BIGINT AS candidates FROM (SELECT delay AS tau, 3 * delay + 4 AS max_lag FROM (" + ORACLES["acf_delay"] + "))")
def _(s, d):
    e = QUERIES["acf_delay"](s, d).select(F.col("delay").alias("tau"), (3 * F.col("delay") + 4).alias("max_lag"))
    return e.agg(F.max("max_lag").cast("int").alias("source_max"), F.count(F.lit(1)).alias("processes"), F.sum(F.ceil(F.col("max_lag") / F.col("tau"))).alias("candidates"))


@query("context_codes", "SELECT trial, t, process, 4 * lag(code, 1) OVER w + 2 * lag(code, 2) OVER w + lag(code, 4) OVER w AS context FROM sym WINDOW w AS (PARTITION BY trial, process ORDER BY t) QUALIFY context IS NOT NULL", ("sym",))
def _(s, d):
    return delays.context_codes(ev_symbols(s, d), [1, 2, 4], 2)


@query("dense_codes", "SELECT trial, t, (dense_rank() OVER (ORDER BY " + ", ".join(_TYPES) + ") - 1)::INT AS code FROM (SELECT 0::BIGINT AS trial, * FROM wide)", ("wide",))
def _(s, d):
    """One code for each distinct row of all processes: the few distinct rows are ranked, not the series."""
    wide = ev_symbols(s, d).groupBy("trial", "t").pivot("process", list(_TYPES)).agg(F.max("code"))
    codes = wide.select(*_TYPES).distinct().withColumn("code", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_TYPES)) - 1))
    return wide.join(F.broadcast(codes), list(_TYPES)).select("trial", "t", "code")


@query("add_context", "SELECT trial, t, process, code FROM w UNION ALL SELECT DISTINCT trial, t, 'context', (trial % 2)::INT FROM w".replace("w ", "(SELECT floor(t / 100)::BIGINT AS trial, t % 100 AS t, process, code FROM sym WHERE t < (SELECT floor((max(t) + 1) / 100) * 100 FROM sym)) ").replace("FROM w", "FROM (SELECT floor(t / 100)::BIGINT AS trial, t % 100 AS t, process, code FROM sym WHERE t < (SELECT floor((max(t) + 1) / 100) * 100 FROM sym))"), ("sym",))
def _(s, d):
    """Windows as trials, with a process that tells even ones from odd ones."""
    w = align.windows(ev_symbols(s, d), 100).select(F.col("window").alias("trial"), "t", "process", "code")
    return align.add_context(w, (F.col("trial") % 2).cast("int"))


@query("pool_units", "SELECT unit * 1000 + trial AS trial, t, process, code FROM (SELECT 0 AS unit, * FROM sym UNION ALL SELECT 1, * FROM sym WHERE t < 100)", ("sym",))
def _(s, d):
    sym = ev_symbols(s, d)
    return align.pooled([sym, sym.where("t < 100")], 1000)


@query("subset_trials", "SELECT trial, t, process, code FROM (SELECT floor(t / 100)::BIGINT AS trial, t % 100 AS t, process, code FROM sym WHERE t < (SELECT floor((max(t) + 1) / 100) * 100 FROM sym)) WHERE trial IN (1, 3)", ("sym",))
def _(s, d):
    w = align.windows(ev_symbols(s, d), 100).select(F.col("window").alias("trial"), "t", "process", "code")
    return align.subset_trials(w, [1, 3])


@query("te_longer_history", "SELECT source, target, round((" + "sum(n * log2(n)) + sum(CASE WHEN rw = 1 THEN nw * log2(nw) ELSE 0 END) - sum(CASE WHEN ryw = 1 THEN nyw * log2(nyw) ELSE 0 END) - sum(CASE WHEN rxw = 1 THEN nxw * log2(nxw) ELSE 0 END)) / sum(n), 9) AS te FROM (SELECT *, sum(n) OVER (PARTITION BY source, target, w) AS nw, row_number() OVER (PARTITION BY source, target, w) AS rw, sum(n) OVER (PARTITION BY source, target, y, w) AS nyw, row_number() OVER (PARTITION BY source, target, y, w) AS ryw, sum(n) OVER (PARTITION BY source, target, x, w) AS nxw, row_number() OVER (PARTITION BY source, target, x, w) AS rxw FROM (SELECT b.process AS source, a.process AS target, a.code AS y, 2 * b1.code + b.code AS x, 2 * a1.code + a2.code AS w, count(*) AS n FROM sym a JOIN sym a1 ON a1.process = a.process AND a1.t = a.t - 1 JOIN sym a2 ON a2.process = a.process AND a2.t = a.t - 2 JOIN sym b ON b.process <> a.process AND b.t = a.t - 3 JOIN sym b1 ON b1.process = b.process AND b1.t = a.t - 2 GROUP BY ALL)) GROUP BY ALL", ("sym",))
def _(s, d):
    """Two steps of the target's past, and two of the source's, the nearest two steps back."""
    rows = align.windowed_pairs(ev_symbols(s, d), own=2, source=2, lag=2)
    keys = ["source", "target"]
    return info.conditional_mi(info.counts(rows, keys, ["y", "x", "w"]), keys).select(*keys, F.round("cmi", 9).alias("te"))


# Tables of edges.
_SQL["one"] = "one AS (SELECT source, target, y, x, w, n FROM cnt WHERE lag = 1)"
_NEEDS["one"] = ["cnt"]


def _one(s, d) -> DataFrame:
    return info.counts(ev_pairs(s, d), ["source", "target"], ["y", "x", "w"])


@query("levels_by_stratum", "SELECT source, target, w, count(DISTINCT x) AS levels FROM one GROUP BY ALL", ("one",))
def _(s, d):
    return _one(s, d).groupBy("source", "target", "w").agg(F.count_distinct("x").alias("levels"))


_SQL["law"] = "law AS (SELECT source, target, w, list((y, x, round(p, 1)) ORDER BY y, x) AS law FROM (SELECT *, n / sum(n) OVER (PARTITION BY source, target, w) AS p FROM one) GROUP BY ALL)"
_SQL["cluster"] = "cluster AS (SELECT source, target, w, dense_rank() OVER (PARTITION BY source, target ORDER BY first) - 1 AS cluster FROM (SELECT *, min(w) OVER (PARTITION BY source, target, law) AS first FROM law))"
_NEEDS |= {"law": ["one"], "cluster": ["law"]}


@query("merge_contexts", "SELECT source, target, w, cluster::INT AS cluster FROM cluster", ("cluster",))
def _(s, d):
    """Contexts whose laws agree to one digit."""
    return channels.laws(_one(s, d), ["source", "target"], 1)


@query("apply_merge", "SELECT source, target, y, x, cluster::INT AS w, sum(n)::BIGINT AS n FROM one JOIN cluster USING (source, target, w) GROUP BY ALL", ("cluster",))
def _(s, d):
    one = _one(s, d)
    return channels.merged(one, channels.laws(one, ["source", "target"], 1), ["source", "target"])


_CHANNEL = [(0, 0, 0.75), (0, 1, 0.25), (1, 0, 0.4), (1, 1, 0.6)]
_SQL["q"] = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({w}, {z}, {q}::DOUBLE)" for w, z, q in _CHANNEL) + ") v(w, z, q))"
_NEEDS["q"] = []


@query("degrade_contexts", "SELECT source, target, y, x, z, round(sum(n * q), 9) AS n FROM one JOIN q USING (w) GROUP BY ALL", ("one", "q"))
def _(s, d):
    return channels.degraded(_one(s, d), s.createDataFrame(_CHANNEL, "w int, z int, q double")).withColumn("n", F.round("n", 9))


@query("harden_channel", "SELECT source, target, y, x, z, sum(n)::DOUBLE AS n FROM one JOIN (SELECT w, z FROM q QUALIFY row_number() OVER (PARTITION BY w ORDER BY q DESC, z) = 1) USING (w) GROUP BY ALL", ("one", "q"))
def _(s, d):
    return channels.degraded(_one(s, d), channels.hardened(s.createDataFrame(_CHANNEL, "w int, z int, q double")))


@query("layers_from_values", "SELECT source, target, round(te, 9) AS te, round(tdmi, 9) AS tdmi, round(flow, 9) AS intrinsic, round(te - flow, 9) AS synergistic, round(tdmi - flow, 9) AS shared, clipped FROM (SELECT *, least(greatest(intrinsic, 0), te, tdmi) AS flow FROM (SELECT source, target, greatest(te, 0) AS te, greatest(tdmi, 0) AS tdmi, intrinsic, intrinsic < 0 OR intrinsic > least(te, tdmi) OR te < 0 OR tdmi < 0 AS clipped FROM (SELECT *, round(te + tdmi - 0.0004, 9) AS intrinsic FROM (SELECT * FROM (" + ORACLES["te_pairs"][ORACLES["te_pairs"].index("SELECT source, target, round(cmi"):] + ") JOIN (" + ORACLES["tdmi_pairs"][ORACLES["tdmi_pairs"].index("SELECT source, target, round((sum"):] + ") USING (source, target)))))", ("cmi", "cnt"))
def _(s, d):
    """The rule that keeps an estimate of intrinsic flow within its bounds."""
    both = QUERIES["te_pairs"](s, d).join(QUERIES["tdmi_pairs"](s, d), ["source", "target"])
    out = channels.layers(both.withColumn("intrinsic", F.round(F.col("te") + F.col("tdmi") - 0.0004, 9)))
    return out.select("source", "target", *[F.round(c, 9).alias(c) for c in ("te", "tdmi", "intrinsic", "synergistic", "shared")], "clipped")


@query("adjust_by_layer", "SELECT layer, source, p, CASE WHEN p IS NOT NULL THEN round(least(1, min(p * m / r) OVER (PARTITION BY layer ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) END AS q FROM (SELECT *, count(p) OVER (PARTITION BY layer) AS m, row_number() OVER (PARTITION BY layer ORDER BY p NULLS LAST, source) AS r FROM (SELECT target AS layer, source, CASE WHEN source <> 'click' THEN p END AS p FROM shift))", ("shift",))
def _(s, d):
    """q values within each target; tests that were not made stay without one."""
    rows = shift_null(s, d).select(F.col("target").alias("layer"), "source", F.when(F.col("source") != "click", F.col("p")).alias("p"))
    made = decide.adjust(rows.where("p is not null"), family=["layer"]).select("layer", "source", "p", F.round("q", 9).alias("q"))
    return made.unionByName(rows.where("p is null").withColumn("q", F.lit(None).cast("double")))


# O-information rates of all but one or two processes.
def _omega_sql(names: list[str], suffix: tuple[str, ...]) -> str:
    if len(names) < 3:
        return "0"
    h = lambda ps: "(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM lagged GROUP BY " + ", ".join(p + x for p in ps for x in suffix) + "))"
    return f"({len(names) - 2} * {h(names)} + " + " + ".join(f"{h([p])} - {h([q for q in names if q != p])}" for p in names) + ")"


_SQL["lagged"] = "lagged AS (SELECT * FROM (SELECT " + ", ".join(f"{p}, lag({p}) OVER (ORDER BY t) AS {p}_p" for p in _TYPES) + " FROM wide) WHERE " + _TYPES[0] + "_p IS NOT NULL)"
_NEEDS["lagged"] = ["wide"]
_rate_sql = lambda names: f"({_omega_sql(names, ('', '_p'))} - {_omega_sql(names, ('_p',))})"
_SUBSETS = [tuple(_TYPES)] + [tuple(q for q in _TYPES if q not in gone) for k in (1, 2) for gone in combinations(_TYPES, k)]
_SQL["rates"] = "rates AS (" + " UNION ALL ".join(f"SELECT '{'+'.join(p for p in _TYPES if p not in names)}' AS gone, {_rate_sql(list(names))} AS rate" for names in _SUBSETS) + ")"
_NEEDS["rates"] = ["lagged"]


def _rates(s, d) -> DataFrame:
    """(gone, rate): the O-information rate of all processes without some, all entropies from one aggregation."""
    past = Window.partitionBy("trial").orderBy("t")
    wide = ev_symbols(s, d).groupBy("trial", "t").pivot("process", list(_TYPES)).agg(F.max("code"))
    rows = wide.select(*_TYPES, *[F.lag(p).over(past).alias(f"{p}_p") for p in _TYPES]).where(f"{_TYPES[0]}_p is not null")
    table_ = info.counts(rows, [], [*_TYPES, *[f"{p}_p" for p in _TYPES]])
    groups = {(kind, ps) for names in _SUBSETS if len(names) > 2 for kind in "bp" for ps in [names, *((p,) for p in names), *(tuple(q for q in names if q != p) for p in names)]}
    columns = lambda kind, ps: [c for p in ps for c in ([p, f"{p}_p"] if kind == "b" else [f"{p}_p"])]
    cells = info.marginals(table_, [], {f"{kind}:{'+'.join(ps)}": columns(kind, ps) for kind, ps in groups})
    h = cells.groupBy("part").agg((F.log2(F.sum("n")) - F.sum(xlog2x(F.col("n").cast("double"))) / F.sum("n")).alias("h"))
    terms = []
    for names in _SUBSETS:
        if len(names) > 2:
            gone = "+".join(p for p in _TYPES if p not in names)
            for kind, sign in (("b", 1.0), ("p", -1.0)):
                terms.append((gone, f"{kind}:{'+'.join(names)}", sign * (len(names) - 2)))
                terms += [(gone, f"{kind}:{p}", sign) for p in names] + [(gone, f"{kind}:{'+'.join(q for q in names if q != p)}", -sign) for p in names]
    weights = s.createDataFrame(terms, "gone string, part string, weight double")
    return weights.join(h, "part").groupBy("gone").agg(F.sum(F.col("weight") * F.col("h")).alias("rate"))


@query("oir_node_gradients", "SELECT gone AS process, round((SELECT rate FROM rates WHERE gone = '') - rate, 7) AS gradient FROM rates WHERE gone <> '' AND gone NOT LIKE '%+%'", ("rates",))
def _(s, d):
    rates = _rates(s, d)
    whole = rates.where("gone = ''").select(F.col("rate").alias("whole"))
    return rates.where("gone != '' and gone not like '%+%'").crossJoin(whole).select(F.col("gone").alias("process"), F.round(F.col("whole") - F.col("rate"), 7).alias("gradient"))


@query("oir_link_gradients", "SELECT a.gone AS a, b.gone AS b, round((SELECT rate FROM rates WHERE gone = '') - a.rate - b.rate + r.rate, 7) AS gradient FROM rates a JOIN rates b ON a.gone < b.gone AND a.gone <> '' AND a.gone NOT LIKE '%+%' AND b.gone NOT LIKE '%+%' JOIN rates r ON r.gone = a.gone || '+' || b.gone", ("rates",))
def _(s, d):
    rates = _rates(s, d)
    whole = rates.where("gone = ''").select(F.col("rate").alias("whole"))
    one = rates.where("gone != '' and gone not like '%+%'")
    a, b = (one.select(F.col("gone").alias(x), F.col("rate").alias(f"r{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("gone", F.concat_ws("+", "a", "b"))
    return pairs.join(rates, "gone").crossJoin(whole).select("a", "b", F.round(F.col("whole") - F.col("ra") - F.col("rb") + F.col("rate"), 7).alias("gradient"))


# Prediction by counts.
_SQL["lolo"] = "lolo AS (SELECT floor(a.t / 100)::BIGINT AS \"window\", a.process, a.code AS y, b.code AS x, count(*) AS n FROM sym a JOIN sym b ON b.process = a.process AND b.t = a.t - 1 AND floor(b.t / 100) = floor(a.t / 100) WHERE a.t < (SELECT floor((max(t) + 1) / 100) * 100 FROM sym) GROUP BY ALL)"
_NEEDS["lolo"] = ["sym"]


@query("window_log_likelihood", 'SELECT "window", process, round(sum(n * ln((tyx - n + 0.5) / (tx - nx + 1))), 6) AS ll FROM (SELECT *, sum(n) OVER (PARTITION BY process, y, x) AS tyx, sum(n) OVER (PARTITION BY process, x) AS tx, sum(n) OVER (PARTITION BY "window", process, x) AS nx FROM lolo) GROUP BY ALL', ("lolo",))
def _(s, d):
    """Each window's log likelihood under the laws of all others."""
    w = align.windows(ev_symbols(s, d), 100)
    x = F.lag("code").over(Window.partitionBy("trial", "window", "process").orderBy("t"))
    cells = w.select("window", "process", F.col("code").alias("y"), x.alias("x")).where("x is not null").groupBy("window", "process", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    rows = cells.withColumn("tyx", over("process", "y", "x")).withColumn("tx", over("process", "x")).withColumn("nx", over("window", "process", "x"))
    return rows.groupBy("window", "process").agg(F.round(F.sum(F.col("n") * F.log((F.col("tyx") - F.col("n") + 0.5) / (F.col("tx") - F.col("nx") + 1))), 6).alias("ll"))


@query(
    "predictive_te",
    """SELECT source, target, round(sum(n * (log2((tyxw - n + 0.5) / (txw - nxw + 1)) - log2((tyw - nyw + 0.5) / (tw - nw + 1)))) / sum(n), 9) AS te FROM (SELECT *, sum(n) OVER (PARTITION BY source, target, y, x, w) AS tyxw, sum(n) OVER (PARTITION BY source, target, x, w) AS txw, sum(n) OVER (PARTITION BY source, target, fold, x, w) AS nxw,
      sum(n) OVER (PARTITION BY source, target, y, w) AS tyw, sum(n) OVER (PARTITION BY source, target, fold, y, w) AS nyw, sum(n) OVER (PARTITION BY source, target, w) AS tw, sum(n) OVER (PARTITION BY source, target, fold, w) AS nw
      FROM (SELECT source, target, floor(t / 144)::INT AS fold, y, x, w, count(*) AS n FROM pairs WHERE lag = 1 GROUP BY ALL)) GROUP BY ALL""",
    ("pairs",),
)
def _(s, d):
    """What the source's past adds to the held-out log likelihood of the target, by smoothed tables over folds of time."""
    rows = ev_pairs(s, d).withColumn("fold", F.floor(F.col("t") / 144))
    cells = rows.groupBy("source", "target", "fold", "y", "x", "w").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("source", "target", *c))
    rest = lambda *c: over(*c) - over("fold", *c)
    cells = cells.select("source", "target", "n", rest("y", "x", "w").alias("yxw"), rest("x", "w").alias("xw"), rest("y", "w").alias("yw"), rest("w").alias("w"))
    gain = F.log2((F.col("yxw") + 0.5) / (F.col("xw") + 1)) - F.log2((F.col("yw") + 0.5) / (F.col("w") + 1))
    return cells.groupBy("source", "target").agg(F.round(F.sum(F.col("n") * gain) / F.sum("n"), 9).alias("te"))


@query("block_entropies", "SELECT length, count(*) AS words, sum(n)::BIGINT AS total, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) AS h FROM (SELECT 1 AS length, code::VARCHAR AS word, count(*) AS n FROM sym WHERE process = 'click' GROUP BY ALL UNION ALL " + " UNION ALL ".join(f"SELECT {k}, word, count(*) FROM (SELECT concat({', '.join(f'lag(code, {j}) OVER w' for j in range(k - 1, 0, -1))}, code) AS word, row_number() OVER w AS r FROM sym WHERE process = 'click' WINDOW w AS (ORDER BY t)) WHERE r >= {k} GROUP BY ALL" for k in (2, 3, 4)) + ") GROUP BY length", ("sym",))
def _(s, d):
    """Entropies of words of one to four symbols of a process."""
    by = Window.partitionBy("trial").orderBy("t")
    rows = ev_symbols(s, d).where("process = 'click'").select(F.col("code"), *[F.lag("code", j).over(by).alias(f"l{j}") for j in (1, 2, 3)])
    words = F.array(*[F.struct(F.lit(k).alias("length"), F.concat(*[F.col(f"l{j}").cast("string") for j in range(k - 1, 0, -1)], F.col("code").cast("string")).alias("word")) for k in (1, 2, 3, 4)])
    cells = rows.select(F.explode(words).alias("e")).select("e.*").where("word is not null").groupBy("length", "word").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    return cells.groupBy("length").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("total"), F.round(F.log2(F.sum("n")) - F.sum(n * F.log2(n)) / F.sum("n"), 9).alias("h"))


@query("late_events", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts < seen - INTERVAL 1 HOUR) AS late FROM (SELECT *, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM events) GROUP BY 1")
def _(s, d):
    """Events that come more than an hour behind the latest one seen before, in the order of their ids."""
    seen = F.max("ts").over(Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = table(s, d, "events").withColumn("seen", seen)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") < F.col("seen") - F.expr("INTERVAL 1 HOUR")).alias("late"))


@query("rank_window", "SELECT trial, t, process, (dense_rank() OVER (PARTITION BY process ORDER BY value) - 1)::INT AS code FROM val WHERE value IS NOT NULL", ("val",))
def _(s, d):
    from lagweave.plans.catalogue import ev_value

    return encode.identity(ev_value(s, d).where("value is not null"))
