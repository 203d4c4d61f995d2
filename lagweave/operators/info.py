"""Count tables and information measures in bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.functions.special import digamma, harmonic, lgamma, xlog2x

LN2 = 0.6931471805599453


def counts(realizations: DataFrame, keys: list[str], symbols: list[str]) -> DataFrame:
    """The joint count table of each key."""
    return realizations.groupBy(*keys, *symbols).agg(F.count(F.lit(1)).alias("n"))


def marginals(table: DataFrame, keys: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """All marginals of a count table in one aggregation: rows (keys, set, n), a row for each occupied cell."""
    symbols = sorted({s for v in sets.values() for s in v})
    rows = table.groupingSets([[*keys, *v] for v in sets.values()], *keys, *symbols).agg(F.sum("n").alias("cell"), F.grouping_id(*keys, *symbols).alias("gid"))
    order = [*keys, *symbols]
    names = {sum(1 << (len(order) - 1 - order.index(c)) for c in symbols if c not in v): k for k, v in sets.items()}
    name = F.lit(None).cast("string")
    for g, k in names.items():
        name = F.when(F.col("gid") == g, F.lit(k)).otherwise(name)
    return rows.select(*keys, name.alias("part"), F.col("cell").alias("n"))


def entropies(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of each key by several estimators, from the counts n of occupied cells."""
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("K"), F.count_if(F.col("n") == 1).alias("f1"), F.count_if(F.col("n") == 2).alias("f2"))
    rows = cells.join(total, keys) if keys else cells.crossJoin(total)
    n, big = F.col("n").cast("double"), F.col("total").cast("double")
    sign = F.when(F.col("n") % 2 == 0, 1.0).otherwise(-1.0)
    g = digamma(n) + sign / 2 * (digamma((n + 1) / 2) - digamma(n / 2))
    out = rows.groupBy(*keys, "total", "K", "f1", "f2").agg(
        F.sum(n * F.log(n)).alias("s"),
        F.sum(n / big * (harmonic(big - 1) - harmonic(n - 1))).alias("z"),
        F.sum(n * g).alias("g"),
    )
    f1, f2, big = F.col("f1"), F.col("f2"), F.col("total")
    plugin = F.log(big) - F.col("s") / big
    a = F.when(f2 > 0, 2 * f2 / ((big - 1) * f1 + 2 * f2)).when(f1 > 0, 2 / ((big - 1) * (f1 - 1) + 2)).otherwise(1.0)
    tail = F.when((f1 > 0) & (a < 1), f1 / big * _tail(a, big)).otherwise(0.0)
    return out.select(*keys, F.col("total").alias("N"), "K", (plugin / LN2).alias("plugin"), ((plugin + (F.col("K") - 1) / (2 * big)) / LN2).alias("miller_madow"), (F.col("z") / LN2).alias("zhang"), ((F.col("z") + tail) / LN2).alias("chao_wang_jost"), ((F.log(big) - F.col("g") / big) / LN2).alias("grassberger"))


def _tail(a: Column, n: Column, head: int = 200, depth: int = 80) -> Column:
    """sum over j >= 0 of (1-a)^(j+1) / (n+j): the first terms, then the rest by Euler-Maclaurin, its integral an exponential integral in continued-fraction form."""
    q, m = 1 - a, n + head
    first = F.aggregate(F.sequence(F.lit(0), F.lit(head - 1)), F.lit(0.0), lambda s, j: s + F.pow(q, j + 1) / (n + j))
    z = -F.log(q) * m
    fraction = F.aggregate(F.sequence(F.lit(depth), F.lit(1), F.lit(-1)), z, lambda c, k: z + k / (1 + k / c))
    term = F.pow(q, F.lit(head + 1)) / m
    return first + F.pow(q, F.lit(head + 1)) / fraction + term / 2 - term * (F.log(q) - 1 / m) / 12


def conditional_mi(table: DataFrame, keys: list[str], y: str = "y", x: str = "x", w: list[str] | None = None) -> DataFrame:
    """I[y : x | w] of each key, plug-in and Miller-Madow, from one pass over the marginals."""
    w = ["w"] if w is None else w
    sets = {"yxw": [y, x, *w], "yw": [y, *w], "xw": [x, *w], "w": w}
    cells = marginals(table, keys, sets)
    n = F.col("n").cast("double")
    agg = cells.groupBy(*keys).agg(*[F.sum(F.when(F.col("part") == k, xlog2x(n)).otherwise(0.0)).alias(f"s_{k}") for k in sets], *[F.count_if(F.col("part") == k).alias(f"k_{k}") for k in sets], F.sum(F.when(F.col("part") == "yxw", F.col("n"))).alias("N"))
    plugin = (F.col("s_yxw") + F.col("s_w") - F.col("s_yw") - F.col("s_xw")) / F.col("N")
    correction = (F.col("k_yw") + F.col("k_xw") - F.col("k_yxw") - F.col("k_w")) / (2 * F.col("N") * LN2)
    return agg.select(*keys, "N", plugin.alias("cmi"), (plugin + correction).alias("cmi_mm"))


def more_entropies(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Jackknife and James-Stein shrinkage entropies in bits, from the counts n of occupied cells."""
    n, big = F.col("n").cast("double"), F.col("total").cast("double")
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("K"), F.sum(xlog2x(n)).alias("s"), F.sum(n * n).alias("squares"))
    rows = cells.join(total, keys)
    left = F.when(big > 1, F.log2(big - 1) - (F.col("s") - xlog2x(n) + xlog2x(n - 1)) / (big - 1)).otherwise(0.0)
    squares, k = F.col("squares") / big**2, F.col("K")
    weight = F.when((k > 1) & (big > 1) & (squares > 1 / k), F.least(F.lit(1.0), (1 - squares) / ((big - 1) * (squares - 1 / k)))).otherwise(1.0)
    p = weight / k + (1 - weight) * n / big
    out = rows.groupBy(*keys, "total", "s").agg(F.sum(n * left).alias("left"), F.sum(-p * F.log2(p)).alias("shrink"))
    return out.select(*keys, (big * (F.log2(big) - F.col("s") / big) - (big - 1) / big * F.col("left")).alias("jackknife"), "shrink")


def log_bayes_factor(table: DataFrame, keys: list[str], levels: int, ess: float = 1.0) -> DataFrame:
    """Log evidence (nats) that x helps to predict y given w, from counts n of (y, x, w): the closed form for Dirichlet priors of equal total weight, over the occupied contexts."""

    def evidence(context: list[str], name: str) -> DataFrame:
        cells = table.groupBy(*keys, *context, "y").agg(F.sum("n").alias("n"))
        rows = cells.groupBy(*keys, *context).agg(F.collect_list("n").alias("ns"), F.sum("n").alias("n"))
        rows = rows.withColumn("a", ess / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        cell = F.aggregate("ns", F.lit(0.0), lambda s, m: s + lgamma(F.col("a") / levels + m) - lgamma(F.col("a") / levels))
        return rows.groupBy(*keys).agg(F.sum(lgamma(F.col("a")) - lgamma(F.col("a") + F.col("n")) + cell).alias(name))

    both = evidence(["x", "w"], "full").join(evidence(["w"], "part"), keys)
    return both.select(*keys, (F.col("full") - F.col("part")).alias("log_bf"))


def o_information_rate(realizations: DataFrame, keys: list[str], now: list[str], past: list[str]) -> DataFrame:
    """O-information of whole blocks (now and past of each process) less that of the pasts alone, in bits, all marginals from one aggregation; above 0 redundancy prevails, below 0 synergy."""
    m = len(now)
    sets, signs = {}, {}
    for name, block, outer in (("b", [[a, b] for a, b in zip(now, past, strict=True)], 1), ("p", [[b] for b in past], -1)):
        chosen = {f"{name}_all": (list(range(m)), m - 2)} | {f"{name}_only{j}": ([j], 1) for j in range(m)} | {f"{name}_not{j}": ([k for k in range(m) if k != j], -1) for j in range(m)}
        for k, (members, sign) in chosen.items():
            sets[k], signs[k] = [c for v in members for c in block[v]], outer * sign
    cells = marginals(counts(realizations, keys, [*now, *past]), keys, sets)
    sign = F.create_map(*[F.lit(v) for k in signs for v in (k, float(signs[k]))])[F.col("part")]
    n = F.col("n").cast("double")
    total = F.sum(F.when(F.col("part") == "b_all", F.col("n")))
    # the coefficients of blocks and pasts add up alike, so the logarithms of the total cancel
    return cells.groupBy(*keys).agg(total.alias("N"), (-F.sum(sign * xlog2x(n)) / total).alias("rate"))
