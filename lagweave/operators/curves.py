"""Straight stretches of curves, block entropies, stationarity, multi-information."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lagweave.functions.special import xlog2x
from lagweave.operators.info import counts, marginals
from lagweave.operators.machine import chi2_sf


def line_fits(curve: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Least squares on every stretch of at least `least` points of the curves (keys, x, y): slope, intercept, ends, and a weight, the length of the line over its mean square error."""
    points = curve.select(*keys, "x", "y")
    ends = points.select(*keys, F.col("x").alias("start")).join(points.select(*keys, F.col("x").alias("stop")), keys).where("start < stop")
    inside = ends.join(points, keys).where("x >= start and x <= stop")
    by = [*keys, "start", "stop"]
    fits = inside.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("points"), F.max(F.abs("y")).alias("top")).where(F.col("points") >= least)
    miss = F.pow(F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"), 2)
    left = inside.join(fits, by).groupBy(*by, "slope", "intercept", "points", "top").agg(F.avg(miss).alias("square"))
    error = F.sqrt("square") + 1e-12 * F.greatest(F.lit(1.0), F.col("top"))
    length = (F.col("stop") - F.col("start")) * F.sqrt(1 + F.pow("slope", 2))
    return left.select(*by, "slope", "intercept", "points", (length / F.pow(error, 2)).alias("weight"))


def weighted_quantile(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """The value at which the running share of the weights reaches q, on the line between neighbours."""
    by = Window.partitionBy(*keys).orderBy(value, "weight", "start", "stop")
    share = F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(Window.partitionBy(*keys))
    steps = rows.withColumn("share", share).withColumn("before", F.lag("share").over(by)).withColumn("last", F.lag(value).over(by))
    at = F.col("last") + (q - F.col("before")) / (F.col("share") - F.col("before")) * (F.col(value) - F.col("last"))
    # the last share may fall short of one by rounding; no q here is that high
    return steps.where(F.col("share") >= q).groupBy(*keys).agg(F.min_by(F.coalesce(at, F.col(value)), F.struct("share", value)).alias(name))


def scaling_region(curve: DataFrame, keys: list[str], least: int = 3, bins: int = 50) -> DataFrame:
    """The slope that most of the well fitting stretches of a curve share, with the ends of those stretches. Curves of fewer than `least` points have no row."""
    fits = line_fits(curve, keys, least)
    whole = Window.partitionBy(*keys)
    low, high = F.min("slope").over(whole), F.max("slope").over(whole)
    place = F.when(high > low, F.least(F.floor((F.col("slope") - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(bins // 2)
    fits = fits.withColumn("bin", place)
    mode = fits.groupBy(*keys, "bin").agg(F.sum("weight").alias("w")).groupBy(*keys).agg(F.max_by("bin", F.struct("w", (-F.col("bin")).alias("b"))).alias("bin"))
    near = fits.join(mode, [*keys, "bin"])
    out = fits.groupBy(*keys).agg(F.count(F.lit(1)).alias("fits"))
    for value, rows, q, name in (("slope", near, 0.5, "slope"), ("intercept", near, 0.5, "intercept"), ("start", near, 0.5, "start"), ("stop", near, 0.5, "stop"), ("slope", fits, 0.25, "slope_low"), ("slope", fits, 0.75, "slope_high")):
        out = out.join(weighted_quantile(rows, keys, value, q, name), keys)
    return out


def block_entropy_curve(symbols: DataFrame, longest: int) -> DataFrame:
    """(process, x, y): Miller-Madow entropies of words of x symbols within trials, up to the length whose words are undersampled (more than a fifth of their number are distinct); the first three lengths always stay."""
    by = Window.partitionBy("trial", "process").orderBy("t")
    past = symbols.select("process", *[(F.lag("code", j).over(by) if j else F.col("code")).alias(f"c{j}") for j in range(longest)])
    words = F.array(*[F.when(F.col(f"c{k - 1}").isNotNull(), F.struct(F.lit(k).alias("x"), F.concat_ws(" ", *[F.col(f"c{j}").cast("string") for j in range(k)]).alias("word"))) for k in range(1, longest + 1)])
    cells = past.select("process", F.explode(words).alias("e")).where("e is not null").groupBy("process", "e.x", "e.word").agg(F.count(F.lit(1)).alias("n"))
    n, total = F.col("n").cast("double"), F.sum("n")
    y = F.log2(total) - F.sum(xlog2x(n)) / total + (F.count(F.lit(1)) - 1) / (2 * total * F.log(F.lit(2.0)))
    out = cells.groupBy("process", "x").agg(y.alias("y"), F.count(F.lit(1)).alias("words"), total.alias("total"))
    return out.where("x <= 3 or words <= total / 5").select("process", F.col("x").cast("double").alias("x"), "y")


def stationarity(samples: DataFrame, segments: int = 4) -> DataFrame:
    """G test of whether patterns of three values, side by side, are spread alike over the segments of a process's trials: g, degrees of freedom and p (1 where there is nothing to compare)."""
    own = Window.partitionBy("trial", "process")
    size = F.floor(F.count(F.lit(1)).over(own) / segments)
    by = own.orderBy("t")
    rows = samples.select("trial", "process", "t", (F.row_number().over(by) - 1).alias("k"), size.alias("size"), F.col("value").alias("a"), F.lead("value", 1).over(by).alias("b"), F.lead("value", 2).over(by).alias("c"))
    rows = rows.where("size >= 9").withColumn("segment", F.floor(F.col("k") / F.col("size"))).withColumn("place", F.col("k") % F.col("size"))
    rows = rows.where((F.col("segment") < segments) & (F.col("place") % 3 == 0) & (F.col("place") + 2 < F.col("size")))
    pattern = F.when(F.expr("a <= b"), 4).otherwise(0) + F.when(F.expr("b <= c"), 2).otherwise(0) + F.when(F.expr("a <= c"), 1).otherwise(0)
    cells = rows.groupBy("process", "trial", "segment", pattern.alias("pattern")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("process", *c))
    cells = cells.withColumn("g", 2 * F.col("n") * F.log(F.col("n") * over() / over("trial", "segment") / over("pattern")))
    out = cells.groupBy("process").agg(F.greatest(F.sum("g"), F.lit(0.0)).alias("g"), ((F.count_distinct("trial", "segment") - 1) * (F.count_distinct("pattern") - 1)).alias("dof"))
    return out.select("process", "g", "dof", chi2_tail("g", "dof").alias("p"))


@F.pandas_udf(DoubleType())
def chi2_tail(g: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, int(k)) if k > 0 else 1.0 for a, k in zip(g, dof, strict=True)])


def multi_information(realizations: DataFrame, keys: list[str], symbols: list[str]) -> DataFrame:
    """Total correlation, dual total correlation and co-information in bits, all marginals from one aggregation."""
    m = len(symbols)
    sets = {"".join(str(j) for j in range(m) if k >> j & 1): [symbols[j] for j in range(m) if k >> j & 1] for k in range(1, 1 << m)}
    cells = marginals(counts(realizations, keys, symbols), keys, sets)
    total = F.sum(F.when(F.col("part") == "".join(map(str, range(m))), F.col("n")))

    def of(sign: dict[str, int]) -> Column:
        """The sum of the entropies with their signs."""
        weight = F.create_map(*[F.lit(v) for k, c in sign.items() for v in (k, float(c))])[F.col("part")]
        return F.log2(total) * float(sum(sign.values())) - F.sum(F.coalesce(weight, F.lit(0.0)) * xlog2x(F.col("n").cast("double"))) / total

    whole = "".join(map(str, range(m)))
    one = {k: 1 for k in sets if len(k) == 1}
    rest = {k: 1 for k in sets if len(k) == m - 1}
    return cells.groupBy(*keys).agg(
        total.alias("N"),
        of(one | {whole: -1}).alias("total_correlation"),
        of(rest | {whole: 1 - m}).alias("dual_total_correlation"),
        of({k: (-1) ** (len(k) + 1) for k in sets}).alias("coinformation"),
    )
