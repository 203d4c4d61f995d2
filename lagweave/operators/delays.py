"""Delays and candidate lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagweave.operators import encode, info


def first_minimum(curve: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The first lag of a curve (keys, lag, value) that lies below the one before and not above the one after; else that of the least value."""
    w = Window.partitionBy(*keys).orderBy("lag")
    v = F.col(value)
    dip = (v < F.lag(v).over(w)) & (v <= F.lead(v).over(w))
    rows = curve.select(*keys, "lag", value, dip.alias("dip"))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("dip"), F.col("lag"))), F.min_by("lag", F.struct(value, "lag"))).alias("delay"))


def _lagged(samples: DataFrame, value: str, largest: int) -> DataFrame:
    """(process, lag, a, b): each value and the one `lag` steps before, for all lags, one window over each trial."""
    w = Window.partitionBy("trial", "process").orderBy("t")
    each = [F.struct(F.lit(k).alias("lag"), F.lag(value, k).over(w).alias("b")) for k in range(1, largest + 1)]
    rows = samples.select("process", F.col(value).alias("a"), F.array(*each).alias("es")).select("process", "a", F.explode("es").alias("e"))
    return rows.select("process", "e.lag", "a", "e.b").where("b is not null")


def auto_mi(samples: DataFrame, largest: int = 20, bins: int = 8, digits: int = 12) -> DataFrame:
    """Miller-Madow information of a process about itself at each lag, in quantile bins."""
    pairs = _lagged(encode.equal_frequency(samples, bins), "code", largest)
    curve = info.conditional_mi(info.counts(pairs, ["process", "lag"], ["a", "b"]), ["process", "lag"], "a", "b", [])
    return curve.select("process", "lag", F.round("cmi_mm", digits).alias("mi"))


def autocorrelation(samples: DataFrame, largest: int = 20) -> DataFrame:
    """Correlation of a process with itself at each lag, each trial's mean removed."""
    centred = samples.withColumn("c", F.col("value") - F.avg("value").over(Window.partitionBy("trial", "process")))
    pairs = _lagged(centred, "c", largest)
    return pairs.groupBy("process", "lag").agg((F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2))).alias("r"))


def curvature(samples: DataFrame, largest: int = 20, digits: int = 9) -> DataFrame:
    """Mean Menger curvature of (x_t, x_t+lag) at each lag, smoothed over three lags, the ends counted twice. Scaled by the process's deviation."""
    w = Window.partitionBy("trial", "process").orderBy("t")
    scaled = samples.withColumn("z", (F.col("value") - F.avg("value").over(Window.partitionBy("trial", "process"))) / F.stddev_pop("value").over(Window.partitionBy("process")))
    x = [F.lead("z", j).over(w) for j in range(largest + 3)]
    rows = scaled.select("process", *[c.alias(f"z{j}") for j, c in enumerate(x)])

    def bend(k: int) -> Column:
        (ax, ay), (bx, by), (cx, cy) = ((F.col(f"z{j}"), F.col(f"z{j + k}")) for j in range(3))
        side = lambda px, py, qx, qy: F.sqrt((px - qx) ** 2 + (py - qy) ** 2)
        sides = side(ax, ay, bx, by) * side(bx, by, cx, cy) * side(ax, ay, cx, cy)
        return F.when(sides > 1e-12, 2 * F.abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / sides)

    means = rows.groupBy("process").agg(*[F.avg(bend(k)).alias(f"m{k}") for k in range(1, largest + 1)])
    m = lambda k: F.col(f"m{min(max(k, 1), largest)}")
    each = F.array(*[F.struct(F.lit(k).alias("lag"), F.round((m(k - 1) + m(k) + m(k + 1)) / 3, digits).alias("curvature")) for k in range(1, largest + 1)])
    return means.select("process", F.explode(each).alias("e")).select("process", "e.lag", "e.curvature")


def lags(largest: int, step: int = 1, least: int = 1, logarithmic: bool = False, points: int = 16) -> list[int]:
    """Candidate lags `step` apart, or a geometric grid whose lags are that far apart at least."""
    if not logarithmic:
        return list(range(least, largest + 1, max(step, 1)))
    top = max(largest, least)
    out: list[int] = []
    for k in range(points):
        lag = round(least * (top / least) ** (k / (points - 1)))
        if not out or lag - out[-1] >= max(step, 1):
            out.append(lag)
    return out


def candidate_lags(embeddings: DataFrame) -> DataFrame:
    """(process, lag) of a table of embeddings (process, max_lag, min_lag, tau, lag_step)."""
    step = F.greatest("tau", "lag_step", F.lit(1))
    return embeddings.where("max_lag >= min_lag").select("process", F.explode(F.sequence("min_lag", "max_lag", step)).alias("lag"))


def context_codes(symbols: DataFrame, chosen: list[int], alphabet: int) -> DataFrame:
    """The joint code of a process's symbols at the chosen lags, most significant first; rows without one of them go."""
    w = Window.partitionBy("trial", "process").orderBy("t")
    code = F.lit(0)
    for lag in chosen:
        code = code * alphabet + F.lag("code", lag).over(w)
    return symbols.select("trial", "t", "process", code.alias("context")).where("context is not null")


