"""Histograms of least description length (normalised maximum likelihood)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def regrets(n: int, most: int) -> list[float]:
    """Log of the multinomial normaliser for 1 to `most` bins and n samples, in nats; linear time in both."""
    if n == 0:
        return [0.0] * most
    h = np.arange(1, n)
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    inner = log_fact[n] - log_fact[h] - log_fact[n - h] + h * np.log(h / n) + (n - h) * np.log((n - h) / n)
    out = [0.0, math.log(2 + float(np.exp(inner).sum()))]
    for k in range(3, most + 1):
        out.append(out[-1] + math.log1p(n / (k - 2) * math.exp(out[-2] - out[-1])))
    return out[:most]


def cuts(values: np.ndarray, candidates: int = 48, most: int = 24) -> tuple[list[float], float]:
    """Inner cut points of the best histogram and its length in nats: candidate cuts lie midway between neighbouring values at quantiles, bins are chosen by dynamic programming."""
    x = np.sort(values[np.isfinite(values)])
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return [], 0.0
    at = np.unique(np.searchsorted(x, np.quantile(x, np.linspace(0, 1, candidates + 1)[1:-1]), side="right"))
    at = at[(at > 0) & (at < n)]
    place = np.unique(np.r_[x[0], (x[at - 1] + x[at]) / 2, x[-1]])
    below = np.r_[0, np.searchsorted(x, place[1:-1], side="right"), n]
    count, width = below[None, :] - below[:, None], np.maximum(place[None, :] - place[:, None], 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = np.where(count > 0, -count * np.log(count / (n * width)), 0.0)
    cost[np.tril_indices(len(place))] = np.inf
    best, back, inner = cost[0].copy(), [], len(place) - 2
    most = min(most, inner + 1)
    price = regrets(n, most)
    found = (best[-1], 1)
    for k in range(2, most + 1):
        tried = best[:, None] + cost
        back.append(tried.argmin(0))
        best = tried.min(0)
        length = best[-1] + price[k - 1] + math.lgamma(inner + 1) - math.lgamma(k) - math.lgamma(inner - k + 2)
        if length < found[0] - 1e-9:
            found = (length, k)
    out, j = [], len(place) - 1
    for step in reversed(back[: found[1] - 1]):
        j = int(step[j])
        out.append(float(place[j]))
    return out[::-1], float(found[0])


def histograms(series: DataFrame) -> DataFrame:
    """Cut points of each process. A task holds the values of one process."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        where, length = cuts(f["value"].to_numpy(float))
        return pd.DataFrame([{"process": f["process"].iloc[0], "bins": len(where) + 1, "cuts": where, "nats": length}])

    return series.select("process", "value").groupBy("process").applyInPandas(run, "process string, bins int, cuts array<double>, nats double")
