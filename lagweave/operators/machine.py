"""Epsilon machines: causal states of a symbol process from its word counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words(symbols: DataFrame, length: int) -> DataFrame:
    """Counts n of all words of `length` symbols, as (process, word array<int>), within trials and without gaps."""
    order = Window.partitionBy("trial", "process").orderBy("t")
    rows = symbols.select("process", "t", F.lag("t", length - 1).over(order).alias("t0"), F.array(*[F.lag("code", k).over(order) for k in range(length - 1, -1, -1)]).alias("word"))
    return rows.where(F.col("t") - F.col("t0") == length - 1).groupBy("process", "word").agg(F.count(F.lit(1)).alias("n"))


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-squared law: the incomplete gamma function by its series, or its continued fraction."""
    a, z = dof / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - front * total)
    f = 0.0
    for k in range(200, 0, -1):
        f = k * (k - a) / (z + 2 * k + 1 - a - f)
    return min(1.0, front / (z + 1 - a - f))


def g_test(a: np.ndarray, b: np.ndarray) -> float:
    """p value that two rows of counts share one law."""
    n = np.stack([a, b])
    n = n[:, n.sum(0) > 0]
    expected = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * float(np.nansum(np.where(n > 0, n * np.log(n / expected), 0.0)))
    return chi2_sf(g, max(1, n.shape[1] - 1)) if n.shape[1] > 1 else 1.0


def states(table: dict[tuple[int, ...], np.ndarray], alpha: float = 0.001) -> dict[tuple[int, ...], int]:
    """Merge histories whose next symbol has one law, then split states until a symbol leads from each to one state only.

    `table` holds the counts of the next symbol after each history of one length.
    """
    pools: list[np.ndarray] = []
    of: dict[tuple[int, ...], int] = {}
    for h in sorted(table, key=lambda h: (-table[h].sum(), h)):
        fits = [(g_test(table[h], p), k) for k, p in enumerate(pools)]
        p, k = max(fits, default=(-1.0, -1))
        if p > alpha:
            pools[k] = pools[k] + table[h]
        else:
            k = len(pools)
            pools.append(table[h])
        of[h] = k
    while True:
        # a successor that was never seen as a history leaves the question open
        leads = {h: (of[h], tuple(of.get((*h[1:], a), -1) if table[h][a] else -1 for a in range(len(table[h])))) for h in table}
        votes: dict[int, list[tuple]] = {}
        split = {}
        for h in sorted(table, key=lambda h: (-table[h].sum(), h)):
            state, to = leads[h]
            for k, seen in enumerate(votes.setdefault(state, [])):
                if all(x == y or -1 in (x, y) for x, y in zip(to, seen, strict=True)):
                    votes[state][k] = tuple(max(x, y) for x, y in zip(to, seen, strict=True))
                    split[h] = (state, k)
                    break
            else:
                votes[state].append(to)
                split[h] = (state, len(votes[state]) - 1)
        if len(set(split.values())) == len(set(of.values())):
            return of
        number = {s: k for k, s in enumerate(dict.fromkeys(split.values()))}
        of = {h: number[s] for h, s in split.items()}


def entropy(n: np.ndarray) -> float:
    p = n[n > 0] / n.sum()
    return max(0.0, -float((p * np.log2(p)).sum()))


def measures(table: dict[tuple[int, ...], np.ndarray], alpha: float = 0.001) -> dict[str, float]:
    """Number of states, statistical complexity, entropy rate given the state, and excess entropy from blocks, in bits."""
    of = states(table, alpha)
    rows = np.zeros((max(of.values()) + 1, len(next(iter(table.values())))))
    for h, k in of.items():
        rows[k] += table[h]
    rate = sum(r.sum() * entropy(r) for r in rows) / rows.sum()
    length, blocks = len(next(iter(table))), np.array([c.sum() for c in table.values()])
    return {"states": len(rows), "complexity": entropy(rows.sum(1)), "rate": float(rate), "excess": max(0.0, entropy(blocks) - length * float(rate))}


def machines(symbols: DataFrame, history: int = 3, alpha: float = 0.001) -> DataFrame:
    """The machine of each process; a task holds the word counts of one, at most alphabet ** (history + 1) rows."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        seen = [tuple(w) for w in f["word"]]
        size = max(max(w) for w in seen) + 1
        table: dict[tuple[int, ...], np.ndarray] = {}
        for w, n in zip(seen, f["n"], strict=True):
            table.setdefault(w[:-1], np.zeros(size))[w[-1]] += n
        return pd.DataFrame([{"process": f["process"].iloc[0], **measures(table, alpha)}])

    return words(symbols, history + 1).groupBy("process").applyInPandas(run, "process string, states int, complexity double, rate double, excess double")
