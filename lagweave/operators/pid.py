"""Partial information decomposition of two sources about a target, from joint count tables.

A grouped task holds one table of counts, whose size depends on the alphabets
and not on the length of the series; the null tables are drawn from its margins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.operators.kernels import upper_p


def information(p: np.ndarray) -> np.ndarray:
    """Mutual information in bits of joint laws p[..., y, x]."""
    with np.errstate(divide="ignore", invalid="ignore"):
        t = p * np.log2(p / (p.sum(-1, keepdims=True) * p.sum(-2, keepdims=True)))
    return np.maximum(0.0, np.where(p > 0, t, 0.0).sum((-2, -1)))


def _flat(p: np.ndarray) -> np.ndarray:
    return p.reshape(*p.shape[:-2], -1)


def least_mutual(p: np.ndarray) -> np.ndarray:
    """Redundancy as the smaller of both single informations (MMI)."""
    return np.minimum(information(p.sum(-1)), information(p.sum(-2)))


def least_specific(p: np.ndarray) -> np.ndarray:
    """Redundancy of Williams and Beer: for each target value the smaller specific information, averaged."""
    py = p.sum((-2, -1))
    out = []
    for q in (p.sum(-1), p.sum(-2)):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = q * np.log2(q / (py[..., None] * q.sum(-2, keepdims=True)))
        out.append(np.where(q > 0, t, 0.0).sum(-1))
    return np.maximum(0.0, np.minimum(*out).sum(-1))


def least_joint(p: np.ndarray, rounds: int = 400, rate: float = 0.5, tol: float = 1e-9) -> np.ndarray:
    """Redundancy of Bertschinger et al. (BROJA): the joint information is minimised over all laws with the same two (target, source) margins, by mirror descent; each step is brought back to the margins by proportional fitting, one target value at a time. All laws of a stack advance together."""
    a, b = p.sum(-1), p.sum(-2)
    q = a[..., :, None] * b[..., None, :] / np.maximum(p.sum((-2, -1)), 1e-300)[..., None, None]
    best = last = information(_flat(q))
    for _ in range(rounds):
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(q > 0, np.log(q / q.sum(-3, keepdims=True)), 0.0)
        q = q * np.exp(-rate * slope)
        for _ in range(50):
            q *= (a / np.maximum(q.sum(-1), 1e-300))[..., :, None]
            q *= (b / np.maximum(q.sum(-2), 1e-300))[..., None, :]
            if np.abs(q.sum(-1) - a).max() < 1e-10:
                break
        now = information(_flat(q))
        best = np.minimum(best, now)
        if np.abs(last - now).max() < tol:
            break
        last = now
    return np.maximum(0.0, information(a) + information(b) - best)


REDUNDANCY = {"mmi": least_mutual, "wb": least_specific, "broja": least_joint}


def parts(p: np.ndarray, measure: str = "broja") -> dict[str, np.ndarray]:
    """The four parts and their total, of one law p[y, x1, x2] or a stack of them."""
    r = REDUNDANCY[measure](p)
    one, two, total = information(p.sum(-1)), information(p.sum(-2)), information(_flat(p))
    return {"redundancy": r, "unique1": one - r, "unique2": two - r, "synergy": total - one - two + r, "total": total}


def without_interaction(n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A table with the same (target, source) margins in which, given the target, the sources are paired at random."""
    out = np.zeros_like(n)
    for y, cells in enumerate(n):
        left = cells.sum(0)
        for x, size in enumerate(cells.sum(1)):
            out[y, x] = rng.multivariate_hypergeometric(left, size, method="marginals") if size else 0
            left = left - out[y, x]
    return out


def synergy_test(n: np.ndarray, measure: str = "broja", draws: int = 99, seed: int = 0) -> float:
    """p value of the synergy against tables without interaction; 1 without draws."""
    if not draws:
        return 1.0
    rng = np.random.default_rng(seed)
    null = np.stack([without_interaction(n, rng) for _ in range(draws)])
    return upper_p(parts(null / n.sum(), measure)["synergy"], float(parts(n / n.sum(), measure)["synergy"]), tol=1e-7)


def kind(total: str = "total") -> Column:
    """The part that is over half of the total, else mixed; none without information."""
    t = F.col(total)
    return F.when(t <= 1e-9, "none").when(F.col("synergy") > t / 2, "synergistic").when(F.col("redundancy") > t / 2, "redundant").when(F.greatest("unique1", "unique2") > t / 2, "unique").otherwise("mixed")


def hyperedges(cells: DataFrame, measure: str = "broja", draws: int = 49, seed: int = 0) -> DataFrame:
    """Decomposition of each (source1, source2, target) from counts n of (y, x1, x2), with a p value of the synergy."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at = [np.unique(f[c], return_inverse=True)[1] for c in ("y", "x1", "x2")]
        n = np.zeros([int(a.max()) + 1 for a in at], np.int64)
        np.add.at(n, tuple(at), f["n"].to_numpy())
        key = {c: f[c].iloc[0] for c in ("source1", "source2", "target")}
        own = seed + zlib.crc32("+".join(key.values()).encode())
        return pd.DataFrame([key | {k: float(v) for k, v in parts(n / n.sum(), measure).items()} | {"p": synergy_test(n, measure, draws, own)}])

    schema = "source1 string, source2 string, target string, redundancy double, unique1 double, unique2 double, synergy double, total double, p double"
    return cells.groupBy("source1", "source2", "target").applyInPandas(run, schema).withColumn("kind", kind())


def hypergraph(edges: DataFrame, key: str = "h") -> DataFrame:
    """Bipartite arcs: from each source to its hyperedge, from the hyperedge to its target."""
    named = edges.withColumn(key, F.concat_ws("+", "source1", "source2"))
    into = named.select(F.explode(F.array("source1", "source2")).alias("tail"), F.concat_ws(">", key, "target").alias("head"))
    return into.unionByName(named.select(F.concat_ws(">", key, "target").alias("tail"), F.col("target").alias("head")))
