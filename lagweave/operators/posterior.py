"""Flow layers under a Dirichlet posterior of the joint law of (y, x, w)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.operators.kernels import layers

PARTS = ("te", "tdmi", "intrinsic", "synergistic", "shared")


def draws(n: np.ndarray, size: int = 40, prior: float = 0.5, seed: int = 0) -> dict[str, np.ndarray]:
    """Layers of `size` joint laws drawn given counts n[y, x, w], each cell with the same prior weight."""
    rng = np.random.default_rng(seed)
    laws = rng.dirichlet((n + prior).reshape(-1), size).reshape(size, *n.shape)
    found = [layers(p, restarts=1, steps=80, seed=seed + k) for k, p in enumerate(laws)]
    return {k: np.array([f[k] for f in found]) for k in PARTS}


def dominance(intrinsic: str = "intrinsic_mean", shared: str = "shared_mean") -> Column:
    """Whether shared information is at least twice the intrinsic flow."""
    return (F.col(shared) >= 2 * F.col(intrinsic)) & (F.col(shared) > 1e-9)


def layer_posterior(cells: DataFrame, size: int = 40, prior: float = 0.5, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Mean and equal-tailed interval of each layer of each edge, from counts n of (y, x, w); a task holds the cells of one edge."""
    names = [f"{k}_{end}" for k in PARTS for end in ("mean", "low", "high")]
    tails = [(1 - confidence) / 2, (1 + confidence) / 2]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at = [np.unique(f[c], return_inverse=True)[1] for c in ("y", "x", "w")]
        n = np.zeros([int(a.max()) + 1 for a in at])
        np.add.at(n, tuple(at), f["n"].to_numpy())
        source, target = f["source"].iloc[0], f["target"].iloc[0]
        drawn = draws(n, size, prior, seed + zlib.crc32(f"{source}>{target}".encode()))
        values = [float(v) for k in PARTS for v in (drawn[k].mean(), *np.quantile(drawn[k], tails))]
        return pd.DataFrame([[source, target, int(n.sum()), *values]], columns=["source", "target", "N", *names])

    schema = "source string, target string, N long, " + ", ".join(f"{k} double" for k in names)
    return cells.groupBy("source", "target").applyInPandas(run, schema).withColumn("shared_dominant", dominance())
