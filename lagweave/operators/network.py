"""Networks of parents and flow layers: kernels dealt out by target."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.operators import kernels


def _matrix(f: pd.DataFrame, column: str = "codes") -> np.ndarray:
    return np.array(f.sort_values(["trial", "t"])[column].tolist())


def per_target(symbols: DataFrame, kernel, schema: str, value: str = "code") -> DataFrame:
    """Run kernel(matrix (steps, processes), names, target number), which returns rows, for every process, each in a task of its own. A task holds the aligned series once: steps times processes numbers."""
    names = [r.process for r in symbols.select("process").distinct().orderBy("process").collect()]
    wide = symbols.groupBy("trial", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("process", value))), lambda s: s[value]).alias("codes")).where(F.size("codes") == len(names))
    dealt = wide.withColumn("target", F.explode(F.array(*[F.lit(k) for k in range(len(names))])))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = kernel(_matrix(f), names, int(f["target"].iloc[0]))
        return pd.DataFrame(rows, columns=columns, dtype=None if rows else object)

    columns = [c.split()[0] for c in schema.split(", ")]
    return dealt.groupBy("target").applyInPandas(run, schema)


def infer(symbols: DataFrame, max_lag: int = 3, n_perm: int = 100, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Parents of every process, with the layers of each edge given the target's past and its other parents. Seeds depend on the target's name alone."""

    def kernel(codes: np.ndarray, names: list[str], target: int):
        own_seed = seed + zlib.crc32(names[target].encode())
        found = kernels.select_parents(codes, target, max_lag, n_perm, alpha, own_seed)
        out = []
        y = codes[max_lag:, target]
        for p in sorted({v[0] for v in found["sources"]}):
            own = [v for v in found["sources"] if v[0] == p]
            rest = found["past"] + [v for v in found["sources"] if v[0] != p]
            x = kernels.dense(*[kernels.lagged(codes, v, max_lag) for v in own])
            w = kernels.dense(*[kernels.lagged(codes, v, max_lag) for v in rest]) if rest else np.zeros(len(y), np.int64)
            split = kernels.layers(kernels.joint(y, x, w), seed=own_seed)
            out.append({"source": names[p], "target": names[target], "lags": sorted(v[1] for v in own), "p": max(found["p"][v] for v in own), "omnibus_p": found["omnibus_p"], **split})
        return out

    return per_target(symbols, kernel, "source string, target string, lags array<int>, p double, omnibus_p double, te double, tdmi double, intrinsic double, synergistic double, shared double")


def edge_tests(pairs: DataFrame, n_perm: int = 100, n_boot: int = 50, seed: int = 0) -> DataFrame:
    """Permutation p value and bootstrap interval of the transfer entropy of each edge (source, target, lag)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["trial", "t"])
        y, x, w = (f[c].to_numpy(np.int64) for c in ("y", "x", "w"))
        own = seed + zlib.crc32(f"{f['source'].iloc[0]}>{f['target'].iloc[0]}".encode())
        te, p = kernels.permutation_test(y, x, w, n_perm, own)
        low, high = kernels.bootstrap_interval(y, x, w, n_boot, own)
        return pd.DataFrame({"source": [f["source"].iloc[0]], "target": [f["target"].iloc[0]], "lag": [f["lag"].iloc[0]], "te": [te], "p": [p], "ci_low": [low], "ci_high": [high]})

    return pairs.groupBy("source", "target", "lag").applyInPandas(run, "source string, target string, lag int, te double, p double, ci_low double, ci_high double")
