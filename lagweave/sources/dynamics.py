"""Series with memory of their own: recursions in numpy, one repetition to a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def var_process(n: int, coefficients: np.ndarray, noise: float, rng: np.random.Generator, burn_in: int = 200) -> np.ndarray:
    """A vector autoregression; coefficients[lag - 1, target, source]."""
    lags, m, _ = coefficients.shape
    flat = np.concatenate(list(coefficients), axis=1)
    x = np.zeros((lags + burn_in + n, m))
    shocks = noise * rng.standard_normal(x.shape)
    for t in range(lags, len(x)):
        x[t] = flat @ x[t - lags : t][::-1].reshape(-1) + shocks[t]
    return x[-n:]


def coupled_maps(n: int, coupling: np.ndarray, step: Callable[[np.ndarray], np.ndarray], rng: np.random.Generator, burn_in: int = 200) -> np.ndarray:
    """Maps of the unit interval that take in a share of their sources' images; coupling[target, source] sums to 1 at most."""
    x = rng.random(len(coupling))
    own = 1 - coupling.sum(axis=1)
    out = np.empty((n, len(x)))
    for t in range(burn_in + n):
        image = step(x)
        x = np.clip(own * image + coupling @ image, 0, 1)
        if t >= burn_in:
            out[t - burn_in] = x
    return out


def logistic(x: np.ndarray, r: float = 4.0) -> np.ndarray:
    return r * x * (1 - x)


def tent(x: np.ndarray, slope: float = 1.99) -> np.ndarray:
    """A slope just below 2: at 2 binary fractions run out of digits."""
    return slope * np.minimum(x, 1 - x)


def lorenz96(n: int, m: int, rng: np.random.Generator, forcing: float = 10.0, dt: float = 0.1, substeps: int = 10, noise: float = 0.1, burn_in: int = 200) -> np.ndarray:
    """A ring of oscillators by fourth-order Runge-Kutta, with noise on what is observed."""
    h = dt / substeps
    slope = lambda v: (np.roll(v, -1) - np.roll(v, 2)) * np.roll(v, 1) - v + forcing
    x, out = forcing + rng.standard_normal(m), np.empty((n, m))
    for t in range(burn_in + n):
        for _ in range(substeps):
            a = slope(x)
            b = slope(x + h / 2 * a)
            c = slope(x + h / 2 * b)
            x = x + h / 6 * (a + 2 * b + 2 * c + slope(x + h * c))
        if t >= burn_in:
            out[t - burn_in] = x
    return out + noise * rng.standard_normal(out.shape)


def automaton(n: int, cells: int, rng: np.random.Generator, rule: int = 90, noise: float = 0.05) -> np.ndarray:
    """An elementary cellular automaton on a ring whose cells flip now and then."""
    table = np.array([rule >> k & 1 for k in range(8)])
    x, out = rng.integers(0, 2, cells), np.empty((n, cells), int)
    for t in range(n):
        x = table[4 * np.roll(x, 1) + 2 * x + np.roll(x, -1)] ^ (rng.random(cells) < noise)
        out[t] = x
    return out


def spiking(n: int, weights: np.ndarray, rng: np.random.Generator, delay: int = 1, baseline: float = 0.02, refractory: int = 2) -> np.ndarray:
    """Neurons that fire with a logistic probability of their inputs `delay` steps before, and stay silent after a spike; weights[target, source]."""
    m, base = len(weights), np.log(baseline / (1 - baseline))
    out, u = np.zeros((n, m), int), rng.random((n, m))
    for t in range(delay, n):
        fire = u[t] < 1 / (1 + np.exp(-(base + weights @ out[t - delay])))
        out[t] = fire & ~out[max(0, t - refractory) : t].any(axis=0)
    return out


def simulate(spark: SparkSession, make: Callable[[np.random.Generator], np.ndarray], repetitions: int = 1, seed: int = 0) -> DataFrame:
    """(trial, t, process, value) of make(generator), one repetition to a task, each with a generator of its own."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        k = int(f["id"].iloc[0])
        x = make(np.random.default_rng([seed, k]))
        n, m = x.shape
        return pd.DataFrame({"trial": k, "t": np.repeat(np.arange(n), m), "process": [f"p{j:02d}" for j in range(m)] * n, "value": x.reshape(-1).astype(float)})

    return spark.range(repetitions).groupBy("id").applyInPandas(run, "trial long, t long, process string, value double")
