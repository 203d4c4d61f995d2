"""Numerical kernels in numpy, each run for one target or edge in a grouped task."""

from __future__ import annotations

import math

import numpy as np


def dense(*columns: np.ndarray) -> np.ndarray:
    """One code for each distinct row of the columns."""
    if not columns:
        return np.zeros(0, np.int64)
    return np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)[1].reshape(-1)


def _entropy(code: np.ndarray) -> float:
    n = np.bincount(code)
    n = n[n > 0]
    return math.log2(len(code)) - float((n * np.log2(n)).sum()) / len(code)


def cmi(y: np.ndarray, x: np.ndarray, z: np.ndarray) -> float:
    """Plug-in I[y : x | z] in bits of codes, not below 0."""
    kx, kz = int(x.max()) + 1, int(z.max()) + 1
    xz, yz = x * kz + z, y * kz + z
    return max(0.0, _entropy(yz) + _entropy(xz) - _entropy(yz * kx + x) - _entropy(z))


def strata(z: np.ndarray) -> list[np.ndarray]:
    """The rows of each code of z that has two or more."""
    ends = np.cumsum(np.bincount(z))[:-1]
    return [rows for rows in np.split(np.argsort(z, kind="stable"), ends) if len(rows) > 1]


def shuffled(y: np.ndarray, groups: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """y with the values of each group of rows dealt out anew among them."""
    out = y.copy()
    for rows in groups:
        out[rows] = rng.permutation(y[rows])
    return out


def exceeds(value: float, null, n_perm: int, alpha: float, tol: float = 1e-12) -> float | None:
    """The p value of a statistic against draws null(), or None as soon as it can't be alpha or less."""
    above = 0
    for _ in range(n_perm):
        above += null() >= value - tol
        if 1 + above > alpha * (1 + n_perm):
            return None
    return (1 + above) / (1 + n_perm)


def upper_p(null: np.ndarray, value: float, tol: float = 1e-12) -> float:
    return (1 + int((np.asarray(null) >= value - tol).sum())) / (1 + len(null))


def permutation_test(y: np.ndarray, x: np.ndarray, z: np.ndarray, n_perm: int, seed: int) -> tuple[float, float]:
    """The conditional mutual information and its p value under permutations within strata."""
    rng = np.random.default_rng(seed)
    v, groups = cmi(y, x, z), strata(z)
    return v, upper_p([cmi(shuffled(y, groups, rng), x, z) for _ in range(n_perm)], v)


def bootstrap_interval(y: np.ndarray, x: np.ndarray, z: np.ndarray, n_boot: int, seed: int, block: float | None = None, confidence: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the stationary bootstrap of aligned rows: blocks of geometric length, the cube root of their number in the mean."""
    rng, n, values = np.random.default_rng(seed), len(y), []
    block = block or max(1.0, n ** (1 / 3))
    for _ in range(n_boot):
        new = rng.random(n) < 1 / block
        new[0] = True
        start = rng.integers(0, n, n)
        run = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        at = (start[run] + np.arange(n) - run) % n
        values.append(cmi(y[at], x[at], z[at]))
    lo, hi = np.quantile(values, [(1 - confidence) / 2, (1 + confidence) / 2])
    return float(lo), float(hi)


def lagged(codes: np.ndarray, variable: tuple[int, int], start: int) -> np.ndarray:
    """The past of a (process, lag) at each step from `start` on."""
    p, lag = variable
    return codes[start - lag : len(codes) - lag, p]


#: Rounds of single sources and pairs.
ROUNDS = 4


def select_parents(codes: np.ndarray, target: int, max_lag: int = 3, n_perm: int = 100, alpha: float = 0.05, seed: int = 0) -> dict:
    """Greedy forward selection of own past, then of sources, by the maximum statistic. Where no single source is left, all pairs of the rest are tested together, so that sources that tell something only jointly are found; up to ROUNDS times. Then backward elimination and an omnibus test."""
    rng = np.random.default_rng(seed)
    y = codes[max_lag:, target]
    columns = {(p, lag): lagged(codes, (p, lag), max_lag) for p in range(codes.shape[1]) for lag in range(1, max_lag + 1)}
    zero = np.zeros(len(y), np.int64)
    context = lambda vs: dense(*[columns[v] for v in vs]) if vs else zero

    def grow(candidates: list, chosen: list) -> list:
        chosen = list(chosen)
        while rest := [c for c in candidates if c not in chosen]:
            best = strongest([(c,) for c in rest], chosen)
            if best is None:
                break
            chosen.extend(best)
        return chosen

    def strongest(groups: list[tuple], chosen: list) -> tuple | None:
        """The group of candidates that tells most about y given `chosen`, if the maximum over all groups is significant."""
        z = context(chosen)
        codes, rows = [context(list(g)) for g in groups], strata(z)
        values = [cmi(y, x, z) for x in codes]

        def null() -> float:
            s = shuffled(y, rows, rng)
            return max(cmi(s, x, z) for x in codes)

        best = int(np.argmax(values))
        return None if exceeds(values[best], null, n_perm, alpha) is None else groups[best]

    own = grow([(target, lag) for lag in range(1, max_lag + 1)], [])
    others, kept = [v for v in columns if v[0] != target], list(own)
    for _ in range(ROUNDS):
        kept = grow(others, kept)
        rest = [v for v in columns if v not in kept]
        pairs = [(a, b) for k, a in enumerate(rest) for b in rest[k + 1 :] if a[0] != target or b[0] != target]
        joint_pair = strongest(pairs, kept) if pairs else None
        if joint_pair is None:
            break
        kept += joint_pair
    own, sources, p_of = [v for v in kept if v[0] == target], [v for v in kept if v[0] != target], {}
    for v in list(sources):
        z = context([u for u in own + sources if u != v])
        value, rows = cmi(y, columns[v], z), strata(z)
        p = upper_p([cmi(shuffled(y, rows, rng), columns[v], z) for _ in range(n_perm)], value)
        if p > alpha:
            sources.remove(v)
        else:
            p_of[v] = p
    omnibus = (0.0, 1.0)
    if sources:
        omnibus = permutation_test(y, context(sources), context(own), n_perm, int(rng.integers(1 << 31)))
    return {"past": own, "sources": sources, "p": p_of, "omnibus": omnibus[0], "omnibus_p": omnibus[1]}


def joint(y: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    p = np.zeros((int(y.max()) + 1, int(x.max()) + 1, int(w.max()) + 1))
    np.add.at(p, (y, x, w), 1)
    return p / p.sum()


class Garbled:
    """I[Y : X | Z] as a function of a channel from W to Z: four sums of m log2 m over tables that are linear in the channel, so the gradient is each table's own transpose applied to its logarithms."""

    def __init__(self, p: np.ndarray):
        w = p.shape[2]
        self.tables = [(p.reshape(-1, w), 1), (p.sum(1), -1), (p.sum(0), -1), (p.sum((0, 1))[None], 1)]

    def __call__(self, channel: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = 0.0, np.zeros_like(channel)
        for table, sign in self.tables:
            m = table @ channel
            log = np.log2(np.where(m > 1e-300, m, 1.0))
            value += sign * float((m * log).sum())
            slope += sign * (table.T @ log)
        return value, slope

    def at(self, logits: np.ndarray) -> tuple[float, np.ndarray]:
        """The value for the channel with these logits, and the gradient on the probability simplex, mapped to them."""
        log_channel = logits - np.logaddexp.reduce(logits, axis=1)[:, None]
        channel = np.exp(log_channel)
        value, slope = self(channel)
        return value, channel * (slope - np.einsum("wz,wz->w", channel, slope)[:, None])


def mutual(p: np.ndarray) -> float:
    """I[Y : X | W] of a joint p[y, x, w]."""
    a, b, c = p.sum(1, keepdims=True), p.sum(0, keepdims=True), p.sum((0, 1), keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = p * np.log2(p * c / (a * b))
    return float(np.nansum(np.where(p > 0, t, 0.0)))


def layers(p: np.ndarray, bound: int | None = None, restarts: int = 3, steps: int = 250, rate: float = 0.2, seed: int = 0) -> dict[str, float]:
    """Transfer entropy split into intrinsic and synergistic flow, time-delayed information into intrinsic and shared: the intrinsic part is the least information over all garblings of the context."""
    te, tdmi = mutual(p), mutual(p.sum(2, keepdims=True))
    rng, n, garbled = np.random.default_rng(seed), p.shape[2], Garbled(p)
    best, size = min(te, tdmi), min(n, bound or n)
    for _ in range(restarts if n > 1 else 0):
        theta = rng.normal(0, 2.0, (n, size))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            value, g = garbled.at(theta)
            best = min(best, value)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    best = max(0.0, best)
    return {"te": te, "tdmi": tdmi, "intrinsic": best, "synergistic": te - best, "shared": tdmi - best}


def psi(n: np.ndarray) -> np.ndarray:
    """Digamma at positive numbers."""
    x = np.asarray(n, float) + 8
    out = np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    for k in range(8):
        out -= 1 / (x - 8 + k)
    return out


class Sorted:
    """Points in the order of their first coordinate: whatever lies within a distance of a point, in the maximum norm, lies in one stretch of it."""

    def __init__(self, points: np.ndarray):
        self.order = np.argsort(points[:, 0], kind="stable")
        self.points = points[self.order]
        self.first = self.points[:, 0]

    def neighbour(self, k: int, chunk: int = 128) -> np.ndarray:
        """The distance of each point from its k-th neighbour: the stretch around a chunk is doubled until no point beyond it can be nearer."""
        n, out = len(self.points), np.empty(len(self.points))
        for a in range(0, n, chunk):
            b, reach = min(n, a + chunk), 4 * chunk
            while True:
                low, high = max(0, a - reach), min(n, b + reach)
                d = np.zeros((b - a, high - low))
                for c in self.points.T:
                    np.maximum(d, np.abs(c[a:b, None] - c[None, low:high]), out=d)
                radius = np.partition(d, k, axis=1)[:, k]
                free = np.minimum(self.first[a:b] - (self.first[low - 1] if low else -np.inf), (self.first[high] if high < n else np.inf) - self.first[a:b])
                if (radius <= free).all():
                    break
                reach *= 2
            out[self.order[a:b]] = radius
        return out

    def within(self, radius: np.ndarray, chunk: int = 128) -> np.ndarray:
        """How many points, itself among them, are nearer to each point than its radius."""
        r, out = radius[self.order], np.empty(len(radius), np.int64)
        if self.points.shape[1] == 1:  # sums and differences may round ties differently, which jittered values don't have
            out[self.order] = np.maximum(np.searchsorted(self.first, self.first + r, side="left") - np.searchsorted(self.first, self.first - r, side="right"), 1)
            return out
        wide = r * (1 + 1e-9)
        low, high = np.searchsorted(self.first, self.first - wide, side="left"), np.searchsorted(self.first, self.first + wide, side="right")
        for a in range(0, len(r), chunk):
            s = slice(a, a + chunk)
            lo, hi = int(low[s].min()), int(high[s].max())
            near = np.ones((len(r[s]), hi - lo), bool)
            for c in self.points.T:
                near &= np.abs(c[s, None] - c[None, lo:hi]) < r[s, None]
            out[self.order[s]] = np.maximum(near.sum(axis=1), 1)
        return out


def ksg(x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None, k: int = 4) -> float:
    """Nearest-neighbour (conditional) mutual information in bits: maximum norm, neighbours nearer than the k-th one counted, the point among them; may be negative."""
    x, y = (np.asarray(c, float).reshape(len(c), -1) for c in (x, y))
    z = np.empty((len(x), 0)) if z is None else np.asarray(z, float).reshape(len(x), -1)
    radius = Sorted(np.hstack([x, y, z])).neighbour(k)
    inner = psi(Sorted(z).within(radius)) if z.shape[1] else psi(np.full(len(x), len(x)))
    sides = sum(psi(Sorted(np.hstack([c, z])).within(radius)) for c in (x, y))
    return float((psi(k) + np.mean(inner - sides)) / math.log(2))


def capacity(q: np.ndarray, rounds: int = 500, tol: float = 1e-10) -> float:
    """Capacity in bits of a channel q[x, y] by Blahut and Arimoto."""
    r = np.full(len(q), 1 / len(q))
    for _ in range(rounds):
        out = r @ q
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(q > 0, q * np.log2(q / out), 0.0).sum(axis=1)
        new = r * 2**d
        low, high = math.log2(new.sum()), d.max()
        r = new / new.sum()
        if high - low < tol:
            break
    return float(low)


def coherence(a: np.ndarray, b: np.ndarray, size: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and magnitude-squared coherence: Welch segments, Hann window, half overlap, means removed."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(a) - size + 1, size // 2)
    fa, fb = (np.array([np.fft.rfft(w * (s[i : i + size] - s[i : i + size].mean())) for i in starts]) for s in (a, b))
    cross = (fa * fb.conj()).mean(0)
    return np.fft.rfftfreq(size), np.abs(cross) ** 2 / np.maximum((np.abs(fa) ** 2).mean(0) * (np.abs(fb) ** 2).mean(0), 1e-300)


def granger(series: np.ndarray, target: int, source: int, lags: int = 2) -> tuple[float, float]:
    """Transfer entropy in bits of a linear autoregression, and its F statistic, the source's lags left out or not."""
    y = series[lags:, target]
    full = np.column_stack([np.ones(len(y))] + [series[lags - k : len(series) - k, p] for p in range(series.shape[1]) for k in range(1, lags + 1)])
    keep = [0] + [1 + p * lags + k for p in range(series.shape[1]) if p != source for k in range(lags)]
    rss = [float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum()) for m in (full, full[:, keep])]
    dof = len(y) - full.shape[1]
    return 0.5 * math.log2(rss[1] / rss[0]), (rss[1] - rss[0]) / lags / (rss[0] / dof)
