"""Language identification by a byte convolutional network, trained and run in numpy.

A text is cut into fixed windows of bytes, the last padded with zeros. Byte
embeddings pass through filters of several widths, a maximum over each window
and a softmax; a document's distribution is the mean of its windows' ones,
weighted by their letters' bytes. Texts that are null or have no letter are
`und` with score 0; so is every text where nothing labelled was given. Ties go
to the language first in order. Repeated rows are predicted each for itself.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the network is fitted on, in expectation, and the share of them that any language has at least.
SAMPLE_ROWS, LEAST_ROWS = 6000, 20
WINDOW, EMBED, WIDTHS, FILTERS, BATCH = 256, 8, (2, 3, 4, 5), 8, 256
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]")
_letters = np.array([chr(k).isalpha() or k >= 128 for k in range(256)], np.float32)


class Network:
    """Embedding, filters (one matrix, narrow widths padded with zeros), and the softmax layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS), len(WIDTHS) * FILTERS
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((wide, EMBED, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(wide * EMBED, n)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.dense = rng.normal(0, 0.1, (n, len(classes))).astype(np.float32)
        self.shift = np.zeros(len(classes), np.float32)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Every run of the widest filter's length, flattened: (windows, places, width * embedding)."""
        e = np.ascontiguousarray(self.embed[windows]).reshape(len(windows), -1)
        wide = max(WIDTHS)
        places = windows.shape[1] - wide + 1
        return np.lib.stride_tricks.as_strided(e, (len(windows), places, wide * EMBED), (e.strides[0], 4 * EMBED, 4))

    def pooled(self, windows: np.ndarray, where: bool = False):
        cols = self.columns(windows)
        flat = np.ascontiguousarray(cols).reshape(-1, cols.shape[2]) @ self.filters
        act = flat.reshape(len(windows), -1, flat.shape[1])
        if not where:
            return np.maximum(act.max(axis=1) + self.bias, 0)
        at = act.argmax(axis=1)
        top = np.take_along_axis(act, at[:, None], 1)[:, 0] + self.bias
        return np.maximum(top, 0), at, cols

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.dense + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of windows x with labels y; the maximum lets a gradient through at one place of each filter."""
        row = np.arange(len(x))
        top, at, cols = self.pooled(x, where=True)
        z = top @ self.dense + self.shift
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[row, y] -= 1
        p /= len(x)
        g = {"dense": top.T @ p, "shift": p.sum(0)}
        back = (p @ self.dense.T) * (top > 0)
        g["bias"] = back.sum(0)
        chosen = cols[row[:, None], at]
        g["filters"] = np.einsum("bn,bnd->dn", back, chosen) * self.mask
        into = back[:, :, None] * self.filters.T[None]
        g["embed"] = np.zeros_like(self.embed)
        for w in range(max(WIDTHS)):
            np.add.at(g["embed"], x[row[:, None], at + w], into[:, :, w * EMBED : (w + 1) * EMBED])
        g["embed"][0] = 0
        return g

    def fit(self, windows: np.ndarray, labels: np.ndarray, texts: np.ndarray, steps: int = 700, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> None:
        """Adam on cross entropy. A step draws languages, then texts of each, then windows of these, so that neither frequent languages nor long texts weigh more."""
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "dense", "shift")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        first = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]])
        count = np.diff(np.r_[first, len(texts)])
        by_class = [np.flatnonzero(labels[first] == k) for k in range(len(self.classes))]
        for step in range(1, steps + 1):
            drawn = np.array([rng.choice(by_class[k]) for k in rng.integers(0, len(self.classes), batch)])
            pick = first[drawn] + (rng.random(batch) * count[drawn]).astype(int)
            g = self.gradients(windows[pick], labels[pick])
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                update = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                setattr(self, k, (getattr(self, k) - update).astype(np.float32))


def cut_windows(text: str) -> np.ndarray:
    """All bytes of a text in rows of WINDOW, the last padded with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


def train(texts: list[str], langs: list[str]) -> Network | None:
    classes = sorted(set(langs))
    if not classes:
        return None
    net = Network(classes)
    parts = [cut_windows(t) for t in texts]
    number = {x: k for k, x in enumerate(classes)}
    sizes = [len(p) for p in parts]
    labels, owner, windows = np.repeat([number[x] for x in langs], sizes), np.repeat(np.arange(len(parts)), sizes), np.concatenate(parts)
    useful = _letters[windows].sum(axis=1) > 20
    if useful.any() and set(labels[useful]) == set(labels):
        windows, labels, owner = windows[useful], labels[useful], owner[useful]
    if len(classes) > 1:
        net.fit(windows, labels, owner)
    return net


def learn(labelled: DataFrame) -> Network | None:
    """Fit on whole texts of a bounded sample of rows (doc_id, text, lang): about an equal share of each language, by a hash of id and text; rows alike count once. Every language is an output of the network, so their list must fit on the driver."""
    rows = labelled.where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("_h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = max(LEAST_ROWS, SAMPLE_ROWS / max(1, len(counts)))
    # a row is taken if its hash lies below its language's share: about SAMPLE_ROWS rows of whatever table
    chosen = rows.where("false")
    if counts:
        below = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, share / n)))])
        chosen = rows.where(F.col("_h") < F.try_element_at(below, F.col("lang")) * (1 << 30))
    found = sorted((r.lang, r.text) for r in chosen.select("lang", "text").distinct().collect())
    return train([t for _, t in found], [k for k, _ in found])


def predict_texts(net: Network | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability) of each text, its windows run through the network in batches."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    todo = [k for k, t in enumerate(texts) if t and _letter.search(t)] if net else []
    rows, owner, held = [], [], 0
    sums = {k: np.zeros(len(net.classes)) for k in todo} if net else {}

    def flush() -> None:
        nonlocal rows, owner, held
        if not rows:
            return
        windows, ids = np.concatenate(rows), np.concatenate(owner)
        for i in range(0, len(windows), BATCH):
            w = windows[i : i + BATCH]
            p = net.probabilities(w) * (_letters[w].sum(axis=1, keepdims=True) + 1e-3)
            for k, x in zip(ids[i : i + BATCH], p, strict=True):
                sums[k] += x
        rows, owner, held = [], [], 0

    for k in todo:
        w = cut_windows(texts[k])
        rows.append(w)
        owner.append(np.full(len(w), k))
        held += len(w)
        if held >= 8 * BATCH:
            flush()
    flush()
    for k in todo:
        p = sums[k] / max(sums[k].sum(), 1e-12)
        best = int(p.argmax())
        out[k] = (net.classes[best], float(min(1.0, p[best])))
    return out


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row; a narrow pass over whole texts."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [x for i in range(0, len(texts), 256) for x in predict_texts(net, [t if isinstance(t, str) else None for t in texts.iloc[i : i + 256]])]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.lang_pred", "r.score")
