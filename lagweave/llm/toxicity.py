"""Toxicity by compression distance between two zstandard dictionaries.

Windows are single words with the space before them. One dictionary is trained
on ordinary windows, the other on the windows of toxic documents that contrast
with ordinary ones; a window whose compressed length is shorter under the toxic
dictionary by a calibrated margin is a hit. The score of a document is a
logistic function of its hits' number, gain and best share saved, and its length, fitted
on a held-back part of the sample.

Null and empty texts have no window and get the score of a document without
hits. Repeated rows are scored alike, each for itself. An id labelled both ways
is no example of either class; of rows that share a labelled id, every distinct
text is one. With fewer than six examples of either class every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import WORD, lent

#: Documents of each class at most from which the dictionaries and thresholds are learnt.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 2000, 5000
GRAM, DICT_BYTES, LEVEL, CACHE = 5, (16_384, 65_536), 6, 200_000
#: Stands after each window and at the end of both dictionaries: zstandard looks for no match in the last bytes of a block and stores short blocks as they are, so a bare word would never be compressed.
FRAME = bytes(range(1, 33)) + b"\n"
_word = re.compile(WORD)


def windows(text: str | None) -> list[bytes]:
    return [b" " + w.encode("utf-8", "replace") for w in _word.findall((text or "").lower())]


def _grams(words: Iterable[bytes]) -> set[bytes]:
    return {w[i : i + GRAM] for w in words for i in range(max(1, len(w) - GRAM + 1))}


def contrastive(toxic: list[list[bytes]], ordinary: list[list[bytes]], least: float = 0.01, ratio: float = 12.0) -> set[bytes]:
    """Byte runs in at least the share `least` of toxic documents and `ratio` times as often there as in ordinary ones."""
    seen, other = Counter(), Counter()
    for words in toxic:
        seen.update(_grams(set(words)))
    for words in ordinary:
        other.update(_grams(set(words)))
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    return {g for g, k in seen.items() if len(g) == GRAM and k >= max(3, least * n) and (k / n) >= ratio * (other[g] + 0.5) / m}


def distinct_texts(texts: list[str], size: int = 8, shared: int = 4) -> list[str]:
    """Texts without those that share at least `shared` of their `size` least word hashes with any one text kept before them: copies would lend their words false weight."""
    holders, out = defaultdict(list), []
    for text in texts:
        sketch = sorted({zlib.crc32(w) for w in set(windows(text)) if len(w) > 5})[:size]
        if max(Counter(k for h in sketch for k in holders[h]).values(), default=0) < shared:
            for h in sketch:
                holders[h].append(len(out))
            out.append(text)
    return out


def _dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where the trainer finds too little, the most frequent windows themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL)
    except zstandard.ZstdError:
        frequent = [w for w, _ in Counter(samples).most_common(2000)]
        return zstandard.ZstdCompressionDict(b"".join(reversed(frequent))[-size:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Model:
    """Two dictionaries, the margin in bytes of a hit, and the logistic weights; picklable."""

    def __init__(self, toxic: bytes, ordinary: bytes, margin: int = 2, share: float = 0.3, weights: tuple = (0.0, 0.0, 0.0, 0.0, -20.0)):
        self.toxic, self.ordinary, self.margin, self.share, self.weights = toxic, ordinary, margin, share, weights
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def forget(self) -> None:
        """Drop the compressors and the known gains; they are made again when next used."""
        self._ready = None

    def gain(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        if self._ready is None:
            pair = []
            for content in (self.ordinary + FRAME, self.toxic + FRAME):
                d = zstandard.ZstdCompressionDict(content)
                params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, min_match=4)
                pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
            self._ready = (*pair, {})
        ordinary, toxic, known = self._ready
        if (found := known.get(window)) is None:
            if len(known) >= CACHE:
                known.clear()
            found = len(ordinary(window + FRAME)) - len(toxic(window + FRAME))
            if len(window) <= 64:
                known[window] = found
        return found

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Of hits: their number and gain (logarithms), the best share of a window saved; and the text's length."""
        words, hits, total, best = windows(text), 0, 0, 0.0
        for w in words:
            if (g := self.gain(w)) >= self.margin and g >= self.share * len(w):
                hits += 1
                total += g
                best = max(best, g / len(w))
        return math.log1p(hits), math.log1p(total), best, math.log1p(len(words))

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, (*self.features(text), 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Newton steps for ridge logistic regression; the last column is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from two thirds of either class; margin and weights from the rest."""
    toxic, ordinary = distinct_texts(toxic), distinct_texts(ordinary)
    if len(toxic) < 6 or len(ordinary) < 6:
        return Model(b"\0" * 8, b"\0" * 8)
    t, o = [windows(x) for x in toxic], [windows(x) for x in ordinary]
    fit_t, fit_o = [x for k, x in enumerate(t) if k % 3], [x for k, x in enumerate(o) if k % 3]
    marks = contrastive(fit_t, fit_o)
    odd = [w for x in fit_t for w in x if len(w) >= GRAM and not marks.isdisjoint(_grams([w]))]
    plain = [w for x in fit_o for w in x]
    if not odd:
        return Model(b"\0" * 8, b"\0" * 8)
    sentences = [b"".join(plain[i : i + 12]) for i in range(0, len(plain), 12)]
    packs = [b"".join(odd[i : i + 6]) for i in range(0, len(odd), 6)]
    model = Model(_dictionary(packs * max(1, 300 // len(packs)), DICT_BYTES[0]).as_bytes(), _dictionary(sentences, DICT_BYTES[1]).as_bytes())
    held = [(x, 1) for x in toxic[::3]] + [(x, 0) for x in ordinary[::3]]
    y, best = np.array([k for _, k in held], float), None
    for margin, share in ((m, s) for m in (1, 2, 3) for s in (0.2, 0.27, 0.34, 0.42)):
        model.margin, model.share = margin, share
        x = np.array([(*model.features(a), 1.0) for a, _ in held])
        w = _logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        if best is None or loss < best[0]:
            best = (loss, margin, share, tuple(map(float, w)))
    model.margin, model.share, model.weights = best[1:]
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample: of each class the first labels in the order of a hash of the id, then the whole texts of these at most SAMPLE_TOXIC + SAMPLE_ORDINARY ids, which are broadcast; only sampled texts are shuffled."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    picked = [r for k, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)) for r in labels.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    ids = F.broadcast(docs.sparkSession.createDataFrame([(int(r.doc_id), int(r.toxic)) for r in picked], "doc_id long, toxic int"))
    found = docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id").distinct().collect()
    found.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.text))
    return train([r.text for r in found if r.toxic == 1], [r.text for r in found if r.toxic == 0])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row of `docs`; a narrow pass over whole texts."""
    found = docs.select("doc_id", _scored(model)(F.col("text")).alias("score"))
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(model: Model):
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in lent(batches, model.forget):
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Rows of `docs` that are not predicted toxic, all columns as they are; a narrow filter."""
    return docs.where(_scored(model)(F.col("text")) < threshold)
