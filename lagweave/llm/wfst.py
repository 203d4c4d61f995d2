"""SentencePiece encoding and decoding as weighted finite-state transduction.

The machine is compiled once on the driver from the pieces of a public model:

* normaliser: the model's own character map, as a trie whose longest match is
  replaced, its rule for runs of spaces and its dummy space in front; then every
  space becomes the meta symbol. A meta symbol of the text itself goes to its
  bytes, so decoding gives the normalised text exactly: with the identity map,
  as in the 32k model, the text itself;
* pieces: a trie whose accepting states emit an id at the piece's cost;
* byte fallback: a code point without a piece of its own emits its UTF-8 bytes
  at a cost above any piece.

An input is composed with it lazily, and the least cost in the tropical
semiring is relaxed from left to right; of equal costs the longer last piece
stands. No piece holds a meta symbol after another character, so the composed
machine is cut at these places and each part solved alone: parts repeat, and
their paths are kept in a bounded memory.

Costs: scores of a unigram model are negated. The scores of a BPE model are
ranks, not log-probabilities, so they are read as a Zipf law, log(rank + 2).
Which of the two a model is, its file says.

Null texts have null ids; an empty text has none. Texts of any length take
linear time; lone surrogates can't occur in Spark strings. Repeated rows are
encoded alike.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import lent

META = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Parts whose paths a worker keeps at most, and code points of a part that is kept.
CACHE, CACHED_CHARS = 100_000, 48
#: Code points and rows of texts whose ids a worker holds at once.
HELD, HELD_ROWS = 500_000, 1000
_part = re.compile(rf"{META}*[^{META}]+|{META}+")


class Vocabulary(list):
    """(piece, score, kind) by id, with what else the model file says: whether scores are ranks, the character map, whether a space is put in front and runs of spaces shrink."""

    def __init__(self, pieces=(), ranks: bool = False, charmap: dict[str, str] | None = None, dummy: bool = True, squeeze: bool = False):
        super().__init__(pieces)
        self.ranks, self.charmap, self.dummy, self.squeeze = ranks, charmap or {}, dummy, squeeze

    def __reduce__(self):
        return Vocabulary, (list(self), self.ranks, self.charmap, self.dummy, self.squeeze)


def _message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            size, i = number(i) if key & 7 == 2 else (4 if key & 7 == 5 else 8, i)
            value, i = raw[i : i + size], i + size
        yield key >> 3, value


def _charmap(blob: bytes) -> dict[str, str]:
    """The character map of a normaliser: a double-array trie over bytes, whose leaves point at zero-ended strings."""
    if len(blob) < 4:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, strings = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    step = lambda u: (u >> 10) << ((u & 512) >> 6)
    out, todo = {}, [(step(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        for c in range(1, 256):
            child = at ^ c
            if child < len(units) and units[child] & 0x800000FF == c:
                if units[child] >> 8 & 1:
                    value = units[child ^ step(units[child])] & 0x7FFFFFFF
                    out[(key + bytes([c])).decode("utf-8", "replace")] = strings[value : strings.index(b"\0", value)].decode()
                todo.append((child ^ step(units[child]), key + bytes([c])))
    return out


def read_pieces(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file; kinds are normal, byte, unused or control."""
    from pathlib import Path

    return parse_model(Path(path).read_bytes())


def parse_model(raw: bytes) -> Vocabulary:
    # Fixed values of the file format: kinds of pieces and of models by number.
    kinds = {1: "normal", 2: "control", 3: "control", 4: "normal", 5: "unused", 6: "byte"}
    bpe = 2
    out = Vocabulary()
    for field, value in _message(raw):
        if field == 1:
            piece = dict(_message(value))
            out.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, kinds[piece.get(3, 1)]))
        elif field == 2:
            out.ranks = dict(_message(value)).get(3, 1) == bpe
        elif field == 3:
            rules = dict(_message(value))
            out.charmap, out.dummy, out.squeeze = _charmap(rules.get(2, b"")), bool(rules.get(3, 1)), bool(rules.get(4, 1))
    return out


def costs(pieces: list[tuple[str, float, str]]) -> dict[int, float]:
    """The cost of each normal piece: -score, or of a vocabulary of ranks a Zipf law's negative logarithm."""
    normal = {i: s for i, (_, s, k) in enumerate(pieces) if k == "normal"}
    last = max((-s for s in normal.values() if s > -1e8), default=1.0)
    return {i: math.log(min(-s, last) + 2) if getattr(pieces, "ranks", False) else -s for i, s in normal.items()}


class Transducer:
    """Normaliser, piece trie and byte fallback; picklable, its memory of parts stays behind."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.pieces = [p if k == "normal" else "" for p, _, k in pieces]
        weights = costs(pieces)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.fallback = max(weights.values(), default=0.0) + 10.0
        self.root: dict = {}
        for i, w in weights.items():
            node = self.root
            for ch in self.pieces[i]:
                node = node.setdefault(ch, {})
            node[""] = (w, i)
        self.known: dict[str, list[int]] = {}
        self.dummy, self.squeeze = getattr(pieces, "dummy", True), getattr(pieces, "squeeze", False)
        self.charmap: dict = {}
        for key, new in getattr(pieces, "charmap", {}).items():
            node = self.charmap
            for ch in key:
                node = node.setdefault(ch, {})
            node[""] = new

    def plain(self, text: str) -> str:
        """What encoding keeps of a text: the longest keys of the character map replaced, runs of spaces shrunk if the model does so."""
        if self.charmap:
            out, i, n = [], 0, len(text)
            while i < n:
                node, j, best, end = self.charmap, i, text[i], i + 1
                while j < n and (node := node.get(text[j])) is not None:
                    j += 1
                    if (new := node.get("")) is not None:
                        best, end = new, j
                out.append(best)
                i = end
            text = "".join(out)
        return re.sub(" +", " ", text.strip(" ")) if self.squeeze else text

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def shortest(self, part: str) -> list[int]:
        """Ids along the least-cost path through one part of a normalised text; \\0-marked code points are literal."""
        n = len(part)
        best, back = [0.0] + [math.inf] * n, [None] * (n + 1)
        for i in range(n):
            here, node, j = best[i], self.root, i
            while j < n and (node := node.get(part[j])) is not None:
                j += 1
                if (arc := node.get("")) is not None and (c := here + arc[0]) < best[j]:
                    best[j], back[j] = c, (i, arc[1])
            if (c := here + self.fallback) < best[i + 1]:
                best[i + 1], back[i + 1] = c, (i, -1)
        out, j = [], n
        while j:
            i, piece = back[j]
            out.extend((piece,) if piece >= 0 else [self.bytes[b] for b in reversed(part[i].encode())])
            j = i
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        text = self.plain(text)
        front = META if self.dummy else ""
        if META in text:
            out: list[int] = []
            for k, plain in enumerate(text.split(META)):
                out += [self.bytes[b] for b in META.encode()] if k else []
                out += self._run((front if not k else "") + plain.replace(" ", META))
            return out
        return self._run(front + text.replace(" ", META)) if text else []

    def _run(self, normal: str) -> list[int]:
        out, known = [], self.known
        for part in _part.findall(normal):
            if (ids := known.get(part)) is None:
                ids = self.shortest(part)
                if len(part) <= CACHED_CHARS:
                    if len(known) >= CACHE:
                        known.clear()
                    known[part] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The inverse, up to normalisation: ids to bytes, meta symbols to spaces, the dummy space dropped."""
        if not hasattr(self, "_raw"):
            self._raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(META, " ").encode() for i, p in enumerate(self.pieces)]
        raw = self._raw
        return b"".join([raw[i] for i in ids])[self.dummy :].decode("utf-8", "replace") if len(ids) else ""


def encoded(machine: Transducer, texts: pd.Series) -> Iterator[pd.DataFrame]:
    """ids and round_trip of the texts in order, in frames of HELD code points or one text at most: what Spark hands over at once has many times as many ids."""
    sizes = np.array([len(t) if isinstance(t, str) else 0 for t in texts], np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at : at + HELD_ROWS]), HELD, side="right")))
        ids, back = [], []
        for t in texts.iloc[at:stop]:
            ids.append(np.array(machine.encode(t), np.int32) if isinstance(t, str) else None)
            back.append(machine.decode(ids[-1].tolist()) == machine.plain(t) if isinstance(t, str) else None)
        yield pd.DataFrame({"ids": ids, "round_trip": pd.array(back, "boolean")})
        at = stop


def encode(docs: DataFrame, machine: Transducer) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding them gives the normalised text back, of every row of `docs`."""

    @F.pandas_udf("ids array<int>, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in lent(batches, machine.known.clear):
            yield from encoded(machine, texts)

    found = docs.select("doc_id", run(F.col("text")).alias("r")).select("doc_id", "r.ids", "r.round_trip")
    return found.select("doc_id", "ids", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), "round_trip")
