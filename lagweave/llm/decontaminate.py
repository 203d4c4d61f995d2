"""Benchmark decontamination by disjoint pieces along diagonals and exact edit distance.

The items are a stated query set, taken in blocks; documents stream past each
block. An item allows e edits and is cut into e + t pieces, which do not overlap
and are rare among the items. An edit spoils one piece at most, so wherever a
document holds the item with at most e edits, t pieces or more stand as they
are, on e + 1 neighbouring diagonals (place in the document less place in the
item). Where so many do, the text around them is verified by Myers'
bit-parallel edit distance between the item and any part of it (in Hyyro's
blocks of 64 bits). No item within the edits is missed: neither step samples.

Letters are compared in lower case, white space as spaces. A document is
reported once for each item with the least distance and, of those, the part
that ends first. Null and empty texts match nothing; nor do null and empty
items. The edits allowed are the same share of an item's length whatever that
is: items of under five letters must occur as they are. Repeated rows are
reported once for each; items of one text are reported separately; an item
without an id is an item, reported with a null id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import give_back

#: Edits allowed, as a share of an item's length.
RATE = 0.2
#: Longest piece, its buckets as a power of two (one that several share only adds to counts), and pieces of an item beyond one more than its edits, as a share of its length.
LONGEST, BUCKETS, SPARE = 6, 20, 0.03
#: Letters of an item that are cut into pieces together.
SEGMENT = 256
#: Code points and number of the items of one block at most: what an executor holds of the query set.
BLOCK_CHARS, BLOCK_ITEMS = 250_000, 4000
#: Code points of documents that are searched together, and looked up together; places of pieces that are sorted together, if more than one text's worth.
BATCH, CHUNK, PLACES = 10_000_000, 65_536, 1_000_000
#: Stretches of text verified together, from how many for each word of an item on, and new places of one.
LANES, FEW, STRETCH = 8192, 32, 256
SPACES = "\t\n\x0b\x0c\r"


def plain(text: str) -> str:
    text = text.lower()
    for c in SPACES:
        text = text.replace(c, " ")
    return text


def edit_distance(item: Sequence, region: Sequence, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance between `item` and any part of `region` (`anchored`: that begins where it does), and where the first such part ends (Myers 1999)."""
    n = len(item)
    masks: dict = {}
    for i, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best, end = n, 0
    for j, ch in enumerate(region, 1):
        eq = masks.get(ch, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        grow, shrink = down | (full & ~(zero | up)), up & zero
        score += bool(grow & top) - bool(shrink & top)
        if score < best:
            best, end = score, j
        grow, shrink = (grow << 1 | anchored) & full, (shrink << 1) & full
        up, down = shrink | (full & ~(zero | grow)), grow & zero
    return best, end


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def search(x: np.ndarray, masks: np.ndarray, base: np.ndarray, size: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """edit_distance() for many items and parts x[begin:end] side by side, longest part first; a part's masks are at its `base` plus the letter."""
    words, one = len(masks), np.uint64(1)
    top = ((size - 1) % 64).astype(np.uint64)
    up, down = np.full((words, len(size)), ~np.uint64(0)), np.zeros((words, len(size)), np.uint64)
    score, best, where, at = size.copy(), size.copy(), begin.copy(), begin.copy()
    steps = int((end - begin).max(initial=0))
    active = np.searchsorted(begin - end, -np.arange(steps), side="left")
    for t in range(steps):
        a = active[t]
        cell = base[:a] + x[at[:a]]
        at[:a] += 1
        gain = loss = np.uint64(0)
        for w in range(words):
            p, m = up[w, :a], down[w, :a]
            eq = masks[w].take(cell)
            xv = eq | m
            eq |= loss
            xh = eq & p
            xh += p
            xh ^= p
            xh |= eq
            grow = xh | p
            np.invert(grow, out=grow)
            grow |= m
            xh &= p
            g, s = (grow >> np.uint64(63), xh >> np.uint64(63)) if w + 1 < words else (grow >> top[:a] & one, xh >> top[:a] & one)
            grow <<= one
            grow |= gain
            xh <<= one
            xh |= loss
            np.bitwise_and(grow, xv, out=m)
            grow |= xv
            np.invert(grow, out=grow)
            np.bitwise_or(xh, grow, out=p)
            gain, loss = g, s
        score[:a] += gain.view(np.int64) - loss.view(np.int64)
        better = np.flatnonzero(score[:a] < best[:a])
        best[better] = score[better]
        where[better] = at[better]
    return best, where


def buckets(x: np.ndarray, lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, bucket of the letters from each place on) for lengths in rising order."""
    h, have = np.zeros(len(x), np.uint32), 0
    for q in lengths:
        for k in range(have, min(q, len(x))):
            h = h[: len(x) - k]
            h = h * np.uint32(0x9E3779B1) + x[k:].astype(np.uint32) + np.uint32(1)
        have = q
        yield q, ((h[: max(0, len(x) - q + 1)] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS)).astype(np.intp)


def pieces(codes: list[np.ndarray], number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place, length) of `number` disjoint pieces of each item, such that the least is to be found elsewhere, as far as other pieces of these items tell."""
    sizes = np.array([len(c) for c in codes])
    parts = -(-sizes // SEGMENT)
    item, n = _each(parts, np.arange(len(codes)))
    begin, end = sizes[item] * n // parts[item], sizes[item] * (n + 1) // parts[item]
    want = number[item] * end // sizes[item] - number[item] * begin // sizes[item]  # no more than letters
    size, at = end - begin, begin + (np.cumsum(sizes) - sizes)[item]
    flat = np.concatenate(codes)
    often = np.full((LONGEST + 1, len(flat)), np.inf, np.float32)
    for q, b in buckets(flat, range(1, LONGEST + 1)):
        often[q, : len(b)] = np.bincount(b)[b] + 4.0 ** (2 - q)
    found = []
    for k in range(0, len(item), SEGMENT):
        some = np.arange(k, min(k + SEGMENT, len(item)))
        segment, place, length = _cheapest(often, at[some], size[some], want[some])
        found.append((item[some[segment]], begin[some[segment]] + place, length))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _cheapest(often: np.ndarray, at: np.ndarray, size: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, length) of the `want` disjoint pieces of each segment whose `often` sum to the least."""
    rows, width = np.arange(len(at)), int(size.max()) + 1
    ends = np.arange(width)
    costs = np.full((LONGEST + 1, len(at), width), np.inf, np.float32)  # of the piece of a length that ends somewhere
    for q in range(1, LONGEST + 1):
        start = ends - q
        ok = (start >= 0) & (ends <= size[:, None])
        costs[q] = np.where(ok, often[q].take(at[:, None] + start, mode="clip"), np.inf)
    before, steps = np.zeros((len(at), width), np.float32), []
    for _ in range(int(want.max())):
        best, length = np.full((len(at), width), np.inf, np.float32), np.zeros((len(at), width), np.int8)
        for q in range(1, min(LONGEST, width - 1) + 1):
            c = before[:, :-q] + costs[q, :, q:]
            better = c < best[:, q:]
            np.copyto(best[:, q:], c, where=better)
            np.copyto(length[:, q:], q, where=better)
        before = np.minimum.accumulate(best, axis=1)
        steps.append((np.maximum.accumulate(np.where(best == before, ends, 0).astype(np.int16), axis=1), length))
    out, end = [], size.copy()
    for k in range(len(steps), 0, -1):
        seg = rows[want >= k]
        last, length = steps[k - 1]
        stop = last[seg, end[seg]].astype(np.int64)
        q = length[seg, stop].astype(np.int64)
        end[seg] = stop - q
        out.append((seg, stop - q, q))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Pieces:
    """The pieces of some items by bucket, and how many tell where an item may be."""

    def __init__(self, which: np.ndarray, codes: list[np.ndarray], edits: np.ndarray):
        self.which, self.edits = which, edits
        self.sizes = np.array([len(codes[k]) for k in which])
        self.least = np.minimum(1 + (SPARE * self.sizes).astype(int), self.sizes - edits)
        row, place, length = pieces([codes[k] for k in which], edits + self.least)
        self.reach = int((self.sizes + edits).max())
        self.off = int(self.sizes.max())
        self.bits = int(CHUNK + 2 * self.reach + self.off).bit_length()  # a row of diagonals, and edits between two rows
        self.lengths = np.unique(length).tolist()
        bucket = np.empty(len(row), np.intp)
        flat, first = np.concatenate([codes[k] for k in which]), np.cumsum(self.sizes) - self.sizes
        for q, b in buckets(flat, self.lengths):
            mine = length == q
            bucket[mine] = b[(first[row] + place)[mine]]
        order = np.argsort(bucket, kind="stable")
        self.place = ((row << self.bits) + self.off - place)[order]
        self.count = np.bincount(bucket, minlength=1 << BUCKETS).astype(np.int32)
        self.first = np.cumsum(self.count) - self.count
        self.some = self.count > 0

    def regions(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, from, to) of parts of x, which hold all places of items within their edits."""
        todo = [(at, min(at + CHUNK, len(x))) for at in range(0, len(x), CHUNK)][::-1]
        while todo:
            at, stop = todo.pop()
            low = max(0, at - self.reach)
            j, bucket = [], []
            for _, b in buckets(x[low:stop], self.lengths):
                j.append(np.flatnonzero(self.some.take(b)))
                bucket.append(b[j[-1]])
            j, bucket = np.concatenate(j), np.concatenate(bucket)
            count = self.count[bucket]
            if count.sum() > PLACES and stop - at > self.reach:
                half = (at + stop) // 2
                todo += [(half, stop), (at, half)]
                continue
            entry = np.repeat(self.first[bucket] - (np.cumsum(count) - count), count)
            entry += np.arange(len(entry))
            place = self.place.take(entry)
            place += np.repeat(j, count)
            place.sort()
            k = place >> self.bits
            other = np.arange(len(place)) - self.least[k] + 1
            near = np.flatnonzero((place - place[other.clip(0)] <= self.edits[k]) & (other >= 0))
            if not len(near):
                continue
            k = k[near]
            diagonal = (place[near] & ((1 << self.bits) - 1)) - self.off + low
            begin, end = diagonal - self.edits[k], diagonal + self.edits[k] + self.sizes[k]
            new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (begin[1:] > end[:-1])])
            yield self.which[k[new]], begin[new], end[np.r_[new[1:], len(k)] - 1]


class Block:
    """Items with their pieces and bit masks, which a worker makes when they are first used."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = [(k, plain(t)) for k, t in items if t]
        self.rate = rate
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _index(self):
        if self._ready is None:
            seen = sorted({ord(c) for _, t in self.items for c in t})
            letters = np.zeros(0x110000, np.uint16 if len(seen) < 1 << 16 else np.uint32)
            letters[seen] = np.arange(1, len(seen) + 1)
            codes = [letters[points(t)] for _, t in self.items]
            sizes = np.array([len(c) for c in codes])
            edits = (self.rate * sizes).astype(int)
            some = np.flatnonzero(sizes > edits)
            index = [Pieces(some, codes, edits[some])] if len(some) else []
            words, masks = -(-sizes // 64), {}
            for w in np.unique(words):
                rows = np.flatnonzero(words == w)
                m = np.zeros((w, len(rows), len(seen) + 1), np.uint64)
                for r, k in enumerate(rows):
                    i = np.arange(sizes[k])
                    np.bitwise_or.at(m, (i // 64, r, codes[k]), np.uint64(1) << (i % 64).astype(np.uint64))
                masks[w] = rows, m.reshape(w, -1)
            self._ready = letters, sizes, edits, np.flatnonzero(sizes <= edits), index, words, masks, codes
        return self._ready

    def _verify(self, x: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least edit distance between each item and any part of x[begin:end], and where the first such part ends."""
        _, sizes, _, _, _, words, masks, codes = self._index()
        best, where = sizes[item].copy(), begin.copy()
        for w, (rows, m) in masks.items():
            mine = np.flatnonzero(words[item] == w)
            if len(mine) < FEW * w:  # too few to go side by side
                for k in mine.tolist():
                    best[k], ends = edit_distance(codes[item[k]].tolist(), x[begin[k] : end[k]].tolist())
                    where[k] += ends
                continue
            mine = mine[np.argsort(begin[mine] - end[mine], kind="stable")]  # longest first
            for i in range(0, len(mine), LANES):
                part = mine[i : i + LANES]
                best[part], where[part] = search(x, m, np.searchsorted(rows, item[part]) * (m.shape[1] // len(rows)), sizes[item[part]], begin[part], end[part])
        return best, where

    def match(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item, distance, start) of matching pairs."""
        out: list[tuple[int, int, int, int]] = []
        if not self.items:
            return out
        rows, held, size = [], [], 0
        for r, t in enumerate(texts):
            if t:
                rows.append(r)
                held.append(plain(t))
                size += len(held[-1])
                if size > BATCH:
                    out += self._match(rows, held)
                    rows, held, size = [], [], 0
        return out + (self._match(rows, held) if held else [])

    def _match(self, rows: list[int], texts: list[str]) -> list[tuple[int, int, int, int]]:
        letters, sizes, edits, rest, index, *_ = self._index()
        stops = np.cumsum([len(t) for t in texts])
        starts = stops - [len(t) for t in texts]
        x = np.empty(stops[-1], letters.dtype)
        for t, a, b in zip(texts, starts.tolist(), stops.tolist(), strict=True):
            np.take(letters, points(t), out=x[a:b])
        found = [f for pieces in index for f in pieces.regions(x)]
        if len(rest):  # so many edits that pieces tell nothing
            found.append((np.repeat(rest, len(texts)), np.tile(starts, len(rest)), np.tile(stops, len(rest))))
        if not found:
            return []
        item, begin, end = (np.concatenate(c) for c in zip(*found, strict=True))
        begin, end = begin.clip(0), end.clip(max=len(x))
        # one for each text, cut to it
        doc = np.searchsorted(stops, begin, side="right")
        n = np.maximum(np.searchsorted(stops, end, side="left") - doc + 1, 1)
        item, begin, end, doc, n = _each(n, item, begin, end, doc)
        doc = doc + n
        begin, end = np.maximum(begin, starts[doc]), np.minimum(end, stops[doc])
        # one for each stretch of it
        item, begin, end, doc, n = _each(np.maximum(-(-(end - begin) // STRETCH), 1), item, begin, end, doc)
        begin = begin + n * STRETCH
        end = np.minimum(end, begin + STRETCH + sizes[item] + edits[item])
        d, at = self._verify(x, item, begin, end)
        good = np.flatnonzero(d <= edits[item])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for r, k, e, a in zip(doc[good].tolist(), item[good].tolist(), d[good].tolist(), at[good].tolist(), strict=True):
            a -= int(starts[r])
            if (r, k) not in best or (e, a) < best[r, k]:
                best[r, k] = (e, a)
        out = []
        for (r, k), (e, a) in best.items():  # the part is as long as the item, read backwards, is from its end
            text = self.items[k][1]
            _, back = edit_distance(text[::-1], texts[r][max(0, a - len(text) - e) : a][::-1], anchored=True)
            out.append((rows[r], k, e, a - back))
        return out


def _each(n: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each row n times, with its number among them."""
    return *(np.repeat(c, n) for c in columns), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, streamed through the driver one partition at a time."""
    held, size = [], 0
    for r in items.where("length(text) > 0").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if held and (size + len(r.text) > BLOCK_CHARS or len(held) == BLOCK_ITEMS):
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, item_chars and start of every document and item of it; a narrow pass for each block of items."""
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, item_chars int, start long")

    def searcher(block):
        def search(texts: pd.Series) -> pd.Series:
            give_back()
            out: list[list] = [[] for _ in range(len(texts))]
            held = block.value.items
            for r, k, d, at in block.value.match([t if isinstance(t, str) else None for t in texts]):
                out[r].append({"item_id": held[k][0], "distance": d, "item_chars": len(held[k][1]), "start": at})
            return pd.Series(out)

        # said to be nondeterministic lest a filter on what it finds run it twice
        return F.pandas_udf(search, "array<struct<item_id:long,distance:int,item_chars:int,start:long>>").asNondeterministic()

    for held in blocks(items):
        block = docs.sparkSession.sparkContext.broadcast(Block(held, rate))  # at most BLOCK_CHARS of items
        some = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), searcher(block)(F.col("text")).alias("f"))
        found = found.unionByName(some.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.*"))
    return found


def keep(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows of `docs` that hold no item, all columns as they are; a narrow filter for each block of items."""
    def cleaner(block):
        def clean(texts: pd.Series) -> pd.Series:
            give_back()
            out = np.ones(len(texts), bool)
            for r, *_ in block.value.match([t if isinstance(t, str) else None for t in texts]):
                out[r] = False
            return pd.Series(out)

        return F.pandas_udf(clean, "boolean")

    for held in blocks(items):
        block = docs.sparkSession.sparkContext.broadcast(Block(held, rate))  # at most BLOCK_CHARS of items
        docs = docs.where(cleaner(block)(F.col("text")))
    return docs
