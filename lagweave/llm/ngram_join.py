"""Self-join of documents on the Jaccard similarity of their word shingles, with Bayesian pruning.

Documents with one set of shingles are one node. Its MinHash values, a byte
each, are cut into bands; nodes that agree in a band meet in a bucket. A pair
is compared where it first agrees, some values at a time, and dropped as soon
as the posterior probability that its similarity reaches the threshold, given
the agreements so far and a uniform prior, falls below the tolerance (Satuluri
and Parthasarathy 2012). Nodes that stay connected by what is left are verified
together on whole shingle sets, exactly, in blocks.

No stage emits pairs: buckets and classes return a row per member with its
number of links and one edge towards the least member it hangs on. A bucket or
class beyond BLOCK members is dealt out as pairs of blocks.

Shingles are SIZE consecutive words, of shorter texts all words. Null texts and
texts without a word have no shingle, no link, and are classes of their own, as
are rows without an id (class null). Repeated rows count as copies of each
other; rows of one id with different texts are told apart by a hash of the text.
The least doc_id of a class is its id, so such rows may give two classes one id.
At the threshold a pair shares no band with probability (1 - 0.8^6)^54, less
than 1e-7.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import WORD, cut, drop_cut, free_name, give_back, lent, shuffle_partitions
from lagweave.llm.graph import components

SIZE, NUMERATOR, DENOMINATOR = 5, 4, 5
BANDS, ROWS, TOLERANCE = 54, 6, 1e-9
BLOCK, STEP = 1024, 36
#: Words whose hashes a worker keeps at most, during a task.
CACHE = 50_000
_word = re.compile(WORD)
_rng = np.random.default_rng(2024)
_mul = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_add = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)[:, None]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hash = _Hashes()


def forget() -> None:
    """Drop the known hashes of this process; a function that Spark sends to workers would carry a copy of them."""
    _hash.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = _word.findall(text or "")
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : i + n] + np.uint64(i + 1))
    return np.unique(out)


def minhash_bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys: the band's number and a byte of each of its ROWS MinHash values."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        part = x[None, i : i + 1024]
        for f in range(0, BANDS * ROWS, 81):
            np.minimum(least[f : f + 81], (part * _mul[f : f + 81] + _add[f : f + 81]).min(axis=1), out=least[f : f + 81])
    byte = (((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.int64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.int64)
    for r in range(ROWS):
        key = (key << 8) | byte[:, r]
    return key


def least_agreements(threshold: float = NUMERATOR / DENOMINATOR, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of compared values: the fewest agreements at which the similarity still reaches the threshold with a posterior probability of `tolerance`. Agreement by chance of two bytes is allowed for; with a uniform prior the posterior is P(Binomial(n + 1, t) <= m)."""
    t = threshold + (1 - threshold) / 256
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
        out[n] = m
    return out


def _survivors(bands: np.ndarray, band: int, a: np.ndarray, b: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """Which pairs (a, b) of rows agree first in this band and are not dropped."""
    alive = np.flatnonzero(~(bands[a, :band] == bands[b, :band]).any(axis=1)) if band else np.arange(len(a))
    agree = np.zeros(len(a), np.int32)
    values = bands.view(np.uint8).reshape(len(bands), BANDS, 8)[:, :, :ROWS].reshape(len(bands), -1)
    for n, least in needed.items():
        if not len(alive):
            break
        agree[alive] += (values[a[alive], n - STEP : n] == values[b[alive], n - STEP : n]).sum(axis=1, dtype=np.int32)
        alive = alive[agree[alive] >= least]
    return alive


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _pairs(first: np.ndarray, second: np.ndarray, same: bool, chunk: int = 40_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two blocks, or of one block with itself, a bounded number at a time."""
    rows = max(1, chunk // max(1, len(second)))
    for i in range(0, len(first), rows):
        a, b = np.meshgrid(first[i : i + rows], second, indexing="ij")
        keep = a < b if same else np.ones(a.shape, bool)
        if keep.any():
            yield a[keep], b[keep]


def _bucket(f: pd.DataFrame) -> pd.DataFrame:
    """Edges (u, v) of the buckets in a group of rows (key, i, j, block, rep, bands): each member to the least it hangs on."""
    give_back()
    needed, out = least_agreements(), []
    f = f.sort_values(["key", "i", "j", "rep"], kind="stable")
    bands, reps, block = np.array(f["bands"].tolist(), np.int64).reshape(-1, BANDS), f["rep"].to_numpy(), f["block"].to_numpy()
    k = f[["key", "i", "j"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
    for s, e in zip(starts, [*starts[1:], len(f)], strict=True):
        (key, i, j), ids = k[s], np.arange(s, e)
        one, two = ids[block[s:e] == i], ids[block[s:e] == j]
        forest = _Forest(e - s)
        for a, b in _pairs(one, two, i == j):
            for x in _survivors(bands, int(key >> 48), a, b, needed):
                forest.join(int(a[x]) - s, int(b[x]) - s)
        for x in range(e - s):
            if (r := forest.root(x)) != x:
                out.append((reps[s + x], reps[s + r]))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def intersections(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of slices of their indicator matrices."""
    values, place = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    ends = np.cumsum([len(x) for x in (*one, *two)])
    owner = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(one), len(two)), np.float32)
    for i in range(0, len(values), width):
        a, b = np.searchsorted(place, (i, i + width))
        x = np.zeros((len(ends), min(width, len(values) - i)), np.float32)
        x[owner[a:b], place[a:b] - i] = 1
        total += x[: len(one)] @ x[len(one) :].T
    return total


def _verify(f: pd.DataFrame) -> pd.DataFrame:
    """For rows (comp, i, j, block, rep, copies, set): (rep, links, v) with the documents that a member is linked with in these blocks, and the least member it hangs on."""
    give_back()
    out = []
    f = f.sort_values(["comp", "i", "j", "rep"], kind="stable")
    k, reps, block, copies = f[["comp", "i", "j"]].to_numpy(), f["rep"].to_numpy(), f["block"].to_numpy(), f["copies"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in f["set"]]
    starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
    for s, e in zip(starts, [*starts[1:], len(f)], strict=True):
        (_, i, j), ids = k[s], np.arange(s, e)
        one, two = ids[block[s:e] == i], ids[block[s:e] == j]
        if not len(one) or not len(two):
            continue
        common = intersections([sets[x] for x in one], [sets[x] for x in two])
        n1, n2 = np.array([len(sets[x]) for x in one]), np.array([len(sets[x]) for x in two])
        linked = (NUMERATOR + DENOMINATOR) * common.astype(np.int64) >= NUMERATOR * (n1[:, None] + n2[None])
        links = np.zeros(e - s, np.int64)
        if i == j:
            np.fill_diagonal(linked, False)
            links += linked @ copies[two]
        else:
            links[one - s] += linked @ copies[two]
            links[two - s] += linked.T @ copies[one]
        forest = _Forest(e - s)
        for a, b in zip(*np.nonzero(linked), strict=True):
            forest.join(int(one[a]) - s, int(two[b]) - s)
        out += [(reps[s + x], links[x], reps[s + forest.root(x)]) for x in range(e - s)]
    return pd.DataFrame(out, columns=["rep", "links", "v"], dtype="int64")


def _dealt(members: DataFrame, group: str, size: str, rows: int) -> tuple[DataFrame, int]:
    """Rows with the pairs of blocks (i, j) they take part in, and a task number for `rows` of them at a time."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"))))
    dealt = dealt.withColumn("p", pairs).withColumn("i", F.col("p.i")).withColumn("j", F.col("p.j")).drop("p", "blocks", size)
    tasks = max(shuffle_partitions(members.sparkSession), rows)
    return dealt.withColumn("task", F.pmod(F.xxhash64(group, "i", "j"), F.lit(tasks))), tasks


def _text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n) without a class, and (doc_id, th, n, first, n_links) of the others; first is the (doc_id, th) that stands for the class, th the hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(docs).alias("th"), "text")

    @F.pandas_udf("n int, fp binary, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in lent(batches, forget):
            sets = [shingles(t if isinstance(t, str) else None) for t in texts]
            yield pd.DataFrame({"n": [len(s) for s in sets], "fp": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "bands": [minhash_bands(s) if len(s) else None for s in sets]})

    every = cut(docs.select("doc_id", "th", sketch("text").alias("s")).select("doc_id", "th", "s.n", "s.fp", "s.bands"))
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    # nodes are numbered in the written table: the numbers are those that its readers see, whatever is computed again
    counted = every.where(~alone).groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("copies"))
    counted = cut(counted.withColumn("rep", F.monotonically_increasing_id()))
    firsts = counted.select("fp", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), "rep")
    reps = every.where(~alone).select("fp", "doc_id", "th", "bands").join(firsts, ["fp", "doc_id", "th"]).select("rep", "bands").dropDuplicates(["rep"])
    reps = cut(reps)
    in_band = reps.select("rep", F.explode("bands").alias("key"))
    # a bucket's members are summed up before they are shuffled; buckets with the same members are compared once, in the first band
    sums = in_band.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.xxhash64("rep", F.lit(1)).bitwiseAND(0xFFFFFFFF)).alias("s")).where("n > 1")
    kept = cut(sums.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n"))
    buckets = in_band.join(kept, "key").select("key", "rep", "n").join(reps, "rep")
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    dealt, _ = _dealt(buckets, "key", "n", total // 10_000)
    edges = dealt.groupBy("task").applyInPandas(_bucket, "u long, v long")
    near = cut(components(edges))
    drop_cut(reps, kept)
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = near.join(sizes, "root").select(F.col("node").alias("rep"), F.col("root").alias("comp"), "size").join(counted.select("rep", "copies", "first"), "rep")
    members = members.select("rep", "comp", "size", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"))

    @F.pandas_udf("binary")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in lent(batches, forget):
            yield pd.Series([shingles(t).tobytes() for t in texts], dtype=object)

    held = docs.join(members, ["doc_id", "th"]).select("rep", "comp", "size", "copies", sets("text").alias("set")).dropDuplicates(["rep"])
    dealt, _ = _dealt(held, "comp", "size", near.count() // 1000)
    verified = cut(dealt.groupBy("task").applyInPandas(_verify, "rep long, links long, v long"))
    drop_cut(near)
    classes = cut(components(verified.select(F.col("rep").alias("u"), "v")).select(F.col("node").alias("rep"), "root"))
    least = cut(classes.join(counted.select("rep", "first"), "rep").groupBy("root").agg(F.min("first").alias("least")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    named = counted.join(links, "rep", "left").join(classes, "rep", "left").join(least, "root", "left")
    named = named.select("fp", F.coalesce("least", "first").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return every.where(alone).select("doc_id", "th", "n"), every.where(~alone).select("doc_id", "th", "n", "fp").join(named, "fp").select("doc_id", "th", "n", "first", "n_links")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_shingles and n_links (other documents whose similarity reaches the threshold) of every row of `docs`."""
    alone, linked = _classes(docs)
    n = F.col("n").cast("long").alias("n_shingles")
    linked = linked.select("doc_id", F.col("first.doc_id").alias("class_id"), n, "n_links")
    return linked.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), n, F.lit(0).cast("long").alias("n_links")))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each class, of its least doc_id, all columns as they are; rows without an id or without a word stay. Of rows that agree in id and text one stays; rows of one id whose texts are no near copies all do."""
    _, linked = _classes(docs)
    doc_id, th = free_name(docs, "doc_id_"), free_name(docs, "text_hash_")
    lost = linked.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("th") != F.col("first.th"))).select(F.col("doc_id").alias(doc_id), F.col("th").alias(th)).distinct()
    marked = docs.where("doc_id is not null").withColumn(doc_id, F.col("doc_id").cast("long")).withColumn(th, _text_hash(docs))
    named = marked.join(lost, [doc_id, th], "left_anti").dropDuplicates([doc_id, th])
    return named.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
