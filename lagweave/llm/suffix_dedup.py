"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A byte is removed if a string of WIDTH bytes that covers it also starts at any
other place of the corpus. Every such string holds exactly one anchor: its
least run of CORE bytes by hash, the leftmost of equal ones, so equal strings
hold it at the same place. An anchor stands for all strings that chose it; its
context is what these cover.

1. Anchors whose core occurs once in the corpus can't stand for a repeat. Cores
   are counted by hash (partial sums first), and only repeated ones go on.
2. Each task sorts the suffixes that start at its anchors, cut where their
   context ends, merges equal contexts, and sends front-coded runs: of each
   suffix the length it shares with the one before and the rest.
3. Each receiver merges its runs with a loser tree whose nodes know the common
   prefix of their string with the last winner: the longer one wins unread, and
   equal ones are compared from there on only. Suffixes that share a core come
   out side by side; the strings they stand for are compared within them.

Cores found more than HOT times are not brought together: there each string of
WIDTH bytes is a suffix of its own, dealt out by its whole content, and equal
ones are neighbours in the merge. A task merges equal strings before it sends
them, so a hot string travels once from each task.

Null texts count as empty. Texts shorter than WIDTH lose nothing. Repeated rows
repeat each other. Strings never cross documents. Rows without an id are
documents too.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import cut, drop_cut, shuffle_partitions

WIDTH, CORE, HOT = 200, 64, 20_000
#: Bytes of contexts that a task sorts at a time, and anchors that a receiver merges on average.
RUN_BYTES, MERGED = 24_000_000, 40_000
_base, _WHOLE = 0x9E3779B97F4A7C15 | 1, 0xFFFF
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_base, pow(_base, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(raw: bytes, width: int = WIDTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of the strings that chose each anchor, the anchor's place and its core's hash."""
    t = np.frombuffer(raw, np.uint8)
    n = len(t)
    if n < width:
        none = np.empty(0, np.int64)
        return none, none, none, none
    up, down = _power(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up)])
    h = _mix((sums[core:] - sums[:-core]) * down[: n - core + 1])
    m, w = len(h), width - core + 1
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    full = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:m] = packed
    rows = full.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(after[: m - w + 1], before[w - 1 : m]) & np.uint64(0xFFFFFFFF)
    at = least.astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    place = at[first]
    return first, last, place, h[place].view(np.int64)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least `start`."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    size = 16
    while a[start : start + size] == b[start : start + size]:
        start += size
    while size > 1:
        size //= 2
        if a[start : start + size] == b[start : start + size]:
            start += size
    return start


class Run:
    """A sorted run as it is read: suffixes rebuilt from front coding one at a time."""

    def __init__(self, blob: bytes):
        (self.shared, self.rest_len, self.rest, self.left_len, self.left, self.n_ids, self.ids) = pickle.loads(blob)
        self.k = self.r = self.l = self.i = 0
        self.suffix = b""

    def next(self) -> tuple[int, bytes, bytes | None, np.ndarray] | None:
        """(length shared with the suffix before, suffix, left context or None for a whole string, places)."""
        k = self.k
        if k == len(self.shared):
            return None
        self.k += 1
        shared, n = int(self.shared[k]), int(self.rest_len[k])
        self.suffix = self.suffix[:shared] + self.rest[self.r : self.r + n]
        self.r += n
        left, n = None, int(self.left_len[k])
        if n != _WHOLE:
            left = self.left[self.l : self.l + n]
            self.l += n
        n = int(self.n_ids[k])
        ids = self.ids[self.i : self.i + n]
        self.i += n
        return shared, self.suffix, left, ids


def encode_run(items: list[tuple[bytes, bytes | None, list[tuple[int, int]]]]) -> bytes:
    """Front-code sorted items (suffix, left context, places)."""
    shared, rest, before = [], [], b""
    for suffix, _, _ in items:
        c = common(before, suffix)
        shared.append(c)
        rest.append(suffix[c:])
        before = suffix
    lefts = [x for _, x, _ in items]
    return pickle.dumps((
        np.array(shared, np.uint16), np.array([len(x) for x in rest], np.uint16), b"".join(rest),
        np.array([_WHOLE if x is None else len(x) for x in lefts], np.uint16), b"".join(x for x in lefts if x),
        np.array([len(x) for _, _, x in items], np.int32), np.array([p for _, _, x in items for p in x], np.int64).reshape(-1, 2),
    ), protocol=5)


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, bytes | None, np.ndarray]]:
    """All items in the order of their suffixes, each with the length shared with the item before: a loser tree over common prefixes."""
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    heads: list = [r.next() for r in runs] + [None] * (size - k)
    known = [0] * size  # the prefix that each head shares with the last winner
    losers = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether head a goes before head b; the loser's known prefix becomes that with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return True
        if x is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        s, t = x[1], y[1]
        c = common(s, t, known[a])
        first = len(s) <= c or (len(t) > c and s[c] < t[c])
        known[b if first else a] = c
        return first

    def play(node: int) -> int:
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    winner = play(1) if size > 1 else 0
    while (head := heads[winner]) is not None:
        yield known[winner], *head[1:]
        heads[winner] = new = runs[winner].next()
        known[winner] = new[0] if new else 0
        node = (winner + size) >> 1
        while node:
            rival = losers[node]
            if not beats(winner, rival):
                losers[node], winner = winner, rival
            node >>= 1


def repeats(group: list[tuple[int, bytes, bytes, np.ndarray]], width: int = WIDTH) -> Iterator[tuple[np.ndarray, int, int]]:
    """(places of the anchor's context, first and last repeated string in it) of items (shared, suffix, left, places) with one core."""
    if len(group) == 1:
        _, suffix, left, ids = group[0]
        if len(ids) > 1:
            yield ids, 0, len(left) + len(suffix) - width
        return
    if len(group) == 2:
        (_, s1, l1, i1), (right, s2, l2, i2) = group
        back = common(l1[::-1], l2[::-1])
        for s, left, ids in ((s1, l1, i1), (s2, l2, i2)):
            if len(ids) > 1:
                yield ids, 0, len(left) + len(s) - width
            elif back >= width - right:
                yield ids, len(left) - back, len(left) - (width - right)
        return
    whole = [left + suffix for _, suffix, left, _ in group]
    marks = [np.zeros(len(x) - width + 1, bool) for x in whole]
    most = max(len(g[2]) for g in group)
    for back in range(most + 1):  # strings that start so many bytes before the anchor
        seen: dict[bytes, int] = {}
        for k, (_, _, left, ids) in enumerate(group):
            at = len(left) - back
            if 0 <= at < len(marks[k]):
                other = seen.setdefault(whole[k][at : at + width], k)
                if other != k:
                    marks[k][at] = marks[other][at + len(group[other][2]) - len(left)] = True
                elif len(ids) > 1:
                    marks[k][at] = True
    for (_, _, _, ids), m in zip(group, marks, strict=True):
        edge = np.flatnonzero(np.diff(np.r_[False, m, False]))
        for a, b in edge.reshape(-1, 2):
            yield ids, int(a), int(b) - 1


def merged_repeats(blobs: list[bytes]) -> pd.DataFrame:
    """Rows (k, first, last) of repeated strings' starts, from the runs of one receiver."""
    ks, firsts, lasts = [], [], []

    def tell(ids: np.ndarray, first: int, last: int) -> None:
        ks.append(ids[:, 0])
        firsts.append(ids[:, 1] + first)
        lasts.append(ids[:, 1] + last)

    group: list = []
    strings: list = []  # places of the current whole string

    def end_string() -> None:
        if sum(map(len, strings)) > 1:
            for ids in strings:
                tell(ids, 0, 0)
        strings.clear()

    def end_group() -> None:
        by_context: list = []
        for item in sorted(group, key=lambda g: (g[1], g[2])) if len(group) > 2 else group:
            if by_context and by_context[-1][1:3] == item[1:3]:
                shared, s, left, ids = by_context[-1]
                by_context[-1] = (shared, s, left, np.concatenate([ids, item[3]]))
            else:
                by_context.append(item)
        if by_context:
            if len(by_context) == 2:
                a, b = by_context
                by_context[1] = (common(a[1], b[1]), *b[1:])
            for found in repeats(by_context):
                tell(*found)
        group.clear()

    run_min, before = 0, None
    for shared, suffix, left, ids in merge([Run(b) for b in blobs]):
        run_min = min(run_min, shared)
        if left is None:
            if before is None or run_min < len(suffix) or before != suffix:
                end_string()
            strings.append(ids)
            before, run_min = suffix, len(suffix)
            if group and shared < CORE:
                end_group()
            continue
        if shared < CORE:
            end_group()
        group.append((shared, suffix, left, ids))
    end_group()
    end_string()
    if not ks:
        return pd.DataFrame({"k": [], "first": [], "last": []}).astype("int64")
    return pd.DataFrame({"k": np.concatenate(ks), "first": np.concatenate(firsts), "last": np.concatenate(lasts)})


def removed(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs of a text, from ranges of repeated strings' starts."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + WIDTH)
        else:
            out.append([a, b + WIDTH])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte ranges) of every row of `docs`."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))

    def cores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 500):
                g = f.iloc[i : i + 500]
                found = [anchors(t.encode("utf-8", "replace"))[3] for t in g["text"]]
                n = [len(x) for x in found]
                yield pd.DataFrame({"h": np.concatenate(found), "k": np.repeat(g["k"].to_numpy(), n), "o": np.concatenate([np.arange(x, dtype=np.int32) for x in n])})

    every = cut(docs.where(F.octet_length("text") >= WIDTH).select("k", "text").mapInPandas(cores, "h long, k long, o int"))
    # written before the join: with a plain exchange on either side, adaptive execution can split a core that a third of all anchors share
    often = cut(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot")))
    asked = cut(every.join(often, "h").groupBy("k").agg(F.collect_set(F.when(~F.col("hot"), F.col("o"))).alias("os"), F.collect_set(F.when(F.col("hot"), F.col("o"))).alias("hot")))
    total = asked.agg(F.coalesce(F.sum(F.size("os") + 50 * F.size("hot")), F.lit(0)).alias("n")).first().n
    drop_cut(every)
    drop_cut(often)
    parts = max(shuffle_partitions(spark), -(-total // MERGED))

    @F.pandas_udf("n_bytes long, sha string, raw binary")
    def settle(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        """The digest of every text as it is; the text itself only where something may go. Ids stay outside the worker, where a null would turn them into floats."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        return pd.DataFrame({"n_bytes": [len(x) for x in raw], "sha": [hashlib.sha256(x).hexdigest() for x in raw], "raw": [x if w else None for x, w in zip(raw, wanted, strict=True)]})

    open_docs = docs.join(asked, "k", "left").select("doc_id", "k", "os", "hot", settle(F.col("text"), F.col("os").isNotNull()).alias("s"))
    open_docs = cut(open_docs.select("doc_id", "k", "s.n_bytes", "s.sha", F.col("s.raw").alias("text"), "os", "hot"))
    drop_cut(asked)

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict] = {}
        size = 0

        def flush() -> pd.DataFrame:
            rows = [(p, encode_run([(s, left, at) for (s, left), at in sorted(items.items(), key=lambda x: (x[0][0], x[0][1] or b""))])) for p, items in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["part", "run"])

        for f in frames:
            for k, raw, os, hot in zip(f["k"], f["text"], f["os"], f["hot"], strict=True):
                first, last, place, h = anchors(raw)
                for o in sorted(os):
                    a, b, c = int(first[o]), int(last[o]) + WIDTH, int(place[o])
                    held.setdefault(int(h[o]) % parts, {}).setdefault((raw[c:b], raw[a:c]), []).append((k, a))
                    size += b - a + 100
                for o in sorted(hot):
                    for a in range(int(first[o]), int(last[o]) + 1):
                        s = raw[a : a + WIDTH]
                        held.setdefault(xxhash.xxh64_intdigest(s) % parts, {}).setdefault((s, None), []).append((k, a))
                        size += WIDTH + 100
                    if size > RUN_BYTES:
                        yield flush()
                        size = 0
                if size > RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    sent = open_docs.where("os is not null").select("k", "text", "os", "hot").mapInPandas(runs, "part int, run binary")
    found = sent.groupBy("part").applyInPandas(lambda f: merged_repeats(f["run"].tolist()), "k long, first long, last long")
    ranges = found.distinct().groupBy("k").agg(F.collect_list(F.struct("first", "last")).alias("r")).select("k", F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts"))

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    def finish(digests: pd.Series, raws: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        out = []
        for sha, raw, a, b in zip(digests, raws, firsts, lasts, strict=True):
            spans = removed(raw, list(zip(a.tolist(), b.tolist(), strict=True))) if a is not None else []
            if spans:
                kept, past = hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(raw[past:x])
                    past = y
                kept.update(raw[past:])
                sha = kept.hexdigest()
            out.append((sum(y - x for x, y in spans), len(spans), sha, [{"start": x, "end": y} for x, y in spans]))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "spans"])

    done = open_docs.select("doc_id", "k", "n_bytes", "sha", "text").join(ranges, "k", "left").select("doc_id", "n_bytes", finish("sha", "text", "firsts", "lasts").alias("f"))
    return done.select("doc_id", "n_bytes", "f.n_removed", "f.n_spans", "f.kept_sha256", "f.spans")
