"""Language-model scores: a marginal over all subword segmentations of every word.

The vocabulary is that of a public model; its scores are the prior. Training
text is summed up as word counts over the whole corpus (a word that occurs in
every document is one row after partial aggregation). Expectation maximisation,
a few rounds over the most frequent words and one over all training words,
turns prior scores into piece weights:
the expected uses of each piece, over all segmentations, plus the prior. Each
distinct word is spelled once, so that the weights suit words not seen before.
The sum over a word's segmentations comes from a forward recursion in log
space. Training words are pieces of the lattice too: one more arc spans the
word, with weight c / (N + theta), and the segmentations into subwords share
theta / (N + theta). Theta is the value, of a grid, at which all training words
are likeliest when each occurrence is left out of its own count. A document's
probability is the product over its words and one end. Both recursions run
once for each distinct word, not for each occurrence, and once for a prefix
that words of one batch share.

The same counts give the base score, an add-0.1 unigram over words.

Null texts count as empty: they consist of the end alone. Repeated rows are
documents of their own, in training too, and share a result row's values; rows
are told apart by an internal number only. Words of any length are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import cut, drop_cut
from lagweave.llm.wfst import META, costs

#: Words with more than 1/HEAVY of all tokens are looked up in a broadcast table, which so has fewer than HEAVY rows whatever the corpus; all others are joined.
HEAVY = 20_000
#: Rounds over heavy words alone before the one over all words.
ADD, PRIOR_WEIGHT, ROUNDS = 0.1, 2000.0, 3
#: Values of theta tried, as multiples of V + 1.
GRID = [2.0 ** (1 - k) for k in range(14)]
END = ""
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Lattice:
    """Log weights of pieces and bytes in a trie; forward recursion and expected uses, over words that share prefixes."""

    def __init__(self, pieces: list[tuple[str, float, str]], counts: dict[int, float] | None = None):
        prior = costs(pieces)
        total = math.log(sum(math.exp(-c) for c in prior.values()))
        self.prior = {i: -c - total for i, c in prior.items()}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        floor = min(self.prior.values()) - 2
        for i in self.byte_id.values():
            self.prior[i] = floor
        self.end = len(pieces)
        self.prior[self.end] = math.log(0.01)
        norm = math.log(sum(math.exp(w) for w in self.prior.values()))
        if counts is None:
            self.weight = {i: w - norm for i, w in self.prior.items()}
        else:
            n = sum(counts.values()) + PRIOR_WEIGHT
            self.weight = {i: math.log((counts.get(i, 0.0) + PRIOR_WEIGHT * math.exp(w - norm)) / n) for i, w in self.prior.items()}
        self.fallback: dict[str, tuple[float, tuple[int, ...]]] = {}
        self.back: dict = {}  # a trie of pieces read from their ends
        for i, (p, _, k) in enumerate(pieces):
            if k == "normal" and i in prior:
                node = self.back
                for ch in reversed(p):
                    node = node.setdefault(ch, {})
                node[""] = (self.weight[i], i)

    def _spell(self, ch: str) -> tuple[float, tuple[int, ...]]:
        """Log weight and byte pieces of one character."""
        ids = tuple(self.byte_id[b] for b in ch.encode("utf-8", "replace"))
        known = self.fallback[ch] = (sum(self.weight[i] for i in ids), ids)
        return known

    def _extend(self, s: str, alpha: list[float], arcs: list | None = None) -> None:
        """Forward recursion in log space from the place that `alpha` has come to, up to the end of s: alpha[j] is the logarithm of the sum over all segmentations of s[:j]. With `arcs`, also the share of each last piece among those segmentations: (start, share, ids)."""
        back, fallback, exp, log1p = self.back, self.fallback, math.exp, math.log1p
        for j in range(len(alpha) - 1, len(s)):
            w, ids = fallback.get(s[j]) or self._spell(s[j])
            a = alpha[j] + w
            here = [(j, a, ids)]
            node, i = back, j
            while i >= 0 and (node := node.get(s[i])) is not None:
                if (arc := node.get("")) is not None:
                    x = alpha[i] + arc[0]
                    here.append((i, x, (arc[1],)))
                    if x > a:
                        a = x + log1p(exp(a - x))
                    elif x > a - 40:  # less does not change a double
                        a += log1p(exp(x - a))
                i -= 1
            alpha.append(a)
            if arcs is not None:
                arcs.append([(i, exp(x - a), ids) for i, x, ids in here])

    def log_probs(self, words: list[str]) -> list[float]:
        """Natural logarithms of the sums over all segmentations of words; the empty word is the end. Words are taken in their order, each going on from the prefix that it shares with the last."""
        out, last, alpha = [0.0] * len(words), META, [0.0]
        for k in sorted(range(len(words)), key=words.__getitem__):
            if words[k] == END:
                out[k] = self.weight[self.end]
                continue
            s = META + words[k]
            del alpha[_common(last, s) + 1 :]
            self._extend(s, alpha)
            out[k], last = alpha[-1], s
        return out

    def log_prob(self, word: str) -> float:
        return self.log_probs([word])[0]

    def expect(self, word: str, times: float, counts: list[float]) -> None:
        """Add the expected uses of each piece in `times` occurrences of a word."""
        self.expect_all([word], counts, times)

    def expect_all(self, words: list[str], counts: list[float], times: float = 1.0) -> None:
        """Add the expected uses of each piece in the words, `times` for each. What arrives at a place, from all words with that prefix, is handed back to where its last pieces start, by their shares, once the words have left the prefix."""
        last, alpha, arcs, mass = "", [0.0], [[]], [0.0]

        def leave(k: int) -> None:
            while len(alpha) > k + 1:
                alpha.pop()
                here, m = arcs.pop(), mass.pop()
                for i, share, ids in here:
                    use = m * share
                    mass[i] += use
                    for piece in ids:
                        counts[piece] += use

        for word in sorted(words):
            if word == END:
                counts[self.end] += times
                continue
            s = META + word
            leave(_common(last, s))
            self._extend(s, alpha, arcs)
            mass += [0.0] * (len(alpha) - len(mass))
            mass[-1] += times
            last = s
        leave(0)


def _common(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    return k


def tokens(text: Column) -> Column:
    """Lower-cased words of a text, then the end. lower() does to ASCII texts what is asked, A-Z alone; translate(), which is slow, is left to the others. Splitting at one plain character needs no regular expression."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, *LOWER))
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.concat(F.array_remove(F.split(text, " "), ""), F.array(F.lit(END)))


def _theta(words: DataFrame, total: int, distinct: int) -> float:
    """The mass of spelled words, in occurrences: the value of the grid with the best leave-one-out likelihood of all training words."""
    c, spelled = F.col("c"), F.col("spelled")

    def fit(theta: float) -> Column:
        left = F.when(c == 1, math.log(theta) + spelled * math.log(10)).otherwise(F.log(c - 1 + theta * F.pow(F.lit(10.0), spelled)))
        return F.sum(c * (left - math.log(max(total, 1) - 1 + theta)))

    tried = [m * (distinct + 1) for m in GRID]
    fits = words.where("c > 0").agg(*[fit(t).alias(f"f{k}") for k, t in enumerate(tried)]).first()
    return max(zip([f if f is not None else 0.0 for f in fits], tried, strict=True), key=lambda p: (round(p[0], 6), p[1]))[1]


def score(docs: DataFrame, train: Column, pieces: list[tuple[str, float, str]]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`; `train` says which rows to learn from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", train.alias("train"), tokens(F.col("text")).alias("words"))
    counted = rows.select("train", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("train")).alias("c"), F.count(F.lit(1)).alias("n"))
    counted = cut(counted)
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count_if(F.col("c") > 0).alias("V"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    heavy = F.col("n") > sums["all"] / HEAVY
    size = len(pieces) + 1
    lattice, top = Lattice(pieces), [r.word for r in counted.where(F.col("c") > sums["N"] / HEAVY).select("word").orderBy("word").collect()]  # fewer than HEAVY rows, by training text alone
    for _ in range(ROUNDS):
        gathered = [0.0] * size
        lattice.expect_all(top, gathered)
        lattice = Lattice(pieces, {i: x for i, x in enumerate(gathered) if x > 0})
    first = spark.sparkContext.broadcast(lattice)

    def expected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [0.0] * size
        for f in frames:
            first.value.expect_all(list(f["word"]), counts)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"piece": at.astype("int32"), "uses": np.array(counts)[at]})

    uses = counted.where("c > 0").select("word").mapInPandas(expected, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    model = spark.sparkContext.broadcast(Lattice(pieces, {r.piece: round(r.uses, 6) for r in uses.collect()}))  # at most one row for each piece of the vocabulary

    @F.pandas_udf("double")
    def marginal(words: pd.Series) -> pd.Series:
        return pd.Series(model.value.log_probs(list(words)), dtype="float64") / math.log(10)

    known = counted.select("word", "c", F.log10((F.col("c") + ADD) / (sums.N + ADD * (sums.V + 1))).alias("base"), marginal("word").alias("spelled"), "n")
    known = cut(known)
    drop_cut(counted)
    spelled = F.col("spelled")
    theta = _theta(known, sums.N, sums.V)
    whole = F.log10("c") + F.log1p(theta / F.col("c") * F.pow(F.lit(10.0), spelled)) / math.log(10)
    known = known.select("word", (F.col("c") > 0).alias("known"), "base", "n", (F.when(F.col("c") > 0, whole).otherwise(math.log10(theta) + spelled) - math.log10(sums.N + theta)).alias("lattice"))
    often = F.broadcast(known.where(heavy).select("word", "known", "base", "lattice"))
    seldom = known.where(~heavy).select(F.col("word").alias("rw"), F.col("known").alias("rk"), F.col("base").alias("rb"), F.col("lattice").alias("rl")).hint("shuffle_hash")
    # rows are told apart by an internal number; a word looked up in the broadcast table goes to a partition by row, not by word
    terms = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), tokens(F.col("text")).alias("words")).select("doc_id", "row", F.explode("words").alias("word"))
    here = terms.join(often, "word", "left").groupBy("doc_id", "row")
    frequent = F.col("lattice").isNotNull()
    looked = terms.join(often, "word", "left").where(~frequent).select("doc_id", "row", "word")
    rare = looked.join(seldom, F.col("word") == F.col("rw")).groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if("rk").alias("n_known"), F.sum("rb").alias("base_score"), F.sum("rl").alias("score"))
    total = here.agg(F.count_if(frequent).alias("n_tokens"), F.count_if(frequent & F.col("known")).alias("n_known"), F.coalesce(F.sum("base"), F.lit(0.0)).alias("base_score"), F.coalesce(F.sum("lattice"), F.lit(0.0)).alias("score"))
    total = total.unionByName(rare).groupBy("doc_id", "row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return total.select("doc_id", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(int(sums.N)).cast("long").alias("train_tokens"), "base_score", "score")
