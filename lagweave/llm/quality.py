"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Metrics are columns over whole texts; a rule is a condition that rejects a
document, on metrics or, where it has one of its own, on the text `t` and
evaluated only when its turn comes. plan() measures every rule's own cost and
rejections on a bounded sample and puts the rules in the order of rejections per
second; cascade() tests them in that order and evaluates no rule after the first
that rejects. The verdict doesn't depend on the order.

Null texts count as empty: no words, all metrics 0, rejected for having too few
words. Lines that are equal count as repeats from the second on; lines without
a word never do. Repeated rows are judged each for itself; other columns of the
table are not touched.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagweave.llm.common import WORD

SYMBOLS = r"[#*$%&|<>]"
#: Rows on which plan() measures rules, and code points that a text may have to be one of them: what the driver holds at most. No verdict depends on the sample.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 100_000


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Words in windows found twice or more, from the hash of each window in the order of the text."""

    def from_sorted(s: Column) -> Column:
        twice = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: a.h == b.h)

        def places(t: Column) -> Column:
            again = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(F.get(t, i), F.lit(False)) | F.coalesce(F.get(t, i - 1), F.lit(False)), x.i)), lambda x: x.isNotNull())
            return _let(F.array_sort(again), lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda acc, x: acc + x))

        return _let(twice, places)

    return _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), from_sorted)


def repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows found at least twice in the list, the first window included."""

    def from_words(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))
        return _let(windows, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(_covered(t)))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), from_words)


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of every row, and its text t for rules with metrics of their own."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    parts = text.select(
        "doc_id",
        "t",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("l"),
        F.regexp_count("t", F.lit(SYMBOLS)).alias("s"),
    )
    return parts.select(
        "doc_id",
        "t",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.col("s").cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )


#: The base rules, then those of the method; each rejects where its condition is true.
BASE = {"few_words": "n_words < 50", "repeated_words": "100 * n_repeat_words > 50 * n_words"}
Rule = str | Callable[[], Column]
# Patterns: a line with a word, a word with a letter, an ellipsis that ends a line, a bullet that begins one.
LINE, LETTERS = r"[^\x20\x09-\x0D][^\n]*", r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*"
CUT_LINE, BULLET = r"(?:\.\.\.|…)[ \t]*(?:\n|\z)", r"(?:\A|\n)[ \t]*[-*•‣▪–][ \t]"


def _count(pattern: str) -> Column:
    return F.regexp_count("t", F.lit(pattern))


RULES: dict[str, Rule] = {
    **BASE,
    "short_words": "2 * n_words > word_chars",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_dup_lines >= 5 and 10 * n_dup_lines > n_words",
    "cut_lines": lambda: 10 * _count(CUT_LINE) > 3 * _count(LINE),
    "bullet_lines": lambda: 10 * _count(BULLET) > 9 * _count(LINE),
    "few_words_with_letters": lambda: 2 * _count(LETTERS) < F.col("n_words"),
    "few_characters": lambda: F.size(F.array_distinct(F.split("t", ""))) < 8,
}


def _condition(rule: Rule) -> Column:
    return F.expr(rule) if isinstance(rule, str) else rule()


def plan(docs: DataFrame, rules: dict[str, Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of `rules`, the most rejections per second on a bounded sample first. The sample is read as Spark reads the first rows of a table, from as few partitions as have them; a rule's cost is what it adds to the metrics, which every row needs anyway."""
    texts = [r.text for r in docs.select("text").where(F.length("text") < SAMPLE_CHARS).limit(rows).collect()]
    if not texts:
        return sorted(rules)
    spark = docs.sparkSession
    sample = metrics(spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in texts])).alias("text"), F.lit(0).alias("doc_id")))
    needed = F.bit_xor(F.xxhash64("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")).alias("x")

    def run(condition: Column) -> tuple[int, float]:
        took, job = [], sample.agg(needed, F.count_if(condition).alias("k"))
        for _ in range(3):
            began = time.perf_counter()
            k = job.first().k
            took.append(time.perf_counter() - began)
        return k, min(took)

    _, alone = run(F.lit(False))
    worth = {}
    for name, rule in rules.items():
        rejected, took = run(_condition(rule))
        worth[name] = (rejected + 0.5) / len(texts) / max(1e-3, took - alone)
    return sorted(rules, key=lambda k: (-worth[k], k))


def cascade(order: list[str], rules: dict[str, Rule] = RULES) -> Column:
    """The first rule in `order` that rejects, or null; a CASE stops at the first true branch, so the metrics that later rules have of their own are not computed."""
    out = F
    for name in order:
        out = out.when(_condition(rules[name]), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, rules: dict[str, Rule] = RULES, order: list[str] | None = None) -> DataFrame:
    """The metrics of every row with base_failed and kept; `order` of the rules, if not to be planned."""
    measured = metrics(docs)
    base = F.expr(" or ".join(f"({c})" for c in BASE.values()))
    return measured.select("*", base.alias("base_failed"), cascade(order or plan(docs, rules), rules).isNull().alias("kept")).drop("t")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS l FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
own AS (SELECT doc_id, len(regexp_extract_all(x, '(?:\.\.\.|…)[ \t]*(?:\n|\z)')) AS cut, len(regexp_extract_all(x, '(?:\A|\n)[ \t]*[-*•‣▪–][ \t]')) AS bullets,
  len(regexp_extract_all(x, '[^\x20\x09-\x0D][^\n]*')) AS n_lines, len(regexp_extract_all(x, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) AS lettered,
  len(list_distinct(string_split(x, ''))) AS n_chars FROM t)
SELECT m.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 2 * n_words > word_chars OR word_chars > 15 * n_words
    OR 10 * n_symbols > 3 * n_words OR (n_dup_lines >= 5 AND 10 * n_dup_lines > n_words)
    OR 10 * cut > 3 * n_lines OR 10 * bullets > 9 * n_lines OR 2 * lettered < n_words OR n_chars < 8) AS kept
FROM m JOIN own USING (doc_id)
"""
