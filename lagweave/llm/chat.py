r"""Chat formatting by perspective rotation, in DataFrame functions.

Every participant of a conversation gets a rendering in which they speak as the
assistant and all others as named users; system turns are instructions and
belong to nobody. A rendering comes with the spans, in code points, of the
participant's own words: the loss mask.

Turns stand in the order of turn, role and text, nulls first; repeated rows are
repeated turns. A null role is the participant `unknown`, a null text an empty
one; rows with a null conv_id are one conversation of that id. The opening of a
marker inside a text or a role is written `<\|`, and in a role its closing `|\>`
and a line feed as a space, so neither can forge a turn. Two roles that differ in
that alone stay two participants. A
conversation with system turns alone has no participant and no rendering. Other
columns are ignored. A rendering is one value, so a dialogue must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _safe(role: Column) -> Column:
    for old, new in (("<|", "<\\|"), ("|>", "|\\>"), ("\n", " ")):
        role = F.replace(role, F.lit(old), F.lit(new))
    return role


def rotate(turns: DataFrame, system: str = "system") -> DataFrame:
    """conv_id, perspective, n_turns, n_own, rendered, mask_spans ("start:end" joined by commas) of every participant of every conversation."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("text"))
    whole = Window.partitionBy("conv_id")
    cast = rows.withColumn("perspective", F.array_sort(F.collect_set(F.when(F.col("role") != system, F.col("role"))).over(whole)))
    each = cast.withColumn("perspective", F.explode("perspective"))
    own = F.col("role") == F.col("perspective")
    head = F.when(F.col("role") == system, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), _safe(F.col("role")), F.lit("|>\n")))
    each = each.select("conv_id", "perspective", "turn", "role", "text", own.alias("own"), head.alias("head"), F.concat(head, F.col("text"), F.lit("<|end|>\n")).alias("part"))
    order = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = each.withColumn("ord", F.row_number().over(order)).withColumn("past", F.coalesce(F.sum(F.length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("past") + F.length("head")
    span = F.when(F.col("own"), F.concat(start.cast("string"), F.lit(":"), (start + F.length("text")).cast("string")))
    placed = placed.withColumn("span", span)
    grouped = placed.groupBy("conv_id", "perspective").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("own")).alias("n_own"),
        F.array_sort(F.collect_list(F.struct("ord", "part", "span"))).alias("s"),
    )
    return grouped.select("conv_id", "perspective", "n_turns", "n_own", F.array_join(F.col("s.part"), "").alias("rendered"), F.array_join(F.col("s.span"), ",").alias("mask_spans"))


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'),
e AS (SELECT r.conv_id, perspective, turn, role, text, role = perspective AS own,
  CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(replace(replace(role, '<|', '<\|'), '|>', '|\>'), chr(10), ' ') || '|>' || chr(10) END AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, head || text || '<|end|>' || chr(10) AS part, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text) AS ord FROM e),
s AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY conv_id, perspective ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS a FROM o)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own, string_agg(part, '' ORDER BY ord) AS rendered,
  coalesce(string_agg((a::VARCHAR) || ':' || ((a + length(text))::VARCHAR), ',' ORDER BY ord) FILTER (WHERE own), '') AS mask_spans
FROM s GROUP BY conv_id, perspective
"""
