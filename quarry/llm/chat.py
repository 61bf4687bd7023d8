"""Preference formatting: shared prompt, paired completions, loss masks.

A pair of conversations, chosen and rejected, is cut at their longest common prefix of
turns (equal role and text). The prefix is rendered once as the prompt; what follows of
each is its completion, with the spans that count for the loss: the texts of the
assistant's turns and their end marks. All of it is DataFrame functions.

Defined results: a null role or text is empty; turns are ordered by number, then role,
then text, nulls first, and repeated turns all count; equal conversations have empty
completions; an empty conversation shares nothing; a conversation without an assistant
turn has no loss spans. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BREAK, END = "<|", "|>\n", "<|end|>\n"


def turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.transform(ordered, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def shared_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


def _head(t: Column) -> Column:
    return F.concat(F.lit(START), t.role, F.lit(BREAK))


def render(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda t: F.concat(_head(t), t.text, F.lit(END))), "")


def spans(part: Column, role: str = "assistant") -> Column:
    """``start-end`` of what counts for the loss, joined by commas."""
    size = lambda t: F.length(_head(t)) + F.length(t.text) + len(END)
    step = lambda s, t: F.struct(
        (s.at + size(t)).alias("at"),
        F.when(t.role == role, F.concat(s.found, F.array(F.concat((s.at + F.length(_head(t))).cast("string"), F.lit("-"), (s.at + size(t)).cast("string"))))).otherwise(s.found).alias("found"),
    )
    return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found")), step, lambda s: F.array_join(s.found, ","))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """From ``pair_id, chosen, rejected`` (arrays of turns): prompt, completions and their loss spans."""
    n = shared_turns(F.col("chosen"), F.col("rejected"))
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n_prompt_turns")))
    cut = pairs.withColumn("n_prompt_turns", n).select("pair_id", "n_prompt_turns", F.slice("chosen", 1, F.col("n_prompt_turns")).alias("prompt"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return cut.select("pair_id", "n_prompt_turns", render(F.col("prompt")).alias("prompt"), render(F.col("c")).alias("chosen"), spans(F.col("c")).alias("chosen_spans"), render(F.col("r")).alias("rejected"), spans(F.col("r")).alias("rejected_spans"))


def branched_pairs(rows: DataFrame) -> DataFrame:
    """Pairs from plain conversations, every one with all its turns: chosen is the conversation;
    rejected keeps the first half of its turns (rounded up) and goes on as the conversation
    whose id differs in the lowest bit does from there, if there is one."""
    all_ = turns(rows)
    other = all_.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("turns").alias("other"))
    half = F.ceil(F.size("turns") / 2).cast("int")
    tail = F.when(F.size("other") > half, F.slice("other", half + 1, F.greatest(F.lit(1), F.size("other") - half))).otherwise(F.slice("turns", 1, 0))
    joined = all_.join(other, "conv_id", "left")
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", 1, half), tail).alias("rejected"))


ORACLE = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations
), ends AS (SELECT c, max(k) AS n FROM t GROUP BY c),
u AS (SELECT t.c, t.k, t.role, t.text, e.n, CAST(ceil(e.n / 2.0) AS BIGINT) AS h FROM t JOIN ends e ON t.c = e.c WHERE t.k <= e.n),
rejected AS (
  SELECT c, k, role, text FROM u WHERE k <= h
  UNION ALL
  SELECT e.c, u.k, u.role, u.text FROM u JOIN ends e ON e.c = xor(u.c, 1::BIGINT) WHERE u.k > CAST(ceil(e.n / 2.0) AS BIGINT)
), both_sides AS (
  SELECT coalesce(a.c, b.c) AS c, coalesce(a.k, b.k) AS k, a.k IS NOT NULL AND b.k IS NOT NULL AND a.role = b.role AND a.text = b.text AS same
  FROM u a FULL JOIN rejected b ON a.c = b.c AND a.k = b.k
), cut AS (SELECT c, coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS p FROM both_sides GROUP BY c),
sized AS (
  SELECT side, x.c, x.k, x.role, '<|' || role || '|>' || chr(10) AS head, text, p, x.k > p AS later FROM (
    SELECT 'c' AS side, c, k, role, text FROM u UNION ALL SELECT 'r', c, k, role, text FROM rejected) x JOIN cut ON cut.c = x.c
), placed AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS shown,
         coalesce(sum(length(head) + length(text) + {len(END)}) FILTER (later) OVER (PARTITION BY side, c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM sized
)
SELECT c AS pair_id, CAST(max(p) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 'c' AND NOT later), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 'c' AND later), '') AS chosen,
  coalesce(string_agg(CAST(off + length(head) AS VARCHAR) || '-' || CAST(off + length(shown) AS VARCHAR), ',' ORDER BY k) FILTER (side = 'c' AND later AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(shown, '' ORDER BY k) FILTER (side = 'r' AND later), '') AS rejected,
  coalesce(string_agg(CAST(off + length(head) AS VARCHAR) || '-' || CAST(off + length(shown) AS VARCHAR), ',' ORDER BY k) FILTER (side = 'r' AND later AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY c
"""
