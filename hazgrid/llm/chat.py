"""Preference formatting of chat turns, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once as the prompt; what
follows on either side is rendered as a completion whose mask says which turns train.

Scale: rows stay turns. One partial aggregation by (pair, turn, role, text) tells which sides have a turn, another finds
each pair's first turn where the sides differ, and offsets are sums over blocks of turns, so that no conversation is ever
gathered into one row or one task, however long. A hot first turn or text spreads over its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one part that a window sums at a time.
BLOCK = 1024
# The marks around a rendered turn.
START, END = "<|im_start|>", "<|im_end|>"


def preference_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (pair_id, side 'chosen' or 'rejected', turn, role, text) as rows of rendered parts.

    Result: pair_id, part ('prompt', 'chosen' or 'rejected'), turn, role, rendered, mask (the turn trains: an assistant's
    turn of a completion), start_char and end_char (its place in the part's text, in turn order).

    Nulls: a null turn comes before all others, a null role renders as 'user', a null text as empty; a row whose pair_id
    or side is null belongs to no pair and is left out. Repeated rows count once. Several different rows of one turn are
    rendered by role, then text, and the sides agree on that turn only if they have all of them in common. A pair with one
    side only has no prompt: all its turns are that side's completion. Further columns are ignored.
    """
    t = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).select(
        "pair_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        (F.col("side") == "chosen").alias("_c"),
    )
    t = t.groupBy("pair_id", "turn", "role", "text").agg(F.bool_or("_c").alias("_c"), F.bool_or(~F.col("_c")).alias("_r"))
    differs = t.where(~(F.col("_c") & F.col("_r"))).groupBy("pair_id").agg(F.min("turn").alias("_first"))
    t = t.join(differs, "pair_id", "left")
    common = F.col("_first").isNull() | (F.col("turn") < F.col("_first"))
    sides = F.when(common, F.array(F.lit("prompt"))).otherwise(F.filter(F.array(F.when(F.col("_c"), F.lit("chosen")), F.when(F.col("_r"), F.lit("rejected"))), lambda p: p.isNotNull()))
    rendered = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    t = t.select("pair_id", F.explode(sides).alias("part"), "turn", "role", "text", rendered.alias("rendered")).withColumn("_n", F.length("rendered"))
    t = t.withColumn("_block", F.floor(F.col("turn") / BLOCK))
    inside = Window.partitionBy("pair_id", "part", "_block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("pair_id", "part").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("pair_id", "part", "_block").agg(F.sum("_n").alias("_size"))
    blocks = blocks.select("pair_id", "part", "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    t = t.withColumn("_end", F.sum("_n").over(inside)).join(blocks, ["pair_id", "part", "_block"])
    return t.select(
        "pair_id", "part", "turn", "role", "rendered",
        ((F.col("part") != "prompt") & (F.col("role") == "assistant")).alias("mask"),
        (F.col("_before") + F.col("_end") - F.col("_n")).alias("start_char"), (F.col("_before") + F.col("_end")).alias("end_char"),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row a pair: prompt, chosen and rejected as texts, with chosen_mask and rejected_mask as arrays of [start, end)
    character ranges that train. For pairs that fit a row, as training examples do; ``preference_turns`` has no such bound."""
    parts = preference_turns(turns).groupBy("pair_id", "part").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "mask", "rendered"))).alias("_t"))
    text = F.array_join(F.transform("_t", lambda t: t["rendered"]), "")
    mask = F.transform(F.filter("_t", lambda t: t["mask"]), lambda t: F.array(t["start_char"], t["end_char"]))
    parts = parts.select("pair_id", "part", text.alias("_text"), mask.alias("_mask"))

    def of(part: str, column: str):
        return F.max(F.when(F.col("part") == part, F.col(column)))

    return parts.groupBy("pair_id").agg(
        *(F.coalesce(of(p, "_text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")),
        *(F.coalesce(of(p, "_mask"), F.array().cast("array<array<bigint>>")).alias(f"{p}_mask") for p in ("chosen", "rejected")),
    )


def replaced_replies(conversations: DataFrame) -> DataFrame:
    """Pairs of ``conversations`` (conv_id, turn, role, text) as turns of ``preference_turns``: a conversation is the chosen
    side; the rejected side has its turns but the last, and the last turn of the conversation whose conv_id differs in the
    lowest bit instead. Where there is no such conversation, the pair has no rejected side.

    A last turn that several rows have ends with the greatest role, then text. Nulls are as in ``preference_turns``; rows
    without conv_id are left out.
    """
    c = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ends = c.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("end"))
    other = ends.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("end").alias("other"))
    both = ends.join(other, "conv_id").select("conv_id", F.col("end.turn").alias("last"), "other")
    early = c.join(both.select("conv_id", "last"), "conv_id").where("turn < last").drop("last")
    late = both.select("conv_id", F.col("last").alias("turn"), "other.role", "other.text")
    chosen = c.withColumn("side", F.lit("chosen"))
    return chosen.unionByName(early.unionByName(late).withColumn("side", F.lit("rejected"))).withColumnRenamed("conv_id", "pair_id")


def op2_chat_formatting(spark, sf_dir):
    """Each conversation against itself with another one's last turn: prompt and both masked completions, as turns."""
    return preference_turns(replaced_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP2_SQL = """
WITH v AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1),
b AS (SELECT z.conv_id, z.turn AS last, o.role, o.text FROM z JOIN z o ON o.conv_id = xor(z.conv_id, 1)),
s AS (
  SELECT conv_id AS pair_id, turn, role, text, true AS c FROM v
  UNION ALL SELECT v.conv_id, v.turn, v.role, v.text, false FROM v JOIN b USING (conv_id) WHERE v.turn < b.last
  UNION ALL SELECT conv_id, last, role, text, false FROM b),
t AS (SELECT pair_id, turn, role, text, bool_or(c) AS c, bool_or(NOT c) AS r FROM s GROUP BY ALL),
d AS (SELECT pair_id, min(turn) AS first FROM t WHERE NOT (c AND r) GROUP BY pair_id),
m AS (
  SELECT t.*, first IS NULL OR turn < first AS common,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
  FROM t LEFT JOIN d USING (pair_id)),
p AS (
  SELECT *, 'prompt' AS part FROM m WHERE common
  UNION ALL SELECT *, 'chosen' FROM m WHERE NOT common AND c
  UNION ALL SELECT *, 'rejected' FROM m WHERE NOT common AND r),
o AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS e FROM p)
SELECT pair_id, part, turn, role, rendered, part <> 'prompt' AND role = 'assistant' AS mask,
       CAST(e - length(rendered) AS BIGINT) AS start_char, CAST(e AS BIGINT) AS end_char
FROM o
"""
