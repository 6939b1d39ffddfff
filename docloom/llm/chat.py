"""Chat formatting by perspective rotation: for every participant, the dialogue with that speaker as assistant, the others as named users, and masks accordingly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import running_total, table

START, END = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, turn, role, name, segment, segment_start, mask_start, mask_end): each turn as each participant's rendering has it.

    A rendering is its segments in the order (turn, speaker, text), nulls first; they stay rows, with their place in it in
    code points, so that no dialogue has to fit one row. Of the assistant's turns, [mask_start, mask_end) covers the text
    and the end mark, on which a model is trained; other turns have none (null). `system` speaks to all and is no
    participant. A null speaker is `unknown`, blanks in names become `_`, a null text is empty, and a start or end mark
    inside a text is broken by a space. Null conversations and turns are values like any other, repeated rows are turns of
    their own, other columns are not read; an empty table, and a dialogue of system turns only, gives no rows.
    """
    name = F.coalesce(F.regexp_replace(F.col(speaker_col).cast("string"), r"[\x20\x09-\x0D]", "_"), F.lit("unknown"))
    text = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    own = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), name.alias("name"), text.alias("text"))
    people = own.where("name <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("name").alias("perspective")).distinct()
    seen = own.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    role = F.when(F.col("name") == "system", "system").when(F.col("name") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("role", role)
    head = F.concat(F.lit(START), "role", F.when(F.col("role") == "user", F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))
    seen = seen.withColumn("_head", F.length(head)).withColumn("segment", F.concat(head, "text", F.lit(END + "\n"))).withColumn("_long", F.length("segment").cast("long"))
    seen = seen.withColumn("_bucket", F.floor(F.col("turn") / 1024))
    placed = running_total(seen, ["conv_id", "perspective"], "_bucket", [F.asc("turn"), F.asc("name"), F.asc("text")], "_long", "_end")
    mine = F.col("role") == "assistant"
    start = F.col("_end") - F.col("_long")
    return placed.select("conv_id", "perspective", "turn", "role", "name", "segment", start.alias("segment_start"), F.when(mine, start + F.col("_head")).alias("mask_start"), F.when(mine, F.col("_end") - 1).alias("mask_end"))


def assembled(segments: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, masks) from rows of `rotate_perspectives`: each rendering as one text and the [start, end) ranges to train on, for dialogues that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("segment_start", "segment", "mask_start", "mask_end")))
    each = segments.groupBy("conv_id", "perspective").agg(parts.alias("p"))
    trained = F.filter("p", lambda x: x["mask_start"].isNotNull())
    return each.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("text"), F.transform(trained, lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end"))).alias("masks"))


def op8_chat(spark, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(regexp_replace(role, '[\\x20\\x09-\\x0D]', '_', 'g'), 'unknown') AS name, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id AS conv, name AS perspective FROM t WHERE name <> 'system'
), s AS (
  SELECT t.*, p.perspective, CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv
), h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM s
), g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h
), e AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM g)
SELECT conv_id, perspective, turn, role, name, segment, stop - length(segment) AS segment_start,
  CASE WHEN role = 'assistant' THEN stop - length(segment) + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN stop - 1 END AS mask_end
FROM e
"""
