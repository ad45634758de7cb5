"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the assistant and
all others as named users; only the assistant's words (and the mark that ends them) are trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns

#: The marks of the chat markup, and the roles that nobody takes the perspective of.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NARRATORS = ("system",)
NOBODY = "unknown"


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """A row for each turn of each perspective: conv_id, perspective, turn, speaker, out_role, name, segment, mask_start, mask_end, trained.

    segment is the rendered turn; a perspective's segments by turn (then speaker, then segment) are its dialogue.
    mask_start and mask_end are code points of the segment, end exclusive, equal where nothing is trained. A dialogue
    in one row would hold an unbounded group, so the dialogue stays a run of rows; ``in_order`` sorts them for writing.

    Speakers are told apart by their exact name. Null names are the participant "unknown"; narrators (system) keep
    their role in every perspective and have none of their own, so a conversation of narrators alone gives no rows.
    Null conversation ids are one conversation. Null texts render empty. Markup inside texts is broken by a space, so
    that nobody speaks for others. Rows with equal turns stay separate rows. Texts may be of any length; an empty table
    gives no rows; other columns don't matter.

    The output has every turn once for each participant: a conversation of very many speakers gives turns times
    speakers rows, by what is asked for. One shuffle of the turns by conversation; participants are distinct names, found with partial aggregation. A
    conversation that holds many of the rows is split by Spark's skew join, as both sides are plain exchanges.
    """
    turns = columns(df, conv=conv_col, turn=turn_col, speaker=F.coalesce(F.col(f"`{role_col}`"), F.lit(NOBODY)), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    turns = turns.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null")))
    seats = turns.where(~F.col("speaker").isin(*narrators)).select(F.col("key"), F.col("speaker").alias("perspective")).distinct()
    return render(turns.join(seats, "key"), narrators)


def render(every: DataFrame, narrators: tuple[str, ...]) -> DataFrame:
    """The segments and masks of rows with conv, perspective, turn, speaker, text."""
    out_role = F.when(F.col("speaker").isin(*narrators), F.col("speaker")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    tame = lambda c: F.replace(F.replace(c, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    name = F.when(F.col("out_role") == "user", F.col("speaker"))
    named = F.coalesce(F.concat(F.lit(" name="), tame(F.regexp_replace("name", r"[\r\n]+", " "))), F.lit(""))
    head = F.concat(F.lit(OPEN), F.col("out_role"), named, F.lit("\n"))
    trained = F.col("out_role") == "assistant"
    return (
        every.withColumn("out_role", out_role)
        .withColumn("name", name)
        .withColumn("head", head)
        .withColumn("body", F.concat(tame(F.col("text")), F.lit(CLOSE)))
        .select(
            F.col("conv").alias("conv_id"),
            "perspective",
            "turn",
            "speaker",
            "out_role",
            "name",
            F.concat("head", "body", F.lit("\n")).alias("segment"),
            F.length("head").cast("long").alias("mask_start"),
            (F.length("head") + F.when(trained, F.length("body")).otherwise(0)).cast("long").alias("mask_end"),
            trained.alias("trained"),
        )
    )


def in_order(rotated: DataFrame) -> DataFrame:
    """The rows dealt and sorted so that files written from them hold dialogues in order; no group meets in one task."""
    by = ["conv_id", "perspective", "turn", "speaker", "segment"]
    return rotated.repartitionByRange(*by).sortWithinPartitions(*by)


#: DuckDB: the same rows.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), seats AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), every AS (
  SELECT t.conv_id, s.perspective, t.turn, t.speaker,
    CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = s.perspective THEN 'assistant' ELSE 'user' END AS out_role,
    replace(replace(t.text, '<|', '< |'), '|>', '| >') || '<|im_end|>' AS body
  FROM turns t JOIN seats s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), heads AS (
  SELECT *, CASE WHEN out_role = 'user' THEN speaker END AS name,
    '<|im_start|>' || out_role || CASE WHEN out_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM every
)
SELECT conv_id, perspective, turn, speaker, out_role, name, head || body || chr(10) AS segment,
  CAST(length(head) AS BIGINT) AS mask_start,
  CAST(length(head) + CASE WHEN out_role = 'assistant' THEN length(body) ELSE 0 END AS BIGINT) AS mask_end,
  out_role = 'assistant' AS trained
FROM heads
"""
