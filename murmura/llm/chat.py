"""Multi-party perspective rotation of dialogues.

Each participant of a conversation gives one rendering of it, in which their turns are the
assistant's and everyone else's are those of users with names; turns of system roles stay what they
are and make no perspective. The loss mask covers what the assistant says, with its end mark.

A rendering isn't gathered into one value, so that a conversation of any length can be rendered: there
is one row for each turn and perspective, holding the turn's text as rendered and its place in the
whole rendering. Joining the segments of a (conversation, perspective) by char_start gives the
rendering. Places are running sums in two levels: within blocks of _BLOCK turn numbers, and over the
sums of blocks, so that a conversation that holds much of the table is spread over tasks.

Defined results: a null role is the speaker 'unknown', a null text is empty; turns with equal numbers
are ordered by speaker and text, null numbers come first; a null conv_id is a conversation of its own;
repeated rows are repeated turns; a conversation of system turns only gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = 256
#: The marks around a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, char_start, char_end, mask_start, mask_end."""
    base = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    )
    is_system = F.col("speaker").isin(*system_roles) if system_roles else F.lit(False)
    people = base.where(~is_system).select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = base.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(is_system, "system").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.when(role == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(F.lit("")), F.lit("\n"))
    seen = seen.select(
        "conv_id", "perspective", "turn", "speaker", "body", role.alias("role"), name.alias("name"), F.concat(head, "body", F.lit(CLOSE)).alias("segment"),
        F.length(head).alias("head_chars"), F.floor(F.col("turn") / _BLOCK).alias("block"),
    ).withColumn("chars", F.length("segment").cast("long"))
    keys = ["conv_id", "perspective", "block"]
    sums = seen.groupBy(*keys).agg(F.sum("chars").alias("block_chars"))
    by_block = Window.partitionBy("conv_id", "perspective").orderBy(F.col("block").asc_nulls_first())
    before = sums.select(*[F.col(c).alias(f"b_{c}") for c in keys], F.coalesce(F.sum("block_chars").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = seen.join(before, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in keys])
    in_block = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "speaker", "body").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before") + F.sum("chars").over(in_block)
    out = placed.select("conv_id", "perspective", "turn", "role", "name", "segment", "chars", "head_chars", end.alias("char_end"))
    start = F.col("char_end") - F.col("chars")
    said = F.col("role") == "assistant"
    return out.select(
        "conv_id", "perspective", "turn", "role", "name", "segment", start.alias("char_start"), "char_end",
        F.when(said, start + F.col("head_chars")).alias("mask_start"), F.when(said, F.col("char_end") - 1).alias("mask_end"),
    )


ORACLE = f"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM base WHERE speaker <> 'system'
), seen AS (
  SELECT b.conv_id, p.perspective, b.turn, b.speaker, b.body,
    CASE WHEN b.speaker = p.perspective THEN 'assistant' WHEN b.speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM base b JOIN people p ON b.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '{OPEN}' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM seen
), rendered AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end
  FROM rendered
)
SELECT conv_id, perspective, turn, role, name, segment, CAST(char_end - length(segment) AS BIGINT) AS char_start, char_end,
  CASE WHEN role = 'assistant' THEN CAST(char_end - length(segment) + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN role = 'assistant' THEN char_end - 1 END AS mask_end
FROM placed
"""
