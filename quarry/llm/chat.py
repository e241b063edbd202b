"""Chat formatting by perspective rotation, in DataFrame operations alone.

For every participant of a conversation the dialogue is rendered once, with that speaker as the assistant
and the others as named users. The mask marks what the model is to learn: the participant's own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import end_to_end, materialize, read

PART_CHARS = 1 << 20  # code points of roles and texts in a row, about; only longer dialogues take several
SYSTEM = ("system",)
END = "<|end|>"


def _plain(c):
    """Text that can't be taken for a mark of the format."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, part_chars: int = PART_CHARS, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """conv_id, part, participant, n_turns, n_own, rendered and mask of every perspective.

    ``turns`` has conv_id, turn, role (the speaker) and text. Participants are all speakers of the whole
    conversation but those named in ``system``, whose turns are rendered as such. A conversation without
    a participant gives no row. The mask is an array of struct<start, end> over code points of
    ``rendered``: the participant's texts with their end marks.

    A row holds the whole dialogue (part 0). One of more than ``part_chars`` goes on in further rows, cut
    between turns where that many are full, so that no task holds an unbounded one: ``rendered`` of the parts,
    joined by number, is the dialogue, and masks count within a part. Turns are in order of turn, then role,
    then text, nulls first; repeated rows are repeated turns. A null text is empty, a null role is rendered as
    a user named unknown and is no participant; rows with a null conv_id are one conversation. "<|" in texts
    and names becomes "< |". Other columns are ignored.
    """
    size = (F.coalesce(F.length("role"), F.lit(0)) + F.coalesce(F.length("text"), F.lit(0)) + 16).cast("long")
    rows = turns.select("conv_id", "turn", "role", "text")
    # sizes are summed before the exchange; only conversations too long for a row are put in order by ranges
    long = rows.groupBy("conv_id").agg(F.sum(size).alias("n")).where(F.col("n") > part_chars)
    long = materialize(long.select(F.col("conv_id").alias("_q_conv")), "long")
    held = F.struct("turn", "role", "text").alias("t")
    if long.isEmpty():
        dealt = rows.select("conv_id", F.lit(0).cast("long").alias("part"), held)
    else:
        same = F.col("conv_id").eqNullSafe(F.col("_q_conv"))
        short = rows.join(long, same, "left_anti").select("conv_id", F.lit(0).cast("long").alias("part"), held)
        placed = materialize(rows.join(long, same, "left_semi").withColumn("_q_size", size), "turns")
        placed = end_to_end(placed, ["conv_id", "turn", "role", "text"], "_q_size")
        begin = placed.groupBy(F.col("conv_id").alias("_q_conv")).agg(F.min(F.col("end_at") - F.col("_q_size")).alias("_q_begin"))
        placed = placed.join(materialize(begin, "begin"), same)
        part = F.floor((F.col("end_at") - F.col("_q_size") - F.col("_q_begin")) / part_chars).cast("long")
        dealt = short.unionByName(placed.select("conv_id", part.alias("part"), held))
    parts = dealt.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    speakers = turns.where(F.col("role").isNotNull() & ~F.col("role").isin(*system)).select(F.col("conv_id").alias("_q_conv"), F.col("role").alias("participant")).distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_q_conv"))).drop("_q_conv")

    def own(t):
        return F.coalesce(t["role"] == F.col("participant"), F.lit(False))

    def head(t):
        name = _plain(F.coalesce(t["role"], F.lit("unknown")))
        return F.when(own(t), "<|assistant|>\n").when(t["role"].isin(*system), "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(_plain(t["text"]), F.lit(END)).alias("body"), own(t).alias("own")))
    both = both.withColumn("pieces", pieces)
    span = "struct<start:int,end:int>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        here = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return both.select(
        "conv_id",
        "part",
        "participant",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("pieces", zero, step)["out"].alias("mask"),
    )


def op3_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every perspective of every conversation, as :func:`rotate` says, with the mask as start:end pairs."""
    out = rotate(read(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ","))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, CAST((sum(n) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) - n) // 1048576 AS BIGINT) AS part,
    turn, role, text FROM (SELECT *, coalesce(length(role), 0) + coalesce(length(text), 0) + 16 AS n FROM conversations)
), s AS (
  SELECT DISTINCT conv_id, role AS participant FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), p AS (
  SELECT t.*, s.participant, coalesce(t.role = s.participant, false) AS own,
    CASE WHEN t.role = s.participant THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name=' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || '|>' || chr(10) END AS head,
    replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' AS body,
    row_number() OVER (PARTITION BY t.conv_id, part, participant
      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, participant ORDER BY n
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM p
)
SELECT conv_id, part, participant, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
  coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(body) AS BIGINT), ',' ORDER BY n) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, part, participant
"""
