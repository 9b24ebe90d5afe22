"""Perspective rotation of multi-party dialogues, in DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant and the others as
named users; system turns stay system turns. The loss mask covers what the assistant says, with its end mark.

A dialogue is rendered in parts of PART turns, so that no row and no task grows with a dialogue: row number part holds turns
part * PART up to the next part, char_start is where its text begins in the whole rendering, and mask_spans are [start, end)
in characters of the whole rendering. Dialogues of up to PART turns are one row for each participant. Turn numbers and
character offsets come from prefix sums in two levels (counts of blocks, then rows in a block). What is put in order in one task is
a block: the turns of 64 turn numbers of a dialogue, or its turns without a number.

Defined cases: turns are ordered by turn, speaker and text, null turns last; repeated rows are turns of their own; null
text is empty text; a null or empty speaker is a user named UNKNOWN, not a participant; rows with a null conversation id
form one dialogue; dialogues of system turns alone, and empty tables, give no rows. In texts and names '<|' becomes '<\\|',
so that no text can forge a mark. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import Scratch

PART = 64
BLOCK = 64
SYSTEM = "system"
UNKNOWN = "unknown"
END = "<|end|>\n"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def numbered(turns: DataFrame) -> DataFrame:
    """With seq: the place of a turn in its dialogue, from 0. No task sorts a whole dialogue: rows are sorted in blocks of
    BLOCK turn numbers, and only the blocks' counts are summed along the dialogue."""
    last = F.lit(1 << 61).cast("long")
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn").cast("long") / BLOCK), last))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").count().select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    placed = turns.withColumn("row", F.row_number().over(inside) - 1)
    return placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", (F.col("base") + F.col("row")).alias("seq"), "speaker", "text")


def _head(speaker: Column, perspective: Column) -> Column:
    return (
        F.when(speaker == perspective, F.lit("<|assistant|>\n"))
        .when(speaker == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _safe(F.coalesce(speaker, F.lit(UNKNOWN))), F.lit("|>\n")))
    )


def rotate(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, part, n_turns, n_masked, char_start, text, mask_spans ('start-end,start-end'). Its size is turns
    times participants, as every perspective holds the whole dialogue.

    Texts are shuffled twice, for their numbers and for their parts; participants, and where their parts begin, are worked out
    on lengths alone and joined to the parts where these stand."""
    speaker = F.nullif(F.col(speaker_col), F.lit(""))
    turns = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = numbered(turns).select("conv_id", F.floor(F.col("seq") / PART).alias("part"), "seq", "speaker", F.concat(_safe(F.col("text")), F.lit(END)).alias("body"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "speaker", "body"))).alias("items"))
    parts = Scratch(df.sparkSession, "rotation").save(parts, "parts")  # at most PART turns a row

    lengths = parts.select("conv_id", "part", F.explode(F.transform("items", lambda x: F.struct(x["speaker"].alias("speaker"), F.length(x["body"]).cast("long").alias("n")))).alias("x"))
    sums = lengths.groupBy("conv_id", "part", "x.speaker").agg(F.sum("x.n").alias("n"), F.count(F.lit(1)).alias("turns"))
    people = sums.where("speaker is not null").where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    sized = sums.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    sized = sized.groupBy("c", "perspective", "part").agg(F.sum(F.col("n") + F.col("turns") * F.length(_head(F.col("speaker"), F.col("perspective")))).alias("size"))
    earlier = W.partitionBy("c", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sized.select("c", "perspective", F.col("part").alias("p"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("long").alias("char_start"))

    shown = parts.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    pieces = F.transform("items", lambda x: F.struct(F.coalesce(x["speaker"] == F.col("perspective"), F.lit(False)).alias("own"), _head(x["speaker"], F.col("perspective")).alias("head"), x["body"].alias("body")))
    shown = shown.withColumn("pieces", pieces)
    zero = F.struct(F.col("char_start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, x):
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.concat_ws("-", a.cast("string"), b.cast("string"))
        return F.struct(b.cast("long").alias("at"), F.when(x["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return shown.select(
        "conv_id",
        "perspective",
        "part",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda x: x["own"])).cast("long").alias("n_masked"),
        "char_start",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.aggregate("pieces", zero, step, lambda acc: F.array_join(acc["spans"], ",")).alias("mask_spans"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, nullif(role, '') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, nullif(role, '') NULLS FIRST, coalesce(text, '')) - 1 AS seq
  FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
r AS (
  SELECT conv_id, perspective, seq, seq // 64 AS part, coalesce(speaker = perspective, false) AS own,
         CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || replace(coalesce(speaker, 'unknown'), '<|', '<\|') || '|>' || chr(10) END AS head,
         replace(text, '<|', '<\|') || '<|end|>' || chr(10) AS body
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
s AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY seq) AS stop FROM r)
SELECT conv_id, perspective, part::BIGINT AS part, count(*)::BIGINT AS n_turns, sum(own::INT)::BIGINT AS n_masked,
       min(stop - length(head) - length(body))::BIGINT AS char_start, string_agg(head || body, '' ORDER BY seq) AS text,
       coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY seq) FILTER (WHERE own), '') AS mask_spans
FROM s GROUP BY conv_id, perspective, part
"""
