"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all others
as named users; the mask marks the characters that the model is to learn, those of the speaker's own turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import table

#: The markers of a turn, and the role whose turns are kept as they are and belong to nobody.
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def rotate(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, ...) -> a row for each conversation and participant: conv_id, speaker, n_turns,
    text, mask (array of [from, to) character spans of the speaker's turns, their end markers included).

    Participants are the distinct roles but `system`; turns come in order of `turn`, then role, then text, nulls first.
    A null role is the participant `unknown`, a null text an empty one; turns that repeat are kept; rows without a
    conv_id are left out; a conversation of system turns alone has no row; other columns are ignored. A conversation
    is one group (turns of one conversation are few); its turns are sorted in it, and its rotations are made from it
    by Spark's own expressions, so that no text is shuffled twice.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    talk = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM)))
    one = talk.select("conv_id", "turns", F.explode(speakers).alias("speaker"))

    def render(t):
        head = (
            F.when(t["role"] == F.col("speaker"), F.lit("assistant\n"))
            .when(t["role"] == SYSTEM, F.lit("system\n"))
            .otherwise(F.concat(F.lit("user name="), t["role"], F.lit("\n")))
        )
        return F.struct(
            (t["role"] == F.col("speaker")).alias("own"),
            F.concat(F.lit(START), head).alias("head"),
            F.concat(t["text"], F.lit(END)).alias("body"),
        )

    one = one.withColumn("parts", F.transform("turns", render))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("spans"))

    def step(state, p):
        a = state["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        spans = F.when(p["own"], F.concat(state["spans"], F.array(F.array(a, b)))).otherwise(state["spans"])
        return F.struct(b.alias("at"), spans.alias("spans"))

    mask = F.aggregate("parts", start, step, lambda s: s["spans"])
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "")
    return one.select("conv_id", "speaker", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s[0], s[1])), ",")
    return out.select("conv_id", "speaker", "n_turns", "text", spans.alias("mask"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT s.conv_id, s.speaker, t.k, t.role = s.speaker AS own,
        '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant' || chr(10) WHEN t.role = 'system' THEN 'system' || chr(10)
             ELSE 'user name=' || t.role || chr(10) END AS head,
        t.text || '<|im_end|>' || chr(10) AS body
      FROM s JOIN t USING (conv_id)),
p AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k) AS b FROM r)
SELECT conv_id, speaker, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(b - length(body) AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM p GROUP BY conv_id, speaker
"""
