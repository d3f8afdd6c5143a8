"""Chat formatting by rotation of perspectives.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant and all others as
named users; system turns stay system turns. The mask lists the code-point spans that are trained on: the speaker's
own texts with their end mark.

A rendering is handed out in parts of ``PART`` consecutive turn numbers, so a dialogue of any length is never gathered in one
row. ``begin`` counts the code points of the rendering before a part, and the spans of the mask count from the start of the
rendering: parts joined by number are the whole rendering and its whole mask, whatever the size of a part.

Null text is empty. A null turn counts as number 0 and stands before the others of its part. Turns with equal numbers are ordered by role and
text; repeated rows are repeated turns. A null role speaks as ``unknown`` and has no perspective, like ``system``; a
dialogue without other roles is not rendered. A null dialogue id is a dialogue. Marks inside texts are broken up by a
blank. Only the four columns named are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running, stored

PART = 64
SYSTEM, NOBODY, END = "system", "unknown", "<|end|>\n"


def rotated(turns: DataFrame, dialogue: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            part: int = PART) -> DataFrame:
    """(conv_id, part, speaker, begin, n_turns, rendered, mask) per dialogue, part and participant."""
    rows = turns.select(F.col(dialogue).alias("conv_id"), F.floor(F.coalesce(F.col(turn), F.lit(0)) / part).alias("part"),
                        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(NOBODY)).alias("role"),
                                 F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")).alias("t"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    speakers = (turns.where(F.col(role).isNotNull() & (F.col(role) != SYSTEM))
                .select(F.col(dialogue).alias("_conv"), F.col(role).alias("speaker")).distinct())
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    head = lambda t: (F.when(t["role"] == F.col("speaker"), F.lit("<|assistant|>\n"))
                      .when(t["role"] == SYSTEM, F.lit("<|system|>\n"))
                      .otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n"))))
    both = both.select("conv_id", "part", "speaker", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("own"))).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    both = stored(both.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_key"), "*", whole.alias("rendered")))
    begins = running(both.select("_key", "speaker", "part", F.char_length("rendered").cast("long").alias("chars")), ["_key", "speaker"], "part", "chars", "begin")
    both = both.join(begins.drop("chars"), ["_key", "speaker", "part"])

    def add(state, p):
        start = state["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["body"])
        span = F.concat_ws(":", start, end)
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.col("begin").alias("at"), F.array().cast("array<string>").alias("spans"))
    mask = F.aggregate("pieces", start, add, lambda s: F.array_join(s["spans"], ","))
    return both.select("conv_id", "part", "speaker", "begin", F.size("pieces").cast("long").alias("n_turns"), "rendered", mask.alias("mask"))


SQL = """
with t as (
  select conv_id, floor(coalesce(turn, 0) / 64.0)::bigint as part, turn, coalesce(role, 'unknown') as role,
         replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) as body
  from conversations),
s as (select distinct conv_id, role as speaker from conversations where role is not null and role <> 'system'),
p as (
  select t.*, s.speaker, t.role = s.speaker as own,
         case when t.role = s.speaker then '<|assistant|>' when t.role = 'system' then '<|system|>'
              else '<|user name=' || t.role || '|>' end || chr(10) as head
  from t join s on t.conv_id is not distinct from s.conv_id),
o as (
  select *, row_number() over w as k, sum(length(head) + length(body)) over w as hi
  from p window w as (partition by conv_id, speaker order by part, turn nulls first, role, body rows unbounded preceding))
select conv_id, part, speaker, min(hi - length(head) - length(body))::bigint as begin, count(*) as n_turns, string_agg(head || body, '' order by k) as rendered,
       coalesce(string_agg((hi - length(body))::varchar || ':' || hi::varchar, ',' order by k) filter (where own), '') as mask
from o group by conv_id, part, speaker
"""
