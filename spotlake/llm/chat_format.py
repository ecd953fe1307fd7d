"""Conversations as training windows, in DataFrame operations only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. Each window holds the opening
system turn, a little repeated history (without loss) and its own span; the loss lies on the
assistant turns of the span, so every target counts once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.common import WORD

#: Fixed values of the template. A turn is TURN + role + line end + text + END + line end.
TURN, END = "<s>", "</s>"
#: Strings that a text may not show unescaped: the template's own and those of other common templates.
CONTROL = (TURN, END, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: The escapes: \\0 is a backslash, \\1 is < of a control string, \\2 is [ of a control string, \\3 is a line end in a role.
ESCAPES = (("[", "\\2"), ("<", "\\1"))


def escape(text: Column, control: Sequence[str] = CONTROL) -> Column:
    """Backslashes doubled up as \\0, and the first character of every control string replaced."""
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for first, code in ESCAPES:
        rests = "|".join(re.escape(c[1:]) for c in control if c[0] == first)
        if rests:
            out = F.regexp_replace(out, f"{re.escape(first)}(?={rests})", code.replace("\\", "\\\\"))
    return out


def unescape(text: Column) -> Column:
    for first, code in ESCAPES:
        text = F.replace(text, F.lit(code), F.lit(first))
    return F.replace(text, F.lit("\\0"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\3"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\3"), F.lit("\n")))


def windows(
    conversations: DataFrame, budget: int = 512, history: int = 64, turn_overhead: int = 4, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per window: conv_id, window (from 1), formatted, loss (array of start, end in code points), context (turns
    at the beginning that are repeated: the system turn from the second window on, and history), tokens.

    Tokens of a turn are its words and turn_overhead. Beside the system turn and the history a window has a room of
    budget - history - the system turn. Spans begin in successive strides of the room without the longest turn of the
    conversation, so that a window is filled but for about one turn and keeps the budget. If a turn is longer than half of
    the room, strides are half of it (a sixteenth of the budget at least), and a window may go over the budget by a turn
    that is longer than a stride; such a turn stays whole. History is the turns right before the span
    of at most `history` tokens in all, a stride at most. Turns go by turn, then role and text; nulls first. A null text
    or role counts as empty, a null conv_id is a conversation of its own, repeated rows are repeated turns. An empty
    table gives no rows. Other columns are not looked at, whatever their names.
    """
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + turn_overhead)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    system = F.when(F.first("role").over(everything) == "system", F.first("tokens").over(everything)).otherwise(F.lit(0))
    turns = rows.select("*", F.row_number().over(order).alias("i"), F.coalesce(F.sum("tokens").over(so_far), F.lit(0)).alias("before"), system.alias("system"))
    is_system = (F.col("i") == 1) & (F.col("system") > 0)
    room, longest = F.lit(budget) - F.lit(history) - F.col("system"), F.coalesce(F.max(F.when(~is_system, F.col("tokens"))).over(Window.partitionBy("conv_id")), F.lit(0))
    stride = F.greatest(room - longest, F.floor(room / 2), F.lit(max(1, budget // 16)))
    turns = turns.withColumns({"stride": stride, "at": F.greatest(F.col("before") - F.col("system"), F.lit(0)), "is_system": is_system}).withColumn("slot", F.floor(F.col("at") / F.col("stride")))

    by_slot = Window.partitionBy("conv_id").orderBy("slot")
    later = by_slot.rangeBetween(1, Window.unboundedFollowing)
    placed = turns.select(
        "conv_id", "i", "role", "text", "tokens", "is_system", "at", "stride", F.dense_rank().over(by_slot).alias("window"), F.min("at").over(later).alias("next_at"),
        F.max("slot").over(Window.partitionBy("conv_id")).alias("last_slot"),
    ).withColumn("n_windows", F.max("window").over(Window.partitionBy("conv_id")))
    repeats = ~F.col("is_system") & (F.col("next_at") - F.col("at") <= F.least(F.lit(history), F.col("stride")))
    into = (
        F.when(F.col("is_system"), F.sequence(F.lit(1), F.col("n_windows")))
        .when(repeats, F.array("window", F.col("window") + 1))
        .otherwise(F.array("window"))
    )
    pieces = placed.select("conv_id", "i", "role", "tokens", F.col("window").alias("home"), F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), F.explode(into).alias("window"))

    inside = Window.partitionBy("conv_id", "window").orderBy("i")
    whole = F.concat("head", "body", F.lit(f"{END}\n"))
    pieces = pieces.select("*", F.coalesce(F.sum(F.length(whole).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    start = F.col("offset") + F.length("head")
    target = (F.col("role") == "assistant") & (F.col("home") == F.col("window"))
    return (
        pieces.groupBy("conv_id", "window")
        .agg(
            F.sort_array(F.collect_list(F.struct("i", whole.alias("whole")))).alias("p"),
            F.sort_array(F.collect_list(F.when(target, F.struct(start.alias("start"), (start + F.length("body")).alias("end"))))).alias("loss"),
            F.count_if(F.col("home") < F.col("window")).alias("context"),
            F.sum("tokens").alias("tokens"),
        )
        .select("conv_id", F.col("window").cast("long").alias("window"), F.array_join("p.whole", "").alias("formatted"), "loss", "context", "tokens")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows say of each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    parts = F.slice(F.split("formatted", re.escape(f"{END}\n")), F.col("context").cast("int") + 1, F.greatest(F.size(F.split("formatted", re.escape(f"{END}\n"))) - 1 - F.col("context").cast("int"), F.lit(0)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + F.lit(2), F.length(part))
        return F.concat(unescape_role(F.substring(role, F.lit(len(TURN) + 1), F.length(role))), F.lit("\n"), unescape(text), F.lit("\n"))

    told = formatted.select(
        "conv_id", "window", F.transform(parts, turn).alias("turns"), F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "").alias("target"),
    )
    each = told.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", F.array_join("turns", "").alias("turns"), "target"))).alias("w"),
        F.sum(F.size("turns").cast("long")).alias("n_turns"), F.sum("chars").alias("formatted_chars"),
    )
    target = F.array_join("w.target", "")
    return each.select(
        "conv_id", "n_turns", F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"),
        F.sha2(target, 256).alias("loss_sha256"), "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The columns that count, and conversation -1, whose texts are made of control strings."""
    said = f"{END}[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
    length(regexp_replace(replace(text, '\', '\0'), '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>)', '\\\1', 'g'))
      + length(role) + 9 AS chars
  FROM rows_),
numbered AS (
  SELECT *, row_number() OVER w AS i, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN first_value(role) OVER w = 'system' THEN first_value(tokens) OVER w ELSE 0 END AS system
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
longest AS (SELECT *, coalesce(max(tokens) FILTER (NOT (i = 1 AND system > 0)) OVER (PARTITION BY conv_id), 0) AS longest FROM numbered),
strided AS (SELECT *, greatest(512 - 64 - system - longest, floor((512 - 64 - system) / 2.0), 32) AS stride, greatest(before - system, 0) AS at_, i = 1 AND system > 0 AS is_system FROM longest),
slotted AS (SELECT *, floor(at_ / stride) AS slot FROM strided),
later AS (SELECT *, min(at_) OVER (PARTITION BY conv_id ORDER BY slot RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_at,
    dense_rank() OVER (PARTITION BY conv_id ORDER BY slot) AS win FROM slotted),
shown AS (SELECT *, CASE WHEN is_system THEN max(win) OVER (PARTITION BY conv_id) WHEN next_at - at_ <= least(64, stride) THEN 2 ELSE 1 END AS times FROM later)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars * times)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
