"""Chat formatting by relational steps: column functions and one grouping, no Python workers.

Turns are collected and sorted by conversation, adjacent turns of one role are merged, and every
merged turn is written as ``<s>[ROLE]role[/ROLE]text[NEXT]text</s>``, one text for each turn it
was merged from, so the turns can be read back. Control strings inside texts and roles get a
backslash after their first character, one more than they have; reading back takes one away.

The loss mask is a row of pieces of the formatted text, each under the loss or not: the pieces,
joined, are the formatted text, and those under the loss are the (escaped) texts of the roles
that are learned from.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import table

BEGIN, END, ROLE, ROLE_END, NEXT = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[NEXT]"
#: What can't stand in a text as it is: this template's marks and the instruction marks other templates know.
CONTROLS = (BEGIN, END, ROLE, ROLE_END, NEXT, "[INST]", "[/INST]")
#: All controls begin with one of two characters and hold none of them further on, so no two of them overlap.
REST = "|".join(re.sub(r"([\[\]])", r"\\\1", c[1:]) for c in CONTROLS)
ESCAPE, UNESCAPE = rf"([<\[])(\\*)({REST})", rf"([<\[])\\(\\*)({REST})"
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _literal(text: str) -> str:
    """A pattern for the text itself."""
    return re.sub(r"([\[\]])", r"\\\1", text)


def merged_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, n_turns, merged: array of (role, texts), escaped.

    Turns are in order of turn (null first), then role and text. Null roles and texts are empty.
    """
    rows = conversations.select("conv_id", "turn", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    d = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # Places (from 0) at which another role begins, and the one after the last turn.
    heads = F.expr("filter(sequence(0, size(turns) - 1), j -> j = 0 or not (get(turns, j - 1).role <=> get(turns, j).role))")
    d = d.select("conv_id", "turns", F.concat(heads, F.array(F.size("turns"))).alias("heads"))
    run = "named_struct('role', get(turns, h).role, 'texts', transform(slice(turns, h + 1, get(heads, i + 1) - h), t -> t.text))"
    merged = F.expr(f"transform(slice(heads, 1, size(heads) - 1), (h, i) -> {run})")
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), merged.alias("merged"))


def format_chats(conversations: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, n_turns, formatted, pieces: array of (text, loss).

    Null roles and texts are empty ones; rows with a null conv_id are one conversation; repeated
    rows are turns of their own; an empty table gives an empty table; extra columns are ignored.
    A conversation is one row, so its text has to fit into one (2 GB).
    """
    d = merged_turns(conversations)
    quoted = ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in learned) or "null"
    # Learned turns are cut into mark, text, mark, text, mark; others are one piece.
    inner = f"flatten(transform(m.texts, (t, j) -> array(named_struct('text', if(j = 0, concat('{BEGIN}{ROLE}', m.role, '{ROLE_END}'), '{NEXT}'), 'loss', false), named_struct('text', t, 'loss', true))))"
    whole = f"array(named_struct('text', concat('{BEGIN}{ROLE}', m.role, '{ROLE_END}', array_join(m.texts, '{NEXT}'), '{END}'), 'loss', false))"
    piece = f"if(m.role in ({quoted}), concat({inner}, array(named_struct('text', '{END}', 'loss', false))), {whole})"
    d = d.select("conv_id", "n_turns", F.flatten(F.expr(f"transform(merged, m -> {piece})")).alias("pieces"))
    return d.select("conv_id", "n_turns", F.array_join("pieces.text", "").alias("formatted"), "pieces")


def read_turns(formatted: Column) -> Column:
    """The formatted text -> array of (role, text), as the turns were given."""
    blocks = F.split(formatted, END)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        halves = F.split(block, _literal(ROLE_END), 2)
        role = unescape(F.substring(F.get(halves, F.lit(0)), len(BEGIN + ROLE) + 1, 2147483647))
        return F.transform(F.split(F.get(halves, F.lit(1)), _literal(NEXT)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learned_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def loss_spans(formatted: DataFrame) -> DataFrame:
    """format_chats' rows -> (conv_id, start, end): code points of the formatted text that are under the loss mask, a row a span."""
    p = formatted.select("conv_id", F.posexplode("pieces").alias("at", "piece"))
    until = F.sum(F.length("piece.text")).over(Window.partitionBy("conv_id").orderBy("at"))
    return p.select("conv_id", "piece.loss", until.alias("end"), F.length("piece.text").alias("n")).where("loss").select("conv_id", (F.col("end") - F.col("n")).alias("start"), "end")


PLANTED = "</s>[INST] ok [/INST]"


def op13_chat_format(spark, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PLANTED).alias("text"))
    d = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted))
    d = d.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("pieces")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(told).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        digest(F.col("learned")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    """The same by string aggregation: a merged turn's frame counts where the role changes."""
    frame, mid = len(BEGIN + ROLE + ROLE_END + END), len(NEXT)
    hidden = lambda c: f"length(regexp_replace({c}, '{ESCAPE}', '\\1\\\\\\2\\3', 'g'))"
    return f"""WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
    t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows_)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({hidden('text')} + CASE WHEN before IS DISTINCT FROM role THEN {hidden('role')} + {frame} ELSE {mid} END)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id"""


QUERIES = {"op13_chat_format": op13_chat_format}
ORACLES: dict[str, str] = {"op13_chat_format": _sql()}
