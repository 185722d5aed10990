"""Chat formatting by grammar round trip, with built-in expressions only.

A conversation becomes ``[level] `` and then, for each turn, ``<s>[INST] role [/INST]text</s>``.  The level says how the
roles and texts are written: 0 as they are, 1 with a backslash inside every control string (one more for each it has
already).  A conversation is rendered at level 0, parsed again by the grammar and compared with its source; where a text
conflicts with the grammar it is rendered at level 1.  The formatted text is parsed again at the end, and a difference
that is left raises an error.

Defined results: turns are ordered by turn (nulls first), role and text; a null role or text is empty; a null conv_id is
a conversation of its own; an empty table gives an empty result; further columns are ignored.  A conversation is one
output row, so its turns have to fit into one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of a turn and the control strings that are escaped.
_OPEN, _MIDDLE, _CLOSE = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"(/?s>|/?INST\])"
_TURN = r"(?s)<s>\[INST\] (.*?) \[/INST\](.*?)</s>"


def escape(text: Column) -> Column:
    """One more backslash inside every control string."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def render(turns: Column, level: int) -> Column:
    """The formatted conversation of an array of (role, text)."""
    write = escape if level else (lambda c: c)
    parts = F.transform(turns, lambda t: F.concat(F.lit(_OPEN), write(t["role"]), F.lit(_MIDDLE), write(t["text"]), F.lit(_CLOSE)))
    return F.concat(F.lit(f"[{level}] "), F.array_join(parts, ""))


def parse(formatted: Column) -> Column:
    """The array of (role, text) of a formatted conversation."""
    roles = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(2))
    escaped = formatted.startswith("[1] ")
    read = lambda c: F.when(escaped, unescape(c)).otherwise(c)
    return F.zip_with(roles, texts, lambda r, t: F.struct(read(r).alias("role"), read(t).alias("text")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (parsed again from it) for each conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("rows"))
    source = source.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("formatted", render(F.col("source"), 0))
    # An equal count and equal rendering mean equal turns: the rendering is a function of them.
    final = plain.withColumn("formatted", F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(render(F.col("source"), 1)))
    parsed = final.withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return parsed.select("conv_id", "formatted", same.alias("turns"))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and hashes read back from the formatted text."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
