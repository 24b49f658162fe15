r"""Chat formatting with a grammar round trip, on DataFrame functions alone.

The template writes a turn as ``### role: text</turn>\n``, an escaped one as ``###e role: text</turn>\n``. The grammar:

    conversation = { turn }
    turn         = ("### " | "###e ") role ": " text "</turn>" newline

``### ``, ``###e `` and ``</turn>`` are control strings: to the parser they begin and end turns wherever they stand. Every
conversation is rendered without escapes and parsed again; where the recovered turns differ from the source, its
conflicting turns are escaped; where they still differ, all its turns are; the last result is checked and raises if it
isn't identical. Escapes: ``\b`` for a backslash, ``\l`` for ``<``, ``\h`` for ``#``, ``\c`` for ``:``.

Plan: one aggregation by conversation (turns are small structs; a conversation is rendered as a whole), no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, OPEN_ESCAPED, CLOSE = "### ", "###e ", "</turn>"
END = CLOSE + "\n"
TURNS = "array<struct<role:string,text:string>>"


def escape(s: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")):
        s = F.replace(s, F.lit(plain), F.lit(code))
    return s


def unescape(s: Column) -> Column:
    for plain, code in ((":", "\\c"), ("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        s = F.replace(s, F.lit(code), F.lit(plain))
    return s


def render(turns: Column, how: str) -> Column:
    """The conversation's text; how: 'raw', 'conflicts' (escape the turns that clash with the grammar) or 'all'."""

    def one(t: Column) -> Column:
        raw = F.concat(F.lit(OPEN), t.role, F.lit(": "), t.text, F.lit(END))
        escaped = F.concat(F.lit(OPEN_ESCAPED), escape(t.role), F.lit(": "), escape(t.text), F.lit(END))
        return raw if how == "raw" else escaped if how == "all" else F.when(conflicts(t), escaped).otherwise(raw)

    return F.array_join(F.transform(turns, one), "")


def conflicts(t: Column) -> Column:
    both = F.concat(t.role, F.lit("\n"), t.text)
    return both.contains(OPEN) | both.contains(OPEN_ESCAPED) | both.contains(CLOSE) | t.role.contains(":") | t.role.contains("\n")


def parse(formatted: Column) -> Column:
    """The turns that the grammar recovers; null if the text isn't in the language.

    Split at each control string that opens a turn, check and cut each piece.
    """
    heads = F.regexp_extract_all(formatted, F.lit("###e? "), F.lit(0))
    pieces = F.slice(F.split(formatted, "###e? "), F.lit(2), F.greatest(F.size(heads), F.lit(0)))

    def one(p: Column, head: Column) -> Column:
        ok = p.endswith(END) & (F.locate(CLOSE, p) == F.length(p) - len(END) + 1) & (F.locate(": ", p) > 0)
        at = F.locate(": ", p)
        role = F.substring(p, F.lit(1), at - 1)
        text = F.substring(p, at + 2, F.length(p) - len(END) - at - 1)
        esc = head == OPEN_ESCAPED
        return F.when(ok, F.struct(F.when(esc, unescape(role)).otherwise(role).alias("role"), F.when(esc, unescape(text)).otherwise(text).alias("text")))

    turns = F.zip_with(pieces, heads, one)
    return F.when(formatted == "", F.array().cast(TURNS)).when(F.startswith(formatted, F.lit("###")) & ~F.exists(turns, lambda t: t.isNull()), turns)


def chat_format(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: conv_id, formatted, the turns read back from it, and how it was rendered.

    Turns are in the order of (turn, role, text), nulls first; null role or text: empty. Rows that repeat are turns of
    their own. A null conv_id is a conversation. An empty table gives an empty result. Other columns are not read.
    """
    each = rows.select(rows[conv_id].alias("conv_id"), F.struct(rows[turn].alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text")).alias("t"))
    conv = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    conv = conv.select("conv_id", F.transform("ts", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("source"))
    df = conv.withColumn("formatted", render(F.col("source"), "raw")).withColumn("turns", parse(F.col("formatted"))).withColumn("how", F.lit("raw"))
    for how in ("conflicts", "all"):
        same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
        df = df.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(render(F.col("source"), how))).withColumn("how", F.when(same, F.col("how")).otherwise(F.lit(how)))
        df = df.withColumn("turns", parse(F.col("formatted")))
    same = F.coalesce(F.col("turns") == F.col("source"), F.lit(False))
    checked = F.when(same, F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast(TURNS))
    return df.select("conv_id", "formatted", checked.alias("turns"), "how")


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """What the loss mask covers: the unescaped texts of that role's turns, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t.role == role), lambda t: t.text), "")


def loss_spans(formatted: Column, turns: Column, role: str = "assistant") -> Column:
    """[start, end) code points of that role's texts, as they stand in the formatted conversation."""
    heads = F.regexp_extract_all(formatted, F.lit("###e? "), F.lit(0))
    pieces = F.slice(F.split(formatted, "###e? "), F.lit(2), F.greatest(F.size(heads), F.lit(0)))
    sized = F.zip_with(F.zip_with(heads, pieces, lambda h, p: F.struct(F.length(h).alias("h"), F.locate(": ", p).alias("at"), F.length(p).alias("n"))), turns, lambda x, t: F.struct(x.h.alias("h"), x.at.alias("at"), x.n.alias("n"), (t.role == role).alias("own")))
    spans = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc.pos + x.h + x.n).cast("int").alias("pos"),
            F.when(x.own, F.concat(acc.out, F.array(F.struct((acc.pos + x.h + x["at"] + 1).cast("int").alias("start"), (acc.pos + x.h + x.n - len(END)).cast("int").alias("end"))))).otherwise(acc.out).alias("out"),
        ),
    )
    return spans.out
