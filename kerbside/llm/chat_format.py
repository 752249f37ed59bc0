"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is written as turns ``<|im_start|>role\\ntext<|im_end|>\\n``. A deterministic
parser splits the result at the start marks and reads each piece back; a piece has the end mark
only at its end. Texts that do not come back are escaped and rendered again, then whole
conversations, until what is read equals the source. The escape puts one more backslash between
``<`` and ``|``; it can be undone for any string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: a line break becomes backslash n, a backslash is doubled."""
    doubled = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return escape_text(F.replace(doubled, F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes are read first, from the left; what stands between them has line breaks."""
    between = F.split(unescape_text(role), r"\\\\", -1)
    return F.array_join(F.transform(between, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column, escaped) -> Column:
    """One string from (role, text) turns; ``escaped(turn)`` says whether its text is escaped."""

    def one(turn: Column) -> Column:
        body = F.when(escaped(turn), escape_text(turn["text"])).otherwise(turn["text"])
        return F.concat(F.lit(START), escape_role(turn["role"]), F.lit("\n"), body, F.lit(END + "\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """Turns of a rendered string: array of (role, raw, text, start); start is the code point
    offset of the raw text. A piece that isn't a whole turn, or that has an end mark before its
    end, gives nulls."""
    pieces = F.slice(F.split(rendered, r"<\|im_start\|>", -1), 2, 1 << 30)
    shaped = F.transform(
        pieces,
        lambda p: F.struct(
            F.length(p).alias("size"),
            F.regexp_extract(p, r"(?s)^([^\n]*)\n.*<\|im_end\|>\n$", 1).alias("head"),
            F.when(p.rlike(r"(?s)^[^\n]*\n.*<\|im_end\|>\n$") & (F.instr(p, END) == F.length(p) - len(END)), F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("raw"),
        ),
    )
    # offsets: each piece stands after a start mark and all pieces before it
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,raw:string,text:string,start:int>>").alias("turns"))
    return F.aggregate(
        shaped,
        zero,
        lambda acc, p: F.struct(
            (acc["at"] + F.lit(len(START)) + p["size"]).alias("at"),
            F.concat(
                acc["turns"],
                F.array(
                    F.struct(
                        unescape_role(p["head"]).alias("role"),
                        p["raw"].alias("raw"),
                        unescape_text(p["raw"]).alias("text"),
                        (acc["at"] + F.lit(len(START)) + F.length(p["head"]) + F.lit(1)).alias("start"),
                    )
                ),
            ).alias("turns"),
        ),
    )["turns"]


def pairs(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Render (conv_id, turn, role, text) as one row per conversation.

    Output: conv_id, formatted, level (0 raw, 1 conflicting texts escaped, 2 all texts
    escaped), turns (as read back) and loss_spans (start and end of the assistant's raw texts
    in ``formatted``). What is read back equals the source at every level, else the query fails. Null texts and roles count as empty; null turns come first; equal turns
    go by role and text and repeated rows stay; a null conv_id is a conversation of its own;
    an empty table gives an empty one; extra columns are not looked at. A conversation is one
    string, so its rows meet in one task.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    alone = lambda body: parse(F.concat(F.lit(START), F.lit("r\n"), body, F.lit(END + "\n")))
    back = alone(text)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # a text conflicts if it does not come back from a conversation of its own
    fine = (~F.col("text").contains("<")) | ((F.size(back) == 1) & F.coalesce(back[0]["text"] == F.col("text"), F.lit(False)))
    rows = rows.withColumn("conflict", ~fine)
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "conflict"))).alias("source"))
    never, always = (lambda t: F.lit(False)), (lambda t: F.lit(True))
    tried = grouped.withColumn("raw0", render(F.col("source"), never)).withColumn("raw1", render(F.col("source"), lambda t: t["conflict"]))
    same = lambda rendered: F.coalesce(pairs(parse(rendered)) == pairs(F.col("source")), F.lit(False))
    all_escaped = render(F.col("source"), always)
    lost = F.raise_error(F.lit("a conversation does not come back from its formatted text")).cast("int")
    level = F.when(same(F.col("raw0")), 0).when(same(F.col("raw1")), 1).when(same(all_escaped), 2).otherwise(lost)
    chosen = tried.withColumn("level", level).withColumn("formatted", F.when(F.col("level") == 0, F.col("raw0")).when(F.col("level") == 1, F.col("raw1")).otherwise(all_escaped))
    read = chosen.select("conv_id", "formatted", "level", parse(F.col("formatted")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["raw"])).alias("end")))
    return read.withColumn("loss_spans", spans)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from ``formatted``: turns, and text under the loss mask. One row for
    each row of ``format_conversations``, whose docstring says what nulls, repeats and empty tables give."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape_text(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return (
        formatted.withColumn("loss", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(turns, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
