"""JSON objects out of replies in words, by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "(?i)```(json)?"


def balanced_end(chars: Column, start: Column) -> Column:
    """Where the object that opens at ``start`` closes (both from 1), or 0: one fold over the characters
    with depth, string and escape as its state."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        quote, slash = ch == '"', ch == "\\"
        depth = s["depth"] + F.when(~s["quoted"] & (ch == "{"), 1).when(~s["quoted"] & (ch == "}"), -1).otherwise(0)
        quoted = F.when(s["quoted"], s["escaped"] | ~quote).otherwise(quote)
        closes = (s["end"] == 0) & ~s["quoted"] & (ch == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), (s["quoted"] & ~s["escaped"] & slash).alias("escaped"), (s["at"] + 1).alias("at"), F.when(closes, s["at"] + 1).otherwise(s["end"]).alias("end"))

    length = F.aggregate(F.slice(chars, start, F.size(chars)), state, step)["end"]
    return F.when(length > 0, start + length - 1).otherwise(0)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more. The parser stops after a whole value; as the one
    entry of a list and of an object at once, a value can't end before the text does."""
    entry = F.concat(F.lit("["), text, F.lit("]"))
    return F.try_parse_json(entry).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull() & (F.json_array_length(entry) == 1)


def json_in(text: Column) -> Column:
    """The first balanced object of a text that parses, or the whole text if that does; null if there is
    none. Marks of code blocks are taken out first. Each opening brace is tried in turn until one
    parses, so a text costs its length for each brace before its object."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), FENCE, ""))
    chars = F.split(plain, "")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(plain), F.lit(1))), lambda i: F.element_at(chars, i) == "{")

    def attempt(found: Column, start: Column) -> Column:
        end = balanced_end(chars, start)
        part = F.substring(plain, start, end - start + 1)
        return F.when(found.isNotNull(), found).otherwise(F.when((end > 0) & is_json(part), part))

    tried = F.when(F.size(starts) > 0, F.aggregate(starts, F.lit(None).cast("string"), attempt))
    return F.when(plain == "", None).when(is_json(plain), plain).otherwise(tried)
