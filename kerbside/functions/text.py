"""Text, date and severity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules, default: str | None = None) -> Column:
    """The label of the first pattern that is found in ``text`` (in either case)."""
    out = None
    for label, pattern in rules:
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default)) if default is not None else out


def fold_place(text: Column) -> Column:
    """Lower case; all but letters and digits become single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


#: Fixed value: an hour and its minutes.
HOUR = r"(?:^|[T\s])([01]?\d|2[0-3]):[0-5]\d"


def hour_of(text: Column) -> Column:
    """Hour 0-23 of the first hh:mm in a text, else null."""
    hour = F.regexp_extract(text, HOUR, 1)
    return F.nullif(hour, F.lit("")).cast("int")


def weekday(date: Column) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(date) - 1).cast("int")


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def time_band(hour: Column) -> Column:
    return F.when(hour.between(7, 10), "morning rush").when(hour.between(11, 16), "daytime").when(hour.between(17, 20), "evening rush").when(hour.isNotNull(), "night")


def severity_of_score(score: Column) -> Column:
    return F.when(score >= 6, "fatal").when(score >= 3, "serious").otherwise("minor")


def weight(severity: Column, fatal: int = 3, serious: int = 2, minor: int = 1) -> Column:
    return F.when(severity == "fatal", fatal).when(severity == "serious", serious).otherwise(minor)


def severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in ("fatal", "serious", "minor")]


def local_hour(ts: Column) -> Column:
    """Hour in India (UTC + 5:30)."""
    return F.hour(ts + F.expr("interval '330' minute")).cast("int")
