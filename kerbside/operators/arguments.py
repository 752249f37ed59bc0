"""What a caller asks for, made safe: filter values checked, sort columns from a list, page sizes bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query

c = F.col

# Zones, severities and the columns that a list may be sorted by.
ZONES = ("North", "South", "East", "West", "Central")
SEVERITIES = ("fatal", "serious", "minor")
SORTABLE = ("accident_date", "id", "severity", "score")


def clamped(value: Column, low: int, high: int) -> Column:
    """The leading whole number of a text between bounds; null where it has none."""
    number = F.regexp_extract(value, r"^\s*([+-]?[0-9]{1,9})", 1)
    return F.when(number != "", F.greatest(F.lit(low), F.least(F.lit(high), number.try_cast("int"))))


def clean_text(value: Column, longest: int = 60) -> Column:
    """Trimmed and cut; null for a text of spaces only."""
    return F.substring(F.nullif(F.trim(value), F.lit("")), 1, longest)


def day_of(value: Column, month_day: str) -> Column:
    """A day in ISO form, or a year with ``month_day`` put after it; null for other texts."""
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), value).when(value.rlike("^[0-9]{4}$"), F.concat(value, F.lit(f"-{month_day}")))


def one_of(value: Column, allowed: tuple) -> Column:
    """The allowed word that equals the value in either case, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for word in allowed for x in (word.lower(), word)]), F.lower(value))


@query("""
    select id, nullif(trim(substr(trim(location), 1, 60)), '') as place,
        case upper(zone) when 'NORTH' then 'North' when 'SOUTH' then 'South' when 'EAST' then 'East' when 'WEST' then 'West' when 'CENTRAL' then 'Central' end as zone,
        case when severity in ('fatal', 'serious', 'minor') then severity end as severity,
        case when length(date_raw) = 10 then date_raw end as date_from, substr(date_raw, 1, 4) || '-12-31' as date_to,
        greatest(0, least(23, factor)) as hour_from from incidents""")
def clean_arguments(t):
    """Each report as a question for its like: what isn't in form is left out. Days come with and
    without a time, years alone; hours beyond the day are the last hour."""
    return t.incidents.select(
        "id", clean_text(c("location")).alias("place"), one_of(F.upper("zone"), ZONES).alias("zone"), F.when(c("severity").isin(*SEVERITIES), c("severity")).alias("severity"),
        day_of(c("date_raw"), "01-01").alias("date_from"), day_of(F.substring("date_raw", 1, 4), "12-31").alias("date_to"), clamped(c("factor").cast("string"), 0, 23).alias("hour_from"),
    )


def sorted_page(df: DataFrame, sort_by: str, descending: bool, page: int, size: int) -> DataFrame:
    """A page of at most 100 rows, from the first one on; unknown sort columns give way to the
    date, rows without a value come last, and the id settles ties."""
    name = sort_by if sort_by in SORTABLE else SORTABLE[0]
    order = c(name).desc_nulls_last() if descending else c(name).asc_nulls_last()
    size = min(100, max(1, size))
    return df.orderBy(order, "id").offset((max(1, page) - 1) * size).limit(size)


@query("select id, accident_date, severity from incidents order by accident_date desc nulls last, id limit 100", dates=("accident_date",))
def sorted_page_unknown_column(t):
    """A column that isn't on the list, a page before the first and too large a page."""
    return sorted_page(t.incidents, "reporter_id", True, -3, 5000).select("id", "accident_date", "severity")


@query("select id, score, severity from incidents order by score asc nulls last, id limit 30 offset 60")
def sorted_page_third(t):
    return sorted_page(t.incidents, "score", False, 3, 30).select("id", "score", "severity")
