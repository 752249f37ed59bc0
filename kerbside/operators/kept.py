"""Kept outputs: partial sums of the incidents by day, cell, area and severity, changed by what changes.

Digests and coverage cells come from the partial sums alone. A change set - rows that came, and
rows that were hidden, deleted or edited, as they were before - is summed in the same way and
added, so no incident of before is read again. Sums are of whole numbers, positions in
micro-degrees, so what goes out takes away exactly what came in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up
from ..functions.text import weight
from ..plans.dialect import half_up as sql_half_up
from ..plans.dialect import severity_counts as sql_severity
from ..plans.registry import query
from ..plans.steps import checkpoint
from .spatial import cell

c = F.col
KEYS, SUMS = ("day", "i", "j", "area", "severity"), ("n", "lat6", "lng6")
#: Degrees of a cell of coverage, about a kilometre.
CELL = 0.009


def partial_sums(rows: DataFrame, sign: int = 1) -> DataFrame:
    """(KEYS, SUMS) of active incidents; rows without a date or area are kept under null."""
    rows = cell(rows.filter(c("lat").isNotNull() & c("lng").isNotNull()), CELL)
    micro = lambda x: F.round(c(x) * 1e6).cast("long")
    return rows.groupBy(c("accident_date").alias("day"), "i", "j", F.coalesce("area", "location").alias("area"), "severity").agg(
        (F.count(F.lit(1)) * sign).alias("n"), (F.sum(micro("lat")) * sign).alias("lat6"), (F.sum(micro("lng")) * sign).alias("lng6")
    )


def changed(kept: DataFrame, came: DataFrame, went: DataFrame) -> DataFrame:
    """``kept`` after rows came and others went; groups that nothing is left of go. Null keys are keys; what
    went must have been counted before, else a negative count says that it wasn't."""
    rows = kept.unionByName(partial_sums(came)).unionByName(partial_sums(went, -1))
    return rows.groupBy(*KEYS).agg(*(F.sum(x).alias(x) for x in SUMS)).filter("n <> 0")


def cells_from(kept: DataFrame) -> DataFrame:
    """Accident cells as ``accident_cells`` has them: counts by severity, weight and the middle."""
    sums = {s: F.coalesce(F.sum(F.when(c("severity") == s, c("n"))), F.lit(0)).alias(s) for s in ("fatal", "serious", "minor")}
    middle = lambda x: half_up(F.sum(x) / F.sum("n") / 1e6, 5)
    return kept.groupBy("i", "j").agg(F.sum("n").alias("accidents"), *sums.values(), F.sum(weight(c("severity")) * c("n")).alias("weight"), middle("lat6").alias("lat"), middle("lng6").alias("lng"))


def digest_from(kept: DataFrame, days: int = 30) -> DataFrame:
    """(area, total, previous_total, fatal) of the last ``days`` days of the data and of those before."""
    ends = kept.agg(F.max("day").alias("end"))
    age = F.datediff("end", "day")
    rows = kept.crossJoin(F.broadcast(ends)).withColumn("age", age).filter(c("age").between(0, 2 * days - 1))
    now = lambda cond: F.coalesce(F.sum(F.when(cond, c("n"))), F.lit(0))
    return rows.groupBy("area").agg(now(c("age") < days).alias("total"), now(c("age") >= days).alias("previous_total"), now((c("age") < days) & (c("severity") == "fatal")).alias("fatal"))


def steps_of(t):
    """The incidents as a first set and three changes: rows come, some are hidden, others are deleted."""
    rows = t.active
    first = rows.filter("seq % 3 <> 0")
    return first, [(rows.filter("seq % 6 = 0"), first.filter("seq % 14 = 1")), (rows.filter("seq % 6 = 3"), rows.filter("seq % 6 = 0 and seq % 5 = 0")), (first.filter("seq % 28 = 1"), first.filter("false"))]


def kept_after_changes(t) -> DataFrame:
    first, changes = steps_of(t)
    kept = checkpoint(partial_sums(first))
    for came, went in changes:
        kept = checkpoint(changed(kept, came, went))
    return kept


LEFT = "x as (select * from active where not (seq % 3 <> 0 and seq % 14 = 1 and seq % 28 <> 1) and not (seq % 6 = 0 and seq % 5 = 0))"


@query(f"""
    with {LEFT} select cast(floor((lat - 12.5e0) / 0.009e0) as bigint) as i, cast(floor((lng - 77e0) / 0.009e0) as bigint) as j, count(*) as accidents, {sql_severity()}, cast(sum(case severity when 'fatal' then 3 when 'serious' then 2 else 1 end) as bigint) as weight,
        {sql_half_up('cast(sum(cast(round(lat * 1e6) as bigint)) as double) / count(*) / 1e6', 5)} as lat, {sql_half_up('cast(sum(cast(round(lng * 1e6) as bigint)) as double) / count(*) / 1e6', 5)} as lng from x group by 1, 2""")
def kept_cells(t):
    """Cells of coverage after several change sets, from partial sums that only the changes touched."""
    return cells_from(kept_after_changes(t))


@query(f"""
    with {LEFT}, w as (select coalesce(area, location) as area, severity, date_diff('day', accident_date, (select max(accident_date) from x)) as age from x)
    select area, count(*) filter (where age < 30) as total, count(*) filter (where age >= 30) as previous_total, count(*) filter (where age < 30 and severity = 'fatal') as fatal from w where age between 0 and 59 group by 1""")
def kept_digest(t):
    """The digest of the last 30 days by area after the same change sets."""
    return digest_from(kept_after_changes(t))
