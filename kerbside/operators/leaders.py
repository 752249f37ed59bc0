"""Greedy clustering in a fixed order: a row leads unless a leader before it is near.

What a loop over ordered rows does one by one, rounds do for all places at once. Of the rows
of one small cell only the first undecided one can lead next, since it is near all others; it
does once no undecided row before it is near. So a row meets the first rows of the cells around
it and never all rows of a crowd, and a crowd at one place is decided by its first row. Rows with
few around them, before long quiet, are decided by the loop itself, many such groups at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, half_up, haversine_km
from ..plans.steps import checkpoint

c = F.col
ROW = ("kind", "ord", "id", "lat", "lng", "at", "until")
#: Rows of a group that is decided by a loop, at most; larger ones go to the rounds.
SMALL_GROUP = 1000


def ordered_rows(rows: DataFrame, id: str, kind: Column, order: list[Column], at: Column | None = None, until: Column | None = None) -> DataFrame:
    """(kind, ord, id, lat, lng, at, until) for ``elect``: rows of one kind are held against each other
    in the order of ``ord``, which ends with the id; ``at`` is in seconds and must rise with it."""
    seconds = lambda x: F.lit(None).cast("double") if x is None else (F.unix_micros(x.cast("timestamp")) / 1e6)
    return rows.select(kind.alias("kind"), F.struct(*order, c(id).alias("last")).alias("ord"), c(id).alias("id"), "lat", "lng", F.lit(0.0).alias("at") if at is None else seconds(at).alias("at"), seconds(until).alias("until"))


class Near:
    """Who is near whom: within ``metres`` and, if given, at most ``seconds`` later."""

    def __init__(self, metres: float, seconds: float | None):
        self.metres, self.seconds = metres, seconds
        # longitudes are narrower than latitudes: a cell as wide as the radius in latitude is not in longitude
        self.size = metres / METRES_PER_DEGREE / 0.95

    def cells(self, rows: DataFrame, part: float = 1.0, names: tuple = ("i", "j", "slot")) -> DataFrame:
        slot = F.lit(0) if self.seconds is None else F.floor(c("at") / F.lit(self.seconds * part))
        i, j, k = names
        return rows.withColumns({i: F.floor(c("lat") / F.lit(self.size * part)), j: F.floor(c("lng") / F.lit(self.size * part)), k: slot})

    def spread(self, rows: DataFrame, later: bool) -> DataFrame:
        """Rows of (x: struct), once for each cell around theirs and, in time, the slot after or before."""
        around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
        slots = [0] if self.seconds is None else [0, 1 if later else -1]
        rows = self.cells(rows.select("x", c("x.kind").alias("kind"), c("x.lat").alias("lat"), c("x.lng").alias("lng"), c("x.at").alias("at")))
        rows = rows.withColumn("di", F.explode(around)).withColumn("dj", F.explode(around)).withColumn("ds", F.explode(F.array(*map(F.lit, slots))))
        return rows.select("x", c("kind").alias("x_kind"), (c("i") + c("di")).alias("x_i"), (c("j") + c("dj")).alias("x_j"), (c("slot") + c("ds")).alias("x_slot"))

    def met(self, rows: DataFrame, others: DataFrame, later: bool, how: str = "inner") -> DataFrame:
        """``rows`` with each of ``others`` (x) in the cells around them that is near; ``later`` if those
        are the earlier ones of a pair."""
        held = self.spread(others, later)
        same = c("kind").eqNullSafe(c("x_kind")) & (c("i") == c("x_i")) & (c("j") == c("x_j")) & (c("slot") == c("x_slot"))
        near = self.cells(rows).join(held, same, how).withColumn("m", half_up(haversine_km(c("lat"), c("lng"), c("x.lat"), c("x.lng")) * 1000.0, 3)).filter(c("m") <= self.metres)
        if self.seconds is not None:
            gap = c("at") - c("x.at") if later else c("x.at") - c("at")
            near = near.filter(gap.between(0.0, float(self.seconds)))
        return near.drop("i", "j", "slot", "x_kind", "x_i", "x_j", "x_slot")


def led(rows: DataFrame, leaders: DataFrame, near: Near) -> DataFrame:
    """Pairs of a row and a leader ``x`` that comes before it, is near and still open; a leader leads itself."""
    return near.met(rows, leaders, later=True).filter((c("x.ord") <= c("ord")) & (c("x.until").isNull() | (c("x.until") > c("at")) | (c("x.id") == c("id"))))


def grouped(rows: DataFrame, near: Near) -> DataFrame:
    """``rows`` with ``rows_of``, the group that holds all that can be near them: bands of latitude, then
    stretches of longitude, then of time, each ending where a whole cell is empty. The ends are
    found on distinct cells, of which a city and a span of time have so many, whatever the rows."""
    cells = near.cells(rows)
    parts = ["kind"]
    for x in ("i", "j", "slot"):
        held = cells.select(*parts, x).distinct()
        before = F.lag(x).over(Window.partitionBy(*parts).orderBy(x))
        run = F.sum(F.when(c(x) - before <= 1, 0).otherwise(1)).over(Window.partitionBy(*parts).orderBy(x))
        runs = held.withColumn(f"{x}_run", run).withColumnsRenamed({k: f"of_{k}" for k in (*parts, x)})
        same = c(x) == c(f"of_{x}")
        for k in parts:
            same = same & c(k).eqNullSafe(c(f"of_{k}"))
        cells = cells.join(runs, same).drop(*[f"of_{k}" for k in (*parts, x)])
        parts.append(f"{x}_run")
    return cells.select(*rows.columns, F.struct(*parts).alias("rows_of"))


def looped(metres: float, seconds: float | None) -> Callable[..., Column]:
    """Which rows of a group lead, by their places in its order."""

    @F.pandas_udf("array<int>")
    def leads(lats: pd.Series, lngs: pd.Series, ats: pd.Series, untils: pd.Series) -> pd.Series:
        def near(a: tuple, b: tuple) -> bool:
            h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
            m = 6371.0 * 2.0 * math.atan2(math.sqrt(h), math.sqrt(1.0 - h)) * 1000.0
            return math.floor(m * 1000.0 + 0.5) / 1000.0 <= metres

        out = []
        for group in zip(lats, lngs, ats, untils):
            found: list[int] = []
            open_: list[tuple] = []
            for n, row in enumerate(zip(*group)):
                at = row[2]
                if seconds is not None:
                    open_ = [x for x in open_ if at - x[2] <= seconds]
                if not any((x[3] is None or math.isnan(x[3]) or x[3] > at) and near(x, row) for x in open_):
                    found.append(n)
                    open_.append(row)
            out.append(found)
        return pd.Series(out)

    return leads


def elect(rows: DataFrame, metres: float, seconds: float | None = None) -> DataFrame:
    """The leaders of ``ordered_rows``, as structs ``x``.

    Rows without a position or time lead themselves, small groups are decided by a loop. Of the others each round decides what no undecided row
    before it can change; rounds are as many as the longest chain of rows that wait for each
    other, which follows how long a neighbourhood is never quiet, not how many rows it has.
    """
    near = Near(metres, seconds)
    rows = checkpoint(rows.select(*ROW))
    placed = c("lat").isNotNull() & c("lng").isNotNull() & c("at").isNotNull()
    leaders = rows.filter(~placed).select(F.struct(*ROW).alias("x"))
    held = checkpoint(grouped(rows.filter(placed), near))
    crowds = held.groupBy("rows_of").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > SMALL_GROUP).select("rows_of")
    ordered = F.array_sort(F.collect_list(F.struct("ord", *[x for x in ROW if x != "ord"])))
    groups = held.join(crowds, "rows_of", "left_anti").groupBy("rows_of").agg(ordered.alias("all"))
    first = groups.select("all", looped(metres, seconds)(*[c(f"all.{x}") for x in ("lat", "lng", "at", "until")]).alias("first"))
    by_loop = first.select(F.explode(F.transform("first", lambda n: F.get("all", n))).alias("y")).select(F.struct(*[c(f"y.{x}").alias(x) for x in ROW]).alias("x"))
    leaders = leaders.unionByName(checkpoint(by_loop))
    open_rows = checkpoint(held.join(crowds, "rows_of", "left_semi").drop("rows_of"))
    while not open_rows.isEmpty():
        small = near.cells(open_rows, 0.25, ("si", "sj", "ss"))
        firsts = checkpoint(small.groupBy("kind", "si", "sj", "ss").agg(F.min_by(F.struct(*ROW), "ord").alias("x")).select("x"))
        waiting = near.met(open_rows, firsts, later=False).filter(c("ord") < c("x.ord")).select(c("x.id").alias("waits")).distinct()
        new = checkpoint(firsts.join(waiting, c("x.id") == c("waits"), "left_anti"))
        done = led(open_rows, new, near).select(c("id").alias("done")).distinct()
        open_rows = checkpoint(open_rows.join(done, c("id") == c("done"), "left_anti"))
        leaders = leaders.unionByName(new)
    return leaders


def clusters(rows: DataFrame, metres: float, seconds: float | None = None, nearest: bool = True) -> DataFrame:
    """(id, leader_id): each row's leader, the nearest before it or, if not ``nearest``, the first in order."""
    leaders = checkpoint(elect(rows, metres, seconds))
    choice = F.struct("m", c("x.ord").alias("o")) if nearest else F.struct(c("x.ord").alias("o"))
    placed = led(rows, leaders, Near(metres, seconds)).groupBy("id").agg(F.min_by("x.id", choice).alias("leader_id"))
    alone = leaders.filter("x.lat is null or x.lng is null or x.at is null").select(c("x.id").alias("id"), c("x.id").alias("leader_id"))
    return placed.unionByName(alone)
