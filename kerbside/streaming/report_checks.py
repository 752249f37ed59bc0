"""Checks on reports as they come: duplicates among them, signs of spam, and reporters in haste."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, haversine_km
from ..operators.integrity import ACCIDENT, REACH_DAYS, REACH_M, cosines, scored_duplicates, signals, with_vectors
from ..operators.spatial import cell, ring
from .in_order import in_order

c = F.col
DAY_MS = 86_400_000


def duplicate_pairs(reports: DataFrame, delay: str = "1 hour", horizon: str = "30 days") -> DataFrame:
    """(a_id, b_id, score, verdict): each report of (id, at_ts, lat, lng, accident_date, text) with every
    other that is near in place and date, both ways, as ``operators.integrity.duplicates`` scores them.

    The stream is joined with itself by cell, so that reports that came before and after meet; a
    report waits for others for ``horizon`` of event time. Texts become vectors as they come in.
    """
    size = REACH_M / METRES_PER_DEGREE / 0.95
    rows = with_vectors(reports.filter(c("lat").isNotNull() & c("lng").isNotNull()), "text").withWatermark("at_ts", delay)
    half = lambda x: rows.select(*[c(k).alias(f"{x}_{k}") for k in ("id", "at_ts", "lat", "lng", "accident_date", "v")])
    a = cell(half("a"), size, "a_lat", "a_lng", "a_i", "a_j")
    b = ring(cell(half("b"), size, "b_lat", "b_lng"))
    days = F.abs(F.datediff("a_accident_date", "b_accident_date"))
    soon = F.expr(f"b_at_ts between a_at_ts - interval '{horizon}' and a_at_ts + interval '{horizon}'")
    met = a.join(b, (c("a_i") == c("i")) & (c("a_j") == c("j")) & soon & (c("a_id") != c("b_id")))
    met = met.withColumns({"days": days, "m": haversine_km(c("a_lat"), c("a_lng"), c("b_lat"), c("b_lng")) * 1000.0}).filter((c("m") <= REACH_M) & (c("days").isNull() | (c("days") <= REACH_DAYS)))
    return scored_duplicates(cosines(met.select("a_id", "b_id", "m", "days", "a_v", "b_v"), ["a_id", "b_id", "m", "days"]))


def flags(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, signs of spam, off_topic) of each report as it comes; ``pairs`` is the static row of letter
    pairs that titles know."""
    rows = reports.select(c("id").alias("doc_id"), "text", (~F.coalesce("text", F.lit("")).rlike("(?i)" + ACCIDENT)).alias("off_topic"))
    return signals(rows, pairs)


def within_a_day(state: dict, at: int, event: dict | None) -> list[tuple]:
    """Reports of one person in the 24 hours up to each of theirs, itself counted."""
    state["times"] = [x for x in state.get("times", []) if x >= at - DAY_MS] + [at]
    return [(event["id"], len(state["times"]))]


def haste(reports: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(reporter_id, id, recent) of (id, reporter_id, at_ts), in the order of event time."""
    return in_order(reports.withColumn("rank", c("id")), within_a_day, "reporter_id", "reporter_id long, id long, recent long", delay, "rank", "id")
