"""Emergency dispatch on Structured Streaming; the batch replays in ``operators.response`` give
the same rows from a finished log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .in_order import in_order

#: Fixed value: the window in which reports merge.
MERGE_WINDOW = "15 minutes"


def rate_limited(events: DataFrame, limit: int) -> DataFrame:
    """Users with more than ``limit`` requests in a tumbling window of 15 minutes."""
    counts = events.withWatermark("ts", MERGE_WINDOW).groupBy(F.window("ts", MERGE_WINDOW).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("requests"))
    return counts.filter(F.col("requests") > limit).select("user_id", F.col("w.start").alias("window_start"), "requests")


def step_of_life(state: dict, at: int, event: dict | None) -> list[tuple]:
    """Steps go forward by one; a step that doesn't is counted as illegal and changes nothing."""
    if event["stage"] == state.get("stage", 0) + 1:
        state["stage"] = event["stage"]
    else:
        state["illegal"] = state.get("illegal", 0) + 1
    return [(at, state.get("stage", 0), state.get("illegal", 0))]


def lifecycles(log: DataFrame, delay: str = MERGE_WINDOW) -> DataFrame:
    """(alert_id, at_ms, stage, illegal) after each step of (alert_id, at_ts, stage), in the order of
    event time however the rows arrive."""
    rows = log.withColumn("rank", F.col("stage"))
    return in_order(rows, step_of_life, "alert_id", "alert_id long, at_ms long, stage int, illegal int", delay, "rank", "stage")


def debounced(updates: DataFrame, silence: str = "150 milliseconds", delay: str = MERGE_WINDOW) -> DataFrame:
    """(alert_id, kind, at_ts, updates): the last update of each burst of one key, once the key has been
    silent for longer than ``silence``. A burst is a session of event time, so the same rows come out whatever
    the batches; at one time the larger kind counts as the last."""
    rows = updates.withWatermark("at_ts", delay)
    bursts = rows.groupBy(F.session_window("at_ts", silence).alias("burst"), "alert_id").agg(F.max(F.struct("at_ts", "kind")).alias("last"), F.count(F.lit(1)).alias("updates"))
    return bursts.select("alert_id", "last.kind", "last.at_ts", "updates")
