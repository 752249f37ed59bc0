"""Keyed machines on event time: what arrives out of order is held until the watermark has passed it.

A machine is a function of its state, an event or a deadline; the processor below feeds it in the
order of event time, whatever the batches are, and sets a timer for each held event and for the
machine's next deadline. A replay feeds a finished log to the same machine.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A machine takes (state, at in ms, event or None at a deadline), changes the state and returns
#: rows. state["deadline"] is when it wants to be called without an event, if at all.
Machine = Callable[[dict, int, dict | None], list[tuple]]


def advance(machine: Machine, held: dict, until: float) -> list[tuple]:
    """Feed held events and deadlines before ``until`` in order; at one time deadlines come first,
    then events by their ``rank``."""
    out: list[tuple] = []
    events, state = sorted(held["events"], key=lambda e: (e["at"], e["rank"])), held["state"]
    done = 0
    while True:
        deadline = state.get("deadline")
        now = events[done]["at"] if done < len(events) else None
        if deadline is not None and deadline < until and (now is None or deadline <= now):
            state["deadline"] = None
            out += machine(state, deadline, None)
        elif now is not None and now < until:
            out += machine(state, now, events[done])
            done += 1
        else:
            break
    held["events"] = events[done:]
    return out


class InOrder(StatefulProcessor):
    def __init__(self, machine: Machine, columns: list[str]):
        self.machine, self.columns = machine, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("held", "json string")

    def held(self) -> dict:
        return json.loads(self.value.get()[0]) if self.value.exists() else {"events": [], "state": {}}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.held()
        for batch in rows:
            new = [json.loads(x) for x in batch["event"]]
            held["events"] += new
            for at in {e["at"] for e in new}:
                self.handle.registerTimer(at)
        self.value.update((json.dumps(held),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.held()
        out = advance(self.machine, held, timerValues.getCurrentWatermarkInMs())
        if (deadline := held["state"].get("deadline")) is not None:
            self.handle.registerTimer(deadline)
        if held["state"].get("over") and not held["events"]:
            self.value.clear()
        else:
            self.value.update((json.dumps(held),))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def close(self) -> None:
        pass


def events_of(log: DataFrame, key: str, at: str, *fields: str) -> DataFrame:
    """(key, at_ts, event): each row as JSON with its time in ms; ``rank`` orders rows of one time."""
    event = F.to_json(F.struct(F.unix_millis(F.col(at).cast("timestamp")).alias("at"), *fields))
    return log.select(F.col(key), F.col(at).cast("timestamp").alias("at_ts"), event.alias("event"))


def in_order(log: DataFrame, machine: Machine, key: str, schema: str, delay: str, *fields: str) -> DataFrame:
    """Rows of the machine of each key over a stream of (key, at_ts, rank, ...). Rows later than ``delay``
    after others are dropped, as watermarks do; rows without a key or time have no place in the
    order and go. State is in RocksDB, which this sets for the session."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = events_of(log.filter(F.col(key).isNotNull() & F.col("at_ts").isNotNull()), key, "at_ts", *fields).withWatermark("at_ts", delay)
    columns = [x.split()[0] for x in schema.split(", ")]
    return rows.groupBy(key).transformWithStateInPandas(InOrder(machine, columns), schema, "append", "eventTime")


def replay(log: DataFrame, machine: Machine, key: str, schema: str, until: str, *fields: str) -> DataFrame:
    """The same rows from a finished log, up to the time ``until``. A key's log is what one machine
    lives through, so it fits a task; keys go to Python many at a time."""
    columns = [x.split()[0] for x in schema.split(", ")]
    end = pd.Timestamp(until, tz="UTC").value // 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for logs in batches:
            lives = ((k, advance(machine, {"events": [json.loads(x) for x in events], "state": {}}, end)) for k, events in zip(logs["key"].tolist(), logs["events"]))
            yield pd.DataFrame([(k, *r) for k, rows in lives for r in rows], columns=columns, dtype=object)

    rows = events_of(log.filter(F.col(key).isNotNull() & F.col("at_ts").isNotNull()), key, "at_ts", *fields)
    return rows.groupBy(F.col(key).alias("key")).agg(F.collect_list("event").alias("events")).mapInPandas(run, schema)
