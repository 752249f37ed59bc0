"""Rounds, release and arrival times: streams in any order and batches give what a plain loop gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kerbside.streaming import dispatch, in_order, rounds

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
LOG = "alert_id long, at_ts timestamp, rank int, kind string, hospital_id long, km double, plan array<array<long>>"


@pytest.fixture(scope="module")
def log():
    draw, rows = random.Random(7), []
    for a in range(60):
        start = draw.randrange(0, 1800)
        plan = [[a * 100 + r * 10 + k for k in range(3)] for r in range(draw.randint(0, 3))]
        rows.append((a, start * 1000, 0, "created", None, None, plan))
        names = [h for r in plan for h in r] or [1]
        for n in range(draw.randint(0, 9)):
            kind = draw.choice(["accept", "accept", "decline", "decline", "release", "release", "dispatched", "on_scene", "closed", "location", "location", "cancel"])
            rows.append((a, (start + draw.randrange(-5, 420)) * 1000, n + 1, kind, draw.choice(names[:2]), round(draw.uniform(0, 9), 2), None))
    rows.append((-1, 20_000_000, 0, "created", None, None, []))  # lets the watermark pass all others
    return rows


class Plain:
    """The rules of one alert, written as a person would follow them."""

    def __init__(self, events, until):
        self.out, self.status, self.by, self.asked, self.round, self.due, self.eta = [], None, None, {}, 0, None, None
        for at, _, kind, h, km, plan in sorted(events, key=lambda e: e[:2]):
            while self.due is not None and self.due <= at:
                self.escalate()
            getattr(self, "on_" + kind, None) and getattr(self, "on_" + kind)(at, h, km, plan)
            if kind in ("dispatched", "on_scene", "closed"):
                self.stage(at, h, kind)
        while self.due is not None and self.due < until:
            self.escalate()

    def say(self, at, kind, h=None, detail=""):
        self.out.append((at, kind, self.round, h, detail))

    def escalate(self):
        at, self.due = self.due, None
        for h in [h for h, x in self.asked.items() if x == "?"]:
            self.asked[h] = "missed"
            self.say(at, "missed", h)
        picks = self.plan[self.round] if self.round < min(3, len(self.plan)) else []
        if not picks:
            return self.say(at, "exhausted", None, rounds.NO_ANSWER if self.round >= 3 else rounds.NONE_LEFT)
        self.round, self.due = self.round + 1, at + 90_000
        for h in picks:
            self.asked[h] = "?"
            self.say(at, "notified", h)

    def on_created(self, at, h, km, plan):
        if self.status is None:
            self.status, self.plan, self.due = "new", plan, at
            self.escalate()

    def no(self, at, what, h):
        self.say(at, "rejected", h, f"{what}: {self.status or 'no such alert'}")

    def on_accept(self, at, h, km, plan):
        if self.status == "new":
            self.status, self.by, self.due = "accepted", h, None
            self.say(at, "accepted", h)
            for o in [o for o, x in self.asked.items() if x == "?"]:
                self.asked[o] = "missed"
                if o != h:
                    self.say(at, "missed", o)
            self.asked[h] = "accepted"
        elif self.status is None or self.by != h:
            self.no(at, "accept", h)

    def on_decline(self, at, h, km, plan):
        if self.status != "new":
            return self.no(at, "decline", h)
        self.asked[h] = "declined"
        self.say(at, "declined", h)
        if "?" not in self.asked.values():
            self.due = at

    def on_release(self, at, h, km, plan):
        if self.status not in ("accepted", "dispatched") or self.by != h:
            return self.no(at, "release", h)
        self.status, self.by, self.due, self.eta, self.asked[h] = "new", None, at, None, "declined"
        self.say(at, "released", h)

    def on_cancel(self, at, h, km, plan):
        if self.status not in ("new", "accepted", "dispatched"):
            return self.no(at, "cancel", h)
        self.status, self.due = "cancelled", None
        self.say(at, "cancelled")

    def stage(self, at, h, kind):
        order = ["accepted", "dispatched", "on_scene", "transporting", "closed"]
        if self.status not in order or order.index(kind) <= order.index(self.status) or self.by != h:
            return self.no(at, kind, h)
        self.status = kind
        self.say(at, kind, h)

    def on_location(self, at, h, km, plan):
        if self.status not in ("accepted", "dispatched", "on_scene", "transporting") or self.by != h:
            return self.no(at, "location", h)
        if self.status == "accepted":
            self.status = "dispatched"
            self.say(at, "dispatched", h, "by position")
        if self.eta is None or at - self.eta[0] >= 30_000:
            self.eta = (at, rounds.minutes(km * 1.35 / 24 * 60), km)
            self.say(at, "eta", h, f"{self.eta[1]} routed")
        else:
            self.say(at, "eta", h, f"{rounds.minutes(self.eta[1] * (min(1.5, km / self.eta[2]) if self.eta[2] else 1.0))} scaled")


def expected(log, until):
    keys = {r[0] for r in log}
    return sorted(((k, *x) for k in keys for x in Plain([r[1:] for r in log if r[0] == k], until).out), key=str)


def frame(spark, log):
    return spark.createDataFrame([(a, T0 + dt.timedelta(milliseconds=at), rank, kind, h, km, plan) for a, at, rank, kind, h, km, plan in log], LOG)


def shifted(rows):
    t0 = int(T0.timestamp() * 1000)
    return sorted(((r[0], r[1] - t0, *tuple(r)[2:]) for r in rows), key=str)


def test_replay_equals_rules(spark, log):
    found = in_order.replay(frame(spark, log), rounds.dispatch, "alert_id", rounds.SCHEMA, "2024-03-01 05:00:00", *rounds.FIELDS).collect()
    want = expected(log, 18_000_000)
    assert shifted(found) == [r for r in want if r[0] >= 0]
    kinds = {r[2] for r in want}
    assert {"released", "exhausted", "missed", "eta", "rejected", "cancelled"} <= kinds


def streamed(spark, batches, build, tmp, name):
    for n, b in enumerate(batches):
        b.coalesce(1).write.parquet(f"{tmp}/in/{n}")
    source = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
    q = build(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}").collect()


def test_stream_equals_rules(spark, log, tmp_path):
    """Five batches of rows in any order."""
    draw, rows = random.Random(1), log[:-1]
    draw.shuffle(rows)
    batches = [frame(spark, rows[k::4]) for k in range(4)] + [frame(spark, log[-1:])]
    found = streamed(spark, batches, lambda s: in_order.in_order(s, rounds.dispatch, "alert_id", rounds.SCHEMA, "1 hour", *rounds.FIELDS), tmp_path, "rounds_out")
    assert shifted(found) == [r for r in expected(log, 16_400_000) if r[0] >= 0]


def test_lifecycles_in_batches(spark, tmp_path):
    draw = random.Random(2)
    rows = [(a, T0 + dt.timedelta(minutes=3 * s + a % 2), s) for a in range(40) for s in draw.sample(range(1, 6), draw.randint(1, 5))]
    draw.shuffle(rows)
    schema = "alert_id long, at_ts timestamp, stage int"
    batches = [spark.createDataFrame(rows[k::4], schema) for k in range(4)] + [spark.createDataFrame([(-1, T0 + dt.timedelta(days=2), 1)], schema)]
    found = streamed(spark, batches, lambda s: dispatch.lifecycles(s, "1 hour"), tmp_path, "cycles_out")
    got = {}
    for r in sorted(found, key=lambda r: (r["alert_id"], r["at_ms"])):
        got[r["alert_id"]] = (r["stage"], r["illegal"])
    want = {}
    for a, _, s in sorted(rows):
        stage, illegal = want.get(a, (0, 0))
        want[a] = (s, illegal) if s == stage + 1 else (stage, illegal + 1)
    assert got == want


def test_bursts_become_one(spark, tmp_path):
    draw = random.Random(3)
    rows = [(k, T0 + dt.timedelta(milliseconds=draw.randrange(0, 20_000)), f"u{n}") for n in range(500) for k in [draw.randrange(4)]]
    schema = "alert_id long, at_ts timestamp, kind string"
    batches = [spark.createDataFrame(rows[k::4], schema) for k in range(4)] + [spark.createDataFrame([(-1, T0 + dt.timedelta(days=1), "end")], schema)]
    found = streamed(spark, batches, lambda s: dispatch.debounced(s, delay="1 hour"), tmp_path, "bursts_out")
    want, last = [], {}
    for k, at, kind in sorted(rows):
        if k in last and (at - last[k][-1][0]).total_seconds() <= 0.15:
            last[k].append((at, kind))
        else:
            last[k] = [(at, kind)]
            want.append((k, last[k]))
    assert sorted((r["alert_id"], r["kind"], r["updates"]) for r in found) == sorted((k, max(x)[1], len(x)) for k, x in want)
