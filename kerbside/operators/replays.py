"""Finished logs replayed: what the streams of ``streaming`` give, from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..plans.registry import query
from ..streaming.dispatch import debounced
from ..streaming.in_order import replay
from ..streaming.rounds import FIELDS, ROUND_MS, SCHEMA, dispatch
from .response import escalations

c = F.col


def dispatch_log(t) -> DataFrame:
    """(alert_id, at_ts, rank, kind, hospital_id, km, plan): each open alert with the hospitals of its
    rounds, and what these answer: some decline, some accept, and of those some hand the case back."""
    plan = escalations(t.alerts, t.hospitals)
    rounds = plan.groupBy("alert_id", "round_no").agg(F.array_sort(F.collect_list(F.struct("place", "hospital_id"))).alias("picks")).groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("round_no", c("picks.hospital_id").alias("ids")))).alias("rounds"))
    alerts = t.alerts.filter("status = 'new'").select(c("id").alias("alert_id"), c("created_at").cast("timestamp").alias("at_ts"), "lat", "lng")
    created = alerts.join(rounds.select("alert_id", c("rounds.ids").alias("plan")), "alert_id", "left").select("alert_id", "at_ts", F.lit(0).alias("rank"), F.lit("created").alias("kind"), F.lit(None).cast("long").alias("hospital_id"), F.lit(None).cast("double").alias("km"), "plan")
    later = lambda seconds: F.timestamp_millis(F.unix_millis("at_ts") + (seconds * 1000).cast("long"))
    turn = (c("alert_id") + c("place") * 3 + c("round_no")) % 7
    wait = F.lit(ROUND_MS // 1000) * (c("round_no") - 1) + (c("alert_id") * 7 + c("place") * 31) % 150
    hospitals = t.hospitals.select(c("id").alias("hospital_id"), c("lat").alias("h_lat"), c("lng").alias("h_lng"))
    asked = plan.select("alert_id", "round_no", "place", "hospital_id").join(alerts, "alert_id").join(hospitals, "hospital_id").withColumns({"turn": turn, "wait": wait, "km": haversine_km(c("lat"), c("lng"), c("h_lat"), c("h_lng"))})
    takes = c("turn") == 0
    steps = F.array_compact(F.array(
        F.when(takes, F.struct(F.lit("accept").alias("kind"), c("wait").alias("s"), c("km").alias("km"))).when(c("turn") <= 3, F.struct(F.lit("decline").alias("kind"), c("wait").alias("s"), c("km").alias("km"))),
        *[F.when(takes, F.struct(F.lit("location").alias("kind"), (c("wait") + 20 * k).alias("s"), (c("km") * (1.0 - 0.15 * k)).alias("km"))) for k in (1, 2, 3)],
        F.when(takes & (c("alert_id") % 3 == 0), F.struct(F.lit("release").alias("kind"), (c("wait") + 100).alias("s"), c("km").alias("km"))),
        F.when(takes, F.struct(F.lit("on_scene").alias("kind"), (c("wait") + 300).alias("s"), c("km").alias("km"))), F.when(takes, F.struct(F.lit("closed").alias("kind"), (c("wait") + 900).alias("s"), c("km").alias("km"))),
    ))
    answers = asked.select("alert_id", "at_ts", "hospital_id", "place", "round_no", F.posexplode(steps).alias("n", "x"))
    rank = c("round_no") * 1000 + c("place") * 100 + c("n")
    answers = answers.select("alert_id", later(c("x.s")).alias("at_ts"), rank.cast("int").alias("rank"), c("x.kind").alias("kind"), "hospital_id", c("x.km").alias("km"), F.lit(None).cast("array<array<long>>").alias("plan"))
    return created.unionByName(answers)


@query()
def dispatch_rounds(t):
    """Every step of every open alert: rounds, answers, releases and re-dispatch, arrival times, exhaustion."""
    return replay(dispatch_log(t), dispatch, "alert_id", SCHEMA, "2100-01-01", *FIELDS)


@query("""
    with s as (select *, case when coalesce(at_ts - lag(at_ts) over (partition by alert_id order by at_ts) > interval '150' millisecond, true) then 1 else 0 end as fresh from positions),
    b as (select *, sum(fresh) over (partition by alert_id order by at_ts range between unbounded preceding and current row) as burst from s)
    select alert_id, arg_max(kind, (at_ts, kind)) as kind, count(*) as updates from b group by alert_id, burst""")
def debounced_updates(t):
    """The last update of each burst of an alert's updates, after more than 150 ms of silence."""
    return debounced(t.positions.withColumn("at_ts", c("at_ts").cast("timestamp"))).select("alert_id", "kind", "updates")
