"""What each side sees of an alert, and text made safe for pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query

c = F.col
#: Statuses that a reporter may still cancel, and events that a reporter sees.
CANCELLABLE, PUBLIC_EVENTS = ("new", "accepted", "dispatched"), ("created", "accepted", "on_scene", "closed")
#: Columns that all sides see.
COMMON = ("id", "status", "priority", "is_drill", "created_at", "lat", "lng", "zone", "report_count", "accepted_hospital_id", "escalation_round", "exhausted")
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def html_escaped(text: Column) -> Column:
    """Text that a page shows as it is; a null is empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, shown in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(shown))
    return out


def picked(df: DataFrame, columns: tuple) -> DataFrame:
    """Only the columns of a list that ``df`` has, in its order: what a write may carry."""
    return df.select(*[x for x in df.columns if x in columns])


def with_hospital(alerts: DataFrame, hospitals: DataFrame, *columns: str) -> DataFrame:
    """Alerts with columns of the hospital that accepted, null before one has."""
    h = hospitals.select(c("id").alias("h_id"), *[c(x).alias(f"hospital_{x}") for x in columns])
    return alerts.join(h, c("accepted_hospital_id") == c("h_id"), "left").drop("h_id")


def public_view(alerts: DataFrame, hospitals: DataFrame, targets: DataFrame, events: DataFrame) -> DataFrame:
    """A reporter's view: no declines, no telephone; whether it can be cancelled, how many hospitals were
    asked, and the events that concern a reporter, in order."""
    asked = targets.filter("round_no > 0").groupBy(c("alert_id").alias("id")).agg(F.count(F.lit(1)).alias("hospitals_notified"))
    steps = events.filter(c("kind").isin(*PUBLIC_EVENTS)).groupBy(c("alert_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("at_ts", "stage", "kind"))).alias("steps"))
    steps = steps.select("id", F.array_join("steps.kind", ">").alias("timeline"))
    rows = with_hospital(picked(alerts.withColumn("reporter_known", c("reporter_id").isNotNull()), (*COMMON, "reporter_known")), hospitals, "name", "phone", "address", "emergency_level")
    rows = rows.join(asked, "id", "left").join(steps, "id", "left").withColumn("can_cancel", c("status").isin(*CANCELLABLE))
    return rows.withColumns({"hospitals_notified": F.coalesce("hospitals_notified", F.lit(0)), "timeline": F.coalesce("timeline", F.lit(""))})


def crew_view(alerts: DataFrame, hospitals: DataFrame) -> DataFrame:
    """An ambulance's view: what all see, the reporter, and the hospital it drives to."""
    return with_hospital(picked(alerts, (*COMMON, "reporter_id")), hospitals, "name", "phone", "address", "lat", "lng")


@query("""
    with t as (select alert_id as id, count(*) as n from alert_targets where round_no > 0 group by 1), e as (select alert_id as id, string_agg(kind, '>' order by at_ts, stage) as timeline from alert_events where kind in ('created', 'accepted', 'on_scene', 'closed') group by 1)
    select a.id, a.status, a.priority, a.zone, a.report_count, a.reporter_id is not null as reporter_known, a.status in ('new', 'accepted', 'dispatched') as can_cancel, h.name as hospital_name, h.emergency_level as hospital_emergency_level, coalesce(t.n, 0) as hospitals_notified, coalesce(e.timeline, '') as timeline
    from alerts a left join hospitals h on h.id = a.accepted_hospital_id left join t on t.id = a.id left join e on e.id = a.id""")
def public_alerts(t):
    shown = ("id", "status", "priority", "zone", "report_count", "reporter_known", "can_cancel", "hospital_name", "hospital_emergency_level", "hospitals_notified", "timeline")
    return public_view(t.alerts, t.hospitals, t.alert_targets, t.alert_events).select(*shown)


@query("select a.id, a.status, a.reporter_id, a.lat, a.lng, h.name as hospital_name, h.phone as hospital_phone, h.address as hospital_address, h.lat as hospital_lat from alerts a left join hospitals h on h.id = a.accepted_hospital_id")
def crew_alerts(t):
    return crew_view(t.alerts, t.hospitals).select("id", "status", "reporter_id", "lat", "lng", "hospital_name", "hospital_phone", "hospital_address", "hospital_lat")


@query("select page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')) as escaped_md5 from pages")
def escaped_pages(t):
    """Whole pages as text that a page can show, by digest."""
    return t.pages.select("page_id", F.md5(html_escaped(c("html")).cast("binary")).alias("escaped_md5"))
