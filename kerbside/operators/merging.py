"""Reports of one accident and rows of one hospital, merged in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import km
from ..plans.registry import query
from ..plans.steps import checkpoint
from .facilities import FOLDED, folded_name
from .leaders import clusters, ordered_rows

c = F.col
#: Metres and minutes in which reports merge, vehicles that are known and how many are
#: kept, characters of the notes, what joins them, and metres of one hospital's rows.
REPORT_M, REPORT_MIN, MOST_VEHICLES, NOTE_CHARS, NOTE_JOIN, CAMPUS_M = 200.0, 15, 6, 1500, "\n— ", 250.0
VEHICLES = ("two_wheeler", "car", "auto", "bus_truck", "pedestrian", "cycle", "other")
#: Answers from mild to grave, the grave answer of each question, levels and priorities from the best on.
INJURED = ("unknown", "0", "1", "2", "3+")
GRAVE = {"conscious": "no", "breathing": "no", "bleeding": "yes", "trapped": "yes", "fire": "yes"}
LEVELS = ("trauma", "emergency", "general", "none")
PRIORITIES = ("critical", "urgent", "standard")


def merged_into(reports: DataFrame, metres: float = REPORT_M, minutes: float = REPORT_MIN, closed_at: Column | None = None) -> DataFrame:
    """(id, alert_id): the alert of each report of (id, lat, lng, created_at, is_drill).

    Reports come in order of time and id. One that has an open alert of its kind (drill or not)
    within ``metres``, no more than ``minutes`` old, merges into the nearest, of equally near ones
    the oldest; else it is an alert itself. A merged report is no target. Reports without a
    position or time are alerts of their own; ``closed_at`` is when an alert stops taking reports.
    """
    rows = ordered_rows(reports, "id", F.coalesce(c("is_drill"), F.lit(False)), [c("created_at")], c("created_at"), closed_at)
    return clusters(rows, metres, minutes * 60.0).withColumnRenamed("leader_id", "alert_id")


def injured_rank(name: str) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, INJURED)), c(name)), F.lit(1))


def running(reports: DataFrame) -> DataFrame:
    """Reports of (alert_id, ...) with what their alert's triage says once they are in: the gravest
    answers so far, and the priority of these and the report's own severity."""
    order = Window.partitionBy("alert_id").orderBy("created_at", "id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = reports.withColumn("hurt", F.max(injured_rank("injured")).over(so_far))
    grave = F.lit(False)
    for question, bad in GRAVE.items():
        rows = rows.withColumn(f"is_{question}", F.coalesce(c(question) == bad, F.lit(False)))
        grave = grave | c(f"is_{question}")
    any_grave = F.max(grave | (c("hurt") == len(INJURED))).over(so_far)
    level = F.when(any_grave | (F.coalesce("reported_severity", F.lit("")) == "fatal"), 0).when((c("hurt") == 2) | ((F.coalesce("reported_severity", F.lit("")) == "minor") & (c("hurt") != 4)), 2).otherwise(1)
    return rows.withColumn("level", level).withColumn("place", F.row_number().over(order))


def answers(question: str, bad: str) -> Column:
    """The grave answer if anyone gave it, else the other if anyone did."""
    known = F.max(F.when(c(question).isin("yes", "no"), c(question)))
    return F.when(F.max(f"is_{question}"), bad).otherwise(F.coalesce(known, F.lit("unknown"))).alias(question)


def merged_alerts(reports: DataFrame, into: DataFrame) -> DataFrame:
    """One row for each alert with its reports folded in.

    Triage keeps the gravest answers, the priority is the highest that any state of the triage had,
    vehicles are joined in the order they were named (known ones, 6 at most), notes are joined and
    cut at 1500 characters. An alert of any number of reports is folded by windows; only the
    first 500 notes, which fill those characters, and 7 kinds of vehicles are put into arrays.
    """
    rows = checkpoint(running(reports.join(into, "id")))
    facts = rows.groupBy("alert_id").agg(
        F.element_at(F.array(*map(F.lit, INJURED)), F.max("hurt").cast("int")).alias("injured"), *(answers(q, bad) for q, bad in GRAVE.items()),
        F.max("called_108").alias("called_108"), F.element_at(F.array(*map(F.lit, PRIORITIES)), (F.min("level") + 1).cast("int")).alias("priority"), F.count(F.lit(1)).alias("report_count"),
    )
    facts = facts.withColumn("severity", F.when(c("priority") == "standard", "minor").otherwise("serious"))
    named = rows.select("alert_id", "place", F.posexplode(F.slice(F.array_distinct(F.filter(F.split("vehicles", ","), lambda v: v.isin(*VEHICLES))), 1, MOST_VEHICLES)).alias("at", "vehicle"))
    first = named.groupBy("alert_id", "vehicle").agg(F.min(F.struct("place", "at")).alias("first"))
    kinds = first.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("first", "vehicle"))).alias("all"))
    kinds = kinds.select("alert_id", F.array_join(F.slice(c("all.vehicle"), 1, MOST_VEHICLES), ",").alias("vehicles"))
    noted = rows.filter("note <> ''").withColumn("nth", F.row_number().over(Window.partitionBy("alert_id").orderBy("place"))).filter(c("nth") <= NOTE_CHARS // 3)
    notes = noted.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.substring("note", 1, NOTE_CHARS).alias("note")))).alias("all"))
    notes = notes.select("alert_id", F.substring(F.array_join("all.note", NOTE_JOIN), 1, NOTE_CHARS).alias("note"))
    return facts.join(kinds, "alert_id", "left").join(notes, "alert_id", "left").withColumn("vehicles", F.coalesce("vehicles", F.lit("")))


#: A replay of all reports one by one, the places side by side: nothing of one place is near another.
REPLAY = f"""
    s as (select *, row_number() over (partition by place, is_drill order by created_at, id) as k from sos),
    r as (
        select place, is_drill, cast(0 as bigint) as k, cast(null as bigint) as id, cast(null as bigint) as alert_id, cast([] as struct(id bigint, lat double, lng double, ts timestamp)[]) as open from (select distinct place, is_drill from s)
        union all
        select place, is_drill, k, id, coalesce(best.id, id), case when best is null then list_append(recent, {{'id': id, 'lat': lat, 'lng': lng, 'ts': created_at}}) else recent end from (
            select *, list_sort(list_filter(list_transform(recent, lambda a: {{'m': floor({km('a.lat', 'a.lng', 'lat', 'lng')} * 1e6 + 0.5e0) / 1e3, 'ts': a.ts, 'id': a.id}}), lambda a: a.m <= 200e0))[1] as best from (
                select s.*, list_filter(r.open, lambda a: a.ts >= s.created_at - interval '15' minute) as recent from r join s on s.place = r.place and s.is_drill = r.is_drill and s.k = r.k + 1
            )
        )
    ), m as (select s.*, r.alert_id from s join r using (id))"""


@query(f"with recursive {REPLAY} select id, alert_id, id <> alert_id as merged from m")
def report_merge(t):
    """Every report with its alert, within 200 m and 15 minutes, drills apart."""
    return merged_into(t.sos).withColumn("merged", c("id") != c("alert_id"))


HURT = "case injured when '0' then 2 when '1' then 3 when '2' then 4 when '3+' then 5 else 1 end"
IS_GRAVE = " or ".join(f"{q} = '{bad}'" for q, bad in GRAVE.items())


@query(f"""
    with recursive {REPLAY}, g as (
        select *, max({HURT}) over w as hurt, bool_or({IS_GRAVE} or injured = '3+') over w as grave, row_number() over w as nth from m window w as (partition by alert_id order by created_at, id rows between unbounded preceding and current row)
    ), f as (
        select alert_id, ['unknown', '0', '1', '2', '3+'][max(hurt)] as injured, {", ".join(f"case when bool_or({q} = '{bad}') then '{bad}' else coalesce(max({q}) filter (where {q} in ('yes', 'no')), 'unknown') end as {q}" for q, bad in GRAVE.items())}, bool_or(called_108) as called_108,
            ['critical', 'urgent', 'standard'][1 + min(case when grave or reported_severity = 'fatal' then 0 when hurt = 2 or (coalesce(reported_severity, '') = 'minor' and hurt <> 4) then 2 else 1 end)] as priority, count(*) as report_count,
            left(string_agg(note, chr(10) || '— ' order by nth) filter (where note <> ''), 1500) as note from g group by 1
    ), v as (select alert_id, vehicle, min(nth * 10 + pos) as first from (select alert_id, nth, unnest(string_split(vehicles, ',')) as vehicle, generate_subscripts(string_split(vehicles, ','), 1) as pos from g)
        where vehicle in ('two_wheeler', 'car', 'auto', 'bus_truck', 'pedestrian', 'cycle', 'other') group by 1, 2)
    select f.*, case when priority = 'standard' then 'minor' else 'serious' end as severity, coalesce(array_to_string(list_slice(x.vehicles, 1, 6), ','), '') as vehicles from f left join (select alert_id, list(vehicle order by first) as vehicles from v group by 1) x using (alert_id)""")
def merged_reports(t):
    """The alerts that the reports make, with triage, priority, vehicles, notes and how many reports."""
    return merged_alerts(t.sos, merged_into(t.sos))


# --- hospitals -------------------------------------------------------------------------


def completeness() -> Column:
    filled = lambda name: c(name).isNotNull() & (c(name).cast("string") != "")
    one = lambda cond: F.when(cond, 1).otherwise(0)
    return 2 * one(filled("phone")) + one(filled("address")) + one(c("osm_type").isin("way", "relation")) + one(filled("emergency_tag")) + one(c("beds") > 0)


def merged_hospitals(rows: DataFrame, metres: float = CAMPUS_M) -> DataFrame:
    """One row for each hospital: rows of one folded name within ``metres`` of a more complete one go
    into it, of several such into the most complete.

    Rows come in order of completeness and id. Empty phones, addresses, beds and operators are
    filled from the rows that go into it, in that order, and the best level is kept with where
    it comes from. Rows without a position stay as they are; ``merged`` counts the rows that went in.
    """
    ranked = rows.withColumn("folded", folded_name(c("name"))).withColumn("full", completeness())
    led = clusters(ordered_rows(ranked, "id", c("folded"), [(-c("full")).alias("less")]), metres, nearest=False)
    order = F.struct((c("id") != c("leader_id")).alias("other"), (-c("full")).alias("less"), "id")
    first = lambda name, cond: F.min_by(F.when(cond, c(name)), F.when(cond, order)).alias(name)
    filled = lambda name: c(name).isNotNull() & (c(name).cast("string") != "")
    own = lambda name: F.min_by(name, order).alias(name)
    level = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), c("emergency_level")), F.lit(0)), F.lit(len(LEVELS) + 1))
    best = F.struct(level.alias("level"), order.alias("order"))
    return ranked.join(led, "id").groupBy(c("leader_id")).agg(
        own("name"), own("lat"), own("lng"), first("phone", filled("phone")), first("address", filled("address")), first("beds", c("beds") > 0), first("operator_type", filled("operator_type")),
        F.min_by("emergency_level", best).alias("emergency_level"), F.min_by("level_source", best).alias("level_source"), (F.count(F.lit(1)) - 1).alias("merged"),
    ).withColumnRenamed("leader_id", "id")


RANK = "array_position(['trauma', 'emergency', 'general', 'none'], emergency_level)"


@query(f"""
    with recursive s as (
        select *, {FOLDED.replace("'The ' || name || ' Pvt Ltd & Hospitals'", "name")} as folded, case when phone is not null then 2 else 0 end + case when address is not null then 1 else 0 end + case when osm_type in ('way', 'relation') then 1 else 0 end
            + case when emergency_tag is not null then 1 else 0 end + case when beds > 0 then 1 else 0 end as complete from campuses
    ), o as (select *, row_number() over (partition by folded order by complete desc, id) as k from s),
    r as (
        select folded, cast(0 as bigint) as k, cast(null as bigint) as id, cast(null as bigint) as leader, cast([] as struct(id bigint, lat double, lng double)[]) as all_leaders from (select distinct folded from o)
        union all
        select folded, k, id, coalesce(best.id, id), case when best is null then list_append(all_leaders, {{'id': id, 'lat': lat, 'lng': lng}}) else all_leaders end from (
            select o.*, r.all_leaders, list_filter(r.all_leaders, lambda a: floor({km('a.lat', 'a.lng', 'o.lat', 'o.lng')} * 1e6 + 0.5e0) / 1e3 <= 250e0)[1] as best from r join o on o.folded = r.folded and o.k = r.k + 1
        )
    ), m as (select o.*, r.leader from o join r using (id))
    select leader as id, arg_min(name, k) as name, arg_min(lat, k) as lat, arg_min(lng, k) as lng, arg_min(phone, k) filter (where phone is not null) as phone, arg_min(address, k) filter (where address is not null) as address,
        arg_min(beds, k) filter (where beds > 0) as beds, arg_min(operator_type, k) filter (where operator_type is not null) as operator_type, arg_min(emergency_level, {RANK} * cast(1000000000 as bigint) + k) as emergency_level, arg_min(level_source, {RANK} * cast(1000000000 as bigint) + k) as level_source, count(*) - 1 as merged
    from m group by 1""")
def dedupe_hospitals(t):
    """Hospitals of one folded name within 250 m, merged into the most complete row."""
    return merged_hospitals(t.campuses)
