"""Filters, searches, paging, validation and row visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, half_up, in_box
from ..plans.dialect import half_up as sql_half_up
from ..plans.dialect import km
from ..plans.registry import query

c = F.col


def like_any(needle: str, *columns: str) -> Column:
    """A substring in any of the columns, in either case; % and _ are plain characters."""
    hits = [F.lower(c(x)).contains(needle.lower()) for x in columns]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def accidents_where(df: DataFrame, *, date_from=None, date_to=None, severity=None, area=None, zone=None, keep_undated=False) -> DataFrame:
    """Only the filters that are given become predicates, so each reaches the scan."""
    if date_from is not None:
        hit = c("accident_date") >= F.lit(date_from).cast("date")
        df = df.filter(hit | c("accident_date").isNull() if keep_undated else hit)
    if date_to is not None:
        hit = c("accident_date") <= F.lit(date_to).cast("date")
        df = df.filter(hit | c("accident_date").isNull() if keep_undated else hit)
    if severity is not None:
        df = df.filter(c("severity") == severity)
    if area is not None:
        df = df.filter(like_any(area, "area"))
    if zone is not None:
        df = df.filter(c("zone") == zone)
    return df


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """A page with the number of all rows in total_count."""
    counted = df.crossJoin(df.agg(F.count(F.lit(1)).alias("total_count")))
    return counted.orderBy(*order).offset(offset).limit(size)


def hour_in(hour: Column, first: int, last: int) -> Column:
    """Inclusive; wraps midnight where first > last."""
    inside = (hour >= first) & (hour <= last) if first <= last else (hour >= first) | (hour <= last)
    return F.coalesce(inside, F.lit(False))


BASIC = ("id", "severity", "area", "zone", "accident_date")


@query("select id, severity, area, zone, accident_date from active where accident_date >= date '2024-03-01' and accident_date <= date '2024-09-30' and severity = 'serious' and lower(area) like '%area 1%'", dates=('accident_date',))
def accidents_filter(t):
    return accidents_where(t.active, date_from="2024-03-01", date_to="2024-09-30", severity="serious", area="Area 1").select(*BASIC)


@query("select id, severity, area, zone, accident_date from active where (accident_date >= date '2024-06-01' or accident_date is null) and zone = 'East'", dates=('accident_date',))
def accidents_filter_json(t):
    return accidents_where(t.active, date_from="2024-06-01", zone="East", keep_undated=True).select(*BASIC)


NEAR = km("lat", "lng", "12.95e0", "77.55e0")


@query(f"select id, severity, {sql_half_up(NEAR, 3)} as km from active where severity in ('fatal', 'serious') and {NEAR} <= 5e0")
def filter_within_km(t):
    d = haversine_km(c("lat"), c("lng"), F.lit(12.95), F.lit(77.55))
    return t.active.filter(c("severity").isin("fatal", "serious")).withColumn("d", d).filter("d <= 5").select("id", "severity", half_up(c("d"), 3).alias("km"))


@query("select id, hour, severity from active where hour >= 21 or hour <= 5")
def filter_hour_wrap(t):
    return t.active.filter(hour_in(c("hour"), 21, 5)).select("id", "hour", "severity")


@query("select count(*) filter (where hour >= 21 or hour <= 5) as matched, count(*) filter (where hour is null) as excluded_no_time from active where zone = 'North'")
def filter_excluded_no_time(t):
    return t.active.filter(c("zone") == "North").agg(F.count_if(hour_in(c("hour"), 21, 5)).alias("matched"), F.count_if(c("hour").isNull()).alias("excluded_no_time"))


@query("""
    with n as (select location, area, count(*) filter (where hour between 3 and 4) as hits, count(*) filter (where hour is null) as untimed from active group by 1, 2)
    select id, hour, hits = 0 and untimed > 0 as time_filter_dropped from active r join n on r.location = n.location and r.area is not distinct from n.area where hour between 3 and 4 or (hits = 0 and untimed > 0)""")
def filter_soft_time(t):
    """Incidents of each place between three and five at night; where a place has none, but has some
    without a time, all of its incidents."""
    hit = hour_in(c("hour"), 3, 4)
    facts = t.active.groupBy(c("location").alias("l"), c("area").alias("a")).agg(F.count_if(hit).alias("hits"), F.count_if(c("hour").isNull()).alias("untimed"))
    dropped = (c("hits") == 0) & (c("untimed") > 0)
    return t.active.join(facts, (c("location") == c("l")) & c("area").eqNullSafe(c("a"))).filter(hit | dropped).select("id", "hour", dropped.alias("time_filter_dropped"))


@query("""
    with r as (select * from incidents where lower(title) like '%click%' or lower(location) like '%click%' or lower(area) like '%click%')
    select id, title, severity, (select count(*) from r) as total_count from r order by seq desc limit 20 offset 20""")
def admin_search_page(t):
    rows = t.incidents.filter(like_any("click", "title", "location", "area"))
    return page(rows, [c("seq").desc()], 20, 20).select("id", "title", "severity", "total_count")


@query("select id, name, emergency_level, beds from hospitals where (lower(name) like '%hospital%' or lower(address) like '%1%' or phone like '%1%') and coalesce(emergency_level, 'general') in ('trauma', 'emergency', 'general') order by name, id limit 25 offset 10")
def hospital_search(t):
    rows = t.hospitals.filter(like_any("hospital", "name") | like_any("1", "address", "phone")).filter(F.coalesce("emergency_level", F.lit("general")).isin("trauma", "emergency", "general"))
    return rows.orderBy("name", "id").offset(10).limit(25).select("id", "name", "emergency_level", "beds")


@query("select id, title from active where contains(lower(concat_ws(' ', title, description, location)), 'factor 7')")
def keyword_search(t):
    return t.active.filter(F.lower(F.concat_ws(" ", "title", "description", "location")).contains("factor 7")).select("id", "title")


@query("select id, lat, lng from incidents where lat between 12.9e0 and 13.0e0 and lng between 77.5e0 and 77.6e0")
def bbox_filter(t):
    return t.incidents.filter(in_box(c("lat"), c("lng"), 12.9, 77.5, 13.0, 77.6)).select("id", "lat", "lng")


def report_errors() -> Column:
    """The reasons why a submitted report is refused, in the order of its fields."""
    place, area, text = F.trim("location"), F.trim("area"), F.trim("description")
    checks = [
        F.when(c("lat").isNull(), "latitude is required").when(~c("lat").between(12.5, 13.5), "latitude out of bounds"),
        F.when(c("lng").isNull(), "longitude is required").when(~c("lng").between(77.0, 78.2), "longitude out of bounds"),
        F.when(F.coalesce(F.length(place), F.lit(0)) == 0, "location is required").when(F.length(place) > 100, "location too long"),
        F.when(F.coalesce(F.length(area), F.lit(0)) == 0, "area is required").when(F.length(area) > 60, "area too long"),
        F.when(c("severity").isNull(), "severity is required").when(~c("severity").isin("fatal", "serious", "minor"), "severity unknown"),
        F.when(c("accident_date").isNull(), "date is required"),
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "description is required").when(~F.length(text).between(20, 500), "description length"),
    ]
    return F.array_compact(F.array(*checks))


@query("""
    select id, concat_ws('; ', case when lat is null then 'latitude is required' when lat not between 12.5 and 13.5 then 'latitude out of bounds' end,
        case when lng is null then 'longitude is required' when lng not between 77.0 and 78.2 then 'longitude out of bounds' end,
        case when coalesce(length(trim(location)), 0) = 0 then 'location is required' when length(trim(location)) > 100 then 'location too long' end,
        case when coalesce(length(trim(area)), 0) = 0 then 'area is required' when length(trim(area)) > 60 then 'area too long' end,
        case when severity is null then 'severity is required' when severity not in ('fatal', 'serious', 'minor') then 'severity unknown' end,
        case when accident_date is null then 'date is required' end,
        case when coalesce(length(trim(description)), 0) = 0 then 'description is required' when length(trim(description)) not between 20 and 500 then 'description length' end) as errors
    from incidents""")
def validate_reports(t):
    return t.incidents.select("id", F.array_join(report_errors(), "; ").alias("errors"))


@query("""
    select id, case event when 'click' then 'near_miss' when 'view' then 'road_hazard' when 'error' then 'action_request' end is not null and length(trim(description)) >= 25 and lat is not null as valid
    from (select *, regexp_extract(title, '^Incident ([a-z]+) ', 1) as event from incidents)""")
def validate_civic(t):
    kinds = F.create_map(*map(F.lit, ("click", "near_miss", "view", "road_hazard", "error", "action_request")))
    kind = F.try_element_at(kinds, F.regexp_extract("title", "^Incident ([a-z]+) ", 1))
    return t.incidents.select("id", (kind.isNotNull() & (F.length(F.trim("description")) >= 25) & c("lat").isNotNull()).alias("valid"))


@query("select id, reporter_id, created_at from incidents where status = 'pending' and reporter_id is not null and source = 'User'")
def pending_queue(t):
    return t.incidents.filter((c("status") == "pending") & c("reporter_id").isNotNull() & (c("source") == "User")).select("id", "reporter_id", "created_at")


@query("select id, case status when 'active' then 'verified' when 'hidden' then 'rejected' else coalesce(status, 'pending') end as shown_status, accident_date from incidents where reporter_id = 7", dates=('accident_date',))
def reports_mine(t):
    shown = F.when(c("status") == "active", "verified").when(c("status") == "hidden", "rejected").otherwise(F.coalesce("status", F.lit("pending")))
    return t.incidents.filter("reporter_id = 7").select("id", shown.alias("shown_status"), "accident_date")


@query("select id, escalation_round from alerts where status = 'new' and not exhausted and created_at + interval '90' second * escalation_round <= timestamp '1998-01-01 00:00:00'")
def due_for_escalation(t):
    due = F.expr("created_at + interval '90' second * escalation_round <= timestamp_ntz'1998-01-01 00:00:00'")
    return t.alerts.filter((c("status") == "new") & ~c("exhausted") & due).select("id", "escalation_round")


def visible_to(role: str, user: int | None = None) -> Column:
    """Public: active rows; an owner: own rows too; an administrator: all."""
    if role == "admin":
        return F.lit(True)
    shown = c("status") == "active"
    return shown | (c("reporter_id") == user) if user is not None else shown


@query("""
    select 'public' as role, count(*) filter (where status = 'active') as visible_rows from incidents
    union all select 'owner', count(*) filter (where status = 'active' or reporter_id = 7) from incidents
    union all select 'admin', count(*) from incidents""")
def rls_visible_rows(t):
    roles = {"public": ("public", None), "owner": ("owner", 7), "admin": ("admin", None)}
    counts = t.incidents.agg(*[F.count_if(visible_to(*who)).alias(name) for name, who in roles.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), c(r).alias("visible_rows")) for r in roles])).alias("x")).select("x.*")


@query("""
    select id, status, priority, case when accepted_hospital_id = 3 then 'note ' || cast(id as varchar) end as note,
        case when accepted_hospital_id = 3 then reporter_id end as reporter_phone from alerts where not is_drill""")
def redacted_view(t):
    involved = c("accepted_hospital_id") == 3
    return t.alerts.filter(~c("is_drill")).select(
        "id", "status", "priority", F.when(involved, F.concat(F.lit("note "), c("id").cast("string"))).alias("note"), F.when(involved, c("reporter_id")).alias("reporter_phone")
    )


@query("select id, status, created_at from alerts order by case status when 'new' then 0 when 'closed' then 1 else 2 end, created_at desc, id limit 200")
def civic_ordered(t):
    rank = F.when(c("status") == "new", 0).when(c("status") == "closed", 1).otherwise(2)
    return t.alerts.orderBy(rank, c("created_at").desc(), "id").limit(200).select("id", "status", "created_at")


@query("""
    select id, cast(row_number() over (order by case priority when 'critical' then 0 when 'urgent' then 1 else 2 end, case when accepted_hospital_id = 5 then 0 else 1 end, created_at desc, id) as integer) as place
    from alerts qualify place <= 100""")
def console_order(t):
    rank = F.when(c("priority") == "critical", 0).when(c("priority") == "urgent", 1).otherwise(2)
    mine = F.when(c("accepted_hospital_id") == 5, 0).otherwise(1)
    # the best hundred come first, so that the numbering sees no more rows than these
    top = t.alerts.select("id", rank.alias("rank"), mine.alias("mine"), "created_at").orderBy("rank", "mine", c("created_at").desc(), "id").limit(100)
    return top.select("id", F.row_number().over(Window.orderBy("rank", "mine", c("created_at").desc(), "id")).alias("place"))


@query(f"select id, {sql_half_up(NEAR, 3)} as km from active order by {NEAR}, seq limit 8")
def near_you(t):
    d = haversine_km(c("lat"), c("lng"), F.lit(12.95), F.lit(77.55))
    return t.active.withColumn("d", d).orderBy("d", "seq").limit(8).select("id", half_up(c("d"), 3).alias("km"))
