"""Changes of tables as functions of a snapshot and its changes: each gives a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_match
from ..plans.dialect import first_match as sql_first
from ..plans.registry import query
from .facilities import ZONES

c = F.col


def merge_snapshot(old: DataFrame, new: DataFrame, key: str, guard=None) -> DataFrame:
    """Rows of both by ``key``: a new value that isn't null replaces the old one, unless
    ``guard`` (a condition on the old row, prefix o_) protects it."""
    o = old.select(*[c(x).alias(f"o_{x}") for x in old.columns])
    both = o.join(new, c(f"o_{key}") == c(key), "full_outer")
    free = F.lit(True) if guard is None else ~F.coalesce(guard, F.lit(False))
    return both.select(*[F.coalesce(F.when(free, c(x)), c(f"o_{x}"), c(x)).alias(x) for x in old.columns])


def patch(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``changes`` where they have a value."""
    renamed = changes.select(c(key), *[c(x).alias(f"n_{x}") for x in changes.columns if x != key])
    joined = df.join(renamed, key, "left")
    return joined.select(*[F.coalesce(c(f"n_{x}"), c(x)).alias(x) if f"n_{x}" in joined.columns else c(x) for x in df.columns])


OVERLAY = "o as (select id, case when seq % 2 = 0 then '' else 'New ' || title end as title, location from incidents where seq % 3 = 0), b as (select id, title, area from incidents where seq % 5 <> 0)"


@query(f"with {OVERLAY} select coalesce(b.id, o.id) as id, coalesce(nullif(o.title, ''), b.title) as title, b.area, o.location from b full join o on b.id = o.id")
def merge_sources(t):
    """Two sources by id; of two values the later one wins unless it is empty."""
    o = t.incidents.filter("seq % 3 = 0").select("id", F.when(c("seq") % 2 == 0, "").otherwise(F.concat(F.lit("New "), "title")).alias("o_title"), "location")
    b = t.incidents.filter("seq % 5 != 0").select("id", "title", "area")
    return b.join(o, "id", "full_outer").select("id", F.coalesce(F.nullif("o_title", F.lit("")), "title").alias("title"), "area", "location")


FRESH = "n as (select id + 20 as id, name || ' new' as name, case when id % 2 = 0 then null else beds + 1 end as beds, cast(null as boolean) as verified from hospitals)"


@query(f"""
    with {FRESH}, o as (select id, name, beds, verified from hospitals)
    select coalesce(o.id, n.id) as id, case when coalesce(o.verified, false) then o.name else coalesce(n.name, o.name) end as name,
        case when coalesce(o.verified, false) then o.beds else coalesce(n.beds, o.beds) end as beds, o.verified from o full join n on o.id = n.id""")
def upsert_protected(t):
    new = t.hospitals.select((c("id") + 20).alias("id"), F.concat("name", F.lit(" new")).alias("name"), F.when(c("id") % 2 != 0, c("beds") + 1).alias("beds"), F.lit(None).cast("boolean").alias("verified"))
    return merge_snapshot(t.hospitals.select("id", "name", "beds", "verified"), new, "id", c("o_verified"))


@query("""
    select id from hospitals h where verified or source = 'manual' or id in (select hospital_id from accounts) or id in (select id + 20 from hospitals)""")
def prune_stale(t):
    """Rows that the source still has; verified, manual and linked ones stay anyway."""
    h = t.hospitals.select("id", "verified", "source")
    kept = c("verified") | (c("source") == "manual")
    loose = h.filter(~kept).join(t.accounts.select(c("hospital_id").alias("id")), "id", "left_anti")
    gone = loose.join(t.hospitals.select((c("id") + 20).alias("id")), "id", "left_anti")
    return h.join(gone, "id", "left_anti").select("id")


@query("select id, status from alerts where created_at >= (select max(created_at) from alerts) - interval '30' day or status = 'new'")
def hydrate_recent_or_open(t):
    last = t.alerts.agg(F.max("created_at").alias("last"))
    return t.alerts.crossJoin(F.broadcast(last)).filter("created_at >= last - interval '30' day or status = 'new'").select("id", "status")


@query("""
    select id, case when seq % 7 = 0 then 'active' when seq % 7 = 1 then 'hidden' else status end as status from incidents where seq % 7 <> 2""")
def bulk_moderate(t):
    """Lists of ids: verified, hidden, and deleted."""
    ids = t.incidents.select("id", (c("seq") % 7).alias("k"))
    act = ids.filter("k in (0, 1)").select("id", F.when(c("k") == 0, "active").otherwise("hidden").alias("status"))
    left = t.incidents.select("id", "status").join(ids.filter("k = 2").select("id"), "id", "left_anti")
    return patch(left, act, "id")


@query("""
    with n as (select id + 30 as id, 'N ' || name as name from hospitals)
    select coalesce(o.id, n.id) as id, coalesce(n.name, o.name) as name from (select id, name from hospitals) o full join n on o.id = n.id""")
def upsert_merge(t):
    new = t.hospitals.select((c("id") + 30).alias("id"), F.concat(F.lit("N "), "name").alias("name"))
    return merge_snapshot(t.hospitals.select("id", "name"), new, "id")


@query("select alert_id, hospital_id, case when response = 'missed' and hospital_id <> 5 then 'missed late' else response end as response from alert_targets")
def mark_missed(t):
    changed = F.when((c("response") == "missed") & (c("hospital_id") != 5), "missed late").otherwise(c("response"))
    return t.alert_targets.select("alert_id", "hospital_id", changed.alias("response"))


@query("select id, case status when 'closed' then 'resolved' when 'cancelled' then 'void' else status end as status from alerts where not is_drill")
def status_migration(t):
    """Old status words replaced, drills purged."""
    words = F.when(c("status") == "closed", "resolved").when(c("status") == "cancelled", "void").otherwise(c("status"))
    return t.alerts.filter(~c("is_drill")).select("id", words.alias("status"))


@query("select alert_id, string_agg(h, ',' order by h) as hospitals from (select distinct alert_id, cast(hospital_id as varchar) as h from alert_targets where round_no <= 2) group by 1")
def array_union_ids(t):
    """Ids that two rounds have notified, each once."""
    of = lambda r: F.collect_set(F.when(c("round_no") == r, c("hospital_id").cast("string")))
    g = t.alert_targets.filter("round_no <= 2").groupBy("alert_id").agg(of(1).alias("a"), of(2).alias("b"))
    return g.select("alert_id", F.array_join(F.sort_array(F.array_union("a", "b")), ",").alias("hospitals"))


@query("select id, severity, 'feature' as origin from active union all select 'local-' || id, severity, 'local' from incidents where status = 'pending' and reporter_id = 7")
def union_user_reports(t):
    local = t.incidents.filter("status = 'pending' and reporter_id = 7").select(F.concat(F.lit("local-"), "id").alias("id"), "severity", F.lit("local").alias("origin"))
    return t.active.select("id", "severity", F.lit("feature").alias("origin")).unionByName(local)


def append(df: DataFrame, new: DataFrame, status: str) -> DataFrame:
    """``df`` and the new rows, these with ``status``; columns that they lack are null."""
    return df.unionByName(new.withColumn("status", F.lit(status)), allowMissingColumns=True).select(*df.columns)


@query("""
    select id, title, description, status from incidents union all
    select 'report-' || cast(conv_id as varchar) || '-' || cast(turn as varchar), null, nullif(trim(text), ''), 'pending' from questions where nullif(trim(text), '') is not null""")
def append_reports(t):
    """Texts that users sent, as reports that wait for a decision; empty ones are refused."""
    said = F.nullif(F.trim("text"), F.lit(""))
    new = t.questions.filter(said.isNotNull()).select(F.concat(F.lit("report-"), c("conv_id").cast("string"), F.lit("-"), c("turn").cast("string")).alias("id"), said.alias("description"))
    return append(t.incidents.select("id", "title", "description", "status"), new, "pending")


def updated_rows(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """The rows that ``changes`` (key, new value) alters, with the value before; rows whose
    value stays are not among them."""
    new = changes.select(key, c(column).alias("__new"))
    met = df.select(key, c(column).alias(f"old_{column}")).join(new, key)
    return met.filter(~c(f"old_{column}").eqNullSafe(c("__new"))).withColumnRenamed("__new", column)


@query("""
    with n as (select alert_id as id, arg_max(kind, stage) as status from alert_events group by 1)
    select a.id, a.status as old_status, n.status from alerts a join n on a.id = n.id where a.status is distinct from n.status""")
def status_returning(t):
    """Alerts take the kind of their last event; the changed ones are returned."""
    last = t.alert_events.groupBy(c("alert_id").alias("id")).agg(F.max_by("kind", "stage").alias("status"))
    return updated_rows(t.alerts, last, "id", "status")


@query("""
    with m as (select location, quantile_disc(lat, 0.5) as mlat, quantile_disc(lng, 0.5) as mlng from incidents where lat is not null and lng is not null group by location)
    select i.id, coalesce(i.lat, m.mlat) as lat, coalesce(i.lng, m.mlng) as lng, i.lat is null and m.mlat is not null as filled from incidents i left join m on i.location = m.location""")
def geometry_backfill(t):
    """Rows without a point take the median one of their location's other rows; a location
    without any stays as it is. Sums of one location hold each distinct coordinate once, and are
    formed before rows move."""
    rows = t.incidents.select("id", "location", "lat", "lng")
    known = rows.filter("lat is not null and lng is not null").groupBy("location").agg(*[F.expr(f"percentile_disc(0.5) within group (order by {x}) as m{x}") for x in ("lat", "lng")])
    both = rows.join(known, "location", "left")
    return both.select("id", F.coalesce("lat", "mlat").alias("lat"), F.coalesce("lng", "mlng").alias("lng"), (c("lat").isNull() & c("mlat").isNotNull()).alias("filled"))


def set_points(rows: DataFrame, points: DataFrame) -> DataFrame:
    """``rows`` (id, lat, lng) with the points (id, lat, lng, at) that a geocoder has set, and whether one
    was: of several for an id the last by ``at``, then the largest. A point that was set counts as it is,
    a missing one too; ids that no row has change nothing, rows that share an id change alike."""
    last = points.filter("id is not null").groupBy(c("id").alias("set_id")).agg(F.max(F.struct("at", "lat", "lng")).alias("p"))
    both = rows.join(last, c("id") == c("set_id"), "left")
    pick = lambda x: F.when(c("set_id").isNotNull(), c(f"p.{x}")).otherwise(c(x)).alias(x)
    return both.select("id", pick("lat"), pick("lng"), c("set_id").isNotNull().alias("was_set"))


@query("""
    select i.id, case when p.id is not null then photo_lat else i.lat end as lat, case when p.id is not null then photo_lng else i.lng end as lng, p.id is not null as was_set
    from incidents i left join (select id, photo_lat, photo_lng from photos where photo_lat is not null) p on i.id = cast(p.id as varchar)""")
def geometry_set(t):
    """Incidents with the points that their photos name."""
    points = t.photos.filter("photo_lat is not null").select(c("id").cast("string").alias("id"), c("photo_lat").alias("lat"), c("photo_lng").alias("lng"), c("taken_on").alias("at"))
    return set_points(t.incidents.select("id", "lat", "lng"), points)


@query("""
    select 'emergency_level' as field, emergency_level as value, count(*) as n from hospitals group by 2 union all
    select 'er_status', er_status, count(*) from hospitals group by 2 union all
    select 'source', source, count(*) from hospitals group by 2""")
def seed_report(t):
    """What a run of the seed loaded: rows of each value of each field, in one pass."""
    fields = ("emergency_level", "er_status", "source")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c(f).alias("value")) for f in fields]))
    return t.hospitals.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


#: Fixed value: columns that a moderator may change.
EDITABLE = ("title", "description", "location", "area", "zone", "severity", "status", "accident_date")


def moderated(df: DataFrame, changes: DataFrame) -> DataFrame:
    """``df`` with the non-null values of ``changes`` (id, columns of EDITABLE) put in; other columns of a
    change are not taken. Where a place is changed and no zone is given, the zone is inferred from the
    new area and location. Of several changes of one id the last by their other columns counts."""
    taken = [x for x in EDITABLE if x in changes.columns]
    one = changes.groupBy(c("id").alias("c_id")).agg(F.max(F.struct(*taken)).alias("new"))
    rows = df.join(one, c("id") == c("c_id"), "left")
    new = lambda x: c(f"new.{x}") if x in taken else F.lit(None)
    value = {x: F.coalesce(new(x), c(x)) for x in taken}
    moved = new("location").isNotNull() | new("area").isNotNull()
    if "zone" in df.columns:
        place = F.concat_ws(" ", value.get("area", c("area")), value.get("location", c("location")))
        value["zone"] = F.when(new("zone").isNotNull(), new("zone")).when(moved, F.when(F.trim(place) == "", "Central").otherwise(first_match(place, ZONES, "Other"))).otherwise(c("zone"))
    return rows.select(*[value[x].alias(x) if x in value else c(x) for x in df.columns])


@query(f"""
    with n as (select *, case when seq % 5 = 0 then case seq % 4 when 0 then 'Whitefield Main Road' when 1 then 'Hebbal' when 2 then 'Mysore Road' else 'Nowhere' end end as new_location, case when seq % 15 = 0 then 'West' end as new_zone, case when seq % 7 = 0 then 'hidden' end as new_status from incidents)
    select id, coalesce(new_location, location) as location, coalesce(new_status, status) as status, reporter_id,
        case when new_zone is not null then new_zone when new_location is not null then {sql_first("concat_ws(' ', area, new_location)", ZONES, 'Other')} else zone end as zone from n""")
def moderate_places(t):
    """Changed places get the zone of their new names; a reporter can't be changed."""
    spots = F.when(c("seq") % 4 == 0, "Whitefield Main Road").when(c("seq") % 4 == 1, "Hebbal").when(c("seq") % 4 == 2, "Mysore Road").otherwise("Nowhere")
    changes = t.incidents.filter("seq % 5 = 0 or seq % 7 = 0").select("id", F.when(c("seq") % 5 == 0, spots).alias("location"), F.when(c("seq") % 15 == 0, "West").alias("zone"), F.when(c("seq") % 7 == 0, "hidden").alias("status"), F.lit(-1).cast("long").alias("reporter_id"))
    return moderated(t.incidents, changes).select("id", "location", "status", "reporter_id", "zone")
