"""Counts and rankings of incidents by month, time, area and cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import half_up
from ..functions.text import hour_of, month_of, severity_counts, weekday, weight
from ..plans.dialect import half_up as sql_half_up
from ..plans.dialect import severity_counts as sql_severity
from ..plans.registry import query

c = F.col
SEV = sql_severity()


def n(name: str = "total"):
    return F.count(F.lit(1)).alias(name)


def spine(spark, name: str, size: int) -> DataFrame:
    """0 .. size - 1 as an int column: a constant number of rows."""
    return spark.range(size).select(c("id").cast("int").alias(name))


def dense(counts: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """``counts`` with a row for every key; what is missing is 0."""
    joined = F.broadcast(keys).join(counts, list(names), "left")
    return joined.select(*names, *[F.coalesce(x, F.lit(0)).alias(x) for x in counts.columns if x not in names])


@query(f"select strftime(accident_date, '%Y-%m') as month, count(*) as total, {SEV} from active where accident_date is not null group by 1")
def stats_monthly(t):
    return t.active.filter(c("accident_date").isNotNull()).groupBy(month_of(c("accident_date")).alias("month")).agg(n(), *severity_counts())


@query(f"select h.hour, count(a.id) as total, {sql_severity('a')} from (select cast(range as int) as hour from range(24)) h left join active a on a.hour = h.hour group by h.hour")
def by_hour(t):
    counts = t.active.filter(c("hour").isNotNull()).groupBy("hour").agg(n(), *severity_counts())
    return dense(counts, spine(t.spark, "hour", 24), "hour")


@query("select d.dow, count(a.id) as total from (select cast(range as int) as dow from range(7)) d left join (select id, cast(extract(dow from accident_date) as int) as dow from active) a on a.dow = d.dow group by d.dow")
def by_day(t):
    counts = t.active.filter(c("accident_date").isNotNull()).groupBy(weekday(c("accident_date")).alias("dow")).agg(n())
    return dense(counts, spine(t.spark, "dow", 7), "dow")


MATRIX = """
    select d.dow, h.hour, count(a.id) as total from (select cast(range as int) as dow from range(7)) d cross join (select cast(range as int) as hour from range(24)) h
    left join (select id, hour, cast(extract(dow from accident_date) as int) as dow from active) a on a.dow = d.dow and a.hour = h.hour group by d.dow, h.hour"""


@query(MATRIX)
def dow_hour_matrix(t):
    counts = t.active.filter(c("accident_date").isNotNull() & c("hour").isNotNull()).groupBy(weekday(c("accident_date")).alias("dow"), "hour").agg(n())
    return dense(counts, spine(t.spark, "dow", 7).crossJoin(spine(t.spark, "hour", 24)), "dow", "hour")


@query(f"""
    select 'hour' as kind, hour as bucket, count(*) as total, {SEV} from active where hour is not null group by 2
    union all select 'day', cast(extract(dow from accident_date) as int), count(*), {SEV} from active where accident_date is not null group by 2""")
def stats_by_time(t):
    both = F.explode(F.array(F.struct(F.lit("hour").alias("kind"), c("hour").alias("bucket")), F.struct(F.lit("day").alias("kind"), weekday(c("accident_date")).alias("bucket"))))
    return t.active.select("severity", both.alias("x")).select("severity", "x.*").filter("bucket is not null").groupBy("kind", "bucket").agg(n(), *severity_counts())


@query(f"select coalesce(area, 'Unknown') as area, coalesce(zone, 'Unknown') as zone, count(*) as total, {SEV} from active group by 1, 2")
def stats_by_area(t):
    return t.active.groupBy(F.coalesce("area", F.lit("Unknown")).alias("area"), F.coalesce("zone", F.lit("Unknown")).alias("zone")).agg(n(), *severity_counts())


@query(f"select count(*) as total, {SEV}, count(*) filter (where accident_date is null) as undated, min(accident_date) as first_date, max(accident_date) as last_date from active", dates=('first_date', 'last_date'))
def meta_counts(t):
    return t.active.agg(n(), *severity_counts(), F.count_if(c("accident_date").isNull()).alias("undated"), F.min("accident_date").alias("first_date"), F.max("accident_date").alias("last_date"))


@query("select distinct area from active where area is not null")
def meta_areas(t):
    return t.active.filter("area is not null").select("area").distinct()


@query("select distinct zone from active where zone is not null")
def meta_zones(t):
    return t.active.filter("zone is not null").select("zone").distinct()


@query(f"""
    with g as (select area, count(*) as total, arg_min(lat, seq) as lat, arg_min(lng, seq) as lng from active where area is not null group by area)
    select area, total, lat, lng, cast(row_number() over (order by total desc, area) as integer) as place, {sql_half_up('total * 100e0 / max(total) over ()', 1)} as share_of_max from g""")
def area_hotspots(t):
    g = t.active.filter("area is not null").groupBy("area").agg(n(), F.min_by("lat", "seq").alias("lat"), F.min_by("lng", "seq").alias("lng"))
    place = F.row_number().over(Window.orderBy(c("total").desc(), "area"))
    return g.select("area", "total", "lat", "lng", place.alias("place"), half_up(c("total") * 100.0 / F.max("total").over(Window.partitionBy()), 1).alias("share_of_max"))


@query(f"""
    with g as (
        select coalesce(area, 'Unknown area') as area, count(*) as incidents, cast(sum(case severity when 'fatal' then 5 when 'serious' then 3 else 1 end) as bigint) as weighted,
            count(*) filter (where severity = 'fatal') as critical, count(*) filter (where regexp_matches(date_raw, '(?:^|\\s)0?9:[0-5][0-9]')) as hour_matches, max(accident_date) as latest
        from active group by 1
    ), s as (
        select *, least(100e0, {sql_half_up('weighted * 1e0 / greatest(1, max(weighted) over ()) * 78e0 + least(12, hour_matches * 3) + least(10, critical * 2)')}) as risk_score from g
    )
    select area, incidents, weighted, critical, hour_matches, latest, cast(risk_score as int) as risk_score, case when risk_score >= 70 then 'high' when risk_score >= 40 then 'medium' else 'low' end as risk_level
    from s order by risk_score desc, area limit 12""", dates=('latest',))
def risk_hotspots(t):
    g = t.active.groupBy(F.coalesce("area", F.lit("Unknown area")).alias("area")).agg(
        n("incidents"), F.sum(weight(c("severity"), 5, 3, 1)).alias("weighted"), F.count_if(c("severity") == "fatal").alias("critical"), F.count_if(hour_of(c("date_raw")) == 9).alias("hour_matches"), F.max("accident_date").alias("latest")
    )
    top = F.greatest(F.lit(1), F.max("weighted").over(Window.partitionBy()))
    raw = c("weighted") * 1.0 / top * 78.0 + F.least(F.lit(12), c("hour_matches") * 3) + F.least(F.lit(10), c("critical") * 2)
    s = g.withColumn("risk_score", F.least(F.lit(100.0), half_up(raw)).cast("int"))
    level = F.when(c("risk_score") >= 70, "high").when(c("risk_score") >= 40, "medium").otherwise("low")
    return s.withColumn("risk_level", level).orderBy(c("risk_score").desc(), "area").limit(12)


@query(f"select count(*) as total, {SEV}, {sql_half_up("count(*) filter (where severity = 'fatal') * 100e0 / count(*)", 1)} as fatal_share, min(accident_date) as first_date, max(accident_date) as last_date from active where zone = 'East'", dates=('first_date', 'last_date'))
def ask_count(t):
    fatal = F.count_if(c("severity") == "fatal")
    return t.active.filter("zone = 'East'").agg(n(), *severity_counts(), half_up(fatal * 100.0 / F.count(F.lit(1)), 1).alias("fatal_share"), F.min("accident_date").alias("first_date"), F.max("accident_date").alias("last_date"))


@query(f"select coalesce(nullif(trim(substr(area, 1, 50)), ''), location) as place, count(*) as total, {SEV} from active group by 1 order by total desc, fatal desc, place limit 8")
def ask_rank_places(t):
    place = F.coalesce(F.nullif(F.trim(F.substring("area", 1, 50)), F.lit("")), c("location"))
    return t.active.groupBy(place.alias("place")).agg(n(), *severity_counts()).orderBy(c("total").desc(), c("fatal").desc(), "place").limit(8)


def trend(rows: DataFrame, length: int) -> DataFrame:
    return rows.groupBy(F.substring(c("accident_date").cast("string"), 1, length).alias("bucket")).agg(n(), F.count_if(c("severity") == "fatal").alias("fatal"))


@query("select substr(cast(accident_date as varchar), 1, 7) as bucket, count(*) as total, count(*) filter (where severity = 'fatal') as fatal from active group by 1")
def ask_trend_month(t):
    return trend(t.active, 7)


@query("select substr(cast(accident_date as varchar), 1, 4) as bucket, count(*) as total, count(*) filter (where severity = 'fatal') as fatal from active group by 1")
def ask_trend_year(t):
    return trend(t.active, 4)


@query("""
    with h as (select hour, count(*) as n from active where hour is not null group by 1), d as (select cast(extract(dow from accident_date) as int) as dow, count(*) as n from active where accident_date is not null group by 1)
    select (select count(*) from active) as matched, (select cast(sum(n) as bigint) from h) as with_time, (select cast(sum(n) as bigint) from d) as with_date,
        (select hour from h order by n desc, hour limit 1) as peak_hour, (select dow from d order by n desc, dow limit 1) as peak_dow, (select sum(n) from h) >= 10 as reliable""")
def ask_time_pattern(t):
    a = t.active
    best = lambda df, key: df.agg(F.sum("n").alias(f"with_{key}"), F.max_by(key, F.struct("n", -c(key))).alias(f"peak_{key}"))
    h = best(a.filter("hour is not null").groupBy("hour").agg(n("n")), "hour")
    d = best(a.filter("accident_date is not null").groupBy(weekday(c("accident_date")).alias("dow")).agg(n("n")), "dow")
    return a.agg(n("matched")).crossJoin(h).crossJoin(d).select("matched", c("with_hour").alias("with_time"), c("with_dow").alias("with_date"), "peak_hour", "peak_dow", (c("with_hour") >= 10).alias("reliable"))


#: Steps of a 300 m grid at the city's latitude.
D_LAT, D_LNG = "300e0 / 111000e0", "300e0 / (111000e0 * cos(radians(12.97e0)))"


@query(f"""
    with r as (select *, cast(floor(lat / ({D_LAT}) + 0.5e0) as bigint) as i, cast(floor(lng / ({D_LNG}) + 0.5e0) as bigint) as j from active),
    nm as (select i, j, location, row_number() over (partition by i, j order by count(*) desc, location) as k from r group by i, j, location),
    g as (select i, j, count(*) as total, {SEV}, {sql_half_up('avg(lat)', 5)} as lat, {sql_half_up('avg(lng)', 5)} as lng from r group by i, j)
    select location as name, lat, lng, total, fatal, serious, minor, 3 * fatal + 2 * serious + minor as severity_score from g join nm using (i, j) where k = 1
    order by severity_score desc, total desc, i, j limit 5""")
def ask_hotspots(t):
    r = t.active.withColumn("i", F.expr(f"floor(lat / ({D_LAT}) + 0.5e0)")).withColumn("j", F.expr(f"floor(lng / ({D_LNG}) + 0.5e0)"))
    by_name = r.groupBy("i", "j", "location").agg(n("m"), *severity_counts(), F.sum("lat").alias("sy"), F.sum("lng").alias("sx"))
    # of each cell: the most frequent name, of ties the first one
    names = by_name.groupBy("i", "j").agg(F.min_by("location", F.struct(-c("m"), "location")).alias("name"), F.sum("m").alias("total"), *[F.sum(s).alias(s) for s in ("fatal", "serious", "minor")], F.sum("sy").alias("sy"), F.sum("sx").alias("sx"))
    score = 3 * c("fatal") + 2 * c("serious") + c("minor")
    top = names.withColumn("severity_score", score).orderBy(c("severity_score").desc(), c("total").desc(), "i", "j").limit(5)
    return top.select("name", half_up(c("sy") / c("total"), 5).alias("lat"), half_up(c("sx") / c("total"), 5).alias("lng"), "total", "fatal", "serious", "minor", "severity_score")


@query(f"select p.place, count(*) as total, {sql_severity('a')} from (values ('Area 1'), ('Area 12'), ('Area 23')) p(place) join active a on a.area = p.place group by 1")
def ask_compare(t):
    places = t.spark.createDataFrame([("Area 1",), ("Area 12",), ("Area 23",)], "place string")
    return t.active.join(F.broadcast(places), c("area") == c("place")).groupBy("place").agg(n(), *severity_counts())


@query("select count(*) as total, count(accident_date) as with_date, count(hour) as with_time, min(accident_date) as first_date, max(accident_date) as last_date from active", dates=('first_date', 'last_date'))
def ask_coverage(t):
    return t.active.agg(n(), F.count("accident_date").alias("with_date"), F.count("hour").alias("with_time"), F.min("accident_date").alias("first_date"), F.max("accident_date").alias("last_date"))


@query("""
    with r as (select * from active where severity = 'fatal')
    select id, title, accident_date, (select count(*) from r) as matched from r order by accident_date desc nulls last, seq desc limit 5""", dates=('accident_date',))
def ask_search(t):
    r = t.active.filter("severity = 'fatal'")
    top = r.orderBy(c("accident_date").desc_nulls_last(), c("seq").desc()).limit(5)
    return top.crossJoin(r.agg(n("matched"))).select("id", "title", "accident_date", "matched")


@query("""
    with g as (select area, count(*) as total from active where area is not null group by 1)
    select area, total, total * 1e0 / max(total) over () as intensity from g""")
def heatmap_intensity(t):
    g = t.active.filter("area is not null").groupBy("area").agg(n())
    return g.select("area", "total", (c("total") * 1.0 / F.max("total").over(Window.partitionBy())).alias("intensity"))


@query("select cast(floor((lat - 12.5e0) / 0.01e0) as bigint) as i, cast(floor((lng - 77e0) / 0.01e0) as bigint) as j, cast(sum(score) as bigint) as score_sum, sum(score) / 10e0 as density from active group by 1, 2")
def score_density(t):
    cell = [F.expr("floor((lat - 12.5e0) / 0.01e0)").alias("i"), F.expr("floor((lng - 77e0) / 0.01e0)").alias("j")]
    return t.active.groupBy(*cell).agg(F.sum("score").alias("score_sum")).withColumn("density", c("score_sum") / F.lit(10.0))


@query("select max(try_cast(id as bigint)) + 1 as next_id from incidents where regexp_matches(id, '^[0-9]+$')")
def next_numeric_id(t):
    return t.incidents.filter(c("id").rlike("^[0-9]+$")).agg((F.max(F.expr("try_cast(id as bigint)")) + 1).alias("next_id"))


@query("select reporter_id, string_agg(id, ',' order by seq) as ids from active group by 1")
def ordered_collect(t):
    g = t.active.groupBy("reporter_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("x"))
    return g.select("reporter_id", F.array_join(F.transform("x", lambda s: s["id"]), ",").alias("ids"))


@query("select distinct floor(lat * 1e4 + 0.5e0) / 1e4 as lat4, floor(lng * 1e4 + 0.5e0) / 1e4 as lng4 from active")
def unique_locations(t):
    return t.active.select(half_up(c("lat"), 4).alias("lat4"), half_up(c("lng"), 4).alias("lng4")).distinct()


# --- digests of a period ---------------------------------------------------------------

LATEST = "(select max(accident_date) from active)"


def windows(active: DataFrame, days: int) -> DataFrame:
    """Dated rows with ``now``: true in (end - days, end], false in the window before it."""
    last = active.agg(F.max("accident_date").alias("end"))
    age = F.datediff("end", "accident_date")
    return active.crossJoin(F.broadcast(last)).withColumn("now", age < days).filter((age >= 0) & (age < 2 * days))


@query(f"""
    with w as (select severity, date_diff('day', accident_date, {LATEST}) < 30 as now from active where date_diff('day', accident_date, {LATEST}) between 0 and 59)
    select count(*) filter (where now) as total, count(*) filter (where not now) as previous_total, count(*) filter (where now and severity = 'fatal') as fatal,
        cast({sql_half_up('(count(*) filter (where now) - count(*) filter (where not now)) * 100e0 / nullif(count(*) filter (where not now), 0)')} as bigint) as change_pct from w""")
def digest_totals(t):
    now, before = F.count_if("now"), F.count_if(~c("now"))
    return windows(t.active, 30).agg(
        now.alias("total"), before.alias("previous_total"), F.count_if(c("now") & (c("severity") == "fatal")).alias("fatal"), half_up((now - before) * 100.0 / F.nullif(before, F.lit(0))).cast("long").alias("change_pct")
    )


@query(f"""
    with w as (select area, location from active where date_diff('day', accident_date, {LATEST}) between 0 and 29)
    select coalesce(area, location) as area, count(*) as total, {sql_half_up('count(*) * 100e0 / (select count(*) from w)')} as share_pct from w group by 1 order by total desc, area limit 3""")
def digest_top_areas(t):
    w = windows(t.active, 30).filter("now")
    g = w.groupBy(F.coalesce("area", "location").alias("area")).agg(n()).orderBy(c("total").desc(), "area").limit(3)
    return g.crossJoin(w.agg(n("all"))).select("area", "total", half_up(c("total") * 100.0 / c("all")).alias("share_pct"))


@query(f"""
    with w as (select location, date_diff('day', accident_date, {LATEST}) < 1 as now from active where date_diff('day', accident_date, {LATEST}) between 0 and 1)
    select distinct location from w where now and location not in (select location from w where not now)""")
def digest_new_areas(t):
    w = windows(t.active, 1)
    return w.filter("now").select("location").distinct().join(w.filter(~c("now")).select("location"), "location", "left_anti")


@query(f"""
    select case when hour between 7 and 10 then 'morning rush' when hour between 11 and 16 then 'daytime' when hour between 17 and 20 then 'evening rush' else 'night' end as band, count(*) as total
    from active where hour is not null and date_diff('day', accident_date, {LATEST}) between 0 and 29 group by 1""")
def digest_time_bands(t):
    from ..functions.text import time_band

    return windows(t.active, 30).filter(c("now") & c("hour").isNotNull()).groupBy(time_band(c("hour")).alias("band")).agg(n())


@query(f"""
    with a as (select 0 as k, date '2030-01-01' as anchor union all select 1, {LATEST}), l as (select unnest([7, 30, 90, 365]) as days),
    x as (select k, anchor, days, count(r.id) as n from a cross join l left join active r on r.accident_date <= anchor and date_diff('day', r.accident_date, anchor) < days group by all)
    select anchor, cast(days as int) as days, n as total from x where n >= 3 order by k, days limit 1""", dates=('anchor',))
def digest_window(t):
    """The first window, of today's and then of the latest date, with three rows or more."""
    dates = t.active.filter("accident_date is not null").groupBy("accident_date").agg(n("m"))  # a row for each day
    anchors = t.spark.sql("select 0 as k, date'2030-01-01' as anchor").unionByName(dates.agg(F.lit(1).alias("k"), F.max("accident_date").alias("anchor")))
    asked = anchors.select("k", "anchor", F.explode(F.array(*map(F.lit, (7, 30, 90, 365)))).alias("days"))
    x = dates.crossJoin(F.broadcast(asked)).filter("accident_date <= anchor and datediff(anchor, accident_date) < days").groupBy("k", "anchor", "days").agg(F.sum("m").alias("total"))
    return x.filter("total >= 3").orderBy("k", "days").limit(1).select("anchor", "days", "total")
