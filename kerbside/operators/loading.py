"""Scans, source formats and sinks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import in_box
from ..functions.text import severity_of_score
from ..plans.registry import query
from ..sources import incidents as source
from ..sources.choices import first_source
from ..sources.incidents import JSON_SCHEMA, csv_field, ewkb_point, geojson_feature, normalised_json, wkt_point

c = F.col


@query("select id, seq, title, area, zone, severity, score, status, lat, lng from incidents")
def scan_incidents(t):
    return t.incidents.select("id", "seq", "title", "area", "zone", "severity", "score", "status", "lat", "lng")


@query("select id, title, area, severity, coalesce(case when seq % 20 <> 0 then status end, 'active') as status, case when seq % 5 <> 0 then lat end as lat, case when seq % 5 <> 0 then lng end as lng from incidents")
def scan_json_normalise(t):
    """Rows that went through JSON text and its schema."""
    fields = F.struct("id", "title", "area", "severity", F.when(c("seq") % 20 != 0, c("status")).alias("status"), (c("seq") % 5 != 0).alias("hasCoords"), "lat", "lng")
    parsed = t.incidents.select(F.from_json(F.to_json(fields), JSON_SCHEMA).alias("r")).select("r.*")
    return normalised_json(parsed)


@query("""
    select id, trim(title) as title, coalesce(severity, 'minor') as severity, greatest(1, least(10, score)) as score, coalesce(zone, 'Central') as zone, cast(accident_date as varchar) as date, hour,
        cast(extract(dow from accident_date) as int) as dow, lat, lng, coalesce(status, 'active') as status, source = 'User' as is_user, cast(reporter_id as varchar) as reporter from incidents""")
def normalise_incidents(t):
    from ..functions.text import weekday

    return t.incidents.select(
        "id", F.trim("title").alias("title"), F.coalesce("severity", F.lit("minor")).alias("severity"), F.greatest(F.lit(1), F.least(F.lit(10), "score")).alias("score"), F.coalesce("zone", F.lit("Central")).alias("zone"), c("accident_date").cast("string").alias("date"),
        "hour", weekday(c("accident_date")).alias("dow"), "lat", "lng", F.coalesce("status", F.lit("active")).alias("status"), (c("source") == "User").alias("is_user"), c("reporter_id").cast("string").alias("reporter"),
    )


@query("select id, severity, lat, lng from active")
def active_incidents(t):
    return t.active.select("id", "severity", "lat", "lng")


@query("select id, title, status from incidents where id = '77'")
def lookup_by_id(t):
    return t.incidents.filter("id = '77'").select("id", "title", "status")


@query("select alert_id, string_agg(cast(hospital_id as varchar), ',' order by hospital_id) as hospitals from alert_targets where alert_id in (1, 7, 32, 39, 68, 103) group by 1")
def lookup_in_list(t):
    g = t.alert_targets.filter(c("alert_id").isin(1, 7, 32, 39, 68, 103)).groupBy("alert_id").agg(F.sort_array(F.collect_list("hospital_id")).alias("h"))
    return g.select("alert_id", F.array_join(c("h").cast("array<string>"), ",").alias("hospitals"))


@query("select id, case when score >= 6 then 'fatal' when score >= 3 then 'serious' else 'minor' end as severity, greatest(1, least(10, score)) as score, lat, lng from incidents where lat between 12.85e0 and 13.05e0 and lng between 77.45e0 and 77.65e0")
def seed_accidents(t):
    rows = t.incidents.filter(in_box(c("lat"), c("lng"), 12.85, 77.45, 13.05, 77.65))
    return rows.select("id", severity_of_score(c("score")).alias("severity"), F.greatest(F.lit(1), F.least(F.lit(10), "score")).alias("score"), "lat", "lng")


@query("select s_suppkey as id, case when s_suppkey % 2 = 0 then 12.25e0 else 13.5e0 end as lat, cast(s_suppkey % 250 as double) + 0.5e0 as lng from supplier")
def seed_row_normalise(t):
    """Positions of seed rows, old ones as text and new ones as numbers."""
    old = F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("SRID=4326;POINT("), (c("s_suppkey") % 250).cast("string"), F.lit(".5 12.25)")))
    lat, lng = wkt_point(old)
    return t.supplier.select(c("s_suppkey").alias("id"), F.coalesce(lat, F.lit(13.5)).alias("lat"), F.coalesce(lng, (c("s_suppkey") % 250).cast("double") + 0.5).alias("lng"))


@query("select event_id as id, cast(event_id % 90 as double) + 0.25e0 as lat, cast(event_id % 170 as double) + 0.75e0 as lng from events")
def parse_wkt_point(t):
    wkt = F.concat(F.lit("point ("), (c("event_id") % 170).cast("string"), F.lit(".75 "), (c("event_id") % 90).cast("string"), F.lit(".25)"))
    lat, lng = wkt_point(wkt)
    return t.events.select(c("event_id").alias("id"), lat.alias("lat"), lng.alias("lng"))


@query()
def parse_ewkb_point(t):
    """Points in hex EWKB; the text is made of two known positions."""
    known = F.when(c("event_id") % 2 == 0, "0101000020E6100000AE47E17A1466534052B81E85EBF12940").otherwise("00000000014053666666666666402A000000000000")
    return t.events.select(c("event_id").alias("id"), ewkb_point(known).alias("p")).select("id", "p.lat", "p.lng")


@query()
def osm_normalise(t):
    """Elements of a map extract as hospital rows; those without name or position go."""
    element = F.to_json(F.struct(F.lit("node").alias("type"), c("id"), c("lat"), F.when(c("id") % 9 != 0, c("lng")).alias("lon"), F.struct(c("name"), c("emergency_tag").alias("emergency"), c("beds_raw").alias("beds"), c("phone")).alias("tags")))
    shape = "type string, id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
    e = t.facilities.select(F.from_json(element, shape).alias("e"))
    tag = lambda k: F.try_element_at(c("e.tags"), F.lit(k))
    rows = e.select(
        F.concat(F.lit("osm_"), F.substring("e.type", 1, 1), c("e.id").cast("string")).alias("id"), F.trim(F.coalesce(tag("name"), tag("name:en"))).alias("name"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lng"),
        F.expr("try_cast(regexp_replace(e.tags['beds'], '[^0-9]', '') as int)").alias("beds"), F.trim(F.regexp_extract(tag("phone"), "^[^;,/]*", 0)).alias("phone"), tag("emergency").alias("emergency_tag"),
    )
    return rows.filter("name != '' and lat is not null and lng is not null")


@query("""
    select id, 'Feature' as type, 'Point' as kind, severity, area from active""")
def geojson_features(t):
    """Features as JSON text, read back into columns."""
    f = t.active.select("id", geojson_feature("severity", "area").alias("f"))
    get = lambda path: F.get_json_object("f", path)
    return f.select("id", get("$.type").alias("type"), get("$.geometry.type").alias("kind"), get("$.properties.severity").alias("severity"), get("$.properties.area").alias("area"))


@query("""
    select id || ',' || '"' || replace(replace(title, 'near', 'near, "at"'), '"', '""') || '",' || coalesce(area, '') || ',' || coalesce(zone, '') || ',' || severity || ',' || cast(score as varchar) || ',' || coalesce(cast(accident_date as varchar), '') || ',' || source as line from active""")
def csv_export_rows(t):
    title = F.replace("title", F.lit("near"), F.lit('near, "at"'))
    return t.active.select(F.concat_ws(",", *[csv_field(x) for x in (c("id"), title, c("area"), c("zone"), c("severity"), c("score"), c("accident_date"), c("source"))]).alias("line"))


STRIP = "coalesce(html, '')"
for _tag in ("script", "style", "iframe"):
    STRIP = rf"regexp_replace({STRIP}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', '', 'g')"
STRIP = f"regexp_replace(regexp_replace({STRIP}, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', ' ', 'g')"
for _entity, _char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''")):
    STRIP = f"regexp_replace({STRIP}, '(?i)&{_entity};', '{_char}', 'g')"
STRIP = rf"substr(trim(regexp_replace({STRIP}, '\s+', ' ', 'g')), 1, 15000)"


@query(f"select page_id, {STRIP} as text from pages")
def strip_html(t):
    return t.pages.select("page_id", source.strip_html(c("html")).alias("text"))


@query(f"select page_id from pages where length({STRIP}) >= 50")
def strip_html_min_len(t):
    return t.pages.filter(F.length(source.strip_html(c("html"))) >= 50).select("page_id")


@query("select id, unnest(range(1, case severity when 'fatal' then 4 when 'serious' then 3 else 2 end)) as copy_no from active")
def weighted_replicate(t):
    """Rows as often as their severity weighs, for drills."""
    from ..functions.text import weight

    return t.active.select("id", F.explode(F.sequence(F.lit(1).cast("long"), weight(c("severity")).cast("long"))).alias("copy_no"))


def live_hospitals(spark, path):
    """Elements of a map extract, a JSON object a line."""
    rows = spark.read.schema("id long, lat double, lon double, tags map<string,string>").json(path)
    return rows.select("id", c("tags")["name"].alias("name"), "lat", c("lon").alias("lng"))


def seed_hospitals(spark, path):
    rows = spark.read.parquet(path)
    return rows.select(c("s_suppkey").alias("id"), F.concat(F.lit("Hospital "), "s_name").alias("name"), (F.lit(12.85) + (c("s_suppkey") * 13 % 250) * 0.001).alias("lat"), (F.lit(77.45) + (c("s_suppkey") * 29 % 250) * 0.001).alias("lng"))


@query("select id, name, lat, lng, 'seed' as source_label from hospitals")
def source_fallback(t):
    """Hospitals of the live extract, else of its kept copy, else of the seed table. The given folders hold
    the seed alone."""
    extracts = [(label, f"{t.sf_dir}/{label}-extract.json", live_hospitals) for label in ("live", "cached")]
    return first_source(t.spark, [*extracts, ("seed", f"{t.sf_dir}/supplier.parquet", seed_hospitals)])
