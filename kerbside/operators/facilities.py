"""Hospitals from their sources: classification, names, identity and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up
from ..functions.text import first_match, hour_of, severity_of_score
from ..plans.dialect import first_match as sql_first
from ..plans.registry import query
from ..sources.chatter import json_in

c = F.col
#: Kinds of facilities by name; the first that is found counts.
FACILITY = (
    ("veterinary", r"\bveterinar|\bvets?\b|\bpets?\b|\banimal|\bcattle"),
    ("dental", r"dental|dentist|\bteeth\b|\btooth|orthodont|\bsmiles?\b|endodont|\bimplant"),
    ("eye", r"\beyes?\b|netra|nethra|ophthalm|\bvision\b|lasik|retina|nayana|cataract|\boptic"),
    ("ayush", r"ayur|homoe?opath|homeo|unani|siddha|naturopath|\byoga\b|panchakarma|herbal|ayush|wellness"),
    ("diagnostic", r"diagnostic|\bscans?\b|laborator|\blabs?\b|patholog|imaging|x-?ray|blood bank|\bmri\b"),
    ("skin", r"\bskin\b|dermat|cosmetic|\bhair\b|aesthetic|slimming|\blaser\b|tricholog"),
    ("maternity", r"\bivf\b|fertility|maternity|\bmatern|\bwomen'?s\b|\bmother|gyna?ec|obstetric|cloud ?nine|motherhood|cradle|\bbirth|femme"),
    ("cancer", r"cancer|oncolog|\bonco\b|kidwai"),
    ("mental_health", r"psychiatr|mental health|de-?addiction|counsel|\bnasha\b|nimhans"),
    ("rehab", r"physio|rehab|palliative|hospice|old age|geriatric care|dialysis"),
    ("specialty", r"tubercul|\btb\b|leprosy|infectious disease|epidemic|chest disease|isolation"),
    ("pediatric", r"\bchild|children|p(a)?ediatric|\bkids?\b|neonat|\bbaby\b|rainbow"),
    ("hospital", r"hospital|medical college|institute of medical|health city|multi-?special|super-?special|nursing home|infirmary|\bchc\b|community health|taluk"),
    ("clinic", r"clinic|polyclinic|dispensary|health cent(er|re)|\bu?phc\b|primary health|family (doctor|physician)|\bdr\.?\s|doctor|\bmedicals?\b|pharmacy|chemist|surgery cent"),
)
#: Kinds that never take an accident's victims.
NO_EMERGENCY = ("veterinary", "dental", "eye", "ayush", "diagnostic", "skin", "maternity", "cancer", "mental_health", "rehab", "specialty", "clinic")
SUB_UNIT = r"\bopd\b|out-?patient|screening|physiother|rehabilit|psychiatr|department|\bdept\b|pharmacy|blood bank|hostel|quarters|\badmin|nursing college|college of nursing|mortuary"
EMERGENCY_UNIT = "emergency|casualty|trauma"
EMERGENCY_NAME = r"multi-?special|super-?special|general hospital|government hospital|govt\.? hospital|district hospital|taluk|\bchc\b|community health|medical college|institute of medical sciences|trauma|emergency|casualty|24\s*[x×*]\s*7|24 ?hrs?\b|accident"
#: Hospitals known for a trauma centre, and for a casualty department, by name.
CURATED_TRAUMA = (
    "victoria hospital", "sanjay gandhi", "nimhans|national institute of mental health", "bowring", r"\bst\.? ?john'?s", "ramaiah", "manipal hospital|manipal (north ?side|whitefield)",
    "narayana (health|hrudayalaya|multi|institute)|mazumdar shaw", r"\bfortis\b", "apollo (hospital|speciality|multi)", r"\baster (cmi|rv|whitefield|hospital)", r"\bsakra\b", "gleneagles|bgs global", "^sparsh hospital",
    "columbia asia", "vydehi", "kempegowda institute", r"\bk\.? ?c\.? general", "jayanagar general",
)
CURATED_EMERGENCY = (
    r"st\.? ?philomena", "baptist hospital", "^mallya hospital", "hosmat", "bhagwan mahaveer jain", r"\besi (model )?hospital|\besic\b", "sagar hospital", "rajarajeswari medical", "sapthagiri (institute|hospital|medical)",
    r"\bmvj\b", "vikram hospital", "chinmaya mission hospital", "brookefield hospital",
)
#: Kinds that a curated name doesn't override.
NOT_CURATED = ("veterinary", "dental", "eye", "ayush", "diagnostic", "skin", "maternity", "clinic")
CURATED = (("trauma", "|".join(CURATED_TRAUMA)), ("emergency", "|".join(CURATED_EMERGENCY)))
#: Zones by the names of their places; the first that is found counts.
ZONES = (
    ("East", "east|whitefield|kr puram|indiranagar|marathahalli|varthur|kadubeesanahalli|hopefarm|kadugodi|sarjapur|domlur|carmelaram|mahadevapura|bellandur|hsr|koramangala"),
    ("North", "north|hebbal|yelahanka|jakkur|kodigehalli|bellary|tumkur|peenya|mathikere|rt nagar|yeshwanthpur|nagavara|manyata|kamanahalli|banaswadi"),
    ("South", "south|jayanagar|jp nagar|bannerghatta|arekere|banashankari|btm|silk|hosur|electronic|nice|kengeri|mysore"),
    ("West", "west|rajajinagar|vijayanagar|magadi|jalahalli"),
    ("Central", "central|mg road|majestic|shivaji|richmond|cantonment|ulsoor|cbd"),
    ("Highway / ORR", "nh|highway|outer ring|orr|nh-44"),
)


@query(f"select n_nationkey as id, case when n_name = '' then 'Central' else {sql_first('n_name', ZONES, 'Other')} end as zone from nation")
def infer_zone(t):
    return t.nation.select(c("n_nationkey").alias("id"), F.when(c("n_name") == "", "Central").otherwise(first_match(c("n_name"), ZONES, "Other")).alias("zone"))


@query(f"select id, {sql_first('name', FACILITY, 'hospital')} as facility_type from facilities")
def classify_facility(t):
    return t.facilities.select("id", first_match(c("name"), FACILITY, "hospital").alias("facility_type"))


NONE = ", ".join(f"'{x}'" for x in NO_EMERGENCY)


NO_CURE = ", ".join(f"'{x}'" for x in NOT_CURATED)


@query(f"""
    with k as (select *, {sql_first('name', FACILITY, 'hospital')} as kind, regexp_matches(name, '(?i){SUB_UNIT}') and not regexp_matches(name, '(?i){EMERGENCY_UNIT}') as part from named_facilities),
    f as (select *, case when kind not in ({NO_CURE}) and not part then {sql_first('name', CURATED)} end as curated from k),
    g as (select *, case when curated is not null and kind <> 'pediatric' then 'hospital' else kind end as facility_type from f)
    select id, facility_type, case when part then 'none' when curated is not null then curated when emergency_tag = 'no' then 'none' when facility_type in ({NONE}) then 'none' when emergency_tag = 'yes' then 'emergency'
        when regexp_matches(name, '(?i){EMERGENCY_NAME}') or beds >= 50 then 'emergency' else 'general' end as level,
        case when part then 'name-rule' when curated is not null then 'curated' when emergency_tag = 'no' then 'osm' when facility_type in ({NONE}) then 'name-rule' when emergency_tag = 'yes' then 'osm' else 'name-rule' end as level_source from g""")
def classify_hospital(t):
    return hospital_levels(t.named_facilities).select("id", "facility_type", "level", "level_source")


def hospital_levels(rows: DataFrame) -> DataFrame:
    """``rows`` (name, emergency_tag, beds) with facility_type, level and where the level comes from: a
    part of a campus, a curated name, the map's tag, the kind, the name, the beds."""
    kind, tag, name = c("facility_type"), F.coalesce("emergency_tag", F.lit("")), F.coalesce("name", F.lit(""))
    part = name.rlike("(?i)" + SUB_UNIT) & ~name.rlike("(?i)" + EMERGENCY_UNIT)
    f = rows.withColumn("facility_type", first_match(name, FACILITY, "hospital")).withColumn("part", part)
    f = f.withColumn("curated", F.when(~kind.isin(*NOT_CURATED) & ~c("part"), first_match(name, CURATED)))
    f = f.withColumn("facility_type", F.when(c("curated").isNotNull() & (kind != "pediatric"), "hospital").otherwise(kind))
    none, curated = kind.isin(*NO_EMERGENCY), c("curated")
    level = F.when(c("part"), "none").when(curated.isNotNull(), curated).when((tag == "no") | none, "none").when(tag == "yes", "emergency").when(name.rlike("(?i)" + EMERGENCY_NAME) | (c("beds") >= 50), "emergency").otherwise("general")
    origin = F.when(c("part"), "name-rule").when(curated.isNotNull(), "curated").when(tag == "no", "osm").when(none, "name-rule").when(tag == "yes", "osm").otherwise("name-rule")
    return f.withColumn("level", level).withColumn("level_source", origin).drop("part", "curated")


def folded_name(name: Column) -> Column:
    x = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(x, r"\b(the|pvt|private|ltd|limited|sri|shri|sree)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"hospitals\b", "hospital"), "[^a-z0-9]+", " "))


FOLDED = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower('The ' || name || ' Pvt Ltd & Hospitals'), '&', ' and '), '\b(the|pvt|private|ltd|limited|sri|shri|sree)\b', ' ', 'g'), 'hospitals\b', 'hospital', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"select id, {FOLDED} as folded from facilities")
def normalise_name(t):
    return t.facilities.select("id", folded_name(F.concat(F.lit("The "), "name", F.lit(" Pvt Ltd & Hospitals"))).alias("folded"))


def fixed5(x: Column) -> Column:
    """Five decimals as text, without locale."""
    whole = F.round(x * 100000).cast("long")
    return F.concat(F.floor(whole / 100000).cast("string"), F.lit("."), F.lpad((whole % 100000).cast("string"), 5, "0"))


SQL5 = "cast(cast(floor(round({0} * 100000) / 100000) as bigint) as varchar) || '.' || lpad(cast(cast(round({0} * 100000) as bigint) % 100000 as varchar), 5, '0')"


@query(f"select id, case when id % 2 = 0 then 'osm_n' || cast(id as varchar) else 'hosp_' || substr(sha1({FOLDED.replace("'The ' || name || ' Pvt Ltd & Hospitals'", 'name')} || '|' || {SQL5.format('lat')} || '|' || {SQL5.format('lng')}), 1, 16) end as stable_id from facilities")
def stable_id(t):
    key = F.concat_ws("|", folded_name(c("name")), fixed5(c("lat")), fixed5(c("lng")))
    return t.facilities.select("id", F.when(c("id") % 2 == 0, F.concat(F.lit("osm_n"), c("id").cast("string"))).otherwise(F.concat(F.lit("hosp_"), F.substring(F.sha1(key.cast("binary")), 1, 16))).alias("stable_id"))


@query("""
    select id, nullif(trim(regexp_extract(phone, '^[^;,/]*', 0)), '') as phone, case when try_cast(regexp_replace(beds_raw, '[^0-9]', '', 'g') as int) between 1 and 9999 then try_cast(regexp_replace(beds_raw, '[^0-9]', '', 'g') as int) end as beds,
        case when phone is not null then 2 else 0 end + case when beds > 0 then 1 else 0 end + case when emergency_tag is not null then 1 else 0 end as completeness from facilities""")
def clean_contact(t):
    phone = F.nullif(F.trim(F.regexp_extract("phone", "^[^;,/]*", 0)), F.lit(""))
    beds = F.expr("try_cast(regexp_replace(beds_raw, '[^0-9]', '') as int)")
    full = F.when(c("phone").isNotNull(), 2).otherwise(0) + F.when(c("beds") > 0, 1).otherwise(0) + F.when(c("emergency_tag").isNotNull(), 1).otherwise(0)
    return t.facilities.select("id", phone.alias("phone"), F.when(beds.between(1, 9999), beds).alias("beds"), full.alias("completeness"))


@query("select id, case when score >= 6 then 'fatal' when score >= 3 then 'serious' else 'minor' end as severity, case severity when 'fatal' then 10 when 'serious' then 5 else 1 end as score_back from incidents")
def severity_map(t):
    back = F.when(c("severity") == "fatal", 10).when(c("severity") == "serious", 5).otherwise(1)
    return t.incidents.select("id", severity_of_score(c("score")).alias("severity"), back.alias("score_back"))


HOUR = r"cast(nullif(regexp_extract(date_raw, '(^|[T\s])([01]?[0-9]|2[0-3]):[0-5][0-9]', 2), '') as int)"


@query(f"select id, {HOUR} as hour from incidents")
def parse_hour(t):
    return t.incidents.select("id", hour_of(c("date_raw")).alias("hour"))


@query("select id, regexp_extract(date_raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}', 0) as day, substr(date_raw, 1, 7) as month, try_cast(regexp_extract(date_raw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}', 0) as date) is not null as valid from incidents")
def parse_date(t):
    day = F.regexp_extract("date_raw", "^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    return t.incidents.select("id", day.alias("day"), F.substring("date_raw", 1, 7).alias("month"), F.try_to_date(day).isNotNull().alias("valid"))


@query("select id, case when hour between 7 and 10 then 'morning rush' when hour between 11 and 16 then 'daytime' when hour between 17 and 20 then 'evening rush' when hour is not null then 'night' end as band, cast(extract(dow from accident_date) as int) as dow from incidents")
def time_bands(t):
    from ..functions.text import time_band, weekday

    return t.incidents.select("id", time_band(c("hour")).alias("band"), weekday(c("accident_date")).alias("dow"))


@query("select id, cast(extract(hour from created_at + interval '330' minute) as int) as hour, cast(cast(created_at + interval '330' minute as date) as varchar) as day from alerts")
def ist_hour(t):
    from ..functions.text import local_hour

    return t.alerts.select("id", local_hour(c("created_at")).alias("hour"), F.to_date(c("created_at") + F.expr("interval '330' minute")).cast("string").alias("day"))


@query("select id, try_cast(split_part(pos, ',', 1) as double) as lat, try_cast(split_part(pos, ',', 2) as double) as lng from (select id, case when id % 3 = 0 then 'nowhere' else '12.' || cast(900 + id % 90 as varchar) || ', 77.' || cast(500 + id % 90 as varchar) end as pos from facilities) where regexp_matches(pos, '^\\s*-?[0-9.]+\\s*,\\s*-?[0-9.]+\\s*$')")
def parse_latlng(t):
    pos = F.when(c("id") % 3 == 0, "nowhere").otherwise(F.concat(F.lit("12."), (c("id") % 90 + 900).cast("string"), F.lit(", 77."), (c("id") % 90 + 500).cast("string")))
    shape = r"^\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*$"
    part = lambda k: F.regexp_extract("pos", shape, k).cast("double")
    return t.facilities.select("id", pos.alias("pos")).filter(c("pos").rlike(shape)).select("id", part(1).alias("lat"), part(2).alias("lng"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_props(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""
    select id, case event_id_kind when 4 then null when 3 then replace(props, '}', ', "note": "a } in text, and {"}') else props end as found, case when event_id_kind <> 4 then json_extract_string(props, '$.k') end as k
    from (select id, id % 6 as event_id_kind, props from replies)""")
def json_in_replies(t):
    """The first whole JSON object of each reply, whatever stands around it."""
    rows = t.replies.select("id", json_in(c("text")).alias("found"))
    return rows.select("id", "found", F.get_json_object("found", "$.k").alias("k"))
