"""The road-safety relations, bound to the tables that the driver gives.

Each binding is one SELECT in the common dialect of Spark SQL and DuckDB, so that queries and
their oracles start from the same rows. Braces name raw tables or other bindings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

BINDINGS = {
    "incidents": """
        select cast(event_id as string) as id, event_id as seq,
            'Incident ' || event_type || ' near Area ' || cast(user_id % 25 as string) as title,
            event_type || ' reported, factor ' || regexp_extract(props, '[0-9]+', 0) as description,
            'Road ' || cast(user_id % 40 as string) as location,
            case when user_id % 25 = 24 then null else 'Area ' || cast(user_id % 25 as string) end as area,
            case user_id % 25 % 6 when 0 then 'North' when 1 then 'South' when 2 then 'East' when 3 then 'West' when 4 then 'Central' end as zone,
            case event_type when 'error' then 'fatal' when 'purchase' then 'serious' else 'minor' end as severity,
            case event_type when 'error' then 10 when 'purchase' then 5 else 1 end as score,
            case when event_id % 20 = 0 then 'pending' when event_id % 33 = 0 then 'hidden' else 'active' end as status,
            case when event_id % 10 = 0 then null else cast(cast(ts as date) + cast(30 * (user_id % 12) as int) as date) end as accident_date,
            case when event_id % 3 = 0 then substr(cast(ts as string), 1, 10) else substr(cast(ts as string), 1, 16) end as date_raw,
            case when event_id % 3 = 0 then null else cast(extract(hour from ts) as int) end as hour,
            case when event_id % 97 = 0 then null else 12.85e0 + (user_id % 25) * 0.01e0 + (event_id % 7) * 0.0005e0 end as lat,
            case when event_id % 97 = 0 then null else 77.45e0 + (user_id * 7 % 25) * 0.01e0 + (event_id % 11) * 0.0005e0 end as lng,
            case when event_id % 4 = 0 then 'User' else 'News' end as source,
            case when event_id % 4 = 0 then null else 'http://news.example.com/' || cast(event_id as string) end as link,
            user_id as reporter_id, cast(regexp_extract(props, '[0-9]+', 0) as int) as factor, ts as created_at
        from {events}""",
    "active": "select * from {incidents} where status = 'active' and lat is not null and lng is not null",
    "hospitals": """
        select s_suppkey as id, 'Hospital ' || s_name as name, 'Street ' || cast(s_nationkey as string) as address,
            case when s_suppkey % 3 = 0 then null else '080-' || cast(100000 + s_suppkey as string) end as phone,
            case s_nationkey % 5 when 0 then 'trauma' when 3 then 'general' when 4 then 'none' else 'emergency' end as emergency_level,
            case s_suppkey % 7 when 0 then 'diverting' when 1 then 'busy' when 2 then 'accepting' end as er_status,
            cast(s_suppkey * 7 % 120 as int) as beds, s_suppkey % 6 = 0 as verified,
            case when s_suppkey % 4 = 0 then 'manual' else 'osm' end as source,
            12.85e0 + (13 * s_suppkey % 250) * 0.001e0 as lat, 77.45e0 + (29 * s_suppkey % 250) * 0.001e0 as lng
        from {supplier}""",
    "accounts": """
        select c_custkey as user_id, c_custkey * 3 as hospital_id, c_name || '@example.com' as email
        from {customer} where c_custkey % 5 = 0""",
    "alerts": """
        select o_orderkey as id, o_custkey as reporter_id,
            case substr(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'critical' when '3' then 'urgent' else 'standard' end as priority,
            case o_orderstatus when 'F' then 'closed' when 'P' then 'cancelled' else 'new' end as status,
            o_orderdate + interval '1' minute * (37 * o_orderkey % 1440) as created_at,
            case when o_orderstatus = 'F' then 1 + o_orderkey % 9 end as accept_min,
            case when o_orderstatus = 'F' then 5 + o_orderkey % 31 end as scene_min,
            case when o_orderstatus = 'F' and o_orderkey % 5 <> 0 then 20 + o_orderkey % 71 end as close_min,
            o_orderstatus = 'O' and o_orderkey % 4 = 0 as exhausted,
            cast(1 + o_custkey % 3 as int) as escalation_round, cast(1 + o_orderkey % 3 as int) as report_count, o_orderkey % 10 = 0 as is_drill,
            case o_custkey % 5 when 0 then 'North' when 1 then 'South' when 2 then 'East' when 3 then 'West' else 'Central' end as zone,
            case when o_orderstatus = 'F' then o_custkey % (select count(*) from {supplier}) end as accepted_hospital_id,
            12.85e0 + (o_orderkey * 17 % 200) * 0.001e0 as lat, 77.45e0 + (o_custkey * 23 % 200) * 0.001e0 as lng,
            case o_orderkey % 5 when 0 then '0' when 1 then '1' when 2 then '2' when 3 then '3+' else 'unknown' end as injured,
            case o_orderkey % 7 when 0 then 'no' when 1 then 'unknown' else 'yes' end as conscious,
            case when o_orderkey % 11 = 0 then 'no' else 'yes' end as breathing,
            case when o_orderkey % 6 = 0 then 'yes' else 'no' end as bleeding,
            case when o_orderkey % 13 = 0 then 'yes' else 'unknown' end as trapped,
            case when o_orderkey % 29 = 0 then 'yes' else 'no' end as fire,
            case o_custkey % 4 when 0 then 'fatal' when 1 then 'serious' when 2 then 'minor' end as reported_severity
        from {orders}""",
    "sos": """
        select event_id as id, user_id % 25 as place, timestamp '2024-01-01 00:00:00' + interval '1' second * (event_id * 13 + event_id * 7 % 11) as created_at,
            12.85e0 + (user_id % 25) * 0.01e0 + (event_id % 7) * 0.0005e0 as lat, 77.45e0 + (user_id * 7 % 25) * 0.01e0 + (event_id % 11) * 0.0005e0 as lng, event_id % 9 = 0 as is_drill,
            case event_id % 8 when 0 then '0' when 1 then '1' when 2 then '2' when 3 then '3+' else 'unknown' end as injured, case event_id % 17 when 0 then 'no' when 1 then 'yes' when 2 then 'yes' else 'unknown' end as conscious,
            case event_id % 19 when 0 then 'no' when 3 then 'yes' else 'unknown' end as breathing, case event_id % 21 when 0 then 'yes' when 5 then 'no' else 'unknown' end as bleeding, case when event_id % 23 = 0 then 'yes' else 'unknown' end as trapped,
            case event_id % 29 when 0 then 'yes' when 1 then 'no' else 'unknown' end as fire, case event_type when 'error' then 'fatal' when 'purchase' then 'serious' when 'view' then 'minor' end as reported_severity,
            case event_id % 5 when 0 then 'car,auto' when 1 then 'two_wheeler' when 2 then 'bus_truck,pedestrian' when 3 then 'cycle,tank,other' else '' end as vehicles, event_id % 6 = 0 as called_108,
            case when event_id % 3 = 0 then null else event_type || ' at factor ' || regexp_extract(props, '[0-9]+', 0) end as note
        from {events}""",
    "positions": """
        select l_orderkey as alert_id, l_returnflag || cast(l_linenumber as string) as kind,
            timestamp '2024-01-01 00:00:00' + interval '1' second * (l_orderkey % 86400) + interval '1' millisecond * (l_linenumber * (40 + l_orderkey % 5 * 45)) as at_ts
        from {lineitem}""",
    "replies": """
        select event_id as id, case event_id % 6 when 0 then 'Sure: ```json' || chr(10) || props || chr(10) || '```' when 1 then props when 2 then 'A stray ' || chr(123) || ' brace, then ' || props || ' and ' || chr(125) || ' more'
            when 3 then 'It said "hi": ' || replace(props, chr(125), ', "note": "a ' || chr(125) || ' in text, and ' || chr(123) || '"' || chr(125)) || ' "end' when 4 then 'nothing here ' || chr(123) || ' but "' || event_type || '"' else 'first ' || props || ' second' end as text, props
        from {events}""",
    "photos": """
        select event_id as id, user_id, case event_id % 7 when 0 then 'Canon' when 1 then 'Apple' end as make, case event_id % 5 when 0 then 'EOS' end as model, case user_id % 11 when 0 then 'Adobe Photoshop 24' when 1 then 'GIMP 2.10' when 2 then 'Stable Diffusion web UI' else event_type end as software,
            case user_id % 13 when 0 then 'trainedAlgorithmicMedia' when 1 then 'made with Midjourney' else '' end as description, case when event_id % 4 = 0 then 'png' else 'jpeg' end as format, event_id % 3 = 0 as has_exif,
            cast(case event_id % 6 when 0 then 1080 when 1 then 1440 else 200 + event_id % 900 end as int) as width, cast(150 + event_id % 700 as int) as height,
            case when event_id % 5 <> 1 then cast(cast(ts as date) + cast(event_id % 6 as int) as date) end as taken_on, cast(ts as date) as reported_on,
            case when event_id % 3 = 0 then 12.9e0 + (event_id % 90) * 0.001e0 end as photo_lat, case when event_id % 3 = 0 then 77.5e0 + (event_id % 70) * 0.001e0 end as photo_lng, 12.9e0 + (user_id % 90) * 0.001e0 as lat, 77.5e0 + (user_id % 70) * 0.001e0 as lng
        from {events}""",
    "campuses": """
        select c_custkey as id, 'Sri ' || c_mktsegment || case cast(floor(c_custkey / 3e0) as bigint) % 4 when 0 then ' Hospitals' when 1 then ' Hospital Pvt Ltd' when 2 then ' Health City' else ' Clinic' end as name,
            case when c_custkey % 3 = 0 then '080-' || cast(c_custkey as string) end as phone, case when c_custkey % 4 = 1 then 'Street ' || cast(c_custkey as string) end as address, case c_custkey % 5 when 0 then 'way' when 1 then 'relation' else 'node' end as osm_type,
            case when c_custkey % 7 = 0 then 10 + c_custkey % 90 end as beds, case c_custkey % 6 when 0 then 'private' when 1 then 'government' end as operator_type, case c_custkey % 9 when 0 then 'yes' when 1 then 'no' end as emergency_tag,
            case c_custkey % 4 when 0 then 'trauma' when 1 then 'general' when 2 then 'none' else 'emergency' end as emergency_level, case c_custkey % 4 when 0 then 'curated' when 1 then 'osm' else 'name-rule' end as level_source,
            12.85e0 + (c_custkey * 37 % 97) * 0.0009e0 as lat, 77.45e0 + (c_custkey * 53 % 89) * 0.0009e0 as lng
        from {customer}""",
    "alert_targets": """
        select l_orderkey as alert_id, l_suppkey as hospital_id, cast(1 + floor((min(l_linenumber) - 1) / 3e0) as int) as round_no, min(l_quantity) as eta_min,
            case when max(case when l_returnflag = 'A' then 1 else 0 end) = 1 then 'accepted' when max(case when l_returnflag = 'R' then 1 else 0 end) = 1 then 'declined' else 'missed' end as response
        from {lineitem} group by l_orderkey, l_suppkey""",
    "alert_events": """
        select o_orderkey as alert_id, s.stage as stage, s.kind as kind,
            o_orderdate + interval '1' minute * (37 * o_orderkey % 1440 + s.mins) as at_ts
        from {orders} cross join (values (1, 'created', 0), (2, 'accepted', 1), (3, 'dispatched', 3), (4, 'on_scene', 6), (5, 'closed', 15)) as s(stage, kind, mins)
        where s.stage <= 1 + o_orderkey % 5""",
    "routes": """
        select p_partkey as id, cast(floor(p_partkey / 4e0) as bigint) as trip, cast(p_partkey % 4 as int) as alt,
            12.85e0 + (cast(floor(p_partkey / 4e0) as bigint) * 3 % 25) * 0.01e0 as lat1, 77.45e0 + (cast(floor(p_partkey / 4e0) as bigint) * 7 % 25) * 0.01e0 as lng1,
            12.85e0 + (cast(floor(p_partkey / 4e0) as bigint) * 5 % 25) * 0.01e0 + 0.03e0 as lat2, 77.45e0 + (cast(floor(p_partkey / 4e0) as bigint) * 11 % 25) * 0.01e0 + 0.03e0 as lng2
        from {part}""",
    "drives": """
        select p_partkey as trip, cast(a.alt as int) as alt, cast(s.seq as int) as seq,
            12.85e0 + (p_partkey * 3 % 25) * 0.01e0 + s.part * ((p_partkey * 5 % 25 - p_partkey * 3 % 25) * 0.01e0 + 0.03e0) + case when s.seq = 1 then case a.alt when 0 then 0e0 when 1 then case when p_partkey % 4 = 1 then 0.0001e0 else 0.006e0 end else -0.009e0 end else 0e0 end as lat,
            77.45e0 + (p_partkey * 7 % 25) * 0.01e0 + s.part * ((p_partkey * 11 % 25 - p_partkey * 7 % 25) * 0.01e0 + 0.03e0) - case when s.seq = 1 then case a.alt when 0 then 0e0 when 1 then case when p_partkey % 4 = 1 then 0.0001e0 else 0.004e0 end else -0.007e0 end else 0e0 end as lng
        from {part} cross join (values (0), (1), (2)) as a(alt) cross join (values (0, 0e0), (1, 0.4e0), (2, 1e0)) as s(seq, part) where a.alt <= p_partkey % 3""",
    "facilities": """
        select c_custkey as id, 'hosp ' || c_name || case c_custkey % 8 when 0 then ' dental' when 1 then ' eye care' when 2 then ' general hospital' when 3 then ' trauma'
            when 4 then ' OPD' when 5 then ' polyclinic' when 6 then ' medical college' else '' end as name,
            cast(c_custkey % 120 as int) as beds, case c_custkey % 9 when 0 then 'yes' when 1 then 'no' end as emergency_tag,
            12.85e0 + (c_custkey % 50) * 0.002e0 as lat, 77.45e0 + (c_custkey % 40) * 0.002e0 as lng, case when c_custkey % 3 = 0 then ' 080 1234; 080 9 ' else null end as phone,
            case when c_custkey % 2 = 0 then cast(c_custkey as string) || ' beds' end as beds_raw
        from {customer}""",
    "named_facilities": """
        select id, case id % 10 when 0 then 'Victoria Hospital ' || name when 1 then 'St. John''s ' || name when 2 then 'Sagar Hospital ' || name when 3 then 'City 24x7 ' || name when 4 then 'Fortis OPD' else name end as name, beds, emergency_tag from {facilities}""",
    "questions": "select conv_id, turn, text from {conversations} where role = 'user'",
    "asked": """
        select seq as id, case seq % 11
            when 0 then 'How many fatal accidents in ' || area || ' in 202' || cast(seq % 7 as string) || '?' when 1 then 'Compare ' || area || ' and Area ' || cast(seq % 25 as string) || ' after 9 pm'
            when 2 then 'Where are the worst junctions near ' || area when 3 then 'Most dangerous places in the ' || lower(zone) || ' zone' when 4 then 'List recent serious crashes between 6 and 9 pm at ' || area
            when 5 then 'Is the number of deaths growing per year?' when 6 then 'What time of day is worst past 5?' when 7 then 'Predict next month for ' || area when 8 then 'minor ones at night, by zone: which are the worst?'
            when 9 then 'Trend of incidents by month in 2024' else title end as text
        from {incidents}""",
    "report_text": "select doc_id, text, lang from {documents}",
}


#: Tables whose rows hold long texts.
TEXTS = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the files are read in fewer parts than half of them, as one
    file of one row group is: reading is cheap, and what is done with a text is not."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


class Tables:
    """Raw tables and bindings as DataFrames, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in RAW and name not in BINDINGS):
            raise AttributeError(name)
        made = self.__dict__["made"]
        if name not in made:
            if name in RAW:
                rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                made[name] = spread(rows) if name in TEXTS else rows
            else:
                sql = BINDINGS[name]
                needs = {n: getattr(self, n) for n in re.findall(r"\{(\w+)\}", sql)}
                made[name] = self.spark.sql(sql, **needs)
        return made[name]


def with_bindings(sql: str) -> str:
    """A query of bindings as one standalone statement."""
    needed: list[str] = []

    def add(name: str):
        if name in BINDINGS and name not in needed:
            for inner in re.findall(r"\{(\w+)\}", BINDINGS[name]):
                add(inner)
            needed.append(name)

    for name in BINDINGS:
        if re.search(rf"\b(from|join)\s+{name}\b", sql):
            add(name)
    body = sql.strip()
    parts = [f"{n} as ({re.sub(r'[{}]', '', BINDINGS[n])})" for n in needed]
    for word in ("with recursive ", "with "):
        if body.lower().startswith(word):
            return word + ", ".join([*parts, body[len(word) :]]) if parts else body
    return ("with " + ", ".join(parts) + " " if parts else "") + body
