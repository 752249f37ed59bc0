"""Suggested routes: detours for trips with a single route, unlike routes only, scores along each
line by incidents and by a model's cells, the safest choice and a sentence for it.

A line is (trip, alt, line): the points of one route in order, alternatives of a trip by ``alt``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, half_up, haversine_km, in_box
from ..functions.text import weight
from ..plans.bindings import spread
from ..plans.dialect import half_up as sql_half_up
from ..plans.dialect import km
from ..plans.registry import query
from ..plans.steps import checkpoint
from .risk import RANKED, baseline, level_of, mid_rank
from .spatial import BUFFER, LINE_STEP, SAME, SHARED_CELL, SHARED_M, SHARED_STEP, SQL_CELL, STEP, cell, places_of, radius_pairs, ring, side

c = F.col

#: The box that trips lie in (south, west, north, east), kilometres between their ends at
#: least, how far a detour swings out, routes that are scored, shares of incidents and forecast in the
#: danger, how much slower and how much safer a choice may and must be.
BOX, CLOSE_KM, SWING, MOST_ROUTES = (12.5, 77.0, 13.5, 78.2), 0.2, 0.25, 4
PAST, AHEAD, SLOWER, MINUTES, SAFER = 0.7, 0.3, 1.4, 3.0, 0.85
#: Kilometres an hour where a route brings no time of its own.
SPEED = 30.0


def lines_of(points: DataFrame) -> DataFrame:
    """(trip, alt, line) of points (trip, alt, seq, lat, lng); points without a position are left out."""
    got = F.array_sort(F.collect_list(F.struct("seq", "lat", "lng")))
    placed = points.filter("lat is not null and lng is not null")
    return placed.groupBy("trip", "alt").agg(F.transform(got, lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("line"))


def legs(line: Column) -> Column:
    """Pairs (a, b) of neighbours; the first point stands before itself, so that each point ends one leg."""
    before = F.concat(F.slice(line, 1, 1), F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))))
    return F.zip_with(before, line, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def leg_km(leg: Column) -> Column:
    return haversine_km(leg["a"]["lat"], leg["a"]["lng"], leg["b"]["lat"], leg["b"]["lng"])


def samples(lines: DataFrame, metres: float) -> DataFrame:
    """(trip, alt, leg, k, a_lat, a_lng): points at most ``metres`` apart along each line, its own included."""
    each = lines.select("trip", "alt", F.posexplode(legs(c("line"))).alias("leg", "p")).withColumn("steps", F.greatest(F.lit(1), F.ceil(leg_km(c("p")) * 1000.0 / metres)).cast("int"))
    at = each.withColumn("k", F.explode(F.sequence(F.lit(1), c("steps"))))
    on = lambda x: c(f"p.a.{x}") + (c(f"p.b.{x}") - c(f"p.a.{x}")) * (c("k") / c("steps"))
    return at.select("trip", "alt", "leg", "k", on("lat").alias("a_lat"), on("lng").alias("a_lng"))


def possible(lines: DataFrame) -> DataFrame:
    """Lines of which both ends lie in the box and are not too close together."""
    a, b = F.get("line", F.lit(0)), F.get("line", F.size("line") - 1)
    inside = in_box(a["lat"], a["lng"], *BOX) & in_box(b["lat"], b["lng"], *BOX)
    return lines.filter(inside & (haversine_km(a["lat"], a["lng"], b["lat"], b["lng"]) >= CLOSE_KM))


def with_detours(lines: DataFrame) -> DataFrame:
    """Trips with one route get two more, through points off the middle of the straight line."""
    alone = lines.groupBy("trip").agg(F.count(F.lit(1)).alias("n"), F.max("alt").alias("alt"), F.min_by("line", "alt").alias("line")).filter("n = 1")
    a, b = F.get("line", F.lit(0)), F.get("line", F.size("line") - 1)
    ends = alone.select("trip", "alt", a.alias("a"), b.alias("b"), ((a["lat"] + b["lat"]) / 2).alias("lat"), ((a["lng"] + b["lng"]) / 2).alias("lng"))
    shrink = F.cos(F.radians("lat"))
    sides = ends.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    # a quarter of the straight line, at a right angle to it
    via = F.struct((c("lat") + c("side") * ((c("b.lng") - c("a.lng")) * shrink) * SWING).alias("lat"), (c("lng") + c("side") * (-(c("b.lat") - c("a.lat"))) * SWING / shrink).alias("lng"))
    more = sides.select("trip", (c("alt") + F.when(c("side") == 1, 1).otherwise(2)).alias("alt"), F.array("a", via, "b").alias("line"))
    return lines.select("trip", "alt", "line").unionByName(more)


def unlike(lines: DataFrame, most: int = MOST_ROUTES) -> DataFrame:
    """Lines without those that run along one kept before, in the order of ``alt``, at most ``most`` a
    trip. Samples of a trip's lines meet by grid cell; the fold is over the few lines of a trip."""
    size = SHARED_M / METRES_PER_DEGREE / 0.95
    # a trip's first line is kept in any case; the others' samples are the fewer, so these go to the cells around
    later = lines.withColumn("first", F.min("alt").over(Window.partitionBy("trip"))).filter("alt > first")
    mine = samples(later, float(SHARED_STEP))
    other = samples(lines, float(LINE_STEP)).select(c("trip").alias("b_trip"), c("alt").alias("b_alt"), c("a_lat").alias("b_lat"), c("a_lng").alias("b_lng"))
    there = cell(other, size, "b_lat", "b_lng").withColumnsRenamed({"i": "b_i", "j": "b_j"})
    met = ring(cell(mine, size, "a_lat", "a_lng")).join(there, (c("trip") == c("b_trip")) & (c("alt") > c("b_alt")) & (c("i") == c("b_i")) & (c("j") == c("b_j")))
    hits = met.filter(haversine_km(c("a_lat"), c("a_lng"), c("b_lat"), c("b_lng")) * 1000.0 <= SHARED_M).groupBy("trip", "alt", "b_alt").agg(F.countDistinct("leg", "k").alias("hits"))
    alike = hits.join(mine.groupBy("trip", "alt").agg(F.count(F.lit(1)).alias("n")), ["trip", "alt"]).filter(c("hits") / c("n") > SAME).groupBy("trip", "alt").agg(F.collect_set("b_alt").alias("alike"))
    none = F.array().cast("array<int>")
    row = F.struct("alt", F.coalesce("alike", none).alias("alike"), "line")
    trips = lines.join(alike, ["trip", "alt"], "left").groupBy("trip").agg(F.array_sort(F.collect_list(row)).alias("all"))
    kept = F.aggregate("all", none, lambda got, r: F.when(F.arrays_overlap(got, r["alike"]), got).otherwise(F.array_append(got, r["alt"])))
    first = trips.withColumn("kept", F.slice(kept, 1, most)).withColumn("r", F.explode("all")).filter(F.array_contains("kept", c("r.alt")))
    return first.select("trip", "r.alt", "r.line")


def scored(lines: DataFrame, rows: DataFrame, model: DataFrame, speed: float = SPEED) -> DataFrame:
    """Each line with the incidents of ``rows`` (lat, lng, severity) in its buffer, and the mean of
    ``model`` (i, j, expected, level; a cell without a row expects nothing) at its samples. Expected
    values are summed in whole thousandths, so that the order of sums doesn't show."""
    at = samples(lines, float(STEP))
    met = radius_pairs(at, side(places_of(rows).select("lat", "lng"), "b", "lat", "lng"), float(BUFFER))
    near = met.groupBy("trip", "alt", c("b_lat").alias("lat"), c("b_lng").alias("lng")).agg(F.min("m").alias("m")).join(places_of(rows, "severity"), ["lat", "lng"])
    by = lambda s: F.coalesce(F.sum(F.when(c("severity") == s, c("n"))), F.lit(0)).alias(s)
    past = near.groupBy("trip", "alt").agg(F.sum("n").alias("incidents"), *map(by, ("fatal", "serious", "minor")), F.sum(c("n") * weight(c("severity")) * (F.lit(1.0) - F.lit(0.5) * c("m") / BUFFER)).alias("exposure"))
    known = model.select("i", "j", F.round(c("expected") * 1000.0).cast("long").alias("expected"), "level")
    cells = cell(at, lat="a_lat", lng="a_lng").groupBy("trip", "alt", "i", "j").agg(F.count(F.lit(1)).alias("n")).join(known, ["i", "j"], "left")
    ahead = cells.groupBy("trip", "alt").agg(F.sum("n").alias("n"), F.coalesce(F.sum(c("expected") * c("n")), F.lit(0)).alias("expected"), F.count_if(c("level").isin("high", "very_high")).alias("hot_cells"))
    long = lines.select("trip", "alt", F.aggregate(legs(c("line")), F.lit(0.0), lambda s, x: s + leg_km(x)).alias("km")).join(ahead, ["trip", "alt"]).join(past, ["trip", "alt"], "left")
    per_km = F.coalesce("exposure", F.lit(0.0)) / F.greatest(F.lit(0.5), c("km"))
    return long.select(
        "trip", "alt", half_up(c("km"), 2).alias("distance_km"), half_up(c("km") / speed * 60.0, 1).alias("duration_min"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("incidents", "fatal", "serious", "minor")],
        half_up(F.coalesce("exposure", F.lit(0.0)), 2).alias("exposure"), half_up(per_km, 2).alias("per_km"), half_up(c("expected") / 1000.0 / c("n"), 3).alias("predicted"), "hot_cells", half_up(F.exp(per_km * -0.35) * 100.0).alias("safety"),
    )


def chosen(routes: DataFrame) -> DataFrame:
    """Scored routes with their danger among the trip's, and which one is fastest and which recommended:
    the least danger among those that are not much slower, if it is clearly below the fastest one's."""
    w = Window.partitionBy("trip")
    share = lambda x, part: F.lit(part) * c(x) / F.greatest(F.lit(1e-9), F.max(x).over(w))
    d = routes.withColumn("danger", half_up(share("exposure", PAST) + share("predicted", AHEAD), 3)).withColumn("least", F.min("duration_min").over(w))
    ok = c("duration_min") <= c("least") * SLOWER + MINUTES
    picked = d.withColumns({"fast": F.min(F.struct("duration_min", "alt", "danger")).over(w), "best": F.min(F.when(ok, F.struct("danger", "alt"))).over(w)})
    take = F.when(c("best.danger") > c("fast.danger") * SAFER, c("fast.alt")).otherwise(c("best.alt"))
    return picked.withColumn("recommended", c("alt") == take).withColumn("fastest", c("alt") == c("fast.alt")).drop("least", "fast", "best")


def trip_classes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trip, of): every trip with the least trip of the same lines; and the lines of those least trips. What
    is suggested follows from the lines alone, so trips that many take are worked out once."""
    shape = F.array_sort(F.collect_list(F.struct("alt", "line")))
    trips = checkpoint(lines.groupBy("trip").agg(shape.alias("shape")))
    classes = checkpoint(trips.groupBy("shape").agg(F.min("trip").alias("of")))
    return trips.join(classes, "shape").select("trip", "of"), classes.select(c("of").alias("trip"), F.inline("shape"))


def for_all(found: DataFrame, trips: DataFrame) -> DataFrame:
    """Rows of (trip, ...), once for each of ``trips`` (trip, of) of that class."""
    return trips.join(found.withColumnRenamed("trip", "of"), "of").select(*found.columns)


def suggested_once(lines: DataFrame, rows: DataFrame, model: DataFrame) -> DataFrame:
    """All steps: trips that are possible, detours, unlike routes, scores, choice. Trips whose ends are
    too close, outside the box or missing give no rows. Lines are written before they are sampled, as
    each step reads them several times, and dealt to all cores: few bytes of lines are many samples."""
    every = spread(checkpoint(with_detours(possible(lines))))
    return chosen(scored(spread(checkpoint(unlike(every))), rows, model))


def suggested(lines: DataFrame, rows: DataFrame, model: DataFrame) -> DataFrame:
    """``suggested_once`` for every trip, trips of the same lines being worked out once."""
    trips, classes = trip_classes(lines)
    return for_all(suggested_once(classes, rows, model), trips)


def reduction(better: Column, worse: Column) -> Column:
    return F.when(worse > 0, half_up((worse - better) / worse * 100.0)).otherwise(0.0).cast("int")


def plain(x: Column) -> Column:
    """A number of one decimal as text, with its sign, without a decimal of 0."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), F.regexp_replace(x.cast("string"), r"\.0$", ""))


def summaries(routes: DataFrame) -> DataFrame:
    """(trip, routes, summary): one sentence on each trip's choice."""
    fields = F.struct("incidents", "safety", "exposure", "predicted", "duration_min", "distance_km", "fastest")
    g = routes.groupBy("trip").agg(F.count(F.lit(1)).alias("routes"), F.max(F.when(c("recommended"), fields)).alias("b"), F.max(F.when(c("fastest"), fields)).alias("f"))
    fewer, lower = reduction(c("b.exposure"), c("f.exposure")), reduction(c("b.predicted"), c("f.predicted"))
    gains = F.concat_ws(" and ", F.when(fewer > 0, F.concat(fewer.cast("string"), F.lit("% less severity-weighted incident exposure"))), F.when(lower > 0, F.concat(lower.cast("string"), F.lit("% lower predicted risk"))))
    more = lambda x: plain(half_up(c(f"b.{x}") - c(f"f.{x}"), 1))
    count, safety = c("b.incidents").cast("string"), c("b.safety").cast("int").cast("string")
    text = (
        F.when(c("routes") == 1, F.concat(F.lit("Only one practical route was found. It passes "), count, F.lit(f" recorded incident(s) within {BUFFER} m.")))
        .when(c("b.fastest"), F.concat(F.lit("The fastest route is also the safest: "), count, F.lit(f" recorded incident(s) within {BUFFER} m, safety score "), safety, F.lit("/100.")))
        .otherwise(F.concat(F.lit("Safer alternative: "), F.when(gains == "", "lower overall risk").otherwise(gains), F.lit(" than the fastest route, for "), more("duration_min"), F.lit(" min and "), more("distance_km"), F.lit(" km.")))
    )
    return g.select("trip", "routes", text.alias("summary"))


def past_model(t) -> DataFrame:
    """Cells of past incidents as a model: what stands in a cell and around it, levels by rank."""
    return baseline(t).withColumn("pct", mid_rank("score")).select("i", "j", c("score").alias("expected"), level_of(c("pct")).alias("level"))


def sql_samples(name: str, of: str, metres: int) -> str:
    """(trip, alt, seq, k, lat, lng) along the lines of ``of``, as CTEs."""
    return f"""{name}_l as (select *, coalesce(lag(lat) over w, lat) as lat0, coalesce(lag(lng) over w, lng) as lng0 from {of} window w as (partition by trip, alt order by seq)),
        {name}_s as (select *, {km('lat0', 'lng0', 'lat', 'lng')} as km, cast(greatest(1, ceil({km('lat0', 'lng0', 'lat', 'lng')} * 1000e0 / {metres})) as bigint) as steps from {name}_l),
        {name} as (select trip, alt, seq, k, lat0 + (lat - lat0) * (k / cast(steps as double)) as lat, lng0 + (lng - lng0) * (k / cast(steps as double)) as lng from (select *, unnest(range(1, steps + 1)) as k from {name}_s))"""


AROUND = "cross join (select unnest([-1, 0, 1]) as di) cross join (select unnest([-1, 0, 1]) as dj)"
SUGGESTED = f"""with recursive {RANKED},
    en as (select trip, alt, arg_min(lat, seq) as lat1, arg_min(lng, seq) as lng1, arg_max(lat, seq) as lat2, arg_max(lng, seq) as lng2 from drives group by 1, 2),
    ok as (select * from en where lat1 between {BOX[0]} and {BOX[2]} and lat2 between {BOX[0]} and {BOX[2]} and lng1 between {BOX[1]} and {BOX[3]} and lng2 between {BOX[1]} and {BOX[3]} and {km('lat1', 'lng1', 'lat2', 'lng2')} >= {CLOSE_KM}),
    lone as (select *, (lat1 + lat2) / 2 as la, (lng1 + lng2) / 2 as ln from ok qualify count(*) over (partition by trip) = 1),
    via as (select *, la + s * ((lng2 - lng1) * cos(radians(la))) * 0.25e0 as vlat, ln + s * (-(lat2 - lat1)) * 0.25e0 / cos(radians(la)) as vlng, cast(alt + case when s = 1 then 1 else 2 end as int) as nalt from lone cross join (select unnest([1, -1]) as s)),
    ln as (select d.trip, d.alt, d.seq, d.lat, d.lng from drives d join ok using (trip, alt) union all select trip, nalt, 0, lat1, lng1 from via union all select trip, nalt, 1, vlat, vlng from via union all select trip, nalt, 2, lat2, lng2 from via),
    {sql_samples('far', 'ln', SHARED_STEP)}, {sql_samples('mid', 'ln', LINE_STEP)},
    fa as (select *, {SHARED_CELL.format('lat')} as i, {SHARED_CELL.format('lng')} as j from far), mb as (select trip, alt as other, lat, lng, {SHARED_CELL.format('lat')} + di as i, {SHARED_CELL.format('lng')} + dj as j from mid {AROUND}),
    hit as (select a.trip, a.alt, b.other, count(distinct (a.seq, a.k)) as hits from fa a join mb b on a.trip = b.trip and a.alt > b.other and a.i = b.i and a.j = b.j where {km('a.lat', 'a.lng', 'b.lat', 'b.lng')} * 1000e0 <= {SHARED_M} group by all),
    al as (select trip, alt, list(other) as alike from hit join (select trip, alt, count(*) as n from far group by 1, 2) using (trip, alt) where hits / cast(n as double) > {SAME} group by 1, 2),
    od as (select trip, alt, coalesce(alike, []) as alike, row_number() over (partition by trip order by alt) as r from (select distinct trip, alt from ln) left join al using (trip, alt)),
    fo as (select trip, r, [alt] as kept from od where r = 1 union all select fo.trip, od.r, case when list_has_any(fo.kept, od.alike) then fo.kept else list_append(fo.kept, od.alt) end from fo join od on od.trip = fo.trip and od.r = fo.r + 1),
    kp as (select trip, unnest(arg_max(kept, r)[1:{MOST_ROUTES}]) as alt from fo group by 1), kl as (select ln.* from ln join kp using (trip, alt)),
    {sql_samples('sp', 'kl', STEP)},
    dc as (select *, {SQL_CELL('lat', 'lng')} from sp), pc as (select lat, lng, i + di as i, j + dj as j from (select distinct lat, lng, {SQL_CELL('lat', 'lng')} from active) {AROUND}),
    xm as (select trip, alt, p.lat, p.lng, min({km('d.lat', 'd.lng', 'p.lat', 'p.lng')} * 1000e0) as m from dc d join pc p on d.i = p.i and d.j = p.j where {km('d.lat', 'd.lng', 'p.lat', 'p.lng')} * 1000e0 <= {BUFFER} group by all),
    ps as (select trip, alt, count(*) as incidents, count(*) filter (where severity = 'fatal') as fatal, count(*) filter (where severity = 'serious') as serious, count(*) filter (where severity = 'minor') as minor,
        sum(case severity when 'fatal' then 3 when 'serious' then 2 else 1 end * (1e0 - 0.5e0 * m / {BUFFER})) as exposure from xm join active ac on ac.lat = xm.lat and ac.lng = xm.lng group by 1, 2),
    ce as (select trip, alt, cast(floor((lat - 12.5e0) / 0.0045e0) as bigint) as i, cast(floor((lng - 77e0) / 0.0045e0) as bigint) as j, count(*) as n from sp group by all),
    ah as (select trip, alt, sum(n) as n, coalesce(sum(n * cast(round(score * 1000e0) as bigint)), 0) as expected, count(*) filter (where level in ('high', 'very_high')) as hot_cells from ce left join lv using (i, j) group by 1, 2),
    le as (select trip, alt, sum(km) as km from sp_s group by 1, 2),
    ro as (select trip, alt, {sql_half_up('km', 2)} as distance_km, {sql_half_up('km / 30e0 * 60e0', 1)} as duration_min, coalesce(incidents, 0) as incidents, coalesce(fatal, 0) as fatal, coalesce(serious, 0) as serious, coalesce(minor, 0) as minor,
        {sql_half_up('coalesce(exposure, 0e0)', 2)} as exposure, {sql_half_up('coalesce(exposure, 0e0) / greatest(0.5e0, km)', 2)} as per_km, {sql_half_up('cast(expected as double) / 1000e0 / cast(n as double)', 3)} as predicted, hot_cells,
        {sql_half_up('100e0 * exp(-0.35e0 * (coalesce(exposure, 0e0) / greatest(0.5e0, km)))')} as safety from le join ah using (trip, alt) left join ps using (trip, alt)),
    da as (select *, {sql_half_up('0.7e0 * exposure / greatest(1e-9, max(exposure) over (partition by trip)) + 0.3e0 * predicted / greatest(1e-9, max(predicted) over (partition by trip))', 3)} as danger, min(duration_min) over (partition by trip) as least from ro),
    pk as (select trip, arg_min(alt, (duration_min, alt)) as fast, arg_min(danger, (duration_min, alt)) as fast_danger, arg_min(alt, (danger, alt)) filter (where duration_min <= least * 1.4e0 + 3e0) as best, min(danger) filter (where duration_min <= least * 1.4e0 + 3e0) as best_danger from da group by 1),
    su as (select da.* exclude (least), alt = case when best_danger > fast_danger * 0.85e0 then fast else best end as recommended, alt = fast as fastest from da join pk using (trip))"""


@query(f"{SUGGESTED} select * from su")
def safe_routes(t):
    """Every route that is suggested for a trip, with its scores; given routes are those of ``drives``."""
    return suggested(lines_of(t.drives), t.active, past_model(t))


LESS = "cast(case when f.{0} > 0 then " + sql_half_up("(f.{0} - b.{0}) / f.{0} * 100e0") + " else 0 end as int)"
MORE = "case when {0} >= 0 then '+' else '' end || regexp_replace(cast({0} as varchar), '\\.0$', '')"


@query(f"""{SUGGESTED},
    tw as (select b.trip, (select count(*) from su x where x.trip = b.trip) as routes, b.incidents, b.safety, b.fastest, {LESS.format('exposure')} as fewer, {LESS.format('predicted')} as lower_, {sql_half_up('b.duration_min - f.duration_min', 1)} as mins, {sql_half_up('b.distance_km - f.distance_km', 1)} as kms
        from su b join su f on b.trip = f.trip and b.recommended and f.fastest)
    select trip, routes, case when routes = 1 then 'Only one practical route was found. It passes ' || incidents || ' recorded incident(s) within {BUFFER} m.'
        when fastest then 'The fastest route is also the safest: ' || incidents || ' recorded incident(s) within {BUFFER} m, safety score ' || cast(safety as int) || '/100.'
        else 'Safer alternative: ' || case when fewer <= 0 and lower_ <= 0 then 'lower overall risk' else concat_ws(' and ', case when fewer > 0 then fewer || '% less severity-weighted incident exposure' end, case when lower_ > 0 then lower_ || '% lower predicted risk' end) end
            || ' than the fastest route, for ' || {MORE.format('mins')} || ' min and ' || {MORE.format('kms')} || ' km.' end as summary from tw""")
def safe_route_summaries(t):
    """What is said of each trip's choice."""
    trips, classes = trip_classes(lines_of(t.drives))
    return for_all(summaries(suggested_once(classes, t.active, past_model(t))), trips)
