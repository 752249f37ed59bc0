"""Forecasts that questions ask for: the cells of most risk that a place and a zone name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import half_up
from ..plans.dialect import half_up as sql_half_up
from ..plans.dialect import km
from ..plans.registry import query
from .answers import CALLS, asked_plans
from .risk import RANKED, counts
from .safe_routes import past_model
from .spatial import GRID, SOUTH, WEST, places_of, radius_pairs, side

c = F.col

#: Names that name nothing, letters of a name at most, metres around a cell's centre that
#: name it, cells of an answer.
GENERIC, NAME_CHARS, AROUND_M, MOST = "^(the road|road|main road|bengaluru|bangalore|unknown|city|highway)$", 60, 700.0, 5
ANY = "*"


def named_cells(model: DataFrame, rows: DataFrame) -> DataFrame:
    """Cells of ``model`` (i, j, expected, level) above low, with the commonest name and the nearest
    place's area and zone within 700 m, past counts, and the risk relative to cells with incidents."""
    past = counts(rows).select("i", "j", "n", "fatal")
    both = model.join(past, ["i", "j"], "left")
    mean = both.filter("n is not null").agg(F.avg(F.round(c("expected") * 1000.0).cast("long")).alias("mean"))
    hot = both.filter("level <> 'low'").crossJoin(F.broadcast(mean))  # one row
    centres = hot.select(F.struct("i", "j").alias("b_id"), (F.lit(SOUTH) + (c("i") + 0.5) * F.lit(GRID)).alias("b_lat"), (F.lit(WEST) + (c("j") + 0.5) * F.lit(GRID)).alias("b_lng"))
    clean = lambda x: F.when((F.trim(x) != "") & ~F.trim(x).rlike(f"(?i){GENERIC}") & (F.length(F.trim(x)) <= NAME_CHARS), F.trim(x))
    places = places_of(rows.withColumn("name", F.coalesce(clean("location"), clean("area"))), "name", "area", "zone")
    near = radius_pairs(side(places, "a", "lat", "lng", "name", "area", "zone", "n"), centres, AROUND_M)
    names = near.filter("a_name is not null").groupBy("b_id", "a_name").agg(F.sum("a_n").alias("n")).groupBy("b_id").agg(F.min_by("a_name", F.struct(-c("n"), "a_name")).alias("name"))
    first = near.groupBy("b_id").agg(F.min(F.struct(half_up(c("m"), 3).alias("m"), F.coalesce("a_area", F.lit("")).alias("area"), F.coalesce("a_zone", F.lit("")).alias("zone"))).alias("f"))
    told = first.join(names, "b_id", "left").select("b_id.i", "b_id.j", "name", "f.area", "f.zone")
    relative = half_up(F.round(c("expected") * 1000.0).cast("long") / c("mean"), 2).alias("relative_risk")
    return hot.join(told, ["i", "j"], "left").select("i", "j", "name", F.coalesce("area", F.lit("")).alias("area"), F.coalesce("zone", F.lit("")).alias("zone"), "level", "expected", relative, F.coalesce("n", F.lit(0)).alias("past_incidents"), F.coalesce("fatal", F.lit(0)).alias("past_fatal"))


def forecasts(asks: DataFrame, cells: DataFrame, most: int = MOST) -> DataFrame:
    """The ``most`` cells of the highest expectation for each of the distinct (place, zone) asked, null for
    any: the zone is the cell's, the place is part of its name or area, in either case of letters."""
    wanted = asks.select("place", "zone", F.lower(F.coalesce("zone", F.lit(ANY))).alias("key"), F.lower("place").alias("part")).distinct()
    offered = cells.withColumnRenamed("zone", "own_zone").withColumn("key", F.explode(F.array(F.lit(ANY), F.lower("own_zone")))).withColumn("hay", F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), "area")))
    met = offered.join(wanted, "key").filter(c("part").isNull() | c("hay").contains(c("part")))
    rank = F.row_number().over(Window.partitionBy("place", "zone").orderBy(c("expected").desc(), "i", "j"))
    return met.withColumn("rank", rank).filter(c("rank") <= most).select("place", "zone", "rank", "i", "j", F.coalesce("name", F.nullif("area", F.lit("")), F.lit("Unnamed cell")).alias("name"), "level", "relative_risk", "past_incidents", "past_fatal")


def sql_clean(x: str) -> str:
    return f"case when trim({x}) <> '' and not regexp_matches(trim({x}), '(?i){GENERIC}') and length(trim({x})) <= {NAME_CHARS} then trim({x}) end"


@query(f"""
    with {RANKED}, {CALLS},
    asks as (select distinct place, zone from pa where tool = 'risk_forecast'),
    mn as (select avg(cast(round(score * 1000e0) as bigint)) as mean from lv join g using (i, j)),
    hc as (select lv.i, lv.j, level, score, cast(round(score * 1000e0) as bigint) / mean as rel, coalesce(n, 0) as n, coalesce(fatal, 0) as fatal, 12.5e0 + (lv.i + 0.5e0) * 0.0045e0 as y, 77e0 + (lv.j + 0.5e0) * 0.0045e0 as x from lv left join g using (i, j) cross join mn where level <> 'low'),
    nr as (select h.i, h.j, coalesce({sql_clean('a.location')}, {sql_clean('a.area')}) as name, coalesce(a.area, '') as area, coalesce(a.zone, '') as zone, {sql_half_up(km('h.y', 'h.x', 'a.lat', 'a.lng') + ' * 1000e0', 3)} as m from hc h join active a on {km('h.y', 'h.x', 'a.lat', 'a.lng')} * 1000e0 <= {AROUND_M}),
    nm as (select i, j, name from (select i, j, name, count(*) as k from nr where name is not null group by all) qualify row_number() over (partition by i, j order by k desc, name) = 1),
    fi as (select i, j, area, zone from nr qualify row_number() over (partition by i, j order by m, area, zone) = 1),
    ct as (select hc.*, name, coalesce(area, '') as area, coalesce(zone, '') as zone from hc left join nm using (i, j) left join fi using (i, j))
    select k.place, k.zone, cast(row_number() over (partition by k.place, k.zone order by score desc, ct.i, ct.j) as int) as rank, ct.i, ct.j, coalesce(ct.name, nullif(ct.area, ''), 'Unnamed cell') as name, level, {sql_half_up('rel', 2)} as relative_risk, n as past_incidents, fatal as past_fatal
    from asks k join ct on (k.zone is null or lower(k.zone) = lower(ct.zone)) and (k.place is null or contains(lower(coalesce(ct.name, '') || ' ' || ct.area), lower(k.place))) qualify rank <= {MOST}""")
def asked_forecasts(t):
    """Cells for all that forecasts are asked for; the model is the cells of past incidents."""
    return forecasts(asked_plans(t).filter("tool = 'risk_forecast'"), named_cells(past_model(t), t.active))
