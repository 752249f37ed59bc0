"""The risk grid: features of cells, a ridge Poisson model, its validation and its use."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import half_up, haversine_km
from ..plans.dialect import half_up as sql_half_up
from ..plans.dialect import km
from ..plans.registry import query
from ..plans.steps import checkpoint
from .spatial import GRID, SOUTH, WEST, cell, radius_pairs, ring, side

c = F.col
#: Fixed value: names of major roads.
MAJOR_ROAD = r"highway|\bnh\b|flyover|outer ring|\borr\b|expressway|elevated|bypass|toll|ring road"
#: With the roads of the tables given whose numbers begin with 1, since these have no such names.
ROAD = MAJOR_ROAD + "|road 1"
#: Fixed value: the ridge penalty on each slope.
PENALTY = 50.0
FEATURES = ("log_own", "log_ring1", "log_ring2", "fatal_share", "road_share", "dist")

COUNTS = f"""p as (select *, cast(floor((lat - 12.5e0) / 0.0045e0) as bigint) as i, cast(floor((lng - 77e0) / 0.0045e0) as bigint) as j from active),
    g as (select i, j, count(*) as n, count(*) filter (where severity = 'fatal') as fatal, count(*) filter (where regexp_matches(concat_ws(' ', title, location, area), '(?i){ROAD}')) as road from p group by i, j)"""
CAND = "cand as (select distinct i + di as i, j + dj as j from g cross join (select cast(unnest(range(-2, 3)) as bigint) as di) cross join (select cast(unnest(range(-2, 3)) as bigint) as dj))"


def counts(rows: DataFrame) -> DataFrame:
    """(i, j, n, fatal, road): incidents of each cell."""
    road = F.concat_ws(" ", "title", "location", "area").rlike("(?i)" + ROAD)
    return cell(rows).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("severity") == "fatal").alias("fatal"), F.count_if(road).alias("road"))


@query(f"with {COUNTS} select * from g")
def grid_counts(t):
    return counts(t.active)


def ringed(g: DataFrame, reach: int = 2) -> DataFrame:
    """For every cell within ``reach`` of an incident: own counts and sums over the rings. Each
    cell of incidents is sent to its neighbours, so one grouping gives all rings."""
    steps = F.array(*[F.lit(x).cast("long") for x in range(-reach, reach + 1)])
    sent = g.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps)).withColumn("r", F.greatest(F.abs("di"), F.abs("dj")))
    at = lambda r, x: F.sum(F.when(c("r") == r, c(x)).otherwise(0))
    near = lambda x: F.sum(F.when(c("r") <= 1, c(x)).otherwise(0))
    return sent.groupBy((c("i") + c("di")).alias("i"), (c("j") + c("dj")).alias("j")).agg(at(0, "n").alias("own"), at(1, "n").alias("ring1"), at(2, "n").alias("ring2"), near("fatal").alias("fatal_near"), near("road").alias("road_near"), at(0, "fatal").alias("fatal"))


RINGED = f"""{COUNTS}, {CAND}, rg as (select x.i, x.j, cast(coalesce(sum(n) filter (where r = 0), 0) as bigint) as own, cast(coalesce(sum(n) filter (where r = 1), 0) as bigint) as ring1, cast(coalesce(sum(n) filter (where r = 2), 0) as bigint) as ring2,
    cast(coalesce(sum(fatal) filter (where r <= 1), 0) as bigint) as fatal_near, cast(coalesce(sum(road) filter (where r <= 1), 0) as bigint) as road_near
    from (select cand.i, cand.j, g.n, g.fatal, g.road, greatest(abs(cand.i - g.i), abs(cand.j - g.j)) as r from cand join g on abs(cand.i - g.i) <= 2 and abs(cand.j - g.j) <= 2) x group by 1, 2)"""


@query(f"with {RINGED} select i, j, own, ring1, ring2 from rg")
def ring_counts(t):
    return ringed(counts(t.active)).select("i", "j", "own", "ring1", "ring2")


@query(f"with {COUNTS}, {CAND} select * from cand")
def candidate_cells(t):
    return ring(counts(t.active).select("i", "j"), 2).distinct()


def features(g: DataFrame) -> DataFrame:
    r = ringed(g)
    local = c("own") + c("ring1") + 1
    lat, lng = F.lit(SOUTH) + (c("i") + 0.5) * F.lit(GRID), F.lit(WEST) + (c("j") + 0.5) * F.lit(GRID)
    return r.select(
        "i", "j", "own", "ring1", "fatal", F.log1p("own").alias("log_own"), F.log1p("ring1").alias("log_ring1"), F.log1p("ring2").alias("log_ring2"), ((c("fatal_near") + 0.3) / local).alias("fatal_share"), ((c("road_near") + 0.1) / local).alias("road_share"),
        (haversine_km(lat, lng, F.lit(12.9716), F.lit(77.5946)) / 10.0).alias("dist"), lat.alias("lat"), lng.alias("lng"),
    )


CENTRE = km("12.5e0 + (i + 0.5e0) * 0.0045e0", "77e0 + (j + 0.5e0) * 0.0045e0", "12.9716e0", "77.5946e0")


@query(f"""with {RINGED} select i, j, {sql_half_up('ln(1 + own)', 4)} as log_own, {sql_half_up('ln(1 + ring1)', 4)} as log_ring1, {sql_half_up('ln(1 + ring2)', 4)} as log_ring2,
    {sql_half_up('(fatal_near + 0.3e0) / (own + ring1 + 1)', 4)} as fatal_share, {sql_half_up('(road_near + 0.1e0) / (own + ring1 + 1)', 4)} as road_share, {sql_half_up(f'{CENTRE} / 10e0', 4)} as dist from rg""")
def cell_features(t):
    return features(counts(t.active)).select("i", "j", *[half_up(c(x), 4).alias(x) for x in FEATURES])


@dataclass
class PoissonFit:
    beta: np.ndarray

    def mu(self) -> Column:
        eta = F.lit(float(self.beta[0]))
        for b, x in zip(self.beta[1:], FEATURES):
            eta = eta + F.lit(float(b)) * c(x)
        return F.exp(F.least(eta, F.lit(20.0)))


def fit_poisson(rows: DataFrame, penalty: float = PENALTY) -> PoissonFit:
    """Ridge Poisson regression of y; the intercept is free. MLlib divides the likelihood by the
    number of incidents, so the penalty is too."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    total = rows.agg(F.sum("y")).first()[0] or 0
    if total == 0:
        return PoissonFit(np.array([-20.0] + [0.0] * len(FEATURES)))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x", labelCol="y", regParam=penalty / float(total), maxIter=50, tol=1e-8)
    model = glm.fit(data)
    return PoissonFit(np.array([model.intercept, *model.coefficients.toArray()]))


def folds_of(rows: DataFrame, k: int = 5) -> DataFrame:
    """Each incident's fold by a hash of its id, so that a task that runs again agrees."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))


def fold_rows(rows: DataFrame, k: int = 5, cells: DataFrame | None = None) -> DataFrame:
    """For each fold: features of cells from the other folds, and the fold's own counts y. Counts
    are taken once per cell and fold; histories are sums over the other folds. Cells around
    those of ``cells`` (i, j) count too, without incidents of their own. The rows, a few for
    each cell of the city, are written once, as fits read them many times."""
    road = F.concat_ws(" ", "title", "location", "area").rlike("(?i)" + ROAD)
    per = cell(folds_of(rows, k)).groupBy("i", "j", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("severity") == "fatal").alias("fatal"), F.count_if(road).alias("road"))
    if cells is not None:
        per = per.unionByName(cells.select("i", "j", F.lit(0).alias("fold"), *[F.lit(0).cast("long").alias(x) for x in ("n", "fatal", "road")]))
    out = None
    for f in range(k):
        other = per.groupBy("i", "j").agg(*[F.sum(F.when(c("fold") != f, c(x)).otherwise(0)).alias(x) for x in ("n", "fatal", "road")], F.sum(F.when(c("fold") == f, c("n")).otherwise(0)).alias("target"))
        x = features(other).withColumn("fold", F.lit(f))
        y = other.select(c("i").alias("ti"), c("j").alias("tj"), "target")
        joined = x.join(y, (c("i") == c("ti")) & (c("j") == c("tj")), "left").withColumn("y", F.coalesce("target", F.lit(0)).cast("double")).drop("ti", "tj", "target")
        out = joined if out is None else out.unionByName(joined)
    return checkpoint(out)


@query()
def poisson_fit(t):
    """Coefficients of the model over all folds."""
    fit = fit_poisson(fold_rows(t.active))
    return t.spark.createDataFrame([(name, float(b)) for name, b in zip(("intercept", *FEATURES), fit.beta)], "feature string, coefficient double")


def hit_rate_of(scored: DataFrame, share: float, *keys: str) -> DataFrame:
    """Share of y in the top ``share`` of cells by score, for each of ``keys``."""
    w = Window.partitionBy(*keys).orderBy(c("score").desc(), "i", "j")
    top = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    r = scored.withColumn("hit", F.row_number().over(w) <= top)
    return r.groupBy(*keys).agg(half_up(F.try_divide(F.sum(F.when(c("hit"), c("y")).otherwise(0)), F.sum("y")), 3).alias("hit_rate"))


@query()
def cv_folds(t):
    """Hit rate of the top tenth and pseudo R2 in each fold, fitted on the others."""
    rows = fold_rows(t.active)
    out = None
    for f in range(5):
        train = rows.filter(c("fold") != f)
        fit = fit_poisson(train)
        mean = train.agg(F.avg("y")).first()[0]
        scored = rows.filter(c("fold") == f).withColumn("score", fit.mu())
        dev = lambda m: F.sum(F.when(c("y") > 0, c("y") * F.ln(c("y") / m)).otherwise(0.0) - (c("y") - m)) * 2.0
        r2 = scored.agg((F.lit(1.0) - dev(F.greatest(c("score"), F.lit(1e-9))) / dev(F.lit(mean))).alias("pseudo_r2"))
        one = hit_rate_of(scored, 0.1, "fold").crossJoin(r2)
        out = one if out is None else out.unionByName(one)
    return out


BASE = f"{RINGED}, b as (select i, j, own + 0.001e0 * ring1 as score, own as y, fatal from rg left join g using (i, j))"


def baseline(t) -> DataFrame:
    """Cells scored by their past, against their fatal incidents as targets."""
    return features(counts(t.active)).select("i", "j", (c("own") + F.lit(0.001) * c("ring1")).alias("score"), c("own"), c("fatal").alias("y"))


@query(f"with {BASE}, r as (select coalesce(fatal, 0) as y, row_number() over (order by score desc, i, j) as k, count(*) over () as n from b) select {sql_half_up('sum(y) filter (where k <= ceil(0.1e0 * n)) / cast(sum(y) as double)', 3)} as hit_rate from r")
def hit_rate(t):
    return hit_rate_of(baseline(t).withColumn("one", F.lit(1)), 0.1, "one").select("hit_rate")


@query(f"with {BASE}, r as (select coalesce(fatal, 0) as y, row_number() over (order by score desc, i, j) as k, count(*) over () as n from b) select {sql_half_up('floor(sum(y) filter (where k <= ceil(0.1e0 * n)) / cast(sum(y) as double) * 1e3 + 0.5e0) / 1e3 / 0.1e0', 2)} as pai from r")
def pai(t):
    return hit_rate(t).select(half_up(c("hit_rate") / 0.1, 2).alias("pai"))


@query(f"with {BASE}, x as (select coalesce(fatal, 0) as y, greatest(1e-9, score * 0.2e0) as m from b) select {sql_half_up('2e0 * sum(case when y > 0 then y * ln(y / m) else 0e0 end - (y - m))', 2)} as deviance from x")
def poisson_deviance(t):
    m = F.greatest(F.lit(1e-9), c("score") * 0.2)
    return baseline(t).agg(half_up(F.sum(F.when(c("y") > 0, c("y") * F.ln(c("y") / m)).otherwise(0.0) - (c("y") - m)) * 2.0, 2).alias("deviance"))


def mid_rank(value: str) -> Column:
    """0 to 100; ties get the middle of their ranks. Cells of one city: a bounded number."""
    w, everyone = Window.orderBy(value), Window.partitionBy()
    ties = F.count(F.lit(1)).over(Window.partitionBy(value))
    n = F.count(F.lit(1)).over(everyone)
    return F.when(n > 1, (F.rank().over(w) - 1 + (ties - 1) / 2.0) / (n - 1) * 100.0).otherwise(100.0)


def level_of(pct: Column) -> Column:
    return F.when(pct >= 95, "very_high").when(pct >= 85, "high").when(pct >= 65, "medium").otherwise("low")


RANKED = f"{BASE}, pr as (select i, j, score, (rank() over (order by score) - 1 + (count(*) over (partition by score) - 1) / 2e0) / (count(*) over () - 1) * 100e0 as pct from b), lv as (select *, case when pct >= 95 then 'very_high' when pct >= 85 then 'high' when pct >= 65 then 'medium' else 'low' end as level from pr)"


@query(f"with {RANKED} select i, j, {sql_half_up('pct', 2)} as pct, level from lv")
def percentile_midrank(t):
    return baseline(t).withColumn("pct", mid_rank("score")).select("i", "j", half_up(c("pct"), 2).alias("pct"), level_of(c("pct")).alias("level"))


@query(f"with {RANKED} select level, count(*) as cells from lv group by 1")
def risk_levels(t):
    return percentile_midrank(t).groupBy("level").agg(F.count(F.lit(1)).alias("cells"))


@query("""
    with h as (select h.hour, 1 + count(a.id) as n from (select cast(range as int) as hour from range(24)) h left join active a on a.hour = h.hour group by 1)
    select hour, floor(n * 24e0 / sum(n) over () * 100 + 0.5e0) / 100 as factor from h where (select count(hour) >= 30 and count(hour) >= 0.15 * count(*) from active)""")
def hour_profile(t):
    """Relative frequency of each hour, smoothed by one; only if enough rows have a time."""
    from .statistics import dense, spine

    n = dense(t.active.filter("hour is not null").groupBy("hour").agg(F.count(F.lit(1)).alias("n")), spine(t.spark, "hour", 24), "hour").withColumn("n", c("n") + 1)
    enough = t.active.agg(((F.count("hour") >= 30) & (F.count("hour") >= F.lit(0.15) * F.count(F.lit(1)))).alias("enough"))
    factor = half_up(c("n") * 24.0 / F.sum("n").over(Window.partitionBy()), 2)
    return n.withColumn("factor", factor).crossJoin(F.broadcast(enough)).filter("enough").select("hour", "factor")


NEAR = km("y", "x", "a.lat", "a.lng")


@query(f"""
    with {RANKED}, k as (select i, j, 12.5e0 + (i + 0.5e0) * 0.0045e0 as y, 77e0 + (j + 0.5e0) * 0.0045e0 as x from lv where level in ('high', 'very_high')),
    m as (select k.i, k.j, a.location, count(*) as n from k join active a on {NEAR} * 1000e0 <= 700e0 group by 1, 2, 3)
    select i, j, location as name from m qualify row_number() over (partition by i, j order by n desc, location) = 1""")
def cell_names(t):
    """The commonest location near each cell of high risk."""
    k = percentile_midrank(t).filter(c("level").isin("high", "very_high"))
    centres = k.select(F.struct("i", "j").alias("b_id"), (F.lit(SOUTH) + (c("i") + 0.5) * F.lit(GRID)).alias("b_lat"), (F.lit(WEST) + (c("j") + 0.5) * F.lit(GRID)).alias("b_lng"))
    places = t.active.groupBy("lat", "lng", "location").agg(F.count(F.lit(1)).alias("n"))  # rows of one place meet once
    m = radius_pairs(side(places, "a", "lat", "lng", "location", "n"), centres, 700.0).groupBy("b_id", "a_location").agg(F.sum("a_n").alias("n"))
    return m.groupBy("b_id").agg(F.min_by("a_location", F.struct(-c("n"), "a_location")).alias("name")).select("b_id.i", "b_id.j", "name")


@query("""
    with d as (select accident_date, count(*) as n from active where accident_date is not null group by 1), s as (select accident_date, sum(n) over (order by accident_date) as upto, sum(n) over () as total from d),
    cut as (select min(accident_date) as cutoff from s where upto > floor(0.75e0 * total))
    select cutoff, count(*) filter (where accident_date >= cutoff) as test_rows, count(*) filter (where accident_date is null or accident_date < cutoff) as history_rows from active cross join cut group by 1""", dates=("cutoff",))  # fmt: skip
def temporal_split(t):
    """The date at three quarters of the dated rows; days are counted before they are ordered."""
    return t.active.crossJoin(F.broadcast(cutoff_of(t))).groupBy("cutoff").agg(F.count_if(c("accident_date") >= c("cutoff")).alias("test_rows"), F.count_if(c("accident_date").isNull() | (c("accident_date") < c("cutoff"))).alias("history_rows"))


def cutoff_of(t) -> DataFrame:
    d = t.active.filter("accident_date is not null").groupBy("accident_date").agg(F.count(F.lit(1)).alias("n"))
    s = d.withColumn("upto", F.sum("n").over(Window.orderBy("accident_date"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return s.filter(c("upto") > F.floor(F.lit(0.75) * c("total"))).agg(F.min("accident_date").alias("cutoff"))


@query(f"""
    with d as (select accident_date, count(*) as n from active where accident_date is not null group by 1), s as (select accident_date, sum(n) over (order by accident_date) as upto, sum(n) over () as total from d),
    cut as (select min(accident_date) as cutoff from s where upto > floor(0.75e0 * total)),
    q as (select cast(floor((lat - 12.5e0) / 0.0045e0) as bigint) as i, cast(floor((lng - 77e0) / 0.0045e0) as bigint) as j, coalesce(accident_date >= cutoff, false) as test from active cross join cut),
    h as (select i, j, count(*) filter (where not test) as old, count(*) filter (where test) as y from q group by 1, 2), r as (select y, row_number() over (order by old desc, i, j) as k, count(*) over () as n from h)
    select {sql_half_up('sum(y) filter (where k <= ceil(0.1e0 * n)) / cast(sum(y) as double)', 3)} as hit_rate from r""")
def backtest_baseline(t):
    """How many later incidents the cells with the most earlier ones hold."""
    q = cell(t.active.crossJoin(F.broadcast(cutoff_of(t)))).withColumn("test", F.coalesce(c("accident_date") >= c("cutoff"), F.lit(False)))
    h = q.groupBy("i", "j").agg(F.count_if(~c("test")).alias("score"), F.count_if("test").alias("y")).withColumn("one", F.lit(1))
    return hit_rate_of(h, 0.1, "one").select("hit_rate")


#: Dated, later and earlier incidents that a backtest needs, and the shares of cells it looks at.
DATED, LATER, EARLIER, SHARES = 40, 10, 20, {"hit5": 0.05, "hit10": 0.1}


def backtest(rows: DataFrame, cutoff: DataFrame) -> DataFrame:
    """One row: whether the model, fitted on incidents before the (one-row) cutoff and undated ones, ranks the
    cells of later incidents first: shares of these in the top 5 and 10 % of cells, beside those of a
    ranking by past counts. No row where too few incidents are dated, later or earlier."""
    placed = rows.filter(c("lat").isNotNull() & c("lng").isNotNull())
    split = placed.crossJoin(F.broadcast(cutoff)).withColumn("later", F.coalesce(c("accident_date") >= c("cutoff"), F.lit(False)))
    facts = split.agg(F.first("cutoff").alias("cutoff"), F.count("accident_date").alias("dated"), F.count_if("later").alias("test_rows"), F.count_if(~c("later")).alias("history_rows"))
    f = facts.first()  # one row of counts
    schema = "cutoff date, test_rows long, history_rows long, " + ", ".join(f"{kind}_{x} double" for kind in ("model", "baseline") for x in SHARES)
    if f["dated"] < DATED or f["test_rows"] < LATER or f["history_rows"] < EARLIER:
        return rows.sparkSession.createDataFrame([], schema)
    history = split.filter(~c("later")).drop("cutoff", "later")
    cells = cell(placed).select("i", "j").distinct()
    fit = fit_poisson(fold_rows(history, cells=cells))
    known = counts(history)
    every = known.unionByName(cells.join(known, ["i", "j"], "left_anti").select("i", "j", *[F.lit(0).cast("long").alias(x) for x in ("n", "fatal", "road")]))
    later = cell(split.filter("later")).groupBy(c("i").alias("ti"), c("j").alias("tj")).agg(F.count(F.lit(1)).alias("y"))
    scored = features(every).withColumns({"model": fit.mu(), "baseline": c("own") + F.lit(0.001) * c("ring1")}).join(later, (c("i") == c("ti")) & (c("j") == c("tj")), "left")
    scored = checkpoint(scored.select("i", "j", "model", "baseline", F.coalesce("y", F.lit(0)).alias("y"), F.lit(1).alias("one")))
    out = facts.select("cutoff", "test_rows", "history_rows")
    for kind in ("model", "baseline"):
        for name, share in SHARES.items():
            rate = hit_rate_of(scored.withColumn("score", c(kind)), share, "one").select(c("hit_rate").alias(f"{kind}_{name}"))
            out = out.crossJoin(F.broadcast(rate))
    return out


@query()
def backtest_model(t):
    """The fitted model against the last quarter of the dated incidents."""
    return backtest(t.active, cutoff_of(t)).withColumn("cutoff", c("cutoff").cast("string"))


@query()
def risk_at(t):
    """Expected incidents, index and level of every cell of the fitted model."""
    fit = fit_poisson(fold_rows(t.active))
    scored = features(counts(t.active)).withColumn("expected", fit.mu())
    r = scored.withColumn("pct", mid_rank("expected"))
    return r.select("i", "j", half_up(c("expected"), 3).alias("expected"), half_up(c("pct")).alias("risk_index"), level_of(c("pct")).alias("level"), c("own").alias("past_incidents"))


@query()
def top_risk_cells(t):
    return risk_at(t).orderBy(c("expected").desc(), "i", "j").limit(10)


@query()
def kfold_assign(t):
    return folds_of(t.active).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))
