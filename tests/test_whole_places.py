"""Place queries over all rows, against the SQL without its filter and against plain products."""

import math
import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbside import operators  # noqa: F401
from kerbside.functions.geo import haversine_km
from kerbside.operators import risk, spatial
from kerbside.operators.spatial import duplicate_counts, merge_candidates, near_counts, nearest_by_cells, overlaps, unlike_routes
from kerbside.plans.bindings import RAW, Tables
from kerbside.plans.registry import ORACLES, callables

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def nearest(points, places, k):
    """All points with all places, cut by rank."""
    km = haversine_km(F.col("p_lat"), F.col("p_lng"), F.col("h_lat"), F.col("h_lng"))
    order = Window.partitionBy("p_id").orderBy("km", "h_id")
    return points.crossJoin(places).withColumn("km", km).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def rows_of(sql, folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in RAW:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("name, relation, key, where", [("rank_candidates", "alerts", "alert_id", "status = 'new'"), ("drive_time_matrix", "alerts", "alert_id", "status = 'new' and priority = 'critical'")])
def test_all_rows(spark, name, relation, key, where):
    got = callables()[name](spark, SF).select(key).distinct().count()
    assert got == getattr(Tables(spark, SF), relation).filter(where).count()


def test_matrix_has_every_pair(spark):
    """Far hospitals too: no pool, and no level but none, leaves any out."""
    t = Tables(spark, SF)
    alerts = t.alerts.filter("status = 'new' and priority = 'critical'").selectExpr("id", "lat", "lng", "hour(created_at + interval 330 minutes) as hour").collect()
    hospitals = t.hospitals.filter("emergency_level != 'none'").collect()
    got = {(r["alert_id"], r["hospital_id"]): r["eta_min"] for r in callables()["drive_time_matrix"](spark, SF).collect()}
    assert len(got) == len(alerts) * len(hospitals) and len(hospitals) > 17
    rad = math.radians
    for a in alerts:
        factor = 1.5 if a["hour"] in (8, 9, 10, 17, 18, 19, 20) else 1.25 if 11 <= a["hour"] < 17 else 1.0 if a["hour"] >= 22 or a["hour"] < 6 else 1.15
        for b in hospitals:
            half = math.sin(rad(b["lat"] - a["lat"]) / 2) ** 2 + math.cos(rad(a["lat"])) * math.cos(rad(b["lat"])) * math.sin(rad(b["lng"] - a["lng"]) / 2) ** 2
            assert abs(got[a["id"], b["id"]] - 2 * 6371 * math.asin(math.sqrt(half)) * 1.35 / 24 * 60 * factor) < 0.0501


def test_matrix_counts_each_row_and_place(spark):
    """Hospitals of one place, and one without a position, have their cells; so has an alert without one."""
    day = "timestamp '2024-01-01 00:00:00'"
    alerts = spark.sql(f"select * from values (1L, 12.9D, 77.5D, 'new', 'critical', {day}), (2L, null, 77.5D, 'new', 'critical', {day}), (3L, 12.9D, 77.5D, 'new', 'urgent', {day}), (4L, 12.9D, 77.5D, 'closed', 'critical', {day}) as v(id, lat, lng, status, priority, created_at)")
    hospitals = spark.sql("select id, if(id = 30, null, if(id > 20, 40D, 12.9D)) as lat, 77.5D as lng, case id % 4 when 0 then 'trauma' when 1 then 'none' when 2 then 'general' else 'emergency' end as emergency_level from range(40)")
    got = {(r["alert_id"], r["hospital_id"]): r["eta_min"] for r in spatial.drive_time_matrix(SimpleNamespace(alerts=alerts, hospitals=hospitals)).collect()}
    open_doors = [i for i in range(40) if i % 4 != 1]
    assert sorted(got) == [(a, i) for a in (1, 2) for i in open_doors]
    assert [i for i in open_doors if got[1, i] is None] == [30] and all(got[2, i] is None for i in open_doors)
    assert all(got[1, i] == 0 for i in open_doors if i <= 20) and got[1, 39] > 10000


def test_every_report_has_its_neighbours(spark):
    got = sorted(tuple(r) for r in callables()["near_candidates"](spark, SMALL).collect())
    assert got == rows_of(ORACLES["near_candidates"], SMALL) and len(got) > 0.9 * Tables(spark, SMALL).active.count()


def test_every_open_alert_is_picked_for(spark):
    open_alerts = {r["id"] for r in Tables(spark, SMALL).alerts.filter("status = 'new'").collect()}
    assert {r["alert_id"] for r in callables()["campus_greedy_pick"](spark, SMALL).collect()} == open_alerts


@pytest.mark.parametrize("k, n", [(15, 300), (2, 40), (5, 3), (1, 1)])
def test_nearest_by_cells_is_exact(spark, k, n):
    draw = random.Random(k)
    at = lambda: draw.choice([(draw.uniform(12.8, 13.1), draw.uniform(77.4, 77.7)), (12.9 + draw.randrange(3) * 0.009, 77.5), (draw.uniform(-40, 60), draw.uniform(60, 90))])
    points = spark.createDataFrame([(i, *at()) for i in range(120)] + [(999, None, 77.5)], "p_id long, p_lat double, p_lng double")
    places = spark.createDataFrame([(i, *at()) for i in range(n)], "h_id long, h_lat double, h_lng double")
    shaped = lambda df: sorted((r["p_id"], r["place"], r["h_id"], r["km"]) for r in df.collect())
    assert shaped(nearest_by_cells(points, places, k)) == shaped(nearest(points.filter("p_lat is not null"), places, k))


def test_candidates_follow_points_not_places(spark):
    """Four times the places, three quarters of them in one spot, leave what a point meets alike."""
    draw, met = random.Random(5), []
    points = spark.createDataFrame([(i, 12.9 + draw.random() * 0.1, 77.5 + draw.random() * 0.1) for i in range(200)], "p_id long, p_lat double, p_lng double")
    for n in (2000, 8000):
        rows = [(i, *((12.95 + draw.random() * 1e-4, 77.55) if i % 4 else (12.9 + draw.random() * 0.1, 77.5 + draw.random() * 0.1))) for i in range(n)]
        places = spark.createDataFrame(rows, "h_id long, h_lat double, h_lng double")
        got = nearest_by_cells(points, places, 5)
        assert got.count() == 1000
        size = 0.1 * (5 / n) ** 0.5 / 2
        first = spatial.cell(points, size, "p_lat", "p_lng").join(spatial.ring(spatial.cell(places, size, "h_lat", "h_lng")), ["i", "j"])
        met.append(first.count())
    assert met[1] < 2.5 * met[0]


@pytest.mark.parametrize("rows, want", [(30, 0), (400, 1)])
def test_backtest_gates_and_exact_fit(spark, rows, want):
    draw = random.Random(rows)
    data = [(str(i), f"t{i}", "Ring Road" if i % 3 else "x", "Area", draw.choice(["fatal", "minor"]), 12.9 + draw.gauss(0, 0.01), 77.6 + draw.gauss(0, 0.01), f"2024-{1 + i % 12:02d}-10" if i % 8 else None) for i in range(rows)]
    df = spark.createDataFrame(data, "id string, title string, location string, area string, severity string, lat double, lng double, day string").withColumn("accident_date", F.col("day").cast("date"))
    cutoff = spark.createDataFrame([("2024-10-01",)], "d string").select(F.col("d").cast("date").alias("cutoff"))
    found = risk.backtest(df, cutoff).collect()
    assert len(found) == want
    if want:
        r = found[0]
        later = [x for x in data if x[7] and x[7] >= "2024-10-01"]
        assert (r["test_rows"], r["history_rows"]) == (len(later), rows - len(later)) and 0 < r["model_hit10"] <= 1 and r["model_hit5"] <= r["model_hit10"]
        history = df.filter("accident_date is null or accident_date < date'2024-10-01'")
        pdf = risk.fold_rows(history, cells=spatial.cell(df).select("i", "j").distinct()).toPandas()
        x = np.column_stack([np.ones(len(pdf)), pdf[list(risk.FEATURES)].astype(float)])
        y, b = pdf["y"].to_numpy(float), np.zeros(len(risk.FEATURES) + 1)
        b[0] = math.log(y.mean())
        # MLlib scales the penalty by each feature's variance; the same there and here
        ridge = np.diag([0.0, *(risk.PENALTY * x[:, 1:].std(axis=0, ddof=1) ** 2)])
        fit = risk.fit_poisson(spark.createDataFrame(pdf)).beta
        plain = np.diag([0.0] + [risk.PENALTY] * len(risk.FEATURES))
        gradient = lambda beta, pen: x.T @ (y - np.exp(x @ beta)) - pen @ beta
        assert min(np.abs(gradient(fit, plain)).max(), np.abs(gradient(fit, ridge)).max()) < 1e-2 * y.sum()


def test_near_counts_brute(spark):
    rows = [(1, 12.9, 77.5, "2024-01-01"), (2, 12.9, 77.5, "2024-01-03"), (3, 12.9, 77.5, "2024-01-04"), (4, 12.9, 77.5, None), (5, 12.912, 77.5, "2024-01-02"), (6, 12.95, 77.5, "2024-01-01"), (7, 12.95, 77.5, None), (8, 13.2, 77.5, None)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double, day string").selectExpr("id", "lat", "lng", "cast(day as date) accident_date")
    assert sorted(tuple(r) for r in near_counts(df, 1500.0, 2).collect()) == [(1, 3), (2, 4), (3, 3), (4, 4), (5, 4), (6, 1), (7, 1)]


def test_duplicate_counts_brute(spark):
    draw = random.Random(3)
    rows = [(i, 12.9 + draw.randrange(4) * 0.001, 77.5 + draw.randrange(3) * 0.001, draw.choice(["2024-01-01", "2024-01-02", None])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double, day string").selectExpr("id", "lat", "lng", "cast(day as date) accident_date")
    km = lambda a, b: 6371 * 2 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))
    want = {a[0]: sum(a[0] != b[0] and a[3] == b[3] and km(a, b) <= 0.3 for b in rows) for a in rows}
    assert dict(map(tuple, duplicate_counts(df).collect())) == {i: n for i, n in want.items() if n}


def test_merges_keep_to_the_default_window(spark):
    rows = [(1, 12.9, 77.5, "2024-01-01 00:00:00"), (2, 12.901, 77.5, "2024-01-01 00:14:00"), (3, 12.9, 77.5, "2024-01-01 00:15:00"), (4, 12.91, 77.5, "2024-01-01 00:16:00"), (5, 12.9, 77.5, "2024-01-01 00:31:00")]
    df = spark.createDataFrame(rows, "id long, lat double, lng double, at string").selectExpr("id", "lat", "lng", "cast(at as timestamp) created_at", "false is_drill")
    assert sorted(map(tuple, merge_candidates(df).collect())) == [(2, 1), (3, 1)]
    assert sorted(map(tuple, merge_candidates(df, 2000.0, 60).collect())) == [(2, 1), (3, 1), (4, 2), (5, 1)]


def test_routes_that_share_their_way_are_one(spark):
    line = [(1, 7, 12.9, 77.5, 12.95, 77.55), (2, 7, 12.9, 77.5, 12.95, 77.55), (3, 7, 12.9, 77.5, 12.95, 77.45), (4, 8, 12.9, 77.5, 12.95, 77.55), (5, 7, 12.95, 77.45, 12.9, 77.5)]
    routes = spark.createDataFrame(line, "id long, trip long, lat1 double, lng1 double, lat2 double, lng2 double")
    shares = {(r["route_id"], r["other"]): r["share"] for r in overlaps(routes).collect()}
    assert shares[1, 2] == shares[2, 1] == 1.0 and shares[3, 5] == 1.0 and 0 < shares[1, 3] < 0.1 and (1, 4) not in shares
    assert sorted(map(tuple, unlike_routes(routes, overlaps(routes)).collect())) == [(7, 1), (7, 3), (8, 4)]
