"""Work that must not follow the samples, crowds or copies of larger tables: rows that shuffles write."""

import random

from kerbside.operators import answers, integrity, leaders, merging, response, safe_routes, spatial
from kerbside.streaming.in_order import replay


def shuffled_rows(spark, run):
    """What ``run`` returns, and the rows that its shuffles wrote."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = written()
    out = run()
    return out, sum(n for k, n in written().items() if k not in before)


def line_table(spark, trips, alts=2):
    """Routes of about 20 km; all lines of a trip differ."""
    draw = random.Random(trips)
    rows = [(trip * alts + n, trip, n, 12.85 + draw.random() * 0.05, 77.45 + draw.random() * 0.05, 12.98 + draw.random() * 0.05, 77.58 + draw.random() * 0.05) for trip in range(trips) for n in range(alts)]
    return spark.createDataFrame(rows, "id long, trip long, alt int, lat1 double, lng1 double, lat2 double, lng2 double")


def test_overlaps_shuffle_routes_and_no_samples(spark):
    routes = line_table(spark, 5)
    got, rows = shuffled_rows(spark, lambda: spatial.overlaps(routes.union(routes.selectExpr("id + 100", "trip", "alt", "lat1", "lng1", "lat2", "lng2"))).collect())
    shares = {(r["route_id"], r["other"]): r["share"] for r in got}
    assert shares[0, 100] == shares[103, 3] == 1.0
    assert rows < 500


def test_lines_of_many_trips_are_compared_once(spark):
    one = line_table(spark, 1)
    many = one.crossJoin(spark.range(500).withColumnRenamed("id", "t")).selectExpr("t * 10 + id as id", "t as trip", "lat1", "lng1", "lat2", "lng2")
    got, rows = shuffled_rows(spark, lambda: spatial.overlaps(many).groupBy("share").count().collect())
    assert [r["count"] for r in got] in ([1000], [500, 500]) and rows < 12_000


class Given:
    """Routes and incidents as the tables that queries read."""

    def __init__(self, spark, copies):
        self.routes = line_table(spark, 2).crossJoin(spark.range(copies).withColumnRenamed("id", "t")).selectExpr("t * 10 + id as id", "t * 10 + trip as trip", "alt", "lat1", "lng1", "lat2", "lng2")
        self.active = spark.createDataFrame([(12.85 + n * 0.002, 77.45 + n * 0.002, "fatal" if n % 3 else "minor") for n in range(60)], "lat double, lng double, severity string")


def taken_by_all(spark, build, copies=120):
    """Rows of ``build`` for so many copies of four routes, each with the copy it is of, in the order of routes;
    the routes' lines are sampled once, so that shuffles write fewer rows than copies of samples."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, rows = shuffled_rows(spark, lambda: build(Given(spark, copies)).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows < 12_000
    return got


def test_scores_sample_lines_and_not_their_routes(spark):
    got = taken_by_all(spark, spatial.route_scores)
    assert len(got) == 480 and len({(r["route_id"] % 10, r["incidents"], r["exposure"]) for r in got}) == 4 and any(r["incidents"] for r in got)


def test_choices_sample_lines_and_not_their_routes(spark):
    got = taken_by_all(spark, spatial.choose_safest)
    assert len(got) == 240 and len({(r["trip"] % 10, r["chosen"] % 10, r["reduction_pct"]) for r in got}) == 2


def test_exposures_sample_lines_and_not_their_routes(spark):
    got = taken_by_all(spark, spatial.route_exposure)
    assert len(got) == 120 * len({(r["route_id"] % 10, r["lat"], r["m"]) for r in got}) > 0


def test_distances_sample_lines_and_not_their_routes(spark):
    got = taken_by_all(spark, spatial.point_segment_distance)
    assert len(got) == 120 * len({(r["route_id"] % 10, r["near"], r["closest_m"]) for r in got}) > 0


def drives_of(spark, copies):
    draw = random.Random(4)
    ends = [(12.9 + draw.random() * 0.05, 77.5 + draw.random() * 0.05, 12.98 + draw.random() * 0.02, 77.6 + draw.random() * 0.02) for _ in range(4)]
    points = [(t, 0, k, *(e[:2] if k == 0 else e[2:])) for t, e in enumerate(ends) for k in (0, 1)]
    return spark.createDataFrame(points, "trip long, alt int, seq int, lat double, lng double").crossJoin(spark.range(copies)).selectExpr("id * 10 + trip as trip", "alt", "seq", "lat", "lng")


class Driven(Given):
    def __init__(self, spark, copies):
        super().__init__(spark, 1)
        self.drives = drives_of(spark, copies)


def test_trips_of_the_same_lines_are_suggested_once(spark, monkeypatch):
    monkeypatch.setattr(safe_routes, "past_model", lambda t: spark.createDataFrame([(80, 120, 1.5, "high")], "i long, j long, expected double, level string"))
    got, rows = shuffled_rows(spark, lambda: safe_routes.safe_routes(Driven(spark, 200)).drop("alt").collect())
    assert len(got) == 2400 and len({(r["trip"] % 10, *r[1:]) for r in got}) == 12
    assert rows < 40_000


def test_summaries_of_the_same_lines_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(safe_routes, "past_model", lambda t: spark.createDataFrame([(80, 120, 1.5, "high")], "i long, j long, expected double, level string"))
    got, rows = shuffled_rows(spark, lambda: safe_routes.safe_route_summaries(Driven(spark, 200)).collect())
    assert len(got) == 800 and len({(r["trip"] % 10, r["routes"], r["summary"]) for r in got}) == 4
    assert rows < 40_000


class Alarmed:
    """Alerts at three places, and hospitals at five."""

    def __init__(self, spark, copies):
        self.alerts = spark.range(copies).selectExpr("id", "if(id % 50 = 7, null, 'critical') as priority", "'new' as status", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as created_at", "12.9 + id % 3 * 0.01 as lat", "77.5 as lng")
        self.alerts = self.alerts.selectExpr("id", "priority", "status", "created_at", "cast(lat as double) lat", "cast(lng as double) lng")
        self.hospitals = spark.range(30).selectExpr("id", "if(id % 2 = 0, 'trauma', 'general') as emergency_level", "if(id % 9 = 0, 'diverting', 'accepting') as er_status", "cast(12.9 + id % 5 * 0.01 as double) lat", "cast(77.51 as double) lng")


def test_alerts_of_one_place_are_planned_once(spark):
    got, rows = shuffled_rows(spark, lambda: response.escalation_plan(Alarmed(spark, 1500)).collect())
    assert {r["alert_id"] for r in got} == set(range(1500)) and max(r["place"] for r in got) == 3
    assert len({(r["alert_id"] % 3, r["alert_id"] % 50 == 7, r["round_no"], r["place"], r["hospital_id"], r["rank_score"]) for r in got}) == len([r for r in got if r["alert_id"] in (0, 1, 2, 7, 57, 107)])
    assert rows < 12_000


def test_alerts_of_one_place_end_alike(spark):
    got, rows = shuffled_rows(spark, lambda: response.escalation_outcome(Alarmed(spark, 1500)).collect())
    plan = response.escalation_plan(Alarmed(spark, 150)).groupBy("alert_id").agg({"round_no": "max", "*": "count", "due_at": "max"}).collect()
    first = {r["alert_id"]: (r["rounds"], r["notified"], r["exhausted_at"]) for r in got}
    assert len(got) == 1500 and all(first[r["alert_id"]] == (r["max(round_no)"], r["count(1)"], r["max(due_at)"]) for r in plan)
    assert rows < 12_000


def test_hashes_are_dealt_out_seven_times(spark):
    hashes = spark.range(3000).selectExpr("id", "xxhash64(id div 2, 7L) ^ if(id % 2 = 1, 5L << cast(id % 50 as int), 0L) as hash")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, rows = shuffled_rows(spark, lambda: integrity.near_hashes(hashes).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r["a_id"], r["b_id"], r["distance"]) for r in got} >= {(n, n + 1, 2) for n in range(0, 3000, 2)}
    assert rows < 30_000


def test_machines_of_many_keys_share_a_call(spark):
    calls = spark.sparkContext.accumulator(0)

    def machine(state, at, event):
        state["n"] = state.get("n", 0) + 1
        if event["rank"] == 0:
            calls.add(1)
        return [(at, state["n"], event["rank"] or None)]

    log = spark.range(6000).selectExpr("id div 3 as key", "timestamp_seconds(3 - id % 3) as at_ts", "cast(id % 3 as int) as rank").coalesce(1)
    seen = replay(log, machine, "key", "key long, at_ms long, n int, rank long", "2100-01-01", "rank")
    assert {tuple(r) for r in seen.collect()} == {(k, (3 - n) * 1000, 3 - n, n or None) for k in range(2000) for n in range(3)}
    assert calls.value == 2000 and "FlatMapGroups" not in seen._jdf.queryExecution().toString()


def reports(spark, n):
    rows = spark.range(n).selectExpr("id", "12.9 + id % 4 * 0.01 + hash(id, 1) % 3 * 0.001 as lat", "77.5 + hash(id, 2) % 3 * 0.001 as lng", "cast(timestamp_seconds(1700000000 + id * 60) as timestamp_ntz) as created_at", "id % 9 = 0 as is_drill")
    return rows.selectExpr("id", "cast(lat as double) lat", "cast(lng as double) lng", "if(id % 400 > 300, created_at + interval 30 days, created_at) as created_at", "is_drill")


def test_quiet_neighbourhoods_need_no_rounds(spark, monkeypatch):
    """The loop over small groups and the rounds elect alike, and without crowds there are no rounds."""
    asked, met = [], leaders.Near.met
    monkeypatch.setattr(leaders.Near, "met", lambda *x, **y: asked.append(1) or met(*x, **y))
    by_loop = {tuple(r) for r in merging.merged_into(reports(spark, 400)).collect()}
    assert len(asked) == 1
    monkeypatch.setattr(leaders, "SMALL_GROUP", 0)
    assert {tuple(r) for r in merging.merged_into(reports(spark, 400)).collect()} == by_loop and len(asked) > 4
    assert len(by_loop) == 400 and 20 < len({a for _, a in by_loop}) < 400


def test_questions_of_the_same_words_are_planned_once(spark):
    class Asked:
        active = spark.createDataFrame([("Hosa Road",), ("Area 3",)], "area string")
        asked = spark.range(4000).selectExpr("id", "concat('How many fatal accidents in Area 3 in 202', id % 3, ' after 9 pm?') as text")

    got, rows = shuffled_rows(spark, lambda: answers.distinct_calls(Asked).collect())
    assert {(r["tool"], r["place"], r["year"], r["hours"]) for r in got} == {("count_incidents", "Area 3", f"202{k}", "21-5") for k in range(3)}
    assert len(got) == 3 and rows < 1000
