"""Merging of reports and of hospitals against loops over the rows, one by one."""

import datetime as dt
import math
import random

import pytest

from kerbside.operators import merging

SOS = "id long, created_at timestamp, lat double, lng double, is_drill boolean, injured string, conscious string, breathing string, bleeding string, trapped string, fire string, reported_severity string, vehicles string, called_108 boolean, note string, closed timestamp"
HOSPITAL = "id long, name string, phone string, address string, osm_type string, beds int, operator_type string, emergency_tag string, emergency_level string, level_source string, lat double, lng double"


def metres(a, b):
    s = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return math.floor(6371.0 * 2.0 * math.atan2(math.sqrt(s), math.sqrt(1 - s)) * 1e6 + 0.5) / 1e3


@pytest.fixture(scope="module")
def reports():
    draw, t0 = random.Random(5), dt.datetime(2024, 5, 1)
    tri = lambda: draw.choice(["yes", "no", "unknown", "unknown", None])
    rows = []
    for i in range(900):
        crowd = i % 3 == 0  # a third of all rows stand at one place
        lat, lng = (12.9, 77.6) if crowd else (12.9 + draw.random() * 0.02, 77.6 + draw.random() * 0.02)
        at = t0 + dt.timedelta(seconds=draw.randrange(0, 6 * 3600))
        closed = at + dt.timedelta(minutes=draw.choice([2, 40])) if draw.random() < 0.3 else None
        vehicles = ",".join(draw.choices(["car", "auto", "tank", "cycle", "other", "two_wheeler", "bus_truck", "pedestrian"], k=draw.randint(0, 4)))
        note = draw.choice([None, "", "x" * draw.randint(1, 300), "é\U0001f600 fell"])
        rows.append((i, at, lat, lng, draw.choice([True, False, False, None]), draw.choice(["0", "1", "2", "3+", "unknown", None]), tri(), tri(), tri(), tri(), tri(), draw.choice(["fatal", "serious", "minor", None]), vehicles, draw.choice([True, False]), note, closed))
    return rows + [(2000, t0, None, 77.6, False, *rows[0][5:]), (2001, None, 12.9, 77.6, False, *rows[0][5:])]


def replay(rows):
    """(alert of each report, reports of each alert in order)."""
    alone = [r for r in rows if None in r[1:4]]
    alerts, into = [], {r[0]: r[0] for r in alone}
    for r in sorted((r for r in rows if None not in r[1:4]), key=lambda r: (r[1], r[0])):
        open_ones = [a for a in alerts if bool(a[4]) == bool(r[4]) and dt.timedelta(0) <= r[1] - a[1] <= dt.timedelta(minutes=15) and (a[15] is None or a[15] > r[1]) and metres(a[2:4], r[2:4]) <= 200]
        if open_ones:
            into[r[0]] = min(open_ones, key=lambda a: (metres(a[2:4], r[2:4]), a[1], a[0]))[0]
        else:
            alerts.append(r)
            into[r[0]] = r[0]
    return into


def test_reports_equal_replay(spark, reports):
    df = spark.createDataFrame(reports, SOS)
    from pyspark.sql import functions as F

    got = {r["id"]: r["alert_id"] for r in merging.merged_into(df, closed_at=F.col("closed")).collect()}
    want = replay(reports)
    assert got == want and len(set(want.values())) < 0.8 * len(want)
    assert merging.merged_into(df.limit(0)).count() == 0


def fold(rows):
    """The state of an alert after its reports, each in turn."""
    ranks = {"unknown": -1, "0": 0, "1": 1, "2": 2, "3+": 3}
    state = None
    for r in rows:
        t = {"injured": r[5] or "unknown", **{q: v or "unknown" for q, v in zip(merging.GRAVE, r[6:11])}}
        seen = list(dict.fromkeys(v for v in r[12].split(",") if v in merging.VEHICLES))[:6]
        if state is None:
            state = {**t, "vehicles": seen, "called_108": r[13], "level": 9, "n": 0, "note": ""}
        else:
            if ranks[t["injured"]] > ranks[state["injured"]]:
                state["injured"] = t["injured"]
            for q, bad in merging.GRAVE.items():
                a, b = state[q], t[q]
                state[q] = bad if bad in (a, b) else a if a != "unknown" else b
            state["vehicles"] = list(dict.fromkeys(state["vehicles"] + seen))[:6]
            state["called_108"] |= r[13]
        if any(state[q] == bad for q, bad in merging.GRAVE.items()) or state["injured"] == "3+" or r[11] == "fatal":
            level = 0
        else:
            level = 2 if state["injured"] == "0" or (r[11] == "minor" and state["injured"] != "2") else 1
        state["level"], state["n"] = min(state["level"], level), state["n"] + 1
        if r[14]:
            state["note"] = (state["note"] + "\n— " + r[14])[:1500] if state["note"] else r[14]
    return (state["injured"], *(state[q] for q in merging.GRAVE), state["called_108"], merging.PRIORITIES[state["level"]], state["n"], ",".join(state["vehicles"]), state["note"] or None)


def test_alerts_equal_fold(spark, reports):
    rows = [r for r in reports if r[1] is not None]
    df = spark.createDataFrame(rows, SOS)
    into = replay([(*r[:15], None) for r in rows])
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        groups.setdefault(into[r[0]], []).append(r)
    found = merging.merged_alerts(df, merging.merged_into(df)).collect()
    got = {r["alert_id"]: (r["injured"], *(r[q] for q in merging.GRAVE), r["called_108"], r["priority"], r["report_count"], r["vehicles"], r["note"]) for r in found}
    assert got == {k: fold(v) for k, v in groups.items()}


def clustered(rows, radius=250.0):
    full = lambda r: 2 * bool(r[2]) + bool(r[3]) + (r[4] in ("way", "relation")) + bool(r[7]) + bool(r[5])
    order = sorted(rows, key=lambda r: (-full(r), r[0]))
    kept = []
    for r in order:
        near = next((k for k in kept if k["name"].lower() == r[1].lower() and None not in (r[10], r[11], k["lat"], k["lng"]) and metres((k["lat"], k["lng"]), r[10:12]) <= radius), None)
        if near is None:
            kept.append({"id": r[0], "name": r[1], "phone": r[2] or None, "address": r[3] or None, "beds": r[5] or None, "operator_type": r[6] or None, "emergency_level": r[8], "level_source": r[9], "lat": r[10], "lng": r[11], "merged": 0})
            continue
        near["merged"] += 1
        for name, at in (("phone", 2), ("address", 3), ("beds", 5), ("operator_type", 6)):
            near[name] = near[name] or r[at] or None
        if merging.LEVELS.index(r[8]) < merging.LEVELS.index(near["emergency_level"]):
            near["emergency_level"], near["level_source"] = r[8], r[9]
    return sorted((k["id"], k["name"], k["phone"], k["address"], k["beds"], k["operator_type"], k["emergency_level"], k["level_source"], k["merged"]) for k in kept)


def test_hospitals_equal_loop(spark):
    draw = random.Random(8)
    maybe = lambda *xs: draw.choice([None, "", *xs])
    rows = [(i, draw.choice(["Ward 12", "Ward 99", "City"]), maybe("1", "2"), maybe("a"), draw.choice(["way", "node", None]), draw.choice([None, 0, 20]), maybe("p", "g"), maybe("yes"), draw.choice(merging.LEVELS), draw.choice(["osm", "curated"]), 12.89 + draw.random() * 0.02, 77.6 + draw.random() * 0.02) for i in range(700)]
    rows += [(900, "Edge", "1", None, None, None, None, None, "none", "osm", 12.8999, 77.6), (901, "edge", None, "b", None, 7, None, None, "trauma", "curated", 12.9001, 77.6)]  # 22 m apart, on both sides of 12.9
    rows += [(902, "Edge", None, None, None, None, None, None, "general", "osm", None, 77.6)]
    rows += [(1000 + i, "Crowd", None, None, None, i, None, None, "general", "osm", 12.95, 77.7) for i in range(400)]
    found = merging.merged_hospitals(spark.createDataFrame(rows, HOSPITAL))
    got = sorted((r["id"], r["name"], r["phone"], r["address"], r["beds"], r["operator_type"], r["emergency_level"], r["level_source"], r["merged"]) for r in found.collect())
    assert got == clustered(rows)
    assert {r[0] for r in got} & {900, 901, 902} == {901, 902} or {r[0] for r in got} & {900, 901, 902} == {900, 902}
    assert merging.merged_hospitals(spark.createDataFrame([], HOSPITAL)).count() == 0
