"""Escalation against a plain loop, questions and hospital names against known answers."""

import math

import pytest

from kerbside.operators.facilities import hospital_levels
from kerbside.operators.questions import find_places, known_places, plans
from kerbside.operators.response import PENALTY, escalations
from kerbside.plans.bindings import Tables

SF = "/root/testdata/sf0.001"


def km(a, b):
    s = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 6371.0 * 2.0 * math.atan2(math.sqrt(s), math.sqrt(1 - s))


def up(x):
    return math.floor(x * 10 + 0.5) / 10


def loop(alert, hospitals):
    """Rounds of (hospital, score), one after another."""
    picked, rounds = [], []
    while len(rounds) < 3:
        left = [h for h in hospitals if h["emergency_level"] != "none" and h["id"] not in {p["id"] for p in picked}]
        left.sort(key=lambda h: (km((alert["lat"], alert["lng"]), (h["lat"], h["lng"])), h["id"]))
        pool = left[:15] + ([h for h in left if h["emergency_level"] == "trauma"][:2] if alert["priority"] == "critical" else [])
        scored = sorted({(up(up(km((alert["lat"], alert["lng"]), (h["lat"], h["lng"])) * 1.35 / 24 * 60) + PENALTY.get((alert["priority"], h["emergency_level"]), 10) + (8 if h["er_status"] == "busy" else 0)), h["id"]) for h in pool if h["er_status"] != "diverting"})
        now = []
        for score, i in scored:
            h = next(x for x in hospitals if x["id"] == i)
            if len(now) < 3 and all(km((h["lat"], h["lng"]), (p["lat"], p["lng"])) >= 0.25 for p in picked):
                now.append((i, score))
                picked.append(h)
        if not now:
            break
        rounds.append(now)
    return rounds


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_rounds_of_escalation(spark, sf):
    t = Tables(spark, sf)
    hospitals = [r.asDict() for r in t.hospitals.collect()]
    alerts = t.alerts.filter("status = 'new' and id % 7 = 0").limit(60)
    alerts = spark.createDataFrame(alerts.collect(), alerts.schema)
    got: dict = {}
    for r in escalations(alerts, t.hospitals).orderBy("alert_id", "round_no", "place").collect():
        rounds = got.setdefault(r["alert_id"], [])
        if len(rounds) < r["round_no"]:
            rounds.append([])
        rounds[-1].append((r["hospital_id"], r["rank_score"]))
    assert got == {a["id"]: x for a in alerts.collect() if (x := loop(a, hospitals))}


PLACES = ("Hebbal", "Koramangala", "Silk Board", "Board", "hebbal", "Road")
ASKED = {
    "How many fatal accidents in Hebbal in 2025?": {"tool": "count_incidents", "severity": "fatal", "place": "Hebbal", "date_from": "2025-01-01", "date_to": "2025-12-31"},
    "worst junctions in Kormangala": {"tool": "hotspots", "place": "Koramangala"},
    "Compare Hebbal vs Silk Board": {"tool": "compare_places", "others": "Silk Board; Hebbal", "place": None},
    "accidents between 6 and 9 pm": {"tool": "count_incidents", "hour_from": 18, "hour_to": 21},
    "crashes after 9 pm": {"hour_from": 21, "hour_to": 5},
    "anything past 5": {"hour_from": 17, "hour_to": 5},
    "between 12 am and 4 am": {"hour_from": 0, "hour_to": 4},
    "most dangerous places in the east zone": {"tool": "rank_places", "zone": "East", "group_by": "zone"},
    "monthly trend": {"tool": "trend", "step": "month"},
    "late night list": {"tool": "search_incidents", "hour_from": 21, "hour_to": 5},
    None: {"tool": "count_incidents", "place": None},
}


def test_plans_of_known_questions(spark):
    places = known_places(spark.createDataFrame([(x,) for x in PLACES], "area string"))
    asked = spark.createDataFrame(list(enumerate(ASKED)), "id long, text string")
    got = {r["id"]: r.asDict() for r in plans(asked, places).collect()}
    for i, want in enumerate(ASKED.values()):
        assert {k: got[i][k] for k in want} == want, list(ASKED)[i]
    assert find_places(asked.limit(0), places).count() == 0


def test_levels_of_known_hospitals(spark):
    names = {
        "Victoria Hospital": ("hospital", "trauma", "curated"), "St. John's Medical College": ("hospital", "trauma", "curated"), "Sagar Hospital": ("hospital", "emergency", "curated"), "Fortis OPD": ("hospital", "none", "name-rule"),
        "Narayana Nethralaya": ("eye", "none", "name-rule"), "City 24x7": ("hospital", "emergency", "name-rule"), "Plain Care": ("hospital", "general", "name-rule"), "Smile Dental": ("dental", "none", "name-rule"), "NIMHANS": ("hospital", "trauma", "curated"),
    }
    rows = spark.createDataFrame([(x, None, None) for x in names], "name string, emergency_tag string, beds int")
    assert {r["name"]: (r["facility_type"], r["level"], r["level_source"]) for r in hospital_levels(rows).collect()} == names
