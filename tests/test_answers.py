"""Tables of planned calls on known rows, and the same tables whatever the blocks of places."""

import datetime as dt

import pytest

from kerbside.operators import answers
from kerbside.plans.bindings import Tables

INCIDENTS = "id string, seq long, title string, area string, location string, zone string, severity string, accident_date date, hour int, lat double, lng double"
PLANS = "id long, tool string, severity string, zone string, date_from string, date_to string, hour_from int, hour_to int, place string, others string, group_by string, step string"


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def incidents(spark):
    rows = [
        ("1", 1, "Bus hits cyclist", "Koramangala", "80 Feet Road", "East", "fatal", day("2024-01-05"), 22, 12.93, 77.62), ("2", 2, "Truck overturns", "Kormangala", "80 Feet Road", "East", "minor", day("2024-02-05"), 9, 12.9301, 77.6201),
        ("3", 3, "Crash", "Hebbal", "Ring Road", "North", "serious", None, None, 13.03, 77.59), ("4", 4, "Crash", None, "Hebbal flyover", "North", "fatal", day("2025-03-01"), None, 13.0301, 77.5901), ("5", 5, "Crash", "", None, None, "minor", day("2025-03-02"), 3, 12.8, 77.5),
    ]
    return spark.createDataFrame(rows, INCIDENTS)


def tables(spark, incidents, *plans):
    every = [(n, *p) for n, p in enumerate(plans)]
    of, calls = answers.calls_of(spark.createDataFrame(every, PLANS))
    found: dict = {}
    for r in answers.tables_of(calls, incidents).collect():
        found.setdefault(r["call"], {}).setdefault(r["row_no"], {})[r["name"]] = r["value"]
    out: dict = {}
    for r in of.collect():
        shaped = dict(found.get(r["call"], {}))
        out["note", r["id"], r["step"]] = shaped.pop(0, {}).get("Note")
        out[r["id"], r["step"]] = [row for _, row in sorted(shaped.items())]
    return out


def plan(tool, severity=None, zone=None, year=None, hours=(None, None), place=None, others=None, group_by=None, step=None):
    return (tool, severity, zone, year and f"{year}-01-01", year and f"{year}-12-31", *hours, place, others, group_by, step)


def test_known_answers(spark, incidents):
    got = tables(
        spark, incidents, plan("count_incidents"), plan("count_incidents", place="Koramangala"), plan("count_incidents", zone="North", hours=(21, 5)), plan("trend", step="year"), plan("time_pattern", hours=(21, 5)),
        plan("compare_places", others="Hebbal; Koramangala; Nowhere"), plan("search_incidents", severity="fatal"), plan("rank_places", group_by="zone"), plan("hotspots", place="Hebbal"), plan("search_incidents", hours=(21, 5), zone="North"), plan("risk_forecast"),
    )
    count = lambda *n: [{"Severity": s, "Count": str(k)} for s, k in zip(("Fatal", "Serious", "Minor"), n)]
    place = lambda name, *n, head="Place": {head: name, **{k: str(v) for k, v in zip(("Total", "Fatal", "Serious", "Minor"), n)}}
    assert got[0, 1] == count(2, 1, 2) and got[0, 2] == [place("Hebbal flyover", 1, 1, 0, 0), place("Koramangala", 1, 1, 0, 0), place("Hebbal", 1, 0, 1, 0), place("Kormangala", 1, 0, 0, 1), place("Unknown", 1, 0, 0, 1)]
    assert got[1, 1] == count(1, 0, 1)  # one area is misspelt
    assert got[2, 1] == count(1, 1, 0)  # none of the North's rows has a time, so the hours go
    assert got["note", 2, 1] == "none of the 2 matching records include a time of day, so the 21:00–5:59 filter could not be applied and results cover all hours" and got["note", 0, 1] is None
    assert got[3, 1] == [{"Period": "2024", "Total": "2", "Fatal": "1"}, {"Period": "2025", "Total": "2", "Fatal": "1"}]
    assert got[4, 1] == [{"Matched": "5", "With time": "3", "With date": "4", "Peak hour": "3", "Peak day": "0"}]
    assert got[5, 1] == [place("Hebbal", 2, 1, 1, 0), place("Koramangala", 2, 1, 0, 1), place("Nowhere", 0, 0, 0, 0)]
    assert [r["Date"] for r in got[6, 1]] == ["2025-03-01", "2024-01-05"] and got[6, 1][0]["Place"] == "Hebbal flyover"
    assert got[7, 1] == [place("East", 2, 1, 0, 1), place("North", 2, 1, 1, 0), place("Unknown", 1, 0, 0, 1)]
    assert got[8, 1] == [place("Hebbal flyover", 2, 1, 1, 0, head="Spot")]
    assert got[9, 1] == [] and (10, 1) not in got  # a search keeps its hours; forecasts are the model's


def test_sentences(spark, incidents):
    calls = answers.calls_of(spark.createDataFrame([(0, *plan("count_incidents", zone="North", hours=(21, 5))), (1, *plan("rank_places", severity="fatal", year=2031, group_by="area")), (2, *plan("compare_places", others="Hebbal; Nowhere")), (3, *plan("hotspots", place="Hebbal"))], PLANS))[1]
    found = {r["call"].split("|")[0]: r["answer"] for r in answers.sentences(calls, answers.tables_of(calls, incidents)).collect()}
    note = "none of the 2 matching records include a time of day, so the 21:00–5:59 filter could not be applied and results cover all hours"
    assert found == {
        "count_incidents": f"There are 2 incidents in the North zone: 1 fatal, 1 serious and 0 minor (50% fatal). Note: {note}.", "rank_places": "No fatal incidents from 2031-01-01 to 2031-12-31 found.",
        "compare_places": "Hebbal: 2 (1 fatal, 1 serious, 0 minor); Nowhere: 0 (0 fatal, 0 serious, 0 minor).", "hotspots": 'The worst spots for incidents matching "Hebbal" (within 300 m clusters): Hebbal flyover — 2 incident(s), 1 fatal.',
    }


def test_blocks_of_places(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    calls = answers.calls_of(answers.asked_plans(t))[1]
    whole = sorted(map(tuple, answers.tables_of(calls, t.active).collect()), key=str)
    monkeypatch.setattr(answers, "PLACE_BLOCK", 4)
    assert sorted(map(tuple, answers.tables_of(calls, t.active).collect()), key=str) == whole and len(whole) > 100


def test_empty_tables(spark, incidents):
    assert tables(spark, incidents.limit(0), plan("count_incidents"), plan("trend", step="year"))[0, 1][0] == {"Severity": "Fatal", "Count": "0"}
    assert answers.tables_of(answers.calls_of(spark.createDataFrame([], PLANS))[1], incidents).count() == 0
