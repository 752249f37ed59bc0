"""Per-row operators take every row, and searches every vector of the query set."""

import duckdb
import pytest

from kerbside import operators  # noqa: F401
from kerbside.plans.bindings import Tables
from kerbside.plans.registry import ORACLES, callables

SF = "/root/testdata/sf0.001"


def test_points_of_every_event(spark):
    ids = {r["event_id"] for r in Tables(spark, SF).events.select("event_id").collect()}
    wkt = {r["id"]: (r["lat"], r["lng"]) for r in callables()["parse_wkt_point"](spark, SF).collect()}
    assert wkt == {i: (i % 90 + 0.25, i % 170 + 0.75) for i in ids}
    ewkb = {r["id"]: r["lat"] for r in callables()["parse_ewkb_point"](spark, SF).collect()}
    assert set(ewkb) == ids
    assert all(v == pytest.approx(12.9725 if i % 2 == 0 else 13.0, abs=1e-3) for i, v in ewkb.items())


def test_every_report_is_replicated(spark):
    times = {"fatal": 3, "serious": 2, "minor": 1}
    want = sorted((r["id"], n + 1) for r in Tables(spark, SF).active.collect() for n in range(times[r["severity"]]))
    assert sorted(tuple(r) for r in callables()["weighted_replicate"](spark, SF).collect()) == want


def test_query_set_of_searches(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = sorted(con.execute(ORACLES["cosine_topk"]).fetchall())
    got = sorted(tuple(r) for r in callables()["cosine_topk"](spark, SF).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])
    assert {r[0] for r in got} == {r["vec_id"] for r in Tables(spark, SF).embeddings.filter("vec_id % 50 = 0").collect()}
