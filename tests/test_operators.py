"""Every query with an oracle gives the same rows as its SQL; invariants and known values."""

import duckdb
import pytest

from kerbside import operators  # noqa: F401
from kerbside.plans.bindings import RAW, Tables
from kerbside.plans.registry import BUILDERS, ORACLES, callables
from kerbside.sources.incidents import decode_ewkb

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in RAW:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def shaped(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = callables()[name](spark, SF)
    want = duck.execute(ORACLES[name])
    assert shaped(got.columns, got.collect()) == shaped([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(BUILDERS) - set(ORACLES) - {"cv_folds", "top_risk_cells"}))
def test_others_give_rows(spark, name):
    assert callables()[name](spark, SF).count() > 0


def test_points():
    assert decode_ewkb("0101000020E6100000AE47E17A1466534052B81E85EBF12940")[0] == pytest.approx(12.9725, abs=1e-3)
    assert decode_ewkb("00000000014053666666666666402A000000000000") == (13.0, pytest.approx(77.6))
    assert decode_ewkb("zz") == decode_ewkb(None) == decode_ewkb("01") == (None, None)


def test_totals_agree(spark):
    t = Tables(spark, SF)
    run = callables()
    total = t.active.count()
    assert run["stats_by_area"](spark, SF).agg({"total": "sum"}).first()[0] == total
    assert run["accident_cells"](spark, SF).agg({"accidents": "sum"}).first()[0] == total
