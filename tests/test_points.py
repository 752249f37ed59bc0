"""Points that are set by id, against a dictionary."""

from kerbside.operators.snapshots import set_points


def test_last_point_of_an_id_counts(spark):
    rows = [("a", 1.0, 2.0), ("b", None, None), ("b", 5.0, 6.0), ("c", 7.0, 8.0), (None, 9.0, 9.0), ("d", 3.0, 3.0)]
    sets = [("b", 10.0, 11.0, 1), ("b", 12.0, 13.0, 2), ("b", 12.0, 14.0, 2), ("c", None, None, 1), ("z", 1.0, 1.0, 1), (None, 0.0, 0.0, 1), ("d", 4.0, 4.0, None)]
    last = {}
    for i, lat, lng, at in sorted(sets, key=lambda s: (s[3] is not None, s[3] or 0, s[1] or 0, s[2] or 0)):
        last[i] = (lat, lng)
    df, points = spark.createDataFrame(rows, "id string, lat double, lng double"), spark.createDataFrame(sets, "id string, lat double, lng double, at int")
    got = sorted((str(r["id"]), str(r["lat"]), str(r["lng"]), r["was_set"]) for r in set_points(df, points).collect())
    want = sorted((str(i), *(map(str, last[i]) if i is not None and i in last else (str(lat), str(lng))), i is not None and i in last) for i, lat, lng in rows)
    assert got == want
    assert set_points(df.limit(0), points).count() == 0 and not any(r["was_set"] for r in set_points(df, points.limit(0)).collect())
