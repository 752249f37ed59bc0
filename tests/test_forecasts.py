"""Forecasts of asked places and zones against a plain loop."""

import random

from pyspark.sql import functions as F

from kerbside.operators import forecasts as fc


def test_cells_of_asks(spark):
    draw = random.Random(3)
    cells = [(i, i % 7, draw.choice([None, "Silk Board", "Hebbal Flyover", "100% Road"]), draw.choice(["", "Hebbal", "Indiranagar"]), draw.choice(["", "North", "East"]), "high", draw.randrange(9) / 1000, 1.0, 2, 0) for i in range(60)]
    asks = [(None, None), ("hebbal", None), ("HEBBAL", "north"), (None, "East"), ("100%", "East"), ("nowhere", None), (None, None), ("Hebbal", "West")]
    df = spark.createDataFrame(cells, "i long, j long, name string, area string, zone string, level string, expected double, relative_risk double, past_incidents long, past_fatal long")
    got = {(r["place"], r["zone"], r["rank"]): (r["i"], r["name"]) for r in fc.forecasts(spark.createDataFrame(asks, "place string, zone string"), df).collect()}
    want = {}
    for place, zone in set(asks):
        fit = [x for x in cells if (zone is None or x[4].lower() == zone.lower()) and (place is None or place.lower() in f"{x[2] or ''} {x[3]}".lower())]
        for n, x in enumerate(sorted(fit, key=lambda x: (-x[6], x[0], x[1]))[: fc.MOST]):
            want[place, zone, n + 1] = (x[0], x[2] or x[3] or "Unnamed cell")
    assert got == want and len(got) > 20


def test_names_of_cells(spark):
    at = lambda i, j: (12.5 + (i + 0.5) * 0.0045, 77 + (j + 0.5) * 0.0045)
    rows = [("a", "t", "Main Road", "Hebbal", "North", "fatal", *at(10, 10)), ("b", "t", " Ring Road ", "Hebbal", "North", "minor", *at(10, 10)), ("c", "t", "Ring Road", None, None, "minor", *at(10, 11)), ("d", "t", "x" * 61, "City", "East", "minor", *at(90, 90))]
    df = spark.createDataFrame(rows, "id string, title string, location string, area string, zone string, severity string, lat double, lng double")
    model = spark.createDataFrame([(10, 10, 3.0, "high"), (10, 11, 1.0, "low"), (90, 90, 2.0, "medium"), (50, 50, 9.0, "very_high")], "i long, j long, expected double, level string")
    got = {(r["i"], r["j"]): (r["name"], r["area"], r["zone"], r["relative_risk"], r["past_incidents"], r["past_fatal"]) for r in fc.named_cells(model, df).collect()}
    # the mean is that of cells with incidents; generic and long names name nothing
    assert got == {(10, 10): ("Ring Road", "Hebbal", "North", 1.5, 2, 1), (90, 90): (None, "City", "East", 1.0, 1, 0), (50, 50): (None, "", "", 4.5, 0, 0)}
    assert fc.named_cells(model.limit(0), df.filter(F.lit(False))).count() == 0
