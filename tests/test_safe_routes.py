"""Suggested routes against a plain loop over points, and the sentences for them."""

import math
import random

from kerbside.operators import safe_routes as sr

FIELDS = ("distance_km", "duration_min", "incidents", "fatal", "exposure", "predicted", "hot_cells", "danger")


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def dense(line, metres):
    out = [line[0]]
    for a, b in zip(line, line[1:]):
        n = max(1, math.ceil(km(a, b) * 1000 / metres))
        out += [(a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) for k in range(1, n + 1)]
    return out


def rounded(x, digits):
    return math.floor(x * 10**digits + 0.5) / 10**digits


def brute(lines, incidents, model):
    """{(trip, alt): (fields, recommended, fastest)}"""
    out = {}
    for trip, alts in lines.items():
        a, b = alts[0][0], alts[0][-1]
        if km(a, b) < 0.2 or not all(12.5 <= p[0] <= 13.5 and 77 <= p[1] <= 78.2 for p in (a, b)):
            continue
        routes = list(alts)
        if len(routes) == 1:
            mid, shrink = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), math.cos(math.radians((a[0] + b[0]) / 2))
            for s in (1, -1):
                routes.append([a, (mid[0] + s * (b[1] - a[1]) * shrink * 0.25, mid[1] - s * (b[0] - a[0]) * 0.25 / shrink), b])
        kept = []
        for n, line in enumerate(routes):
            points = dense(line, 120)
            if not any(sum(any(km(p, q) <= 0.04 for q in dense(routes[u], 60)) for p in points) / len(points) > 0.9 for u in kept):
                kept.append(n)
        found = {}
        for n in kept[:4]:
            at = dense(routes[n], 40)
            near = [(w, sev, d) for p, w, sev in incidents if (d := min(km(p, q) for q in at) * 1000) <= 120]
            cells = [(math.floor((y - 12.5) / 0.0045), math.floor((x - 77) / 0.0045)) for y, x in at]
            long = sum(km(p, q) for p, q in zip(routes[n], routes[n][1:]))
            found[n] = {
                "distance_km": rounded(long, 2), "duration_min": rounded(long / 30 * 60, 1), "incidents": len(near), "fatal": sum(s == "fatal" for _, s, _ in near), "exposure": rounded(sum(w * (1 - 0.5 * d / 120) for w, _, d in near), 2),
                "predicted": rounded(sum(model.get(k, (0, ""))[0] for k in cells) / len(cells), 3), "hot_cells": sum(model.get(k, (0, ""))[1] in ("high", "very_high") for k in set(cells)),
            }
        most = {x: max([1e-9, *(r[x] for r in found.values())]) for x in ("exposure", "predicted")}
        for r in found.values():
            r["danger"] = rounded(0.7 * r["exposure"] / most["exposure"] + 0.3 * r["predicted"] / most["predicted"], 3)
        fast = min(found, key=lambda n: (found[n]["duration_min"], n))
        best = min((n for n in found if found[n]["duration_min"] <= found[fast]["duration_min"] * 1.4 + 3), key=lambda n: (found[n]["danger"], n))
        if found[best]["danger"] > found[fast]["danger"] * 0.85:
            best = fast
        out |= {(trip, n): (tuple(r[x] for x in FIELDS), n == best, n == fast) for n, r in found.items()}
    return out


def test_suggestions_equal_a_plain_loop(spark):
    draw = random.Random(7)
    near = lambda p, by: (p[0] + draw.gauss(0, by), p[1] + draw.gauss(0, by))
    lines, hub = {}, (12.95, 77.6)
    for trip in range(24):
        a, b = near(hub, 0.01), near(hub, 0.01)
        if trip % 8 == 5:
            b = near(a, 0.0003)  # too close
        if trip % 8 == 6:
            a = (12.4, 77.6)  # outside
        lines[trip] = [[a, near(((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), 0.003), b] for _ in range(1 + trip % 4)]
        if trip % 4 == 2:
            lines[trip][1] = [p if n != 1 else near(p, 0.00005) for n, p in enumerate(lines[trip][0])]  # along the first
    severities = {"fatal": 3, "serious": 2, "minor": 1}
    incidents = [(near(hub, 0.008), draw.choice(list(severities))) for _ in range(300)]
    incidents += incidents[:20]
    cells = {(math.floor((y - 12.5) / 0.0045), math.floor((x - 77) / 0.0045)) for (y, x), _ in incidents[:200]}
    model = {k: (draw.randrange(5000) / 1000, draw.choice(["low", "medium", "high", "very_high"])) for k in sorted(cells)}

    points = spark.createDataFrame([(t, n, k, *p) for t, alts in lines.items() for n, line in enumerate(alts) for k, p in enumerate(line)] + [(1, 0, 9, None, 77.5)], "trip long, alt int, seq int, lat double, lng double")
    rows = spark.createDataFrame([(*p, s) for p, s in incidents], "lat double, lng double, severity string")
    risk = spark.createDataFrame([(*k, *v) for k, v in model.items()], "i long, j long, expected double, level string")
    routes = sr.suggested(sr.lines_of(points), rows, risk)
    got = {(r["trip"], r["alt"]): (tuple(float(r[x]) for x in FIELDS), r["recommended"], r["fastest"]) for r in routes.collect()}
    want = {k: (tuple(map(float, f)), *rest) for k, (f, *rest) in brute(lines, [(p, severities[s], s) for p, s in incidents], model).items()}
    assert got == want
    assert any(best and not fast for _, best, fast in got.values()) and any(len(lines[t]) == 1 and n > 0 for t, n in got)
    assert max(len([1 for t, _ in got if t == x]) for x in lines) >= 3

    said = {r["trip"]: r["summary"] for r in sr.summaries(routes).collect()}
    assert set(said) == {t for t, _ in got}
    safer = next(t for (t, _), (_, best, fast) in got.items() if best and not fast)
    assert said[safer].startswith("Safer alternative: ") and "than the fastest route, for +" in said[safer]


def test_no_trips_and_no_incidents(spark):
    points = spark.createDataFrame([(1, 0, 0, 12.9, 77.5), (1, 0, 1, 12.92, 77.5), (2, 0, 0, None, None)], "trip long, alt int, seq int, lat double, lng double")
    none = spark.createDataFrame([], "lat double, lng double, severity string")
    model = spark.createDataFrame([], "i long, j long, expected double, level string")
    got = sr.suggested(sr.lines_of(points), none, model).collect()
    assert {(r["trip"], r["alt"], r["recommended"]) for r in got} == {(1, 0, True), (1, 1, False), (1, 2, False)} and all(r["danger"] == 0 for r in got)
    assert sr.suggested(sr.lines_of(points.limit(0)), none, model).count() == 0
