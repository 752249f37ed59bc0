"""Photo hashes against brute force: every pair of up to six bits, at any place, of all rows."""

import random
from itertools import combinations

from kerbside.operators import integrity
from kerbside.plans.bindings import Tables
from kerbside.plans.registry import callables

SF = "/root/testdata/sf0.001"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    """Classes of equal hashes and near pairs of their representatives."""
    least = {}
    for i, h in rows:
        if h is not None:
            least[h] = min(i, least.get(h, i))
    members = {i: least[h] for i, h in rows if h is not None}
    near = set()
    for (g, a), (h, b) in combinations(least.items(), 2):
        bits = bin((g ^ h) & ((1 << 64) - 1)).count("1")
        if bits <= 6:
            near.add((min(a, b), max(a, b), bits))
    return members, near


def test_near_hashes_brute(spark):
    draw = random.Random(7)
    rows = [(1, None), (2, 0), (3, 0), (4, -1), (5, signed(1 << 63)), (6, None)]
    for _ in range(60):
        h = draw.getrandbits(64)
        for bits in (0, 0, 1, 2, 5, 6, 7, 8):
            rows.append((len(rows) + 1, signed(h ^ sum(1 << k for k in draw.sample(range(64), bits)))))
    # six and seven bits, each in a band of its own
    for k in range(8):
        rows.append((len(rows) + 1, signed(sum(1 << (8 * x + 3) for x in range(8) if x != k))))
        rows.append((len(rows) + 1, signed(sum(1 << (8 * x + 3) for x in range(8) if x not in (k, (k + 1) % 8)))))
    df = spark.createDataFrame(rows, "id long, hash long")
    members, near = brute(rows)
    assert {x[2] for x in near} == {1, 2, 3, 4, 5, 6}
    found = [tuple(r) for r in integrity.near_hashes(df).select("a_id", "b_id", "distance").collect()]
    assert sorted(found) == sorted(near)
    for bands in (9, 11):  # as for many more hashes
        assert sorted(map(tuple, integrity.near_hashes(df, bands).select("a_id", "b_id", "distance").collect())) == sorted(near)
    assert integrity.bands_for(10_000) == 8 < integrity.bands_for(10_000_000) <= integrity.bands_for(10**9)
    classes = {r["rep_id"]: r["members"] for r in integrity.hash_classes(df).collect()}
    assert classes == {i: list(members.values()).count(i) for i in set(members.values())}
    assert integrity.near_hashes(df.limit(0)).count() == 0


def test_all_events_take_part(spark):
    rows = [tuple(r) for r in integrity.photo_hashes(Tables(spark, SF)).collect()]
    members, near = brute(rows)
    assert {r["event_id"]: r["rep_id"] for r in callables()["photo_hash_classes"](spark, SF).collect()} == members
    found = [(r["a_id"], r["b_id"], r["distance"]) for r in callables()["hamming_pairs"](spark, SF).collect()]
    assert sorted(found) == sorted(near)
    assert len(members) == Tables(spark, SF).events.count() and any(a % 10 or b % 10 for a, b, _ in near) and {x[2] for x in near} >= {2, 3, 4, 5, 6}
