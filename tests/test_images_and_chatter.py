"""Hashes, blocks and JSON against plain loops, on awkward rows."""

import json
import random

from pyspark.sql import functions as F

from kerbside.operators import images
from kerbside.sources.chatter import json_in


def test_hash_of_grids(spark):
    draw = random.Random(1)
    rows = [(i, [float(draw.randrange(20)) for _ in range(72)]) for i in range(60)] + [(100, [1.0] * 71), (101, None), (102, [None] + [1.0] * 71), (103, [float(72 - k) for k in range(72)])]
    found = {r["id"]: r["h"] for r in spark.createDataFrame(rows, "id long, g array<double>").select("id", images.difference_hash(F.col("g")).alias("h")).collect()}
    for i, g in rows:
        if g is None or len(g) != 72 or None in g:
            assert found[i] is None
        else:
            bits = "".join("1" if g[y * 9 + x] > g[y * 9 + x + 1] else "0" for y in range(8) for x in range(8))
            assert found[i] & (1 << 64) - 1 == int(bits, 2)
    assert found[103] == -1


def test_blocks_of_sixteen(spark):
    draw = random.Random(2)
    w, h = 50, 33  # a rest at both sides
    quiet = [float(draw.randrange(3)) for _ in range(w * h)]
    loud = [40.0 if y < 16 and x < 16 else 0.0 for y in range(160) for x in range(160)]
    two = images.block_statistics(spark.createDataFrame([(1, quiet), (2, None), (3, [1.0])], "id long, level array<double>"), w, h).collect()
    means = sorted(sum(quiet[(by * 16 + y) * w + bx * 16 + x] for y in range(16) for x in range(16)) / 256 for by in range(2) for bx in range(3))
    assert [(r["id"], r["median_error"], r["peak_error"], r["localized"]) for r in two] == [(1, round(means[3], 2), round(means[5], 2), False)]
    one = images.block_statistics(spark.createDataFrame([(9, loud)], "id long, level array<double>"), 160, 160).first()
    assert (one["outlier_ratio"], one["localized"], one["peak_error"]) == (0.01, True, 40.0)


def test_photo_signals_of_unknown_metadata(spark):
    schema = "id long, make string, model string, software string, description string, format string, has_exif boolean, width int, height int, taken_on date, reported_on date, photo_lat double, photo_lng double, lat double, lng double"
    found = images.photo_signals(spark.createDataFrame([(1, *[None] * 14)], schema)).first()
    assert (found["signals"], found["photo_score"]) == ("no_camera_metadata", 0.1)


def parser(text):
    """Each brace in turn, as a reader would."""
    import re

    s = re.sub("(?i)```(json)?", "", text or "").strip(" ")
    try:
        json.loads(s)
        return s
    except ValueError:
        pass
    for start in (i for i, ch in enumerate(s) if ch == "{"):
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(s)):
            ch = s[i]
            if quoted:
                if escaped:
                    escaped = False
                elif ch == "\\":
                    escaped = True
                elif ch == '"':
                    quoted = False
                continue
            if ch == '"':
                quoted = True
            elif ch == "{":
                depth += 1
            elif ch == "}":
                depth -= 1
                if depth == 0:
                    try:
                        json.loads(s[start : i + 1])
                        return s[start : i + 1]
                    except ValueError:
                        break
    return None


def test_json_in_chatter(spark):
    draw = random.Random(3)
    bits = ["{", "}", '"', "\\", ":", "1", " ", "a", '{"a": 1}', '{"a": {"b": "} \\" {"}}', "```json\n", "```", "\n", "é"]
    rows = [(i, "".join(draw.choices(bits, k=draw.randint(0, 9)))) for i in range(500)] + [(-1, None), (-2, ""), (-3, "x " * 3000 + '{"k": [1, {"z": null}]} tail'), (-4, '{"a": 1} {"b": 2}'), (-5, "{{}"), (-6, "7")]
    found = {r["id"]: r["j"] for r in spark.createDataFrame(rows, "id long, s string").select("id", json_in(F.col("s")).alias("j")).collect()}
    assert found == {i: parser(t) for i, t in rows}
    assert sum(x is not None for x in found.values()) > 40
