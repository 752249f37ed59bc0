"""Fallback between sources, and labelled folders."""

import json

import pytest

from kerbside.operators.loading import live_hospitals
from kerbside.sources.choices import CLASSES, first_source, labelled_files


def readers(tmp_path):
    parquet = lambda spark, path: spark.read.parquet(path)
    return [("live", str(tmp_path / "live.parquet"), parquet), ("cached", str(tmp_path / "cached.json"), live_hospitals), ("seed", str(tmp_path / "seed.parquet"), parquet)]


def test_first_source_that_can_be_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="live.*cached.*seed"):
        first_source(spark, readers(tmp_path))
    spark.createDataFrame([(1, "a")], "id long, name string").write.parquet(str(tmp_path / "seed.parquet"))
    assert [tuple(r) for r in first_source(spark, readers(tmp_path)).collect()] == [(1, "a", "seed")]
    (tmp_path / "cached.json").write_text(json.dumps({"id": 5, "lat": 12.9, "lon": 77.6, "tags": {"name": "H"}}) + "\n")
    assert [tuple(r) for r in first_source(spark, readers(tmp_path)).collect()] == [(5, "H", 12.9, 77.6, "cached")]
    # a path that is there but holds no table gives way
    (tmp_path / "live.parquet").mkdir()
    assert first_source(spark, readers(tmp_path)).first()["source_label"] == "cached"


def test_labelled_folder(spark, tmp_path):
    want = set()
    for part in ("train", "validation"):
        for n, label in enumerate(CLASSES):
            (tmp_path / part / label).mkdir(parents=True)
            for k in range(n + 1):
                (tmp_path / part / label / f"{k} x.jpg").write_bytes(bytes(k + 1))
                want.add((part, label, sorted(CLASSES).index(label), k + 1))
    rows = labelled_files(spark, str(tmp_path), contents=True)
    assert {(r["part"], r["label"], r["label_index"], r["length"]) for r in rows.collect()} == want and rows.count() == 12
    assert all(len(r["content"]) == r["length"] for r in rows.collect()) and "content" not in labelled_files(spark, str(tmp_path)).columns
    (tmp_path / "train" / "other").mkdir()
    (tmp_path / "train" / "other" / "a.jpg").write_bytes(b"x")
    with pytest.raises(ValueError, match="exactly minor, moderate, severe"):
        labelled_files(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="test"):
        labelled_files(spark, str(tmp_path), parts=("train", "test"))
