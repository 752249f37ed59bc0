"""Sources in an order of choice, and folders whose names are labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

#: The classes of damage that a labelled folder holds, and its parts.
CLASSES, PARTS = ("minor", "moderate", "severe"), ("train", "validation")


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path can be read, through Spark's own access to its store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def first_source(spark: SparkSession, choices: Sequence[tuple[str, str, Callable[[SparkSession, str], DataFrame]]]) -> DataFrame:
    """Rows of the first of (label, path, reader) whose path is there and whose schema can be read, with
    the label as ``source_label``. A path that is there but can't be read gives way to the next, as a
    failed fetch does; an error if none is left. Rows are read lazily, once."""
    failed = []
    for label, path, reader in choices:
        if not there(spark, path):
            failed.append(f"{label}: no {path}")
            continue
        try:
            rows = reader(spark, path)
            rows.schema  # noqa: B018  a reader of files looks at them here
        except Exception as error:  # noqa: BLE001  what a reader may raise is its own affair
            failed.append(f"{label}: {type(error).__name__}")
            continue
        return rows.withColumn("source_label", F.lit(label))
    raise FileNotFoundError("no source is available: " + "; ".join(failed))


def labelled_files(spark: SparkSession, root: str, classes: Sequence[str] = CLASSES, parts: Sequence[str] = PARTS, contents: bool = False) -> DataFrame:
    """(path, part, label, label_index, length[, content]) of the files under root/part/label. Labels are
    numbered in alphabetical order. Every part must hold exactly ``classes``, or an error names what is
    wrong; only distinct names of folders reach the driver. Without ``contents`` no file is opened."""
    if missing := [p for p in parts if not there(spark, f"{root}/{p}")]:
        raise FileNotFoundError(f"no folder {', '.join(missing)} under {root}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{root}/{p}" for p in parts])
    piece = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", k)
    rows = files.select("path", piece(1).alias("part"), piece(2).alias("label"), "length", *(["content"] if contents else []))
    odd = rows.filter(~(c("part").isin(*parts) & c("label").isin(*classes))).select("part", "label").distinct().limit(10).collect()
    held = rows.groupBy("part").agg(F.count_distinct("label").alias("n")).filter(c("n") == len(set(classes))).count()
    if odd or held != len(set(parts)):
        raise ValueError(f"folders of each part must be exactly {', '.join(classes)}; others: {[tuple(r) for r in odd]}")
    order = F.array(*map(F.lit, sorted(set(classes))))
    names = ["path", "part", "label", (F.array_position(order, c("label")) - 1).cast("int").alias("label_index"), "length"]
    return rows.select(*names, *(["content"] if contents else []))
