"""Writes in the order of each key, with what failed kept and retried.

Each batch's rows go out in a folder of its own, which a repeated batch overwrites: what was
written before a restart is the same rows again, not more. A row that isn't accepted holds
back the later rows of its key, and no other's, until a later batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (key, seq, ...) to the same rows with ``ok``: what the target takes now.
Accepts = Callable[[DataFrame], DataFrame]


def folder(path: str, kind: str, number: int) -> str:
    return f"{path}/{kind}/batch={number:012d}"


def read_or_none(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:  # no batch has written it yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def commit(rows: DataFrame, number: int, path: str, accepts: Accepts) -> None:
    """Write what can go of ``rows`` (key, seq, ...) and of what waits since the batch before. Of rows that
    are equal in key and seq the batch writes one; rows without a key or seq can't be ordered and
    are an error of the caller's: they wait for ever."""
    spark = rows.sparkSession
    waiting = read_or_none(spark, folder(path, "waiting", number - 1), rows.schema)
    judged = accepts(waiting.unionByName(rows).dropDuplicates(["key", "seq"]))
    stop = F.min(F.when(~F.coalesce("ok", F.lit(False)), F.col("seq"))).over(Window.partitionBy("key"))
    judged = judged.withColumn("stop", stop)
    goes = F.col("key").isNotNull() & F.col("seq").isNotNull() & (F.col("stop").isNull() | (F.col("seq") < F.col("stop")))
    judged = judged.withColumn("goes", goes).persist()
    try:
        judged.filter("goes").select(*rows.columns).write.mode("overwrite").parquet(folder(path, "written", number))
        judged.filter("not goes").select(*rows.columns).write.mode("overwrite").parquet(folder(path, "waiting", number))
    finally:
        judged.unpersist()


def write_through(updates: DataFrame, path: str, checkpoint: str, accepts: Accepts, at: str | None = None, delay: str = "1 day", **trigger):
    """Start a stream of (key, seq, ...) into ``path``: ``written`` has each row once, ``waiting`` what the last
    batch left. ``path`` is a folder that driver and executors share. A row that a sender repeats goes
    once: with an event time ``at`` if repeats come within ``delay``, so that their state is bounded;
    without, always, and every key and seq is remembered."""
    unique = updates.withWatermark(at, delay).dropDuplicatesWithinWatermark(["key", "seq"]) if at else updates.dropDuplicates(["key", "seq"])
    stream = unique.writeStream.foreachBatch(lambda rows, number: commit(rows, number, path, accepts))
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def written(spark: SparkSession, path: str) -> DataFrame:
    """All rows that went out, with their batch."""
    return spark.read.parquet(f"{path}/written")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The last written row of each key."""
    rows = written(spark, path).drop("batch")
    return rows.groupBy("key").agg(F.max_by(F.struct(*rows.columns), "seq").alias("x")).select("x.*")
