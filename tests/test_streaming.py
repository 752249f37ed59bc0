"""Streams give what the batch replays give."""

import tempfile

from pyspark.sql import functions as F

from kerbside import operators  # noqa: F401  registers the queries
from kerbside.plans.bindings import Tables
from kerbside.plans.registry import callables
from kerbside.streaming.dispatch import lifecycles, rate_limited

SF = "/root/testdata/sf0.001"


def streamed(spark, df, build, mode):
    with tempfile.TemporaryDirectory() as folder:
        df.write.parquet(f"{folder}/in")
        name = f"t{abs(hash(folder))}"
        source = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
        q = build(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.sql(f"select * from {name}").collect()


def test_rate_limits(spark):
    events = Tables(spark, SF).events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = streamed(spark, events, lambda s: rate_limited(s, 1), "update")
    want = callables()["rate_limit_windows"](spark, SF).collect()
    assert sorted((r["user_id"], str(r["window_start"]), r["requests"]) for r in found) == sorted((r["user_id"], str(r["window_start"]), r["requests"]) for r in want)


def test_lifecycles(spark):
    log = Tables(spark, SF).alert_events.filter("alert_id < 300").select("alert_id", "stage", F.col("at_ts").cast("timestamp").alias("at_ts")).coalesce(1)
    end = spark.createDataFrame([(-1, 1, "2099-01-01")], "alert_id long, stage long, at_ts string").withColumn("at_ts", F.col("at_ts").cast("timestamp"))
    rows = sorted(streamed(spark, log.unionByName(end), lifecycles, "append"), key=lambda r: r["at_ms"])
    found = {r["alert_id"]: (r["stage"], r["illegal"]) for r in rows}
    want = {r["alert_id"]: (r["last_stage"], 0) for r in callables()["lifecycle_replay"](spark, SF).filter("alert_id < 300").collect()}
    assert found == want
