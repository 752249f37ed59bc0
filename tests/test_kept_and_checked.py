"""Kept outputs against full runs, ordered writes with failures, and checks on a stream of reports."""

import random

from pyspark.sql import functions as F

from kerbside.operators import integrity, kept
from kerbside.plans.bindings import Tables
from kerbside.plans.registry import callables
from kerbside.streaming import report_checks, write_through

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_each_change_equals_a_full_run(spark):
    t = Tables(spark, SF)
    first, changes = kept.steps_of(t)
    sums, now = kept.partial_sums(first), first
    for came, went in changes:
        sums = kept.changed(sums, came, went)
        now = now.unionByName(came).join(went.select("seq"), "seq", "left_anti")
        full = kept.partial_sums(now)
        assert rows_of(sums.select(*kept.KEYS, *kept.SUMS)) == rows_of(full.select(*kept.KEYS, *kept.SUMS))
        assert rows_of(kept.digest_from(sums)) == rows_of(kept.digest_from(full))
        assert rows_of(kept.cells_from(sums)) == rows_of(kept.cells_from(full))
    assert kept.changed(sums, now.limit(0), now).count() == 0


def batches_of(spark, rows, schema, tmp, n):
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.parquet(f"{tmp}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")


def test_one_failing_key_delays_no_other(spark, tmp_path):
    draw = random.Random(6)
    rows = [(k, s, f"{k}-{s}") for k in range(8) for s in range(12)]
    rows = sorted(rows, key=lambda r: (r[1] + draw.randrange(4), r[0])) + [(1, 3, "1-3")]  # one row is sent twice
    schema = "key long, seq long, value string"
    taken = {"until": 2}  # key 5 fails from seq 4 on until that many batches are done

    def accepts(df):
        return df.withColumn("ok", (F.col("key") != 5) | (F.col("seq") < 4) | F.lit(taken["until"] <= 0))

    def run():
        return write_through.write_through(batches, f"{tmp_path}/out", f"{tmp_path}/c", accepts)

    batches = batches_of(spark, rows, schema, tmp_path, 4)
    run().awaitTermination()
    out = write_through.written(spark, f"{tmp_path}/out")
    got = sorted((r["key"], r["seq"]) for r in out.collect())
    assert got == sorted({(k, s) for k, s, _ in rows if k != 5 or s < 4})
    for r in out.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("batch", "seq"))).alias("x")).collect():
        seqs = [b["seq"] for b in r["x"] if r["key"] != 5]
        assert len(set(seqs)) == len(seqs)
    # a restart with nothing new writes nothing; the same batch again writes the same
    run().awaitTermination()
    assert sorted((r["key"], r["seq"]) for r in out.collect()) == got
    last = max(r["batch"] for r in out.select("batch").distinct().collect())
    waits = spark.read.parquet(write_through.folder(f"{tmp_path}/out", "waiting", int(last))).select("key", "seq", "value").collect()
    again = spark.createDataFrame([(k, s, v) for k, s, v, b in out.select("key", "seq", "value", "batch").collect() if b == last] + [tuple(r) for r in waits], schema)
    write_through.commit(again, int(last), f"{tmp_path}/out", accepts)
    assert sorted((r["key"], r["seq"]) for r in write_through.written(spark, f"{tmp_path}/out").collect()) == got
    # once the key is taken again, what waits goes with the next batch, in order
    taken["until"] = 0
    spark.createDataFrame([(9, 0, "9-0")], schema).write.parquet(f"{tmp_path}/in/9")
    run().awaitTermination()
    done = write_through.written(spark, f"{tmp_path}/out")
    assert sorted((r["key"], r["seq"]) for r in done.collect()) == sorted({(k, s) for k, s, _ in rows} | {(9, 0)})
    assert {r["key"]: r["seq"] for r in write_through.latest(spark, f"{tmp_path}/out").collect()} == {**dict.fromkeys(range(8), 11), 9: 0}


def stream_of(spark, df, tmp, name):
    """Five files of rows in no order, one for each batch, and one far later that lets the watermark pass."""
    shuffled = df.orderBy(F.xxhash64("id")).repartition(4, F.xxhash64("id"))
    shuffled.write.parquet(f"{tmp}/{name}/a")
    far = df.limit(1).withColumns({"id": F.lit(-1).cast("long"), "at_ts": F.lit("2090-01-01").cast("timestamp"), "lat": F.lit(0.0), "reporter_id": F.lit(-1).cast("long")})
    far.select(*df.columns).coalesce(1).write.parquet(f"{tmp}/{name}/b")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/{name}/*")


def collected(spark, stream, tmp, name):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp}/{name}-c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}")


def test_checks_on_a_stream(spark, tmp_path):
    t = Tables(spark, SF)
    placed = t.active.select(F.col("seq").alias("id"), "lat", "lng", "accident_date", "reporter_id", F.col("created_at").cast("timestamp").alias("at_ts"))
    reports = placed.join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")
    source = stream_of(spark, reports, tmp_path, "reports")
    found = collected(spark, report_checks.duplicate_pairs(source, "400 days", "400 days"), tmp_path, "pairs_out").filter("a_id % 50 = 0 and a_id >= 0 and b_id >= 0")
    want = callables()["duplicate_score"](spark, SF)
    assert rows_of(found.select(*want.columns)) == rows_of(want) and found.count() > 0
    flags = collected(spark, report_checks.flags(source, integrity.known_pairs(t)), tmp_path, "flags_out").filter("doc_id >= 0").distinct()
    batch = report_checks.flags(reports, integrity.known_pairs(t))
    assert rows_of(flags.select(*batch.columns)) == rows_of(batch)
    events = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("reporter_id"), F.col("ts").cast("timestamp").alias("at_ts"), F.lit(1.0).alias("lat"))
    recent = collected(spark, report_checks.haste(stream_of(spark, events, tmp_path, "events"), "60 days"), tmp_path, "haste_out").filter("id >= 0")
    from pyspark.sql import Window

    w = Window.partitionBy("reporter_id").orderBy(F.unix_millis("at_ts")).rangeBetween(-86_400_000, 0)
    full = events.select("reporter_id", "id", F.count(F.lit(1)).over(w).alias("recent"))
    assert rows_of(recent.select("reporter_id", "id", "recent")) == rows_of(full)
