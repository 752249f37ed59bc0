"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.bindings import spread

#: Rows and bytes of an Arrow batch of texts, and of the slices of it that tasks work on.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written between steps: the one that ``spark.checkpoint.dir`` names.

    Only a session on one machine gets a temporary folder where that is unset; on a cluster
    that would split the rows over the machines, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        return f"{tempfile.gettempdir()}/kerbside-{uuid.uuid4().hex[:12]}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage. Spark removes the
    files once nothing refers to them, if spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to what tasks over long texts can hold; bounds
    that are lower already stay. Rows are the same, whatever the bounds."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def slices(batch: pa.RecordBatch, column: str = "text"):
    """Parts of a batch with a bounded number of rows and bytes; a text is never cut, so a longer
    one is a part of its own."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    low = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > low and (i - low >= SLICE_ROWS or held + n > SLICE_BYTES):
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += n
    if low < batch.num_rows:
        yield batch.slice(low)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out




def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """True for rows that must not be learnt from; a null id is never learnt from."""
    return F.coalesce((crc_of_id(column) % modulus) == remainder, F.lit(True))


def unit_hash(*columns: str) -> Column:
    """A reproducible number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def class_sample(rows: DataFrame, label: str, per_class: int, *keys: str, repeats: bool = False, classes: int = 200) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label, chosen by a hash of ``keys``.

    Returns the sample, of which rows that are equal in label and keys are one, and the fraction
    kept of each label. Only the ``classes`` most frequent labels are learnt from, so that a
    column of any values stays a bounded list. With ``repeats`` rows are counted once for each of
    their keys (about, by a sketch); without, keys must be distinct. Then no more than twice as
    many rows are chosen, by the law of large numbers; ``bounded`` makes sure of it.
    """
    size = F.approx_count_distinct(F.xxhash64(*keys), 0.02) if repeats else F.count(F.lit(1))
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(size.alias("n")).orderBy(F.desc("n"), label).limit(classes).collect()
    kept = {r[0]: min(1.0, per_class / max(r[1], 1)) for r in counts}
    value, rate = fresh(rows, "sampled_label", "sampled_rate")
    rates = rows.sparkSession.createDataFrame(list(kept.items()), StructType([StructField(value, rows.schema[label].dataType), StructField(rate, DoubleType())]))
    chosen = rows.join(F.broadcast(rates), F.col(label) == F.col(value)).filter(unit_hash(*keys) < F.col(rate)).drop(value, rate)
    return chosen.dropDuplicates([label, *keys]), kept


def one_text_each(docs: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """(label_id, label, text): one text for each id of a bounded ``sample`` of ids, however many rows of
    ``docs`` have the id: that of the smallest hash. Null texts don't count."""
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    return rows.groupBy("label_id", label).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` if there are at most ``most``, for what is broadcast or collected next."""
    if (n := rows.count()) > most:
        raise ValueError(f"{n} rows where at most {most} were expected: ids repeat too often to be sampled")
    return rows


def hash_blocks(rows: DataFrame, keys: list[str], size: Column, most: int):
    """Parts of ``rows``, each with a total of ``size`` of at most ``most``, for work in blocks.

    Rows that are equal in ``keys`` stay together, so only such a group can exceed the bound;
    make the keys distinct where it must hold. Only a number for each block reaches the driver.
    """
    h, n = F.xxhash64(*keys), 1
    while True:
        totals = rows.groupBy(F.pmod(h, F.lit(n)).alias("block")).agg(F.sum(size).alias("total"), F.count_distinct(h).alias("groups")).collect()
        if all(r["total"] <= most or r["groups"] <= 1 for r in totals):
            break
        n *= 2
    for r in sorted(totals, key=lambda r: r["block"]):
        yield rows.filter(F.pmod(h, F.lit(n)) == r["block"])
