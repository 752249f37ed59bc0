"""Exact dedup with minimal perfect hashes over the distinct digests of a history.

Digests are dealt into buckets by their first bytes. Each bucket of the history has a minimal
perfect hash (levels of bits; a digest's slot is the rank of its bit) whose slots hold the
full digest, the winner's id and the group's size. New digests are looked up in their bucket
and compared byte by byte: members join the slot's group, nonmembers are groups of their own.
Copies are counted per digest before anything moves by bucket, so a hot text costs one row
from each task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import checkpoint, crc_of_id, fresh, small_batches, slices

#: Mean distinct digests of a bucket.
BUCKET_KEYS = 20_000
#: Bits of each level for one key, and the most levels; what is left then is listed plainly.
GAMMA = 1.5
LEVELS = 40


def text_digest(text: str | None) -> bytes:
    """SHA-256 of the UTF-8 text with only A-Z lower-cased; null counts as empty."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).digest()


def with_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""

    small_batches(docs.sparkSession)

    def digest(batches):
        for whole in batches:
            for batch in slices(whole):
                found = [text_digest(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digest, "doc_id long, digest binary")


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests, given as an (n, 4) array of uint64."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = np.arange(len(keys))
        while len(left) and len(self.levels) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            at = self.place(keys[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[at]]
        self.rest = {keys[i].tobytes(): n for n, i in enumerate(left)}
        self.starts = np.cumsum([0, *(level.sum() for level in self.levels)])
        self.ranks = [np.cumsum(level) - level for level in self.levels]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        """Position at a level: the digest's own words, mixed with the level."""
        a, b = keys[:, level % 4], keys[:, (level + 1) % 4]
        h = (a ^ (b * np.uint64(2 * level + 0x9E3779B97F4A7C15 & (1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(17)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that wasn't built in gets any slot, or -1."""
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for n, level in enumerate(self.levels):
            at = self.place(keys[left], n, len(level))
            hit = level[at]
            out[left[hit]] = self.starts[n] + self.ranks[n][at[hit]]
            left = left[~hit]
        for i in left:
            n = self.rest.get(keys[i].tobytes())
            if n is not None:
                out[i] = self.starts[-1] + n
        return out


def as_words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(len(digests), 4)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


def groups_by_digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("size"))


def merge_with_history(history: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """Groups (digest, winner, size) of both inputs, which hold one row for each digest."""

    def merge(old: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
        slot_digests = np.empty((0, 4), np.uint64)
        table = PerfectHash(slot_digests)
        winners, sizes = [], np.zeros(0, np.int64)
        if len(old):
            keys = as_words(old["digest"])
            table = PerfectHash(keys)
            slots = table.slots(keys)
            order = np.argsort(slots)  # slots are 0 .. n-1, each once
            slot_digests = keys[order]
            winners = old["winner"].to_numpy()[order].tolist()
            sizes = old["size"].to_numpy()[order].copy()
        alone = fresh
        if len(fresh) and len(old):
            keys = as_words(fresh["digest"])
            slots = table.slots(keys)
            member = (slots >= 0) & (slot_digests[np.maximum(slots, 0)] == keys).all(axis=1)
            for slot, winner, size in zip(slots[member], fresh["winner"][member], fresh["size"][member]):
                sizes[slot] += size
                winners[slot] = max((w for w in (winners[slot], winner) if not pd.isna(w)), default=None)
            alone = fresh[~member]
        kept = pd.DataFrame({"digest": [d.tobytes() for d in slot_digests], "winner": pd.array(winners, "Int64"), "size": sizes})
        return pd.concat([kept, alone[["digest", "winner", "size"]].astype({"winner": "Int64"})]) if len(alone) else kept

    schema = "digest binary, winner long, size long"

    def deal(df: DataFrame, prefix: str) -> DataFrame:
        # names of its own for each side: both may come from one table
        columns = [F.col(c).alias(f"{prefix}_{c}") for c in ("digest", "winner", "size")]
        return df.select(bucket_of(buckets).alias(f"{prefix}_bucket"), *columns)

    def strip(old: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
        plain = [df.rename(columns=lambda c: c.partition("_")[2]) for df in (old, fresh)]
        return merge(*plain)

    return deal(history, "h").groupBy("h_bucket").cogroup(deal(new, "n").groupBy("n_bucket")).applyInPandas(strip, schema)


def exact_dedup(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text), dropped ones too.

    Output: doc_id, keep_id (the largest id among equal texts), group_size, kept,
    text_sha256. ``is_history`` says which rows were seen before (by default those with an
    even crc32 of the id). Null texts count as empty; of rows repeated with one id a single
    one is kept; a null id loses to any other, and stays only if all of its group are null;
    empty tables give empty ones; extra columns are not looked at.
    """
    past = crc_of_id() % 2 == 0 if is_history is None else is_history
    rows = checkpoint(with_digest(docs))
    seen = F.coalesce(past, F.lit(False))
    history, new = groups_by_digest(rows.filter(seen)), groups_by_digest(rows.filter(~seen))
    buckets = max(1, -(-rows.count() // BUCKET_KEYS))
    groups = merge_with_history(history, new, buckets)
    found = rows.join(groups.withColumnRenamed("digest", "group_digest"), F.col("digest") == F.col("group_digest"))
    return found.select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (all its columns, whatever their names) with one row of each group of equal texts:
    one of those that have the group's largest doc_id. Null texts count as empty; a null id
    stays only where all of its group are null; of rows that repeat in id and text one stays;
    texts of any length are compared whole; an empty table gives an empty one."""
    names, (digest, key, kept_key, kept_digest) = docs.columns, fresh(docs, "digest", "id_key", "kept_key", "kept_digest")
    kept = exact_dedup(docs).filter("kept").select(id_key("doc_id").alias(kept_key), F.unhex("text_sha256").alias(kept_digest)).distinct()

    def tag(batches):
        for whole in batches:
            for batch in slices(whole):
                found = pa.array([text_digest(t.as_py()) for t in batch.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, digest])

    tagged = docs.mapInArrow(tag, StructType([*docs.schema.fields, StructField(digest, BinaryType())])).withColumn(key, id_key("doc_id"))
    once = tagged.join(kept, (F.col(key) == F.col(kept_key)) & (F.col(digest) == F.col(kept_digest)), "left_semi")
    return once.dropDuplicates([key, digest]).select(*[F.col(f"`{c}`") for c in names])


def id_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
