"""Packing by power-of-two decomposition: no sequence crosses documents.

A document of n tokens is cut into full sequences and then into the binary parts of the rest,
longest first. Each piece has a power-of-two length and is a sequence of its own; equal
lengths share a bucket. Nothing is padded.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, slices

SEQUENCE = 2048
#: Parts that a task remembers, and the longest of them. They set the speed, not the ids.
TASK_CACHE = 400_000
LONGEST = 64
#: A run of ASCII marks, but for apostrophes, from a letter or digit to white space or the end.
MARK = re.compile(r"([!-&(-/:-@\[-`{-~](?<=[^\W_].)[!-&(-/:-@\[-`{-~]*)(?=\s|$)")
#: White space in Python that the tokenizer keeps: texts with it are encoded whole.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


@lru_cache(maxsize=1)
def load_tokenizer(path: str):
    """A worker reads the vocabulary once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain_words(text: str) -> list[str] | None:
    """Lower-case words of a Latin-1 text, with the marks after a word as a word of their own: the
    tokenizer lower-cases too, and cuts marks off that stand between a letter and white
    space. None for other texts, and for those that may hold special tokens."""
    if "<|" in text or any(c in text for c in ODD_SPACES):
        return None
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return MARK.sub(r" \1", text.lower()).split()


class PartIds(dict):
    """Ids of a part between white space, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load_tokenizer(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, parts) -> None:
        """Encode the words that aren't known yet together: each word of letters ends with the
        only one of its ids that ends a word."""
        if len(self) >= TASK_CACHE:
            self.clear()
        words = [p for p in parts if p not in self and len(p) <= LONGEST and p.isalpha()]
        for low in range(0, len(words), 2000):
            some = words[low : low + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(some) and ends[-1] == len(ids) - 1:
                whole, at = ids.tobytes(), 0
                for word, end in zip(some, (4 * ends + 4).tolist()):
                    self[word] = whole[at:end]
                    at = end

    def __missing__(self, part: str) -> bytes:
        found = self.encode(part)
        if len(part) <= LONGEST:
            self[part] = found
        return found


def ids_of_texts(texts: list, parts: PartIds) -> list[bytes]:
    """Each document's ids: the tokenizer drops white space and never merges across it."""
    words = [plain_words(t or "") for t in texts]
    parts.learn(set(chain.from_iterable(w for w in words if w)))
    out = []
    for t, w in zip(texts, words):
        if w is None and not any(c in t for c in ODD_SPACES):
            w = t.split()
        out.append(parts.encode(t) if w is None else b"".join(map(parts.__getitem__, w)))
    return out


def document_ids(text: str | None, parts: PartIds) -> bytes:
    return ids_of_texts([text], parts)[0]


def piece_lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Full sequences, then the binary parts of the rest, longest first."""
    out = [sequence] * (n // sequence)
    rest, power = n % sequence, sequence
    while power > 1:
        power //= 2
        if rest & power:
            out.append(power)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, sequence: int = SEQUENCE) -> DataFrame:
    """(doc_id, text) to one row per piece.

    Output: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of
    the length). Null and empty texts are the end id alone; texts of any length are cut whole;
    repeated rows are packed each; null ids stay; an empty table gives an empty one; extra
    columns are not looked at. ``sequence`` must be a power of two.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches):
        parts = PartIds(tokenizer_path)  # what it remembers goes with the task
        for whole in batches:
            for batch in slices(whole):
                rows: list[tuple] = []
                for doc_id, found in zip(batch.column("doc_id").to_pylist(), ids_of_texts(batch.column("text").to_pylist(), parts)):
                    ids = memoryview(found + end)
                    n, at = len(ids) // 4, 0
                    for length in piece_lengths(n, sequence):
                        rows.append((doc_id, at, length, crc32(ids[4 * at : 4 * (at + length)]), n))
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, ", ".join(f"{n} long" for n in names))
    # one sequence for each piece; ids depend on the scan's partitions only, so a task run again gives them again
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("bucket", F.log2("length").cast("int"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces into one folder for each length (bucket=0, 1, ...), so that a reader takes
    batches of equal lengths. Each task writes its own files; no piece moves."""
    pieces.write.partitionBy("bucket").parquet(path)
