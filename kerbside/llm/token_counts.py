"""Token counts with a map-side two-tier lookup and no shuffle of pre-tokens.

The model's pieces hold a space only at their start and never a line break, so no merge
crosses from a character to the space after it, nor a line break: a text's tokens are the
tokens of its space-led parts. Tier one is a compact broadcast table of frequent parts and
their lengths; tier two is a cache in each task, filled by encoding the misses.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, slices, unit_hash

#: Bounds of the broadcast table, of a task's cache and of the rows that the table is drawn
#: from. They set the speed, not the counts.
FREQUENT = 20_000
TASK_CACHE = 150_000
SAMPLE_ROWS = 2_000
SAMPLE_TASKS = 8


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def is_splittable(model) -> bool:
    """Whether the model's pieces allow counting by parts."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i)]
    inner = any("▁" in p.lstrip("▁") for p in pieces)
    breaks = any("\n" in p for p in pieces)
    plain = model.encode("a  b", out_type=str) != model.encode("a b", out_type=str)
    return not inner and not breaks and plain


class PartLengths(dict):
    """Tokens of a part that stands after one space."""

    def __init__(self, path: str, known: dict | None = None):
        super().__init__(known or {})
        self.path, self.known, self.model = path, known or {}, None

    def encode(self, text: str) -> int:
        if self.model is None:
            self.model = load_model(self.path)
        return len(self.model.encode(text, num_threads=1))

    def __missing__(self, part: str) -> int:
        if len(self) >= TASK_CACHE:
            self.clear()
            self.update(self.known)
        if part.startswith("\n"):  # the space before is not in the text
            n = self.encode(part) - 1
        else:
            n = self.encode(part)
        if len(part) <= 64:
            self[part] = n
        return n


def parts_of(text: str) -> list[str] | None:
    """Space-led parts of a text; None if spaces meet each other or a line break."""
    text = text.replace("▁", " ")
    if not text or text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or text[0] == "\n":
        return None
    return text.replace("\n", " \n").split(" ")


def count_tokens(text: str | None, lengths: PartLengths) -> int:
    if not text:
        return 0
    parts = parts_of(text)
    if parts is not None:
        return sum(map(lengths.__getitem__, parts))
    # runs of spaces: encode whole lines that hold them, which no merge leaves
    total = 0
    for i, line in enumerate(text.replace("▁", " ").split("\n")):
        if i:
            # a line after a break: the break is one token, and the text has no space before it
            total += lengths.encode("\n" + line) - 1
        else:
            inner = parts_of(line)
            total += sum(map(lengths.__getitem__, inner)) if inner is not None else lengths.encode(line) if line else 1
    return total


def frequent_parts(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS) -> bytes:
    """The frequent parts with their lengths, packed. They are counted in whole texts of about
    ``rows`` rows, drawn by a hash from all of the table; a bounded number of tasks each send
    their most frequent parts.

    The sample only warms the table: a part that it misses is encoded where it is met.
    """
    share = min(1.0, rows / max(1, docs.count()))

    def top(batches):
        counts: Counter = Counter()
        for whole in batches:
            for batch in slices(whole):
                for t in batch.column("text"):
                    counts.update(parts_of(t.as_py() or "") or ())
                if len(counts) > 20 * FREQUENT:  # parts seen once so far make room
                    counts = Counter({p: n for p, n in counts.items() if n > 1})
        best = counts.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["part", "n"])

    sample = docs.filter(unit_hash("doc_id", F.col("text")) < share).select("text").coalesce(SAMPLE_TASKS)
    counts: Counter = Counter()
    for r in sample.mapInArrow(top, "part string, n long").collect():  # SAMPLE_TASKS * FREQUENT rows at most
        counts[r["part"]] += r["n"]
    chosen = sorted(p for p, n in counts.most_common(FREQUENT) if n > 1)
    lengths = PartLengths(path)
    sizes = np.array([min(lengths[p], 65535) for p in chosen], np.uint16)
    return zlib.compress(b"".join([np.uint32(len(chosen)).tobytes(), sizes.tobytes(), " ".join(chosen).encode("utf-8")]))


def unpack_parts(packed: bytes) -> dict:
    raw = zlib.decompress(packed)
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    if n == 0:
        return {}
    sizes = np.frombuffer(raw[4 : 4 + 2 * n], np.uint16).tolist()
    return {p: s for p, s in zip(raw[4 + 2 * n :].decode("utf-8").split(" "), sizes) if s < 65535}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit) for every row.

    Null and empty texts have 0 bytes and tokens; texts of any length are counted whole;
    repeated rows and null ids stay; an empty table gives an empty one; extra columns are not
    looked at.
    """
    small_batches(docs.sparkSession)
    if not is_splittable(load_model(model_path)):
        raise ValueError("the model's pieces cross spaces: counting by parts would not be exact")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_parts(docs, model_path))

    def count(batches):
        lengths = PartLengths(model_path, unpack_parts(shared.value))
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").to_pylist()
                n = [count_tokens(t, lengths) for t in texts]
                size = [len(t.encode("utf-8")) if t else 0 for t in texts]
                columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
