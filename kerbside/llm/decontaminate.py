"""Benchmark decontamination: Wu-Manber search for all word windows of a benchmark at once.

Texts are folded to words between single spaces, so that a window is a string that starts and
ends with a space. Windows fall in classes of length; each class has a table of shifts by the
block of bytes that ends a position: how far the next possible end of a window's first bytes
is. Where the shift is 0, buckets by a hash of that block and of the window's head select
windows, and a comparison of all bytes confirms. Tasks search a slice of texts in many lanes at
once with numpy: each step moves every lane by its own shift.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, hash_blocks, small_batches, slices
from .folded_words import SPACE, STOP, folded

WINDOW = 10
#: Words of a benchmark text that are one row, and bytes of such rows that are one set of tables.
CHUNK_WORDS, BLOCK_BYTES = 1000, 2 << 20
#: Least bytes of the windows of each class: a short window must not shorten the shifts of all.
CLASSES = (1, 8, 24)
BLOCK, SHIFT_BITS, LANE = 8, 20, 2048
PAD = b"\0" * BLOCK
MIX = np.uint64(0x9E3779B97F4A7C15)


def loads(text: bytes) -> np.ndarray:
    """The 8 bytes at every offset of a padded text, as numbers."""
    return np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))


def first_bytes(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


@dataclass
class Windows:
    """Windows of one class of lengths: offsets and lengths in ``text``, shifts and buckets."""

    text: bytes
    starts: np.ndarray
    sizes: np.ndarray
    least: int = 0
    shifts: np.ndarray = field(default=None)
    keys: np.ndarray = field(default=None)

    def __post_init__(self):
        self.least = int(self.sizes.min())
        at, b = loads(self.text), self.block
        self.shifts = np.full(1 << SHIFT_BITS, self.least - b + 1, np.int32)
        for end in range(b, self.least + 1):
            np.minimum.at(self.shifts, self.slots(at[self.starts + end - b]), self.least - end)
        keys = self.bucket(at, self.starts + self.least)
        order = np.argsort(keys, kind="stable")
        self.starts, self.sizes, self.keys = self.starts[order], self.sizes[order], keys[order]
        self.order = order

    @property
    def block(self) -> int:
        return min(BLOCK, self.least)

    def slots(self, block: np.ndarray) -> np.ndarray:
        return ((block & first_bytes(self.block)) * MIX) >> np.uint64(64 - SHIFT_BITS)

    def bucket(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the block that ends there and of the window's head."""
        mask = first_bytes(self.block)
        tail, head = at[ends - self.block] & mask, at[ends - self.least] & mask
        return ((tail * MIX) ^ (tail >> np.uint64(29))) + head * np.uint64(0xC2B2AE3D27D4EB4F)

    def possible_ends(self, at: np.ndarray, stop: int) -> np.ndarray:
        """Offsets below ``stop`` where the first ``least`` bytes of a window may end."""
        here = np.arange(self.least, stop, LANE)
        ends = np.minimum(here + LANE, stop)
        found = []
        while len(here):
            step = self.shifts[self.slots(at[here - self.block])]
            found.append(here[step == 0])
            here = here + np.maximum(step, 1)
            inside = here < ends
            here, ends = here[inside], ends[inside]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def occurrences(self, text: bytes, at: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and window numbers of all occurrences, compared byte by byte."""
        ends = self.possible_ends(at, stop)
        keys = self.bucket(at, ends)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        begins = np.repeat(ends - self.least, n)
        same = [text[s : s + z] == self.text[a : a + z] for s, a, z in zip(begins.tolist(), self.starts[which].tolist(), self.sizes[which].tolist())]
        same = np.array(same, bool)
        return begins[same], self.order[which[same]]


@dataclass
class Benchmark:
    """Distinct windows of a block of items; which items hold each, as ranks of ``names``."""

    names: list[str]
    classes: list[tuple[Windows, np.ndarray]]
    words: np.ndarray
    heads: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str | None, str]], width: int) -> Benchmark:
        names = sorted({i for i, _ in rows if i is not None})
        rank = {i: n for n, i in enumerate(names)}
        number: dict[bytes, int] = {}
        starts, sizes, words, held = [], [], [], []
        text = b"".join([t.encode() for _, t in rows]) + PAD
        base = 0
        for item, t in rows:
            raw = t.encode()
            spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == SPACE)
            w = min(width, len(spaces) - 1)
            for a, b in zip(spaces[:-w].tolist(), spaces[w:].tolist()):
                window = raw[a : b + 1]
                n = number.setdefault(window, len(number))
                if n == len(starts):
                    starts.append(base + a)
                    sizes.append(b + 1 - a)
                    words.append(w)
                if item is not None:
                    held.append((n, rank[item]))
            base += len(raw)
        starts, sizes = np.array(starts, np.int64), np.array(sizes, np.int64)
        classes = []
        for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62)):
            those = np.flatnonzero((sizes >= low) & (sizes < high))
            if len(those):
                classes.append((Windows(text, starts[those], sizes[those]), those))
        pairs = np.array(sorted(set(held)), np.int64).reshape(-1, 2)
        return cls(names, classes, np.array(words, np.int64), np.searchsorted(pairs[:, 0], np.arange(len(starts) + 1)), pairs[:, 1])


def search(texts: list[bytes], benchmark: Benchmark) -> tuple[np.ndarray, dict]:
    """Words of each folded text, and for those with hits the hit ranges of words and item ranks."""
    joined = np.frombuffer(b"\0 " + b" \0 ".join(texts) + b" \0" if texts else b"\0", np.uint8)
    keep = np.ones(len(joined), bool)
    keep[1:] = (joined[1:] != SPACE) | (joined[:-1] != SPACE)
    text = joined[keep].tobytes()
    codes = np.frombuffer(text, np.uint8)
    spaces, stops = np.flatnonzero(codes == SPACE), np.flatnonzero(codes == STOP)
    head = np.searchsorted(spaces, stops)
    n_words = np.maximum(np.diff(head) - 1, 0)
    padded = text + PAD
    at, begins, which = loads(padded), [], []
    for windows, those in benchmark.classes:
        b, w = windows.occurrences(padded, at, len(text))
        begins.append(b)
        which.append(those[w])
    begins, which = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (begins, which))
    found: dict = {}
    if len(begins):
        doc = np.searchsorted(stops, begins) - 1
        first = np.searchsorted(spaces, begins)
        edges = np.zeros(len(spaces) + 1, np.int64)
        np.add.at(edges, first, 1)
        np.add.at(edges, first + benchmark.words[which], -1)
        hit = np.cumsum(edges) > 0
        for d in np.unique(doc).tolist():
            inside = np.concatenate([[False], hit[head[d] : head[d + 1] - 1], [False]]).astype(np.int8)
            turns = np.flatnonzero(np.diff(inside))
            w = np.unique(which[doc == d])
            items = np.unique(np.concatenate([benchmark.items[benchmark.heads[x] : benchmark.heads[x + 1]] for x in w.tolist()]))
            found[d] = (turns[::2], turns[1::2], items)
    return n_words, found


def joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, in order; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def chunks(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item, words): distinct parts of the items' folded texts, with the words between single
    spaces. A part has at most CHUNK_WORDS words and overlaps the next, so that each window
    lies whole in one."""

    def cut(batches):
        for whole in batches:
            for batch in slices(whole):
                items, out = [], []
                for item, text in zip(batch.column("item").to_pylist(), folded(batch.column("text"))):
                    words = text.split()
                    for at in range(0, max(len(words) - width + 1, min(len(words), 1)), CHUNK_WORDS - width + 1):
                        items.append(item)
                        out.append((b" " + b" ".join(words[at : at + CHUNK_WORDS]) + b" ").decode())
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, pa.string())], ["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(cut, "item string, words string").distinct()


FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words``, ``spans`` (ranges of hit words, end exclusive) and ``items`` (ids of the
    benchmark items with occurring windows, as strings in order) to every row of ``docs``.

    A window is ``width`` consecutive words of an item, or all words of one that has fewer. The
    benchmark's windows are searched in blocks of bounded size, one broadcast table each, so
    that a benchmark of any size can be used; with several blocks what was found is written
    between them. Null and empty texts, of documents or items, have no words; an item without
    an id hits words and is not listed; items that repeat count once; repeated documents stay;
    texts of any length are searched whole; empty tables give rows without hits, or no rows.
    Other columns pass through; an added column whose name is taken gets an underscore.
    """
    small_batches(docs.sparkSession)
    parts = checkpoint(chunks(benchmark, width))
    added = fresh(docs, "n_words", "spans", "items")
    found = docs.withColumns(dict(zip(added, (F.lit(None).cast("long"), F.lit(None).cast("array<struct<start:long,end:long>>"), F.lit(None).cast("array<string>")))))
    blocks = list(hash_blocks(parts, ["item", "words"], F.octet_length("words").cast("long"), block_bytes)) or [parts]
    for n, block in enumerate(blocks):
        rows = sorted(((r["item"], r["words"]) for r in block.collect()), key=lambda r: (r[0] or "", r[1]))
        found = searched(found, Benchmark.of(rows, width), added)
        if n + 1 < len(blocks):
            found = checkpoint(found)
    return found


def searched(docs: DataFrame, benchmark: Benchmark, added: list[str]) -> DataFrame:
    """``docs`` with what one block of the benchmark hits, joined to what others did."""
    shared = docs.sparkSession.sparkContext.broadcast(benchmark)
    names, schema = docs.columns, docs.schema
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]

    def scan(batches):
        b = shared.value
        for whole in batches:
            for batch in slices(whole):
                n_words, hits = search(folded(batch.column("text")), b)
                spans, items = ([x or [] for x in batch.column(name).to_pylist()] for name in added[1:])
                for d, (low, high, ranks) in hits.items():
                    ranges = joined_ranges([*((s["start"], s["end"]) for s in spans[d]), *zip(low.tolist(), high.tolist())])
                    spans[d] = [{"start": x, "end": y} for x, y in ranges]
                    items[d] = sorted({*items[d], *(b.names[r] for r in ranks.tolist())})
                new = dict(zip(added, (pa.array(n_words, kinds[0]), pa.array(spans, kinds[1]), pa.array(items, kinds[2]))))
                yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names)

    return docs.mapInArrow(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """For each document its words, hit words, items and whether it is contaminated, as
    ``find_windows`` finds them; rows, nulls and repeats are as there, extra columns are not looked at."""
    found = find_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, width)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs``, with all its columns, without the rows that hold a window of the benchmark."""
    found = find_windows(docs, benchmark, width)
    return found.filter(F.size(found.columns[-2]) == 0).select(*docs.columns)
