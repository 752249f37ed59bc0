"""Near duplicates: a Jaccard join on word 5-grams with Bayesian pruning of candidates.

1. Each text becomes its set of hashed 5-word shingles; texts with equal sets collapse into
   one before anything is compared.
2. MinHash bands propose candidates: a pair at the threshold shares none of the bands with
   probability (1 - 0.8^4)^30, about 1e-7. Sets that share a band meet at that band's centre,
   so no chain of bands brings others there; a set has few centres, since a centre is a
   small label that neighbours agree on.
3. What meets at a centre is dealt into blocks by set size, and only blocks whose sizes can
   reach the threshold meet. Pairs that also meet at a smaller centre are left to that one.
   MinHash values are compared step by step; a pair goes once the posterior probability
   (uniform prior) of reaching the threshold falls below the tolerance; the rest are verified
   exactly by their shingles.
4. Only counts of links and the classes of a block leave the task, so a group of n near
   copies gives n rows for each block, not n^2.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, slices
from .graph import connected_components

WORD = re.compile(r"\w+")
SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 4
#: MinHash values compared at each step of the pruning.
STEP = 20
TOLERANCE = 1e-9
#: Shingles and rows that one block holds on average, at most.
BLOCK_SHINGLES, BLOCK_ROWS = 150_000, 300
SIZE_BASE = 1.25
#: Words whose hashes a task remembers. It sets the speed only.
CACHED_WORDS = 100_000

_draw = np.random.default_rng(20240229)
MULTIPLIERS = _draw.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = value
        return value


def shingles(text: str | None, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. A text of fewer words has one
    shingle, all its words; one without words has none."""
    found = WORD.findall((text or "").lower())
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if len(h) == 0:
        return h
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS * ROWS) MinHash values; all sets must have a member."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    every = np.concatenate(sets)
    x = ((every >> np.uint64(32)) ^ every).astype(np.uint32)
    out = np.empty((len(sets), len(MULTIPLIERS)), np.uint32)
    for k, (m, c) in enumerate(zip(MULTIPLIERS, OFFSETS)):
        out[:, k] = np.minimum.reduceat((x * m) ^ c, starts)
    return out


def batches_of_sets(sets: list[np.ndarray], most: int = 100_000):
    at = held = 0
    for i, s in enumerate(sets):
        held += len(s)
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(sets):
        yield at, len(sets)


@lru_cache(maxsize=None)
def least_matches(threshold: float = THRESHOLD, step: int = STEP, hashes: int = BANDS * ROWS, tolerance: float = TOLERANCE) -> tuple:
    """For each number of compared values, the fewest matches that keep a pair: with m of n
    matching, the posterior of the similarity is Beta(m + 1, n - m + 1)."""

    def tail(m: int, n: int) -> float:
        grid = np.linspace(threshold, 1.0, 2001)[1:-1]
        a, b = m + 1, n - m + 1
        density = np.exp((a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid) + lgamma(a + b) - lgamma(a) - lgamma(b))
        return float(density.sum() * (1.0 - threshold) / 2000)

    return tuple(next(m for m in range(n + 1) if m == n or tail(m, n) >= tolerance) for n in range(step, hashes + 1, step))


def miss_probability(threshold: float = THRESHOLD) -> float:
    return exp(BANDS * log(1 - threshold**ROWS))


def links_between(sets_a, sigs_a, sets_b, sigs_b, same: bool, threshold: float = THRESHOLD, elsewhere=None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose Jaccard similarity reaches the threshold (a < b within one block), but
    for those that ``elsewhere(rows of a)`` marks in its (rows, all of b) matrix."""
    sizes_a, sizes_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    least = least_matches(threshold)
    found_a, found_b = [], []
    for low in range(0, len(sets_a), 256):
        part = slice(low, low + 256)
        small, large = np.minimum.outer(sizes_a[part], sizes_b), np.maximum.outer(sizes_a[part], sizes_b)
        ok = small >= threshold * large - 1e-9
        if same:
            ok &= np.arange(len(sets_b))[None, :] > np.arange(low, low + ok.shape[0])[:, None]
        if elsewhere is not None:
            ok &= ~elsewhere(part)
        i, j = np.nonzero(ok)
        matches = np.zeros(len(i), np.int32)
        for s, fewest in enumerate(least):
            if len(i) == 0:
                break
            cut = slice(s * STEP, (s + 1) * STEP)
            for at in range(0, len(i), 200_000):
                some = slice(at, at + 200_000)
                matches[some] += (sigs_a[low + i[some], cut] == sigs_b[j[some], cut]).sum(axis=1, dtype=np.int32)
            live = matches >= fewest
            i, j, matches = i[live], j[live], matches[live]
        if len(i) == 0:
            continue
        rows, columns = np.unique(i), np.unique(j)
        both = overlaps([sets_a[low + r] for r in rows], [sets_b[c] for c in columns]) if len(i) * 8 > len(rows) * len(columns) else None
        if both is not None:
            inter = both[np.searchsorted(rows, i), np.searchsorted(columns, j)]
        else:
            inter = np.array([len(np.intersect1d(sets_a[low + a], sets_b[b], assume_unique=True)) for a, b in zip(i, j)])
        union = sizes_a[low + i] + sizes_b[j] - inter
        good = inter >= threshold * union - 1e-9
        found_a.append(low + i[good])
        found_b.append(j[good])
    if not found_a:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(found_a), np.concatenate(found_b)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices in slices of the shingles."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float64)

    def matrix(sets, some):
        m = np.zeros((len(sets), len(some)), np.float32)
        for r, s in enumerate(sets):
            at = np.searchsorted(some, s)
            at[at == len(some)] = 0
            m[r, at[some[at] == s]] = 1.0
        return m

    for low in range(0, len(shared), 8192):
        some = shared[low : low + 8192]
        out += matrix(a, some) @ matrix(b, some).T
    return out.astype(np.int64)


def met_elsewhere(others_a: list, others_b: list):
    """A function of a slice of a's rows: which pairs with b's rows share one of their other
    centres. None if no such pair can be."""
    shared = np.intersect1d(np.concatenate([np.zeros(0, np.int64), *others_a]), np.concatenate([np.zeros(0, np.int64), *others_b]))
    if len(shared) == 0:
        return None

    def matrix(others: list) -> np.ndarray:
        m = np.zeros((len(others), len(shared)), np.float32)
        for r, own in enumerate(others):
            m[r, np.searchsorted(shared, own[np.isin(own, shared)])] = 1.0
        return m

    # a row has at most BANDS centres, so what a block has in common is bounded too
    a, b = matrix(others_a), matrix(others_b)
    return lambda part: (a[part] @ b.T) > 0


def classes_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def text_key() -> Column:
    """With the doc_id, tells a row's text from others of that id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n shingles, set_id: digest of the shingle set, bands: hashes of the
    bands, null for a text without words)."""
    small_batches(docs.sparkSession)

    def sign(batches):
        words = WordHashes()
        for whole in batches:
            for batch in slices(whole):
                sets = [shingles(t.as_py(), words) for t in batch.column("text")]
                at = [i for i, x in enumerate(sets) if len(x)]
                full = [sets[i] for i in at]
                bands: list = [None] * len(sets)
                for a, b in batches_of_sets(full):
                    h = min_hashes(full[a:b]).astype(np.uint64).reshape(b - a, BANDS, ROWS)
                    mixed = np.full((b - a, BANDS), 0x2545F4914F6CDD1D, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        mixed = (mixed ^ h[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                        mixed ^= mixed >> np.uint64(31)
                    for i, row in zip(at[a:b], mixed.view(np.int64)):
                        bands[i] = row
                ids = [set_digest(x) for x in sets]
                columns = [batch.column("doc_id"), batch.column("text_key"), pa.array([len(x) for x in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "set_id", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return rows.mapInArrow(sign, "doc_id long, text_key long, n long, set_id binary, bands array<long>")


def set_digest(members: np.ndarray) -> bytes:
    return blake2b(members.tobytes(), digest_size=16).digest()


def centres(sets: DataFrame) -> DataFrame:
    """(centre, key): where sets that share a band meet.

    A set's label is the smallest key with which it shares a band; a band's centre is the
    smallest label of its sets. So the sets of one band have a centre in common, and near copies
    have mostly one, though no more than two bands lie between any two sets of a centre.
    Minima per band and per key combine in the tasks and are written before they are joined, so
    that a band which many sets share is split over tasks.
    """
    banded = sets.select("key", F.explode("bands").alias("band"))
    low = checkpoint(banded.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select(F.col("band").alias("of"), "low"))
    hits = checkpoint(banded.join(low, F.col("band") == F.col("of")).select("key", "band", "low"))
    label = checkpoint(hits.groupBy(F.col("key").alias("k")).agg(F.min("low").alias("label")))
    labelled = hits.join(label, F.col("key") == F.col("k")).select("key", "band", "label")
    centre = checkpoint(labelled.groupBy(F.col("band").alias("of")).agg(F.min("label").alias("centre")))
    return hits.join(centre, F.col("band") == F.col("of")).select("centre", "key").distinct()


def blocks_of(members: DataFrame) -> DataFrame:
    """Deal (centre, key, n, ...) into blocks and say which pairs of blocks each row must meet.

    A block is a size class of a centre, split by a hash of key so that it holds about
    BLOCK_SHINGLES shingles or BLOCK_ROWS rows, whichever are fewer. Sizes that can reach the threshold differ by one class at most.
    """
    sized = members.withColumn("class", F.floor(F.log("n") / F.lit(log(SIZE_BASE)) + 1e-9).cast("int"))
    weights = sized.groupBy("centre", "class").agg(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    parts = weights.select("centre", "class", F.greatest(F.lit(1), F.ceil("blocks")).cast("int").alias("parts"))
    near = parts.select(F.col("centre").alias("c2"), F.col("class").alias("k2"), F.col("parts").alias("p2"))
    # of each class: its own parts, those of the class above and of the class below
    plan = parts.join(near, (F.col("centre") == F.col("c2")) & (F.abs(F.col("class") - F.col("k2")) <= 1)).groupBy("centre", "class").agg(
        F.max("parts").alias("own"),
        F.max(F.when(F.col("k2") == F.col("class") + 1, F.col("p2"))).alias("above"),
        F.max(F.when(F.col("k2") == F.col("class") - 1, F.col("p2"))).alias("below"),
    )
    dealt = sized.join(checkpoint(plan), ["centre", "class"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("own")).cast("int"))
    name = lambda lo_class, lo, hi_class, hi: F.struct(lo_class.alias("lo_class"), lo.alias("lo"), hi_class.alias("hi_class"), hi.alias("hi"))
    c, p = F.col("class"), F.col("part")
    upto = lambda n: F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<int>")
    pairs = F.concat(
        F.transform(upto(F.col("own")), lambda q: name(c, F.least(p, q), c, F.greatest(p, q))),
        F.transform(F.coalesce(upto(F.col("above")), none), lambda q: name(c, p, c + 1, q)),
        F.transform(F.coalesce(upto(F.col("below")), none), lambda q: name(c - 1, q, c, p)),
    )
    return dealt.select(*members.columns, "class", "part", F.explode(pairs).alias("pair")).select(*members.columns, "class", "part", "pair.*")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text).

    Output: doc_id, class_id (the smallest doc_id of its class: texts joined by links),
    class_size (rows), n_links (other rows with similarity of ``threshold`` or more, equal
    texts too), n_text_links (other shingle sets that it links to). Words are compared without case
    and punctuation. Null and empty texts, and those without words, link to nothing; texts
    shorter than a shingle link to equal ones; rows that repeat link to each other; a doc_id may
    repeat with different texts, which are told apart; rows with a null id pass through with
    themselves as class; empty tables give empty ones; extra columns are not looked at.
    """
    return classes(docs, threshold).select("doc_id", "class_id", "class_size", "n_links", "n_text_links")


def classes(docs: DataFrame, threshold: float) -> DataFrame:
    """As ``near_duplicates``, with text_key and keeper (whether the row's text is the one that
    stands for its class: of the class's smallest doc_id, the smallest shingle set, and of
    that the smallest text_key)."""
    if threshold < THRESHOLD:
        raise ValueError(f"the bands are laid out for thresholds of {THRESHOLD} or more")
    signed = checkpoint(signatures(docs))
    usable = signed.filter("doc_id is not null and n > 0")
    first = F.min(F.struct("doc_id", "text_key"))
    grouped = usable.groupBy("set_id").agg(first.alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    # the key is drawn once, since it is written before it is read
    sets = checkpoint(grouped.select(F.monotonically_increasing_id().alias("key"), "set_id", "rep", "copies", "n", "bands"))
    met = checkpoint(centres(sets))
    verified = checkpoint(verify(docs, sets.drop("bands"), met, threshold))
    counts = verified.filter("kind = 0").groupBy(F.col("a").alias("key_l")).agg(F.sum("rows").alias("link_rows"), F.sum("links").alias("text_links"))
    joined = connected_components(verified.filter("kind = 1").select("a", "b"))
    labelled = checkpoint(
        sets.join(joined, F.col("key") == F.col("node"), "left")
        .join(counts, F.col("key") == F.col("key_l"), "left")
        .select("set_id", "rep", "copies", F.coalesce("component", "key").alias("class"), F.coalesce("link_rows", F.lit(0)).alias("link_rows"), F.coalesce("text_links", F.lit(0)).alias("text_links"))
    )
    totals = checkpoint(labelled.groupBy(F.col("class").alias("of")).agg(F.sum("copies").alias("class_size"), F.min(F.struct("rep.doc_id", "set_id", "rep.text_key")).alias("best")))
    full = checkpoint(labelled.join(totals, F.col("class") == F.col("of")).select(F.col("set_id").alias("found_id"), "copies", "best", "class_size", "link_rows", "text_links"))
    rows = signed.select("doc_id", "text_key", F.when(F.expr("doc_id is not null and n > 0"), F.col("set_id")).alias("found_key"))
    out = rows.join(full, F.col("found_key") == F.col("found_id"), "left")
    own = (F.col("doc_id") == F.col("best.doc_id")) & (F.col("found_id") == F.col("best.set_id")) & (F.col("text_key") == F.col("best.text_key"))
    return out.select(
        "doc_id",
        "text_key",
        F.coalesce("best.doc_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce(F.col("link_rows") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("text_links", F.lit(0)).cast("long").alias("n_text_links"),
        F.coalesce(own, F.lit(True)).alias("keeper"),
    )


def verify(docs: DataFrame, sets: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """Links among the sets that meet at a centre: rows (kind 0, a, links, rows) are partial
    counts of a's links, rows (kind 1, a, b) join a to the smallest set b of its class in a
    block. Shingles are made again from the texts of sets that meet, so none are stored."""
    own = met.groupBy(F.col("key").alias("k")).agg(F.sort_array(F.collect_list("centre")).alias("all"))  # at most BANDS of them
    where = met.join(own, F.col("key") == F.col("k")).select("centre", "key", F.filter("all", lambda x: x < F.col("centre")).alias("others"))
    members = checkpoint(where.join(sets.select(F.col("key").alias("s"), "set_id", "n", "copies"), F.col("key") == F.col("s")).select("centre", "key", "set_id", "n", "copies", "others"))
    chosen = sets.join(own, F.col("key") == F.col("k"), "left_semi").select(F.col("rep.doc_id").alias("id"), F.col("rep.text_key").alias("t"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    texts = rows.join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("text_key") == F.col("t")), "left_semi").select("text")

    def prepare(batches):
        words = WordHashes()
        for whole in batches:
            for batch in slices(whole):
                made = [x for x in (shingles(t.as_py(), words) for t in batch.column("text")) if len(x)]
                for a, b in batches_of_sets(made):
                    columns = [[set_digest(x) for x in made[a:b]], [x.tobytes() for x in made[a:b]], [x.tobytes() for x in min_hashes(made[a:b])]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in columns], ["id", "shingles", "sig"])

    # rows that repeat have equal sets: any of them will do
    prepared = checkpoint(texts.mapInArrow(prepare, "id binary, shingles binary, sig binary").dropDuplicates(["id"]))
    dealt = blocks_of(members).join(prepared, F.col("set_id") == F.col("id")).select("centre", "lo_class", "lo", "hi_class", "hi", "class", "part", "key", "copies", "others", "shingles", "sig")

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        first = rows.iloc[0]
        same = (first["lo_class"], first["lo"]) == (first["hi_class"], first["hi"])
        is_lo = ((rows["class"] == first["lo_class"]) & (rows["part"] == first["lo"])).to_numpy()
        members = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
        sigs = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), BANDS * ROWS)
        others = [np.asarray(x, np.int64) for x in rows["others"]]
        a_at, b_at = (np.arange(len(rows)),) * 2 if same else (np.flatnonzero(is_lo), np.flatnonzero(~is_lo))
        if len(a_at) == 0 or len(b_at) == 0:
            return pd.DataFrame({"kind": [], "a": [], "b": [], "links": [], "rows": []}, dtype="int64")
        elsewhere = met_elsewhere([others[i] for i in a_at], [others[i] for i in b_at])
        a, b = links_between([members[i] for i in a_at], sigs[a_at], [members[i] for i in b_at], sigs[b_at], same, threshold, elsewhere)
        a, b = a_at[a], b_at[b]
        ids, copies = rows["key"].to_numpy(), rows["copies"].to_numpy()
        links = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        partners = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        at = np.flatnonzero(links)
        root = classes_of(a, b, len(rows))
        moved = np.flatnonzero(root != np.arange(len(rows)))
        zero = np.zeros(len(moved), int)
        return pd.DataFrame(
            {
                "kind": np.concatenate([np.zeros(len(at), int), zero + 1]),
                "a": np.concatenate([ids[at], ids[moved]]),
                "b": np.concatenate([ids[at], ids[root[moved]]]),
                "links": np.concatenate([links[at], zero]),
                "rows": np.concatenate([partners[at].astype(np.int64), zero]),
            }
        )

    return dealt.groupBy("centre", "lo_class", "lo", "hi_class", "hi").applyInPandas(check, "kind long, a long, b long, links long, rows long")


def keep_one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all its columns) with one text of each class: that of its smallest doc_id.

    Rows are told apart by doc_id and text, so rows equal in both stay or go together; one
    doc_id with several texts keeps those that stand for a class. Texts without words and rows
    with a null id all stay; an empty table gives an empty one; any other columns may be there,
    whatever their names.
    """
    gone = classes(docs, threshold).filter(~F.col("keeper")).select(F.struct("doc_id", "text_key").alias("gone")).distinct()
    own = F.struct(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_key"))
    return docs.join(gone, own == gone["gone"], "left_anti")
