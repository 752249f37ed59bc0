"""Ranked lexical search: a blocked sparse product of items by terms and terms by documents.

Items are rows of a sparse matrix of how often each has a term; each slice of documents is a
sparse matrix of int64 impacts, term by document. Gustavson's way makes a product row from the
rows of the right matrix that the left row names: an item's scores are sums of whole term
rows, added with numpy. Each task keeps the best of each item; salted groups and then one group
for each item reduce these, so that nothing but k rows for each task and item is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, hash_blocks, small_batches, slices
from .folded_words import folded, pieces

#: Entries of a block of the left matrix, and groups of tasks that reduce first.
BLOCK_TERMS, SALTS = 200_000, 64


@dataclass
class ItemTerms:
    """A block of the left matrix, by item: terms and how often; ``names`` are their ids."""

    names: list
    terms: list[bytes]
    heads: np.ndarray
    columns: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows) -> ItemTerms:
        """Of (item, term, n) in order of items."""
        names, terms, heads, columns, times = [], {}, [], [], []
        for i, (item, term, n) in enumerate(rows):
            if not names or names[-1] != item:
                names.append(item)
                heads.append(i)
            columns.append(terms.setdefault(term.encode(), len(terms)))
            times.append(n)
        return cls(names, list(terms), np.array([*heads, len(columns)]), np.array(columns), np.array(times, np.int64))


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(item_id, term, n): how often the item has the term. Rows of one id are one item, whose
    texts are joined; null texts have no terms."""

    def split(batches):
        for whole in batches:
            for batch in slices(whole):
                ids, out = [], []
                for item, text in zip(batch.column("item_id").to_pylist(), folded(batch.column("text"))):
                    for piece in pieces(text):
                        words = piece.split()
                        ids.extend(repeat(item, len(words)))
                        out.extend(w.decode() for w in words)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["item_id", "term"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(split, "item_id long, term string")
    return rows.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def postings_of(texts: list[bytes], numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All terms of each text, and in order of (term, document): term numbers, documents, counts."""
    lengths = np.zeros(len(texts), np.int64)
    keys = [np.empty(0, np.int64)]
    for d, text in enumerate(texts):
        for piece in pieces(text):
            words = piece.split()
            lengths[d] += len(words)
            found = np.fromiter(map(numbers.get, words, repeat(-1)), np.int64, len(words))
            keys.append(found[found >= 0] * len(texts) + d)
    at, n = np.unique(np.concatenate(keys), return_counts=True)
    return lengths, at // max(len(texts), 1), at % max(len(texts), 1), n


def corpus_counts(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each of ``terms``, over all
    rows: each task adds up its own, so that no word is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        numbers = {t: i for i, t in enumerate(shared.value)}
        held, n, total = np.zeros(len(numbers), np.int64), 0, 0
        for whole in batches:
            for batch in slices(whole):
                lengths, term, _, _ = postings_of(folded(batch.column("text")), numbers)
                held += np.bincount(term, minlength=len(numbers))
                n += int((lengths > 0).sum())
                total += int(lengths.sum())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *at.tolist()], pa.int64()), pa.array([n, total, *held[at].tolist()], pa.int64())], ["slot", "n"])

    sums = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = {r["slot"]: r["n"] for r in sums.collect()}  # a row for each of the terms, at most
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(terms))], np.int64)


def term_weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.floor(1000.0 * np.log((2.0 * n_docs + 2.0) / (2.0 * held + 1.0))).astype(np.int64)


def length_measures(lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """75 and a quarter of a hundred for each average length that a document has."""
    if 25 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        return 75 + 25 * lengths * n_docs // max(total, 1)
    return np.array([75 + 25 * int(x) * n_docs // total for x in lengths], np.int64)


class Best:
    """The k best (score, document) of each item; equal scores by the smaller id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores = [np.empty(0, np.int64)] * items
        self.ids = [np.empty(0, np.int64)] * items
        self.nulls = [np.empty(0, bool)] * items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        held = self.scores[item]
        if len(held) == self.k:
            better = scores >= held[-1]
            scores, ids, nulls = scores[better], ids[better], nulls[better]
        if not len(scores):
            return
        if len(scores) > self.k:  # all that tie with the k-th stay for now
            some = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids, nulls = scores[some], ids[some], nulls[some]
        s, i, z = np.concatenate([held, scores]), np.concatenate([self.ids[item], ids]), np.concatenate([self.nulls[item], nulls])
        order = np.lexsort((i, z, -s))[: self.k]
        self.scores[item], self.ids[item], self.nulls[item] = s[order], i[order], z[order]


def product_rows(left: ItemTerms, weights: np.ndarray, slots: np.ndarray, heads: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
    """(item, scores of all documents) for each item that shares a term with the block: rows of
    the right matrix, merged as the left row names them."""
    for item in range(len(left.names)):
        scores = None
        for e in range(left.heads[item], left.heads[item + 1]):
            column = left.columns[e]
            row = slots[column]
            factor = weights[column] * left.times[e]
            if row < 0 or factor == 0:
                continue
            if scores is None:
                scores = np.zeros(n_docs, np.int64)
            a, b = heads[row], heads[row + 1]
            scores[docs[a:b]] += factor * impacts[a:b]
        if scores is not None:
            yield item, scores


def best_of_block(docs: DataFrame, left: ItemTerms, k: int) -> DataFrame:
    """(item_id, doc_id, score) of the k best documents of each task for each item of a block."""
    n_docs, total, held = corpus_counts(docs, left.terms)
    shared = docs.sparkSession.sparkContext.broadcast((left, term_weights(n_docs, held)))

    def multiply(batches):
        left, weights = shared.value
        numbers = {t: i for i, t in enumerate(left.terms)}
        best = Best(len(left.names), k)
        for whole in batches:
            for batch in slices(whole):
                lengths, term, doc, n = postings_of(folded(batch.column("text")), numbers)
                if not len(term):
                    continue
                impacts = (1_000_000_000 * n) // (1000 * n + 12 * length_measures(lengths, n_docs, total)[doc])
                rows, heads = np.unique(term, return_index=True)
                slots = np.full(len(weights), -1, np.int64)
                slots[rows] = np.arange(len(rows))
                ids = batch.column("doc_id")
                nulls, keys = np.array(ids.is_null()), np.array(ids.fill_null(0))
                for item, scores in product_rows(left, weights, slots, np.append(heads, len(term)), doc, impacts, len(lengths)):
                    some = np.flatnonzero(scores > 0)
                    best.add(item, scores[some], keys[some], nulls[some])
        for item, name in enumerate(left.names):
            if len(best.scores[item]):
                size = len(best.scores[item])
                yield pa.RecordBatch.from_arrays([pa.array([name] * size, pa.int64()), pa.array(best.ids[item], pa.int64(), mask=best.nulls[item]), pa.array(best.scores[item])], ["item_id", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(multiply, "item_id long, doc_id long, score long")


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 20, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item.

    Every row of ``docs`` is a document, repeats too; null and empty texts have no terms and no
    rank; texts of any length count whole. Equal scores go by ascending doc_id, null ids last.
    Rows of one item_id are one item, null being an id too; an item without terms, or whose terms
    no document holds, gives no rows, as do empty tables. Items are taken in blocks of bounded
    size, so that there may be any number of them; extra columns are not looked at.
    """
    small_batches(docs.sparkSession)
    matrix = checkpoint(item_terms(benchmark))
    best = None
    for block in hash_blocks(matrix, ["item_id"], F.lit(1), block_terms):
        left = ItemTerms.of(sorted(((r["item_id"], r["term"], r["n"]) for r in block.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
        found = best_of_block(docs, left, k)
        best = found if best is None else best.unionByName(found)
    if best is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    salt, rank = fresh(best, "salt", "rank")
    best = best.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    few = best.withColumn(rank, F.row_number().over(Window.partitionBy("item_id", salt).orderBy(*order))).filter(F.col(rank) <= k).drop(rank)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")
