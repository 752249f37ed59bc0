"""Exact top-k inner-product search: ball-tree branch and bound in each shard.

Vectors are dealt into shards, and queries, which are some of the rows, into blocks; each task
gets one shard and one block. It builds a ball tree, descends it with all queries of the block,
cuts a subtree for each query whose upper bound of the inner product stays below that query's
current k-th score, and visits the leaves that are left in the order of their bounds, query by
query. A first round searches one shard for each block; its k-th scores are then the floors from
which all other shards start. Shards, blocks and floors are tables: nothing passes the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Rows of a shard, of a block of queries and of a leaf.
SHARD, BLOCK, LEAF = 16_384, 4_096, 256
#: Below any score that a long can hold, and so that its negative is a long too.
NONE = -(2**63 - 1)
#: Stands for a null vec_id, which loses all ties.
NO_ID = 2**63 - 1
#: Vectors up to this component go into trees; their scores are sums of longs.
LARGE = float(1 << 26)


class BallTree:
    """Balls around halves of the points, down to leaves; nodes stand after their parents."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.centres, self.radii, self.parents, self.leaves = [], [], [], []
        todo = [(np.arange(len(points)), -1)]
        while todo:
            at, parent = todo.pop()
            part = points[at]
            centre = part.mean(axis=0)
            away = ((part - centre) ** 2).sum(axis=1)
            node = len(self.centres)
            self.centres.append(centre)
            self.radii.append(np.sqrt(away.max()))
            self.parents.append(parent)
            if len(at) <= leaf or away.max() == 0:
                self.leaves.append((node, at))
                continue
            pole = part[away.argmax()]
            other = part[((part - pole) ** 2).sum(axis=1).argmax()]
            order = np.argsort(part @ (other - pole), kind="stable")
            todo += [(at[order[: len(at) // 2]], node), (at[order[len(at) // 2 :]], node)]

    def leaf_bounds(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Descend with all queries: upper bounds of the inner products in each leaf, -inf where
        the leaf or a ball around it can't reach the query's floor."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        raw = queries @ np.array(self.centres).T + norms[:, None] * np.array(self.radii)[None, :]
        bounds = raw + 1e-6 * (1.0 + np.abs(raw))  # a little loose against rounding
        for node, parent in enumerate(self.parents):
            if parent >= 0:
                np.minimum(bounds[:, node], bounds[:, parent], out=bounds[:, node])
            bounds[bounds[:, node] < floor, node] = -np.inf
        return bounds[:, [node for node, _ in self.leaves]]


class Best:
    """The k best (score, then smaller id) of each query so far, none below ``floor``."""

    def __init__(self, k: int, floor: np.ndarray):
        self.floor = floor
        self.scores = np.full((len(floor), k), NONE)
        self.ids = np.full((len(floor), k), NO_ID)

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        live = (scores >= self.kth()[rows, None]) & (scores > NONE)
        some = live.any(axis=1)
        if not some.any():
            return
        rows, scores, columns = rows[some], scores[some], live[some].any(axis=0)
        all_scores = np.concatenate([self.scores[rows], scores[:, columns]], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids[columns], (len(rows), int(columns.sum())))], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        self.scores[rows] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(all_ids, order, axis=1)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of whole numbers; floats carry them while all sums stay under 2^53."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search_tree(points: np.ndarray, keys: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, best: Best, leaf: int = LEAF) -> int:
    """Offer all that can matter to ``best``; a point whose key is the query's own is left out.
    Returns the number of products that were made."""
    tree = BallTree(points, leaf)
    bounds = tree.leaf_bounds(queries, best.kth())
    order = np.argsort(-bounds, axis=1)
    rows, made = np.arange(len(queries)), 0
    for turn in range(bounds.shape[1]):
        # a query's leaves come by falling bounds: once one fails, all the rest do
        bound = bounds[rows, order[rows, turn]]
        rows = rows[(bound > -np.inf) & (bound >= best.kth()[rows])]
        if len(rows) == 0:
            break
        now = order[rows, turn]
        by_leaf = np.argsort(now, kind="stable")
        for group in np.split(rows[by_leaf], np.flatnonzero(np.diff(now[by_leaf])) + 1):
            members = tree.leaves[order[group[0], turn]][1]
            for at in range(0, len(members), 4096):  # equal points make leaves of any size
                part = members[at : at + 4096]
                for low in range(0, len(group), 1024):
                    some = group[low : low + 1024]
                    scores = inner_products(queries[some], points[part])
                    scores[own[some][:, None] == keys[part][None, :]] = NONE
                    made += scores.size
                    best.offer(some, scores, ids[part])
    return made


def exact_products(queries: np.ndarray, points: np.ndarray, own: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(query row, id, score) of each query's k best, in whole numbers of any size."""
    whole = [[int(x) for x in p] for p in points]
    out = []
    for row, q in enumerate(queries):
        q = [int(x) for x in q]
        scored = sorted((-sum(map(int.__mul__, q, p)), i) for p, key, i in zip(whole, keys.tolist(), ids.tolist()) if key != own[row])
        out += [(row, i, -s) for s, i in scored[:k]]
    return out


def usable() -> Column:
    return F.coalesce(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def top_k(rows: DataFrame, k: int = 20, every: int = 20, scale: int = 64, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The ``k`` best other rows of each query (a row whose vec_id ``every`` divides).

    Input (vec_id, embedding); extra columns are not looked at. Components count as
    floor(scale * x). Null vectors, and those with null or non-finite components, take no
    part; vectors meet only those of their own length. Rows are told apart, not ids: of rows
    that repeat an id each is a candidate, and each query row gets results of its own under that
    id. A row with a null id is a candidate, not a query. An empty table gives no rows.
    Output: query_id, rank from 1, vec_id, score; ties go to the smaller vec_id, nulls last. A score
    beyond a long is written as the nearest long, and ranks by its value as a double.
    """
    x = F.transform("embedding", lambda c: c.cast("double") * float(scale))
    drawn = rows.select("vec_id", "embedding").filter(usable()).select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
    vectors = checkpoint(drawn.withColumn("v", F.transform("v", lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))).withColumn("d", F.size("v")))
    asked = vectors.filter(F.col("vec_id") % every == 0)
    n, m = vectors.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    dealt = vectors.select("d", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "v")
    queries = asked.select("d", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).alias("block"), "key", "vec_id", "v", F.lit(NONE).cast("long").alias("floor"))
    first = checkpoint(search(dealt, queries, F.col("block") % shards, k, shards, blocks))
    kth = first.groupBy(F.col("q_key").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    floored = queries.drop("floor").join(kth, F.col("key") == F.col("of"), "left").select("d", "block", "key", "vec_id", "v", F.coalesce("kth", F.lit(NONE).cast("long")).alias("floor"))
    found = first
    if shards > 1:
        found = first.unionByName(search(dealt, checkpoint(floored), None, k, shards, blocks))
    order = Window.partitionBy("q_key").orderBy(F.col("score").desc(), F.col("approx").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def search(dealt: DataFrame, queries: DataFrame, one: Column | None, k: int, shards: int, blocks: int) -> DataFrame:
    """(q_key, query_id, vec_id, score, approx) of each pair of shard and block: those where the
    shard is ``one`` of the block, or all others."""
    of_block = F.array(one) if one is not None else F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("block") % shards)
    of_shard = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: (b % shards == F.col("shard")) if one is not None else (b % shards != F.col("shard")))
    right = queries.select(F.explode(of_block.cast("array<long>")).alias("q_shard"), F.col("block").cast("long").alias("q_block"), F.col("d").alias("q_d"), F.col("key").alias("q_key"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "floor")
    left = dealt.select("shard", F.explode(of_shard.cast("array<long>")).alias("block"), "d", "key", "vec_id", "v")

    def pair(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {c: np.zeros(0, np.int64) for c in ("q_key", "query_id", "vec_id", "score")} | {"approx": np.zeros(0)}
        if len(rows) == 0 or len(asked) == 0:
            return pd.DataFrame(out)
        matrix = lambda column, d: np.array(column.tolist(), float).reshape(len(column), d)
        d = int(rows["d"].iloc[0])
        points, queries = matrix(rows["v"], d), matrix(asked["q"], d)
        keys, ids, own = (x.to_numpy() for x in (rows["key"], rows["vec_id"], asked["q_key"]))
        best = Best(k, asked["floor"].to_numpy())
        plain_p, plain_q = (np.abs(x).max(axis=1, initial=0) <= LARGE for x in (points, queries))
        p_at, q_at = np.flatnonzero(plain_p), np.flatnonzero(plain_q)
        if len(p_at) and len(q_at):
            part = Best(k, best.floor[q_at])
            search_tree(points[p_at], keys[p_at], ids[p_at], queries[q_at], own[q_at], part)
            best.scores[q_at], best.ids[q_at] = part.scores, part.ids
        row, column = np.nonzero(best.scores > NONE)
        made = [pd.DataFrame({"row": row, "vec_id": best.ids[row, column], "score": best.scores[row, column], "approx": best.scores[row, column].astype(float)})]
        huge_p, huge_q = np.flatnonzero(~plain_p), np.flatnonzero(~plain_q)
        for q_some, p_some in ((q_at, huge_p), (huge_q, np.arange(len(points)))):
            if len(q_some) and len(p_some):
                found = exact_products(queries[q_some], points[p_some], own[q_some], keys[p_some], ids[p_some], k)
                made.append(pd.DataFrame([(q_some[r], i, min(max(s, NONE), 2**63 - 1), float(s)) for r, i, s in found], columns=["row", "vec_id", "score", "approx"]))
        found = pd.concat([m for m in made if len(m)] or made[:1])
        at = found["row"].to_numpy(int)
        return pd.DataFrame({"q_key": own[at], "query_id": asked["query_id"].to_numpy()[at], "vec_id": found["vec_id"].to_numpy(), "score": found["score"].to_numpy(), "approx": found["approx"].to_numpy()})

    groups = left.groupBy("d", "shard", "block").cogroup(right.groupBy("q_d", "q_shard", "q_block"))
    return groups.applyInPandas(pair, "q_key long, query_id long, vec_id long, score long, approx double")
