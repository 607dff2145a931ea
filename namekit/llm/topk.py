"""Exact top-k search by inner product with a ball tree per shard.

All vectors are quantised to integers and dealt evenly to shards; a shard's ball tree is built once.
Queries come in blocks. A block first searches one shard, its home; the k-th scores found there go
with it to all other shards, where a node is opened only for the queries whose upper bound (product
with the ball's centre plus norm times radius) reaches their current k-th score. Nodes are opened in
the order of these bounds, and every leaf raises the k-th scores for the rest of the shard. What
meets in one task is one tree and one block of queries, whatever the size of the data, and every
query meets every shard, so results are exact.

Products are computed in doubles or 64-bit integers where their bound shows that these are exact, else in
Python's integers.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a score among the best that
64 bits cannot hold ends the job with an error; a query meets the vectors of its own length only; a row
is never its own candidate, but another row of the same id is; ties go to the smaller vec_id; fewer
candidates give fewer rows. Null ids take no part.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from namekit.llm.tables import written
from namekit.session import ship_package

SHARD_ROWS = 16_384
BLOCK_QUERIES = 4_096
LEAF_ROWS = 256
SCALE = 256
#: Stands for no score yet; lower than any product of doubles.
NONE = -(1 << 2100)


class BallTree:
    """Vectors in the order of the leaves; node i has children 2i+1 and 2i+2."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.lexsort((rows, ids))
        vectors, ids, rows = vectors[order], ids[order], rows[order]
        n = len(ids)
        self.depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
        n_nodes = 2 ** (self.depth + 1) - 1
        place = np.arange(n)
        self.bounds = np.zeros((n_nodes, 2), np.int64)
        self.bounds[0] = 0, n
        for node in range(2 ** self.depth - 1):
            a, b = self.bounds[node]
            mid = (a + b) // 2
            if b - a > 1:
                part = vectors[place[a:b]].astype(np.float64)
                # split across the line between two far points
                far = part[((part - part[0]) ** 2).sum(1).argmax()]
                other = part[((part - far) ** 2).sum(1).argmax()]
                place[a:b] = place[a:b][np.argsort(part @ (other - far), kind="stable")]
            self.bounds[2 * node + 1] = a, mid
            self.bounds[2 * node + 2] = mid, b
        first_leaf = 2 ** self.depth - 1
        for a, b in self.bounds[first_leaf:]:  # by id inside a leaf, so that ties are met in order
            place[a:b] = np.sort(place[a:b])
        self.vectors, self.ids, self.rows = vectors[place], ids[place], rows[place]
        self.centre = np.zeros((n_nodes, vectors.shape[1]))
        self.radius = np.zeros(n_nodes)
        for node, (a, b) in enumerate(self.bounds):
            if b > a:
                part = self.vectors[a:b].astype(np.float64)
                self.centre[node] = part.mean(0)
                self.radius[node] = math.sqrt(((part - self.centre[node]) ** 2).sum(1).max())

    def upper(self, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Bounds of the products with anything in the nodes, rounding errors included."""
        length = np.sqrt((self.centre[nodes] ** 2).sum(1)) + self.radius[nodes]
        bound = queries @ self.centre[nodes].T + norms[:, None] * self.radius[nodes]
        bound += 1e-9 * norms[:, None] * length + 1e-6
        bound[:, self.bounds[nodes, 1] == self.bounds[nodes, 0]] = -np.inf
        return bound

    def search(self, queries: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray):
        """(scores, ids, found) of each query's best k here, whatever can still reach ``floor``."""
        n = len(queries)
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * queries.shape[1]
        if most >= 2 ** 62:
            return self.search_wide(queries, rows, k)
        kind = np.float64 if most < 2 ** 53 else np.int64
        whole, stock = queries.astype(kind), self.vectors.astype(kind)
        real = queries.astype(np.float64)
        norms = np.sqrt((real ** 2).sum(1))
        best = np.full((n, k), np.iinfo(np.int64).min)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        limit = floor.astype(np.float64)
        # down the tree: (query, leaf) pairs whose bound reaches the floor
        live = np.ones((n, 1), bool)
        for level in range(self.depth + 1):
            first = 2 ** level - 1
            nodes = np.arange(first, 2 * first + 1)
            bound = self.upper(real, norms, nodes)
            live = (np.repeat(live, 2, axis=1) if level else live) & (bound >= limit[:, None])
        bound[~live] = -np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        first_leaf = 2 ** self.depth - 1
        todo = np.arange(n)
        for turn in range(bound.shape[1]):  # every query opens its next best leaf
            leaf = order[todo, turn]
            todo_open = (bound[todo, leaf] >= limit[todo]) & np.isfinite(bound[todo, leaf])
            todo, leaf = todo[todo_open], leaf[todo_open]
            if not len(todo):
                break
            for x in np.unique(leaf):
                q = todo[leaf == x]
                a, b = self.bounds[first_leaf + x]
                score = (whole[q] @ stock[a:b].T).astype(np.int64)
                score[rows[q][:, None] == self.rows[a:b]] = np.iinfo(np.int64).min
                some = np.flatnonzero(score.max(1) >= np.maximum(best[q, -1], limit[q]))
                if not len(some):
                    continue
                q, score = q[some], score[some]
                top = np.argsort(-score.clip(-(2 ** 62)), axis=1, kind="stable")[:, :k]
                both = np.concatenate([best[q], np.take_along_axis(score, top, 1)], axis=1)
                both_id = np.concatenate([best_id[q], self.ids[a:b][top]], axis=1)
                both_id[both == np.iinfo(np.int64).min] = np.iinfo(np.int64).max
                rank = np.lexsort((both_id, -both.clip(-(2 ** 62))), axis=1)[:, :k]
                best[q] = np.take_along_axis(both, rank, 1)
                best_id[q] = np.take_along_axis(both_id, rank, 1)
                full = best[q, -1] > np.iinfo(np.int64).min
                limit[q[full]] = np.maximum(limit[q[full]], best[q[full], -1])
        return best, best_id, best > np.iinfo(np.int64).min


    def search_wide(self, queries: np.ndarray, rows: np.ndarray, k: int):
        """As ``search``, for products beyond 64 bits: every vector is met, in Python's integers."""
        stock = np.vectorize(int, otypes=[object])(self.vectors) if self.vectors.size else self.vectors.astype(object)
        best = np.full((len(queries), k), NONE, object)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        for i, query in enumerate(queries):
            score = stock @ np.array([int(x) for x in query], object) if stock.shape[1] else np.zeros(len(stock), object)
            top = sorted((-s, d) for s, d, r in zip(score, self.ids.tolist(), self.rows.tolist(), strict=True) if r != rows[i])[:k]
            for j, (s, d) in enumerate(top):
                best[i, j], best_id[i, j] = -s, d
        return best, best_id, best > NONE


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double, components times SCALE) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
            .where(F.coalesce(finite, F.lit(False)))
            .select("vec_id", F.transform("x", lambda c: F.lit(float(SCALE)) * c).alias("v")))


def _stack(column: pd.Series) -> np.ndarray:
    """floor of the scaled components: whole numbers, exact in doubles."""
    return np.floor(np.stack(column.to_list()).astype(np.float64))


def _build(part: pd.DataFrame) -> pd.DataFrame:
    v = _stack(part.v) if int(part["size"].iloc[0]) else np.zeros((len(part), 0))
    v = v.astype(np.int32) if np.abs(v).max(initial=0) < 2 ** 31 else v
    tree = BallTree(v, part.vec_id.to_numpy(), part.row.to_numpy())
    return pd.DataFrame({"size": [int(part["size"].iloc[0])], "shard": [int(part.shard.iloc[0])], "tree": [pickle.dumps(tree)]})


def top_k(vectors: DataFrame, query_every: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors for every row whose id is divisible by
    ``query_every``."""
    # numbers of rows are written before use, so they stay what they are when a task runs again
    ship_package(vectors.sparkSession)
    rows = written(quantised(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
    # the sizes of vectors are bounded by the longest; shards and blocks follow the rows of each
    sizes = sizes.select("size", F.ceil(F.col("n") / F.lit(shard_rows)).cast("int").alias("shards"),
                         F.ceil(F.col("q") / F.lit(block_queries)).cast("int").alias("blocks"))
    rows = rows.withColumn("size", F.size("v")).join(F.broadcast(sizes), "size")
    spread = F.xxhash64("row")
    trees = written(rows.withColumn("shard", F.pmod(spread, "shards").cast("int"))
                    .groupBy("size", "shard").applyInPandas(_build, "size int, shard int, tree binary"))
    queries = (rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), "blocks").cast("int"))
               .select("size", "block", F.pmod(F.col("block"), "shards").alias("home"), "shards", "blocks", "vec_id", "row", "v"))
    tree_blocks = trees.join(F.broadcast(sizes), "size").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(queries_: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries_) or not len(tree):
            return empty
        ball: BallTree = pickle.loads(tree.tree.iloc[0])
        v = _stack(queries_.v) if len(queries_.v.iloc[0]) else np.zeros((len(queries_), 0))
        floor = queries_.floor.to_numpy()
        score, vec_id, found = ball.search(v, queries_.row.to_numpy(), k, floor)
        keep = found & (score >= floor[:, None])
        q, _ = np.nonzero(keep)
        if score.dtype == object:
            if any(not -(1 << 63) <= s < 1 << 63 for s in score[keep]):
                raise OverflowError("a score among the best does not fit in 64 bits")
            score = np.where(keep, score, 0).astype(np.int64)
        return pd.DataFrame({"row": queries_.row.to_numpy()[q], "query_id": queries_.vec_id.to_numpy()[q],
                             "vec_id": vec_id[keep], "score": score[keep]})

    schema = "row long, query_id long, vec_id long, score long"
    none = -(1 << 62)

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return (left.groupBy("size", "shard", "block").cogroup(right.groupBy("size", "shard", "block"))
                .applyInPandas(search, schema))

    wanted = ["size", "shard", "block", "vec_id", "row", "v", "floor"]
    held = ["size", "shard", "block", "tree"]
    home = (tree_blocks.where((F.col("blocks") > 0) & (F.col("shard") == F.pmod(F.col("block"), "shards"))).select(held))
    at_home = written(meet(queries.withColumn("shard", F.col("home")).withColumn("floor", F.lit(none)).select(wanted), home))
    # the k-th score at home, where there were k
    floors = (at_home.groupBy("row").agg(F.min("score").alias("least"), F.count("*").alias("n"))
              .select(F.col("row").alias("at"), F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(none)).alias("floor")))
    away = (queries.join(floors, queries.row == floors["at"], "left").withColumn("floor", F.coalesce("floor", F.lit(none)))
            .withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != F.col("home"))))
            .select(wanted))
    elsewhere = meet(away, tree_blocks.where((F.col("blocks") > 0) & (F.col("shard") != F.pmod(F.col("block"), "shards"))).select(held))
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return (at_home.unionByName(elsewhere).withColumn("rank", nth).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
