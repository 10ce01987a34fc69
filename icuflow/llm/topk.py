"""Exact top-k inner-product search: ball-tree branch and bound in shards.

Vectors are dealt to shards of about SHARD_ROWS rows by a hash of the row, queries to blocks of about QUERY_BLOCK
rows. Every (query block, shard) pair is a group of bounded size, searched in one task: a ball tree over the shard
bounds the inner product of a query with any vector of a node by q.c + |q| r; each query visits children in the order
of that bound and leaves out nodes whose bound is below its current k-th score. The shards are searched in two
rounds: the first, of one shard in ROUND, gives each query a k-th score that all the other shards start with.

Components x become floor(256 x), so scores are integers; sums are exact in double precision while they stay under
2^53, else Python's integers take over. Scores must fit in 64 bits.

Rows with a null id, a null vector, or a null or non-finite component take no part. A query's candidates are the rows
with another id and a vector of the same length; each row is a candidate of its own, so a repeated id may fill
several ranks. Repeated query rows are one query. Equal scores rank the smaller id first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icuflow.llm.common import settle

SHARD_ROWS = 4096
QUERY_BLOCK = 2048
ROUND = 8
LEAF_ROWS = 64


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part, with integer components."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).select("vec_id", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


class BallTree:
    """Rows in leaf order with the nodes' centers, radii and row ranges; children of node i are in kids[i]."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.order, self.center, self.radius, self.range, self.kids = np.arange(len(points)), [], [], [], []
        self._grow(points, 0, len(points), leaf)
        self.center, self.radius = np.array(self.center), np.array(self.radius)

    def _grow(self, points: np.ndarray, start: int, end: int, leaf: int) -> int:
        own = points[self.order[start:end]]
        center = own.mean(axis=0)
        away = np.sqrt(((own - center) ** 2).sum(axis=1))
        node = len(self.center)
        self.center.append(center)
        self.radius.append(away.max() * (1 + 1e-9) + 1e-9)
        self.range.append((start, end))
        self.kids.append(None)
        if end - start > leaf and away.max() > 0:
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            side = own @ (other - far)
            self.order[start:end] = self.order[start:end][np.argsort(side, kind="stable")]
            middle = (start + end) // 2
            self.kids[node] = (self._grow(points, start, middle, leaf), self._grow(points, middle, end, leaf))
        return node


class Search:
    """The k best rows of one shard for each of several queries, as far as they can be among the best of all."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
        self.tree = BallTree(points)
        self.ids, self.points = ids[self.tree.order], points[self.tree.order]
        self.query_ids, self.queries, self.floors, self.k = query_ids, queries, floors, k
        self.norms = np.sqrt((queries**2).sum(axis=1)) * (1 + 1e-9)
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visit(0, np.arange(len(queries)), self.bound(0, np.arange(len(queries))))

    def bound(self, node: int, of: np.ndarray) -> np.ndarray:
        most = self.queries[of] @ self.tree.center[node] + self.norms[of] * self.tree.radius[node]
        return most + np.abs(most) * 1e-9

    def visit(self, node: int, of: np.ndarray, bounds: np.ndarray) -> None:
        of = of[bounds >= np.maximum(self.floors[of], self.scores[of, -1])]
        if not of.size:
            return
        if not (kids := self.tree.kids[node]):
            self.leaf(*self.tree.range[node], of)
            return
        left, right = (self.bound(kid, of) for kid in kids)
        for first, (a, b) in ((left >= right, ((kids[0], left), (kids[1], right))), (left < right, ((kids[1], right), (kids[0], left)))):
            if first.any():
                self.visit(a[0], of[first], a[1][first])
                self.visit(b[0], of[first], b[1][first])

    def leaf(self, start: int, end: int, of: np.ndarray) -> None:
        ids = self.ids[start:end]
        scores = self.queries[of] @ self.points[start:end].T
        scores[self.query_ids[of][:, None] == ids[None, :]] = -np.inf
        better = (scores >= np.maximum(self.floors[of], self.scores[of, -1])[:, None]).any(axis=1)
        of, scores = of[better], scores[better]
        scores = np.hstack([self.scores[of], scores])
        ids = np.hstack([self.found[of], np.broadcast_to(ids, (len(of), len(ids)))])
        best = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[of], self.found[of] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def exact_scores(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same with Python's integers, for components so large that doubles would round: row of the query, id, score."""
    out = []
    for row, (own, q) in enumerate(zip(query_ids.tolist(), queries.tolist(), strict=True)):
        scored = [(-sum(a * b for a, b in zip(q, p, strict=True)), i) for i, p in zip(ids.tolist(), points.tolist(), strict=True) if i != own]
        out += [(row, i, -s) for s, i in sorted(scored)[:k]]
    return out


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def searched(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Candidates of each query (query_id, query, vec_id, score) from the given shards. A query starts with its floor."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, query_ids, keys = (t.column(c).to_numpy() for t, c in ((left, "vec_id"), (right, "query_id"), (right, "query")))
            points, asked = _matrix(left.column("v"), left.num_rows), _matrix(right.column("asked"), right.num_rows)
            floors = right.column("floor").cast(pa.float64()).fill_null(float("-inf")).to_numpy()
            size = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
            if points.shape[1] * size(points) * size(asked) < 2**53:
                s = Search(ids, points.astype(np.float64), query_ids, asked.astype(np.float64), floors, k)
                rows, ranks = np.nonzero(s.scores > -np.inf)
                out = [*zip(rows.tolist(), s.found[rows, ranks].tolist(), s.scores[rows, ranks].astype(np.int64).tolist(), strict=True)]
            else:
                out = exact_scores(ids, points, query_ids, asked, k)
            out = [(int(query_ids[r]), int(keys[r]), i, s) for r, i, s in out]
        return pa.table({c: pa.array([x[n] for x in out], pa.int64()) for n, c in enumerate(("query_id", "query", "vec_id", "score"))})

    keys = ["block", "shard", "size"]
    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query_id long, query long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int, k: int, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) whose id is divisible by every, the k best others."""
    rows = quantized(vectors)
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, m = rows.agg(F.count("*"), F.count_if(asked)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_block))
    row_hash = F.xxhash64("vec_id", "v")
    dealt = rows.select("vec_id", "v", F.size("v").alias("size"), F.pmod(row_hash, F.lit(shards)).cast("int").alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = rows.where(asked).select(F.col("vec_id").alias("query_id"), row_hash.alias("query"), F.col("v").alias("asked"), F.size("v").alias("size")).dropDuplicates(["query_id", "query"])
    queries = queries.withColumn("block", F.pmod("query", F.lit(blocks)).cast("int"))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    first = max(1, shards // ROUND)

    def round_of(low: int, high: int, queries: DataFrame) -> DataFrame:
        own = queries.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        return searched(dealt.where(F.col("shard").between(low, high - 1)), own, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = round_of(0, first, queries.withColumn("floor", F.lit(None).cast("long")))
    if first < shards:
        found = settle(found, "topk")
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("i"), F.col("query").alias("q"), F.col("score").alias("floor"))
        rest = round_of(first, shards, queries.join(floors, (F.col("query_id") == F.col("i")) & (F.col("query") == F.col("q")), "left").drop("i", "q"))
        found = found.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
