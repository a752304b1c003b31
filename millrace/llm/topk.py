"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

A block of candidates keeps, for each dimension, its rows sorted by that component. A query
reads all lists from their favourable ends in rounds, scores each row met for the first time,
and stops when the sum of its weighted components at the present depth, which bounds every row
not yet met, is below its kth score (at equality an unmet row could still win by its id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .vectors import matrix, sound

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Candidates and queries that a task holds.
BLOCK, QUERIES = 4096, 2048
FIRST_DEPTH = 16


class SortedLists:
    """Candidates with a list per dimension, sorted by component ascending."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(x, self.order.T, 0).T.copy()
        largest = int(np.abs(x).max(initial=0))
        self.exact_float = lambda q: largest * int(np.abs(q).max(initial=0)) * max(1, x.shape[1]) < 2**53
        self.float = x.astype(np.float64)

    def top(self, query_id: int | None, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, depth reached) of the k best rows other than the query's own, ties to smaller ids."""
        n = len(self.ids)
        used = np.flatnonzero(q)
        met, scored = np.zeros(n, bool), np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fast = self.exact_float(q)
        depth, done = min(FIRST_DEPTH, n), 0
        rising, falling = used[q[used] < 0], used[q[used] > 0]
        while True:
            met[self.order[rising, done:depth]] = True
            met[self.order[falling, n - depth : n - done]] = True
            if not len(used):
                met[:] = True  # every row scores 0
            new = np.flatnonzero(met & ~scored)
            scored[new] = True
            score = np.rint(self.float[new] @ q.astype(np.float64)).astype(np.int64) if fast else (self.x[new] * q).sum(1)
            if query_id is not None:
                other = self.ids[new] != query_id
                new, score = new[other], score[other]
            ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, score])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if depth >= n or not len(used):
                return ids, scores, depth
            bound = int((self.sorted[rising, depth - 1] * q[rising]).sum() + (self.sorted[falling, n - depth] * q[falling]).sum())
            if len(ids) == k and bound < scores[-1]:
                return ids, scores, depth
            done, depth = depth, min(n, depth * 2)


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query row.

    Queries are the rows with vec_id divisible by ``every``; all sound vectors are candidates.
    Components become floor(scale * x), scores are integer inner products, ties go to the
    smaller vec_id. Null and empty vectors, those with null or non-finite components and rows
    with a null vec_id take no part; vectors of different dimensions don't meet; a repeated row
    is a candidate of its own, one query with its other occurrences, and never its own result.
    An empty table gives no rows; other columns are not looked at. Scores are exact: a component
    so large that an inner product might not fit 64 bits, beyond sqrt(2^63 / dimensions) once
    scaled, is an error.

    Of equal vectors only rows of the k + 1 smallest ids can be in a result, k of each id at
    most, so a group of copies never reaches a task as a whole. Each pair of a candidate block
    and a query block is a task.
    """
    wide = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    most = F.sqrt(F.lit(float(2**63)) / F.size("embedding"))
    too_large = F.exists(F.transform("embedding", lambda v: v.cast("double") * scale), lambda v: F.abs(v) + 1 >= most)
    ints = F.when(too_large, F.raise_error(F.lit("a component is too large for scores of 64 bits"))).otherwise(F.transform(wide, lambda v: v.cast("long")))
    rows = vectors.where(sound(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("x"))
    copies = Window.partitionBy("x").orderBy("vec_id")
    same = Window.partitionBy("x", "vec_id").orderBy("vec_id")
    of_id = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k)
    candidates = settle(of_id.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1).drop("copy"))
    asked = settle(rows.where(F.col("vec_id") % every == 0).distinct())
    sizes = candidates.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()  # one row per dimension
    n_asked = asked.count()
    parts = []
    for r in sizes:
        blocks, groups = -(-r["n"] // block), max(1, -(-n_asked // queries))
        hashed = F.xxhash64("vec_id", "x")
        c = candidates.where(F.size("x") == r["dim"]).select(F.pmod(hashed, F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(0).alias("asks"), "vec_id", "x")
        q = asked.where(F.size("x") == r["dim"]).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(hashed, F.lit(groups)).cast("int").alias("g"), F.lit(1).alias("asks"), "vec_id", "x")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Runs of one block pair, candidates and queries together; a run holds one block of each."""

            def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                whole = pa.Table.from_batches(held).combine_chunks()
                x, ids = matrix(whole.column("x").combine_chunks(), np.int64), whole.column("vec_id").to_numpy()
                asks = whole.column("asks").to_numpy() == 1
                lists = SortedLists(ids[~asks], x[~asks])
                found = [(int(i), *lists.top(int(i), v, k)[:2]) for i, v in zip(ids[asks], x[asks])] if len(lists.ids) else []
                return pa.record_batch(
                    [
                        pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                        pa.array(np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])),
                        pa.array(np.concatenate([f[2] for f in found] or [np.zeros(0, np.int64)])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                b, g = batch.column("b").to_numpy(), batch.column("g").to_numpy()
                cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(g) != 0)) + 1
                for s, t in zip([0, *cuts], [*cuts, len(b)]):
                    part = batch.slice(s, t - s)
                    if held and (held[0].column("b")[0] != part.column("b")[0] or held[0].column("g")[0] != part.column("g")[0]):
                        yield one(held)
                        held = []
                    held.append(part)
            if held:
                yield one(held)

        dealt = c.unionByName(q).repartition("b", "g").sortWithinPartitions("b", "g")
        parts.append(dealt.mapInArrow(search, "query_id long, vec_id long, score long"))
    found = parts[0] if parts else vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    for more in parts[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda y: floor(256 * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
