"""Exact top-k inner products by MaxScore.

Vectors are cut into shards of bounded size. A vector is sent to its shard once;
the queries follow it there, batch by batch, so a shard's task holds no more
than the shard. A shard keeps, for every dimension and
sign, the postings of the vectors on that side. A query's terms are the lists
that add to its score. Sorted by score bound, the small ones whose bounds
together stay under the k-th best score are non-essential: a vector in these
alone cannot qualify. Essential postings are traversed, the others are probed
for a candidate only while its bound still competes. Shards' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, rows of a shard gone through at once.
SHARD, STEP = 8192, 1024
SCALE = 1024


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: floor(1024 * component) as longs; rows that are null or hold null or non-finite components go."""
    v = vectors.select(vectors[id_col].alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce((c > F.lit(float("-inf"))) & (c < F.lit(float("inf"))), F.lit(False)))
    return v.filter(F.col("v").isNotNull() & finite).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of longs; shorter vectors count as ending in zeros."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    wide = int(size.max(initial=0))
    if (size == wide).all():
        return flat.reshape(len(size), wide)
    out = np.zeros((len(size), wide), np.int64)
    out[np.arange(wide) < size[:, None]] = flat
    return out


class Shard:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.most = np.stack([np.maximum(-x.min(0, initial=0), 0), np.maximum(x.max(0, initial=0), 0)])
        # postings[step][sign][dimension]: rows of that stretch of the shard on that side
        self.starts = range(0, len(ids), STEP)
        self.postings = [
            [[np.flatnonzero(part[:, d] * sign > 0) for d in range(x.shape[1])] for sign in (-1, 1)] for part in (self.x[s : s + STEP] for s in self.starts)
        ]

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best, ties to the smaller id; ``own`` takes no part."""
        dims = np.flatnonzero(q[: self.x.shape[1]])
        side = (q[dims] > 0).astype(int)
        bound = np.abs(q[dims]) * self.most[side, dims]
        order = np.argsort(bound, kind="stable")
        dims, side, below = dims[order], side[order], np.cumsum(bound[order])
        weights = q[dims]
        best, best_ids, least = np.empty(0, np.int64), np.empty(0, np.int64), None
        for step, start in enumerate(self.starts):
            part = self.x[start : start + STEP]
            if least is None or least <= 0:
                rows, split = np.arange(len(part)), 0
                score = part[:, dims] @ weights
            else:
                split = int(np.searchsorted(below, least))  # lists before it are non-essential
                rest = below[split - 1] if split else 0
                gained = np.zeros(len(part), np.int64)
                seen = np.zeros(len(part), bool)
                for d, s, w in zip(dims[split:], side[split:], weights[split:], strict=True):
                    rows = self.postings[step][s][d]
                    gained[rows] += w * part[rows, d]
                    seen[rows] = True
                rows = np.flatnonzero(seen & (gained + rest >= least))
                score = part[np.ix_(rows, dims[split:])] @ weights[split:]  # with what these take away
                for at in range(split - 1, -1, -1):
                    left = score + below[at] >= least
                    rows, score = rows[left], score[left]
                    if not len(rows):
                        break
                    score = score + weights[at] * part[rows, dims[at]]
            ids = self.ids[start + rows]
            other = ids != own
            best, best_ids = np.concatenate([best, score[other]]), np.concatenate([best_ids, ids[other]])
            top = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[top], best_ids[top]
            least = best[-1] if len(best) == k else None
        return best, best_ids


def _search_shards(k: int):
    """Of rows by shard, the vectors first, each shard's best for its queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            place, asks = batch["shard"].to_numpy(), batch["asks"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(asks) != 0)])) if len(batch) else []
            for start, end in zip(begins, [*begins[1:], len(batch)], strict=True):
                rows = batch.slice(start, end - start)
                if place[start] != now:
                    now, held, shard = place[start], [], None
                if not asks[start]:
                    held.append(rows)
                    continue
                if shard is None and held:
                    vectors = pa.Table.from_batches(held)
                    shard, held = Shard(vectors["vec_id"].to_numpy(), _matrix(vectors["x"])), []
                if shard is not None:
                    own = rows["vec_id"].to_numpy()
                    found = [shard.search(i, q, k) for i, q in zip(own, _matrix(pa.chunked_array([rows["x"]])), strict=True)]
                    query_id = np.repeat(own, [len(ids) for _, ids in found])
                    score, vec_id = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(vec_id), pa.array(score)], ["query_id", "vec_id", "score"])

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, shard_rows: int = SHARD) -> DataFrame:
    """The ``k`` best of ``candidates`` for each of ``queries``, both as ``quantise`` returns them.

    Returns ``query_id, rank, vec_id, score``; fewer rows where there are fewer
    candidates. A candidate with the query's id takes no part. Equal scores go
    by id; candidates that repeat an id are ranked one by one. Vectors of other
    lengths count as ending in zeros, empty ones score 0. Empty sides give no
    rows. Queries that repeat an id share one ranking.
    """
    shards = max(1, -(-candidates.count() // shard_rows))
    # Row numbers, not hashes of ids, so that a common id does not fill a shard.
    dealt = candidates.select((F.monotonically_increasing_id() % shards).alias("shard"), F.lit(0).alias("asks"), "vec_id", "x")
    asked = queries.dropDuplicates(["vec_id"]).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "x")
    # A partition for each shard, as far as there are that many.
    parts = min(shards, 8 * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.unionByName(asked).repartition(parts, "shard").sortWithinPartitions("shard", "asks")
    found = met.mapInArrow(_search_shards(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
