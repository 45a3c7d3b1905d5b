"""Approximate nearest neighbours by a hash-prefix forest.

The vectors are dealt into blocks.  In a block, each tree is a sorted array of long hash strings: signs of random
projections.  A query goes down all trees to its longest-prefix matches, then all trees ascend together, a bit at
a time.  It stops when a vector nearer than the worst of its best would hardly have escaped all trees at that prefix
length, so vectors with near neighbours take few candidates.  Queries meet every block, so the results of blocks
merge into the whole table's, and memory is bounded by a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulspark.llm.common import by_length, checkpoint, each_with_each, finite_vectors, map_batches, packed, prepare, unpack

RESULT = "query_id bigint, rank int, vec_id bigint, score double"
#: Vectors in a block, and queries in one.
BLOCK, QUERIES = 8192, 1024
BITS = 32


class Forest:
    """Sorted arrays of hash strings, one per tree."""

    def __init__(self, mat: np.ndarray, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((mat.shape[1], BITS)) for _ in range(trees)]
        self.order, self.keys = [], []
        for p in self.planes:
            k = self.hashes(mat, p)
            o = np.argsort(k, kind="stable")
            self.order.append(o.astype(np.int32))
            self.keys.append(k[o])

    @staticmethod
    def hashes(mat: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """The signs of the projections as one number, the first at the top."""
        return ((mat @ planes) > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))

    def candidates(self, mat: np.ndarray, queries: np.ndarray, own: list[np.ndarray], k: int, miss: float):
        """For each query the places of its candidates, those of ``own`` left out, and their nearness.

        All trees ascend together until ``k`` candidates are found and a vector as near as the ``k``-th of them has
        been missed with a probability of at most ``miss``: (1 - (1 - angle / pi) ** bits) ** trees.
        """
        asked = [self.hashes(queries, p) for p in self.planes]
        found = [np.zeros(0, np.int64)] * len(queries)
        near = [np.zeros(0)] * len(queries)
        seen = np.zeros(len(mat), bool)
        due = np.full(len(queries), BITS)  # the prefix length that a query is looked up with next; -1 when it is done
        while (bits := int(due.max(initial=-1))) >= 0:
            rows = np.flatnonzero(due == bits)
            free = (np.int64(1) << (BITS - bits)) - 1
            lo, hi = (np.empty((len(self.keys), len(rows)), np.int64) for _ in range(2))
            for t, keys in enumerate(self.keys):
                low = asked[t][rows] & ~free
                lo[t] = np.searchsorted(keys, low, "left")
                hi[t] = np.searchsorted(keys, low | free, "right")
            total = (hi - lo).sum(0)
            for j, q in enumerate(rows.tolist()):
                wide = 0  # the prefix length that is short enough for what has been found
                if total[j] > k or not bits:
                    seen[:] = False
                    for o, x, y in zip(self.order, lo[:, j].tolist(), hi[:, j].tolist(), strict=True):
                        if y > x:
                            seen[o[x:y]] = True
                    seen[own[q]] = False
                    seen[found[q]] = False
                    fresh = np.flatnonzero(seen)
                    found[q], near[q] = np.concatenate([found[q], fresh]), np.concatenate([near[q], mat[fresh] @ queries[q]])
                    if len(found[q]) >= k:
                        wide = self.enough(near[q], k, miss)
                # halfway there, since the k-th best is nearer by then
                due[q] = -1 if not bits or wide >= bits else max(0, bits - 3) if not wide else (bits + wide) // 2
        return zip(found, near, strict=True)

    def enough(self, near: np.ndarray, k: int, miss: float) -> int:
        """The longest prefix at which a vector as near as the k-th best is missed by all trees with ``miss`` at most."""
        same = 1 - np.arccos(np.clip(np.partition(near, -k)[-k], -1, 1)) / np.pi
        at_least = 1 - miss ** (1 / len(self.keys))  # the chance that one tree must have
        return BITS if same >= 1 else max(0, int(np.log(at_least) / np.log(max(same, 1e-12))))


def unit(mat: np.ndarray) -> np.ndarray:
    """Rows scaled so that no square overflows or vanishes, for hashing and for choosing."""
    mat = mat / np.abs(mat).max(1, keepdims=True)
    return mat / np.sqrt((mat * mat).sum(1, keepdims=True))


def cosine(mat: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows give equal results.  Scaled by powers of two, which is exact."""
    shrink = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])
    mat, q = shrink(mat), shrink(q)
    return (mat * q).sum(1) / (np.sqrt((mat * mat).sum(1)) * np.sqrt((q * q).sum()))


def nearest(df: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = 128, miss: float = 0.05, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by cosine found for each vector whose id is divisible by
    ``query_every``, among all vectors but those of the query's own id; ties to the smaller id.

    Every vector is indexed, none is sampled.  In each block a query takes candidates until it has ``k`` and a
    nearer one was missed with a probability of at most ``miss``, so every query gets ``k`` rows where there are as
    many candidates.  Vectors that are null, zero, or hold null or non-finite components take no part, nor do null
    ids; vectors of another length than the query's are none of its candidates.  No rows give no rows.
    """
    prepare(df.sparkSession)
    return by_length(checkpoint(finite_vectors(df, id_col, vec_col, nonzero=True)), lambda v: _nearest(v, k, query_every, trees, miss, seed), RESULT)


def _nearest(v: DataFrame, k: int, query_every: int, trees: int, miss: float, seed: int) -> DataFrame:
    asked = v.where(F.col("id") % query_every == 0)
    parts, q_parts = (max(1, -(-x.count() // size)) for x, size in ((v, BLOCK), (asked, QUERIES)))
    pairs = each_with_each(packed(v.repartition(parts)), packed(asked.repartition(q_parts)), parts)

    def make():
        held: dict = {}

        def step(b: pa.RecordBatch):
            for part, ids, mat, q_ids, q_mat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, mat = unpack(ids, mat)
                q_ids, q_mat = unpack(q_ids, q_mat)
                if held.get("part") != part:
                    scaled, order = unit(mat), np.argsort(ids, kind="stable")
                    held.update(part=part, scaled=scaled, forest=Forest(scaled, trees, seed), order=order, sorted=ids[order])
                scaled, asked = held["scaled"], unit(q_mat)
                lo, hi = (np.searchsorted(held["sorted"], q_ids, side) for side in ("left", "right"))
                own = [held["order"][x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                out = {"query_id": [], "vec_id": [], "score": []}
                for i, (found, rough) in enumerate(held["forest"].candidates(scaled, asked, own, k, miss)):
                    if not len(found):
                        continue
                    if len(found) > k:
                        found = found[rough >= np.partition(rough, -k)[-k] - 1e-9]  # all ties stay
                    s = cosine(mat[found], q_mat[i])
                    top = np.lexsort((ids[found], -s))[:k]
                    out["query_id"] += [int(q_ids[i])] * len(top)
                    out["vec_id"] += ids[found[top]].tolist()
                    out["score"] += s[top].tolist()
                yield out

        return step

    found = map_batches(pairs.select("part", "ids", "mat", "q_ids", "q_mat"), make, "query_id bigint, vec_id bigint, score double")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, from what the blocks found."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
