"""Exact top-k inner products over norm-sorted blocks.

Vectors stand in blocks by descending length.  Each query gets a threshold from the longest vectors; a block is
then read in the order of length, and a query leaves it as soon as its own length times the next vector's is
below the threshold, and a block whose longest vector is too short for all queries of a block isn't read.  What remains is pruned by partial sums: vectors are rotated by the singular vectors of a
sample, so that the first few components carry most of a product, and the rest is bounded by Cauchy-Schwarz.
Survivors are scored exactly, on integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.ann import ranked
from haulspark.llm.common import by_length, checkpoint, finite_vectors, map_batches, packed, prepare, unpack

RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"
BLOCK, QUERIES, CHUNK = 8192, 1024, 1024
#: Vectors that the rotation is computed from, at most; it changes speed, never results.
ROTATION_ROWS = 4096
#: Scores below the least 64-bit integer count as this; one that would be returned raises.
LEAST = -(2**63)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of whole numbers held as doubles: in doubles or 64-bit integers where these are exact, else
    in Python's integers.  Raises OverflowError for a product above 64 bits; one below them becomes LEAST."""
    size = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if size < 2**53:
        return (q @ x.T).astype(np.int64)
    if size < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape)
    s = whole(q).dot(whole(x).T)
    if s.size and s.max() >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return np.maximum(s, LEAST).astype(np.int64)


def rotation(sample: np.ndarray, dim: int) -> np.ndarray:
    return np.linalg.svd(sample.T @ sample)[0] if len(sample) else np.eye(dim)


def lengths(m: np.ndarray) -> np.ndarray:
    """Euclidean lengths; infinite where squares overflow, which prunes nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt((m * m).sum(1)), nan=np.inf, posinf=np.inf)


def slack(q_len: np.ndarray, x_len: float) -> np.ndarray:
    """What rounding may take from a bound on products of vectors of these lengths."""
    return 1 + 1e-9 * q_len * x_len


def block_top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, theta: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, ids and scores of what may be among the best ``k``: for each query, of the block's rows with a
    score of at least ``theta``, the best ``k``.  ``x`` stands by descending length."""
    head = max(1, q.shape[1] // 4)
    with np.errstate(over="ignore", invalid="ignore"):
        qr, xr = q @ turn, x @ turn
    q_len, x_len, q_rest, x_rest = lengths(q), lengths(x), lengths(qr[:, head:]), lengths(xr[:, head:])
    wild = not (np.isfinite(q_len).all() and np.isfinite(x_len).all())  # then bounds say nothing
    theta = theta.astype(float).copy()
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    live = np.arange(len(q_ids))
    for at in range(0, len(ids), CHUNK):
        s = slice(at, at + CHUNK)
        if wild:
            ok = np.ones((len(live), len(ids[s])), bool)
        else:
            live = live[q_len[live] * x_len[at] + slack(q_len[live], x_len[at]) >= theta[live]]
            if not len(live):
                break
            bound = qr[live, :head] @ xr[s, :head].T + np.outer(q_rest[live], x_rest[s])
            ok = bound >= (theta[live] - slack(q_len[live], x_len[at]))[:, None]
        some = ok.any(1)
        rows = live[some]
        if not len(rows):
            continue
        ok, columns = ok[some], np.flatnonzero(ok[some].any(0))
        score = exact(q[rows], x[s][columns])
        for i, r in enumerate(rows):
            least = np.nextafter(np.nextafter(theta[r], -np.inf), -np.inf)  # large scores are rounded as doubles
            good = columns[ok[i, columns] & (score[i] >= least) & (ids[s][columns] != q_ids[r])]
            if len(good):
                got = score[i][np.searchsorted(columns, good)]
                i2, s2 = np.concatenate([best[r][0], ids[s][good]]), np.concatenate([best[r][1], got])
                top = np.lexsort((i2, ~s2))[:k]
                best[r] = (i2[top], s2[top])
                if len(top) == k:
                    theta[r] = max(theta[r], s2[top[-1]])
    n = np.array([len(b[0]) for b in best], int)
    return np.repeat(np.arange(len(q_ids)), n), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])


def top_products(df: DataFrame, k: int = 20, query_every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of floor(scale * vector) for each vector whose
    id is divisible by ``query_every``, with all vectors but those of the query's own id; ties to the smaller id.

    Exact.  Vectors that are null or hold null or non-finite components take no part, nor do null ids; vectors of
    another length than the query's are none of its candidates.  Zero vectors take part.  Components of any size do:
    a score that does not fit 64 bits raises.  No rows give no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    v = finite_vectors(df, id_col, vec_col, nonzero=False)
    scaled = lambda x: F.when(F.abs(x * F.lit(float(scale))) < 2.0**52, F.floor(x * F.lit(float(scale))).cast("double")).otherwise(x * F.lit(float(scale)))  # noqa: E731  larger doubles are whole
    v = v.select("id", F.transform("vec", scaled).alias("vec")).withColumn("length", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    return by_length(checkpoint(v), lambda same: _top(same, k, query_every), RESULT)


def _top(v: DataFrame, k: int, query_every: int) -> DataFrame:
    spark = v.sparkSession
    asked = v.where(F.col("id") % query_every == 0).select("id", "vec")
    parts, q_parts = (max(1, -(-x.count() // size)) for x, size in ((v, BLOCK), (asked, QUERIES)))
    sample = [r["vec"] for r in v.where(F.col("length") < 1e150).orderBy(F.xxhash64("id")).limit(ROTATION_ROWS).select("vec").collect()]
    dim = v.select(F.size("vec").alias("d")).first()["d"]
    turn = spark.sparkContext.broadcast(rotation(np.array(sample, float), dim))
    base = packed(v.repartitionByRange(parts, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id").select("id", "vec", "length"), "length")
    base = checkpoint(base)
    queries = checkpoint(packed(asked.repartition(q_parts)))
    # the greatest length of each block, a number a block, in the order of blocks
    tops = sorted(map(tuple, map_batches(base.select("part", "more"), _greatest, "part int, top double").collect()))
    first = tops[0][0] if tops else 0
    block_no, block_top_len = np.array([t[0] for t in tops], np.int64), np.array([t[1] for t in tops])

    def seed():
        def step(b: pa.RecordBatch):
            for q_part, ids, mat, q_ids, q_mat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, mat = unpack(ids, mat)
                q_ids, q_mat = unpack(q_ids, q_mat)
                n, _, s = block_top(q_ids, q_mat, ids, mat, k, np.full(len(q_ids), -np.inf), turn.value)
                have = np.bincount(n, minlength=len(q_ids))
                low = np.full(len(q_ids), np.inf)
                np.minimum.at(low, n, s)
                theta, q_len = np.where(have >= k, low, -np.inf), lengths(q_mat)
                # blocks whose longest vector is too short for all of these queries aren't read
                may = [not np.isfinite(t) or bool((~np.isfinite(q_len) | (q_len * t + slack(q_len, t) >= theta)).any()) for t in block_top_len.tolist()]
                yield {"q_part": [q_part], "theta": [theta.tobytes()], "parts": [block_no[may].tolist()]}

        return step

    def search():
        def step(b: pa.RecordBatch):
            for theta, ids, mat, q_ids, q_mat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, mat = unpack(ids, mat)
                q_ids, q_mat = unpack(q_ids, q_mat)
                n, i, s = block_top(q_ids, q_mat, ids, mat, k, np.frombuffer(theta, "<f8"), turn.value)
                yield {"query_id": q_ids[n].tolist(), "vec_id": i.tolist(), "score": s.tolist()}

        return step

    q = queries.select(F.col("part").alias("q_part"), F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"))
    start = q.withColumn("part", F.explode(F.sequence(F.lit(first), F.lit(first)))).join(base.where(F.col("part") == first), "part")
    thetas = map_batches(start.select("q_part", "ids", "mat", "q_ids", "q_mat"), seed, "q_part int, theta binary, parts array<int>")
    q = checkpoint(q.join(thetas, "q_part"))
    pairs = base.join(q.withColumn("part", F.explode("parts")), "part")
    found = map_batches(pairs.select("theta", "ids", "mat", "q_ids", "q_mat"), search, "query_id bigint, vec_id bigint, score bigint")
    out = ranked(found, k)
    return out.withColumn("score", F.when(F.col("score") == LEAST, F.raise_error(F.lit("an inner product does not fit 64 bits"))).otherwise(F.col("score")))


def _greatest():
    def step(b: pa.RecordBatch):
        yield {"part": b.column(0).to_pylist(), "top": [float(np.sqrt(np.frombuffer(m, "<f8").max())) for m in b.column(1).to_pylist()]}

    return step


#: DuckDB's form of the query over ``embeddings``, for finite vectors of one length.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64::DOUBLE * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
