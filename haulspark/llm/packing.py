"""Packing by non-negative least squares over a histogram of piece lengths.

A document longer than the window is cut into full windows and a rest.  Combinations of up to three rests that
fill the window exactly are enumerated from the histogram, non-negative least squares gives how often to repeat
each, the counts are rounded to what the histogram has, and what is left is packed greedily: the longest rest first,
closed with what fills the window; rests that fill none are laid end to end and cut at each window.  The plan is made from at most ``window`` numbers; rows meet it by
their length and their rank among rows of that length, so no group of equal lengths is ever brought together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulspark.llm.common import checkpoint, map_batches, narrow, prepare
from haulspark.llm.wordbpe import encoder

#: Keys of cut pieces that are sent to all tasks at most (16 MB); more of them meet the texts in a shuffle.
SENT_KEYS = 250_000
PIECE = "doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, pid int, nth bigint, key string"
OUT_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) with a <= b <= c, a + b + c == window and all in the histogram; a is 0 for two lengths."""
    have = hist > 0
    out = []
    for a in [0, *np.flatnonzero(have[:window]).tolist()]:
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        b = b[have[b] & have[window - a - b]]
        out.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def nnls(combos: np.ndarray, hist: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 that makes the combinations' use of each length approach the histogram: multiplicative updates."""
    h = hist.astype(float).copy()
    h[0] = 0
    x = np.full(len(combos), h.sum() / max(1, 3 * len(combos)))
    n = len(h)

    def use(v: np.ndarray) -> np.ndarray:
        u = sum(np.bincount(combos[:, i], v, n) for i in range(3))
        u[0] = 0
        return u

    top = h[combos].sum(1)
    for _ in range(rounds):
        x *= top / np.maximum(use(x)[combos].sum(1), 1e-12)
    return x


def plan(hist: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Combinations, how often each is used, and the histogram of what is left for the greedy end."""
    combos = combinations(hist, window)
    left = hist.astype(np.int64).copy()
    left[0] = 0
    times = np.zeros(len(combos), np.int64)
    if len(combos):
        x = nnls(combos, hist)
        want = np.rint(x).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            if not want[k]:
                if x[k] < 0.5:
                    break
                continue
            parts, need = np.unique(combos[k][combos[k] > 0], return_counts=True)
            t = min(want[k], int((left[parts] // need).min()))
            times[k] = t
            left[parts] -= t * need
    used = times > 0
    return combos[used], times[used], left


def greedy(left: np.ndarray, window: int) -> tuple[list[tuple[list[int], int]], np.ndarray]:
    """Patterns that fill the window from what is left, longest piece first, each as often as the lengths last, and
    what fits no full pattern.  Each pattern uses up a length, so there are at most ``window`` rounds."""
    left, out, loose = left.copy(), [], np.zeros_like(left)

    def take(have: np.ndarray, gap: int) -> int:
        """The piece to put in: one that closes the gap, alone or with another, else the longest that fits."""
        if have[gap]:
            return gap
        b = np.arange(1, gap // 2 + 1)
        pair = b[(have[b] > 0) & (have[gap - b] > 0) & ((2 * b != gap) | (have[b] > 1))]
        if len(pair):
            return gap - int(pair[0])
        fit = np.flatnonzero(have[: gap + 1])
        return int(fit[-1]) if len(fit) and fit[-1] > 0 else 0

    for a in range(window - 1, 0, -1):
        while left[a] > 0:
            have, parts, gap = left.copy(), [a], window - a
            have[a] -= 1
            while gap and (b := take(have, gap)):
                parts.append(b)
                have[b] -= 1
                gap -= b
            kinds, need = np.unique(parts, return_counts=True)
            t = int((left[kinds] // need).min())
            left[kinds] -= t * need
            if gap:
                loose[kinds] += t * need
            else:
                out.append((parts, t))
    return out, loose


class Layout:
    """Where the r-th piece of length a goes: parts of (start, length, sequence, offset)."""

    def __init__(self, hist: np.ndarray, window: int):
        combos, times, left = plan(hist, window)
        patterns = [([a for a in c if a], t) for c, t in zip(combos.tolist(), times.tolist(), strict=True)]
        more, loose = greedy(left[:window], window)
        self.window, first, made = window, 0, {}
        for parts, t in patterns + more:
            at = 0
            for a in parts:
                made.setdefault(a, []).append((t, first, at))
                at += a
            first += t
        self.slots: dict[int, tuple] = {}
        for a, rows in made.items():
            t, base, at = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            self.slots[a] = (np.concatenate([[0], np.cumsum(t)]), base, at)
        self.full_base = first
        self.rest_base = first + (int(hist[window]) if len(hist) > window else 0)
        lengths = np.arange(window)[::-1]
        start = np.concatenate([[0], np.cumsum(lengths * loose[::-1])])
        self.rest_at = {int(a): int(s) for a, s in zip(lengths, start[:-1], strict=True)}

    def place(self, a: int, r: int) -> list[tuple[int, int, int, int]]:
        if a == self.window:
            return [(0, a, self.full_base + r, 0)]
        cum, base, at = self.slots.get(a, (np.zeros(1, np.int64), (), ()))
        if r < cum[-1]:
            e = int(np.searchsorted(cum, r, "right")) - 1
            return [(0, a, int(base[e] + r - cum[e]), int(at[e]))]
        pos, out, done = self.rest_at[a] + (r - int(cum[-1])) * a, [], 0
        while done < a:
            seq, off = divmod(pos + done, self.window)
            n = min(a - done, self.window - off)
            out.append((done, n, self.rest_base + seq, off))
            done += n
        return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """Windows and rests of every document, with the rank of a piece among those of its length in its task."""
    from pyspark import TaskContext

    def make():
        enc, pid = encoder(tokenizer), TaskContext.get().partitionId()
        w, last = enc.width.itemsize, np.array([end_id], enc.width).tobytes()
        seen = np.zeros(window + 1, np.int64)

        def step(b: pa.RecordBatch):
            rows = []
            for doc_id, ids, key in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                ids += last
                n = len(ids) // w
                for at in range(0, n, window):
                    part = ids[at * w : (at + window) * w]
                    a = len(part) // w
                    rows.append((doc_id, at, a, zlib.crc32(enc.wide(part)), n, pid, int(seen[a]), key if a < window else None))
                    seen[a] += 1
            yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "pid", "nth", "key"), map(list, zip(*rows, strict=True)), strict=True))

        return step

    return map_batches(_keyed(docs, id_col, text_col), make, PIECE)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = narrow(docs, doc_id=id_col, text=text_col)
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their place in sequences of at most ``window`` ids.

    A null or empty text is a document of the end id alone.  Repeated rows are packed as often as they come; null
    ids stay null.  An empty table gives no rows.  Only the last sequence may be short.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = checkpoint(pieces(docs, tokenizer, end_id, window, id_col, text_col))
    counts = base.groupBy("pid", "length").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).drop("count")
    hist = np.zeros(window + 1, np.int64)
    for r in base.groupBy("length").count().collect():  # at most window rows
        hist[r["length"]] = r["count"]
    layout = spark.sparkContext.broadcast(Layout(hist, window))  # bounded by the combinations of the window

    def place():
        where = layout.value

        def step(b: pa.RecordBatch):
            rows = []
            for doc_id, start, length, crc, total, key, rank in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts = where.place(length, rank)
                rows += [(doc_id, start + s, n, crc if len(parts) == 1 else None, total, seq, off, key) for s, n, seq, off in parts]
            yield dict(zip((*OUT_NAMES, "key"), map(list, zip(*rows, strict=True)), strict=True))

        return step

    def checksums():
        enc = encoder(tokenizer)
        w, last = enc.width.itemsize, np.array([end_id], enc.width).tobytes()

        def step(b: pa.RecordBatch):
            *keep, texts = (c.to_pylist() for c in b.columns)
            out = dict(zip(OUT_NAMES, keep, strict=True))
            for k, (ids, s, n) in enumerate(zip(enc.encode(texts), out["start"], out["length"], strict=True)):
                out["ids_crc32"][k] = zlib.crc32(enc.wide((ids + last)[s * w : (s + n) * w]))
            yield out

        return step

    ranked = base.join(offsets, ["pid", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "key", (F.col("before") + F.col("nth")).alias("rank"))
    placed = checkpoint(map_batches(ranked, place, f"{OUT}, key string"))
    # the few pieces that the greedy end has cut are encoded once more for their checksums; their texts alone move
    cut = placed.where("ids_crc32 is null")
    keys = cut.select("key").distinct()
    few = keys.count() <= SENT_KEYS
    texts = _keyed(docs, id_col, text_col).select("key", "text").join(F.broadcast(keys) if few else keys, "key", "left_semi").dropDuplicates(["key"])
    cut = map_batches(cut.join(texts, "key").select(*OUT_NAMES, "text"), checksums, OUT)
    out = placed.where("ids_crc32 is not null").select(*OUT_NAMES).unionByName(cut)
    return out.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")  # a sequence lies together
