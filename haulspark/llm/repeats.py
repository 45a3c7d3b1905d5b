"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else as well.  Each such string (window)
chooses an anchor: the first of its grams of least hash.  Consecutive windows of a text that choose the same place
form a context; equal windows choose the same place of theirs, so they lie in contexts of one gram.

* Contexts that are equal as a whole repeat in all their windows; that takes digests only, no text moves.
* One text of each different context of a gram is brought together.  Packs of whole grams are sorted to a
  Burrows-Wheeler transform; breadth-first backward extension splits its intervals in order of common prefix length
  and stops at LENGTH: the starts of windows that share an interval then are repeated.
* A gram of more than HOT different contexts would be one large pack; its windows are counted by digest instead.

Each window has one context only, so no place is ever taken for a repetition of itself.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.common import map_batches, narrow, prepare
from haulspark.session import written

#: Bytes of a string that must start twice.
LENGTH = 400
#: Bytes of text that are hashed at once, unless a document is longer.
CHUNK = 256 << 10
#: Bytes of contexts in a pack, and different contexts of one gram that may share one.
PACK_BYTES, HOT = 1 << 20, 1000
SPAN = "key binary, lo bigint, hi bigint"
CONTEXT = "key binary, lo bigint, hi bigint, gram bigint, context binary"
BASE = 0x9E3779B97F4A7C15


@functools.cache
def _bytes_table() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers of 0 … n and their inverses, modulo 2^64."""
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each place."""
    n = len(b)
    up, down = _powers(1 << n.bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_bytes_table()[b] * up[:n], out=total[1:])
    x = (total[k:] - total[:-k]) * down[: n - k + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def first_least(x: np.ndarray, w: int) -> np.ndarray:
    """For each w values in a row the place of the least, the first of several: by running minima of blocks."""
    n = len(x)
    keyed = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    whole = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    whole[:n] = keyed
    blocks = whole.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    m = n - w + 1
    return (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts(texts: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """(text, start, end, gram hash) of the contexts of all windows: starts of windows run from ``start`` to
    ``end - length``."""
    k = max(1, 2 * length // 5)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(texts), np.uint8)
    if len(b) < length:
        return []
    h = gram_hashes(b, k)
    at = first_least(h, length - k + 1)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    s = np.flatnonzero(np.arange(len(at)) + length <= ends[text])  # windows within one text
    if not len(s):
        return []
    new = np.flatnonzero(np.concatenate([[True], (at[s][1:] != at[s][:-1]) | (s[1:] != s[:-1] + 1) | (text[s][1:] != text[s][:-1])]))
    lo, hi = s[new], s[np.concatenate([new[1:] - 1, [len(s) - 1]])] + length
    t = text[lo]
    first = ends[t] - sizes[t]
    return list(zip(t.tolist(), (lo - first).tolist(), (hi - first).tolist(), h[at[lo]].view(np.int64).tolist(), strict=True))


def digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


# ---- the transform --------------------------------------------------------------------------------------------


def transform(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes ``s`` in the order of the ``depth`` bytes at least from there on, by tripling (by
    doubling, if three ranks exceed 63 bits), and how many bytes, eight at most, each has in common with the one before."""
    n, x = len(s), np.zeros(len(s) + 8, np.uint64)
    x[:n] = s
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key |= x[i : i + n] << np.uint64(56 - 8 * i)
    sa = np.argsort(key)
    key = key[sa]
    differs = key[1:] ^ key[:-1]
    common = np.zeros(n, np.int64)
    for i in range(8):
        common[1:] += differs < np.uint64(1 << (56 - 8 * i))
    # A place's rank is the first row of those that are equal so far; rows that are alone are settled.
    new = np.concatenate([[True], differs != 0])
    rank, rows, h = np.zeros(n + depth * 3, np.int64), np.arange(n), 8
    wide, times = n + 1, 3 if (n + 1) ** 3 < 1 << 63 else 2
    while True:
        start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        rank[sa[rows]] = rows[start] + 1
        alone = new & np.concatenate([new[1:], [True]])
        rows = rows[~alone]
        if h >= depth or not len(rows):
            return sa, common
        at = sa[rows]
        key = rank[at]
        for i in range(1, times):
            key = key * wide + rank[at + i * h]
        by = np.argsort(key)
        sa[rows], key = at[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        h *= times


def expansion(s: np.ndarray, sa: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each row of the suffix order, whether it has fewer than ``least`` bytes in common with the row before.

    Up to eight bytes that is known from the sorting.  Then backward extension, breadth first: an interval of rows
    that share a prefix w, which the last level has split, splits for each byte c that precedes several of its parts;
    these rows are the interval of cw, one byte longer."""
    n, depth = len(s), min(8, least)
    bound = common < depth
    bound[0] = True
    before = s[sa - 1]  # the transform; the byte before the first is the last
    order = np.argsort(before, kind="stable")  # rows in the order of the bytes in front
    to = np.empty(n, np.int64)
    to[order] = np.arange(n)
    parent, part = np.cumsum(common < depth - 1), np.cumsum(bound)
    rows = np.arange(n)
    for _ in range(least - depth):
        moved = np.arange(n) if len(rows) == n else np.sort(to[rows])
        source = order[moved]
        c, p, q = before[source], parent[source], part[source]
        same = (c[1:] == c[:-1]) & (p[1:] == p[:-1])
        split = same & (q[1:] != q[:-1])
        if not split.any():
            break
        bound[moved[1:][split]] = True
        group = np.cumsum(np.concatenate([[False], ~same]))
        live = np.zeros(group[-1] + 1, bool)
        live[group[1:][split]] = True
        keep = live[group]
        rows = moved[keep]
        parent[rows] = group[keep]
        part[rows] = np.cumsum(np.concatenate([[True], ~same | split]))[keep]
    return bound


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text the starts of the strings of ``length`` bytes that start elsewhere in the texts too."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    if sum(max(0, len(t) - length + 1) for t in texts) < 2:
        return out
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    s = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)  # UTF-8 has no such byte
    inner = np.ones(len(s), bool)
    inner[ends - 1] = False
    sa, common = transform(s, length)
    group = np.cumsum(expansion(s, sa, common, length))
    start = inner.copy()  # with a whole string behind
    text = np.repeat(np.arange(len(texts)), sizes)
    start &= np.arange(len(s)) + length < ends[text]
    many = np.bincount(group[start[sa]], minlength=int(group[-1]) + 1)
    hit = np.sort(sa[start[sa] & (many[group] > 1)])
    for t, at in zip(*_cut(text[hit], hit), strict=True):
        out[t] = at - (ends[t] - sizes[t])
    return out


def _cut(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values by equal neighbouring keys."""
    if not len(keys):
        return [], []
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at].tolist(), np.split(values, at[1:])


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, in order, where touching ones are one."""
    if not len(starts):
        return []
    by = np.argsort(starts, kind="stable")
    a, b = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return list(zip(a[new].tolist(), b[np.concatenate([new[1:], [True]])].tolist(), strict=True))


# ---- on Spark -------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, text): rows of one id and text have one key."""
    d = narrow(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.select(F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text"))).alias("key"), "doc_id", F.col("text").cast("binary").alias("text"))


def _contexts(d: DataFrame, length: int) -> DataFrame:
    def make():
        def step(b: pa.RecordBatch):
            keys, texts, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(text) >= length:
                    keys.append(key)
                    texts.append(text)
                    size += len(text)
                if size >= CHUNK:
                    yield block(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield block(keys, texts)

        def block(keys, texts):
            found = contexts(texts, length)
            t, lo, hi, gram = ([f[i] for f in found] for i in range(4))
            return {"key": [keys[i] for i in t], "lo": lo, "hi": hi, "gram": gram, "context": [digest(texts[i][a:e]) for i, a, e in zip(t, lo, hi, strict=True)]}

        return step

    return map_batches(d.select("key", "text"), make, CONTEXT)


def _cut_out(d: DataFrame, chosen: DataFrame) -> DataFrame:
    """(gram, hot, key, lo, text): the texts of chosen contexts; each document's text moves once."""
    spans = chosen.groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "gram", "hot")).alias("spans"))

    def make():
        def step(b: pa.RecordBatch):
            for key, text, spans in zip(b.column(0), b.column(1), b.column(2), strict=True):
                text, spans = text.as_buffer(), spans.as_py()
                whole = memoryview(text)
                for k in range(0, len(spans), 1000):
                    part = spans[k : k + 1000]
                    yield {"gram": [s["gram"] for s in part], "hot": [s["hot"] for s in part], "key": [key.as_py()] * len(part), "lo": [s["lo"] for s in part], "text": [bytes(whole[s["lo"] : s["hi"]]) for s in part]}

        return step

    return map_batches(d.select("key", "text").join(spans, "key"), make, "gram bigint, hot boolean, key binary, lo bigint, text binary")


def _packs(cuts: DataFrame, length: int, pack_bytes: int) -> DataFrame:
    """Spans of repeated windows among the contexts of each gram, pack by pack."""

    def make():
        held: list[tuple[bytes, int, bytes]] = []
        state = {"gram": None, "size": 0}

        def flush():
            texts = [t for _, _, t in held]
            rows = [(key, lo + a, lo + e) for (key, lo, _), s in zip(held, repeated_starts(texts, length), strict=True) for a, e in merged(s, s + length)]
            held.clear()
            state["size"] = 0
            return {n: [r[i] for r in rows] for i, n in enumerate(("key", "lo", "hi"))}

        def step(b: pa.RecordBatch):
            for gram, key, lo, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if gram != state["gram"] and (state["size"] >= pack_bytes or len(held) > 50_000):
                    yield flush()
                state["gram"] = gram
                held.append((key, lo, text))
                state["size"] += len(text)

        def end():
            if held:
                yield flush()

        step.end = end
        return step

    return map_batches(cuts.select("gram", "key", "lo", "text").repartition("gram").sortWithinPartitions("gram"), make, SPAN)


def _windows(cuts: DataFrame, length: int) -> DataFrame:
    """(window, key, at): a digest of each window of the contexts."""

    def make():
        def step(b: pa.RecordBatch):
            for key, lo, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = len(text) - length + 1
                yield {"window": [digest(text[i : i + length]) for i in range(n)], "key": [key] * n, "at": list(range(lo, lo + n))}

        return step

    return map_batches(cuts.select("key", "lo", "text"), make, "window binary, key binary, at bigint")


def repeated_spans(d: DataFrame, length: int = LENGTH, hot: int = HOT, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(key, lo, hi): spans of repeated windows, which may overlap, of (key, doc_id, text) rows."""
    c = written(_contexts(d, length))
    kinds = written(c.groupBy("gram", "context").agg(F.count("*").alias("n")))
    grams = kinds.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    told = kinds.join(grams, "gram", "left").where((F.col("n") > 1) | F.col("m").isNotNull()).select("context", "n", "m")
    found = written(c.join(told, "context"))  # what repeats as a whole or in part
    whole = found.where(F.col("n") > 1).select("key", "lo", "hi")
    one = found.where(F.col("m").isNotNull()).groupBy("context").agg(F.min(F.struct("key", "lo", "hi", "gram", "m")).alias("one"))
    chosen = one.select("one.key", "one.lo", "one.hi", "one.gram", (F.col("one.m") > hot).alias("hot"))
    cuts = written(_cut_out(d, chosen))
    packed = _packs(cuts.where(~F.col("hot")), length, pack_bytes)
    w = _windows(cuts.where("hot"), length)
    twice = w.groupBy("window").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    counted = w.join(twice, "window", "left_semi").select("key", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    return whole.unionByName(packed).unionByName(counted)


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(doc_id, text, spans, kept) for each row: the text's bytes, the removed runs of bytes as (lo, hi), and the bytes
    that are left.

    A null text is empty, a null id stays null; rows that repeat are documents of their own, so what they share goes
    from all of them; texts shorter than ``length`` bytes keep everything; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    d = _keyed(docs, id_col, text_col)
    spans = repeated_spans(d, length, hot, pack_bytes).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def make():
        def step(b: pa.RecordBatch):
            for doc_id, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = []
                if spans.is_valid:
                    found = merged(*(spans.values.field(i).to_numpy(zero_copy_only=False) for i in range(2)))
                ends = [0, *(x for s in found for x in s), len(text)]
                kept = b"".join(text[a:e] for a, e in zip(ends[::2], ends[1::2], strict=True)) if found else text
                yield {"doc_id": [doc_id], "text": [text], "spans": [[{"lo": a, "hi": e} for a, e in found]], "kept": [kept]}

        return step

    kind = d.schema["doc_id"].dataType.simpleString()
    return map_batches(d.join(spans, "key", "left").select("doc_id", "text", "spans"), make, f"doc_id {kind}, text binary, spans array<struct<lo:bigint,hi:bigint>>, kept binary")


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``without_repeats``."""
    size = F.octet_length("text").cast("bigint")
    return without_repeats(docs, **options).select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
