"""Spelling variants by Bloom-guided neighbourhoods.

Words one edit apart are found without comparing words: each word generates its deletions and its replacements by
later letters (an insertion is a deletion seen from the other side) and probes blocked Bloom filters of the
vocabulary, one shard for each length.  Only positives become rows; an exact join with the vocabulary removes the
false ones.  Edits are never spelt out for that: a word's hash is a sum over its letters and places, so that of an
edit is a sum as well, for many words at once.

Filters are broadcast in rounds of at most FILTER_BYTES, whatever the vocabulary: a round holds some lengths, or a
range of hashes of one length, at a fixed number of bits a word, and the probes of other ranges are passed over.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.common import map_batches, narrow, prepare
from haulspark.session import written

RUN = "[a-zÀ-ÿ]"
#: Letters that a replacement may bring, in code-point order: those of a run after A-Z are lower-cased.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.int64)
#: Words of a task that are counted before they leave it.
HELD = 300_000
#: Bits of a Bloom filter for each word, and bits set in its block of 64.
BITS, HASHES = 16, 4
#: Bytes of filters that one round broadcasts.
FILTER_BYTES = 32 << 20
#: Blocks that travel to the driver as one row.
SLICE = 4096
#: Lengths from here on share a shard.
LONGEST = 64
#: Probes made at once.
PROBES = 1 << 20
SCHEMA = "word string, form string, root string, n bigint, n_near bigint, form_n bigint"
BASE, STIR = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def variants(docs: DataFrame, least: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n): counts of words of ``least`` letters or more within each task; one in ``every`` loses a letter."""

    def make():
        find, held = re.compile(RUN + "{%d,}" % least).findall, Counter()

        def flush():
            out = {"word": list(held), "n": list(held.values())}
            held.clear()
            return out

        def step(b: pa.RecordBatch):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = b"%d:" % doc_id if doc_id is not None else b":"
                for word, n in Counter(find(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(start + word.encode())
                    if h % every == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()

        def end():
            if held:
                yield flush()

        step.end = end
        return step

    return map_batches(narrow(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text"), make, "word string, n bigint")


# ---- hashes of words and of their edits --------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(STIR)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(BASE)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """BASE to the power of 0, 1, … n - 1, modulo 2^64."""
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def letter_values(codes: np.ndarray) -> np.ndarray:
    return _mix(codes.astype(np.uint64) + np.uint64(1))


def codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(words), np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        out[at] = _mix((letter_values(codes([words[i] for i in at], int(length))) * powers(int(length))).sum(1, dtype=np.uint64))
    return out


def edits(c: np.ndarray):
    """For words of one length, as code points: (True, place, None, hashes) for each deletion, (False, place, letters,
    hashes) for each place's replacements; the hashes are a row per word and a column per letter.

    A deletion within a row of equal letters is made once, at the row's end; replacements bring later letters only,
    since the other word of such a pair makes them from its side."""
    m, length = c.shape
    v, p = letter_values(c), powers(length)
    whole = v * p
    total = whole.sum(1, dtype=np.uint64)
    front = np.cumsum(whole, 1, dtype=np.uint64) - whole
    # What follows moves one place to the front: its sum of v[i] * p[i - 1].
    moved = np.zeros((m, length), np.uint64)
    moved[:, 1:] = v[:, 1:] * p[: length - 1]
    back = moved.sum(1, dtype=np.uint64)[:, None] - np.cumsum(moved, 1, dtype=np.uint64)
    new = letter_values(LETTERS)
    for i in range(length):
        yield True, i, None, _mix(front[:, i] + back[:, i])[:, None]
        yield False, i, LETTERS, _mix((total - whole[:, i])[:, None] + (new * p[i])[None, :])


# ---- filters ------------------------------------------------------------------------------------------------


def shard(length) -> F.Column:
    return F.least(length, F.lit(LONGEST))


def mask(h: np.ndarray) -> np.ndarray:
    """HASHES bits of 64, from the low bits of hashes."""
    out = np.zeros(h.shape, np.uint64)
    for k in range(HASHES):
        out |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return out


def blocks_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """A block number from the high bits of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def rounds(sizes: dict[int, int], filter_bytes: int) -> list[dict[int, tuple[int, int, int]]]:
    """For each round: shard -> (blocks of the whole shard, first block, end), so that a round has at most
    ``filter_bytes``.  ``sizes`` counts the words of each shard."""
    most, out, left = max(1, filter_bytes // 8), [], 0
    for s, n in sorted(sizes.items()):
        whole = max(1, math.ceil(n * BITS / 64))
        at = 0
        while at < whole:
            if not left:
                out.append({})
                left = most
            take = min(left, whole - at)
            out[-1][s] = (whole, at, at + take)
            at, left = at + take, left - take
    return out


def _filters(words: DataFrame, plan: dict[int, tuple[int, int, int]]) -> dict[int, np.ndarray]:
    """The round's filters: their bits are joined on the executors by block, so the driver gets the filters only."""
    held = {s: np.zeros(b - a, np.uint64) for s, (_, a, b) in plan.items()}

    def make():
        def step(b: pa.RecordBatch):
            w = b.column(0).to_pylist()
            h, size = word_hashes(w), np.minimum(np.fromiter(map(len, w), np.int64, len(w)), LONGEST)
            for s, (whole, lo, hi) in plan.items():
                at = h[size == s]
                block = blocks_of(at, whole).astype(np.int64)
                ok = (block >= lo) & (block < hi)
                if ok.any():
                    yield {"shard": [s] * int(ok.sum()), "block": block[ok] - lo, "bits": mask(at[ok]).view(np.int64)}

        return step

    def slices(key, pdf):
        """SLICE blocks as bytes."""
        out = np.zeros(SLICE, np.int64)
        out[pdf["block"].to_numpy() % SLICE] = pdf["bits"].to_numpy()
        return pd.DataFrame({"shard": [key[0]], "part": [key[1]], "bits": [out.tobytes()]})

    bits = map_batches(words.select("word"), make, "shard int, block bigint, bits bigint").groupBy("shard", "block").agg(F.bit_or("bits").alias("bits"))
    parts = bits.groupBy("shard", F.expr(f"block div {SLICE}").alias("part")).applyInPandas(slices, "shard int, part bigint, bits binary")
    for r in parts.collect():  # as many bytes as the round's filters have
        whole, at = held[r["shard"]], r["part"] * SLICE
        part = whole[at : at + SLICE]
        part[:] = np.frombuffer(r["bits"], np.uint64)[: len(part)]
    return held


def _positives(words: DataFrame, plan: dict[int, tuple[int, int, int]], filters: dict[int, np.ndarray], shortest: int) -> DataFrame:
    """(word, n, edit): the edits of each word that the round's filters hold."""
    shared = words.sparkSession.sparkContext.broadcast({s: f.tobytes() for s, f in filters.items()})

    def make():
        own = {s: np.frombuffer(f, np.uint64) for s, f in shared.value.items()}

        def step(b: pa.RecordBatch):
            words, counts = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(sizes).tolist():
                chosen = np.flatnonzero(sizes == length)
                many = max(1, PROBES // (2 * len(LETTERS) + 4 * length))
                for k in range(0, len(chosen), many):
                    at = chosen[k : k + many]
                    group = [words[i] for i in at]
                    c = codes(group, length)
                    found: list[tuple[int, str]] = []
                    for shorter, i, letters, h in edits(c):
                        s = min(length - shorter, LONGEST)
                        if s not in own or length - shorter < shortest:
                            continue
                        whole, lo, hi = plan[s]
                        block = blocks_of(h, whole).astype(np.int64)
                        if hi - lo < whole:
                            ok = (block >= lo) & (block < hi)
                            block = np.where(ok, block, lo)
                        bits = mask(h)
                        hit = (own[s][block - lo] & bits) == bits
                        if hi - lo < whole:
                            hit &= ok
                        if shorter:  # equal letters in a row: only the last one goes
                            if i + 1 < length:
                                hit[:, 0] &= c[:, i] != c[:, i + 1]
                            found += [(j, group[j][:i] + group[j][i + 1 :]) for j in np.flatnonzero(hit[:, 0]).tolist()]
                        else:
                            hit &= letters[None, :] > c[:, i][:, None]
                            found += [(j, group[j][:i] + chr(letters[x]) + group[j][i + 1 :]) for j, x in zip(*(y.tolist() for y in np.nonzero(hit)), strict=True)]
                    if found:
                        yield {"word": [group[j] for j, _ in found], "n": counts[at[[j for j, _ in found]]], "edit": [e for _, e in found]}

        return step

    return map_batches(words.select("word", "n"), make, "word string, n bigint, edit string")


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): all pairs of words one edit apart, from both sides.  ``words`` has distinct words of
    letters that RUN allows, and their counts; it is read several times, so it should be a written table."""
    sizes = {r["s"]: r["c"] for r in words.groupBy(shard(F.char_length("word")).alias("s")).agg(F.count("*").alias("c")).collect()}
    shortest = words.agg(F.min(F.char_length("word"))).first()[0] or 0
    found = None
    for plan in rounds(sizes, filter_bytes):
        p = _positives(words, plan, _filters(words, plan), shortest)
        found = p if found is None else found.unionByName(p)
    if found is None:
        return words.sparkSession.createDataFrame([], "word string, n bigint, near string, near_n bigint")
    pairs = found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    both = F.array(F.struct(F.col("word"), F.col("n"), F.col("edit").alias("near"), F.col("edit_n").alias("near_n")), F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root): the end of each chain of forms.  Each form has ``ratio`` times its word's count at least and no
    word has more than ``most``, so the hops are bounded; each round doubles those taken."""
    hops = max(1, math.ceil(math.log(max(most, 2), ratio)))
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(hops + 1))):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return at


def spelling_forms(docs: DataFrame, least: int = 7, occurs: int = 2, ratio: int = 10, every: int = 31, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``least`` letters or more that occurs ``occurs`` times.

    Its form is the near word of largest n (ties: the smallest by code point) if that has ``ratio`` times its own
    count; root follows the forms to the last.  Null and empty texts have no words, a null id counts as an empty one,
    repeated rows count again, an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    counted = variants(docs, least, every, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n"))
    words = written(counted.where(F.col("n") >= occurs))
    near = near_pairs(words, filter_bytes)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    strong = F.col("near_n") >= ratio * F.col("n")
    known = written(joined.select("word", "n", "n_near", F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")))
    most = known.agg(F.max("n")).first()[0] or 0
    ends = roots(known.where(F.col("form").isNotNull()), most, ratio)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
