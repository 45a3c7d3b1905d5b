"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words that repeats with a smallest period and that no neighbouring word extends.  For the words
of a document a suffix automaton is built; its suffix links form a tree, whose root path from a prefix holds all the
prefix's endings.  The words are then appended once more: access() of a link-cut tree recolours the root path with
the new end, and each segment of the path that it meets holds the longest ending that was last seen at one former
end.  If the two ends lie no farther apart than that ending is long, the text between is a square; the last of a
run's squares, which the next word doesn't continue, is the run.  Because a segment's end is its last occurrence, the
distance is the smallest period.

Only stretches whose words can be periodic reach the automaton: all words of a run lie in groups of LOOK words that
come again within a quarter of the stretch.  That is looked up for a whole batch at once by sorting hashes; an equal
hash of different words only adds a stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haulspark.llm.common import map_batches, narrow, prepare

#: A run has at least LEAST words and REPEATS periods.
LEAST, REPEATS = 6, 4
#: Words of a group that must come again; the shortest run still has two groups.
LOOK = 4
#: Bytes of text that are looked up at once.
CHUNK = 2 << 20
SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document after the planted repetition, which some ids have."""
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * (-(-(n - a) // p)))[: n - a]


def stretches(docs: list[list[bytes]]) -> list[tuple[int, int, int]]:
    """(document, start, end) of the stretches that can hold a run of at least LEAST words and REPEATS periods."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    n = int(sizes.sum())
    if n < LEAST:
        return []
    first = np.cumsum(sizes) - sizes
    h = np.fromiter((hash(w) for d in docs for w in d), np.int64, n).view(np.uint64)
    m = n - LOOK + 1
    gram = np.zeros(m, np.uint64)
    for i in range(LOOK):
        gram = (gram ^ h[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    a, b = first, first + sizes  # the stretches so far, apart and in order
    while True:
        a, b = a[b - a >= LEAST], b[b - a >= LEAST]
        if not len(a):
            return []
        count = b - a - LOOK + 1
        at = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        own = np.repeat(np.arange(len(a), dtype=np.uint64), count)
        key = gram[at] + own * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        near = (key[1:] == key[:-1]) & (place[1:] - place[:-1] <= np.repeat((b - a) // REPEATS, count)[order][1:])
        again = np.zeros(n + 1, np.int32)
        hit = np.unique(np.concatenate([place[1:][near], place[:-1][near]]))
        # Words covered by groups that come again, cut where one stretch ends and the next begins.
        np.add.at(again, hit, 1)
        np.add.at(again, hit + LOOK, -1)
        covered = np.cumsum(again[:-1]) > 0
        inside = np.zeros(n, np.int64)
        inside[a] += 1
        edge = np.concatenate([[True], covered[1:] != covered[:-1], [True]])
        edge[:-1] |= (inside > 0) & covered
        cut = np.flatnonzero(edge)
        left, right = cut[:-1], cut[1:]
        keep = covered[left]
        left, right = left[keep], right[keep]
        if len(left) == len(a) and (left == a).all() and (right == b).all():
            break
        a, b = left, right
    doc = np.searchsorted(first, a, side="right") - 1
    return [(int(d), int(x - first[d]), int(y - first[d])) for d, x, y in zip(doc, a, b, strict=True)]


def automaton(s: list[int]) -> tuple[array, array, array]:
    """Suffix automaton of s: the length and suffix link of each state (0 is the root), and each prefix's state."""
    size = 2 * len(s) + 1
    length, link = array("i", bytes(4 * size)), array("i", bytes(4 * size))
    word, target = array("i", b"\xff" * (4 * size)), array("i", bytes(4 * size))
    more: dict[int, dict[int, int]] = {}  # a state's transitions beyond its first
    prefix = array("i", bytes(4 * len(s)))
    link[0] = -1
    last, states = 0, 1
    for i, c in enumerate(s):
        cur = states
        states += 1
        length[cur] = i + 1
        p, q = last, -1
        while p >= 0:
            w = word[p]
            if w == c:
                q = target[p]
                break
            if w < 0:
                word[p], target[p] = c, cur
            else:
                rest = more.get(p)
                if rest is None:
                    more[p] = {c: cur}
                elif c in rest:
                    q = rest[c]
                    break
                else:
                    rest[c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        elif length[p] + 1 == length[q]:
            link[cur] = q
        else:
            clone = states
            states += 1
            length[clone], link[clone], word[clone], target[clone] = length[p] + 1, link[q], word[q], target[q]
            if q in more:
                more[clone] = dict(more[q])
            while p >= 0:
                if word[p] == c:
                    if target[p] != q:
                        break
                    target[p] = clone
                else:
                    rest = more.get(p)
                    if rest is None or rest.get(c) != q:
                        break
                    rest[c] = clone
                p = link[p]
            link[q] = link[cur] = clone
        prefix[i] = last = cur
    return length[:states], link[:states], prefix


def squares(length: array, link: array, prefix: array):
    """Appends word after word; yields (end, distance, length) for each segment of recoloured root path: the longest
    ending of the words up to ``end`` whose last occurrence ended ``distance`` words earlier has ``length`` words.

    Nodes are states plus one and 0 is none, so the root is 1.  A splay tree holds a path of one colour, which its
    splay root carries; parents of splay roots lead to the path above."""
    n = len(link)
    parent = array("i", [0, *(x + 1 for x in link)])
    left, right, colour = array("i", bytes(4 * n + 4)), array("i", bytes(4 * n + 4)), array("i", b"\xff" * (4 * n + 4))

    def splay(x: int) -> None:
        p = parent[x]
        if not p or left[p] != x and right[p] != x:
            return
        while True:
            g = parent[p]
            top = not g or left[g] != p and right[g] != p
            if not top:
                gg = parent[g]
                if (left[g] == p) == (left[p] == x):  # zig-zig: the parent turns first
                    rotate(p, g, gg)
                    rotate(x, p, gg)
                else:
                    rotate(x, p, g)
                    rotate(x, g, gg)
                if left[gg] != x and right[gg] != x or not gg:
                    colour[x] = colour[g]
                    return
                p = gg
            else:
                rotate(x, p, g)
                colour[x] = colour[p]
                return

    def rotate(x: int, p: int, g: int) -> None:
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        parent[x] = g
        if left[p] == x:
            y = right[x]
            left[p], right[x] = y, p
        else:
            y = left[x]
            right[p], left[x] = y, p
        if y:
            parent[y] = p
        parent[p] = x

    for end, state in enumerate(prefix):
        x, below = state + 1, 0
        while x:
            splay(x)
            c = colour[x]
            if c >= 0 and x > 1:
                yield end, end - c, length[x - 1]
            y = right[x]
            if y:
                colour[y] = c  # the rest of the path keeps its end
            right[x] = below
            below, x = x, parent[x]
        splay(state + 1)
        colour[state + 1] = end


def runs(s: list[int], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``repeats`` (two or more) periods, by start."""
    n, out = len(s), []
    for end, distance, size in squares(*automaton(s)):
        whole = size + distance
        if whole >= least and whole >= repeats * distance and (end + 1 == n or s[end + 1] != s[end + 1 - distance]):
            out.append((end - whole + 1, whole, distance))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each document's words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for d, a, b in stretches(docs):
        index: dict[bytes, int] = {}
        out[d] += [(a + s, length, q) for s, length, q in runs([index.setdefault(w, len(index)) for w in docs[d][a:b]])]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not found:
        return words
    drop = np.zeros(len(words) + 1, np.int32)
    for s, length, q in found:
        drop[s + q] += 1
        drop[s + length] -= 1
    keep = np.cumsum(drop[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its number of runs, its strongest run and digests of all runs and of the collapsed words.

    Words are what ASCII white space parts.  A null or empty text has no words and no runs; a null id plants nothing
    and stays null; repeated rows give a row each.  The strongest run has the greatest length by period, ties to the
    smaller start, then period.  A document is worked on as a whole, in memory that its length bounds; nothing is
    shuffled.
    """
    prepare(docs.sparkSession)

    def make():
        def step(b: pa.RecordBatch):
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                ids.append(i)
                texts.append(planted(raw.split(), i))
                size += len(raw)
                if size >= CHUNK:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield block(ids, texts)

        return step

    return map_batches(narrow(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text"), make, SCHEMA)


def block(ids: list[int | None], docs: list[list[bytes]]) -> dict:
    rows = []
    for i, words, found in zip(ids, docs, found_runs(docs), strict=True):
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
        rows.append((i, len(found), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return {n: [r[k] for r in rows] for k, n in enumerate(names)}
