"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts whose word 5-grams overlap with a Jaccard similarity of 0.8 or more are linked.  Exact copies are one text.
Band hashes of MinHash values find candidates (a pair at 0.8 is missed with a probability of about 3e-7); they
connect texts to candidate groups.  Within a group, MinHash values are compared a few at a time, and a pair is
dropped when the posterior probability that it reaches the threshold falls below a tolerance; the rest is verified
exactly on the sets of n-grams.  Groups are cut into blocks of bounded size that meet pairwise, and only counts and
spanning links leave a block: pairs are never rows.

Texts that share boilerplate only hang together by bands, but needn't be compared: of two sets of a similarity of at
least t, the rarest n - ceil(t n) + 1 n-grams of either, in any order of n-grams that holds for both, have one in
common.  Groups of more than a block are taken apart by that in shuffles, and so is each block before it is compared,
with the n-grams in order of how many texts of the group or block have them.  No link is lost by it.
"""

from __future__ import annotations

import functools
import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.common import checkpoint, map_batches, narrow, numbered, place, prepare
from haulspark.operators.components import components

#: 50 bands of 6 MinHash values find candidates.
BANDS, ROWS = 50, 6
#: MinHash values that candidates are pruned by, compared STEP at a time.
SKETCH, STEP = 64, 16
#: A block of a candidate group holds about so many texts and n-grams at most.
BLOCK_TEXTS, BLOCK_GRAMS = 4096, 1_000_000
#: Sets fewer than these are compared straight.
FEW = 16
#: Bands that a task remembers, so that a large group is a few rows of it.
KEPT_BANDS = 500_000
EDGES = string.punctuation + "…“”‘’«»¡¿–—"
SEED = 1


class _Words(dict):
    """64-bit hashes of tokens without signs at their ends; 0 where nothing is left."""

    def __missing__(self, token: str) -> int:
        import xxhash

        word = token.strip(EDGES)
        if len(self) > 400_000:
            self.clear()
        h = self[token] = (xxhash.xxh64_intdigest(word) or 1) if word else 0
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str | None], words: _Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer than n words has one, of all of them."""
    out = []
    powers = _mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for t in texts:
        tokens = t.lower().split() if t else ()
        h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
        h = h[h != 0]
        m = max(1, len(h) - n + 1)
        g = np.zeros(m if len(h) else 0, np.uint64)
        for i in range(min(n, len(h))):
            g += h[i : i + m] * powers[i]
        out.append(np.unique(_mix(g)))
    return out


@functools.cache
def _salts(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 2**32, k, np.uint32), r.integers(0, 2**31, k, np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(sets: list[np.ndarray], k: int) -> np.ndarray:
    """MinHash values of sets, none of which may be empty: one row each."""
    ends = np.cumsum([0, *map(len, sets)])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    salt, odd = _salts(k)
    out = np.empty((len(sets), k), np.uint32)
    for i in range(k):
        h = (x ^ salt[i]) * odd[i]
        out[:, i] = np.minimum.reduceat(h ^ (h >> np.uint32(15)), ends[:-1])
    return out


@functools.cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of n equal MinHash values with which, under a flat prior, the posterior probability of a
    similarity of at least ``threshold`` is not below ``tolerance``: P(Binomial(n + 1, threshold) <= matches)."""
    p = 0.0
    for m in range(n + 1):
        p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if p >= tolerance:
            return m
    return n


def _slots(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of a set's n rarest n-grams must be looked at: two sets without one in common there aren't similar."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def teams(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """A label for each set: sets of different labels have a similarity below ``threshold``."""
    n = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), n)
    _, kind, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    order = np.lexsort((rank[kind], row))
    row, kind = row[order], kind[order]
    seen = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < _slots(n, threshold)[row]
    seen &= count[kind] > 1
    row, kind = row[seen], kind[seen]
    order = np.argsort(kind, kind="stable")
    row, kind = row[order], kind[order]
    head = np.concatenate([[True], kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, bool)
    first = row[np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))]
    return _roots(len(sets), row[row != first], first[row != first])


def links(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float, tolerance: float) -> np.ndarray:
    """Which sets of ``a`` are linked to which of ``b`` (to each other, if None), as a matrix of truth values.
    Only sets of one team are compared."""
    own = b is None
    b = a if own else b
    every = a if own else [*a, *b]
    if len(every) < FEW:
        ka = minhash(a, SKETCH)
        return _compared(a, b, ka, ka if own else minhash(b, SKETCH), own, threshold, tolerance)
    team = teams(every, threshold)
    out = np.zeros((len(a), len(b)), bool)
    order = np.argsort(team, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(team[order])) + 1):
        at_a = members if own else members[members < len(a)]
        at_b = members if own else members[members >= len(a)] - len(a)
        if len(at_a) > own and len(at_b):
            part_a, part_b = [a[i] for i in at_a], [b[i] for i in at_b]
            ka = minhash(part_a, SKETCH)
            out[np.ix_(at_a, at_b)] = _compared(part_a, part_b, ka, ka if own else minhash(part_b, SKETCH), own, threshold, tolerance)
    return out


def _compared(a: list[np.ndarray], b: list[np.ndarray], ka: np.ndarray, kb: np.ndarray, own: bool, threshold: float, tolerance: float) -> np.ndarray:
    """Links of sets whose MinHash values are ``ka`` and ``kb``: pruned by these, STEP at a time, then verified."""
    na, nb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    ok = np.minimum(na[:, None], nb) >= threshold * np.maximum(na[:, None], nb)
    if own:
        ok &= np.triu(np.ones_like(ok), 1)
    for at in range(0, len(a), 256):
        part = ok[at : at + 256]
        same = np.zeros(part.shape, np.uint8)
        for n in range(0, SKETCH, STEP):
            need = least_matches(n + STEP, threshold, tolerance)
            if part.mean() < 0.05:  # few are left: compare these alone
                i, j = np.nonzero(part)
                more = (ka[at + i, n : n + STEP] == kb[j, n : n + STEP]).sum(1).astype(np.uint8)
                same[i, j] += more
            else:
                for h in range(n, n + STEP):
                    same += ka[at : at + 256, h, None] == kb[None, :, h]
            part &= same >= need
    return _verified(a, b, na, nb, ok, threshold)


def _verified(a, b, na, nb, ok, threshold) -> np.ndarray:
    i, j = np.nonzero(ok)
    if not len(i):
        return ok
    rows, cols = np.unique(i), np.unique(j)
    if len(i) > 2000 and len(i) > 0.02 * len(rows) * len(cols):  # many: shared n-grams by matrix products
        both = np.concatenate([a[r] for r in rows] + [b[c] for c in cols])
        kinds, count = np.unique(both, return_counts=True)
        kinds = kinds[count > 1]
        cost = 2e-10 * len(rows) * len(cols) * len(kinds)
        if cost < 25e-6 * len(i):
            shared = np.zeros((len(rows), len(cols)), np.float32)
            at_a = [np.searchsorted(kinds, g) for g in (_in(a[r], kinds) for r in rows)]
            at_b = [np.searchsorted(kinds, g) for g in (_in(b[c], kinds) for c in cols)]
            for k in range(0, len(kinds), 2048):
                shared += _dense(at_a, k, 2048) @ _dense(at_b, k, 2048).T
            out = np.zeros_like(ok)
            s = shared.astype(np.float64)
            out[np.ix_(rows, cols)] = s >= threshold * (na[rows][:, None] + nb[cols] - s) - 1e-9
            return out & ok
    del i, j
    out = np.zeros_like(ok)
    for r in rows:
        for c in np.flatnonzero(ok[r]):
            n = len(np.intersect1d(a[r], b[c], assume_unique=True))
            out[r, c] = n >= threshold * (na[r] + nb[c] - n) - 1e-9
    return out


def _in(g: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    at = np.searchsorted(kinds, g)
    at[at == len(kinds)] = 0
    return g[kinds[at] == g] if len(kinds) else g[:0]


def _dense(at: list[np.ndarray], first: int, width: int) -> np.ndarray:
    out = np.zeros((len(at), width), np.float32)
    for r, x in enumerate(at):
        lo, hi = np.searchsorted(x, (first, first + width))
        out[r, x[lo:hi] - first] = 1
    return out


def _leaders(link: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to, by a symmetric matrix."""
    label = np.arange(len(link))
    while True:
        new = label.copy()
        for at in range(0, len(link), 512):
            part = link[at : at + 512]
            new[at : at + 512] = np.minimum(new[at : at + 512], np.where(part, label, len(link)).min(1, initial=len(link)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


# ---- steps -----------------------------------------------------------------------------------------------


def _sketched(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, grams, bands) of every document; the key is the md5 of the text."""

    def make():
        words = _Words()

        def step(b: pa.RecordBatch):
            sets = grams(b.column(2).to_pylist(), words, n)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            for at in range(0, len(full), 250):
                part = full[at : at + 250]
                m = minhash([sets[i] for i in part], BANDS * ROWS).astype(np.uint64).reshape(len(part), BANDS, ROWS)
                h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(part), BANDS)).copy()
                for r in range(ROWS):
                    h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
                for i, row in zip(part, h.view(np.int64), strict=True):
                    bands[i] = row
            yield {"doc_id": b.column(0).to_pylist(), "key": b.column(1).to_pylist(), "grams": [len(s) for s in sets], "bands": bands}

        return step

    return map_batches(docs.select("doc_id", "key", "text"), make, "doc_id bigint, key string, grams int, bands array<bigint>")


def _node(key) -> F.Column:
    """64 bits of a key.  Should two keys share them, their texts only become candidates of each other."""
    return F.xxhash64(key)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of 0..n-1 is connected to by the edges (u, v)."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, their roots, and the edges (node, root) of a spanning forest: one for each node that is no root."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    roots = _roots(len(nodes), at[: len(u)], at[len(u) :])
    other = roots != np.arange(len(nodes))
    return nodes, nodes[roots], nodes[other], nodes[roots[other]]


def _candidate_edges(sketched: DataFrame) -> DataFrame:
    """(u, v) that connect texts with a band in common: a batch's texts hang on a root each, with one edge a text;
    then the roots, with their bands, hang on each other."""

    def local():
        def step(b: pa.RecordBatch):
            node = b.column(0).to_numpy(zero_copy_only=False)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            who = np.repeat(node, BANDS)
            order = np.lexsort((who, flat))
            flat, who = flat[order], who[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            size = np.diff([*first, len(flat)])
            nodes, roots, u, v = _forest(who, np.repeat(who[first], size))
            band, root = flat[first], roots[np.searchsorted(nodes, who[first])]
            # a band that several texts of an earlier batch had is likely to come again: hang on that batch's root
            at = np.minimum(np.searchsorted(step.band, band), len(step.band) - 1)
            met = step.band[at] == band
            _, _, u2, v2 = _forest(root[met], step.root[at[met]])
            often = (size > 1) & ~met
            if len(step.band) > KEPT_BANDS:
                step.band, step.root = step.band[:1], step.root[:1]
            step.band, new = np.unique(np.concatenate([step.band, band[often]]), return_index=True)
            step.root = np.concatenate([step.root, root[often]])[new]
            band, root = band[~met], root[~met]
            links = len(u) + len(u2)
            yield {"band": pa.array([*band.tolist(), *[None] * links], pa.int64()), "u": np.concatenate([root, u, u2]), "v": pa.array([*[None] * len(band), *v.tolist(), *v2.tolist()], pa.int64())}

        step.band, step.root = np.array([np.iinfo(np.int64).max]), np.zeros(1, np.int64)
        return step

    def across():
        def step(b: pa.RecordBatch):
            band, u = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            head = np.concatenate([[band[0] != step.band], band[1:] != band[:-1]])
            at = np.maximum.accumulate(np.where(head, np.arange(len(u)), -1))
            lead = np.where(at >= 0, u[np.maximum(at, 0)], step.lead)
            step.band, step.lead = band[-1], lead[-1]
            other = lead != u
            if other.any():
                _, _, u, v = _forest(u[other], lead[other])
                yield {"u": u, "v": v}

        step.band, step.lead = None, 0
        return step

    both = map_batches(sketched.where("bands is not null").select(_node("key"), "bands"), local, "band bigint, u bigint, v bigint")
    both = checkpoint(both)
    met = both.where("band is not null").select("band", "u").repartition("band").sortWithinPartitions("band", "u")
    return both.where("band is null").select("u", "v").unionByName(map_batches(met, across, "u bigint, v bigint")).distinct()


def _taken_apart(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(key, grp) of the texts of large groups, rows (key, grp, text), in finer groups; texts without a partner are
    left out.  Texts hang together if they share one of their rarest n-grams in their group."""

    def make():
        words = _Words()

        def step(b: pa.RecordBatch):
            sets = grams(b.column(2).to_pylist(), words, n)
            yield {"node": b.column(0).to_pylist(), "grp": b.column(1).to_pylist(), "slots": _slots(np.array([len(s) for s in sets], np.int64), threshold).tolist(), "grams": [s.view(np.int64) for s in sets]}

        return step

    sets = checkpoint(map_batches(texts.select(_node("key"), "grp", "text"), make, "node bigint, grp bigint, slots bigint, grams array<bigint>"))
    each = sets.select("node", "grp", "slots", F.size("grams").alias("size"), F.explode("grams").alias("g"))
    shared = checkpoint(each.groupBy("grp", "g").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"))
    # what only one text has is rarest and fills its slots first
    ranked = each.join(shared, ["grp", "g"]).groupBy("node", "grp").agg(F.sort_array(F.collect_list(F.struct("texts", "g"))).alias("s"), F.first("slots").alias("slots"), F.first("size").alias("size"))
    left = F.greatest(F.col("slots") - F.col("size") + F.size("s"), F.lit(0)).cast("int")
    rare = checkpoint(ranked.select("node", "grp", F.explode(F.slice("s", F.lit(1), left)).alias("x")).select("node", "grp", F.col("x.g").alias("g")))
    lead = rare.groupBy("grp", "g").agg(F.min("node").alias("lead"))
    edges = rare.join(checkpoint(lead), ["grp", "g"]).where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    return components(edges)


def _linked(rows: list[tuple], threshold: float, tolerance: float) -> dict:
    """Counts and leaders within one whole group: rows are (key, copies, set)."""
    link = links([r[2] for r in rows], None, threshold, tolerance)
    link |= link.T
    copies = np.array([r[1] for r in rows], np.int64)
    n, lead = link @ copies, _leaders(link)
    return {"key": [r[0] for r in rows], "n": n.tolist(), "lead": [rows[i][0] for i in lead], "pack": [None] * len(rows), "grp": [None] * len(rows), "block": [None] * len(rows), "blocks": [None] * len(rows)}


def _pack(rows: list[tuple]) -> bytes:
    import pickle

    return pickle.dumps([(k, c, s.tobytes()) for k, c, s in rows], 5)


def _unpack(data: bytes) -> list[tuple]:
    import pickle

    return [(k, c, np.frombuffer(s, np.uint64)) for k, c, s in pickle.loads(data)]


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """All documents as (doc_id, key, grams, bands), and the distinct texts with words as (key, copies, first, n, class):
    how many rows have the text, their smallest id, its links to other texts' rows, its class."""
    spark = docs.sparkSession
    prepare(spark)
    text = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("key", F.md5("text"))
    sketched = checkpoint(_sketched(text, n))
    kinds = sketched.where("grams > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"), F.max("grams").alias("grams"))
    groups = components(_candidate_edges(sketched))
    found = kinds.select("key", "copies", "grams", _node("key").alias("node")).join(groups, "node").select("key", "copies", "grams", F.col("component").alias("grp"))
    found = checkpoint(found)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    size = checkpoint(found.groupBy("grp").agg(blocks))
    large = size.where("blocks > 1").select("grp")
    if not large.isEmpty():
        whole = checkpoint(found.join(large, "grp", "left_semi"))
        finer = _taken_apart(text.select("key", "text").dropDuplicates(["key"]).join(whole.select("key", "grp"), "key"), n, threshold)
        apart = whole.withColumn("node", _node("key")).join(finer, "node").select("key", "copies", "grams", F.col("component").alias("grp"))
        found = checkpoint(found.join(large, "grp", "left_anti").select("key", "copies", "grams", "grp").unionByName(apart))
        size = found.groupBy("grp").agg(blocks)
    placed = found.join(size, "grp").select("key", "copies", "grp", "blocks", F.pmod(F.xxhash64("key", F.lit(3)), "blocks").cast("int").alias("block"))
    texts = text.select("key", "text").dropDuplicates(["key"]).join(placed, "key")

    def shingle():
        words = _Words()

        def step(b: pa.RecordBatch):
            yield {n: b.column(n).to_pylist() for n in ("grp", "block", "blocks", "key", "copies")} | {"grams": [s.tobytes() for s in grams(b.column("text").to_pylist(), words, n_grams)]}

        return step

    n_grams = n
    sets = map_batches(texts, shingle, "grp bigint, block int, blocks int, key string, copies bigint, grams binary")
    sets = sets.repartition("grp", "block").sortWithinPartitions("grp", "block", "key")

    def gather():
        held: list[tuple] = []

        def flush():
            grp, block, blocks = step.at
            rows = list(held)
            held.clear()
            if blocks == 1:
                return _linked(rows, threshold, tolerance) if len(rows) > 1 else None
            return {"key": [None], "n": [None], "lead": [None], "pack": [_pack(rows)], "grp": [grp], "block": [block], "blocks": [blocks]}

        def step(b: pa.RecordBatch):
            for grp, block, blocks, key, copies, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (grp, block, blocks) != step.at:
                    if held and (out := flush()):
                        yield out
                    step.at = (grp, block, blocks)
                held.append((key, copies, np.frombuffer(s, np.uint64)))

        def end():
            if held and (out := flush()):
                yield out

        step.at, step.end = None, end
        return step

    done = checkpoint(map_batches(sets, gather, "key string, n bigint, lead string, pack binary, grp bigint, block int, blocks int"))
    packs = done.where("pack is not null").select("grp", "block", "blocks", "pack")
    left = packs.select("grp", "block", "pack", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    right = packs.select("grp", F.col("block").alias("other"), F.col("pack").alias("pack2"))

    def meet():
        def step(b: pa.RecordBatch):
            for block, other, p, p2 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, own = _unpack(p), block == other
                b2 = a if own else _unpack(p2)
                link = links([r[2] for r in a], None if own else [r[2] for r in b2], threshold, tolerance)
                if own:
                    link |= link.T
                    n_a = link @ np.array([r[1] for r in a], np.int64)
                    lead = _leaders(link)
                    yield {"key": [r[0] for r in a], "n": n_a.tolist(), "lead": [a[i][0] for i in lead]}
                    continue
                whole = np.zeros((len(a) + len(b2),) * 2, bool)
                whole[: len(a), len(a) :] = link
                whole[len(a) :, : len(a)] = link.T
                every = [*a, *b2]
                lead = _leaders(whole)
                counts = np.concatenate([link @ np.array([r[1] for r in b2], np.int64), link.T @ np.array([r[1] for r in a], np.int64)])
                some = np.flatnonzero(counts)
                yield {"key": [every[i][0] for i in some], "n": counts[some].tolist(), "lead": [every[lead[i]][0] for i in some]}

        return step

    pairs = left.join(right, ["grp", "other"]).repartition("grp", "block", "other").select("block", "other", "pack", "pack2")
    met = checkpoint(map_batches(pairs, meet, "key string, n bigint, lead string"))
    whole = done.where("key is not null").select("key", "n", "lead")
    classes = whole.select("key", "n", F.col("lead").alias("class"))
    if not met.isEmpty():
        named = components(met.select(F.col("key").alias("u"), F.col("lead").alias("v")))
        total = met.groupBy("key").agg(F.sum("n").alias("n"))
        classes = classes.unionByName(total.join(named.withColumnRenamed("node", "key"), "key").select("key", "n", F.col("component").alias("class")))
    members = kinds.join(classes, "key", "left").select("key", "copies", "first", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", "key").alias("class"))
    return sketched, checkpoint(members)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, class_id, n_links of every document.

    Two documents are linked if the sets of their word n-grams have a Jaccard similarity of at least ``threshold``;
    ``n_links`` counts a document's links, copies included, and ``class_id`` is the smallest id in its connected
    class.  Words stand between white space, lower-cased, without signs at their ends; a text of fewer than n words
    has one n-gram of all its words.  A text without words, or a null one, has no links and is a class of its own.
    Repeated rows and null ids are documents of their own; a class of null ids only has a null ``class_id``.  No rows
    give no rows.
    """
    sketched, members = _classes(docs, id_col, text_col, n, threshold, tolerance)
    smallest = members.groupBy("class").agg(F.min("first").alias("class_id"))
    named = members.join(smallest, "class").select("key", "class_id", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    out = sketched.select("doc_id", "key", "grams").join(named, "key", "left")
    lone = F.col("grams") == 0
    return out.select("doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(lone, 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """All columns of the documents that stay when each class keeps the one of the smallest id (null last, then by
    text).  Texts without words all stay.  Of rows with the same id and text, the first by their other columns stays."""
    sketched, members = _classes(docs, id_col, text_col, n, threshold, tolerance)
    best = members.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("w"))
    stay = best.select(F.col("w.key").alias("key"), F.col("w.first").alias("id"), F.lit(False).alias("lone"))
    stay = stay.unionByName(sketched.where("grams = 0").select("key", F.col("doc_id").alias("id"), F.lit(True).alias("lone")).distinct())
    at = F.concat_ws(":", "key", F.coalesce(F.col("id").cast("string"), F.lit("none")))  # of a text and an id
    stay = stay.select(at.alias("at"), "lone")
    names, id_at, text_at = docs.columns, f"c{place(docs, id_col)}", f"c{place(docs, text_col)}"
    docs = numbered(docs)
    others = [F.col(c) for c in docs.columns if c not in (id_at, text_at)]
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_at).cast("bigint").alias("id"), F.md5(F.coalesce(F.col(text_at), F.lit(""))).alias("key"),
        (F.to_json(F.struct(*others), exact) if others else F.lit("")).alias("other"), F.col(text_at).isNull().alias("none"),
    )
    # one join moves the texts once, by text and id, so that copies of one text go different ways; rows are grouped there
    kept = rows.withColumn("at", at).join(stay, "at")
    each = F.when(F.col("lone"), F.concat(F.col("none").cast("string"), "other"))
    one = kept.select("at", "lone", each.alias("each"), "row", "other").groupBy("at", "lone", "each").agg(F.min_by("row", "other").alias("row"), F.count(F.lit(1)).alias("n"))
    # equal rows without words are counted, then written out again, a thousand at a time
    n = F.when(F.col("lone"), F.col("n")).otherwise(F.lit(1))
    one = one.select("row", n.alias("n")).select("row", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000))).alias("k"))
    return one.select("row", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("n") - 1000 * F.col("k"))))).select("row.*").toDF(*names)
