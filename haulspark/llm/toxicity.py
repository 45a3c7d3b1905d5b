"""Toxicity behind a noisy channel.

What a writer meant went through a channel that swaps letters for look-alikes, spaces them out and repeats them.
Each suspicious token, or run of single letters, becomes a lattice of characters it may stand for, and Viterbi
decoding under a character language model restores the likeliest text.  A classifier scores the restored words.

The language model counts the character trigrams of all documents.  The classifier is a short list of words and
word beginnings with a probability each, found by greedy cover on a bounded sample of labelled rows.
"""

from __future__ import annotations

import atexit
import bisect
import functools
import math
import re
import shutil
import string
import tempfile
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.common import checkpoint, map_batches, narrow, numbered, place, prepare

#: What a sign may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
}
EDGES = string.punctuation + "…“”‘’«»¡¿–—"
LETTERS = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"(.)\1\1")
SPACED = re.compile(r"(?<!\S)[^\s.,_*-](?:[ .,_*-]{1,3}[^\s.,_*-](?![^\s.,_*-])){2,}")
SPACED_LETTER = re.compile(r"([^\s.,_*-])([ .,_*-]*)")
LONG_RUN = re.compile(r"(.)\1{3,}")
#: Costs of the channel, as log probabilities.
SWAP, SAME, DROP, LOSE, ONCE, TWICE, PAIR = -1.0, -2.5, -1.5, -4.0, -0.5, -1.0, -3.0  # LOSE: a sign that may be a letter
#: Signs at a token's start and end that may be letters rather than punctuation.
LEAD, TRAIL = "$@!|+*", "$@*+"
#: Words or trigrams that a task holds before it sends their sums on, and scores that it remembers.
HELD, MEMO = 200_000, 1_000_000
#: How many features of different beginnings are to explain each toxic text of the sample, where it has as many.
COVER = 3


class Language:
    """Character trigram model with absolute back-off to pairs and single characters."""

    def __init__(self, counts: dict[str, float]):
        self.three: dict[str, float] = counts
        self.two: Counter = Counter()
        self.pair: Counter = Counter()
        self.one: Counter = Counter()
        for g, n in counts.items():
            self.two[g[:2]] += n
            self.pair[g[1:]] += n
            self.one[g[2]] += n
        self.mid: Counter = Counter()
        for g, n in self.pair.items():
            self.mid[g[0]] += n
        self.total = sum(self.one.values()) + 1.0
        self.memo: dict[str, float] = {}

    def sums(self, g: str) -> tuple[float, float, float, float, float]:
        """Counts of a trigram, of its first two characters, its last two, its middle one and its last one."""
        return self.three.get(g, 0.0), self.two[g[:2]], self.pair[g[1:]], self.mid[g[1]], self.one[g[2]]

    def score(self, before: str, c: str) -> float:
        """log P(c | two characters before it)."""
        g = before + c
        if (s := self.memo.get(g)) is None:
            three, two, pair, mid, one = self.sums(g)
            p1 = (one + 0.1) / (self.total + 100)
            p2 = (pair + 5 * p1) / (mid + 5)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            s = self.memo[g] = math.log((three + 2 * p2) / (two + 2))
        return s


class StoredLanguage(Language):
    """The same model over a file of sorted tables, which is mapped into memory and not read as a whole.

    Each table is keys and running sums: trigrams, pairs of their last two characters, last characters.  Counts of
    what begins alike are differences of the running sums.
    """

    def __init__(self, path: str):
        sizes = np.fromfile(path, "<i8", 3)
        at, self.tables = 24, []
        for n in sizes.tolist():
            keys, upto = (np.memmap(path, "<i8", "r", at + 8 * k * n, (n,)) if n else np.zeros(0, np.int64) for k in (0, 1))
            self.tables.append((keys, upto))
            at += 16 * n
        last = self.tables[2][1]
        self.total = (int(last[-1]) if len(last) else 0) + 1.0
        self.memo: dict[str, float] = {}

    def _between(self, table: int, low: int, high: int) -> float:
        """Counts of the keys from ``low`` up to, not including, ``high``."""
        keys, upto = self.tables[table]
        i, j = bisect.bisect_left(keys, low), bisect.bisect_left(keys, high)
        return float(int(upto[j - 1]) - (int(upto[i - 1]) if i else 0)) if j > i else 0.0

    def sums(self, g: str) -> tuple[float, float, float, float, float]:
        a, b, c = map(ord, g)
        ab, bc = a << 21 | b, b << 21 | c
        key = ab << 21 | c
        return self._between(0, key, key + 1), self._between(0, ab << 21, (ab + 1) << 21), self._between(1, bc, bc + 1), self._between(1, b << 21, (b + 1) << 21), self._between(2, c, c + 1)


@functools.cache
def _edges(c: str, run: int) -> list[tuple[int, str, float]]:
    """What a character may stand for that is followed by itself up to ``run`` times, counted with it."""
    edges = []
    for x in LOOKALIKE.get(c, ""):
        edges.append((1, x, SWAP - 0.3 * (len(LOOKALIKE[c]) - 1)))
        if run > 1:
            edges.append((run, x, SWAP - 0.5))
    if c.isalpha():
        edges.append((1, c, 0.0 if c not in LOOKALIKE else SAME))
        if run > 1:
            edges += [(run, c, ONCE if run > 2 else PAIR)] + [(run, c + c, TWICE)] * (run > 2)
    elif c.isdigit():
        edges.append((1, c, SAME))
    else:
        edges += [(1, "", LOSE if c in LOOKALIKE else DROP), (1, " ", SAME)]
        if run > 1:
            edges.append((run, "", DROP))
    return edges


def lattice(token: str) -> list[list[tuple[int, str, float]]]:
    """For each place of a token, edges (characters used up, text, log probability)."""
    out, run = [], 0
    for i in range(len(token) - 1, -1, -1):
        run = run + 1 if token[i : i + 1] == token[i + 1 : i + 2] else 1
        out.append(_edges(token[i], run))
    return out[::-1]


def spaced_lattice(text: str) -> tuple[str, list[list[tuple[int, str, float]]]]:
    """The letters of a run of single letters, and their lattice: what stands between two letters is nothing or a
    space.  A letter repeated more than three times, spaced out or not, counts as three."""
    letters, gaps = [], []
    for m in SPACED_LETTER.finditer(text):
        if letters[-3:] == [m[1]] * 3:
            gaps[-1] = len(m[2])
        else:
            letters.append(m[1])
            gaps.append(len(m[2]))
    whole, out = "".join(letters), []
    for i, edges in enumerate(lattice(whole)):
        out.append([])
        for used, new, cost in edges:
            if used == 2:  # a pair of letters that were set apart is meant as one
                continue
            gap = gaps[i + used - 1]
            out[-1].append((used, new, cost - 0.1 * gap))
            if gap:
                out[-1].append((used, new + " ", cost - 4.0 - 0.1 * (gap - 1)))
    return whole, out


def viterbi(edges: list[list[tuple[int, str, float]]], language: Language) -> str:
    """The likeliest text through the lattice; a state is a place and the last two characters.

    A state keeps its last piece of text and the state before, so that time is linear in the length and what no state
    leads back to is freed.
    """
    n = len(edges)
    at: dict[int, dict[str, tuple[float, tuple | None]]] = {0: {"  ": (0.0, None)}}
    for i in range(n):
        for state, (score, back) in sorted(at.pop(i, {}).items(), key=lambda x: -x[1][0]):
            for used, new, cost in edges[i]:
                s, before = score + cost, state
                for c in new:
                    if c == " " and before[1] == " ":
                        continue
                    s += language.score(before, c)
                    before = before[1] + c
                to = at.setdefault(i + used, {})
                old = to.get(before)
                if old is None or s > old[0]:
                    to[before] = (s, (back, new) if new else back)
    end = at.get(n, {})
    if not end:
        return ""
    # of equal scores the greatest text, as for whole texts
    best = max(s + language.score(b, " ") for b, (s, _) in end.items())
    return max(_text(back) for b, (s, back) in end.items() if s + language.score(b, " ") == best)


def _text(back: tuple | None) -> str:
    out = []
    while back:
        back, new = back
        out.append(new)
    return "".join(reversed(out))


def squeeze(token: str) -> str:
    """A token with no character more than three times in a row: more say no more."""
    return LONG_RUN.sub(r"\1\1\1", token)


def restore(token: str, language: Language) -> str:
    """The likeliest text of a lower-case token; plain words are what they are."""
    if token.isalpha() and not TRIPLE.search(token):
        return token
    return viterbi(lattice(squeeze(token)), language)


def words_of(token: str, language: Language) -> set[str]:
    """Words that a token may hold: its letter runs, and those of what it is restored to."""
    bare = token.strip(EDGES)
    edge = token[0] in LEAD and token[1:2] != token[0] or token[-1] in TRAIL and token[-2:-1] != token[-1]
    if bare.isalpha() and not edge and not TRIPLE.search(bare):
        return {bare}
    found = set(LETTERS.findall(token))
    if found:
        found.update(LETTERS.findall(restore(bare, language)))
        if edge:
            found.update(LETTERS.findall(restore(token, language)))
    return found


def spaced_words(text: str, language: Language) -> set[str]:
    """Words of runs of single letters, restored."""
    found: set[str] = set()
    for m in SPACED.finditer(text):
        found.update(LETTERS.findall(viterbi(spaced_lattice(m[0])[1], language)))
    return found


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) >= k)] if len(word) > 2 else []


class Reader:
    """Distinct words of texts, each raw token looked at once per task (up to ``keep`` tokens)."""

    def __init__(self, language: Language, value, keep: int = 200_000):
        self.language, self.value, self.keep, self.known = language, value, keep, {}

    def values(self, text: str) -> Iterator:
        """value(words) of each distinct token of a text that has one."""
        text = text.lower()
        tokens = set(text.split())
        if len(self.known) > self.keep:
            self.known = {}
        for t in tokens.difference(self.known):
            self.known[t] = self.value(words_of(t, self.language))
        yield from filter(None, map(self.known.__getitem__, tokens))
        if sum(len(t.strip(EDGES)) == 1 for t in tokens if len(t) < 4) > 1 and (more := self.value(spaced_words(text, self.language))):
            yield more


# ---- training --------------------------------------------------------------------------------------------


def language_model(docs: DataFrame, text_col: str = "text") -> str:
    """Counts the character trigrams of all documents' words and gives the name of the model's file, see ``model``.

    No word and no trigram is left out: what a task holds is sent on and summed, never dropped, so the counts are
    whole numbers that don't depend on the partitioning.
    """

    def make():
        words: Counter = Counter()
        sums: Counter = Counter()

        def fold():
            if not words:
                return
            order = list(words)
            chars = np.frombuffer(("  " + "  ".join(order) + "  ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            codes = chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:]
            times = np.repeat(np.array([words[w] for w in order], float), [len(w) + 2 for w in order])
            times = np.concatenate([times, np.zeros(len(codes) - len(times))])
            kinds, where = np.unique(codes, return_inverse=True)
            for k, n in zip(kinds.tolist(), np.bincount(where, times).astype(np.int64).tolist(), strict=True):
                sums[k] += n
            words.clear()

        def send():
            if sums:
                yield {"g": list(sums), "n": list(sums.values())}
                sums.clear()

        def step(b: pa.RecordBatch):
            for text in b.column(0).to_pylist():
                if text:
                    words.update(text.lower().split())
            if len(words) > HELD or sum(map(len, words)) > 20 * HELD:
                fold()
            if len(sums) > HELD:
                yield from send()

        def end():
            fold()
            yield from send()

        step.end = end
        return step

    grams = map_batches(narrow(docs, text=text_col), make, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    grams = checkpoint(grams.where("n > 0"))
    pairs = checkpoint(grams.groupBy(F.col("g").bitwiseAND(F.lit((1 << 42) - 1)).alias("g")).agg(F.sum("n").alias("n")))
    ones = pairs.groupBy(F.col("g").bitwiseAND(F.lit((1 << 21) - 1)).alias("g")).agg(F.sum("n").alias("n"))
    return _store(grams, pairs, ones)


def _store(*tables: DataFrame) -> str:
    """Writes sorted keys and running sums to a file that Spark ships to all executors; the driver holds a part of a
    table at a time."""
    sc = tables[0].sparkSession.sparkContext
    folder = tempfile.mkdtemp(prefix="haulspark-language-")
    atexit.register(shutil.rmtree, folder, True)
    name = f"language-{uuid.uuid4().hex}"
    sizes = []
    with open(f"{folder}/{name}", "wb") as out, tempfile.TemporaryFile(dir=folder) as held:
        out.write(bytes(24))
        for t in tables:
            n = upto = 0
            held.seek(0)
            held.truncate()
            packed = map_batches(t.orderBy("g"), lambda: lambda b: iter([{"g": [b.column(0).to_numpy().astype("<i8").tobytes()], "n": [b.column(1).to_numpy().astype("<i8").tobytes()]}]), "g binary, n binary")
            for r in packed.toLocalIterator():
                sums = np.cumsum(np.frombuffer(r["n"], "<i8")) + upto
                upto = int(sums[-1])
                n += len(sums)
                out.write(r["g"])
                held.write(sums.astype("<i8").tobytes())
            held.seek(0)
            shutil.copyfileobj(held, out)
            sizes.append(n)
        out.seek(0)
        out.write(np.array(sizes, "<i8").tobytes())
    sc.addFile(f"{folder}/{name}")
    return name


def model(name: str) -> Language:
    """The language model of a name, on the driver or in a task."""
    return StoredLanguage(SparkFiles.get(name))


def fit(docs: DataFrame, labels: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 3000, max_clean: int = 9000) -> tuple[dict[str, float], float]:
    """Features with their probabilities, and the probability without any.

    Learns from at most ``max_toxic`` and ``max_clean`` rows, chosen by a hash of the id among those whose
    crc32(id as text) mod 5 is not 0; of rows that share an id the least text counts.  Without toxic rows, or without clean ones, there are no features.
    """
    spark = docs.sparkSession
    y = narrow(labels, doc_id=id_col, y=label_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("y").cast("int").alias("y"))
    y = y.where(F.col("y").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return {}, 0.5 * (1 + totals.get(1, 0)) / (1 + sum(totals.values())) if totals.get(0) or not totals else 0.5
    order = F.xxhash64("doc_id", F.lit(5))
    chosen = y.where("y = 1").orderBy(order).limit(max_toxic).unionByName(y.where("y = 0").orderBy(order).limit(max_clean))
    text = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # of rows that share an id the least text, so that the sample's bound holds
    sample = text.join(F.broadcast(chosen), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = checkpoint(sample.repartition(4 * spark.sparkContext.defaultParallelism))

    def found(texts: list[str]):
        """The distinct features of each text."""
        reader = Reader(model(language), lambda words: [f for w in words for f in features(w)])
        for t in texts:
            yield set().union(*reader.values(t))

    def count():
        seen = (Counter(), Counter())

        def step(b: pa.RecordBatch):
            for k, fs in zip(b.column(1).to_pylist(), found(b.column(0).to_pylist()), strict=True):
                seen[k].update(fs)
            return ()

        def end():
            fs = list(seen[1])  # a feature that no toxic text of this task has may still be one of another's
            rest = [f for f in seen[0] if f not in seen[1]]
            yield {"f": fs + rest, "n1": [seen[1][f] for f in fs] + [0] * len(rest), "n0": [seen[0][f] for f in fs + rest]}

        step.end = end
        return step

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}, 0.1
    least = max(4, int(0.003 * sizes[1]))
    grow = totals[0] / sizes[0] * sizes[1] / totals[1]  # a clean row of the sample stands for so many against a toxic one
    counts = map_batches(sample.select("text", "y"), count, "f string, n1 bigint, n0 bigint").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    kept = counts.where((F.col("n1") >= least) & (F.col("n1") >= 4 * grow * F.col("n0"))).orderBy(F.desc("n1"), "f").collect()
    # kept: words and beginnings that at least ``least`` toxic texts of the bounded sample have
    n1, n0 = ({r["f"]: r[c] for r in kept} for c in ("n1", "n0"))
    index = {f: i for i, f in enumerate(n1)}

    def cover():
        def step(b: pa.RecordBatch):
            for fs in found(b.column(0).to_pylist()):
                yield {"has": [[index[f] for f in fs if f in index]], "sign": [min((zlib.crc32(f.encode()) for f in fs), default=0)]}

        return step

    # near copies mostly share their smallest hash; one of them stands for all, lest a copied text's words look toxic
    rows = map_batches(sample.where("y = 1").select("text"), cover, "has array<int>, sign bigint").orderBy("sign", F.size("has")).collect()
    has = list({r["sign"]: set(r["has"]) for r in rows}.values())
    names = list(index)
    said: set[int] = set()  # features that say the same as one that we have
    out: dict[str, float] = {}
    todo = [[COVER, h] for h in has]  # each toxic text is to be explained so many times
    while todo:
        seen = Counter(i for _, h in todo for i in h if i not in said)
        if not seen:
            break
        best = max(seen, key=lambda i: (seen[i] - 3 * grow * n0[names[i]], len(names[i]), names[i]))
        if seen[best] < least:
            break
        f = names[best]
        said.add(best)
        if f[-1] == "-":  # a beginning stands for all that begins with it, or that it begins with
            said.update(i for i, x in enumerate(names) if x.startswith(f[:-1]) or x[-1] == "-" and f.startswith(x[:-1]))
        else:
            said.update(index[x] for x in features(f)[1:] if x in index)
        out[f] = (n1[f] + 0.2) / (n1[f] + grow * n0[f] + 0.6)
        for x in todo:
            x[0] -= best in x[1]
        todo = [x for x in todo if x[0] > 0]
    left = [h for h in has if not any(index[f] in h for f in out)]
    base = (len(left) + 0.5) / (len(left) + grow * sizes[0] + 5)
    return out, min(0.4, base)


def score(docs: DataFrame, weights: dict[str, float], base: float, language: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``toxicity`` (0 to 1) added; null and empty texts get ``base``.

    The score is the noisy-or of the distinct features that the restored text has.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((language, weights, base))
    from pyspark.sql.types import DoubleType, StructField, StructType

    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("toxicity", *(f"toxicity_{i}" for i in range(len(docs.columns)))) if n not in taken)
    names, at = docs.columns, place(docs, text_col)
    docs = numbered(docs)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_name, p, none = shared.value
        reader = Reader(model(model_name), lambda words: tuple(f for w in words for f in features(w) if f in p))
        for b in batches:
            scores = []
            for text in b.column(at).to_pylist():
                clean = 1 - none
                for f in set().union(*reader.values(text or "")):
                    clean *= 1 - p[f]
                scores.append(1 - clean)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "score"])

    return docs.mapInArrow(run, schema).toDF(*names, name)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    prepare(docs.sparkSession)
    language = language_model(docs)
    weights, base = fit(docs, labels, language)
    s = score(narrow(docs, doc_id="doc_id", text="text"), weights, base, language)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return s.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with their columns."""
    prepare(docs.sparkSession)
    language = language_model(docs)
    weights, base = fit(docs, labels, language)
    s = score(docs, weights, base, language)
    return s.where(F.col(s.columns[-1]) < threshold).drop(s.columns[-1])
