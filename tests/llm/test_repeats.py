"""Runs of words, spelling variants and repeated byte strings against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulspark.llm import queries, repeats, spelling, word_runs
from haulspark.llm.common import read

SCHEMA = "doc_id bigint, text string, lang string, DOC_ID2 string, key string, gram int, word string, n string"
SMALL = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "clash", "clash", 1, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# ---- 11: runs of words ------------------------------------------------------------------------------------


def all_runs(s, least, repeats_):
    n, out = len(s), []
    for q in range(1, n // repeats_ + 1):
        i = 0
        while i + q < n:
            if s[i] == s[i + q]:
                j = i
                while j + q < n and s[j] == s[j + q]:
                    j += 1
                size = j - i + q
                if size >= max(least, repeats_ * q) and not any(all(s[x] == s[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                    out.append((i, size, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = all_runs(w, 6, 4)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines.encode()), sha(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()))


def test_runs_equal_brute_force():
    r = random.Random(11)
    for _ in range(1500):
        n, letters = r.randint(0, 40), r.choice([1, 2, 3, 5])
        s = [r.randrange(letters) for _ in range(n)]
        if n > 5 and r.random() < 0.5:
            p, x = r.randint(1, 6), r.randrange(n)
            s = [v if i < x else s[min(x + (i - x) % p, n - 1)] for i, v in enumerate(s)]
        for least, times in ((6, 4), (2, 2), (4, 3)):
            assert word_runs.runs(s, least, times) == all_runs(s, least, times), (s, least, times)
        words = [b"%d" % v for v in s]
        assert word_runs.found_runs([words, [], words]) == [all_runs(s, 6, 4), [], all_runs(s, 6, 4)]


def test_squares_are_last_occurrences():
    s = [0, 1, 0, 1, 0, 0, 1, 0, 1, 1]
    for end, distance, size in word_runs.squares(*word_runs.automaton(s)):
        piece = s[end - size + 1 : end + 1]
        ends = [e for e in range(size - 1, end) if s[e - size + 1 : e + 1] == piece]
        assert max(ends) == end - distance
        longer = s[end - size : end + 1] if end - size >= 0 else None
        assert longer is None or not any(s[e - size : e + 1] == longer for e in range(end - distance, end) if e - size >= 0)


def test_word_runs_query(spark):
    r = random.Random(3)
    texts = [None, "", "  \t\n", "a", "a a a a a a", "a a a a a", "a b a b a b a b", "a b a b a b a", "x a b a b a b a b y y y y y y y", "é\x0bé\x0cé é\r\né\té z", "           ", "\x1c \x1c \x1c \x1c \x1c \x1c"]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "b b b b b b c"), (None, None), (4, "a a a a a a"), (-7, "q r s " * 9)]
    got = word_runs.digests(docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((run_row(*x) for x in rows), key=repr)
    assert word_runs.digests(docs(spark, rows).limit(0)).count() == 0


def test_long_repetitive_text_is_fast():
    for s in ([0] * 60_000, list(range(300)) * 200):
        assert word_runs.runs(s) == [(0, 60_000, 1 if s[1] == 0 else 300)]


def test_word_runs_of_the_table(spark):
    want = sorted(run_row(r["doc_id"], r["text"]) for r in read(spark, SMALL, "documents").select("doc_id", F.substring("text", 1, 2500).alias("text")).collect())
    got = word_runs.digests(read(spark, SMALL, "documents").withColumn("text", F.substring("text", 1, 2500)))
    assert sorted(map(tuple, got.collect())) == want


# ---- 12: spelling variants -------------------------------------------------------------------------------


def forms(rows, least=7, occurs=2, ratio=10, every=31):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    count = {w: n for w, n in count.items() if len(w) >= least and n >= occurs}
    near = {w: [] for w in count}
    by = {}
    for w in count:
        for k in {("d", w[:i] + w[i + 1 :]) for i in range(len(w))} | {("d", w)}:
            by.setdefault(k, []).append(w)
    for group in by.values():
        for a in group:
            for b in group:
                if a != b and b not in near[a] and one_edit(a, b):
                    near[a].append(b)
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= ratio * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def misspelt():
    r = random.Random(12)
    base = ["aaaaaaab", "spelling", "variants", "ÉCOLEÉÿ×÷", "aaaaaaaa", "transport" * 8, "Überholung", "aaaaaaa"]
    out = []
    for _ in range(400):
        w = r.choice(base)
        if r.random() < 0.4:
            i, kind = r.randrange(len(w)), r.random()
            w = w[:i] + w[i + 1 :] if kind < 0.4 else w[:i] + r.choice("abyzßÿ") + w[i + (kind < 0.7) :]
        out.append(w)
    for n, w in ((1, "chainaaa"), (21, "chainaab"), (220, "chainabb"), (2300, "chainbbb")):
        out += [w] * n
    rows = [(i, " ".join(r.choice([w, w.upper()]) for w in out[i::40]) + ". short, 7letters7") for i in range(40)]
    return [*rows, (None, "spelling Spelling"), (50, None), (51, ""), (3, rows[3][1]), (52, "x" * 5000 + " " + "x" * 5000), (53, "x" * 4999 + "y " + "x" * 4999 + "y")]


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 48])
def test_spelling_forms_equal_brute_force(spark, misspelt, filter_bytes):
    got = spelling.spelling_forms(docs(spark, misspelt), filter_bytes=filter_bytes).collect()
    assert sorted(map(tuple, got), key=lambda x: x[0]) == forms(misspelt)


def test_spelling_chain_has_one_root(spark, misspelt):
    got = {r["word"]: r for r in spelling.spelling_forms(docs(spark, misspelt), every=10**12).collect()}
    assert got["chainaab"]["form"] == "chainabb" and got["chainaab"]["root"] == "chainbbb" and "chainaaa" not in got


def test_spelling_hashes():
    words = ["spelling", "aabbccdd", "ÿÿÿÿÿÿÿÿ"]
    found = {}
    for shorter, i, letters, h in spelling.edits(spelling.codes(words, 8)):
        for j, w in enumerate(words):
            for k, x in enumerate(h[j].tolist()):
                found[w[:i] + ("" if shorter else chr(letters[k])) + w[i + 1 :]] = x
    keys = list(found)
    assert spelling.word_hashes(keys).tolist() == [found[k] for k in keys]


def test_spelling_rounds_hold_their_bound():
    plan = spelling.rounds({7: 1000, 8: 1, 9: 50}, 512)
    assert all(sum(b - a for _, a, b in p.values()) * 8 <= 512 for p in plan)
    for s, n in ((7, 250), (8, 1), (9, 13)):
        spans = sorted((a, b) for p in plan for k, (whole, a, b) in p.items() if k == s)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_spelling_of_the_table_and_of_nothing(spark):
    d = read(spark, SMALL, "documents")
    got = queries.op12_spelling_variants(spark, SMALL).collect()
    assert sorted(map(tuple, got), key=lambda x: x[0]) == forms([(r["doc_id"], r["text"]) for r in d.collect()])
    assert spelling.spelling_forms(d.limit(0)).count() == 0


# ---- 13: repeated strings --------------------------------------------------------------------------------


def removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return sorted(out, key=repr)


def test_expansion_and_contexts_equal_brute_force():
    r = random.Random(13)
    for _ in range(1500):
        length, letters = r.choice([1, 2, 3, 5, 9, 17]), r.choice([1, 2, 3])
        texts = [bytes(r.randrange(letters) + 97 for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 6))]
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in repeats.repeated_starts(texts, length)] == want
        windows, grams = Counter(), {}
        for t, lo, hi, gram in repeats.contexts(texts, length):
            for s in range(lo, hi - length + 1):
                windows[t, s] += 1
                grams.setdefault(texts[t][s : s + length], set()).add(gram)
        assert windows == Counter((t, i) for t, x in enumerate(texts) for i in range(len(x) - length + 1))
        assert all(len(g) == 1 for g in grams.values())


def test_common_prefixes_by_increasing_value():
    s = np.frombuffer(b"banana\xffbandana\xffananas\xff", np.uint8)
    sa, common = repeats.transform(s, 40)
    for least in (1, 2, 3, 4, 8, 12):
        bound = repeats.expansion(s, sa, common, least)
        for row in range(1, len(s)):
            a, b = bytes(s[sa[row - 1] :]), bytes(s[sa[row] :])
            shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if b"\xff" not in b[:least]:
                assert bound[row] == (shared < least)


@pytest.fixture(scope="module")
def repeating():
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passage, long = text(90), text(4000)
    rows = [(i, text(r.randint(0, 120)) + passage[: r.randint(30, 90)] + text(r.randint(0, 150))) for i in range(60)]
    rows += [(100, long), (101, long[:2000] + "!" + long[2000:]), (102, "z" * 300), (103, "ab" * 200), (104, None), (105, ""), (106, passage), (106, passage), (None, text(100)), (None, None), (107, long[500:540] * 3), (108, text(39))]
    return rows


@pytest.mark.parametrize("hot", [1000, 3])
def test_repeated_strings_equal_brute_force(spark, repeating, hot):
    got = repeats.digests(docs(spark, repeating), length=40, hot=hot, pack_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=repr) == removed(repeating, 40)


def test_repeated_strings_keep_what_is_left(spark, repeating):
    for r in repeats.without_repeats(docs(spark, repeating), 40).collect():
        at = [0, *(x for s in r["spans"] for x in s), len(r["text"])]
        assert b"".join(bytes(r["text"][a:b]) for a, b in zip(at[::2], at[1::2])) == bytes(r["kept"])


def test_repeated_strings_of_the_table_and_of_nothing(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SMALL, "documents").collect()]
    got = queries.op13_repeated_strings(spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=repr) == removed(rows, 400)
    assert repeats.digests(read(spark, SMALL, "documents").limit(0)).count() == 0
