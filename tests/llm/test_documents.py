import collections
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from haulspark.llm import html_extract, license, line_dedup, ngram_join, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, host string, grams int, m string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", s, None if t is None else len(t), "clash", "clash", 1, "clash") for i, t, s in rows], SCHEMA)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))


# ---- licences ----------------------------------------------------------------------------------------------

LICENSED = [
    "Released under the GNU General Public License, and the gnu-general public/LICENSE.", "apache license apache license", "MIT\nLicense", "cc by", "cc-by-sa 4.0", "license mit", None, "", "mit licensed", "é mit license",
    "gnu general public gnu general public license", "all rights reserved", "x " * 40_000 + "Apache License", "general public license", "gnu gnu general public license license",
]


NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this FONT and associated documentation files (the \"Font\"), to deal in the Font without restriction, including",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero Public License as published by the Free Software Foundation",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this except in compliance with the License.",
    "the of and in to a 1 0 is by use", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
]


def test_license_scan_equals_brute_force(spark):
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    texts = LICENSED + NOTICES
    got = {r["doc_id"]: r for r in license.license_scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        starts, labels, own, spans = [], set(), set(), set()
        for n, (phrase, label) in enumerate([*license.BASE, *license.MORE]):
            p = phrase.split()
            hits = [k for k in range(len(words) - len(p) + 1) if all(a in ("_", b) for a, b in zip(p, words[k : k + len(p)], strict=True))]
            labels |= {label} if hits else set()
            spans |= {(label, k, len(p)) for k in hits}
            if n < len(license.BASE):
                starts += hits
                own |= {label} if hits else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(starts), ",".join(sorted(own)))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["labels"] == ",".join(sorted(labels)) and {tuple(s) for s in r["spans"]} == spans
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert got[4]["labels"] == "cc-by,cc-by-sa" and got[11]["labels"] == "proprietary"
    at = len(LICENSED)
    assert [got[at + k]["labels"] for k in range(6)] == ["mit,mit-style", "gpl", "apache", "apache", "", "cc-by,cc-by-sa"]
    assert license.license_scan(docs(spark, [])).count() == 0
    assert license.license_scan(docs(spark, [(1, "mit license", "s"), (1, "mit license", "s"), (None, "cc by", None)])).count() == 3


def test_license_scan_of_a_text_of_licence_words_is_linear(spark):
    import time

    start = time.time()
    r = license.license_scan(docs(spark, [(1, "mit license " * 90_000, "s"), (2, "the gnu general public license " * 30_000, "s")])).orderBy("doc_id").collect()
    assert [x["n_base"] for x in r] == [90_000, 30_000] and time.time() - start < 60


# ---- line dedup --------------------------------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(1)
    common = ["menu home", "  cookies ", "subscribe", ""]
    rows = []
    for i in range(240):
        host = r.choice(["a", "a", "a", "b", "c", None])
        lines = [sentence(r, 6) for _ in range(r.randint(0, 5))] + [c for c in common if r.random() < {"a": 0.5, "b": 0.04, "c": 0.9, None: 0.3}[host]]
        r.shuffle(lines)
        rows.append((i % 230, "\n".join(lines), host))
    rows += [(500, None, "a"), (501, "", "a"), (502, "subscribe", "lonely"), (503, "\n".join(["cookies"] * 50), "c")]
    pages, seen = collections.Counter(), collections.Counter()
    for _, t, h in rows:
        pages[h] += 1
        seen.update({(h, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    want = sorted((i, "\n".join(x for x in (t or "").split("\n") if not (seen[h, x.strip(" ")] >= 5 and seen[h, x.strip(" ")] > 0.1 * pages[h]))) for i, t, h in rows)
    out = line_dedup.dedup_lines(docs(spark, rows))
    assert out.columns[:9] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert out.agg(F.sum(F.col("n_lines") - F.col("n_dropped") - F.size(F.split("text", "\n")))).first()[0] <= 0
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_operators_take_columns_that_differ_in_case(spark):
    from haulspark.llm import bpe, packing, records

    rows = [(1, "mit license here", "a"), (2, None, None), (3, "", "a"), (3, "mit license here", "a")]
    d = docs(spark, rows).drop("key").selectExpr("*", "1 AS TEXT", "2 AS Doc_Id", "'z' AS Source", "map(1, 2) AS `a.b`", "1 AS Toxicity")
    y = spark.createDataFrame([(1, 1, 1), (2, 0, 5)], "doc_id bigint, toxic int, Toxic int")
    assert license.license_scan(d).agg(F.sum("n_base")).first()[0] == 2
    assert line_dedup.dedup_lines(d).columns[: len(d.columns)] == d.columns and line_dedup.dedup_lines(d).count() == 4
    kept = ngram_join.one_of_each(d)
    assert kept.columns == d.columns and kept.count() == 3 and ngram_join.jaccard_join(d).count() == 4
    assert toxicity.reject_toxic(d, y).columns == d.columns and toxicity.toxic_scores(d, y).count() == 4
    public = pytest.importorskip("public_tokenizers")
    assert packing.pack(d, public.path("word_bpe_49k.json")).agg(F.sum("length")).first()[0] > 4
    assert bpe.encode(d, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == 4
    assert records.tokens_round_trip(d, public.path("word_bpe_49k.json"), 2).count() == 4


def test_line_dedup_trims_white_space_and_takes_long_texts(spark):
    rows = [(i, f"own {i}\nmenu{end}\n" + "long line of words " * 50_000 * (i == 3), "a") for i, end in enumerate(["", "\r", "\t", " ", "\u3000", "\xa0 "])]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == {i: t.split("\n")[0] + "\n" + t.split("\n")[2] for i, t, _ in rows}


def test_line_dedup_of_many_boilerplate_lines_is_linear(spark):
    import time

    start = time.time()
    shared = "\n".join(f"menu {i}" for i in range(100_000))
    rows = [(i, f"own {i}\n{shared}\nmenu 5\n\nlast {i}", "a") for i in range(6)]
    got = {r["doc_id"]: tuple(r) for r in line_dedup.dedup_lines(docs(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()}
    assert got == {i: (i, f"own {i}\n\nlast {i}", 100_004, 100_001) for i in range(6)}
    assert time.time() - start < 60


# ---- near duplicates ---------------------------------------------------------------------------------------


def shingles(t):
    w = [x for x in (y.strip(ngram_join.EDGES) for y in (t or "").lower().split()) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def edit(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = sentence(r, 1)
    return " ".join(w)


def corpus(r):
    rows = [(i, sentence(r, r.randint(0, 120)), "s") for i in range(60)]
    for base in range(6):
        text = sentence(r, 100)
        rows += [(1000 + 50 * base + k, edit(r, text, r.randint(0, 4)), "s") for k in range(25)]
    rows += [(2000, None, "s"), (2001, "", "s"), (2002, "...", "s"), (None, sentence(r, 3), "s"), (2003, "two words", "s"), (2004, "Two words!", "s"), (2005, "two words more", "s")]
    rows += [(2100 + k, rows[70][1], "s") for k in range(4)] + [(2100, rows[70][1], "s")]
    return rows


def brute(rows, threshold=0.8):
    sets, parent, n = [shingles(t) for _, t, _ in rows], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, least.get(find(i)), n[i]) for i, (d, _, _) in enumerate(rows)], [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [4096, 6])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)  # small blocks: groups meet block by block
    rows = corpus(random.Random(2))
    got = sorted(map(tuple, ngram_join.jaccard_join(docs(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows)[0], key=str)


@pytest.mark.parametrize("block", [4096, 100])
def test_boilerplate_alone_makes_no_candidates(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    common = " ".join(word() for _ in range(120))
    rows = [(i, f"{' '.join(word() for _ in range(35))} {common} {' '.join(word() for _ in range(35))}", "s") for i in range(600)]
    rows += [(1000 + k, edit(r, rows[k % 7][1], 2), "s") for k in range(20)]
    got = sorted(map(tuple, ngram_join.jaccard_join(docs(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows)[0], key=str)
    sets = ngram_join.grams([t for _, t, _ in rows], ngram_join._Words(), 5)
    sizes = collections.Counter(ngram_join.teams(sets, 0.8).tolist()).values()
    assert sum(n * (n - 1) for n in sizes) < 0.01 * len(rows) ** 2


@pytest.mark.parametrize("seed", range(5))
def test_teams_hold_all_links(seed):
    r = random.Random(seed)
    texts = [t for _, t, _ in corpus(r) if t]
    texts += [" ".join(["a", "b"] * r.randint(1, 9)) for _ in range(20)] + [f"{texts[9]} {sentence(r, r.randint(1, 30))}" for _ in range(20)]
    sets = [s for s in ngram_join.grams(texts, ngram_join._Words(), 5) if len(s)]
    team = ngram_join.teams(sets, 0.8)
    for i, a in enumerate(map(set, map(list, sets))):
        for j in range(i):
            if len(a & set(sets[j])) >= 0.8 * len(a | set(sets[j])) - 1e-9:
                assert team[i] == team[j]


def test_repeated_rows_without_words_all_stay(spark):
    rows = [(1, "...", "a")] * 2500 + [(1, None, "a")] * 3 + [(1, "", "a"), (1, "", "b"), (None, "", None), (None, "", None), (2, "x y", "b"), (2, "x y", "a"), (2, "x y", "a")]
    got = ngram_join.one_of_each(docs(spark, rows)).groupBy("doc_id", "text", "source").count().collect()
    assert {tuple(x)[:3]: x["count"] for x in got} == {(1, "...", "a"): 2500, (1, None, "a"): 3, (1, "", "a"): 1, (1, "", "b"): 1, (None, "", None): 2, (2, "x y", "a"): 1}


def test_one_of_each_class_stays(spark):
    rows = corpus(random.Random(3))
    _, classes = brute(rows)
    kept = ngram_join.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want = []
    for c in set(classes):
        members = [rows[i] for i in range(len(rows)) if classes[i] == c]
        want.append(min((d is None, d or 0) for d, _, _ in members))
    assert sorted((d is None, d or 0) for d in ids) == sorted(want)
    assert ngram_join.one_of_each(docs(spark, [])).count() == 0 and ngram_join.jaccard_join(docs(spark, [])).count() == 0
    assert ngram_join.one_of_each(docs(spark, [(1, "", "a"), (2, "", "a"), (1, None, "b")])).count() == 3


def test_near_copies_with_columns_of_any_kind(spark):
    rows = corpus(random.Random(6))[:80]
    d = docs(spark, rows).selectExpr("*", "map('a', doc_id) AS lookup", "array(named_struct('x', doc_id)) AS things", "cast(text AS binary) AS raw", "1 AS Grams2")
    kept = ngram_join.one_of_each(d.unionByName(d))
    assert kept.columns == d.columns and kept.count() == ngram_join.one_of_each(docs(spark, rows)).count()


def test_forests_connect_what_edges_connect():
    import numpy as np

    r = np.random.default_rng(3)
    for n, m in ((1, 0), (10, 5), (200, 150), (300, 900)):
        u, v = r.integers(0, n, m), r.integers(0, n, m)
        nodes, roots, a, b = ngram_join._forest(u, v)
        parent = {x: x for x in nodes.tolist()}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            x, y = sorted((find(x), find(y)))
            parent[y] = x
        assert [find(x) for x in nodes.tolist()] == roots.tolist()
        assert len(a) == len(nodes) - len(set(roots.tolist())) and dict(zip(a.tolist(), b.tolist(), strict=True)) == {x: find(x) for x in parent if find(x) != x}


def test_matrix_products_equal_intersections():
    import numpy as np

    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(300) < 0.97], r.integers(0, 2**63, 3).astype(np.uint64)])) for _ in range(90)]
    got = ngram_join.links(sets, None, 0.8, 1e-6)
    for i in range(90):
        for j in range(i + 1, 90):
            n = len(np.intersect1d(sets[i], sets[j]))
            assert got[i, j] == (n >= 0.8 * (len(sets[i]) + len(sets[j]) - n))
    across = ngram_join.links(sets[:40], sets[40:], 0.8, 1e-6)
    assert (across == got[:40, 40:]).all()


def test_pruning_keeps_what_may_reach_the_threshold():
    for n in (16, 32, 64):
        m = ngram_join.least_matches(n, 0.8, 1e-6)
        p = sum(__import__("math").comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert p < 1e-5 and m > n // 5


# ---- toxicity ----------------------------------------------------------------------------------------------

RUDE = ["blorgface", "snarkwit", "vexmutt"]


def toxic_corpus(r, n=400):
    rows, labels = [], []
    for i in range(n):
        words = sentence(r, 40).split()
        bad = i % 4 == 0
        if bad:
            for w in r.sample(RUDE, 2):
                words.insert(r.randrange(len(words)), w)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad), "clash"))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus(random.Random(5))
    hidden = [(1000, "they said bl0rgf4ce to me", 1), (1001, "you s n a r k w i t there", 1), (1002, "what a vexxxmutt", 1), (1003, "nothing to see here", 0), (1004, None, 0), (1005, "", 0), (1006, "$narkwit", 1), (1007, "x " * 50_000 + "blorgface", 1)]
    d = docs(spark, rows + [(i, t, "s") for i, t, _ in hidden] + [(None, "blorgface", "s"), (3, "vexmutt", "s")])
    y = spark.createDataFrame([*labels, (None, 1, 1, "x"), (5000, 1, None, "x")], "doc_id bigint, quality int, toxic int, text string")
    got = collections.defaultdict(list)
    for r in toxicity.toxic_scores(d, y).collect():
        got[r["doc_id"]].append(r)
    for i, _, t, _ in labels:
        if i != 3 and got[i][0]["held_out"]:
            assert got[i][0]["predicted"] == t
    for i, text, t in hidden:
        assert got[i][0]["predicted"] == t, text
    assert got[None][0]["predicted"] == 1 and sorted(r["predicted"] for r in got[3]) == [0, 1]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for rs in got.values() for r in rs)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, rs in got.items() if i is not None for r in rs)
    named = toxicity.reject_toxic(d.selectExpr("*", "1 AS Toxicity", "map('a', 1) AS m2"), y)
    assert named.columns[-2:] == ["Toxicity", "m2"] and named.where("doc_id = 1000").count() == 0
    kept = toxicity.reject_toxic(d, y)
    assert kept.columns == d.columns and kept.where("doc_id = 1003").count() == 1 and kept.where("doc_id = 1000").count() == 0


def test_toxicity_without_labels(spark):
    d = docs(spark, [(1, "some text", "s")])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [0 <= r["score"] <= 1 for r in toxicity.toxic_scores(d, none).collect()] == [True]
    assert toxicity.toxic_scores(docs(spark, []), none).count() == 0


def test_viterbi_is_the_best_path():
    language = toxicity.Language({"  c": 5, " ca": 5, "cat": 5, "at ": 5, "t  ": 5, "  d": 2, " do": 2, "dog": 2})
    edges = toxicity.lattice("c@t")
    best = max((sum(c for _, _, c in path) + sum(language.score(("  " + text)[k : k + 2], x) for k, x in enumerate(text)) + language.score(("  " + text)[-2:], " "), text) for path in [(a, b, c) for a in edges[0] for b in edges[1] for c in edges[2]] for text in ["".join(x[1] for x in path)])
    assert toxicity.viterbi(edges, language) == best[1] == "cat"


# ---- web pages ---------------------------------------------------------------------------------------------

PAGES = {
    '<html><head><title>T</title></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy this now, please do.</div><article><h1>Head &amp; line</h1><p><b>One\n  two.<br><p>Three&eacute; &lt;4&gt;</p><script>var a="</p>";</script></article><footer>&copy; me</footer></body></html>': "Head & line\nOne two.\nThreeé <4>",
    '<main><h1>Title</h1><p>Para one is long enough to be seen as text.<p>Second<br>line</main><section class="comments"><h3>Comments</h3><p>I think this is a great article and I agree with it.</p></section><form>Sign up</form>': "Title\nPara one is long enough to be seen as text.\nSecond line",
    '<div class="cookie-banner"><p>We use cookies to improve your visit.</p></div><div class="content"><h2>News</h2><div>Some text in a div, rather long and without markup of any kind.</div><aside class="related">More stories</aside></div><div id="footer">Foot</div>': "News\nSome text in a div, rather long and without markup of any kind.",
    "": "", "plain text only": "plain text only", "<p>Just a para.": "Just a para.", '<article><p>A kept one.</p><div class="share">Share this</div><!-- <p>no</p> --><p hidden>secret</p><p>B kept.</p></article>': "A kept one.\nB kept.",
}


def test_main_text(spark):
    for page, want in PAGES.items():
        assert html_extract.main_text(page)[0] == want
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(PAGES)] + [(99, None, None), (None, "u", "<p>x y z.</p>"), (98, "u", "<div>" * 3000 + "<p>deep text.</p>"), (97, "u", "<article><p>" + "long text. " * 50_000)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(d).collect()}
    assert [got[i]["text"] for i in range(len(PAGES))] == list(PAGES.values())
    assert got[99]["text"] == "" and got[99]["n_chars"] == 0 and got[97]["n_chars"] == 50_000 * 11 - 1
    assert html_extract.extract(d.limit(0)).count() == 0


def test_hostile_pages_take_linear_time():
    import time

    start = time.time()
    for page in ('<a "' * 200_000, "</p>" * 200_000, "<!" * 300_000, "<button>" * 100_000, "<div>" * 20_000 + "<li></li>" * 50_000, "<div>" * 20_000 + "</p></div>" * 20_000, "<svg><p>" * 50_000, "<" * 500_000, "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 100_000, "<dl><dd>" + "<div>" * 20_000 + "<dt>x</dt>" * 50_000, "<ul><li>" * 20_000):
        html_extract.main_text(page)
    assert time.time() - start < 60
    assert html_extract.main_text('<article><p>Less: 1 < 2, said <a title="x > y">one</a> of them.</p></article>')[0] == "Less: 1 < 2, said one of them."
    assert html_extract.main_text("<article><p>Mass is <math><mi>m</mi><annotation>\\\\m</annotation></math>, as it was known for long.</p></article>")[0] == "Mass is m, as it was known for long."
    assert html_extract.main_text('<article><p class="x>Broken quotes here.</p><p>And one more.</p></article>')[0].endswith("And one more.")


def test_marginals_equal_enumeration():
    m = html_extract.model()
    root = html_extract.parse('<div class="x"><p>Some words here.</p><ul><li><a>a</a></li></ul></div><footer>foot</footer>')
    nodes, order = [(root, 0, None)], 0
    while order < len(nodes):
        x, d, _ = nodes[order]
        nodes += [(c, d + 1, x) for c in x.children]
        order += 1
    import itertools
    import math

    weight, total = collections.Counter(), 0.0
    for states in itertools.product([True, False], repeat=len(nodes)):
        s = {id(n): y for (n, _, _), y in zip(nodes, states, strict=True)}
        w = 0.0
        for n, d, p in nodes:
            if s[id(n)]:
                w += 8.0 if p is None else m.potential(n, d)
            if p is not None:
                w += m.tie[s[id(p)], s[id(n)]]
        w = math.exp(w)
        total += w
        for k, y in s.items():
            weight[k] += w * y
    got = m.marginals(root)
    for n, _, _ in nodes:
        assert got[id(n)] == pytest.approx(weight[id(n)] / total, abs=1e-9)


def test_held_out_pages_are_labelled_right():
    m, right, n = html_extract.model(), 0, 0
    for root, content in html_extract.training_pages(150, 99):
        p = m.marginals(root)
        stack = [root]
        while stack:
            x = stack.pop()
            if x.total:
                n += 1
                right += (p[id(x)] > 0.5) == (id(x) in content)
            stack += x.children
    assert right / n > 0.95


def test_long_disguises_are_restored_whole():
    words = "nobody wants stupid worthless people".split()
    counts: dict[str, float] = {}
    for w in words:
        for k in range(len(w) + 1):
            g = f"  {w} "[k : k + 3]
            counts[g] = counts.get(g, 0) + 20
    language = toxicity.Language(counts)
    assert "stupid" in toxicity.words_of("st" + 45 * "u" + "pid", language)
    assert "stupid" in toxicity.words_of("s" + 30 * "." + "tu" + 3000 * "." + "p" + 30 * "1" + "d", language)
    for gap in (" - ", " ", "."):
        text = "  ".join(gap.join(w) for w in words) if gap == " " else gap.join("".join(words))
        assert {"stupid", "worthless"} <= toxicity.spaced_words(text, language), gap
    assert "stupid" in toxicity.spaced_words("s t " + 40 * "u " + "p i d", language)


def test_language_model_counts_everything(spark):
    r = random.Random(3)
    texts = ["the cat sat " * 9 + "".join(chr(0x4E00 + r.randrange(6000)) for _ in range(700)) for _ in range(400)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    counts, words = {}, {}
    for t in texts:
        for w in t.lower().split():
            words[w] = words.get(w, 0) + 1
    for w, n in words.items():
        for k in range(len(w) + 2):
            g = ("  " + w + "  ")[k : k + 3]
            counts[g] = counts.get(g, 0) + n
    assert len(counts) > 200_000
    want = toxicity.Language(counts)
    for parts in (1, 7):
        got = toxicity.model(toxicity.language_model(d.repartition(parts)))
        assert len(got.tables[0][0]) == len(counts) and got.total == pytest.approx(want.total)
        for g in [*r.sample(sorted(counts), 300), "zzz", " th", "\U0010ffff  "]:
            assert got.sums(g) == pytest.approx(want.sums(g)) and got.score(g[:2], g[2]) == pytest.approx(want.score(g[:2], g[2]))
