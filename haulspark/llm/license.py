"""Licence scan over a positional index of rare words, in DataFrame functions only.

A template is a licence phrase or notice: words at positions, of which those of its mandatory key phrases must stand
and the others may differ.  A document keeps the places of the templates' words.  Of a template whose mandatory words
a document has, the places of the word with the highest inverse document frequency are looked up and shifted by its
position in the template, which is where the template may start; they are intersected with the shifted places of the
next rarest, until all words of the mandatory phrases are verified.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulspark.llm.common import checkpoint, checkpoint_dir, narrow

#: The phrases and labels that every scan has.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Mandatory key phrases of more licences, and notices in which "_" stands for a word that may differ.
MORE = (
    ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"), ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"), ("boost software license", "boost"), ("bsd license", "bsd"), ("isc license", "isc"),
    ("redistribution and use in source and binary forms", "bsd"), ("permission is hereby granted free of charge", "mit-style"),
    ("creative commons attribution", "cc-by"), ("cc by sa", "cc-by-sa"), ("cc by nc", "cc-by-nc"), ("cc by nd", "cc-by-nd"), ("cc0 1 0", "cc0"),
    ("unencumbered software released into the public domain", "unlicense"), ("spdx license identifier", "spdx"), ("all rights reserved", "proprietary"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this _ and associated documentation files the _ to deal in the _ without restriction", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify _ or distribute this _ for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under the apache license version _ 0 the license you may not use this _ except in compliance with the license", "apache"),
    ("free software you can redistribute it and or modify it under the terms of the gnu _ public license as published by the free software foundation", "gpl"),
    ("free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("is subject to the terms of the mozilla public license v _ 0", "mpl"),
    ("provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "zlib"),
    ("licensed under a creative commons attribution _ 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike _ 0 international license", "cc-by-sa"),
)
#: Words too frequent to say anything: a document that has no other word of a template has no template.
FREQUENT = frozenset("0 1 a all and any are as be by copy for free in into is it no not of or that the this to use v will with you".split())
#: Words of A-Z, a-z (lower-cased before), digits and everything beyond ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<label:string,start:bigint,length:int,base:boolean,weight:double>>"
TEMPLATES = "array<struct<label:string,base:boolean,length:int,weight:double,kinds:array<string>,words:array<struct<j:int,w:string>>>>"


def _mandatory(template: str) -> list[tuple[int, str]]:
    return [(j, w) for j, w in enumerate(template.split()) if w != "_"]


def _doc_places(docs: DataFrame, text_col: str, vocabulary: list[str]) -> DataFrame:
    """Adds n_words, has (the distinct words of the vocabulary in the text) and places: (w, i) for each place of such
    a word, null unless the text has an infrequent one."""
    listed = lambda words: F.array(*[F.lit(w) for w in words])
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    out = docs.withColumn("_words", words).withColumn("has", F.array_intersect("_words", listed(vocabulary)))
    found = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    places = F.when(F.arrays_overlap("has", listed(w for w in vocabulary if w not in FREQUENT)), found)
    return out.select(*docs.columns, F.size("_words").cast("bigint").alias("n_words"), "has", places.alias("places"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, more: tuple = MORE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document.

    ``spans`` lists (label, start, length) of every place of every template.  ``score`` is 0 without one; else it
    rises with the rarity of the mandatory words found.  A null text counts as empty; null ids, ties and repeated rows
    are kept row by row; an empty table gives no rows; a text of any length is read whole, in linear time.
    A template begins and ends with a mandatory word and has one that is not in FREQUENT.
    """
    checkpoint_dir(docs.sparkSession)
    templates = [(p, label, k < len(base)) for k, (p, label) in enumerate([*base, *more])]
    vocabulary = sorted({w for p, _, _ in templates for _, w in _mandatory(p)})
    d = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    d = checkpoint(_doc_places(d, "text", vocabulary).drop("text"))
    # as many rows as the templates have words
    n, df = d.count(), {r["w"]: r["count"] for r in d.select(F.explode("has").alias("w")).groupBy("w").count().collect()}
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1e-6 for w in vocabulary}

    def row(template: str, label: str, of_base: bool) -> dict:
        rarest = sorted(_mandatory(template), key=lambda x: (-idf[x[1]], x))
        words = [{"j": j, "w": w} for j, w in rarest]
        return {"label": label, "base": of_base, "length": max(j for j, _ in rarest) + 1, "weight": sum(idf[w] for _, w in rarest), "kinds": sorted({w for _, w in rarest}), "words": words}

    index = F.from_json(F.lit(json.dumps([row(*t) for t in templates])), TEMPLATES)
    shifted = lambda word: F.transform(F.filter("places", lambda x: x["w"] == word["w"]), lambda x: x["i"] - word["j"])
    # where a template starts: the places of its words, the rarest first, each less its position, have these in common
    starts = lambda t: F.aggregate(F.slice(t["words"], 2, 1000), shifted(t["words"][0]), lambda found, word: F.array_intersect(found, shifted(word)))
    about = lambda t, s: F.struct(t["label"].alias("label"), s.cast("bigint").alias("start"), t["length"].alias("length"), t["base"].alias("base"), t["weight"].alias("weight"))
    may = F.filter(index, lambda t: F.size(F.array_except(t["kinds"], "has")) == 0)
    spans = F.flatten(F.transform(may, lambda t: F.transform(starts(t), lambda s: about(t, s))))
    d = d.withColumn("spans", F.when(F.col("places").isNull(), F.array().cast(SPANS)).otherwise(spans))
    own = F.filter("spans", lambda x: x["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    weight = F.array_max(F.transform("spans", lambda x: x["weight"]))
    return d.select(
        "doc_id", "n_words", F.size(own).cast("bigint").alias("n_base"),
        F.array_min(F.transform(own, lambda x: x["start"])).alias("first_word"), F.array_max(F.transform(own, lambda x: x["start"])).alias("last_word"),
        labels(own).alias("base_labels"), labels("spans").alias("labels"), F.round(F.coalesce(1 - F.exp(-weight), F.lit(0.0)), 9).alias("score"),
        F.transform("spans", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["length"].alias("length"))).alias("spans"),
    )


def sql(base: tuple = BASE, more: tuple = MORE) -> str:
    """DuckDB's form of the query over ``documents``: every template sought at every place, scores to nine digits."""
    quoted = lambda ws: "[" + ", ".join("NULL" if w == "_" else f"'{w}'" for w in ws) + "]"
    templates = ", ".join(f"({k}, {quoted(p.split())}, '{label}', {str(k < len(base)).lower()})" for k, (p, label) in enumerate([*base, *more]))
    vocabulary = quoted(sorted({w for p, _ in [*base, *more] for _, w in _mandatory(p)}))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
v AS (SELECT unnest({vocabulary}) AS word),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + count(r))) + 1e-6::DOUBLE AS x FROM v LEFT JOIN d ON list_contains(w, word) GROUP BY word),
t AS (SELECT * FROM (VALUES {templates}) t(k, p, label, base)),
g AS (SELECT k, sum(x) AS weight FROM (SELECT k, unnest(p) AS word FROM t) u JOIN idf USING (word) GROUP BY k),
h AS (SELECT r, label, base, weight, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = p[1] AND w[i + 1] IS NOT DISTINCT FROM coalesce(p[2], w[i + 1]) AND i + len(p) - 1 <= len(w)
             AND len(list_filter(range(1, len(p) + 1), lambda j: p[j] IS NOT NULL AND w[i + j - 1] <> p[j])) = 0)) - 1 AS s FROM d, t JOIN g USING (k) WHERE list_contains(w, p[1])),
a AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels,
      array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(weight) AS weight FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(1 - exp(-weight), 0.0), 9) AS score FROM d LEFT JOIN a USING (r)"""
