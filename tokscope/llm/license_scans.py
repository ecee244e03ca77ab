"""License scans by an exact set-similarity join (operator 8), with DataFrame functions only.

Base: places where the words of a phrase stand one after the other (PHRASES).  Method: a block of a text matches a
license template if it contains at least THRESHOLD of the template's distinct words.  A block is a line, or a run of
words over the end of a line that is no longer than the notice (its words counted with repeats), so a wrapped notice is
compared whole.

1. Global order: one pass counts the texts that hold each template word; words are ordered by that count, the
   rarest first (ties by the word).  Only template words can count, so the order has as many rows as the
   templates have words, a bound set by the templates and not by the corpus.
2. Prefix filter: a template of n words that needs k of them shares one of its first n - k + 1 words with any
   text that has a block that matches.  The index of these prefix words is joined (broadcast, at most one row per
   template word) with each text's own words among them.
3. Length filter: a text with fewer than k template words is out.
4. Positional filter: with a match at place i of the template and place j of the text's words (both in global
   order), at most ``i + 1`` earlier and ``min(n - i, m - j) - 1`` later words can be shared.
5. The remaining texts and templates are counted exactly, block by block: a block's words are among its text's, so
   the filters lose none.
6. A run gives way to an overlapping one (of any template, inside a line too) with a higher containment and as many
   shared words: near-equal notices match together, and so do the remains of a notice that a run cuts.

``matches`` returns all pairs of lines and templates and the remaining runs over line ends; ``scan`` labels a block by
its best ones.

Result: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 if there is a base place,
else the best containment of a matched template, else 0).  Defined results: null or empty text has no words and
no labels; repeated rows give repeated rows; extra columns are ignored; templates without words match nothing.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Words of the contract, after lower-casing.
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
THRESHOLD = (4, 5)
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: (label, notice): public license notices.  Openings and further sentences of the longer ones may miss words; a short
#: notice has at most four distinct words, so that all of them are needed and the name of the license is among them.
TEMPLATES = [
    ("apache-2.0", "Apache License 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("bsd", "under the BSD License"),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "BSD 3-Clause License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl", "under the GPL"),
    ("gpl", "under the GPLv2"),
    ("gpl", "under the GPLv3"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"),
    ("isc", "under the ISC License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl", "the Mozilla Public License"),
    ("mpl-2.0", "the MPL 2.0"),
    ("mpl-2.0", "Mozilla License 2.0"),
    ("mpl-2.0", "Mozilla v2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), APART), "")


def _all_words(notice: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in notice.lower()).split()


def _words_of(notice: str) -> list[str]:
    """Distinct words of an ASCII notice."""
    return sorted(set(_all_words(notice)))


def needed(n: int, threshold: tuple[int, int]) -> int:
    """Least shared words of a template of n words."""
    return max(1, -(-n * threshold[0] // threshold[1]))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: every text (null: empty)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return d.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _among(text: Column, order: list[str]) -> Column:
    """The distinct words of a text that are in ``order``, in that order."""
    return F.array_intersect(F.array(*[F.lit(w) for w in order]), words(text))


def global_order(docs: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """All template words, those in the fewest texts first; counted over all texts."""
    every = sorted({w for _, notice in templates for w in _words_of(notice)})
    if not every:
        return []
    held = _texts(docs).select(F.explode(_among(F.col("text"), every)).alias("word")).groupBy("word").count()
    n = {r["word"]: r["count"] for r in held.collect()}  # at most one row per template word
    return sorted(every, key=lambda w: (n.get(w, 0), w))


def _candidates(docs: DataFrame, templates: list[tuple[str, str]], threshold: tuple[int, int]) -> DataFrame:
    """doc_id, text_key, text, t, label, words, n, k, length: every text and template that the filters leave."""
    spark, order = docs.sparkSession, global_order(docs, templates)
    place = {w: i for i, w in enumerate(order)}
    index = []
    for t, (label, notice) in enumerate(templates):
        ws = sorted(_words_of(notice), key=place.__getitem__)
        k = needed(len(ws), threshold)
        index += [(w, t, label, ws, len(ws), k, i, len(_all_words(notice))) for i, w in enumerate(ws[: len(ws) - k + 1])]
    schema = "word string, t int, label string, words array<string>, n int, k int, i int, length int"
    prefix = spark.createDataFrame(index, schema)
    least = min((x[5] for x in index), default=1)
    heads = F.array(*[F.lit(w) for w in sorted({x[0] for x in index})]) if index else F.expr("cast(array() as array<string>)")
    held = _texts(docs).select("doc_id", "text_key", "text", _among(F.col("text"), order).alias("held") if order else F.expr("cast(array() as array<string>)").alias("held"))
    near = held.where(F.size("held") >= least).select("doc_id", "text_key", "text", "held", F.explode(F.array_intersect(heads, "held")).alias("word"))
    m = F.size("held")
    j = F.array_position("held", F.col("word")).cast("int") - 1
    room = F.least(F.col("i"), j) + F.least(F.col("n") - F.col("i"), m - j)
    shared = F.array_intersect("words", "held")
    return (
        near.join(F.broadcast(prefix), "word")
        .where((m >= F.col("k")) & (room >= F.col("k")))
        .withColumn("shared", shared)
        .where((F.size("shared") >= F.col("k")) & (F.get("shared", F.lit(0)) == F.col("word")))  # once, by its first shared word
        .select("doc_id", "text_key", "text", "t", "label", "words", "n", "k", "length")
    )


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, text_key, number, last, label, containment: every block and template that reach the threshold.

    A block reaches from line ``number`` to line ``last``; runs that give way to others are left out.
    """
    pair = ["doc_id", "text_key", "t", "label", "n", "k"]
    by_line = F.transform(F.split("text", "\n"), words)
    d = _candidates(docs, templates, threshold).select(*pair, "words", "length", by_line.alias("by_line"))
    lines = F.transform("by_line", lambda w, i: F.struct(i.alias("number"), F.size(F.array_intersect("words", w)).alias("shared")))
    every = F.flatten(F.transform("by_line", lambda w, i: F.transform(w, lambda x: F.struct(i.alias("line"), x.alias("word")))))
    placed = F.transform(every, lambda x, p: F.struct(p.alias("place"), x["line"].alias("line"), x["word"].alias("word")))
    hits = F.filter(placed, lambda x: F.array_contains("words", x["word"]))
    hits = F.when(F.size("by_line") > 1, hits).otherwise(F.slice(hits, 1, 0))
    d = d.select(*pair, "length", F.filter(lines, lambda x: x["shared"] >= F.col("k")).alias("lines"), hits.alias("hits"))
    # places differ, so the hits of a run are among the next ``length`` ones
    runs = F.transform("hits", lambda h, i: F.filter(F.slice("hits", i + 1, F.col("length")), lambda x: x["place"] < h["place"] + F.col("length")))
    d = d.select(*pair, "lines", runs.alias("runs"))

    def run(x: Column) -> Column:
        first, last = F.element_at(x, 1), F.element_at(x, -1)
        shared = F.size(F.array_distinct(F.transform(x, lambda y: y["word"])))
        return F.struct(first["line"].alias("number"), last["line"].alias("last"), shared.alias("shared"), first["place"].alias("start"), last["place"].alias("end"))

    line = F.transform("lines", lambda x: F.struct(x["number"].alias("number"), x["number"].alias("last"), x["shared"].alias("shared"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    blocks = F.concat(line, F.filter(F.transform("runs", run), lambda x: x["shared"] >= F.col("k")))
    found = d.select(*pair, F.explode(blocks).alias("b")).select("doc_id", "text_key", "t", "label", "b.*", (F.col("b.shared") / F.col("n")).alias("containment"))
    found = written(found, "license-blocks")
    out = ["doc_id", "text_key", "number", "last", "label", "containment"]
    whole = found.where("start is null").select(*out)
    return whole.unionByName(_standing(found.where("start is not null")).where("number < last").select(*out)).distinct()  # repeated rows have equal pairs


def _standing(runs: DataFrame) -> DataFrame:
    """The runs without an overlapping one of higher containment and no fewer shared words."""
    at = Window.partitionBy("doc_id", "text_key", "place")
    here = F.collect_set(F.struct("shared", "containment")).over(at)  # at most a value per template and count
    beaten = F.exists("here", lambda x: (x["containment"] > F.col("containment")) & (x["shared"] >= F.col("shared")))
    places = runs.select("*", F.explode(F.sequence("start", "end")).alias("place")).withColumn("here", here)
    return places.groupBy(*runs.columns).agg(F.max(beaten).alias("beaten")).where("not beaten")


def best_matches(found: DataFrame) -> DataFrame:
    """Of each block's matches those with its highest containment (near-equal notices match together)."""
    block = found.groupBy("doc_id", "text_key", "number", "last").agg(
        F.max("containment").alias("containment"), F.collect_list(F.struct("containment", "label")).alias("all")
    )  # at most a row per template in the list
    top = F.filter("all", lambda x: x["containment"] == F.col("containment"))
    return block.select("doc_id", "text_key", "containment", F.explode(F.transform(top, lambda x: x["label"])).alias("label"))


def _starts(w: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand one after the other."""
    p = phrase.split()
    at = F.sequence(F.lit(0), F.size(w) - len(p))

    def here(i: Column) -> Column:
        test = F.element_at(w, i + 1) == p[0]
        for k, x in enumerate(p[1:], 2):
            test = test & (F.element_at(w, i + k) == x)
        return test

    found = F.filter(at, here)
    may = F.size(w) >= len(p)
    for x in p:
        may = may & F.array_contains(w, x)
    return F.when(may, found).otherwise(F.expr("cast(array() as array<int>)"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per document: word count, base places, and all labels."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words(text).alias("w"))
    d = d.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), *[_starts(F.col("w"), p).alias(f"p{i}") for i, p in enumerate(PHRASES.values())])
    places = [F.col(f"p{i}") for i in range(len(PHRASES))]
    labels = F.filter(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for label, c in zip(PHRASES, places, strict=True)]), lambda x: x.isNotNull())
    base = written(d.select("doc_id", "text_key", "n_words", F.concat(*places).alias("at"), labels.alias("base")), "license-base")
    found = best_matches(matches(docs, templates)).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    same = F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.text_key") == F.col("f.text_key"))
    none = F.expr("cast(array() as array<string>)")
    return base.alias("b").join(found.alias("f"), same, "left").select(
        F.col("b.doc_id").alias("doc_id"),
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    p = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = ", ".join(f"('{label}', {_words_of(n)!r}, {needed(len(_words_of(n)), THRESHOLD)})" for label, n in TEMPLATES)
    at = []
    for label, phrase in PHRASES.items():
        ws = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(ws))
        at.append(f"SELECT r, '{label}' AS label, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {test}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS t, regexp_extract_all({low}, '{p}') AS w FROM documents),
t(label, ws, k) AS (VALUES {rows}),
lines AS (SELECT row_number() OVER () AS l, r, regexp_extract_all(line, '{p}') AS lw FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
every AS (SELECT l, r, label, CAST(len(list_intersect(ws, lw)) AS DOUBLE) / len(ws) AS c FROM lines, t WHERE len(list_intersect(ws, lw)) >= k),
m AS (SELECT r, label, c FROM every QUALIFY c = max(c) OVER (PARTITION BY l)),
b AS ({" UNION ALL ".join(at)}),
bg AS (SELECT r, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM b GROUP BY r),
best AS (SELECT r, max(c) AS c FROM m GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(bg.s, '') AS base_labels,
    coalesce(a.s, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN bg USING (r) LEFT JOIN best USING (r) LEFT JOIN a USING (r)
"""


ORACLE = _oracle()
