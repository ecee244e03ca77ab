"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns: results as documented."""

from __future__ import annotations

import hashlib
import re

import cases
import numpy as np
import pytest
from tokscope.llm import bpe, decontamination, jaccard_join, license_scans, quality_classifier, quality_rules, secret_scans, sharding, substring_dedup, warc

EMPTY = hashlib.sha256(b"").hexdigest()


def rows(df):
    return sorted(df.collect(), key=lambda r: tuple((x is not None, str(type(x)), x if not isinstance(x, float) else x) if not isinstance(x, list) else (True, "list", str(x)) for x in r))


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_bpe(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    out = sorted((r.doc_id or -1, tuple(r.ids), r.decoded) for r in bpe.encode(cases.documents(spark), block_chars=2000).collect())
    want = []
    for doc_id, text, *_ in cases.ROWS:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id or -1, tuple(ids), tok.decode(ids, skip_special_tokens=False)))
    assert out == sorted(want)
    d = by_id(bpe.digests(bpe.encode(cases.documents(spark))))
    assert d[3][0].n_tokens == 0 and d[3][0].ids_sha256 == EMPTY and d[3][0].decoded_sha256 == EMPTY
    assert bpe.encode(cases.no_documents(spark)).count() == 0


def test_bpe_words_equal_the_library():
    import random

    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    tok, spec = Tokenizer.from_file(path), open(path, encoding="utf-8").read()
    split, encode, rng = bpe.splitter(spec), bpe.word_encoder(spec), random.Random(3)
    pool = [chr(i) for i in range(0x250)] + list("ΣσςЖ中文ｶﾞ̈́Ḱ̂  　😀ߙ०Ⅷ‍﻿") + ["'s", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "\x85"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert [i for w in split(text) for i in encode(w)] == tok.encode(text, add_special_tokens=False).ids


def test_decontamination(spark):
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in decontamination.leaks(cases.documents(spark), cases.items(spark)).collect())
    assert found == [(-1, 100), (7, 100), (8, 100), (9, 100)]
    kept = decontamination.without_leaks(cases.documents(spark), cases.items(spark))
    assert kept.columns == cases.documents(spark).columns and kept.count() == len(cases.ROWS) - 4
    assert decontamination.leaks(cases.no_documents(spark), cases.items(spark)).count() == 0
    assert decontamination.leaks(cases.documents(spark), cases.items(spark).limit(0)).count() == 0
    assert decontamination.without_leaks(cases.documents(spark), cases.items(spark).limit(0)).count() == len(cases.ROWS)


def test_secret_scans(spark):
    out = by_id(secret_scans.scan(cases.documents(spark)))
    assert sum(map(len, out.values())) == len(cases.ROWS) and len(out[1]) == 2
    assert out[3][0].base_sha256 == EMPTY and out[3][0].spans == ""
    text = dict((r[0], r[1]) for r in cases.ROWS)[12]
    want = []
    for kind, pattern, group, least in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
    ):
        want += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    said = ",".join(x[2] for x in sorted(want))
    r = out[12][0]
    assert r.spans == said and r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)
    assert secret_scans.scan(cases.no_documents(spark)).count() == 0
    masked = {(r.doc_id, r.k): r for r in secret_scans.masked(cases.documents(spark)).collect()}
    hidden = masked[12, 1]
    assert hidden.text == "É [SECRET]\" password: shortone [SECRET] deadbeefdeadbeef00" and hidden.n_chars == len(hidden.text)
    assert masked[6, 4].text == cases.LONG and len(secret_scans.masked(cases.documents(spark)).collect()) == len(cases.ROWS)


def test_shared_secrets_are_examples(spark):
    rows_ = [(i, f"x password=Abcdefgh12345678{'' if i < 3 else i} y", "en", f"s{i}", 1, None, None) for i in range(5)]
    rows_.append((9, "ghp_" + "a1B2c3D4e5F6g7H8i9J0" * 2, "en", "s9", 1, None, None))
    out = by_id(secret_scans.scan(spark.createDataFrame(rows_, cases.SCHEMA)))
    assert [out[i][0].n_example for i in range(5)] == [1, 1, 1, 0, 0]
    assert [out[i][0].n_live for i in range(5)] == [0, 0, 0, 1, 1]
    assert all(out[i][0].n_assign == 1 for i in range(5))  # base spans stay
    assert out[9][0].spans == "known:0:44" and out[9][0].base_sha256 == EMPTY


def brute_links(rows_):
    sets = []
    for _, text, *_ in rows_:
        w = re.findall(r"[^ \t-\r]+", text or "")
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    near = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    named = [i for i, r in enumerate(rows_) if r[0] is not None]
    links = {i: [j for j in named if j != i and near(sets[i], sets[j])] for i in named}
    out = []
    for i, r in enumerate(rows_):
        if r[0] is None:
            out.append((-1, -1, 0))
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((r[0], min(rows_[j][0] for j in seen), len(links[i])))
    return sorted(out)


def test_jaccard_join(spark):
    got = [(-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in jaccard_join.join(cases.documents(spark)).collect()]
    assert sorted(got) == brute_links(cases.ROWS)
    kept = jaccard_join.one_of_each(cases.documents(spark))
    assert kept.columns == cases.documents(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 2 and {3, 4, 5, 6}.issubset(ids)
    assert jaccard_join.join(cases.no_documents(spark)).count() == 0


def test_jaccard_join_in_chunks(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(80)]
    rows_ = []
    for d in range(60):  # near copies, cut into chunks of five
        words = list(base)
        for at in rng.choice(80, rng.integers(0, 3), replace=False):
            words[at] = f"e{d}_{at}"
        rows_.append((d, " ".join(words), "en", "a", 1, None, None))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(spark.createDataFrame(rows_, cases.SCHEMA), chunk=5).collect())
    assert got == brute_links(rows_)


def test_recall_shortens_prefix():
    assert jaccard_join.matched_depth(0.9) >= jaccard_join.matched_depth(0.9999) >= jaccard_join.matched_depth(0.999999)
    assert jaccard_join.recall(jaccard_join.matched_depth()) >= jaccard_join.TARGET_RECALL


def test_quality_rules(spark):
    out = by_id(quality_rules.judge(cases.documents(spark)))
    assert sum(map(len, out.values())) == len(cases.ROWS)
    assert out[3][0].n_words == 0 and out[3][0].base_failed and not out[3][0].kept and out[3][0].entropy is None
    assert out[10][0].n_repeat_words == 120 and out[10][0].base_failed
    assert out[6][0].n_words == 30_000 and not out[6][0].base_failed
    assert quality_rules.judge(cases.no_documents(spark)).count() == 0


def brute_removed(rows_, window=50):
    first, out = {}, []
    split = [re.findall(r"[^ \t-\r]+", r[1] or "") for r in rows_]
    for r, w in zip(rows_, split, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if r[0] is not None:
                first[key] = min(first.get(key, r[0]), r[0])
    for r, w in zip(rows_, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[i : i + window])] < r[0]:
                gone.update(range(i, i + window))
        out.append((-1 if r[0] is None else r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_substring_dedup(spark):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(cases.documents(spark)).collect())
    assert got == brute_removed(cases.ROWS)
    assert substring_dedup.dedup(cases.no_documents(spark)).count() == 0


def test_substring_dedup_on_few_words(spark):
    """Few different words, so runs, periods and chance repeats abound; a short window."""
    rng = np.random.default_rng(2)
    passages = [" ".join(rng.choice(list("abc"), 70)) for _ in range(4)]
    rows_ = []
    for d in range(60):
        parts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40))), passages[rng.integers(4)][rng.integers(0, 40) :], "a " * rng.integers(0, 70), "a b " * rng.integers(0, 40)]
        rows_.append((int(rng.integers(0, 50)), " ".join(parts[i] for i in rng.permutation(4)), "en", "a", 1, None, None))
    for window in (50, 24):
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(spark.createDataFrame(rows_, cases.SCHEMA), window).collect())
        assert got == brute_removed(rows_, window)


def test_quality_classifier(spark):
    docs = cases.documents(spark)
    out = by_id(quality_classifier.classify(docs, cases.labels(spark)))
    assert sum(map(len, out.values())) == len(cases.ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for rs in out.values() for r in rs)
    assert out[None][0].held_out is False
    assert quality_classifier.classify(cases.no_documents(spark), cases.labels(spark)).count() == 0
    none = by_id(quality_classifier.classify(docs, cases.labels(spark).limit(0)))
    assert none[1][0].score == pytest.approx(0.5)
    kept = quality_classifier.accepted(docs, cases.labels(spark))
    assert kept.columns == docs.columns


def test_license_scans(spark):
    out = by_id(license_scans.scan(cases.documents(spark)))
    assert sum(map(len, out.values())) == len(cases.ROWS)
    r = out[13][0]
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (14, 3, 0, 11)
    assert r.base_labels == "cc-by,gpl,reserved" and r.labels == "cc-by,cc-by-nc,gpl,reserved" and r.score == 1.0
    assert out[3][0].n_words == 0 and out[3][0].first_word is None and out[3][0].labels == "" and out[3][0].score == 0.0
    assert license_scans.scan(cases.no_documents(spark)).count() == 0
    assert license_scans.scan(cases.documents(spark), []).where("labels like '%mit%'").count() == 0


NOTICES = [
    ("Released under the MIT License.", "mit"),
    ("This project is licensed under the MIT license - see the LICENSE file", "mit"),
    ("// Use of this source code is governed by, and licensed under, the BSD License", "bsd"),
    ("Distributed under the BSD 3-Clause License.", "bsd"),
    ("Released under the ISC License", "isc"),
    ("Licensed under the Mozilla Public License", "mpl"),
    ("Available under the MPL 2.0", "mpl-2.0"),
    ("Released under the GPL", "gpl"),
    ("Dual licensed under the GPLv2", "gpl"),
    ("Released under the Apache License 2.0", "apache-2.0"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    (" * The above copyright notice and this permission notice shall be included in all copies or substantial portions", "mit"),
    ("notice, this list of conditions, and the following disclaimer: redistributions of source code must retain the above copyright notice", "bsd"),
    ("Released under the Foo License", ""),
    ("Released under the Foo License 2.0", ""),
    ("Released under the Foo Public License", ""),
    ("we study at MIT under the guidance of others", ""),
]


def test_license_scans_short_notices(spark):
    docs = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(NOTICES)], "doc_id long, text string")
    out = {r.doc_id: r.labels for r in license_scans.scan(docs).collect()}
    assert [out[i] for i in range(len(NOTICES))] == [label for _, label in NOTICES]


WRAPPED = [
    ("// Redistribution and use in source and binary\n// forms, with or without modification, are permitted\n// provided", "bsd", 1.0),
    ("# This Source Code Form is subject to the terms of the\n# Mozilla Public License, v. 2.0.", "mpl,mpl-2.0", 1.0),
    (" * Permission to use, copy, modify, and/or distribute this software\n * for any purpose with or without fee\n * is hereby granted", "isc", 1.0),
    ("a b c\nyou can redistribute it and/or modify\nit under the terms of the GNU Lesser General Public\nLicense", "gpl", 1.0),
    ("x y\nReleased under the\r\n\r\nMIT License.", "mit", 1.0),
    ("x y released under the MIT\n" + "z " * 5000 + "License", "", 0.0),  # no run that long
    ("Licensed under CC\nBY-NC 4.0. All\nrights reserved", "cc-by,cc-by-nc,reserved", 1.0),  # cc-by-sa shares six of seven words
    ("Licensed under CC BY-NC 4.0.\nsa", "cc-by,cc-by-nc", 1.0),
    ("All\nof the rights that were not reserved", "", 0.0),
    ("Permission is hereby granted, free of\ncharge, to anyone obtaining a copy of this software", "mit", 13 / 15),
]


def test_license_scans_wrapped_notices(spark):
    docs = spark.createDataFrame([(i % 7, text) for i, (text, *_) in enumerate(WRAPPED)] * 2, "doc_id long, text string")
    out = sorted((r.doc_id, r.labels, round(r.score, 6)) for r in license_scans.scan(docs).collect())
    assert out == sorted((i % 7, labels, round(score, 6)) for i, (_, labels, score) in enumerate(WRAPPED) for _ in range(2))


def test_license_matches_brute_force(spark):
    """Random wrapped text: lines and runs counted one by one."""
    import random

    draw = random.Random(5)
    notices = [("a", "p q r s t u v w x y"), ("b", "p q r s t u v w x z"), ("c", "k l m"), ("d", "p k p l q")]
    texts = []
    for i in range(60):
        ws = []
        while len(ws) < 60:
            ws += draw.choice(notices)[1].split() if draw.random() < 0.5 else draw.choices("pqrstuvwxyzklmno", k=4)
        texts.append((i, "".join(w + draw.choice("     \n") for w in ws)))
    want = set()
    for i, text in texts:
        ws = [(w, n) for n, line in enumerate(text.split("\n")) for w in line.split()]
        runs = []
        for label, notice in notices:
            kinds, size = set(notice.split()), len(notice.split())
            for n, line in enumerate(text.split("\n")):
                shared = len(kinds & set(line.split()))
                if 5 * shared >= 4 * len(kinds):
                    want.add((i, n, n, label, shared / len(kinds)))
            for s in range(len(ws)):
                places = [p for p in range(s, min(s + size, len(ws))) if ws[p][0] in kinds]
                shared = len({ws[p][0] for p in places})
                if places and places[0] == s and 5 * shared >= 4 * len(kinds):
                    runs.append((s, places[-1], label, shared, shared / len(kinds)))
        for s, e, label, shared, c in runs:
            if ws[s][1] < ws[e][1] and not any(x[0] <= e and s <= x[1] and x[4] > c and x[3] >= shared for x in runs):
                want.add((i, ws[s][1], ws[e][1], label, c))
    out = license_scans.matches(spark.createDataFrame(texts, "doc_id long, text string"), notices).collect()
    assert sum(n < last for _, n, last, *_ in want) > 20
    assert sorted((r.doc_id, r.number, r.last, r.label, r.containment) for r in out) == sorted(want)


def test_sharding(spark, tmp_path):
    docs = cases.documents(spark)
    out = sharding.reshard(docs).collect()
    assert len(out) == len(cases.ROWS)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    import zlib

    want = sorted((r[0] or -1, len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in cases.ROWS)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == want
    assert sharding.reshard(cases.no_documents(spark)).count() == 0


def test_rewrite_only_affected_shards(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "x" * (i % 7 * 100), "en", "a", 1, None, None) for i in range(300)], cases.SCHEMA)
    # two of three shards already fit their capacity; a fourth is new
    places = sharding.reshard(docs, F.col("doc_id") % 3, capacities=[50_000, 50_000, 20_000, 10_000], shards=4, old_shards=3)
    rows_ = places.collect()
    path = str(tmp_path / "shards")
    changed = sharding.rewrite(docs, places, path)
    assert changed == sorted({r.old_shard for r in rows_ if r.moved} | {r.shard for r in rows_ if r.moved})
    back = spark.read.parquet(path).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in back) == sorted((r.doc_id, r.shard, r.slot) for r in rows_ if r.shard in changed)


def test_min_cost_flow_is_least():
    flow = sharding.min_cost_flow([10, 4], [6, 4, 4], [[0, 1, 1], [1, 0, 1]])
    assert [sum(f) for f in flow] == [10, 4] and sum(flow[i][j] * (i != j) for i in range(2) for j in range(3)) == 4
    # a detour over other costs: the cheaper assignment needs the second source to give way
    flow = sharding.min_cost_flow([5, 5], [5, 5], [[1, 9], [1, 2]])
    assert flow == [[5, 0], [0, 5]]
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], [[0]])


def test_warc(spark, tmp_path):
    page = "<html lang='en'><head><title>A &amp; B</title></head><body><!-- x --><p class=\"a>b\">One <b>two</b><br>three</p><script>no()</script><a href='/c?d=1&amp;e'>l</a></body></html>"
    pages = spark.createDataFrame([(1, "http://x.org/p", page, 7), (1, "http://x.org/p", page, 7), (2, None, None, None), (None, "http://[bad", "<a href='http://[::x'>", 1), (4, "u", "", 0)], "page_id long, url string, html string, block int")
    out = warc.derive(warc.responses(pages))
    rows_ = out.collect()
    assert len(rows_) == 10
    text = next(r for r in rows_ if r.page_id == 1 and r.record_type == "conversion")
    about = next(r for r in rows_ if r.page_id == 1 and r.record_type == "metadata")
    assert text.block == "One two\nthree\nl" and text.refers_to == about.refers_to and text.record_id != about.record_id
    assert text.payload_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest()
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    import json

    facts = json.loads(about.block)
    assert facts["title"] == "A & B" and facts["lang"] == "en" and facts["outlinks"] == ["http://x.org/c?d=1&e"]
    path = str(tmp_path / "w")
    warc.write_warc(out, path)
    import glob

    raw = b"".join(open(f, "rb").read() for f in glob.glob(path + "/part-*"))
    heads = re.findall(rb"WARC/1\.1\r\nWARC-Type: (\w+)\r\n.*?Content-Length: (\d+)\r\n\r\n", raw, re.S)
    assert len(heads) == 10 and raw.endswith(b"\r\n\r\n")
    at = 0
    for _ in range(10):  # each block has just the length that its header says
        head = raw.index(b"\r\n\r\n", at) + 4
        n = int(re.search(rb"Content-Length: (\d+)", raw[at:head])[1])
        assert raw[head + n : head + n + 4] == b"\r\n\r\n"
        at = head + n + 4
    assert at == len(raw)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
