"""Collocations against plain Python on awkward texts; the summaries' guarantee on skewed streams."""

from __future__ import annotations

import random
import re
from collections import Counter

import cases
import numpy as np
import pytest
from tokscope.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, k int, n long"


def brute(rows, least, top=2000, most=3):
    f, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, g in f.items():
        cand = {p: a for p, a in g.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            score, cut = min((1_000_000 * a * a // (g[p[:c]] * g[p[c:]]), c) for c in range(1, len(p)))
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 50 * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), g[p[:cut]], g[p[cut:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def awkward():
    rng = random.Random(11)
    vocab = ["Alpha", "beta", "É", "ÉCOLE", "日本", "x\x1cy", "a\xa0b", "K", "q|", "\\", "zz", "İ"]
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("one", ""), ("...", "de")]
    for _ in range(260):
        words = [rng.choice(vocab[: rng.randint(2, len(vocab))]) for _ in range(rng.randint(1, 60))]
        rows.append(("".join(w + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", "\r\n", ";"]) for w in words), rng.choice(["en", "en", "de", None, ""])))
    rows += [("same words again and again " * 30, "fr")] * 40  # a hot group of copies, phrases within phrases
    rows += [(" ".join(f"w{i % 977}" for i in range(20_000)), "en")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 700, "mass": 2000}])
def test_equals_plain_python(spark, sizes):
    rows = awkward()
    df = spark.createDataFrame([(i, t, lang, "p", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    assert got(collocations.collocations(df, **sizes)) == brute(rows, 10)
    assert got(collocations.collocations(df, least=3, top=7, **sizes)) == brute(rows, 3, 7)


def test_longer_phrases(spark):
    rows = awkward()[:120]
    df = spark.createDataFrame([(i, t, lang, "p", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert got(collocations.collocations(df, least=4, max_words=5)) == brute(rows, 4, most=5)


def test_awkward_documents_and_empty_table(spark):
    assert got(collocations.collocations(cases.documents(spark))) == brute([(r[1], r[2]) for r in cases.ROWS], 10)
    assert got(collocations.collocations(cases.no_documents(spark))) == []


@pytest.mark.parametrize("least", [10, 100])
def test_summary_keeps_every_frequent_key(least):
    rng = np.random.default_rng(least)
    stream = np.concatenate([rng.integers(0, 1 << 32, 200_000), rng.zipf(1.3, 100_000) % 5000, np.repeat(np.arange(7_000_000, 7_000_300), least), np.full(90_000, 77)]).astype(np.uint32)
    rng.shuffle(stream)
    cells = []
    for part in np.array_split(stream, 23):
        keys, n = np.unique(part, return_counts=True)
        cells.append((collocations.packed(np.diff(keys, prepend=np.uint32(0))), collocations.packed(n.astype(np.uint32))))
    s = collocations.summarised(cells, len(stream), least)
    keys, n = np.unique(stream, return_counts=True)
    assert len(s.keys) <= s.capacity and s.capacity > len(stream) / least
    assert s.taken <= len(stream) // (s.capacity + 1) < least
    exact = dict(zip(keys.tolist(), n.tolist(), strict=True))
    for k, c in zip(s.keys.tolist(), s.counts.tolist(), strict=True):
        assert exact[k] - s.taken <= c <= exact[k]
    assert set(keys[n >= least].tolist()) <= set(s.survivors(least).tolist())


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 63, 64, 5000):
            x = rng.integers(0, np.iinfo(kind).max, n, dtype=kind)
            assert collocations.unpacked(collocations.packed(x), kind).tolist() == x.tolist()
