"""Byte budget, exact cut, UTF-8-safe slices, snippets and prefix sums against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tokscope.functions import scalars as S
from tokscope.operators import corpus as CO
from tokscope.operators import prefix as P
from tokscope.operators import snippet as SN

SCHEMA = "lang_key string, doc_id long, text string"


def docs_fixture(spark, seed=3, n=60):
    rng = random.Random(seed)
    words = ["été", "日本", "x", "naïve", "𝔸b", "hello", "Ж"]
    rows = []
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        rows.append((lang, i * 7 + rng.randint(0, 3), " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))))
    return rows, spark.createDataFrame(rows, SCHEMA)


def py_budget(rows, target):
    out = {}
    for lang in sorted({r[0] for r in rows}):
        acc, total = [], 0
        for _, d, t in sorted(r for r in rows if r[0] == lang):
            if total >= target:
                break
            acc.append(t)
            total += len(t.encode())
        joined = "\n".join(acc).encode()[:target].decode("utf-8", errors="ignore")
        out[lang] = (len(acc), joined)
    return out


@pytest.mark.parametrize("target,block", [(50, 1 << 16), (301, 16), (5000, 8)])
def test_budget_and_cut(spark, target, block):
    rows, df = docs_fixture(spark)
    exp = py_budget(rows, target)
    cut = CO.corpus_sample(df, target, block_size=block).collect()
    for lang, (n_docs, text) in exp.items():
        mine = sorted((r["doc_seq"], r["start_byte"], r["text"]) for r in cut if r["lang_key"] == lang)
        assert "".join(t for _, _, t in mine) == text
        kept = CO.byte_budget(df, target, block_size=block).where(F.col("lang_key") == lang).count()
        assert kept == n_docs


def test_prefix_sums_match_window_with_tiny_blocks(spark):
    rows, df = docs_fixture(spark)
    slim = df.select("lang_key", "doc_id", F.length("text").alias("n")).repartition(7)
    out, totals = P.exclusive_prefix_sums(slim, ["lang_key"], "doc_id", {"off": "n"}, block_size=5)
    got = {(r["lang_key"], r["doc_id"]): r["off"] for r in out.collect()}
    for lang in {r[0] for r in rows}:
        acc = 0
        for _, d, t in sorted(r for r in rows if r[0] == lang):
            assert got[(lang, d)] == acc
            acc += len(t)
        assert {r["lang_key"]: r["n_total"] for r in totals.collect()}[lang] == acc


def test_utf8_slice_matches_errors_ignore(spark):
    rng = random.Random(11)
    text = "aé日𝔸" * 40
    data = text.encode()
    cases = [(rng.randint(0, len(data)), rng.randint(0, len(data) + 5)) for _ in range(200)]
    df = spark.createDataFrame([(text, a, b) for a, b in cases], "t string, a int, b int")
    got = [r[0] for r in df.select(S.utf8_slice(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got == [data[a:b].decode("utf-8", errors="ignore") for a, b in cases]


def test_snippet_offset_matches_python_random(spark):
    seeds, totals = [3674004633026330627, 1, 2**63 + 5, 7], [10_000_000, 200, 4500, 4396]
    df = spark.createDataFrame([(i, str(s), t) for i, (s, t) in enumerate(zip(seeds, totals))], "i int, s string, t long")
    off = SN.snippet_offset(F.col("s").cast("decimal(20,0)"), F.col("t"))
    got = [r[1] for r in sorted(df.select("i", off).collect())]
    exp = []
    for s, t in zip(seeds, totals):
        if t <= 300:
            exp.append(0)
            continue
        lo = 0 if t <= 4396 else 4096
        hi = t - 300
        exp.append(hi if lo >= hi else random.Random(s).randint(lo, hi))
    assert got == exp
    drawn = df.select("i", SN.snippet_offset(F.col("s").cast("decimal(20,0)"), F.col("t"), "modulo")).collect()
    assert [r[1] for r in sorted(drawn)] == [4096 + seeds[0] % (10_000_000 - 300 - 4096 + 1), 0, 4096 + seeds[2] % 105, seeds[3] % 4097]


def test_seed_matches_sha1(spark):
    import hashlib

    r = spark.createDataFrame([("eng", "Latn")], "i string, s string").select(S.language_seed(F.col("i"), F.col("s")).cast("string")).first()[0]
    assert int(r) == int.from_bytes(hashlib.sha1(b"eng:Latn").digest()[:8], "big")


def test_fallback_text_exact_bytes(spark):
    r = spark.createDataFrame([("English",)], "n string").select(CO.fallback_text(F.col("n"), 1000).alias("t")).first()[0]
    base = ("Sample text for English tokenizer testing. " * 1000).encode()[:1000].decode()
    assert r == base
