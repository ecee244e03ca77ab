"""Rows that earlier versions dropped, multiplied or took too long over."""

from __future__ import annotations

import math
import random
import re
import statistics
import time
import zlib

import cases
import pytest
from tokscope.llm import bpe, decontamination, jaccard_join, license_scans, quality_rules, secret_scans, sharding, warc


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i}", 1, "x", n) for n, (i, t) in enumerate(rows)], cases.SCHEMA)


def test_unlike_texts_under_one_id_both_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = a.replace("a39", "other")
    rows = [(7, a), (7, b), (7, a), (8, near), (9, b), (10, ""), (10, None), (11, ""), (None, a)]
    kept = sorted(((r.doc_id, r.text or "") for r in jaccard_join.one_of_each(docs_of(spark, rows)).collect()), key=str)
    assert kept == sorted([(7, a), (7, b), (10, ""), (11, ""), (None, a)], key=str)
    out = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(docs_of(spark, rows[:5])).collect())
    assert out == sorted([(7, 7, 2), (7, 7, 1), (7, 7, 2), (8, 7, 2), (9, 7, 1)])


def test_short_items_and_excerpts_leak(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 5000)}q" for _ in range(600)]
    filler = " ".join(f"f{i}" for i in range(200))
    item, short = " ".join(words), "only six plain words stand here"
    items = spark.createDataFrame([(1, item), (2, short), (3, "two words"), (4, "three little words")], "item_id long, text string")
    rows = [
        (1, f"{filler} {' '.join(words[200:296])} {filler}"),
        (2, f"{filler}. Only six plain words stand here! {filler}"),
        (3, f"{filler} only six plain stand words here {filler}"),
        (4, f"two words {filler} three little words"),
        (5, f"{filler} {' '.join(words[200:215])} {filler}"),
    ]
    found = sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs_of(spark, rows), items).collect())
    assert found == [(1, 1), (2, 2), (4, 4)]


def plain_bm25(passages, segments, least):
    """Pairs whose summed share of BM25 weight reaches ``least``: every passage against every segment."""
    n, mean = len(segments), statistics.fmean(len(s) for s in segments)
    df = {}
    for s in segments:
        for t in set(s):
            df[t] = df.get(t, 0) + 1
    weights = []
    for s in segments:
        w = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * s.count(t) * 2.2 / (s.count(t) + 1.2 * (0.25 + 0.75 * len(s) / mean)) for t in set(s)}
        own = sum(w.values())
        weights.append({t: x / own for t, x in w.items()})
    out = {}
    for p, terms in enumerate(passages):
        for i, w in enumerate(weights):
            score = sum(w.get(t, 0.0) for t in terms)
            if score >= least - 1e-9:
                out[p, i] = score
    return out


def test_block_max_search_equals_plain_bm25(spark):
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(300)]
    pick = lambda n: [vocab[min(int(rng.expovariate(0.02)), 299)] for _ in range(n)]
    texts = [" ".join(pick(rng.randint(3, 130))) for _ in range(90)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    for least in (0.2, 0.4, 0.7):
        for shard in decontamination.shards(items, 3000):
            cut, place = [], []
            # segments of all items, for the corpus statistics; this shard's by their place in it
            every = []
            for text in texts:
                w = decontamination.tokens(text)
                every += [w[i : i + 48] for i in (max(0, min(i, len(w) - 48)) for i in range(0, len(w), 48))]
            for item, (_, text) in enumerate(shard.items):
                w = decontamination.tokens(text)
                mine = [w[i : i + 48] for i in (max(0, min(i, len(w) - 48)) for i in range(0, len(w), 48))]
                place += [every.index(m) for m in mine]
                cut += mine
            passages = [set(pick(rng.randint(1, 96))) | set(rng.choice(cut)[: rng.randint(0, 48)]) for _ in range(60)]
            passages = [{t if isinstance(t, bytes) else t.encode() for t in p} for p in passages]
            want = {(p, place.index(i)): s for (p, i), s in plain_bm25(passages, every, least).items() if i in place}
            pairs = sorted((p, shard.terms[t]) for p, terms in enumerate(passages) for t in terms if t in shard.terms)
            import numpy as np

            got = shard.search(np.array([p for p, _ in pairs]), np.array([t for _, t in pairs]), least)
            found = {(p, s): x for p, s, x in zip(*(g.tolist() for g in got), strict=True)}
            assert found.keys() >= want.keys() and all(abs(found[k] - x) < 1e-9 for k, x in want.items())
            assert len(found) >= len(want) and all(s in range(len(cut)) for _, s in found)


def test_rewrite_keeps_repeated_rows_and_splits_shards(spark, tmp_path):
    rows = [(i % 9, f"text {i % 9} " * (1 + i % 5)) for i in range(45)] + [(1, "same")] * 3 + [(None, None)] * 2
    docs = docs_of(spark, rows).withColumn("shard", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    places = sharding.reshard(docs, shards=3)
    affected = sharding.rewrite(docs, places, str(tmp_path / "out"), file_rows=5)
    back = sharding.rewritten(spark, places, affected, str(tmp_path / "out")).collect()
    assert len(back) == len(rows)
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, back)) == sorted(map(key, places.collect()))
    want = sorted((i if i is not None else -1, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    assert sorted((k[0], k[2], k[1]) for k in map(key, back)) == want
    for shard in {r.shard for r in back}:
        assert sorted(r.slot for r in back if r.shard == shard) == list(range(sum(r.shard == shard for r in back)))
    assert len(list((tmp_path / "out" / f"shard={affected[0]}").glob("*.parquet"))) > 1


def test_flow_moves_the_fewest_bytes():
    from itertools import product

    rng = random.Random(9)
    for _ in range(40):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 4) for _ in range(n)]
        total = sum(supply)
        capacity = [rng.randint(0, 4) for _ in range(m)]
        capacity[0] += max(0, total - sum(capacity))
        cost = [[rng.randint(0, 3) for _ in range(m)] for _ in range(n)]
        flow = sharding.min_cost_flow(supply, capacity, cost)
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= capacity[j] for j in range(m))
        got = sum(flow[i][j] * cost[i][j] for i in range(n) for j in range(m))
        units = [i for i in range(n) for _ in range(supply[i])]
        best = min(
            (sum(cost[i][j] for i, j in zip(units, to, strict=True)) for to in product(range(m), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(m))),
            default=0,
        )
        assert got == best


def test_shards_are_balanced_and_move_little(spark):
    rng = random.Random(4)
    docs = docs_of(spark, [(i, "x" * rng.randint(0, 300)) for i in range(600)])
    places = sharding.reshard(docs, shards=5, old_shards=4).collect()
    sizes = [sum(r.size for r in places if r.shard == s) for s in range(5)]
    assert max(sizes) - min(sizes) <= 2 * 316  # the rows at the cuts
    old = [sum(r.size for r in places if r.old_shard == s) for s in range(4)]
    least = sum(max(0, o - math.ceil(sum(sizes) / 5)) for o in old)
    moved = sum(r.size for r in places if r.moved)
    assert least - 4 * 316 <= moved <= least + 4 * 316 * 5


def test_many_matches_in_one_text(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(16)) for _ in range(100_000)]
    text = "é " + " ".join(values)
    began = time.time()
    r = secret_scans.scan(docs_of(spark, [(1, text)])).collect()[0]
    assert r.n_hex == 100_000 and time.time() - began < 120
    want = [f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{16,}", text)]
    assert r.spans == ",".join(want)


def test_masking_many_spans(spark):
    rng = random.Random(6)
    parts, want = [], []
    for i in range(3000):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(20))
        gap = "é日 z" * rng.randint(0, 3)
        parts.append(f"{gap} token={value} ")
        want.append(f"{gap} [SECRET] ")
    text = "".join(parts) + "end" + "-" * 9000
    out = secret_scans.masked(docs_of(spark, [(1, text), (2, "plain")])).collect()
    assert {r.doc_id: r.text for r in out} == {1: "".join(want) + "end" + "-" * 9000, 2: "plain"}


@pytest.mark.parametrize("unit", ["<html ", "<script", "<a href=", "<title", "<p '", '<a "> "', "<!--", "<div title='x> ", "</", "<style>", "<a ", "&amp", "<title>", '<a href="'])
@pytest.mark.parametrize("end", ["", ">", "'>"])
def test_hostile_pages_take_linear_time(unit, end):
    page = unit * (1_000_000 // len(unit)) + end
    began = time.time()
    warc.plain_text(page)
    warc.facts(page, "http://x.example/")
    assert time.time() - began < 30


def test_text_and_facts_of_pages():
    page = (
        '<!DOCTYPE html><html class="a" lang="EN-gb"><head><title>A &amp; B\n c</title><script>var x = "<p>";</script></head>'
        "<body><h1>One</h1>two<br>three <b>bold</b><!-- <p>no</p> --><p title='a > b'>four<style>x{}</style> five</p>"
        '<a href="/x?a=1&amp;b=2">six</a> <A HREF=y.html>7</A> <a name=z>8</a><script>never closed'
    )
    assert warc.plain_text(page) == "One\ntwo\nthree bold\nfour five\nsix 7 8"
    assert warc.facts(page, "http://h.example/d/") == {"title": "A & B c", "lang": "en-gb", "outlinks": ["http://h.example/x?a=1&b=2", "http://h.example/d/y.html"]}
    assert warc.plain_text("a < b <p") == "a < b <p" and warc.plain_text("x <script <!-- y") == "x <script"


def test_other_tokenizer_files_are_refused(spark, tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="another build: normalizer, pre_tokenizer, decoder"):
        bpe.encode(docs_of(spark, [(1, "x")]), public_tokenizers.path("byte_bpe_50k.json"))


def test_long_texts_are_encoded_whole(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(400_000)) for _ in range(3)]
    out = {r.doc_id: r for r in bpe.encode(docs_of(spark, list(enumerate(texts)))).collect()}
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert out[i].ids == ids and out[i].decoded == tok.decode(ids, skip_special_tokens=False)


def test_only_a_to_z_are_lower_cased(spark):
    rows = docs_of(spark, [(1, "WORK under THE mit LICENSE")])
    from pyspark.sql import functions as F

    assert rows.select(license_scans.words(F.col("text"))).first()[0] == ["worK", "under", "the", "mit", "license"]


def test_bands_equal_plain_python(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        n = rng.choice([0, 5, 25, 60])
        words = [rng.choice(["the", "house", "zqx", "日本", "stands", "##|$", "Ünï"]) for _ in range(n)]
        rows.append((i, " ".join(words) + ("\nthe house\nthe house\n" if i % 7 == 0 else ""), rng.choice(["en", "en", "de", None]), "s", 1, "x", 0))
    out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    lower = lambda xs: sorted(xs)[(len(xs) - 1) // 2]  # noqa: E731 - the least value that half of them reach
    measured = [r for r in out.values() if r.n_words >= 20]
    for m, floor in quality_rules.FLOOR.items():
        def band(of, m=m, floor=floor):
            v = [math.floor(getattr(r, m) * 1000 + 0.5) for r in of]
            mid = lower(v)
            return mid, max(lower([abs(x - mid) for x in v]) * quality_rules.SPREAD[m], floor * 1000)

        every = band(measured)
        for r in measured:
            own = [x for x in measured if x.lang == r.lang]
            k = quality_rules.PRIOR
            mid, reach = ((a * len(own) + b * k) / (len(own) + k) for a, b in zip(band(own), every, strict=True))
            stray = abs(math.floor(getattr(r, m) * 1000 + 0.5) - mid)
            wide = reach * math.sqrt(max(1.0, quality_rules.STEADY / r.n_words))
            if abs(stray - wide) > 1e-6:
                assert (m in r.rejected_by.split(",")) == (stray > wide)
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        inside = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert r.kept == (not r.base_failed and not r.rejected_by)


def test_written_tables_can_be_dropped(spark, tmp_path):
    from tokscope.llm import common

    common.drop_written(spark)
    old = common.ensure_checkpoint_dir
    common.ensure_checkpoint_dir = lambda _: f"file://{tmp_path}"
    try:
        df = common.written(spark.range(5).toDF("x"), "some")
    finally:
        common.ensure_checkpoint_dir = old
    assert df.count() == 5 and len(list(tmp_path.iterdir())) == 1
    assert common.drop_written(spark) == 1 and not list(tmp_path.iterdir()) and common.drop_written(spark) == 0
