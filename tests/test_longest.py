"""Native longest match against plain Python, alone and under the metrics."""

import random

from pyspark.sql import functions as F

from tokscope.operators import encode as EN
from tokscope.operators import longest as LO
from tokscope.operators import metrics as M


def plain(text, tokens, max_len):
    out, at = [], 0
    while at < len(text):
        for k in range(max_len, 0, -1):
            if len(text[at : at + k]) == k and text[at : at + k] in tokens:
                out.append(tokens[text[at : at + k]])
                at += k
                break
        else:
            out += text[at].encode()
            at += 1
    return out


def test_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(LO, "FOLD", 7)
    rng = random.Random(3)
    alphabet = ["a", "b", "-", "1", ".", "é", "日"]
    strings = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"ab-1", "a", "-1.", "ab-1.é"}
    tokens = {t: 256 + i for i, t in enumerate(sorted(strings))}
    table = spark.createDataFrame(list(tokens.items()), "token string, token_id int")
    chunks = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)} | {"zzz", "ab-1.é" * 20, "日", "x" * 40}
    df = LO.longest_match(spark.createDataFrame([(c,) for c in chunks], "piece string"), table, 6)
    assert {r["piece"]: r["ids"] for r in df.collect()} == {c: plain(c, tokens, 6) for c in chunks}


def test_no_python_worker(spark, capsys):
    table = spark.range(1).select(F.lit("ab").alias("token"), F.lit(256).alias("token_id"))
    LO.longest_match(spark.range(3).select(F.col("id").cast("string").alias("piece")), table, 4).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and plan.count("(4) BroadcastHashJoin") <= 1


def test_metrics_with_tokens_across_pieces(spark):
    texts = ["v2.0 of the v2.0-beta", "don't  v2.0\n", "", "it's the-end of v2.0"]
    docs = spark.createDataFrame([("eng-Latn", "eng", "Latn", "English", "x", i, t) for i, t in enumerate(texts)], "lang_key string, iso_code string, script string, language string, source string, doc_id long, text string")
    tokens = LO.learn_tokens(spark.createDataFrame([("v2.0 v2.0 don't don't of the of the-end",)], "text string"), 12, 5).cache()
    table = {r["token"]: r["token_id"] for r in tokens.collect()}
    assert len(table) == 12 and any("." in t for t in table) and min(table.values()) == 256
    vocab = LO.longest_vocab(docs.where("text <> ''").unionByName(docs.limit(1).withColumn("text", F.lit("\n\n\n"))), tokens, "longest", 5, 12, bos=True)
    joined = "\n".join(texts)
    import re

    chunks = re.findall(r"\S+|\s+", joined)
    # every chunk of the joined text is in the table but the borders, which are white space
    words = {r["piece"]: r["ids"] for r in vocab.words.collect()}
    assert all(words[c] == plain(c, table, 5) for c in chunks if c in words)
    counts = EN.token_counts(docs.select("lang_key", "text").where("text <> ''"), vocab, ["lang_key"])
    want = {}
    for t in texts:
        for c in re.findall(r"\S+|\s+", t):
            for i in plain(c, table, 5):
                want[i] = want.get(i, 0) + 1
    assert {r["token_id"]: r["n"] for r in counts.collect()} == want
    m = M.language_metrics(docs.where("text <> ''"), vocab).collect()
    assert len(m) == 1 and m[0]["total_bytes"] == len("\n".join(t for t in texts if t))
