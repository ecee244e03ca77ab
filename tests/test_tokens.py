"""Global token metrics (tracker sets of FIXTURES 4), encoder invariants, vocabulary analysis."""

import pytest
from pyspark.sql import functions as F

from tokscope.operators import encode as EN
from tokscope.operators import tokens as TK
from tokscope.operators.tokenizers import CHAR_PATTERN, NativeTokenizer, learn_vocab, table_vocab
from tokscope.sources import text as T
from tokscope.functions import unicode_classes as uc

TOK = NativeTokenizer("mock", uc.whitespace_unit_pattern())


def glong(spark, batches):
    """Tracker over token texts: every text is its own id in a decode table."""
    texts = sorted({t for b in batches for t in b})
    ids = {t: i for i, t in enumerate(texts)}
    vocab = table_vocab(spark, [], [TOK], decode_rows=[("mock", i, t) for t, i in ids.items()])
    occ = spark.createDataFrame([("mock", ids[t]) for b in batches for t in b], "tokenizer string, token_id int")
    out = TK.global_metrics_long(TK.annotate(occ, vocab, keep_empty=True)).collect()
    return {r["metric"]: r["value"] for r in out}


def test_basic_tokens(spark):
    m = glong(spark, [[" hello", "world", "!"]])
    assert m["total_tokens_analyzed"] == 3
    assert m["tokens_starting_with_space_pct"] == pytest.approx(100 / 3)
    assert m["tokens_with_whitespace_in_middle_pct"] == 0
    assert m["tokens_with_script_overlap_pct"] == 0
    assert m["tokens_with_latin_unicode_pct"] == pytest.approx(200 / 3)
    assert m["tokens_with_punctuation_unicode_pct"] == pytest.approx(100 / 3)
    assert "tokens_with_chinese_unicode_pct" not in m  # zero-count scripts are absent


def test_mixed_tokens(spark):
    m = glong(spark, [["hello世界", " пример", "test\tmulti"]])
    assert m["tokens_with_script_overlap_pct"] == pytest.approx(100 / 3)
    assert m["tokens_with_whitespace_in_middle_pct"] == pytest.approx(100 / 3)
    assert m["tokens_starting_with_space_pct"] == pytest.approx(100 / 3)
    assert m["tokens_with_latin_unicode_pct"] == pytest.approx(200 / 3)
    assert m["tokens_with_chinese_unicode_pct"] == pytest.approx(100 / 3)
    assert m["tokens_with_cyrillic_unicode_pct"] == pytest.approx(100 / 3)


def test_incremental_equals_together(spark):
    assert glong(spark, [[" test"], ["data"]]) == glong(spark, [[" test", "data"]])
    m = glong(spark, [[" test"], ["data"]])
    assert m["total_tokens_analyzed"] == 2 and m["tokens_starting_with_space_pct"] == 50 and m["tokens_with_latin_unicode_pct"] == 100


def test_empty_has_no_metrics(spark):
    assert glong(spark, []) == {}


@pytest.fixture(scope="module")
def real(spark):
    from tokscope.plans import context as C

    return C.documents(spark, "/root/testdata/sf0.001"), C.vocab(spark, "/root/testdata/sf0.001")


def test_fold_equals_stream(spark, real):
    docs, vocab = real
    folded = EN.token_counts(docs.select("lang_key", "text"), vocab, ["lang_key"])
    direct = EN.token_stream(docs.select("lang_key", "text"), vocab, ["lang_key"]).groupBy("tokenizer", "lang_key", "token_id").count()
    a = {(r[0], r[1], r[2]): r[3] for r in folded.collect()}
    b = {(r[0], r[1], r[2]): r[3] for r in direct.collect()}
    assert a == b


def test_bytes_tokenizer_counts_bytes_and_class_count_matches(spark, real):
    docs, vocab = real
    per_doc = TK.tokens_per_doc(docs.select("doc_id", "text"), vocab, ["doc_id"])
    stream = EN.token_stream(docs.select("doc_id", "text"), vocab, ["doc_id"]).groupBy("tokenizer", "doc_id").count()
    a = {(r[0], r[1]): r[2] for r in per_doc.collect()}
    b = {(r[0], r[1]): r[2] for r in stream.collect()}
    assert a == b
    nbytes = {r[0]: r[1] for r in docs.select("doc_id", F.octet_length("text")).collect()}
    assert all(a[("bytes", d)] == n for d, n in nbytes.items())


def test_vocab_analysis_stride_and_examples(spark):
    toks = [NativeTokenizer("c", CHAR_PATTERN, char_slots=20)]
    vocab = learn_vocab(spark.createDataFrame([("ab ab  cd",)], "text string"), toks)
    r = TK.vocab_analysis(vocab).first()
    # V = 276 ids, stride 1; decodable ids: 128 ASCII bytes + 5 learned chars (unfilled slots and high bytes are NULL)
    assert r["vocab_size"] == 276
    assert r["analyzed_sample_size"] == 133
    assert len(r["sample_non_space_tokens"]) == 10
    assert r["sample_space_tokens"] == [" ", " "]  # byte 32 and the learned space character


def test_token_sample_reads_the_texts_twice(spark, real):
    """One scan for the rank index, one for the sampled stretches."""
    docs, vocab = real
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    one = docs.select("lang_key", "doc_id", counted("text").alias("text"))
    firsts = docs.groupBy("lang_key").agg(F.min("doc_id").alias("first_doc"))
    got = {tuple(r) for r in TK.even_sample_tokens(one, vocab, firsts, max_tokens=50).collect()}
    n = docs.count()
    assert n < seen.value <= 2 * n
    assert got == {tuple(r) for r in TK.even_sample_tokens(docs, vocab, firsts, max_tokens=50).collect()}


def test_token_sample_equals_the_token_stream(spark, monkeypatch):
    """Every tokenizer kind, short stretches, unknown characters, gaps between pieces, several samples in one piece."""
    from pyspark.sql import Window

    monkeypatch.setattr(TK, "INDEX_PIECES", 3)
    monkeypatch.setattr(TK, "INDEX_CHARS", 7)
    texts = ["aa bb  cc dd ee aa", "", "日本 aa é zz\n\t ab", "b" * 40, "unknownword aa unknownword", " ", "é" * 9 + "a" * 9]
    docs = spark.createDataFrame([("x" if i % 3 else "y", i, t) for i, t in enumerate(texts * 3)], "lang_key string, doc_id long, text string")
    toks = [
        NativeTokenizer("bytes", CHAR_PATTERN),
        NativeTokenizer("chars", CHAR_PATTERN, char_slots=3),
        NativeTokenizer("words", uc.words_piece_pattern(), char_slots=2, word_slots=3, bos=True, covers=True),
        NativeTokenizer("gaps", uc.whitespace_unit_pattern(), char_slots=2, word_slots=2),
    ]
    vocab = learn_vocab(spark.createDataFrame([("aa bb aa  cc aa b a",)], "text string"), toks)
    stream = EN.token_stream(docs, vocab, ["lang_key", "doc_id"])
    w = Window.partitionBy("tokenizer", "lang_key").orderBy("doc_id", "pidx", "cidx", "bidx")
    rows = stream.withColumn("pos", F.row_number().over(w) - 1).collect()
    seqs = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        seqs.setdefault((r["tokenizer"], r["lang_key"]), []).append(r["token_id"])
    firsts = docs.groupBy("lang_key").agg(F.min("doc_id").alias("first_doc"))
    for most in (1, 5, 40, 10_000):
        want = set()
        for (tok, lang), ids in seqs.items():
            ids = ([toks[2].bos_id] if tok == "words" else []) + ids
            step = max(1, len(ids) // most)
            want |= {(tok, lang, p, ids[p]) for p in range(0, len(ids), step) if p // step < most}
        got = [tuple(r) for r in TK.even_sample_tokens(docs, vocab, firsts, max_tokens=most, block_size=5).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_character_counts_make_no_row_per_character_of_the_corpus(spark, real):
    """The fold of character-level tokenizers runs over covering pieces, with or without a word tokenizer beside them."""
    docs, vocab = real
    stream = EN.token_stream(docs.select("lang_key", "text"), vocab, ["lang_key"]).groupBy("tokenizer", "lang_key", "token_id").count()
    want = {tuple(r) for r in stream.collect() if r[0] != "words"}
    alone = type(vocab)(words=vocab.words, chars=vocab.chars, tokenizers=[t for t in vocab.tokenizers if t.char_level])
    counts = EN.token_counts(docs.select("lang_key", "text"), alone, ["lang_key"])
    got = {(r["tokenizer"], r["lang_key"], r["token_id"], r["n"]) for r in counts.collect()}
    assert {(t, g, i, n) for g, t, i, n in want} == got or want == got
    pieces = EN.piece_counts(docs.select("lang_key", "text"), alone.tokenizers, ["lang_key"], covering=True)
    assert pieces.where(F.length("piece") > 1).count() > 0
    assert CHAR_PATTERN not in pieces._jdf.queryExecution().optimizedPlan().toString()
