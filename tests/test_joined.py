"""Rows equal the joined text: pieces, units and samples over document ends; groupings; refused keys."""

import itertools

import pytest
from pyspark.sql import functions as F

from tokscope.functions import scalars as S
from tokscope.operators import metrics as M
from tokscope.operators import segment as SG
from tokscope.operators.encode import token_counts, token_stream, tokens_per_row
from tokscope.operators.joined import token_rows
from tokscope.operators.prefix import blocked, exclusive_prefix_sums
from tokscope.operators.tokenizers import NativeTokenizer, learn_vocab, table_vocab
from tokscope.functions import unicode_classes as uc

SCHEMA = "lang_key string, iso_code string, script string, language string, source string, doc_id long, text string"
WORDS = NativeTokenizer("words", uc.words_piece_pattern(), char_slots=16, word_slots=16)


def source(spark, texts, key="eng-Latn", iso="eng", script="Latn", src="a", ids=None):
    ids = ids or [i * 1_000_003 % 999_983 for i in range(1, len(texts) + 1)]
    return spark.createDataFrame([(key, iso, script, "x", src, i, t) for i, t in zip(sorted(ids), texts)], SCHEMA)


def joined(spark, docs):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    return spark.createDataFrame([("\n".join(r.text for r in rows), 1)], "text string, lang_key int")


@pytest.fixture(scope="module")
def vocab(spark):
    train = spark.createDataFrame([("a \n b  \n\n c a b \n",)] * 3, "text string")
    return learn_vocab(train, [WORDS, NativeTokenizer("bytes", "(?s).")])


CASES = [
    ["a ", "b"],
    ["a", "b"],
    [" a ", "  ", "\n", " b\t", "c "],
    ["  ", "\n"],
    ["  ", "a", "  "],
    ["a  \n", " ", " b"],
    ["x"],
    ["a", " ", " "],
]


@pytest.mark.parametrize("texts", CASES)
def test_rows_encode_as_the_joined_text(spark, vocab, texts):
    docs = source(spark, texts)
    rows = token_rows(docs, ["lang_key"], block_size=2)
    ordered = [r.text for r in sorted(rows.collect(), key=lambda r: r.doc_id)]
    assert "".join(ordered) == "\n".join(texts)
    got = {(r.tokenizer, r.token_id): r.n for r in token_counts(rows, vocab, ["lang_key"]).collect()}
    want = {(r.tokenizer, r.token_id): r.n for r in token_counts(joined(spark, docs), vocab, ["lang_key"]).collect()}
    assert got == want


def test_reproduced_case(spark):
    """Documents 'a ' and 'b' hold the four tokens a, space, newline, b only as one text."""
    v = table_vocab(spark, [("w", "a", [1]), ("w", " \n", [2]), ("w", "b", [3]), ("w", " ", [4]), ("w", "\n", [5])], [NativeTokenizer("w", uc.words_piece_pattern())])
    r = M.language_metrics(source(spark, ["a ", "b"]), v, add_special_tokens=False).first()
    assert (r.total_tokens, r.unique_tokens, r.total_bytes) == (3, 3, 4)


TSHEG_CASES = list(itertools.product(["ཀ", "ཀ་ཁ", "་", "ཀ་", "་ཀ", "  ", "ཀ་ཁ་ག་ང"], repeat=2)) + [("ཀ", "ཁ", "ག"), ("ཀ་ཁ", " ", "ག་ང", "་", "ཅ")]


def test_syllables_over_document_ends(spark):
    rows, want = [], {}
    for n, texts in enumerate(TSHEG_CASES):
        for i, t in enumerate(texts):
            rows.append((f"k{n}", "bod", "Tibt", "x", "s", 7 * i, t))
        whole = "\n".join(texts)
        syllables = [x.strip() for x in whole.split(S.TSHEG) if x.strip()]
        if len(syllables) < S.MIN_SYLLABLES:
            syllables = [c for c in whole if not c.isspace() and c != S.TSHEG]
        want[f"k{n}"] = syllables
    docs = spark.createDataFrame(rows, SCHEMA)
    langs, per_doc = M.language_totals(docs, block_size=3)
    assert {r.lang_key: r.total_units for r in langs.collect()} == {k: len(v) for k, v in want.items()}
    units = SG.sampled_units(docs, per_doc, langs.select("lang_key", "total_units"), ["lang_key"], None, 3)
    got = {}
    for r in units.collect():
        got.setdefault(r.lang_key, []).append((r.upos, r.unit))
    for key, found in got.items():
        assert [u for _, u in sorted(found)] == want[key]
        assert [p for p, _ in sorted(found)] == list(range(len(found)))


def test_other_groupings_and_refused_keys(spark, vocab):
    a = source(spark, ["a b", "c"], src="a", ids=[1, 2])
    b = source(spark, ["d e f"], src="b", ids=[3])
    c = source(spark, ["g"], key="deu-Latn", iso="deu", src="b", ids=[4])
    docs = a.unionByName(b).unionByName(c)
    by_source = {(r.tokenizer, r.source): r for r in M.language_metrics(docs, vocab, ["source"]).collect()}
    assert len(by_source) == 4
    assert by_source["bytes", "a"].total_tokens == 5 and by_source["bytes", "b"].total_tokens == len("d e f\ng")
    assert by_source["bytes", "a"].lang_key == "eng-Latn" and by_source["bytes", "b"].lang_key is None
    both = {(r.lang_key, r.source): r.total_bytes for r in M.language_metrics(docs, vocab, ["lang_key", "source"]).collect()}
    assert both == {("eng-Latn", "a"): 5, ("eng-Latn", "b"): 5, ("deu-Latn", "b"): 1}
    keys = {r.lang_key for r in M.language_metrics(docs, vocab).collect()}
    assert keys == {"deu-Latn"}  # eng-Latn stands for two sources: refused
    assert [(r.lang_key, r.n_kinds) for r in M.language_conflicts(docs).collect()] == [("eng-Latn", 2)]


def test_units_without_tokens_count(spark):
    v = table_vocab(spark, [("e", "x", []), ("e", "y", [1, 2])], [NativeTokenizer("e", uc.whitespace_unit_pattern())])
    rows = spark.createDataFrame([(0, "x"), (1, "y")], "upos int, text string")
    assert sorted((r.upos, r.n_tokens) for r in tokens_per_row(rows, v, ["upos"]).collect()) == [(0, 0), (1, 2)]


def test_prefix_sums_on_sparse_and_struct_order(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("i")).alias("k"), (F.col("id") % 7).alias("v"))
    out, _ = exclusive_prefix_sums(df, ["g"], "k", {"before": "v"}, 50)
    total = 0
    for r in sorted(out.collect(), key=lambda r: r.k):
        assert r.before == total
        total += r.v
    sizes = [r["count"] for r in blocked(df, ["g"], "k", 50).groupBy("g", "_blk").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 200  # a window task has a bounded share of a hot group
