"""Word metrics with lookup-table mock tokenizers, segmentation choice (FIXTURES 1-3)."""

import pytest
from pyspark.sql import functions as F

from tokscope.functions import scalars as S
from tokscope.functions import unicode_classes as uc
from tokscope.operators import metrics as M
from tokscope.operators.tokenizers import NativeTokenizer, table_vocab

SIMPLE = NativeTokenizer("simple", uc.whitespace_unit_pattern(), unk_id=999)
SPLITTING = NativeTokenizer("splitting", uc.whitespace_unit_pattern(), unk_id=100)
CHINESE = NativeTokenizer("chinese", f"[^{uc.ws()}]", unk_id=9999)

ROWS = [
    ("simple", "hello", [1]), ("simple", "world", [2]), ("simple", "test", [3]), ("simple", "foo", [4]), ("simple", "bar", [5]),
    ("splitting", "hello", [1, 2]), ("splitting", "world", [3]), ("splitting", "testing", [4, 5, 6]),
    ("chinese", "你", [1001, 1002]), ("chinese", "好", [1003]), ("chinese", "世", [1004, 1005]), ("chinese", "界", [1006]),
]


def metrics_of(spark, tok, text, iso=None, script=None):
    vocab = table_vocab(spark, [r for r in ROWS if r[0] == tok.name], [tok])
    docs = spark.createDataFrame(
        [("k", iso, script, "x", "test", 0, text)], "lang_key string, iso_code string, script string, language string, source string, doc_id long, text string"
    )
    rows = M.language_metrics(docs, vocab, add_special_tokens=False).collect()
    return rows[0] if rows else None


@pytest.mark.parametrize(
    "tok,text,fert,cont,units",
    [
        (SIMPLE, "hello world test", 1.0, 0.0, 3),
        (SIMPLE, "foo bar", 1.0, 0.0, 2),
        (SIMPLE, "hello", 1.0, 0.0, 1),
        (SPLITTING, "hello world", 1.5, 100 / 3, 2),
        (SPLITTING, "testing", 3.0, 200 / 3, 1),
        (SIMPLE, "!@#$%", 1.0, 0.0, 1),
        (SIMPLE, "  hello   world  ", 1.0, 0.0, 2),
    ],
)
def test_word_metrics(spark, tok, text, fert, cont, units):
    r = metrics_of(spark, tok, text)
    assert r["total_units"] == units
    assert r["subword_fertility"] == pytest.approx(fert)
    assert r["continuation_token_pct"] == pytest.approx(cont)
    assert r["segmentation_method"] == "whitespace"


def test_whitespace_only_has_no_units(spark):
    r = metrics_of(spark, SIMPLE, "   \t\n  ")
    assert r is None or (r["total_units"] == 0 and r["subword_fertility"] == 0.0)


@pytest.mark.parametrize(
    "iso,script,text,units,fert,cont",
    [("cmn", "Hani", "你好世界", 4, 1.5, 100 / 3), ("jpn", "Jpan", "你好", 2, 1.5, 100 / 3), ("tha", "Thai", "你好", 2, None, None)],
)
def test_character_segmentation(spark, iso, script, text, units, fert, cont):
    r = metrics_of(spark, CHINESE, text, iso, script)
    assert r["segmentation_method"] == "character"
    assert r["total_units"] == units
    if fert is not None:
        assert r["subword_fertility"] == pytest.approx(fert)
        assert r["continuation_token_pct"] == pytest.approx(cont)


SEGMENTATION = [
    ("cmn", "Hani", "character"), ("zho", "Hans", "character"), ("yue", "Hant", "character"), ("jpn", "Jpan", "character"),
    ("tha", "Thai", "character"), ("eng", "Latn", "whitespace"), ("spa", "Latn", "whitespace"), ("rus", "Cyrl", "whitespace"),
    (None, None, "whitespace"), ("", "", "whitespace"), ("unknown", None, "whitespace"), ("kor", "Hang", "character"),
    ("bod", "Tibt", "syllable"), ("CMN", "Latn", "whitespace"), ("CMN", "Hani", "character"),
]


def test_segmentation_method(spark):
    df = spark.createDataFrame([(i, s) for i, s, _ in SEGMENTATION], "iso string, script string")
    got = [r[0] for r in df.select(S.segmentation_method(F.col("iso"), F.col("script"))).collect()]
    assert got == [m for _, _, m in SEGMENTATION]


def test_syllable_units_and_fallback(spark):
    tok = NativeTokenizer("bytes", "(?s).")
    from tokscope.operators.tokenizers import learn_vocab

    vocab = learn_vocab(spark.createDataFrame([("x",)], "text string"), [tok])
    docs = spark.createDataFrame(
        [("bod-Tibt", "bod", "Tibt", "Tibetan", "t", 0, "ཀ་ཁ་ག་ང"), ("dzo-Tibt", "dzo", "Tibt", "Dz", "t", 1, "ཀ་ཁ")],
        "lang_key string, iso_code string, script string, language string, source string, doc_id long, text string",
    )
    rows = {r["lang_key"]: r for r in M.language_metrics(docs, vocab).collect()}
    assert rows["bod-Tibt"]["total_units"] == 4  # four syllables
    assert rows["dzo-Tibt"]["total_units"] == 2  # < 3 syllables: characters other than the tsheg
    assert rows["bod-Tibt"]["segmentation_method"] == "syllable"
