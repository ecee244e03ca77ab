"""Script sets and whitespace predicates (F8-F11) as Spark expressions vs. the plain rule."""

import random

import pytest
from pyspark.sql import functions as F

from tokscope.functions import scalars as S
from tokscope.functions import unicode_classes as uc

EXACT = [
    ("hello", {"Latin"}),
    ("Привет", {"Cyrillic"}),
    ("你好", {"Chinese"}),
    ("こんにちは", {"Japanese"}),
    ("カタカナ", {"Japanese"}),
    ("안녕", {"Korean"}),
    ("مرحبا", {"Arabic"}),
    ("नमस्ते", {"Devanagari"}),
    ("שלום", {"Hebrew"}),
    ("Γειά", {"Greek"}),
    ("123", {"Numbers"}),
    ("!?.,", {"Punctuation"}),
    ("$+", {"Symbols"}),
    ("𝔸", {"Symbols"}),
    ("hello世界", {"Latin", "Chinese"}),
    ("", set()),
    ("   ", set()),
    ("สวัสดี", {"Thai", "Chinese"}),  # 'HAN' in a Thai character name
    ("々", set()),
    ("ー", {"Japanese"}),
    ("é", {"Latin"}),
]


def test_scripts_exact(spark):
    df = spark.createDataFrame([(t,) for t, _ in EXACT], "t string")
    got = [set(r[0]) for r in df.select(S.unicode_scripts(F.col("t"))).collect()]
    assert got == [e for _, e in EXACT]
    for t, e in EXACT:
        assert uc.py_scripts(t) == e


WS_CASES = [
    ("hello world", False, True),
    (" hello", True, False),
    ("hello ", False, False),
    ("\thello", True, False),
    ("a\tb", False, True),
    ("a　b", False, True),
    ("\x1cab", True, False),
    ("a\x85b", False, True),
    ("", False, False),
    ("   ", True, False),
    ("\r\nx", True, False),
    ("a\fb\vc", False, True),
]


@pytest.mark.parametrize("text,starts,inner", WS_CASES)
def test_whitespace_predicates(spark, text, starts, inner):
    r = spark.createDataFrame([(text,)], "t string").select(
        S.starts_with_whitespace(F.col("t")), S.has_inner_whitespace(F.col("t"))
    ).first()
    assert (r[0], r[1]) == (starts, inner)
    assert starts == bool(text and text[0].isspace())
    assert inner == bool(text.strip() and any(c.isspace() for c in text.strip()))


def test_random_strings_match_python(spark):
    rng = random.Random(7)
    alphabet = "ab é世ー \t\n\x1c　!1$Ж" + "́พ\U0001d538"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        "t", S.unicode_scripts(F.col("t")).alias("s"), S.starts_with_whitespace(F.col("t")).alias("a"),
        S.has_inner_whitespace(F.col("t")).alias("b"), F.size(S.character_units(F.col("t"))).alias("c"),
        F.size(S.whitespace_units(F.col("t"))).alias("w"),
    ).collect()
    for r in rows:
        t = r["t"]
        assert set(r["s"]) == uc.py_scripts(t)
        assert r["a"] == bool(t and t[0].isspace())
        assert r["b"] == bool(t.strip() and any(c.isspace() for c in t.strip()))
        assert r["c"] == len([c for c in t if not c.isspace() and c.isprintable()])
        assert r["w"] == len(t.split())


def test_character_database_version():
    """Class sizes at the committed version; a new Python brings a new database, and this test must be looked at."""
    import unicodedata

    assert unicodedata.unidata_version == uc.UNICODE_VERSION
    sizes = {label: sum(b - a + 1 for a, b in uc._tables()[label]) for label in uc.SCRIPT_LABELS}
    assert sizes == SIZES


#: Code points per label at UNICODE_VERSION.
SIZES = {'Korean': 11677, 'Japanese': 287, 'Chinese': 98809, 'Latin': 1373, 'Cyrillic': 505, 'Arabic': 1133, 'Devanagari': 143, 'Thai': 64, 'Hebrew': 127, 'Greek': 353, 'Punctuation': 832, 'Symbols': 8928, 'Numbers': 1781}
