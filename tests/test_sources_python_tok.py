"""S1/S8 CSV round trip; D1 python tokenizers: fold-encode-fanout equals direct encoding."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tokscope.functions import unicode_classes as uc
from tokscope.operators import encode as EN
from tokscope.operators.tokenizers import python_vocab
from tokscope.sources import catalog as CAT


def test_catalogue_csv_trimmed_and_ordered(spark):
    d = tempfile.mkdtemp(prefix="tokscope-csv-")
    path = os.path.join(d, "cat.csv")
    with open(path, "w") as f:
        f.write(" Name , Script,ISO 639-3 code ,Disk size,Subset\n")
        f.write("French,Latn,fra,1.2 TB,fra_Latn\nTotal,,Total,9 TB,\nGerman,Latn,deu,800 GB,deu_Latn\n")
    cat = CAT.read_catalogue_csv(spark, path)
    assert cat.columns[:5] == ["Name", "Script", "ISO 639-3 code", "Disk size", "Subset"]
    assert [r["Name"] for r in cat.orderBy("catalog_pos").collect()] == ["French", "Total", "German"]
    out = os.path.join(d, "out")
    CAT.write_csv(cat.withColumn("arr", F.array(F.lit("a"), F.lit("b"))), out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 3 and set(r["arr"] for r in back.collect()) == {'["a","b"]'}


def test_python_tokenizer_fold_equals_direct(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    texts = ["the cat sat on the mat", "the dog ate the cat food", "a mat for a cat and a dog"] * 5
    tok = Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tok.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=60, special_tokens=["[UNK]"]))
    path = os.path.join(tempfile.mkdtemp(prefix="tokscope-bpe-"), "tokenizer.json")
    tok.save(path)

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pattern = uc.whitespace_unit_pattern()
    from tokscope.operators.tokenizers import PythonTokenizer

    spec = PythonTokenizer("bpe", pattern, path)
    ps = EN.pieces(docs, [spec], ["doc_id"])
    vocab = python_vocab(ps, "bpe", path, pattern)
    counts = {r["token_id"]: r["n"] for r in EN.token_counts(docs.select(F.lit(0).alias("g"), "text"), vocab, ["g"]).collect()}
    direct: dict[int, int] = {}
    for t in texts:
        for i in tok.encode(t, add_special_tokens=False).ids:
            direct[i] = direct.get(i, 0) + 1
    assert counts == direct
    # decode table covers the whole vocabulary; vocabulary analysis runs on it
    from tokscope.operators import tokens as TK

    assert vocab.decoded(spark).count() == tok.get_vocab_size()
    va = TK.vocab_analysis(vocab).first()
    assert va["vocab_size"] == tok.get_vocab_size() and va["analyzed_sample_size"] > 0


def test_result_documents_roundtrip_lenient_and_strict(spark):
    from pyspark.sql import functions as F

    from tokscope.operators import results as RS

    metrics = spark.createDataFrame(
        [("tk", "eng-Latn", "eng", "Latn", "English", "documents", 2.5, 10, 4, 3, 1.5, 0.0, 50.0, 0.0, "whitespace", 2, 1)],
        "tokenizer string, lang_key string, iso_code string, script string, language string, source string, bytes_per_token double, "
        "total_bytes long, total_tokens long, unique_tokens long, subword_fertility double, continued_word_rate double, "
        "word_split_pct double, continuation_token_pct double, segmentation_method string, total_units long, estimated_units_split long",
    )
    va = spark.createDataFrame([("tk", 3, 50.0, 6, ["a"], [" b"])],
                               "tokenizer string, tokens_without_leading_space_count long, tokens_without_leading_space_pct double, "
                               "analyzed_sample_size long, sample_non_space_tokens array<string>, sample_space_tokens array<string>")
    gl = spark.createDataFrame([("tk", "total_tokens_analyzed", 4.0), ("tk", "tokens_with_latin_unicode_pct", 75.0)], "tokenizer string, metric string, value double")
    sizes = spark.createDataFrame([("tk", 100)], "tokenizer string, vocab_size bigint")
    docs = RS.build_documents(metrics, va, gl, sizes, 2.0, 0.0)
    path = tempfile.mkdtemp(prefix="tokscope-res-") + "/r"
    RS.write_documents(docs, path)
    with open(os.path.join(path, "broken.json"), "w") as f:
        f.write("{not json")
    flat = RS.flatten(RS.read_documents(spark, path)).collect()
    assert len(flat) == 1
    r = flat[0]
    assert r["tokenizer_key"] == "tk" and r["benchmark_size_mb"] == 2.0 and r["datetime"] is None
    assert r["tokens_with_latin_unicode_pct"] == 75.0 and r["tokens_with_greek_unicode_pct"] is None
    assert RS.read_documents(spark, path).count() == 1  # a second read, and one of no column
    assert [r["tokenizer_key"] for r in RS.rejected_documents(spark, path).collect()] == ["broken"]
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING|FAILFAST"):
        RS.read_documents(spark, path, strict=True).collect()
    RS.write_documents(docs, path + "-pq", "parquet")
    assert spark.read.parquet(path + "-pq").select("tokenizer", "tokenizer_key").collect() == [("tk", "tk")]


def test_indented_result_file_and_stem_key(spark, tmp_path):
    import json

    from tokscope.operators import results as RS

    entry = {"language_info": {"name": "English", "iso_code": "eng", "script": "Latn", "source": "s"}, "metrics": {"bytes_per_token": 2.5, "total_bytes": 10}}
    body = {"tokenizer": "org/gpt-2", "vocab_size": 7, "languages": {"eng-Latn": entry}, "global_metrics": {}}
    (tmp_path / "my stem.json").write_text(json.dumps(body, indent=2))
    for strict in (False, True):
        rows = RS.flatten(RS.read_documents(spark, str(tmp_path), strict)).collect()
        assert [(r["tokenizer_key"], r["tokenizer_name"], r["bytes_per_token"]) for r in rows] == [("my stem", "org/gpt-2", 2.5)]
    assert RS.rejected_documents(spark, str(tmp_path)).count() == 0
