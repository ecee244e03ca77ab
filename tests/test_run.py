"""The budgeted run over awkward work lists, the source registry, and refused texts."""


import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tokscope.operators import metrics as M
from tokscope.operators import report as R
from tokscope.operators import results as RS
from tokscope.operators import run as RUN
from tokscope.operators.tokenizers import CHAR_PATTERN, NativeTokenizer, learn_vocab
from tokscope.functions import unicode_classes as uc
from tokscope.sources import catalog as CAT
from tokscope.sources import registry as REG

WORK = "position int, lang_key string, iso_code string, script string, name string, source string, data_dir string"


@pytest.fixture(scope="module")
def vocab(spark):
    toks = [NativeTokenizer("bytes", CHAR_PATTERN), NativeTokenizer("words", uc.words_piece_pattern(), char_slots=20, word_slots=20, bos=True, covers=True)]
    return learn_vocab(spark.createDataFrame([("one two three one two one testing tokenizer",)], "text string"), toks)


def test_run_accounts_for_every_language(spark, vocab):
    work = spark.createDataFrame(
        [
            (0, "eng-Latn", "eng", "Latn", "English", "fineweb", None),
            (1, "eng-Latn", "eng", "Latn", "English again", "fineweb2", None),
            (2, "kor-Hang", "kor", "Hang", "Korean", "fineweb2", None),
            (3, "und-Zyyy", "und", "Zyyy", "Unknown", "fineweb2", None),
            (4, None, None, "Latn", "Nameless", "fineweb2", None),
            (5, "deu-Latn", "deu", "Latn", "German", "fineweb2", None),
            (6, "sql-code", "sql", "code", "Sql (code)", "starcoder", "sql"),
        ],
        WORK,
    )
    rows = [("eng-Latn", i, "one two " * 40, None) for i in range(9)] + [("und-Zyyy", 0, "lost", None), ("sql-code", 0, "select 1", None), ("sql-code", 1, "é" * 400, None)]
    rows += [("deu-Latn", 0, "eins", None), ("deu-Latn", 1, None, REG.UNREADABLE), ("xxx-Latn", 0, "not on the list", None)]
    texts = spark.createDataFrame(rows, "lang_key string, doc_id long, text string, problem string")
    run = RUN.benchmark_run(work, texts, vocab, 700, 1_700_000_000.0)
    got = {r["position"]: (r["status"], r["reason"], r["n_docs"]) for r in run.languages.collect()}
    assert got == {
        0: (RUN.OK, None, 9),
        1: (RUN.ERROR, RUN.DUPLICATE, 9),
        2: (RUN.FALLBACK, RUN.NO_TEXT, 0),
        3: (RUN.ERROR, RUN.UNKNOWN, 1),
        4: (RUN.ERROR, RUN.UNKNOWN, 0),
        5: (RUN.ERROR, REG.UNREADABLE, 1),
        6: (RUN.OK, None, 2),
    }
    text = {}
    for r in sorted(run.corpus.collect(), key=lambda r: (r["lang_key"], r["doc_id"])):
        text[r["lang_key"]] = text[r["lang_key"]] + "\n" + r["text"] if r["lang_key"] in text else r["text"]
    assert text.keys() == {"eng-Latn", "kor-Hang", "sql-code"}
    assert text["eng-Latn"] == "\n".join(["one two " * 40] * 9)[:700]
    assert text["kor-Hang"] == ("Sample text for Korean tokenizer testing. " * 20)[:700]
    assert text["sql-code"] == ("select 1\n" + "é" * 400).encode()[:700].decode(errors="ignore")
    flat = {(r["tokenizer_name"], r["lang_key"]): r for r in RS.flatten(run.documents).collect()}
    assert len(flat) == 6
    for (tok, lang), r in flat.items():
        assert r["total_bytes"] == len(text[lang].encode()) and r["benchmark_size_mb"] == 700 / (1024 * 1024)
        assert r["sample_text"] and r["sample_text"] in text[lang]
        # characters that these tokenizers only know by their bytes do not decode
        assert bool(r["sample_token_count"]) == any(ord(c) < 128 for c in r["sample_text"])
        assert tok != "bytes" or r["total_tokens"] == r["total_bytes"]
    info = run.documents.select(F.explode("languages").alias("k", "v")).select("k", "v.language_info.data_dir", "v.language_info.name").distinct().collect()
    assert {(r["k"], r["data_dir"], r["name"]) for r in info} == {("eng-Latn", None, "English"), ("kor-Hang", None, "Korean"), ("sql-code", "sql", "Sql (code)")}


def test_registry_reads_by_kind(spark, tmp_path, capsys):
    root = str(tmp_path)
    registry = REG.Registry()
    registry.register("notes", REG.SourceKind("json", "body", "{iso_code}"))
    registry.register("sheets", REG.SourceKind("csv", "text", "{iso_code} x", {"multiLine": "true", "escape": '"'}))
    registry.register("plain", REG.SourceKind("text", "value", "all"))
    (tmp_path / "notes" / "eng").mkdir(parents=True)
    (tmp_path / "notes" / "eng" / "a.json").write_text('{"body": "é one", "x": 1}\n{"body": null}\n{"body": ""}\nnot json\n{"x": 2}\n')
    (tmp_path / "sheets" / "deu x").mkdir(parents=True)
    (tmp_path / "sheets" / "deu x" / "b.csv").write_text('n,text,more\n1,"eins\n""zwei""",x\n2,,y\n3,drei,z\n')
    (tmp_path / "plain" / "all").mkdir(parents=True)
    (tmp_path / "plain" / "all" / "c.txt").write_text("l1\n\nl2\n")
    spark.createDataFrame([("sel 1", 1), (None, 2)], "content string, other int").write.parquet(f"{root}/starcoder/sql")
    work = spark.createDataFrame(
        [
            (0, "eng-Latn", "eng", "Latn", "E", "notes", None),
            (1, "deu-Latn", "deu", "Latn", "D", "sheets", None),
            (2, "fra-Latn", "fra", "Latn", "F", "plain", None),
            (3, "sql-code", "sql", "code", "S", "starcoder", "sql"),
            (4, "kor-Hang", "kor", "Hang", "K", "fineweb2", None),
            (5, "zzz-Latn", "zzz", "Latn", "Z", "nowhere", None),
        ],
        WORK,
    )
    rows = sorted(((r["lang_key"], r["text"], r["problem"]) for r in registry.scan_all(spark, root, work).collect()), key=str)
    assert rows == sorted(
        [
            ("eng-Latn", "é one", None),
            ("eng-Latn", None, REG.UNREADABLE),
            ("deu-Latn", 'eins\n"zwei"', None),
            ("deu-Latn", "drei", None),
            ("fra-Latn", "l1", None),
            ("fra-Latn", "l2", None),
            ("sql-code", "sel 1", None),
            ("zzz-Latn", None, "unknown source: nowhere"),
        ],
        key=str,
    )
    one = registry.scan(spark, root, {"lang_key": "sql-code", "iso_code": "sql", "script": "code", "source": "starcoder", "data_dir": "sql"})
    assert [r["text"] for r in one.collect()] == ["sel 1"]
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<content:string>" in plan and "other" not in plan
    with pytest.raises(ValueError, match="unknown source: nowhere"):
        registry.scan(spark, root, {"lang_key": "z", "iso_code": "z", "script": "z", "source": "nowhere", "data_dir": None})
    with pytest.raises(ValueError, match="unknown format"):
        REG.SourceKind("xml", "text", "x")


def test_code_catalogue_keeps_file_order(spark, tmp_path):
    (tmp_path / "c.csv").write_text(" Language \nzig\nc-sharp\n sql \nada\n")
    rows = CAT.code_languages(spark, 3, CAT.read_code_catalogue(spark, str(tmp_path / "c.csv"))).collect()
    assert [(r["catalog_pos"], r["iso_code"], r["name"], r["data_dir"]) for r in sorted(rows)] == [
        (0, "zig", "Zig (code)", "zig"),
        (1, "c-sharp", "C-Sharp (code)", "c-sharp"),
        (2, "sql", "Sql (code)", "sql"),
    ]


def test_wrapper_refuses_empty_texts_and_names(spark, vocab):
    rows = spark.createDataFrame([(1, "eng", "Latn", "one two"), (2, "eng", "Latn", None), (3, "eng", "Latn", ""), (4, None, None, "two  one ")], "id int, iso_code string, script string, text string")
    assert {(r["reason"], r["n"]) for r in M.text_violations(rows, []).collect()} == {("text is None", 1), ("text is empty", 1)}
    with pytest.raises(PySparkException, match="text cannot be empty or None"):
        M.text_metrics(rows, vocab, "id").collect()
    got = {(r["tokenizer"], r["id"]): r for r in M.text_metrics(rows, vocab, "id", strict=False).collect()}
    assert got.keys() == {("bytes", "1"), ("bytes", "4"), ("words", "1"), ("words", "4")}
    assert got["bytes", "1"]["total_tokens"] == 7 and got["words", "1"]["total_units"] == 2 and got["words", "4"]["total_bytes"] == 9
    with pytest.raises(ValueError, match="name cannot be empty"):
        NativeTokenizer("", CHAR_PATTERN)


def test_pivot_drops_what_has_no_value(spark):
    rows = spark.createDataFrame(
        [("a", "x-Latn", 1.0), ("a", "x-Latn", 3.0), ("b", "x-Latn", None), ("b", "y-Latn", None), ("a", "z-Latn", 5.0)], "tokenizer_name string, lang_key string, m double"
    )
    p = R.pivot_metric(rows, "m", ["z-Latn", "y-Latn", "x-Latn", "w-Latn"], ["b", "a", "c"])
    assert p.columns == ["lang_key", "a", "row_pos"]
    assert sorted((r["row_pos"], r["lang_key"], r["a"]) for r in p.collect()) == [(0, "z-Latn", 5.0), (2, "x-Latn", 2.0)]
    assert R.pivot_metric(rows, "m", ["z-Latn"], ["c"]).columns == ["lang_key", "row_pos"]
