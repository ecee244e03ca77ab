"""Work that must not grow faster than the tables: classes for Java, folds of characters, arrivals in many files."""

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokscope.functions import scalars as S
from tokscope.functions import unicode_classes as uc
from tokscope.operators import encode as EN
from tokscope.operators import metrics as M
from tokscope.operators import tokens as TK
from tokscope.operators.tokenizers import CHAR_PATTERN, NativeTokenizer, learn_vocab
from tokscope.plans import queries_reports as QR
from tokscope.session import ensure_checkpoint_dir
from tokscope.streaming import stream as ST

TEXTS = ["the cat the dog", "Ein Käse, 12 Mäuse!", "語学 　 日本​語", " \xa0a\x1c", "\x00\x7f\n\n", "zz the"]
TOKENIZERS = [
    NativeTokenizer("bytes", CHAR_PATTERN),
    NativeTokenizer("chars", CHAR_PATTERN, char_slots=9),
    NativeTokenizer("words", uc.words_piece_pattern(), char_slots=5, word_slots=4, bos=True, covers=True),
]


def _docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)


def test_java_classes_hold_the_same_code_points(spark):
    cps = spark.range(0x110000).where("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    cjk = [(a, a) for a in range(0x4E00, 0x4F00, 2)]  # more ranges than one nested class holds
    got = cps.select(
        F.sum((F.size(S.whitespace_units(F.col("c"))) != F.col("c").rlike(uc.whitespace_unit_pattern()).cast("int")).cast("int")),
        F.sum((S.character_unit_count(F.col("c")) != F.col("c").rlike(uc.character_unit_pattern()).cast("int")).cast("int")),
        F.sum((F.col("c").rlike(uc.java_class([(97, 122), *cjk])) != F.col("id").isin(*range(97, 123), *[a for a, _ in cjk])).cast("int")),
    ).first()
    assert tuple(got) == (0, 0, 0)


def test_characters_are_encoded_once_each(spark, monkeypatch):
    seen, encode = [], EN.encode_pieces
    monkeypatch.setattr(EN, "encode_pieces", lambda p, *a: seen.append(p) or encode(p, *a))
    docs = _docs(spark)
    vocab = learn_vocab(docs, TOKENIZERS)
    counts = {tuple(r) for r in EN.token_counts(docs, vocab, []).collect()}
    rows = seen[0].where("tokenizer = 'chars'").collect()
    assert len(rows) == len({r["piece"] for r in rows}) == len(set("".join(TEXTS)))
    each = EN.token_stream(docs, vocab, ["doc_id"]).groupBy("tokenizer", "token_id").agg(F.count(F.lit(1)).alias("n"))
    assert counts == {tuple(r) for r in each.collect()}


def test_stream_counters_of_known_pieces_correct_those_of_characters(spark):
    docs = _docs(spark)
    vocab = learn_vocab(docs, TOKENIZERS)
    words = ST.replace(vocab, tokenizers=TOKENIZERS[2:])
    both = ST.character_contributions(docs, words).unionByName(
        ST.pieces(docs, TOKENIZERS[2:], []).join(ST.known_pieces(words), ["tokenizer", "piece"]).select("tokenizer", *ST.COUNT_COLUMNS)
    )
    assert ST.summed(both).collect() == ST.counters(ST.document_tokens(docs, words), words).collect()


def test_sampled_units_are_cut_once(spark, monkeypatch):
    cut, stats = [], M.split_stats
    monkeypatch.setattr(M, "split_stats", lambda units, *a: cut.append(units) or stats(units, *a))
    docs = _docs(spark).selectExpr("'a' lang_key", "'eng' iso_code", "'Latn' script", "'English' language", "'s' source", "doc_id", "text")
    M.language_metrics(docs, learn_vocab(docs, TOKENIZERS)).collect()
    assert "regexp" not in cut[0]._jdf.queryExecution().optimizedPlan().toString().lower()


def test_an_arrival_is_as_many_files_as_its_text_asks_for(spark, monkeypatch, tmp_path):
    docs = spark.range(400).selectExpr("id doc_id", "repeat('word ', 20) text", "'en' lang", "'s' source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(QR, "STREAM_FILE_BYTES", 2500)
    folder, _, k = QR._arriving(spark, str(tmp_path))
    folder = folder.removeprefix("file://").removeprefix("file:")
    files = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    assert k == 4 and len(files) == k * QR.STREAM_FILES and ensure_checkpoint_dir(spark)
    sizes = [spark.read.parquet(os.path.join(folder, f)).agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first() for f in files]
    assert all(a[1] < b[0] for a, b in zip(sizes, sizes[1:])) and max(s[2] for s in sizes) <= 60
    times = [os.path.getmtime(os.path.join(folder, f)) for f in files]
    assert times == sorted(times)


def test_codes_of_earlier_blocks_are_let_go():
    from tokscope.llm import collocations as CO

    words = CO.Words()
    words.of(b" ".join(b"w%d" % i for i in range(150_000)))
    words.of(b"a")
    assert len(words.codes.words) <= 2 and CO.BLOCK_BYTES <= 2 << 20


def test_classes_for_java_are_entered_by_their_own_code_points_only():
    for ranges in (uc._tables()["PRINTABLE"], uc._others(uc._tables()["PRINTABLE"])):
        members = uc.java_class(ranges)
        depth = top = 0
        for a, b in zip(members, members[1:]):
            depth += (a == "[") - (a == "]")
            top += depth == 1 and b == "["
        assert top <= 2  # Latin-1 and the others: an ASCII character passes no longer chain


def test_unit_counts_equal_the_units(spark):
    texts = [(t,) for t in [*TEXTS, "", None, "བོད་ཡིག་ x་ ་་​", "་", " \n", "\U0001f600͸a\U0001f600"]]
    t, old = F.col("t"), F.regexp_extract_all("t", F.lit(uc.character_unit_pattern()), 0)
    no_tsheg = F.filter(old, lambda c: c != S.TSHEG)
    pairs = [
        (S.character_units(t), old), (S.character_unit_count(t), F.size(old)), (S.joined_character_units(t, "|"), F.array_join(old, "|")),
        (S.character_units_without_tsheg(t), no_tsheg), (S.character_unit_count_without_tsheg(t), F.size(no_tsheg)),
        (S.syllable_unit_count(t), F.size(S.syllable_units(t))),
    ]
    rows = spark.createDataFrame(texts, "t string").select(*[F.struct(a.alias("a"), b.alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).collect()
    assert all(p["a"] == p["b"] for r in rows for p in r) and len(rows) == len(texts)


def test_character_units_cut_out_the_rest(spark):
    plans = [spark.range(1).select(f(F.col("id").cast("string"))) for f in (S.character_units, S.character_unit_count, S.syllable_unit_count)]
    said = [p._jdf.queryExecution().optimizedPlan().toString() for p in plans]
    assert all("regexp_extract_all" not in x for x in said[:2]) and "regexp_replace" not in said[2]


def test_texts_are_scanned_once_for_syllables_and_the_catalogue(spark, monkeypatch, tmp_path):
    from tokscope.plans import queries_catalog as QC
    from tokscope.sources import catalog as CAT

    spark.createDataFrame([(1, "a་b་c་d", "bo", "s"), (2, "xy z", "en", "s"), (3, "q", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    u = QC.q_units_syllable(spark, str(tmp_path))
    cat = CAT.natural_catalogue(spark, str(tmp_path))
    assert not u.inputFiles() and not cat.inputFiles()
    assert {(r.doc_id, r.n_syl, r.n_syl_chars, r.n_units) for r in u.collect()} == {(1, 4, 4, 4), (2, 1, 3, 3), (3, 1, 1, 1)}


def test_characters_of_pieces_are_one_row_for_all_tokenizers(spark, monkeypatch):
    seen, encode = [], EN.encode_pieces
    monkeypatch.setattr(EN, "encode_pieces", lambda p, *a: seen.append(p) or encode(p, *a))
    docs = _docs(spark)
    vocab = learn_vocab(docs, TOKENIZERS)
    EN.token_counts(docs, vocab, []).collect()
    words = seen[0].where("tokenizer = 'words' and ids is null").collect()  # unknown pieces come as distinct characters too
    assert words and all(len(r["piece"]) == 1 for r in words) and len(words) == len({r["piece"] for r in words})


def test_sampled_characters_are_read_by_position(spark):
    docs = spark.createDataFrame([("en", 0, "aääbé語語x\U0001f600\U0001f600z\n" * 3), ("en", 1, "ä"), ("fr", 2, "語a" * 1500)], "lang_key string, doc_id long, text string")
    vocab = learn_vocab(spark.createDataFrame([("aaä語bb",)], "text string"), TOKENIZERS[:2])
    vocab2 = learn_vocab(spark.createDataFrame([("abcd",)], "text string"), TOKENIZERS[:2])
    heads = docs.groupBy("lang_key").agg(F.min("doc_id").alias("first_doc"))
    for v in (vocab, vocab2):
        for most in (7, 40, 10_000):
            got = TK.even_sample_tokens(docs, v, heads, max_tokens=most)
            stream = EN.token_stream(docs, v, ["lang_key", "doc_id"])
            w = Window.partitionBy("tokenizer", "lang_key").orderBy("doc_id", "pidx", "cidx", "bidx")
            all_ids = stream.withColumn("tpos", F.row_number().over(w) - 1)
            n = all_ids.groupBy("tokenizer", "lang_key").agg(F.count(F.lit(1)).alias("n"))
            step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
            want = all_ids.join(n, ["tokenizer", "lang_key"]).where((F.col("tpos") % step == 0) & (F.floor(F.col("tpos") / step) < most))
            cols = ["tokenizer", "lang_key", "tpos", "token_id"]
            assert {tuple(r) for r in got.select(*cols).collect()} == {tuple(r) for r in want.select(*cols).collect()}
            assert got.count() == want.count()


def test_stretches_of_a_repeated_key_are_one(spark):
    docs = spark.createDataFrame([("en", 0, "aä"), ("en", 0, "bä"), ("en", 1, "aab")], "lang_key string, doc_id long, text string")
    vocab = learn_vocab(spark.createDataFrame([("aab",)], "text string"), TOKENIZERS[1:2])
    heads = docs.groupBy("lang_key").agg(F.min("doc_id").alias("first_doc"))
    got = {r.tpos: r.token_id for r in TK.even_sample_tokens(docs, vocab, heads).collect()}
    assert got == dict(enumerate([256, 257, 0xC3, 0xA4, 0xC3, 0xA4, 256, 256, 257]))
