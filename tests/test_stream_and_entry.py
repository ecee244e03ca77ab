"""Stream replay equals batch (X2); the driver contract; catalogue helpers."""

import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from tokscope.functions import scalars as S
from tokscope.plans import context as C
from tokscope.streaming import stream as ST

SF = "/root/testdata/sf0.001"


def test_stream_replay_equals_batch(spark):
    vocab = C.vocab(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = tempfile.mkdtemp(prefix="tokscope-stream-")
    # the same documents split over three files, replayed one file per micro-batch
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).coalesce(1).write.parquet(os.path.join(folder, f"part{k}"))
    src = os.path.join(folder, "all")
    os.makedirs(src)
    for k in range(3):
        for f in os.listdir(os.path.join(folder, f"part{k}")):
            if f.endswith(".parquet"):
                os.rename(os.path.join(folder, f"part{k}", f), os.path.join(src, f"p{k}-{f}"))
    q = ST.start_global_metrics_stream(spark, src, docs.schema.simpleString().replace("struct<", "").rstrip(">").replace(":", " "),
                                       vocab, os.path.join(folder, "ckpt"), "replay_test", os.path.join(folder, "state"))
    q.awaitTermination()
    streamed = {(r[0], r[1]): r[2] for r in ST.counters_to_long(ST.read_counters(spark, os.path.join(folder, "state"))).collect()}
    batch = {(r[0], r[1]): r[2] for r in ST.counters_to_long(ST.counters(ST.document_tokens(docs, vocab), vocab)).collect()}
    assert streamed == batch and streamed


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    assert "language_metrics" in os_


def test_parse_size_and_title(spark):
    df = spark.createDataFrame([("1.2 TB",), ("3 GB",), ("500 MB",), ("junk",), (None,), ("x GB",)], "s string")
    got = [r[0] for r in df.select(S.parse_size_gb(F.col("s"))).collect()]
    assert got == [1200.0, 3.0, 0.5, 0.0, 0.0, None]
    names = ["c-sharp", "objective-c++", "SQL", "don't", "3d"]
    t = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.title_case(F.col("n"))).collect()]
    assert t == [n.title() for n in names]


def test_budget_stream_equals_batch(spark):
    from tokscope.operators import corpus as CO
    from tokscope.sources import text as T

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = tempfile.mkdtemp(prefix="tokscope-budget-")
    src = os.path.join(folder, "in")
    os.makedirs(src)
    bounds = [0, 60, 130, 10**9]
    for k in range(3):  # files in doc_id order
        part = os.path.join(folder, f"tmp{k}")
        docs.where((F.col("doc_id") >= bounds[k]) & (F.col("doc_id") < bounds[k + 1])).coalesce(1).write.parquet(part)
        for f in os.listdir(part):
            if f.endswith(".parquet"):
                os.rename(os.path.join(part, f), os.path.join(src, f"{k:03d}-{f}"))
    target = 3000
    state = os.path.join(folder, "state")
    budget = ST.Budget(["eng-Latn", "no-such"], target)  # never reached: runs to the end of the files
    q = ST.start_budget_stream(spark, src, "doc_id bigint, text string, lang string, source string, n_chars bigint", target,
                               os.path.join(folder, "ckpt"), state, budget=budget)
    ST.run_until_budget(q, budget)
    streamed = {(r["lang_key"], r["doc_id"]) for r in spark.read.parquet(state).collect()}
    batch = {(r["lang_key"], r["doc_id"]) for r in CO.byte_budget(T.documents_from(docs).where(T.non_empty(F.col("text"))), target).collect()}
    assert streamed == batch and streamed


def _files_in_order(docs, folder, n):
    src = os.path.join(folder, "in")
    os.makedirs(src)
    rows = docs.orderBy("doc_id").toPandas()
    for k in range(n):
        rows.iloc[k * len(rows) // n : (k + 1) * len(rows) // n].to_parquet(os.path.join(src, f"{k:03d}.parquet"), index=False)
    return src


def test_budget_stream_with_uri_state_writes_text_and_really_stops_early(spark):
    from tokscope.operators import corpus as CO
    from tokscope.sources import text as T

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    folder = tempfile.mkdtemp(prefix="tokscope-budget-")
    src = _files_in_order(docs, folder, 12)
    schema, target = "doc_id bigint, text string, lang string, source string", 2000
    state = "file://" + os.path.join(folder, "state")  # totals must carry over between micro-batches
    budget = ST.Budget(["eng-Latn"], target)
    q = ST.start_budget_stream(spark, src, schema, target, "file://" + os.path.join(folder, "ckpt"), state, with_text=True, budget=budget)
    ST.run_until_budget(q, budget)
    done = len([x for x in os.listdir(os.path.join(folder, "state")) if x.startswith("batch_id=")])
    assert done < 12  # files are left unread
    got = {r["doc_id"]: r["text"] for r in spark.read.option("recursiveFileLookup", True).parquet(state).collect()}
    want = {r["doc_id"] for r in CO.byte_budget(T.documents_from(docs), target).collect()}
    assert set(got) <= want and got
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(texts[k] == v for k, v in got.items())
    full = {r["lang_key"]: r["kept_bytes"] for r in ST.kept_totals(spark, state).collect()}
    assert full["eng-Latn"] >= target
    # of the language that was waited for, all of the budget's documents are there
    eng = {r["doc_id"] for r in CO.byte_budget(T.documents_from(docs), target).collect() if r["lang_key"] == "eng-Latn"}
    assert eng <= set(got)
    # a restart knows what was kept before, without reading a file
    again = ST.Budget(["eng-Latn"], target)
    again.resume(spark, state)
    assert again.reached.is_set()


def test_global_metrics_stream_restarts_from_its_state(spark):
    vocab = C.vocab(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    folder = tempfile.mkdtemp(prefix="tokscope-restart-")
    src = _files_in_order(docs, folder, 6)
    later = os.path.join(folder, "later")
    os.makedirs(later)
    for f in sorted(os.listdir(src))[3:]:
        os.rename(os.path.join(src, f), os.path.join(later, f))
    start = lambda: ST.start_global_metrics_stream(
        spark, src, "doc_id bigint, text string, lang string, source string", vocab, os.path.join(folder, "ckpt"), "restart_test", os.path.join(folder, "state")
    )
    read = lambda: {tuple(r) for r in ST.read_counters(spark, os.path.join(folder, "state")).collect()}
    start().awaitTermination()
    half = read()
    for f in os.listdir(later):
        os.rename(os.path.join(later, f), os.path.join(src, f))
    start().awaitTermination()  # the same checkpoint: goes on from the counters of the first three files
    assert len([x for x in os.listdir(os.path.join(folder, "state")) if x.startswith("batch_id=")]) >= 6
    assert read() == {tuple(r) for r in ST.counters(ST.document_tokens(docs, vocab), vocab).collect()} != half


def test_characters_counted_by_class_equal_their_tokens(spark):
    from tokscope.operators.tokenizers import CHAR_PATTERN, NativeTokenizer, learn_vocab

    toks = [NativeTokenizer("bytes", CHAR_PATTERN), NativeTokenizer("chars", CHAR_PATTERN, char_slots=9)]
    vocab = learn_vocab(spark.createDataFrame([("日本é ж\u3000a1$ 日本é",)], "text string"), toks)
    docs = spark.createDataFrame([(1, "日本 é\u3000ж x1$.\t"), (2, "ค Ж αβ \x1c~"), (3, "plain")], "doc_id int, text string")
    want = {tuple(r) for r in ST.counters(ST.document_tokens(docs, vocab), vocab).collect()}
    assert {tuple(r) for r in ST.summed(ST.character_contributions(docs, vocab)).collect()} == want


def test_unique_tokens_stream_merges_sketches(spark):
    from tokscope.operators import metrics as M
    from tokscope.sources import text as T

    vocab = C.vocab(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    folder = tempfile.mkdtemp(prefix="tokscope-unique-")
    src, state = _files_in_order(docs, folder, 5), os.path.join(folder, "state")
    ST.start_unique_tokens_stream(spark, src, "doc_id bigint, text string, lang string, source string", vocab, os.path.join(folder, "ckpt"), state).awaitTermination()
    got = {(r["tokenizer"], r["lang_key"]): r for r in ST.read_unique_tokens(spark, state).collect()}
    exact = {(r["tokenizer"], r["lang_key"]): r for r in M.token_totals(T.documents_from(docs), vocab).collect()}
    assert got.keys() == exact.keys() and max(r["n_batches"] for r in got.values()) == 5
    for k, r in got.items():
        assert r["text_tokens"] == exact[k]["text_tokens"]
        assert abs(r["unique_tokens"] - exact[k]["distinct_ids"]) <= 3 * ST.SKETCH_ERROR * exact[k]["distinct_ids"]
    # sketches merge: two files at a time give the same estimates
    state2 = os.path.join(folder, "state2")
    ST.start_unique_tokens_stream(spark, src, "doc_id bigint, text string, lang string, source string", vocab, os.path.join(folder, "ckpt2"), state2, 2).awaitTermination()
    assert {(r["tokenizer"], r["lang_key"]): r["unique_tokens"] for r in ST.read_unique_tokens(spark, state2).collect()} == {k: r["unique_tokens"] for k, r in got.items()}


def test_streams_read_folder_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert ST.table_folder(spark, str(tmp_path / "documents.parquet")) == (str(tmp_path / "documents.parquet"), "*.parquet")
    folder, glob = ST.table_folder(spark, f"{SF}/documents.parquet")
    assert folder.endswith("sf0.001") and glob == "documents.parquet"


def test_no_shared_folder_on_a_cluster_is_an_error(monkeypatch):
    import pytest
    from tokscope import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
