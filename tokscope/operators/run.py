"""A whole benchmark run over a work list: every language ends in the results or in the table of languages, with a reason.

1. Each row of the work list is tagged (U1, P13): ``error`` for a language key that an earlier row has, for a key without a
   known language or script, and for a language whose source reports an unreadable row; ``fallback`` where no text is
   found (S5); else ``ok``.
2. The corpus (W1, W2): the texts of ``ok`` languages up to the byte budget, cut to it exactly; for ``fallback`` languages
   the fallback text of the same size.  Both go through the same stages from here.
3. Metrics, positional samples, snippets and vocabulary analysis of that corpus become one result document per tokenizer,
   with the samples, the real benchmark size and the languages' data folders.

A failing language never stops the others: its rows are left out by a join with the tagged work list (one row per
language, broadcast), and nothing is raised.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.text import UNKNOWN_SCRIPT
from . import corpus as CO
from . import metrics as M
from . import results as RS
from . import snippet as SN
from . import tokens as TK
from .tokenizers import Vocab

MB = 1024 * 1024

# ---------------------------------------------------------------------------
# What a language can end as, and why.
OK, FALLBACK, ERROR = "ok", "fallback", "error"
DUPLICATE, UNKNOWN, NO_TEXT = "duplicate language key", "unknown language code", "no text found"
# ---------------------------------------------------------------------------

WORK = ("position", "lang_key", "iso_code", "script", "name", "source", "data_dir")


@dataclass
class Run:
    languages: DataFrame  # WORK columns, n_docs, status, reason: one row for each row of the work list
    corpus: DataFrame  # lang_key, iso_code, script, language, source, doc_id, text
    documents: DataFrame  # result documents (schema RESULT), one per tokenizer


def tagged(work: DataFrame, texts: DataFrame) -> DataFrame:
    """The work list with ``n_docs``, ``status`` and ``reason``.

    ``texts`` = ``(lang_key, doc_id, text)`` and, where the source has it, ``problem`` (NULL: a readable row).  A language of
    several work-list rows belongs to the first of them.
    """
    problem = F.col("problem") if "problem" in texts.columns else F.lit(None).cast("string")
    found = texts.groupBy("lang_key").agg(F.count("text").alias("n_docs"), F.min(problem).alias("problem"))
    # one row per language of the work list on both sides
    rows = work.select(*WORK).join(found, "lang_key", "left")
    turn = F.row_number().over(Window.partitionBy("lang_key").orderBy("position"))
    rows = rows.withColumn("turn", turn)
    unknown = F.col("lang_key").isNull() | F.col("iso_code").isNull() | F.col("script").isNull() | (F.col("script") == UNKNOWN_SCRIPT)
    reason = (
        F.when(unknown, F.lit(UNKNOWN))
        .when(F.col("turn") > 1, F.lit(DUPLICATE))
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.coalesce("n_docs", F.lit(0)) == 0, F.lit(NO_TEXT))
    )
    status = F.when(reason.isNull(), F.lit(OK)).when(reason == NO_TEXT, F.lit(FALLBACK)).otherwise(F.lit(ERROR))
    n = F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs")
    return rows.withColumn("reason", reason).select(*WORK, n, status.alias("status"), "reason")


def corpus(languages: DataFrame, texts: DataFrame, target_bytes: int) -> DataFrame:
    """The text that the run measures: the budgeted corpus of ``ok`` languages, the fallback text of ``fallback`` ones."""
    info = languages.select("lang_key", "iso_code", "script", F.col("name").alias("language"), "source", "status")
    good = F.broadcast(info.where(F.col("status") == OK).select("lang_key"))  # one row per language
    kept = CO.corpus_sample(texts.select("lang_key", "doc_id", "text").join(good, "lang_key", "left_semi"), target_bytes)
    # rows after the first carry their separator; joining them again puts it back
    own = F.when(F.col("doc_seq") > 0, F.expr("substring(text, 2)")).otherwise(F.col("text"))
    rows = kept.select("lang_key", F.col("doc_seq").alias("doc_id"), own.alias("text"))
    rows = rows.join(F.broadcast(info.where(F.col("status") == OK)), "lang_key")
    stand_in = info.where(F.col("status") == FALLBACK).withColumns(
        {"doc_id": F.lit(0).cast("long"), "text": CO.fallback_text(F.col("language"), target_bytes)}
    )
    columns = ["lang_key", "iso_code", "script", "language", "source", "doc_id", "text"]
    return rows.select(*columns).unionByName(stand_in.select(*columns))


def benchmark_run(work: DataFrame, texts: DataFrame, vocab: Vocab, target_bytes: int, timestamp: float, draw: str = "python") -> Run:
    """The run over ``work`` (:data:`WORK` columns) and ``texts`` (see :func:`tagged`)."""
    spark = work.sparkSession
    languages = materialize(tagged(work, texts))
    # bounded by the budget times the languages, and read by every stage
    docs = materialize(corpus(languages, texts, target_bytes))
    totals = M.language_totals(docs)
    langs, _ = totals
    sep = M.with_separators(docs, langs, ["lang_key"])
    metrics = M.language_metrics(docs, vocab, totals=totals)
    sampled = TK.even_sample_tokens(sep, vocab, langs.select("lang_key", "first_doc"))
    glong = TK.global_metrics_long(TK.annotate(sampled, vocab, keep_empty=True))
    snips = SN.snippets(sep, langs.select("lang_key", "iso_code", "script", "total_bytes"), draw=draw)
    samples = SN.sample_structs(snips, vocab)
    folders = languages.where(F.col("status") != ERROR).select("lang_key", "data_dir")
    metrics = metrics.join(F.broadcast(folders), "lang_key")
    sizes = spark.createDataFrame([(t.name, t.vocab_size) for t in vocab.tokenizers], "tokenizer string, vocab_size bigint")
    documents = RS.build_documents(metrics, TK.vocab_analysis(vocab), glong, sizes, target_bytes / MB, timestamp, samples)
    return Run(languages, docs, documents)
