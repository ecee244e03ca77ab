"""Corpus building: byte budget (W1), exact cut (W2), fallback text (S5, P9), validation.

The budget needs the bytes of all earlier documents of a language: a two-level prefix sum
over a slim ``(lang_key, doc_id, n_bytes)`` projection (no text is shuffled), pruned to the
blocks that can still be under the budget.  Texts of the kept documents are fetched with a
join afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.text import UNKNOWN_SCRIPT
from .prefix import DEFAULT_BLOCK_SIZE, exclusive_prefix_sums

# ---------------------------------------------------------------------------
# Fixed values of the fallback text.
FALLBACK_PHRASE = "Sample text for {name} tokenizer testing. "
FALLBACK_REPETITIONS = 1000
FALLBACK_MARKERS = ("Sample text for", "tokenizer testing")
SEPARATOR = "\n"
# ---------------------------------------------------------------------------

def byte_budget(docs: DataFrame, target_bytes: int, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """``(lang_key, doc_id, n_bytes, bytes_before)`` of the documents taken while the bytes
    of the earlier documents stay below ``target_bytes`` (separators not counted)."""
    slim = docs.select("lang_key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    with_off, _ = exclusive_prefix_sums(slim, ["lang_key"], "doc_id", {"bytes_before": "n_bytes"}, block_size, below=target_bytes)
    return with_off.where(F.col("bytes_before") < F.lit(target_bytes))


def corpus_sample(docs: DataFrame, target_bytes: int, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """The budgeted documents as one text per language, cut to exactly ``target_bytes``.

    Rows ``(lang_key, doc_seq, doc_id, start_byte, text)``: rows after the first carry their
    leading separator, ``start_byte`` is the row's offset in the joined text, and the row that
    crosses the budget is cut UTF-8-safely (a broken last character is dropped).
    """
    kept = byte_budget(docs, target_bytes, block_size)
    # kept rows per language are bounded by the budget, so this window is small
    seq = kept.withColumn("doc_seq", F.row_number().over(Window.partitionBy("lang_key").orderBy("doc_id")) - 1)
    # the kept documents are a prefix of each language, so its last one (one row per language, broadcast) sifts the texts
    # as they are scanned; what is left is bounded by the budget and meets its offsets by a shuffle
    last = kept.groupBy("lang_key").agg(F.max("doc_id").alias("_last"))
    texts = docs.select("lang_key", "doc_id", "text").join(F.broadcast(last), "lang_key").where(F.col("doc_id") <= F.col("_last"))
    texts = texts.drop("_last").join(seq, ["lang_key", "doc_id"])
    first = F.col("doc_seq") == 0
    seg = F.when(first, F.col("text")).otherwise(F.concat(F.lit(SEPARATOR), F.col("text")))
    start = F.when(first, F.lit(0)).otherwise(F.col("bytes_before") + F.col("doc_seq") - 1).cast("long")
    rows = texts.select("lang_key", "doc_seq", "doc_id", start.alias("start_byte"), seg.alias("seg"))
    keep = F.least(F.octet_length("seg"), F.lit(target_bytes) - F.col("start_byte"))
    rows = rows.withColumn("keep", keep).where(F.col("keep") > 0)
    cut = F.when(F.col("keep") < F.octet_length("seg"), S.utf8_slice(F.col("seg"), F.lit(0), F.col("keep"))).otherwise(F.col("seg"))
    return rows.select("lang_key", F.col("doc_seq").cast("long").alias("doc_seq"), "doc_id", "start_byte", cut.alias("text"))


def fallback_text(name, target_bytes: int):
    """The fallback phrase repeated and cut to exactly ``target_bytes`` (UTF-8 safe)."""
    phrase = F.format_string(FALLBACK_PHRASE.replace("{name}", "%s"), name)
    plen = F.octet_length(phrase)
    reps = F.greatest(F.lit(FALLBACK_REPETITIONS), (F.lit(target_bytes) / plen).cast("int") + 1)
    return S.utf8_slice(F.repeat(phrase, reps), F.lit(0), F.lit(target_bytes))


def is_fallback_text(text) -> F.Column:
    """The text carries both marker phrases."""
    cond = F.lit(True)
    for m in FALLBACK_MARKERS:
        cond = cond & F.coalesce(text.contains(m), F.lit(False))
    return cond


def fallback_rows(spark: SparkSession, catalogue: DataFrame, docs: DataFrame, target_bytes: int) -> DataFrame:
    """S5/P9 per catalogue language: its fallback text and whether it would be used (no text)."""
    from ..sources.catalog import catalog_valid

    langs = catalog_valid(catalogue).select("name", F.concat_ws("-", "iso_code", "script").alias("lang_key"))
    present = docs.select("lang_key").distinct().withColumn("has_text", F.lit(True))
    j = langs.join(present, "lang_key", "left")
    t = fallback_text(F.col("name"), target_bytes)
    return j.select(
        "lang_key",
        "name",
        F.col("has_text").isNull().alias("is_fallback"),
        F.octet_length(t).cast("long").alias("n_bytes"),
        F.md5(t).alias("text_md5"),
        is_fallback_text(t).alias("has_markers"),
    )


def quarantine(sources: DataFrame) -> DataFrame:
    """Validation split per (source, language): ``status`` ok / error with a reason.

    A failing language is reported and left out of later stages; the others go on.
    """
    per = sources.groupBy("source", "lang_key", "script").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text")).alias("n_bytes")
    )
    dup = Window.partitionBy("lang_key")
    per = per.withColumn("n_sources", F.count(F.lit(1)).over(dup))
    reason = (
        F.when(F.col("script") == F.lit(UNKNOWN_SCRIPT), F.lit("unknown language code"))
        .when(F.coalesce(F.col("n_bytes"), F.lit(0)) == 0, F.lit("empty corpus"))
        .when(F.col("n_sources") > 1, F.lit("duplicate language key"))
    )
    return per.select(
        "source",
        "lang_key",
        F.col("n_docs").cast("long").alias("n_docs"),
        F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        reason.alias("reason"),
    )
