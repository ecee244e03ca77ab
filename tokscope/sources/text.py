"""Text sources: driver tables projected to ``(lang_key, iso_code, script, language, source, doc_id, text)``.

Every source is a column-pruned parquet scan; empty and NULL texts are dropped before any
byte is counted (the benchmark skips them too).  Document order is ``doc_id``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Two-letter codes used by the driver's ``documents`` table and the
# (ISO 639-3 code, script, display name, language family) they stand for.
LANGUAGE_CODES: tuple[tuple[str, str, str, str, str], ...] = (
    ("en", "eng", "Latn", "English", "Indo-European"),
    ("de", "deu", "Latn", "German", "Indo-European"),
    ("es", "spa", "Latn", "Spanish", "Indo-European"),
    ("fr", "fra", "Latn", "French", "Indo-European"),
)
# Script given to texts whose language is unknown (Unicode's "common" script code).
UNKNOWN_SCRIPT = "Zyyy"
# ---------------------------------------------------------------------------

TEXT_COLUMNS = ("lang_key", "iso_code", "script", "language", "source", "doc_id", "text")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


#: Session setting: deal every text source out to so many partitions by its document key.
PARTITIONS = "spark.tokscope.input.partitions"


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` as scanned, or dealt out by ``key`` if the caller has set PARTITIONS for the session.

    Files of one row group scan into one task; a caller who knows that (a local test or bench) sets
    the number.  On a cluster it stays unset and no text is shuffled.
    """
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n), key) if n else df


def language_codes(spark: SparkSession) -> DataFrame:
    """The fixed code table as a DataFrame (four rows; joined by broadcast)."""
    return spark.createDataFrame(
        list(LANGUAGE_CODES), "code string, iso_code string, script string, language string, family string"
    )


def lang_key(iso: Column, script: Column, source: Column) -> Column:
    """``{iso}-code`` for code sources, else ``{iso}-{script}``."""
    return F.when(source == F.lit("starcoder"), F.concat(iso, F.lit("-code"))).otherwise(
        F.concat(iso, F.lit("-"), script)
    )


def non_empty(text: Column) -> Column:
    return text.isNotNull() & (text != F.lit(""))


def documents(spark: SparkSession, sf_dir: str, group: str = "lang") -> DataFrame:
    """``documents`` as a text source.

    ``group='lang'`` keys rows by language; ``group='lang_source'`` keys them by language and
    origin (``source`` column), which turns every (language, origin) pair into its own
    benchmark row; ``group='origin'`` keeps the language key and carries the origin as ``source``.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return dealt(documents_from(docs, group), "doc_id")


def documents_from(docs: DataFrame, group: str = "lang") -> DataFrame:
    """Project raw ``documents`` rows (``doc_id, text, lang, source``) to the text-source shape."""
    spark = docs.sparkSession
    codes = F.broadcast(language_codes(spark))
    joined = docs.where(non_empty(F.col("text"))).join(codes, docs.lang == codes.code, "left")
    iso = F.coalesce(F.col("iso_code"), F.col("lang"))
    script = F.coalesce(F.col("script"), F.lit(UNKNOWN_SCRIPT))
    name = F.coalesce(F.col("language"), F.col("lang"))
    src = F.lit("documents")
    key = lang_key(iso, script, src)
    if group == "lang_source":
        key = F.concat(key, F.lit("/"), F.col("source"))
        name = F.concat(name, F.lit(" ["), F.col("source"), F.lit("]"))
    elif group == "origin":
        src = F.col("source")
    elif group != "lang":
        raise ValueError(f"unknown grouping {group!r}")
    return joined.select(
        key.alias("lang_key"),
        iso.alias("iso_code"),
        script.alias("script"),
        name.alias("language"),
        src.alias("source"),
        F.col("doc_id"),
        F.col("text"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as one text source keyed by role; ``doc_id`` is the struct (conv_id, turn)."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    iso = F.lit("und")
    script = F.lit(UNKNOWN_SCRIPT)
    return dealt(conv.where(non_empty(F.col("text"))).select(
        F.concat(lang_key(iso, script, F.lit("conversations")), F.lit("/"), F.col("role")).alias("lang_key"),
        iso.alias("iso_code"),
        script.alias("script"),
        F.concat(F.lit("Conversation ("), F.col("role"), F.lit(")")).alias("language"),
        F.lit("conversations").alias("source"),
        F.struct("conv_id", "turn").alias("doc_id"),
        F.col("text"),
    ), "doc_id")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw HTML of ``pages`` as a code-like source (``html-code``)."""
    pg = read_table(spark, sf_dir, "pages").select("page_id", "html")
    iso = F.lit("html")
    src = F.lit("starcoder")
    return dealt(pg.where(non_empty(F.col("html"))).select(
        lang_key(iso, F.lit("code"), src).alias("lang_key"),
        iso.alias("iso_code"),
        F.lit("code").alias("script"),
        F.lit("Html (code)").alias("language"),
        src.alias("source"),
        F.col("page_id").alias("doc_id"),
        F.col("html").alias("text"),
    ), "doc_id")


def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text used to learn the native tokenizers' vocabularies (``benchmark.text``)."""
    return read_table(spark, sf_dir, "benchmark").select(F.col("text")).where(non_empty(F.col("text")))
