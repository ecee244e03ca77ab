"""Result documents (S6, S7, S9) and their flat views.

A result document holds one tokenizer: vocabulary size and analysis, run parameters, a map
``lang_key -> {language_info, metrics, sample}`` and a map of global metrics.  Documents are
assembled with ``collect_list`` per tokenizer: the lists hold one entry per language or per
global metric, so they are bounded by the catalogue, not by the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import safe_output_name

# ---------------------------------------------------------------------------
# Global-metric columns of the flat report, in report order.  Thai and
# Devanagari are not among them (the long table has every script).
REPORT_GLOBAL_COLUMNS: tuple[str, ...] = (
    "total_tokens_analyzed",
    "tokens_starting_with_space_pct",
    "tokens_with_whitespace_in_middle_pct",
    "tokens_with_script_overlap_pct",
    "tokens_with_symbols_unicode_pct",
    "tokens_with_latin_unicode_pct",
    "tokens_with_punctuation_unicode_pct",
    "tokens_with_numbers_unicode_pct",
    "tokens_with_japanese_unicode_pct",
    "tokens_with_chinese_unicode_pct",
    "tokens_with_cyrillic_unicode_pct",
    "tokens_with_greek_unicode_pct",
    "tokens_with_korean_unicode_pct",
    "tokens_with_arabic_unicode_pct",
    "tokens_with_hebrew_unicode_pct",
)
DEFAULT_BENCHMARK_SIZE_MB = 1.0
PREVIEW_TOKENS = 20
PREVIEW_PER_LINE = 8
# ---------------------------------------------------------------------------

LANGUAGE_INFO = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("iso_code", "script", "name", "source", "data_dir")]
)
METRICS = T.StructType(
    [
        T.StructField("bytes_per_token", T.DoubleType()),
        T.StructField("total_bytes", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("unique_tokens", T.LongType()),
        T.StructField("subword_fertility", T.DoubleType()),
        T.StructField("continued_word_rate", T.DoubleType()),
        T.StructField("word_split_pct", T.DoubleType()),
        T.StructField("continuation_token_pct", T.DoubleType()),
        T.StructField("segmentation_method", T.StringType()),
        T.StructField("total_units", T.LongType()),
        T.StructField("estimated_units_split", T.LongType()),
    ]
)
SAMPLE = T.StructType(
    [
        T.StructField("byte_offset", T.LongType()),
        T.StructField("text_bytes", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("tokens", T.ArrayType(T.StringType())),
    ]
)
VOCAB_METRICS = T.StructType(
    [
        T.StructField("tokens_without_leading_space_count", T.LongType()),
        T.StructField("tokens_without_leading_space_pct", T.DoubleType()),
        T.StructField("analyzed_sample_size", T.LongType()),
        T.StructField("sample_non_space_tokens", T.ArrayType(T.StringType())),
        T.StructField("sample_space_tokens", T.ArrayType(T.StringType())),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("tokenizer", T.StringType()),
        T.StructField("vocab_size", T.LongType()),
        T.StructField("benchmark_size_mb", T.DoubleType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("vocab_metrics", VOCAB_METRICS),
        T.StructField(
            "languages",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("language_info", LANGUAGE_INFO),
                        T.StructField("metrics", METRICS),
                        T.StructField("sample", SAMPLE),
                    ]
                ),
            ),
        ),
        T.StructField("global_metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def _by_key(a, b):
    """Order of map entries (the values themselves hold maps and cannot be compared)."""
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)


def build_documents(
    metrics: DataFrame,
    vocab_metrics: DataFrame,
    global_long: DataFrame,
    vocab_sizes: DataFrame,
    benchmark_size_mb: float | None,
    timestamp: float,
    samples: DataFrame | None = None,
) -> DataFrame:
    """S6 content: one row per tokenizer with the nested result document (schema ``RESULT``).

    ``metrics`` = language metric rows; ``vocab_metrics`` = A11 rows; ``global_long`` =
    ``(tokenizer, metric, value)``; ``vocab_sizes`` = ``(tokenizer, vocab_size)``;
    ``samples`` = optional ``(tokenizer, lang_key, sample struct)``.
    """
    m = metrics
    if samples is not None:
        m = m.join(samples, ["tokenizer", "lang_key"], "left")
    else:
        m = m.withColumn("sample", F.lit(None).cast(SAMPLE))
    entry = F.struct(
        F.col("lang_key").alias("key"),
        F.struct(
            F.struct(
                "iso_code", "script", F.col("language").alias("name"), "source", (F.col("data_dir") if "data_dir" in m.columns else F.lit(None).cast("string")).alias("data_dir")
            ).alias("language_info"),
            F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in METRICS.fields]).alias("metrics"),
            F.col("sample").cast(SAMPLE).alias("sample"),
        ).alias("value"),
    )
    langs = m.groupBy("tokenizer").agg(F.map_from_entries(F.array_sort(F.collect_list(entry), _by_key)).alias("languages"))
    glob = global_long.groupBy("tokenizer").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("global_metrics")
    )
    vm = vocab_metrics.select(
        "tokenizer", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in VOCAB_METRICS.fields]).alias("vocab_metrics")
    )
    size = F.lit(benchmark_size_mb).cast("double") if benchmark_size_mb is not None else F.lit(None).cast("double")
    out = vocab_sizes.join(langs, "tokenizer").join(vm, "tokenizer", "left").join(glob, "tokenizer", "left")
    return out.select(
        "tokenizer",
        F.col("vocab_size").cast("long").alias("vocab_size"),
        size.alias("benchmark_size_mb"),
        F.lit(timestamp).cast("double").alias("timestamp"),
        "vocab_metrics",
        "languages",
        F.coalesce("global_metrics", F.create_map().cast("map<string,double>")).alias("global_metrics"),
    )


def output_name(tokenizer: str, given: str | None = None) -> str:
    """S9 on the driver (for paths): the given name, else '/' and '-' replaced by '_'."""
    return given if given else tokenizer.replace("/", "_").replace("-", "_")


def write_documents(docs: DataFrame, path: str, fmt: str = "json") -> None:
    """One document per tokenizer under ``path/tokenizer_key=<safe name>/``, as JSON or Parquet."""
    keyed = docs.withColumn("tokenizer_key", safe_output_name(F.col("tokenizer")))
    dup = keyed.groupBy("tokenizer_key").count().where("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"two tokenizers map to the output name {dup[0]['tokenizer_key']!r}")
    keyed.repartition("tokenizer_key").write.mode("overwrite").partitionBy("tokenizer_key").format(fmt).save(path)


CORRUPT = "_corrupt_record"


def _files(spark, path: str) -> DataFrame:
    """``(value, file, tokenizer_key)``: each JSON file below ``path`` as one text; key = the ``tokenizer_key=``
    folder where there is one, else the file's stem."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, "/tokenizer_key=([^/]+)/[^/]*$", 1)
    stem = F.regexp_extract(file, "([^/]+)[.]json$", 1)
    key = F.url_decode(F.replace(F.when(folder != "", folder).otherwise(stem), F.lit("+"), F.lit("%2B")))
    return raw.select("value", file.alias("file"), key.alias("tokenizer_key"))


def _parsed(spark, path: str) -> DataFrame:
    schema = T.StructType([*RESULT.fields, T.StructField(CORRUPT, T.StringType())])
    doc = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return _files(spark, path).select("file", "tokenizer_key", doc.alias("doc"))


def read_documents(spark, path: str, strict: bool = False) -> DataFrame:
    """Result documents (one per file, indented or not) with an explicit schema.

    Lenient mode keeps unreadable files out (:func:`rejected_documents` lists them); strict mode fails
    on them.
    """
    if strict:
        doc = F.from_json("value", RESULT, {"mode": "FAILFAST"})
        return _files(spark, path).select("tokenizer_key", doc.alias("doc")).select("doc.*", "tokenizer_key")
    ok = _parsed(spark, path).where(F.col("doc").isNotNull() & F.col(f"doc.{CORRUPT}").isNull())
    return ok.select(*[F.col(f"doc.{f.name}").alias(f.name) for f in RESULT.fields], "tokenizer_key")


def rejected_documents(spark, path: str) -> DataFrame:
    """``(file, tokenizer_key)`` of the files that hold no readable document."""
    bad = F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull()
    return _parsed(spark, path).where(bad).select("file", "tokenizer_key")


def flatten(docs: DataFrame) -> DataFrame:
    """One row per (tokenizer, language) with language, metric, vocab, global and
    sample columns; missing optional values are NULL."""
    d = docs
    if "tokenizer_key" not in d.columns:
        d = d.withColumn("tokenizer_key", safe_output_name(F.col("tokenizer")))
    e = d.select(
        "tokenizer_key",
        F.coalesce("tokenizer", "tokenizer_key").alias("tokenizer_name"),
        F.coalesce("benchmark_size_mb", F.lit(DEFAULT_BENCHMARK_SIZE_MB)).alias("benchmark_size_mb"),
        F.coalesce("timestamp", F.lit(0.0)).alias("timestamp"),
        "vocab_size",
        "vocab_metrics",
        "global_metrics",
        F.explode("languages").alias("lang_key", "lang"),
    )
    m = F.col("lang.metrics")
    ts = F.col("timestamp")
    tokens = F.col("lang.sample.tokens")
    has_tokens = F.coalesce(F.size(tokens), F.lit(0)) > 0
    gm = [F.col("global_metrics")[c].alias(c) for c in REPORT_GLOBAL_COLUMNS]
    return e.select(
        "tokenizer_key",
        "tokenizer_name",
        F.col("lang.language_info.name").alias("language"),
        F.col("lang.language_info.iso_code").alias("iso_code"),
        F.col("lang.language_info.script").alias("script"),
        F.col("lang.language_info.source").alias("source"),
        "lang_key",
        m["bytes_per_token"].alias("bytes_per_token"),
        m["total_bytes"].alias("total_bytes"),
        m["total_tokens"].alias("total_tokens"),
        m["unique_tokens"].alias("unique_tokens"),
        "vocab_size",
        "benchmark_size_mb",
        "timestamp",
        F.when(ts != 0, F.timestamp_seconds(ts)).alias("datetime"),
        m["subword_fertility"].alias("subword_fertility"),
        F.coalesce(m["word_split_pct"], m["continued_word_rate"]).alias("word_split_pct"),
        F.when(m["word_split_pct"].isNotNull(), F.lit("word_split_pct"))
        .when(m["continued_word_rate"].isNotNull(), F.lit("continued_word_rate"))
        .alias("word_split_source"),
        F.col("vocab_metrics.tokens_without_leading_space_pct").alias("tokens_without_leading_space_pct"),
        F.col("vocab_metrics.tokens_without_leading_space_count").alias("tokens_without_leading_space_count"),
        F.col("vocab_metrics.analyzed_sample_size").alias("analyzed_sample_size"),
        *gm,
        F.col("lang.sample.text").alias("sample_text"),
        F.col("lang.sample.byte_offset").alias("sample_byte_offset"),
        F.col("lang.sample.text_bytes").alias("sample_text_bytes"),
        F.when(has_tokens, tokens).alias("sample_tokens"),
        F.when(has_tokens, F.size(tokens)).alias("sample_token_count"),
        F.when(has_tokens, preview(tokens)).alias("sample_tokens_preview"),
    )


def preview(tokens) -> F.Column:
    """the first twenty tokens joined by '|'."""
    return F.array_join(F.slice(tokens, 1, PREVIEW_TOKENS), "|")


def wrap_preview(preview_col) -> F.Column:
    """F16: a '|'-joined preview re-wrapped to eight tokens per line, lines joined by '<br>'."""
    toks = F.split(preview_col, r"\|", -1)
    n = F.size(toks)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(PREVIEW_PER_LINE))
    lines = F.transform(starts, lambda s: F.array_join(F.slice(toks, s, PREVIEW_PER_LINE), "|"))
    return F.when(F.coalesce(F.length(preview_col), F.lit(0)) > 0, F.array_join(lines, "<br>")).otherwise(F.lit(""))


def tokenizer_summary(docs: DataFrame) -> DataFrame:
    """One row per tokenizer with vocabulary and global metrics."""
    d = docs if "tokenizer_key" in docs.columns else docs.withColumn("tokenizer_key", safe_output_name(F.col("tokenizer")))
    ts = F.coalesce(F.col("timestamp"), F.lit(0.0))
    return d.select(
        "tokenizer_key",
        F.coalesce("tokenizer", "tokenizer_key").alias("tokenizer_name"),
        "vocab_size",
        ts.alias("timestamp"),
        F.when(ts != 0, F.date_format(F.to_utc_timestamp(F.timestamp_seconds(ts), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")).alias(
            "datetime"
        ),
        F.col("vocab_metrics.tokens_without_leading_space_pct").alias("tokens_without_leading_space_pct"),
        F.col("vocab_metrics.tokens_without_leading_space_count").alias("tokens_without_leading_space_count"),
        F.col("vocab_metrics.analyzed_sample_size").alias("analyzed_sample_size"),
        F.array_join(F.coalesce("vocab_metrics.sample_non_space_tokens", F.array().cast("array<string>")), "|").alias("sample_non_space_tokens"),
        F.array_join(F.coalesce("vocab_metrics.sample_space_tokens", F.array().cast("array<string>")), "|").alias("sample_space_tokens"),
        *[F.col("global_metrics")[c].alias(c) for c in REPORT_GLOBAL_COLUMNS],
    )
