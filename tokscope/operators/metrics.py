"""Per (tokenizer, language) metrics: A1-A10 as one job of three slim aggregates.

* bytes and units per language: one pass over the documents (no tokenizer involved);
* token counts per (tokenizer, language, id): the broadcast-join encoder plus a partial
  aggregation, so ``unique_tokens`` is an exact two-phase distinct count;
* split rates from the positional unit sample (or from all units with ``max_units=None``),
  each unit encoded alone without special tokens.

Language text = the language's documents in ``doc_id`` order joined by ``"\\n"``: the
separators count as bytes (``n_docs - 1`` of them).  Ratios are computed once from integer
sums, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import segment
from .encode import token_counts, tokens_per_row
from .joined import token_rows
from .prefix import DEFAULT_BLOCK_SIZE
from ..session import materialize
from .tokenizers import NativeTokenizer, Vocab, tokenizer_table

LANG_INFO = ("lang_key", "iso_code", "script", "language", "source")

METRIC_COLUMNS = (
    "tokenizer",
    *LANG_INFO,
    "segmentation_method",
    "total_bytes",
    "total_tokens",
    "unique_tokens",
    "bytes_per_token",
    "total_units",
    "subword_fertility",
    "word_split_pct",
    "continuation_token_pct",
    "continued_word_rate",
    "estimated_units_split",
)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0.0 when den is 0 (or NULL)."""
    return F.when(F.coalesce(den, F.lit(0)) > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def _info(info: Sequence[str]) -> tuple[list[Column], list[Column], Column]:
    """Aggregates and result columns for columns that should be constant in a group (else NULL), and a conflict flag."""
    one = F.struct(*[F.col(c) for c in info])
    aggs = [F.min(one).alias("_info"), F.max(one).alias("_info_last")]
    alike = F.col("_info").eqNullSafe(F.col("_info_last"))
    # a column is NULL only where it differs within the group
    cols = [
        F.when(F.col(f"_info.{c}").eqNullSafe(F.col(f"_info_last.{c}")), F.col(f"_info.{c}")).alias(c) for c in info
    ]
    return aggs, cols, ~alike


def language_conflicts(docs: DataFrame, group_cols: Sequence[str] = ("lang_key",)) -> DataFrame:
    """``(group..., n_kinds)``: keys that stand for more than one language, script or source.

    Such keys are refused: :func:`language_metrics` leaves them out, and this is their error table.
    """
    g = list(group_cols)
    info = [c for c in LANG_INFO if c not in g]
    kinds = docs.select(*g, *info).distinct().groupBy(*g).agg(F.count(F.lit(1)).alias("n_kinds"))
    return kinds.where(F.col("n_kinds") > 1)


EMPTY_TEXT = "text cannot be empty or None"


def text_violations(texts: DataFrame, group_cols: Sequence[str], text_col: str = "text") -> DataFrame:
    """``(group..., reason, n)``: rows that the library wrapper refuses, by reason; a group without any has no row."""
    text = F.col(text_col)
    reason = F.when(text.isNull(), F.lit("text is None")).when(text == "", F.lit("text is empty"))
    return texts.select(*group_cols, reason.alias("reason")).where(F.col("reason").isNotNull()).groupBy(*group_cols, "reason").agg(F.count(F.lit(1)).alias("n"))


def refuse_empty(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """D2, strict: reading an empty or NULL text fails the job, as the wrapper's call does."""
    text = F.col(text_col)
    return texts.withColumn(text_col, F.when(text.isNull() | (text == ""), F.raise_error(F.lit(EMPTY_TEXT)).cast("string")).otherwise(text))


def text_metrics(texts: DataFrame, vocab: Vocab, key: str, strict: bool = True) -> DataFrame:
    """The wrapper's record of every text (rows ``key, iso_code, script, text``; ``key`` is unique), without special
    tokens: one text is one group.  ``strict``: an empty or NULL text fails; else it is left out (:func:`text_violations`)."""
    rows = refuse_empty(texts) if strict else texts.where(F.col("text").isNotNull() & (F.col("text") != ""))
    docs = rows.select(
        F.col(key).cast("string").alias("lang_key"), "iso_code", "script", F.lit("").alias("language"), F.lit("").alias("source"),
        F.lit(0).cast("long").alias("doc_id"), "text",
    )
    m = language_metrics(docs, vocab, add_special_tokens=False)
    return m.select(
        "tokenizer", F.col("lang_key").alias(key), "bytes_per_token", "total_bytes", "total_tokens", "unique_tokens", "subword_fertility",
        "continued_word_rate", "segmentation_method", "total_units", "estimated_units_split",
    )


def language_totals(
    docs: DataFrame, group_cols: Sequence[str] = ("lang_key",), block_size: int = DEFAULT_BLOCK_SIZE
) -> tuple[DataFrame, DataFrame]:
    """Per-group bytes, documents, units and unit kind; plus per-row unit counts.

    Returns ``(langs, per_doc)``; ``langs`` has one row per group and carries the language info
    columns (NULL where they differ within the group).  With ``lang_key`` among the group columns,
    keys of conflicting info are left out (:func:`language_conflicts`).  ``per_doc`` has the rows of
    :func:`segment.unit_row_stats`.
    """
    g = list(group_cols)
    info = [c for c in LANG_INFO if c not in g]
    # slim (counts and edge strings of each document) and read by several stages: computed once
    keep = [*g, *info]
    stats = materialize(segment.doc_unit_stats(docs.select(*keep, *[c for c in ("iso_code", "script") if c not in keep], "doc_id", "text"), keep))
    aggs, cols, conflict = _info(info) if info else ([], [], F.lit(False))
    heads = stats.groupBy(*g).agg(
        *aggs,
        F.min("method").alias("_method"),
        F.max("method").alias("_method_last"),
        F.count(F.lit(1)).alias("n_docs"),
        F.min("doc_id").alias("first_doc"),
        F.sum("n_bytes").alias("doc_bytes"),
    )
    if "lang_key" in g:
        heads = heads.where(~conflict)
    rows = segment.unit_row_stats(stats, g, block_size)
    units = rows.groupBy(*g).agg(
        F.sum("n_plain").alias("n_plain"), F.sum("n_syl").alias("n_syl"), F.sum("n_syl_chars").alias("n_syl_chars")
    )
    method = F.when(F.col("_method") == F.col("_method_last"), F.col("_method")).otherwise(F.lit(segment.KIND_MIXED))
    syllables = F.col("n_syl") >= segment.S.MIN_SYLLABLES
    langs = heads.join(units, g).select(
        *g,
        *cols,
        method.alias("segmentation_method"),
        segment.unit_kind(method, F.col("n_syl")).alias("unit_kind"),
        syllables.alias("syllables"),
        "n_docs",
        "first_doc",
        (F.col("doc_bytes") + F.col("n_docs") - 1).alias("total_bytes"),
        (F.col("n_plain") + F.when(syllables, F.col("n_syl")).otherwise(F.col("n_syl_chars"))).alias("total_units"),
    )
    return langs, segment.doc_units(rows, langs, g)


def language_heads(docs: DataFrame, group_cols: Sequence[str] = ("lang_key",)) -> DataFrame:
    """Per group: first document, document count and text bytes (separators included).

    A plain aggregate (no unit segmentation), for stages that only need where each group's
    text starts and how long it is.
    """
    g = list(group_cols)
    info = [c for c in LANG_INFO if c not in g and c in docs.columns]
    aggs, cols, conflict = _info(info) if info else ([], [], F.lit(False))
    agg = docs.groupBy(*g).agg(
        *aggs, F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text")).alias("doc_bytes")
    )
    if "lang_key" in g:
        agg = agg.where(~conflict)
    return agg.select(*g, *cols, "first_doc", "n_docs", (F.col("doc_bytes") + F.col("n_docs") - 1).alias("total_bytes"))


def with_separators(docs: DataFrame, langs: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """The joined text of every group of ``langs`` as rows ``(group..., doc_id struct, text)`` that no
    piece crosses (:func:`joined.token_rows`), so that encoding them one by one is exact."""
    g = list(group_cols)
    return token_rows(docs, g).join(F.broadcast(langs.select(*g)), g, "left_semi")  # one row per group


def token_totals(docs: DataFrame, vocab: Vocab, group_cols: Sequence[str] = ("lang_key",)) -> DataFrame:
    """``(tokenizer, group..., text_tokens, distinct_ids)`` from the exact id counts.

    ``docs`` must already carry the separators (:func:`with_separators`).
    """
    counts = token_counts(docs.select(*group_cols, "text"), vocab, list(group_cols))
    return counts.groupBy("tokenizer", *group_cols).agg(
        F.sum("n").alias("text_tokens"), F.count(F.lit(1)).alias("distinct_ids")
    )


def split_stats(units: DataFrame, vocab: Vocab, group_cols: Sequence[str] = ("lang_key",)) -> DataFrame:
    """A7/A8 inputs: each sampled unit encoded alone (no special tokens)."""
    g = list(group_cols)
    per_unit = tokens_per_row(units, vocab, [*g, "upos"], text_col="unit")
    k = F.col("n_tokens")
    return per_unit.groupBy("tokenizer", *g).agg(
        F.count(F.lit(1)).alias("n_sampled"),
        F.sum(F.when(k > 1, 1).otherwise(0)).alias("n_split"),
        F.sum(F.greatest(k - 1, F.lit(0))).alias("n_cont"),
        F.sum(k).alias("n_unit_tokens"),
    )


def language_metrics(
    docs: DataFrame,
    vocab: Vocab,
    group_cols: Sequence[str] = ("lang_key",),
    max_units: int | None = segment.DEFAULT_UNIT_SAMPLE,
    add_special_tokens: bool = True,
    block_size: int = DEFAULT_BLOCK_SIZE,
    totals: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """A10: the metric record of every (tokenizer, language), or of any other grouping.

    ``docs`` = a text source (``lang_key, iso_code, script, language, source, doc_id, text``).
    ``max_units`` = size of the positional unit sample for split rates (``None``: all units).
    ``add_special_tokens`` = count special tokens once per language text (the fast path).
    ``totals`` = the ``(langs, per_doc)`` pair of :func:`language_totals` when already built.
    """
    g = list(group_cols)
    spark = docs.sparkSession
    docs = docs.select(*dict.fromkeys([*g, *LANG_INFO, "doc_id", "text"]))
    langs, per_doc = totals if totals is not None else language_totals(docs, g, block_size)
    toks = token_totals(with_separators(docs, langs, g), vocab, g)
    units = segment.sampled_units(docs, per_doc, langs.select(*g, "total_units"), g, max_units, block_size)
    if max_units is not None:  # at most so many rows a group, read twice: the sampled texts are cut once
        units = materialize(units)
    splits = split_stats(units, vocab, g)
    tt = F.broadcast(tokenizer_table(spark, vocab.tokenizers).select("tokenizer", "n_special"))

    special = F.col("n_special") if add_special_tokens else F.lit(0)
    m = toks.join(tt, "tokenizer").join(langs, g).join(splits, ["tokenizer", *g], "left")
    total_tokens = (F.col("text_tokens") + special).cast("long")
    unique_tokens = (F.col("distinct_ids") + special).cast("long")
    has_units = F.col("total_units") > 0
    split_rate = ratio(F.col("n_split"), F.col("n_sampled"))
    cont_pct = ratio(F.col("n_cont"), F.col("n_unit_tokens")) * F.lit(100.0)
    zero = F.lit(0.0)
    return m.select(
        "tokenizer",
        *dict.fromkeys([*g, *LANG_INFO]),
        "segmentation_method",
        F.col("total_bytes").cast("long").alias("total_bytes"),
        total_tokens.alias("total_tokens"),
        unique_tokens.alias("unique_tokens"),
        ratio(F.col("total_bytes"), total_tokens).alias("bytes_per_token"),
        F.col("total_units").cast("long").alias("total_units"),
        F.when(has_units, ratio(total_tokens, F.col("total_units"))).otherwise(zero).alias("subword_fertility"),
        F.when(has_units, split_rate * F.lit(100.0)).otherwise(zero).alias("word_split_pct"),
        F.when(has_units, cont_pct).otherwise(zero).alias("continuation_token_pct"),
        F.when(has_units, cont_pct).otherwise(zero).alias("continued_word_rate"),
        F.when(has_units, (split_rate * F.col("total_units")).cast("long")).otherwise(F.lit(0).cast("long")).alias(
            "estimated_units_split"
        ),
    )
