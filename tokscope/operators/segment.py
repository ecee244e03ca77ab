"""Units of a language (words, characters or syllables) and their positional even sample.

The unit kind is a property of the language (F3/F4) and, for syllable languages, of the
whole text: fewer than three syllables in the whole text switch to character units.  So the
kind is decided from per-language totals first and joined back (broadcast, one row per
language) before units are materialised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joined import body, borders, row_key, syllable_edges
from .prefix import DEFAULT_BLOCK_SIZE, exclusive_prefix_sums

# ---------------------------------------------------------------------------
# Sample sizes of the benchmark's positional samples.
DEFAULT_UNIT_SAMPLE = 1000  # units encoded one by one for split rates
DEFAULT_TOKEN_SAMPLE = 2000  # token occurrences per language for global metrics
# ---------------------------------------------------------------------------

KIND_WHITESPACE = "whitespace"
KIND_CHARACTER = "character"
KIND_SYLLABLE = "syllable"
KIND_SYLLABLE_CHARS = "syllable_chars"  # syllable language with too few syllables
KIND_MIXED = "mixed"  # a group of documents with different methods


def units_of(text: Column, kind: Column) -> Column:
    """Units of one text for a (per-row) unit kind."""
    return (
        F.when(kind == KIND_WHITESPACE, S.whitespace_units(text))
        .when(kind == KIND_CHARACTER, S.character_units(text))
        .when(kind == KIND_SYLLABLE, S.syllable_units(text))
        .otherwise(S.character_units_without_tsheg(text))
    )


def _counts(method: Column, text: Column) -> list[Column]:
    """The unit counts that a method may need, for one row's text."""
    syllable = method == KIND_SYLLABLE
    plain = F.when(method == KIND_WHITESPACE, S.whitespace_unit_count(text)).when(method == KIND_CHARACTER, S.character_unit_count(text))
    return [
        plain.otherwise(F.lit(0)).cast("long").alias("n_plain"),
        F.when(syllable, S.syllable_unit_count(text)).otherwise(F.lit(0)).cast("long").alias("n_syl"),
        F.when(syllable, S.character_unit_count_without_tsheg(text)).otherwise(F.lit(0)).cast("long").alias("n_syl_chars"),
    ]


def _edges(method: Column, text: Column) -> dict[str, Column]:
    """Syllable languages are cut at the outer tshegs; other texts are one row."""
    cut, syllable = syllable_edges(text), method == KIND_SYLLABLE
    return {
        "head": F.when(syllable, cut["head"]).otherwise(F.lit("")),
        "tail": F.when(syllable, cut["tail"]).otherwise(F.lit("")),
        "whole": F.when(syllable, cut["whole"]).otherwise(F.lit(False)),
    }


def doc_unit_stats(docs: DataFrame, keep_cols: Sequence[str]) -> DataFrame:
    """Per document: method, bytes, the unit counts of its body, and its edge strings (syllables)."""
    text = F.col("text")
    with_method = docs.select(
        *keep_cols, "doc_id", "text", S.segmentation_method(F.col("iso_code"), F.col("script")).alias("method")
    )
    method = F.col("method")
    edges = _edges(method, text)
    inner = F.when(method == KIND_SYLLABLE, body(text, edges)).otherwise(text)
    return with_method.select(
        *keep_cols, "doc_id", "method", S.utf8_len(text).alias("n_bytes"), *_counts(method, inner), *[c.alias(n) for n, c in edges.items()]
    )


def _border_rows(edges: DataFrame, g: list[str], block_size: int) -> DataFrame:
    return borders(edges.where(F.col("method") == KIND_SYLLABLE), g, block_size).withColumn("method", F.lit(KIND_SYLLABLE))


def unit_row_stats(stats: DataFrame, group_cols: Sequence[str], block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """``(group..., doc_id struct, method, n_plain, n_syl, n_syl_chars, border)``: rows that no unit reaches over.

    A document's body has a NULL ``border`` (its text is read where it is sampled); a syllable that lies
    between documents is a row of its own, with its text.
    """
    g = list(group_cols)
    counts = ["n_plain", "n_syl", "n_syl_chars"]
    bodies = stats.select(*g, row_key(F.col("doc_id"), 1).alias("doc_id"), "method", *counts, F.lit(None).cast("string").alias("border"))
    syllables = stats.where(F.col("method") == KIND_SYLLABLE)
    if syllables.isEmpty():  # no such language: no borders to look for
        return bodies
    between = borders(syllables, g, block_size).withColumn("method", F.lit(KIND_SYLLABLE))
    return bodies.unionByName(between.select(*g, "doc_id", "method", *_counts(F.col("method"), F.col("text")), F.col("text").alias("border")))


def bodies_of(docs: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``(group..., doc_id struct, text)``: the body of each document (all of it but for syllable languages)."""
    text, method = F.col("text"), S.segmentation_method(F.col("iso_code"), F.col("script"))
    inner = F.when(method == KIND_SYLLABLE, body(text, _edges(method, text))).otherwise(text)
    return docs.select(*group_cols, row_key(F.col("doc_id"), 1).alias("doc_id"), inner.alias("text"))


def unit_kind(method: Column, n_syl_total: Column) -> Column:
    return (
        F.when(method != KIND_SYLLABLE, method)
        .when(n_syl_total < S.MIN_SYLLABLES, F.lit(KIND_SYLLABLE_CHARS))
        .otherwise(F.lit(KIND_SYLLABLE))
    )


def doc_units(rows: DataFrame, langs: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Per row: its unit kind (syllables only if the group has enough of them) and unit count."""
    joined = rows.join(F.broadcast(langs.select(*group_cols, "syllables")), list(group_cols), "inner")  # one row per group
    syllable = F.col("method") == KIND_SYLLABLE
    kind = F.when(~syllable, F.col("method")).when(F.col("syllables"), F.lit(KIND_SYLLABLE)).otherwise(F.lit(KIND_SYLLABLE_CHARS))
    n = F.when(~syllable, F.col("n_plain")).when(F.col("syllables"), F.col("n_syl")).otherwise(F.col("n_syl_chars"))
    return joined.select(*group_cols, "doc_id", kind.alias("unit_kind"), n.alias("n_units"), "border")


def even_sample_step(total: Column, max_items: int) -> Column:
    """``step = max(1, n // max)``; position p is kept iff p % step = 0 and p div step < max."""
    return F.greatest(F.lit(1), F.floor(total / F.lit(max_items))).cast("long")


def sampled_positions(n: Column, start: str, limit: int | None) -> Column:
    """Sampled positions, from 0, within ``n`` items of which the first has position ``start``; reads the column ``step``."""
    n = n.cast("long")
    first = F.expr(f"(({start} + step - 1) div step) * step - {start}")
    rels = F.when(first < n, F.sequence(first, n - 1, F.col("step"))).otherwise(F.array().cast("array<bigint>"))
    return rels if limit is None else F.filter(rels, lambda r: F.floor((F.col(start) + r) / F.col("step")) < limit)


def sampled_units(
    docs: DataFrame,
    per_doc: DataFrame,
    lang_totals: DataFrame,
    group_cols: Sequence[str],
    max_units: int | None = DEFAULT_UNIT_SAMPLE,
    block_size: int = DEFAULT_BLOCK_SIZE,
) -> DataFrame:
    """``(group_cols..., upos, unit)``: the positional even sample of each group's units.

    ``docs`` = a text source; ``per_doc`` = ``(group_cols, doc_id, unit_kind, n_units)``; ``lang_totals`` =
    ``(group_cols, total_units)``.  Only documents holding a sampled position are re-read,
    and their unit arrays are read at the sampled positions before anything is exploded.
    ``max_units=None`` keeps every unit.
    """
    g = list(group_cols)
    with_off, _ = exclusive_prefix_sums(per_doc, g, "doc_id", {"u_off": "n_units"}, block_size, written=True)
    if max_units is None:
        step = F.lit(1).cast("long")
        limit = None
    else:
        step = even_sample_step(F.col("total_units"), max_units)
        limit = max_units
    lt = lang_totals.select(*g, step.alias("step"))
    sel = with_off.join(F.broadcast(lt), g, "inner")
    # first kept position at or after the document's offset
    first = F.expr("((u_off + step - 1) div step) * step")
    keep_doc = (F.col("n_units") > 0) & (first < F.col("u_off") + F.col("n_units"))
    if limit is not None:
        keep_doc = keep_doc & (F.expr("(u_off + step - 1) div step") < F.lit(limit))
    chosen = sel.where(keep_doc).select(*g, "doc_id", "unit_kind", "u_off", "step", "border")
    # at most max_units documents per group when sampling, so the broadcast is bounded
    chosen_b = F.broadcast(chosen) if limit is not None else chosen
    texts = bodies_of(docs, g).join(chosen_b.where(F.col("border").isNull()).drop("border"), [*g, "doc_id"], "inner")
    between = chosen.where(F.col("border").isNotNull()).withColumnRenamed("border", "text")
    texts = texts.unionByName(between.select(*texts.columns))
    units = units_of(F.col("text"), F.col("unit_kind"))

    # the units are cut once a text (a lambda variable) and read at their sampled positions only
    at = lambda us: F.transform(sampled_positions(F.size(us), "u_off", limit), lambda i: F.struct(i.alias("i"), F.get(us, i.cast("int")).alias("u")))
    kept = texts.select(*g, "u_off", F.explode(F.flatten(F.transform(F.array(units), at))).alias("z"))
    return kept.select(*g, (F.col("u_off") + F.col("z.i")).alias("upos"), F.col("z.u").alias("unit"))
