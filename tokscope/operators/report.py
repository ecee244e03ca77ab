"""Reporting over metric rows: ranks, categories, summaries, pivots and selections.

Input is the flat report table (one row per tokenizer and language, see
:func:`tokscope.operators.results.flatten`).  Language-level tables here have one row per
language (hundreds at most), so their global windows are small; nothing here touches text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import catalog as CAT

# ---------------------------------------------------------------------------
# Fixed values of the category rules.
EUROPEAN_FAMILIES = ("Indo-European", "Uralic", "Turkic", "Kartvelian")
EUROPEAN_NAME_EXCEPTIONS = ("Basque", "Maltese")
EUROPEAN_SCRIPT_TAGS = ("latn", "cyrl", "grek")
CJK_SCRIPT_TAGS = ("hani", "jpan", "hang")
RANK_BANDS: tuple[tuple[str, int, int], ...] = (("Top 30 Natural", 0, 30), ("31–60 Natural", 30, 60), ("61–100 Natural", 60, 100))
CATEGORY_ORDER = (
    "All Languages",
    "Top 30 Natural",
    "31–60 Natural",
    "61–100 Natural",
    "Coding",
    "European",
    "Non-European",
    "Latin Script",
    "Cyrillic Script",
    "Arabic Script",
    "CJK Scripts",
)
NO_RANK = 1e9
# ---------------------------------------------------------------------------


# --- W4 / J4 / A16 ----------------------------------------------------------------


def rank_table(present: DataFrame, natural_cat: DataFrame, code_names: DataFrame) -> DataFrame:
    """``(language, language_rank)`` for the languages in ``present(language)``.

    English (the benchmark's English row) first when present, then catalogue languages by
    size (ranks count catalogue rows whether present or not), then code languages in
    catalogue order, then other present languages by name.  A duplicated catalogue name
    keeps its last position.
    """
    valid = natural_cat.dropna(subset=["name", "disk_size"])
    nat = CAT.with_size(valid.where(F.col("iso_code").isNull() | (F.col("iso_code") != F.lit(CAT.TOTAL))))
    # position in the size order; ties keep catalogue order
    nat = nat.withColumn("idx", F.row_number().over(Window.orderBy(F.col("size_gb").desc(), "catalog_pos")) - 1)
    nat = nat.groupBy("name").agg(F.max("idx").alias("pos")).withColumnRenamed("name", "language")
    code = code_names.select(F.col("name").alias("language"), F.col("catalog_pos").alias("pos"))
    eng = present.where(F.col("language") == F.lit(CAT.ENGLISH_RANK_NAME)).select("language", F.lit(0).alias("pos"))
    rest = present.select("language", F.lit(0).alias("pos"))
    blocks = (
        eng.select(F.lit(0).alias("block"), "language", "pos")
        .unionByName(nat.where(~F.col("language").endswith("(code)")).select(F.lit(1).alias("block"), "language", "pos"))
        .unionByName(code.select(F.lit(2).alias("block"), "language", "pos"))
        .unionByName(rest.select(F.lit(3).alias("block"), "language", "pos"))
    )
    first = blocks.withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy("block", "pos"))).where("k = 1")
    ranked = first.withColumn("language_rank", F.row_number().over(Window.orderBy("block", "pos", "language")) - 1)
    return present.join(ranked.select("language", "language_rank"), "language", "left")


def with_rank(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Attach ``language_rank`` by display name (broadcast: one row per language)."""
    return rows.join(F.broadcast(ranks), "language", "left")


def min_rank(rows: DataFrame) -> DataFrame:
    """Lowest rank of each language."""
    return rows.groupBy("language").agg(F.min("language_rank").alias("language_rank"))


# --- U2 / U3 / J5 / J7 / W7 ---------------------------------------------------------


def _kind(language: Column, script: Column) -> Column:
    lang_l = F.lower(language)
    return (
        F.when(lang_l.contains("(code)") | (F.lower(F.coalesce(script, F.lit(""))) == "code"), F.lit("code"))
        .when(lang_l.contains("english"), F.lit("english"))
        .otherwise(F.lit("natural"))
    )


def language_table(rows: DataFrame, natural_cat: DataFrame) -> DataFrame:
    """One row per language: first script seen, kind, min rank, family (J5, missing -> '')."""
    first_seen = Window.partitionBy("language").orderBy("tokenizer_key", "lang_key")
    per = (
        rows.withColumn("k", F.row_number().over(first_seen))
        .where("k = 1")
        .select("language", F.coalesce("script", F.lit("")).alias("script"))
    )
    ranks = min_rank(rows)
    fam = natural_cat.groupBy("name").agg(F.max_by("family", "catalog_pos").alias("family"))
    t = per.join(ranks, "language").join(F.broadcast(fam), per.language == fam.name, "left")
    return t.select(
        "language",
        "script",
        _kind(F.col("language"), F.col("script")).alias("kind"),
        F.coalesce(F.col("language_rank").cast("double"), F.lit(NO_RANK)).alias("rank_key"),
        F.coalesce("family", F.lit("")).alias("family"),
    )


def is_european(language: Column, script: Column, family: Column) -> Column:
    scr = F.lower(script)
    tag = F.lit(False)
    for t in EUROPEAN_SCRIPT_TAGS:
        tag = tag | scr.contains(t)
    return language.isin(*EUROPEAN_NAME_EXCEPTIONS) | (tag & family.isin(*EUROPEAN_FAMILIES))


def _script_has(script: Column, tags: Sequence[str]) -> Column:
    scr = F.lower(script)
    out = F.lit(False)
    for t in tags:
        out = out | scr.contains(t)
    return out


def language_categories(langs: DataFrame) -> DataFrame:
    """``(category, position, language)`` for the eleven ordered category lists."""
    o = ["rank_key", "language"]
    keep = ["rank_key"]  # 'language' is selected separately
    nat = langs.where(F.col("kind") == "natural")
    eng = langs.where(F.col("kind") == "english")
    code = langs.where(F.col("kind") == "code")

    def numbered(df: DataFrame, category: str, order: Sequence[str]) -> DataFrame:
        w = Window.orderBy(*order)
        return df.select(F.lit(category).alias("category"), (F.row_number().over(w) - 1).alias("position"), "language")

    all_langs = (
        eng.select("language", F.lit(0).alias("b"), *keep)
        .unionByName(nat.select("language", F.lit(1).alias("b"), *keep))
        .unionByName(code.select("language", F.lit(2).alias("b"), *keep))
    )
    # only the first English language joins the natural ranking
    top_eng = eng.orderBy("language").limit(1)
    natural_ranked = numbered(
        top_eng.select("language", F.lit(0).alias("b"), *keep).unionByName(nat.select("language", F.lit(1).alias("b"), *keep)),
        "_",
        ["b", *o],
    )
    bands = [
        natural_ranked.where((F.col("position") >= lo) & (F.col("position") < hi)).select(
            F.lit(name).alias("category"), (F.col("position") - lo).alias("position"), "language"
        )
        for name, lo, hi in RANK_BANDS
    ]
    eu = nat.where(is_european(F.col("language"), F.col("script"), F.col("family")))
    non_eu = nat.join(eu.select("language"), "language", "left_anti")  # U3
    parts = [
        numbered(all_langs, "All Languages", ["b", *o]),
        *bands,
        numbered(code, "Coding", o),
        numbered(eu, "European", o),
        numbered(non_eu, "Non-European", o),
        numbered(langs.where(_script_has(F.col("script"), ["latn"])), "Latin Script", o),
        numbered(langs.where(_script_has(F.col("script"), ["cyrl"])), "Cyrillic Script", o),
        numbered(langs.where(_script_has(F.col("script"), ["arab"])), "Arabic Script", o),
        numbered(langs.where(_script_has(F.col("script"), CJK_SCRIPT_TAGS)), "CJK Scripts", o),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("category", F.col("position").cast("int").alias("position"), "language")


# --- W3, T2, T3, A14, A15, A17-A20, P8, P10 --------------------------------------------


def ranked_summary(rows: DataFrame) -> DataFrame:
    """Languages of each tokenizer by bytes per token (desc), ties in input order."""
    w = Window.partitionBy("tokenizer_key").orderBy(F.col("bytes_per_token").desc(), F.col("lang_key"))
    return rows.select(
        "tokenizer_key",
        F.row_number().over(w).alias("rank"),
        "language",
        F.format_string("%.2f", "bytes_per_token").alias("bytes_per_token_2f"),
        "unique_tokens",
        F.format_string("%.2f", "subword_fertility").alias("fertility_2f"),
        F.concat(F.format_string("%.1f", "word_split_pct"), F.lit("%")).alias("split_rate_1f"),
    )


def chart_order(rows: DataFrame, tokenizers: Sequence[str]) -> DataFrame:
    """Selected rows ordered by language rank, then tokenizer name; ``chart_pos`` records it."""
    sel = rows.where(F.col("tokenizer_key").isin(*tokenizers))
    w = Window.orderBy(F.col("language_rank").asc_nulls_last(), "tokenizer_name", "lang_key")
    return sel.select("tokenizer_name", "language", "lang_key", "language_rank", (F.row_number().over(w) - 1).alias("chart_pos"))


def default_tokenizers(rows: DataFrame, preferred: Sequence[str], n: int = 3) -> DataFrame:
    """The preferred tokenizers that are present, else the first ``n`` by name."""
    keys = rows.select("tokenizer_key").distinct()  # one row per tokenizer
    pref = keys.where(F.col("tokenizer_key").isin(*preferred)).select("tokenizer_key", F.lit(1).alias("preferred"))
    first_n = keys.orderBy("tokenizer_key").limit(n).select("tokenizer_key", F.lit(0).alias("preferred"))
    both = pref.unionByName(first_n)
    best = both.withColumn("best", F.max("preferred").over(Window.partitionBy()))
    return best.where(F.col("preferred") == F.col("best")).select("tokenizer_key", (F.col("preferred") == 1).alias("preferred"))


def default_languages(categories: DataFrame, rows: DataFrame) -> DataFrame:
    """The "Top 30 Natural" languages in their order, or every language when that list is empty."""
    top = categories.where(F.col("category") == "Top 30 Natural").select("language", "position", F.lit(1).alias("from_top"))
    every = rows.select("language").distinct()
    every = every.select("language", (F.row_number().over(Window.orderBy("language")) - 1).alias("position"), F.lit(0).alias("from_top"))
    both = top.unionByName(every)
    # both sides hold one row per language: the window over all of them is small
    best = both.withColumn("best", F.max("from_top").over(Window.partitionBy()))
    return best.where(F.col("from_top") == F.col("best")).select(
        "language", F.col("position").cast("int").alias("position"), (F.col("from_top") == 1).alias("from_top30")
    )


def efficiency_vs_vocab(rows: DataFrame, natural_only: bool = False) -> DataFrame:
    """Unweighted mean bytes per token, vocabulary size and row count per tokenizer."""
    r = rows.where(F.col("source") != "starcoder") if natural_only else rows
    agg = r.groupBy("tokenizer_key").agg(
        F.min("tokenizer_name").alias("tokenizer_name"),
        F.min("vocab_size").alias("vocab_size"),
        F.avg("bytes_per_token").alias("avg_efficiency"),
        F.count(F.lit(1)).alias("languages_count"),
    )
    return agg.where(F.col("vocab_size").isNotNull())


def first_per_tokenizer(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per tokenizer, the value of each column at the lowest language rank (non-NULL)."""
    aggs = [
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col("language_rank"), F.col("lang_key")))).alias(c)
        for c in cols
    ]
    return rows.groupBy("tokenizer_name").agg(*aggs)


def pivot_metric(rows: DataFrame, metric: str, lang_keys: Sequence[str], tokenizers: Sequence[str]) -> DataFrame:
    """Mean ``metric`` per language (rows, in list order) and tokenizer (columns, in list order).

    NULLs are dropped first; languages or tokenizers without a value in the data are left out: a first pass over
    the rows finds which of the listed tokenizers there are (at most the list is collected).
    """
    sub = rows.where(F.col("lang_key").isin(*lang_keys) & F.col("tokenizer_name").isin(*tokenizers) & F.col(metric).isNotNull())
    found = {r[0] for r in sub.select("tokenizer_name").distinct().collect()}
    present = [t for t in tokenizers if t in found]
    p = sub.groupBy("lang_key").pivot("tokenizer_name", present).agg(F.avg(metric)) if present else sub.select("lang_key").distinct()
    order = F.create_map(*[x for i, k in enumerate(lang_keys) for x in (F.lit(k), F.lit(i))])
    return p.withColumn("row_pos", F.element_at(order, F.col("lang_key")))


def vocab_utilisation(rows: DataFrame) -> DataFrame:
    """Mean over natural languages of unique tokens / vocabulary size."""
    nat = rows.where((F.col("source") != "starcoder") & (F.col("vocab_size") > 0))
    return nat.groupBy("tokenizer_key").agg(
        F.avg(F.col("unique_tokens").cast("double") / F.col("vocab_size").cast("double")).alias("vocab_utilisation"),
        F.count(F.lit(1)).alias("languages_count"),
    )


def baseline_ratio(rows: DataFrame, metric: str, baseline: str) -> DataFrame:
    """``metric`` of every tokenizer divided by the baseline tokenizer's, per language."""
    base = rows.where(F.col("tokenizer_key") == baseline).select("lang_key", F.col(metric).alias("base_value"))
    j = rows.join(base, "lang_key")
    return j.select(
        "tokenizer_key",
        "lang_key",
        F.col(metric).alias("value"),
        "base_value",
        F.when(F.col("base_value") != 0, F.col(metric) / F.col("base_value")).alias("ratio"),
    )


def select_rows(rows: DataFrame, tokenizers: Sequence[str], languages: Sequence[str]) -> DataFrame:
    """Tokenizer IN ... AND language IN ... (literal lists)."""
    return rows.where(F.col("tokenizer_key").isin(*tokenizers) & F.col("language").isin(*languages))


def nonnull_columns(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10: one aggregate pass; ``(column, non_null)`` for the columns with any value."""
    counts = rows.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    stacked = counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_null")) for c in cols])).alias("s")
    )
    return stacked.select("s.column_name", "s.non_null").where(F.col("non_null") > 0)


def distinct_values(rows: DataFrame) -> DataFrame:
    """Distinct tokenizers, languages and scripts, and their counts."""
    parts = []
    for col in ("tokenizer_key", "language", "script"):
        d = rows.select(F.lit(col).alias("column_name"), F.col(col).alias("value")).distinct()
        parts.append(d)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = out.groupBy("column_name").agg(F.countDistinct("value").alias("n_distinct"))
    return out.join(n, "column_name")
