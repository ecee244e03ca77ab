"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..operators import encode as EN
from ..operators import metrics as M
from ..operators import segment as SG
from ..operators import tokens as TK
from . import context as C
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


@register("language_metrics", lambda: O.language_metrics_sql())
def q_language_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 (flagship): the metric record of every (tokenizer, language) over whole documents."""
    return C.rounded(M.language_metrics(C.documents(spark, sf_dir), C.vocab(spark, sf_dir)))


@register("language_metrics_by_source", lambda: O.language_metrics_by_source_sql())
def q_language_metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10/D2 for another grouping: the metrics of each origin, over the documents of all its languages."""
    from ..sources import text as T

    m = M.language_metrics(T.documents(spark, sf_dir, "origin"), C.vocab(spark, sf_dir), ["source"])
    return C.rounded(m.select("tokenizer", "source", "total_bytes", "total_tokens", "unique_tokens", "bytes_per_token", "total_units", "subword_fertility", "word_split_pct"))


# --- slim metric projections (A1-A9) ------------------------------------------------


def _metric_cols(*cols):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.rounded(C.metrics(spark, sf_dir).select("tokenizer", "lang_key", *cols))

    return run


def _metric_sql(*cols):
    return lambda: f"{O.language_metrics_sql(final=False)}\nSELECT tokenizer, lang_key, " + ", ".join(
        O.rnd(c) + f" AS {c}" if c in O.DOUBLE_METRICS else c for c in cols
    ) + " FROM metrics"


for _name, _cols in {
    "total_tokens": ("total_tokens",),
    "unique_tokens": ("unique_tokens",),
    "bytes_per_token": ("total_bytes", "total_tokens", "bytes_per_token"),
    "subword_fertility": ("total_tokens", "total_units", "subword_fertility"),
    "word_split_pct": ("word_split_pct",),
    "continuation_token_pct": ("continuation_token_pct", "continued_word_rate"),
    "estimated_units_split": ("total_units", "estimated_units_split"),
}.items():
    register(_name, _metric_sql(*_cols))(_metric_cols(*_cols))


@register("total_bytes", lambda: O.with_docs_langs() + "\nSELECT lang_key, total_bytes, CAST(n_docs AS BIGINT) AS n_docs FROM langs")
def q_total_bytes(spark, sf_dir):
    """A1/F1: UTF-8 bytes of each language's text (documents joined by one-byte separators)."""
    heads = M.language_heads(C.documents(spark, sf_dir))
    return heads.select("lang_key", F.col("total_bytes").cast("long").alias("total_bytes"), F.col("n_docs").cast("long").alias("n_docs"))


@register(
    "total_units",
    lambda: O.with_docs_langs() + "\nSELECT lang_key, segmentation_method, unit_kind, CAST(total_units AS BIGINT) AS total_units FROM langs",
)
def q_total_units(spark, sf_dir):
    """A5: unit count and segmentation method per language."""
    langs, _ = M.language_totals(C.documents(spark, sf_dir))
    return langs.select("lang_key", "segmentation_method", "unit_kind", F.col("total_units").cast("long").alias("total_units"))


@register(
    "segmentation_method",
    lambda: "WITH " + O.documents_cte() + f"\nSELECT DISTINCT lang_key, iso_code, script, {O.method_sql('iso_code', 'script')} AS segmentation_method FROM docs",
)
def q_segmentation_method(spark, sf_dir):
    """segmentation method of every language present in the documents."""
    from ..functions import scalars as S

    d = C.documents(spark, sf_dir).select("lang_key", "iso_code", "script").distinct()
    return d.select("lang_key", "iso_code", "script", S.segmentation_method(F.col("iso_code"), F.col("script")).alias("segmentation_method"))


@register("even_sample_units", lambda: O.with_docs_langs() + ",\n" + O.sampled_units_ctes() + "\nSELECT lang_key, CAST(upos AS BIGINT) AS upos, unit FROM su")
def q_even_sample_units(spark, sf_dir):
    """The positional even sample (<= 1000) of every language's units."""
    docs = C.documents(spark, sf_dir)
    langs, per_doc = M.language_totals(docs)
    return SG.sampled_units(docs, per_doc, langs.select("lang_key", "total_units"), ["lang_key"]).select(
        "lang_key", F.col("upos").cast("long").alias("upos"), "unit"
    )


# --- token level (J1-J3, D3, D4, A11-A13, F8-F11) -----------------------------------------


@register("cross_tokenizers", lambda: O.with_docs_langs() + ",\n" + O.vocab_ctes(C.tokenizers()) + "\nSELECT l.lang_key, k.tokenizer, k.vocab_size, k.n_special FROM langs l, toks k")
def q_cross_tokenizers(spark, sf_dir):
    """Every tokenizer over every language (array of tokenizer rows inlined per language)."""
    langs = C.documents(spark, sf_dir).select("lang_key").distinct()
    toks = F.array(*[F.struct(F.lit(t.name).alias("tokenizer"), F.lit(t.vocab_size).cast("long").alias("vocab_size"), F.lit(t.n_special).alias("n_special")) for t in C.tokenizers()])
    return langs.select("lang_key", F.inline(toks))


@register("encode_lookup", lambda: O.encode_lookup_sql(C.tokenizers()))
def q_encode_lookup(spark, sf_dir):
    """Every distinct piece of the documents and its ids (pieces encoded once each)."""
    v = C.vocab(spark, sf_dir)
    folded = EN.piece_counts(C.documents(spark, sf_dir), v.tokenizers, [])
    enc = EN.encode_pieces(folded, v, ["n", "piece"])
    return enc.groupBy("tokenizer", "piece", "n").agg(
        F.sort_array(F.collect_list(F.struct("cidx", "bidx", "token_id"))).alias("ids")
    ).select(
        "tokenizer",
        "piece",
        F.col("n").alias("occurrences"),
        F.size("ids").cast("long").alias("n_ids"),
        F.array_join(F.transform("ids", lambda x: x["token_id"].cast("string")), " ").alias("ids"),
    )


def _counts_with_separators(spark, sf_dir):
    docs = C.documents(spark, sf_dir)
    heads = M.language_heads(docs)
    return EN.token_counts(M.with_separators(docs, heads, ["lang_key"]).select("lang_key", "text"), C.vocab(spark, sf_dir), ["lang_key"])


LONGEST_SLOTS, LONGEST_LEN = 1024, 8


def _longest_tokens(spark, sf_dir):
    from ..operators import longest as LO
    from ..sources import text as T

    return C.shared(spark, sf_dir, "longest_tokens", lambda: LO.learn_tokens(T.training_text(spark, sf_dir), LONGEST_SLOTS, LONGEST_LEN))


@register("longest_match", lambda: O.longest_match_sql(LONGEST_SLOTS, LONGEST_LEN))
def q_longest_match(spark, sf_dir):
    """Every distinct chunk of the documents under a greedy longest-match tokenizer, whose tokens cross piece borders."""
    from ..operators import longest as LO

    docs = C.documents(spark, sf_dir)
    folded = EN.piece_counts(docs, [EN.NativeTokenizer("longest", EN.java_covering_pattern([]), covers=True)], [])
    ids = LO.longest_match(folded.select("piece"), _longest_tokens(spark, sf_dir), LONGEST_LEN)
    return folded.join(ids, "piece").select(
        "piece", F.col("n").alias("occurrences"), F.size("ids").cast("long").alias("n_ids"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids")
    )


@register("decode_tokens", lambda: O.decode_tokens_sql(C.tokenizers()))
def q_decode_tokens(spark, sf_dir):
    """Id counts of every language joined with their decoded text (NULL = undecodable)."""
    v = C.vocab(spark, sf_dir)
    counts = _counts_with_separators(spark, sf_dir)
    dec = F.broadcast(v.decoded(spark))
    return counts.join(dec, ["tokenizer", "token_id"], "left").select(
        "tokenizer", "lang_key", "token_id", "token_text", F.col("n").cast("long").alias("n"), F.col("token_text").isNotNull().alias("decodable")
    )


@register("token_analysis", lambda: O.token_analysis_sql(C.tokenizers()))
def q_token_analysis(spark, sf_dir):
    """Annotated token occurrences per language (undecodable and empty decodes dropped)."""
    v = C.vocab(spark, sf_dir)
    ann = TK.annotate(_counts_with_separators(spark, sf_dir), v, keep_empty=False)
    return ann.select(
        "tokenizer", "lang_key", "token_id", "token_text", "starts_with_space", "has_whitespace_in_middle",
        F.array_join("scripts", ",").alias("scripts"), "script_overlap", F.col("n").cast("long").alias("n"),
    )


@register("vocab_analysis", lambda: O.vocab_analysis_sql(C.tokenizers()))
def q_vocab_analysis(spark, sf_dir):
    """Leading-space analysis of the stride-sampled vocabulary, with examples."""
    va = TK.vocab_analysis(C.vocab(spark, sf_dir))
    return C.rounded(va.withColumn("sample_non_space_tokens", F.array_join("sample_non_space_tokens", "|")).withColumn(
        "sample_space_tokens", F.array_join("sample_space_tokens", "|")))


@register("whitespace_flags", lambda: O.vocab_flags_sql(C.tokenizers(), "ws"))
def q_whitespace_flags(spark, sf_dir):
    """whitespace predicates of every decoded vocabulary entry."""
    a = TK.annotated_vocab(C.vocab(spark, sf_dir))
    return a.where(F.col("token_text").isNotNull()).select("tokenizer", "token_id", "token_text", "starts_with_space", "has_whitespace_in_middle")


@register("unicode_scripts", lambda: O.vocab_flags_sql(C.tokenizers(), "scripts"))
def q_unicode_scripts(spark, sf_dir):
    """Script sets of every decoded vocabulary entry."""
    a = TK.annotated_vocab(C.vocab(spark, sf_dir))
    return a.where(F.col("token_text").isNotNull()).select(
        "tokenizer", "token_id", F.array_join("scripts", ",").alias("scripts"), "script_overlap"
    )


def _sampled_tokens(spark, sf_dir):
    def build():
        docs = C.documents(spark, sf_dir)
        heads = M.language_heads(docs)
        sep = M.with_separators(docs, heads, ["lang_key"])
        return TK.even_sample_tokens(sep, C.vocab(spark, sf_dir), heads.select("lang_key", "first_doc"))

    return C.shared(spark, sf_dir, "sampled_tokens", build)


@register("even_sample_tokens", lambda: O.sampled_tokens_sql(C.tokenizers()) + "\nSELECT tokenizer, lang_key, tpos, token_id FROM stok")
def q_even_sample_tokens(spark, sf_dir):
    """Every step-th token id of each language (<= 2000, BOS at position 0)."""
    return _sampled_tokens(spark, sf_dir).select("tokenizer", "lang_key", "tpos", "token_id")


@register("global_metrics", lambda: O.global_metrics_sql(C.tokenizers()))
def q_global_metrics(spark, sf_dir):
    """Global token metrics per tokenizer over the sampled ids of all languages."""
    v = C.vocab(spark, sf_dir)
    ann = TK.annotate(_sampled_tokens(spark, sf_dir), v, keep_empty=True)
    return C.rounded(TK.global_metrics_long(ann))


@register("script_coverage", lambda: O.script_coverage_sql(C.tokenizers()))
def q_script_coverage(spark, sf_dir):
    """Per tokenizer and script, the share of sampled tokens containing that script."""
    v = C.vocab(spark, sf_dir)
    ann = TK.annotate(_sampled_tokens(spark, sf_dir), v, keep_empty=True)
    total = ann.groupBy("tokenizer").agg(F.count(F.lit(1)).alias("total"))
    per = ann.select("tokenizer", F.explode("scripts").alias("script")).groupBy("tokenizer", "script").agg(F.count(F.lit(1)).alias("n_tokens"))
    return C.rounded(per.join(total, "tokenizer").select(
        "tokenizer", "script", F.col("n_tokens").cast("long").alias("n_tokens"),
        (F.col("n_tokens").cast("double") / F.col("total").cast("double") * F.lit(100.0)).alias("pct"),
    ))
from . import queries_catalog  # noqa: E402,F401  (registers more queries)
from . import queries_reports  # noqa: E402,F401  (registers more queries)
