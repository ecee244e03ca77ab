"""Registered result and report queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import corpus as CO
from ..operators import metrics as M
from ..operators import report as R
from ..operators import results as RS
from ..operators import run as RUN
from ..operators import tokens as TK
from ..session import ensure_checkpoint_dir, materialize
from ..sources import catalog as CAT
from ..sources import text as T
from . import context as C
from . import oracle as O
from . import oracle_catalog as OC
from . import oracle_reports as OR
from .queries import register

# ---------------------------------------------------------------------------
# Fixed parameters of the registered report queries.
TIMESTAMP = OR.TIMESTAMP
SELECTED_TOKENIZERS = ["bytes", "words"]
SELECTED_LANGUAGES = ["English", "French", "Html (code)"]
PREFERRED_TOKENIZERS = ["words", "gpt2"]
PIVOT_LANGS = ["eng-Latn", "fra-Latn", "deu-Latn", "spa-Latn", "html-code", "kor-Hang"]
PIVOT_TOKENIZERS = ["words", "gpt2", "chars", "bytes"]  # one of them has no results
BASELINE = "bytes"
STREAM_BUDGET_BYTES = 60_000
STREAM_FILES = 4  # arrivals (micro-batches); each comes as files of about STREAM_FILE_BYTES of text
STREAM_FILE_BYTES = 8 << 20
RUN_BYTES = 100_000
RUN_EXTRA = 1000  # position of the first work-list row beyond the catalogues
RUN_MISSING = ("kor", "Hang", "Korean", "fineweb2")  # a listed language without text
FIRST_COLUMNS = ["tokens_with_latin_unicode_pct", "tokens_starting_with_space_pct", "tokens_without_leading_space_pct"]
# ---------------------------------------------------------------------------


def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "all_sources")
    if key not in C._SOURCES:
        C._SOURCES[key] = C.documents(spark, sf_dir).unionByName(CAT.code_sources(spark, sf_dir))
    return C._SOURCES[key]


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 content for natural and code sources: one nested document per tokenizer (shared)."""

    def build():
        v = C.vocab(spark, sf_dir)
        docs = all_sources(spark, sf_dir)
        totals = M.language_totals(docs)
        metrics = M.language_metrics(docs, v, totals=totals)
        langs, _ = totals
        sep = M.with_separators(docs, langs, ["lang_key"])
        sampled = TK.even_sample_tokens(sep, v, langs.select("lang_key", "first_doc"))
        glong = TK.global_metrics_long(TK.annotate(sampled, v, keep_empty=True))
        sizes = spark.createDataFrame([(t.name, t.vocab_size) for t in v.tokenizers], "tokenizer string, vocab_size bigint")
        return RS.build_documents(metrics, TK.vocab_analysis(v), glong, sizes, None, TIMESTAMP)

    return C.shared(spark, sf_dir, "result_documents", build)


def ranks(spark, sf_dir, rows: DataFrame) -> DataFrame:
    present = rows.select("language").distinct()
    return R.rank_table(present, C.natural_catalogue(spark, sf_dir), CAT.code_languages(spark))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + J4: flat rows of the result documents with the language rank (shared)."""

    def build():
        flat = RS.flatten(result_documents(spark, sf_dir))
        return R.with_rank(flat, ranks(spark, sf_dir, flat))

    return C.shared(spark, sf_dir, "report_rows", build)


FLAT = list(OR.FLAT_COLUMNS)


def _rows_sql(select: str):
    return lambda: OR.rows_with(C.tokenizers()) + "\n" + select


@register("flatten_results", _rows_sql(OR.flat_select()))
def q_flatten_results(spark, sf_dir):
    """One flat row per (tokenizer, language) from the nested result documents."""
    return C.rounded(report_rows(spark, sf_dir).select(*FLAT))


@register("result_roundtrip", _rows_sql(OR.flat_select()))
def q_result_roundtrip(spark, sf_dir):
    """Result documents written as JSON (one per tokenizer), read back with a schema, flattened."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"results-{uuid.uuid4().hex}")
    RS.write_documents(result_documents(spark, sf_dir), path)
    back = RS.read_documents(spark, path)
    return C.rounded(RS.flatten(back).select(*FLAT))


@register(
    "tokenizer_summary",
    _rows_sql(
        "SELECT DISTINCT tokenizer_key, tokenizer_name, vocab_size, timestamp, strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS datetime, "
        + O.rnd("tokens_without_leading_space_pct")
        + " AS tokens_without_leading_space_pct, tokens_without_leading_space_count, analyzed_sample_size, sample_non_space_tokens, sample_space_tokens, "
        + ", ".join(O.rnd(c) + f" AS {c}" for c in RS.REPORT_GLOBAL_COLUMNS)
        + " FROM rows"
    ),
)
def q_tokenizer_summary(spark, sf_dir):
    """One row per tokenizer with vocabulary metrics and examples, and global metrics."""
    return C.rounded(RS.tokenizer_summary(result_documents(spark, sf_dir)))


@register("language_rank", _rows_sql("SELECT language, language_rank FROM ranks"))
def q_language_rank(spark, sf_dir):
    """Presentation rank of every language in the results."""
    return R.min_rank(report_rows(spark, sf_dir)).select("language", F.col("language_rank").cast("int"))


def _categories(spark, sf_dir):
    rows = report_rows(spark, sf_dir)
    langs = R.language_table(rows, C.natural_catalogue(spark, sf_dir))
    return R.language_categories(materialize(langs))  # one row per language, read by every category


@register("language_categories", lambda: OR.categories_sql(C.tokenizers()) + "\nSELECT category, position, language FROM cats")
def q_language_categories(spark, sf_dir):
    """The eleven ordered language categories."""
    return _categories(spark, sf_dir)


@register(
    "rank_bands",
    lambda: OR.categories_sql(C.tokenizers())
    + "\nSELECT category, position, language FROM cats WHERE category IN ("
    + ", ".join(O.q(b[0]) for b in R.RANK_BANDS)
    + ")",
)
def q_rank_bands(spark, sf_dir):
    """Natural languages (English first) in rank bands 0-29, 30-59, 60-99."""
    return _categories(spark, sf_dir).where(F.col("category").isin(*[b[0] for b in R.RANK_BANDS]))


@register(
    "european_split",
    lambda: OR.categories_sql(C.tokenizers())
    + "\nSELECT n.language, n.family, n.language IN (SELECT language FROM eu) AS is_european FROM nat n",
)
def q_european_split(spark, sf_dir):
    """Natural languages split into European and non-European by family and script."""
    t = R.language_table(report_rows(spark, sf_dir), C.natural_catalogue(spark, sf_dir)).where(F.col("kind") == "natural")
    return t.select("language", "family", R.is_european(F.col("language"), F.col("script"), F.col("family")).alias("is_european"))


@register(
    "ranked_summary",
    _rows_sql(
        "SELECT tokenizer_key, CAST(row_number() OVER (PARTITION BY tokenizer_key ORDER BY bytes_per_token DESC, lang_key) AS INTEGER) AS rank, "
        "language, printf('%.2f', bytes_per_token) AS bytes_per_token_2f, unique_tokens, printf('%.2f', subword_fertility) AS fertility_2f, "
        "printf('%.1f', word_split_pct) || '%' AS split_rate_1f FROM rows"
    ),
)
def q_ranked_summary(spark, sf_dir):
    """Languages of each tokenizer ranked by bytes per token, formatted."""
    return R.ranked_summary(report_rows(spark, sf_dir))


@register(
    "chart_order",
    _rows_sql(
        "SELECT tokenizer_name, language, lang_key, language_rank, CAST(row_number() OVER (ORDER BY language_rank NULLS LAST, tokenizer_name, lang_key) - 1 AS INTEGER) AS chart_pos "
        f"FROM rows WHERE tokenizer_key IN ({', '.join(O.q(t) for t in SELECTED_TOKENIZERS)})"
    ),
)
def q_chart_order(spark, sf_dir):
    """Chart rows ordered by language rank, then tokenizer name."""
    return R.chart_order(report_rows(spark, sf_dir), SELECTED_TOKENIZERS).withColumn("chart_pos", F.col("chart_pos").cast("int"))


@register(
    "default_selection",
    _rows_sql(
        f"""SELECT tokenizer_key, preferred FROM (
  SELECT *, max(CAST(preferred AS INTEGER)) OVER () AS best FROM (
    SELECT DISTINCT tokenizer_key, true AS preferred FROM rows WHERE tokenizer_key IN ({', '.join(O.q(t) for t in PREFERRED_TOKENIZERS)})
    UNION ALL SELECT tokenizer_key, false FROM (SELECT DISTINCT tokenizer_key FROM rows ORDER BY tokenizer_key LIMIT 3)))
WHERE CAST(preferred AS INTEGER) = best"""
    ),
)
def q_default_selection(spark, sf_dir):
    """Default tokenizer selection (preferred ones present, else the first three)."""
    return R.default_tokenizers(report_rows(spark, sf_dir), PREFERRED_TOKENIZERS)


@register(
    "default_languages",
    lambda: OR.categories_sql(C.tokenizers())
    + """,
dl AS (
  SELECT language, position, 1 AS from_top FROM cats WHERE category = 'Top 30 Natural'
  UNION ALL
  SELECT language, CAST(row_number() OVER (ORDER BY language) - 1 AS INTEGER), 0 FROM (SELECT DISTINCT language FROM rows)
)
SELECT language, position, from_top = 1 AS from_top30 FROM (SELECT *, max(from_top) OVER () AS best FROM dl) WHERE from_top = best""",
)
def q_default_languages(spark, sf_dir):
    """Default language selection (Top 30 Natural, else every language)."""
    return R.default_languages(_categories(spark, sf_dir), report_rows(spark, sf_dir))


def _pivot_sql() -> str:
    cols = ", ".join(
        O.rnd(f"avg(bytes_per_token) FILTER (WHERE tokenizer_name = {O.q(t)})") + f" AS {t}"
        for t in PIVOT_TOKENIZERS
        if t in {k.name for k in C.tokenizers()}
    )
    order = " ".join(f"WHEN {O.q(k)} THEN {i}" for i, k in enumerate(PIVOT_LANGS))
    return (
        f"SELECT lang_key, {cols}, CASE lang_key {order} END AS row_pos FROM rows "
        f"WHERE lang_key IN ({', '.join(O.q(k) for k in PIVOT_LANGS)}) AND tokenizer_name IN ({', '.join(O.q(t) for t in PIVOT_TOKENIZERS)}) "
        "AND bytes_per_token IS NOT NULL GROUP BY lang_key"
    )


@register("pivot_metric", _rows_sql(_pivot_sql()))
def q_pivot_metric(spark, sf_dir):
    """Language x tokenizer pivot of mean bytes per token, rows in list order."""
    return C.rounded(R.pivot_metric(report_rows(spark, sf_dir), "bytes_per_token", PIVOT_LANGS, PIVOT_TOKENIZERS))


@register(
    "efficiency_vs_vocab",
    _rows_sql(
        "SELECT tokenizer_key, min(tokenizer_name) AS tokenizer_name, min(vocab_size) AS vocab_size, "
        + O.rnd("avg(bytes_per_token)")
        + " AS avg_efficiency, count(*) AS languages_count FROM rows GROUP BY tokenizer_key HAVING min(vocab_size) IS NOT NULL"
    ),
)
def q_efficiency_vs_vocab(spark, sf_dir):
    """Mean bytes per token against vocabulary size, per tokenizer."""
    return C.rounded(R.efficiency_vs_vocab(report_rows(spark, sf_dir)))


@register(
    "efficiency_natural",
    _rows_sql(
        "SELECT tokenizer_key, min(tokenizer_name) AS tokenizer_name, min(vocab_size) AS vocab_size, "
        + O.rnd("avg(bytes_per_token)")
        + " AS avg_efficiency, count(*) AS languages_count FROM rows WHERE source <> 'starcoder' GROUP BY tokenizer_key HAVING min(vocab_size) IS NOT NULL"
    ),
)
def q_efficiency_natural(spark, sf_dir):
    """A14 over natural languages only."""
    return C.rounded(R.efficiency_vs_vocab(report_rows(spark, sf_dir), natural_only=True))


@register(
    "first_per_tokenizer",
    _rows_sql(
        "SELECT tokenizer_name, "
        + ", ".join(O.rnd(f"arg_min({c}, [coalesce(printf('%09d', language_rank), ''), lang_key]) FILTER (WHERE {c} IS NOT NULL)") + f" AS {c}" for c in FIRST_COLUMNS)
        + " FROM rows GROUP BY tokenizer_name"
    ),
)
def q_first_per_tokenizer(spark, sf_dir):
    """Per tokenizer, the first non-NULL value of tokenizer-level columns (by rank)."""
    return C.rounded(R.first_per_tokenizer(report_rows(spark, sf_dir), FIRST_COLUMNS))


@register(
    "distinct_values",
    _rows_sql(
        """SELECT column_name, value, count(*) OVER (PARTITION BY column_name) AS n_distinct FROM (
  SELECT DISTINCT 'tokenizer_key' AS column_name, tokenizer_key AS value FROM rows
  UNION SELECT DISTINCT 'language', language FROM rows
  UNION SELECT DISTINCT 'script', script FROM rows)"""
    ),
)
def q_distinct_values(spark, sf_dir):
    """Distinct tokenizers, languages and scripts with their counts."""
    return R.distinct_values(report_rows(spark, sf_dir))


@register(
    "vocab_utilisation",
    _rows_sql(
        "SELECT tokenizer_key, "
        + O.rnd("avg(CAST(unique_tokens AS DOUBLE) / vocab_size)")
        + " AS vocab_utilisation, count(*) AS languages_count FROM rows WHERE source <> 'starcoder' AND vocab_size > 0 GROUP BY tokenizer_key"
    ),
)
def q_vocab_utilisation(spark, sf_dir):
    """Mean share of the vocabulary used per natural language."""
    return C.rounded(R.vocab_utilisation(report_rows(spark, sf_dir)))


@register(
    "baseline_ratio",
    _rows_sql(
        f"""SELECT r.tokenizer_key, r.lang_key, {O.rnd('r.bytes_per_token')} AS value, {O.rnd('b.bytes_per_token')} AS base_value,
       {O.rnd('CASE WHEN b.bytes_per_token <> 0 THEN r.bytes_per_token / b.bytes_per_token END')} AS ratio
FROM rows r JOIN rows b ON b.lang_key = r.lang_key AND b.tokenizer_key = {O.q(BASELINE)}"""
    ),
)
def q_baseline_ratio(spark, sf_dir):
    """Bytes per token relative to the baseline tokenizer, per language."""
    return C.rounded(R.baseline_ratio(report_rows(spark, sf_dir), "bytes_per_token", BASELINE))


@register(
    "select_rows",
    _rows_sql(
        OR.flat_select()
        + f" WHERE tokenizer_key IN ({', '.join(O.q(t) for t in SELECTED_TOKENIZERS)}) AND language IN ({', '.join(O.q(x) for x in SELECTED_LANGUAGES)})"
    ),
)
def q_select_rows(spark, sf_dir):
    """Rows of selected tokenizers and languages."""
    return C.rounded(R.select_rows(report_rows(spark, sf_dir), SELECTED_TOKENIZERS, SELECTED_LANGUAGES).select(*FLAT))


NONNULL = FLAT + ["datetime", "sample_text", "sample_tokens_preview"]


def _nn(c: str) -> str:
    if c in FLAT:
        return c
    if c == "datetime":
        return "CASE WHEN timestamp <> 0 THEN 1 END"
    return "NULL"


@register(
    "nonnull_columns",
    _rows_sql(
        "SELECT column_name, non_null FROM (SELECT unnest(["
        + ", ".join(f"{{'column_name': '{c}', 'non_null': count({_nn(c)})}}" for c in NONNULL)
        + "], recursive := true) FROM rows) WHERE non_null > 0"
    ),
)
def q_nonnull_columns(spark, sf_dir):
    """P10: the report columns that hold at least one value."""
    return R.nonnull_columns(report_rows(spark, sf_dir), NONNULL)


# --- the budgeted run: every row of a work list ends in the results or in the table of languages -------


def _run_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English, all natural and code languages of the catalogues, one listed language without text, and the languages of the
    conversations (whose code is unknown).  The catalogue has English too: its key comes twice."""
    work = CAT.work_list(spark, C.natural_catalogue(spark, sf_dir)).drop("duplicate_key")
    n = F.lit(RUN_EXTRA)
    missing = spark.createDataFrame([RUN_MISSING], "iso_code string, script string, name string, source string")
    missing = missing.select(n.alias("position"), T.lang_key(F.col("iso_code"), F.col("script"), F.col("source")).alias("lang_key"), "*", F.lit(None).cast("string").alias("data_dir"))
    talk = T.conversations(spark, sf_dir).select("lang_key", "iso_code", "script", F.col("language").alias("name"), "source").distinct()
    talk = talk.withColumns({"position": n + F.dense_rank().over(Window.orderBy("lang_key")), "data_dir": F.lit(None).cast("string")})  # a few rows
    return work.unionByName(missing).unionByName(talk)


def _run(spark: SparkSession, sf_dir: str) -> RUN.Run:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        texts = all_sources(spark, sf_dir).select("lang_key", "doc_id", "text")
        _RUNS[key] = RUN.benchmark_run(_run_work(spark, sf_dir), texts, C.vocab(spark, sf_dir), RUN_BYTES, TIMESTAMP, draw="modulo")
    return _RUNS[key]


_RUNS: dict[tuple[str, str], RUN.Run] = {}


def _run_languages_cte() -> str:
    work = OC.work_list_sql(99)
    iso, script, name, source = RUN_MISSING
    return f"""raw_work AS ({work}),
work AS (
  SELECT position, lang_key, iso_code, script, name, source, data_dir FROM raw_work
  UNION ALL SELECT {RUN_EXTRA}, {O.q(f'{iso}-{script}')}, {O.q(iso)}, {O.q(script)}, {O.q(name)}, {O.q(source)}, NULL
  UNION ALL SELECT {RUN_EXTRA} + row_number() OVER (ORDER BY role), 'und-{T.UNKNOWN_SCRIPT}/' || role, 'und', '{T.UNKNOWN_SCRIPT}', 'Conversation (' || role || ')', 'conversations', NULL
  FROM (SELECT DISTINCT role FROM conversations WHERE text IS NOT NULL AND text <> '')
),
tagged AS (
  SELECT w.*, coalesce(n.n_docs, 0) AS n_docs,
    CASE WHEN w.script = '{T.UNKNOWN_SCRIPT}' THEN '{RUN.UNKNOWN}'
         WHEN row_number() OVER (PARTITION BY w.lang_key ORDER BY w.position) > 1 THEN '{RUN.DUPLICATE}'
         WHEN n.n_docs IS NULL THEN '{RUN.NO_TEXT}' END AS reason
  FROM work w LEFT JOIN (SELECT lang_key, count(*) AS n_docs FROM all_docs GROUP BY lang_key) n USING (lang_key)
)"""


def _run_docs_cte() -> str:
    """``docs`` of the run: the exact cut of each good language, the fallback text of the one without."""
    raw = O.documents_cte(with_code=True).replace("docs AS (", "all_docs AS (", 1)
    cut = OC.corpus_sample_sql(RUN_BYTES).split(O.documents_cte() + ",\n", 1)[1].rsplit("\nSELECT lang_key, CAST(doc_seq", 1)[0]
    phrase = CO.FALLBACK_PHRASE.replace("{name}", "' || w.name || '")
    fallback = f"left(repeat('{phrase}', {RUN_BYTES // 20}), {RUN_BYTES})"
    return f"""{raw},
{OC.catalogue_ctes()},
{_run_languages_cte()},
{cut.replace("FROM docs", "FROM all_docs", 1)},
docs AS (
  SELECT w.lang_key, w.iso_code, w.script, w.name AS language, w.source, c.doc_seq AS doc_id, CASE WHEN c.doc_seq > 0 THEN substr(c.out, 2) ELSE c.out END AS text
  FROM cut c JOIN tagged w ON w.lang_key = c.lang_key AND w.reason IS NULL
  UNION ALL
  SELECT w.lang_key, w.iso_code, w.script, w.name, w.source, 0, {fallback} FROM tagged w WHERE w.reason = '{RUN.NO_TEXT}'
)"""


RUN_COLUMNS = [*FLAT, "sample_byte_offset", "sample_text_bytes", "sample_text_md5", "sample_token_count", "sample_tokens_preview"]


def _run_sql() -> str:
    cte = OR.rows_with(C.tokenizers(), _run_docs_cte(), RUN_BYTES / RUN.MB, samples=True)
    return cte + "\n" + OR.flat_select(RUN_COLUMNS)


@register("budgeted_run", _run_sql)
def q_budgeted_run(spark, sf_dir):
    """The run of :mod:`..operators.run` under a byte budget, flattened: metrics of the exact cut (and of one fallback text),
    samples, the real benchmark size."""
    flat = RS.flatten(_run(spark, sf_dir).documents).withColumn("sample_text_md5", F.md5("sample_text"))
    return C.rounded(flat.select(*RUN_COLUMNS))


@register(
    "run_languages",
    lambda: "WITH " + O.documents_cte(with_code=True).replace("docs AS (", "all_docs AS (", 1) + ",\n" + OC.catalogue_ctes() + ",\n" + _run_languages_cte()
    + f"\nSELECT CAST(position AS INTEGER) AS position, lang_key, name, source, n_docs, "
    f"CASE WHEN reason IS NULL THEN '{RUN.OK}' WHEN reason = '{RUN.NO_TEXT}' THEN '{RUN.FALLBACK}' ELSE '{RUN.ERROR}' END AS status, reason FROM tagged",
)
def q_run_languages(spark, sf_dir):
    """P13/U1/S5 of the run: what every row of the work list ended as, and why."""
    return _run(spark, sf_dir).languages.select(F.col("position").cast("int"), "lang_key", "name", "source", "n_docs", "status", "reason")


# --- sample preview (F13, F15, F16, D5) and streaming (X2) ---------------------------------


@register("sample_preview", lambda: O.sample_preview_sql(C.tokenizers()))
def q_sample_preview(spark, sf_dir):
    """A 300-byte snippet of every language (the seed modulo the span draws its offset),
    encoded, with previews."""
    from ..operators import snippet as SN

    v = C.vocab(spark, sf_dir)
    docs = C.documents(spark, sf_dir)
    heads = M.language_heads(docs)
    sep = M.with_separators(docs, heads, ["lang_key"])
    snips = SN.snippets(sep, heads.select("lang_key", "iso_code", "script", "total_bytes"), draw="modulo")
    s = SN.sample_structs(snips, v)
    prev = RS.preview(F.col("sample.tokens"))
    return s.select(
        "tokenizer",
        "lang_key",
        F.col("sample.byte_offset").alias("byte_offset"),
        F.col("sample.text_bytes").alias("text_bytes"),
        F.md5(F.col("sample.text")).alias("text_md5"),
        F.size("sample.token_ids").alias("n_token_ids"),
        F.size("sample.tokens").alias("sample_token_count"),
        prev.alias("sample_tokens_preview"),
        RS.wrap_preview(prev).alias("preview_wrapped"),
    )


def _stream_sql() -> str:
    toks = C.tokenizers()
    return (
        "WITH " + O.vocab_ctes(toks) + ",\n"
        + "sd AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''),\n"
        + O.encode_ctes("st", "sd", ["doc_id"], "text", toks) + ",\n"
        + O.decoded_vocab_ctes(toks) + ",\n" + O.annotated_vocab_cte() + ",\n"
        + """ann AS (SELECT s.tokenizer, a.starts_with_space, a.has_whitespace_in_middle, len(a.scripts) > 1 AS script_overlap, a.scripts
        FROM st_stream s JOIN avocab a ON a.tokenizer = s.tokenizer AND a.token_id = s.token_id WHERE a.token_text IS NOT NULL),
tot AS (SELECT tokenizer, count(*) AS total, sum(CAST(starts_with_space AS INTEGER)) AS sp,
               sum(CAST(has_whitespace_in_middle AS INTEGER)) AS inn, sum(CAST(script_overlap AS INTEGER)) AS ov FROM ann GROUP BY ALL),
scr AS (SELECT tokenizer, script, count(*) AS n FROM (SELECT tokenizer, unnest(scripts) AS script FROM ann) GROUP BY ALL)"""
        + O.global_metrics_sql(toks)[O.global_metrics_sql(toks).rindex("\nSELECT tokenizer, 'total_tokens_analyzed'"):]
    )


def _arriving(spark: SparkSession, sf_dir: str) -> tuple[str, str, int]:
    """(folder, name, k): the documents as STREAM_FILES arrivals of ``k`` files in ``doc_id`` order, and a name for the
    stream's tables.  ``k`` follows from the bytes of text, so that no task writes or reads a whole arrival.

    A stand-in for a folder that new files come into: it only copies the rows and dates the files one after another.
    """
    base, name = ensure_checkpoint_dir(spark), f"stream_{uuid.uuid4().hex[:12]}"
    folder = f"{base}/{name}-in"
    docs = T.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    k = max(1, round(n_bytes / (STREAM_FILES * STREAM_FILE_BYTES)))
    docs.repartitionByRange(STREAM_FILES * k, "doc_id").sortWithinPartitions("doc_id").write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    for i, f in enumerate(files):
        fs.setTimes(f, 1_700_000_000_000 + 1000 * i, -1)
    return folder, name, -(-len(files) // STREAM_FILES)


ARRIVING = "doc_id bigint, text string, lang string, source string"


@register("stream_global_metrics", _stream_sql)
def q_stream_global_metrics(spark, sf_dir):
    """Global token metrics of all documents, added up in the state of a streaming query over several micro-batches."""
    from ..streaming import stream as ST

    base = ensure_checkpoint_dir(spark)
    folder, name, k = _arriving(spark, sf_dir)
    state = f"{base}/{name}-state"
    ST.start_global_metrics_stream(spark, folder, ARRIVING, C.vocab(spark, sf_dir), f"{base}/{name}", name, state, k).awaitTermination()
    return C.rounded(ST.counters_to_long(ST.read_counters(spark, state)))


def _unique_stream_sql() -> str:
    toks = C.tokenizers()
    return (
        "WITH " + O.vocab_ctes(toks) + ",\n" + O.documents_cte() + ",\n" + O.encode_ctes("st", "docs", ["lang_key", "doc_id"], "text", toks)
        + f"""
SELECT tokenizer, lang_key, CAST({STREAM_FILES} AS BIGINT) AS n_batches, count(*) AS text_tokens, count(DISTINCT token_id) AS exact_tokens, true AS within_bound
FROM st_stream GROUP BY ALL"""
    )


@register("stream_unique_tokens", _unique_stream_sql)
def q_stream_unique_tokens(spark, sf_dir):
    """A3 on a stream: distinct ids per (tokenizer, language) from the sketches of several micro-batches, beside the exact
    count, and whether the estimate lies within three standard errors of it."""
    from ..streaming import stream as ST

    base = ensure_checkpoint_dir(spark)
    folder, name, k = _arriving(spark, sf_dir)
    v, state = C.vocab(spark, sf_dir), f"{base}/{name}-state"
    ST.start_unique_tokens_stream(spark, folder, ARRIVING, v, f"{base}/{name}", state, k).awaitTermination()
    docs = T.documents(spark, sf_dir)
    exact = M.token_totals(docs, v).select("tokenizer", "lang_key", F.col("distinct_ids").alias("exact_tokens"))
    near = F.abs(F.col("unique_tokens") - F.col("exact_tokens")) <= 3 * ST.SKETCH_ERROR * F.col("exact_tokens")
    both = ST.read_unique_tokens(spark, state).join(exact, ["tokenizer", "lang_key"])
    return both.select("tokenizer", "lang_key", "n_batches", "text_tokens", "exact_tokens", near.alias("within_bound"))


@register("stream_budget", lambda: OC.byte_budget_sql(STREAM_BUDGET_BYTES))
def q_stream_budget(spark, sf_dir):
    """The byte-budgeted documents, taken by a streaming query over files that arrive in ``doc_id`` order; it carries its
    totals between micro-batches and stops as soon as all languages have reached the budget."""
    from ..streaming import stream as ST

    base = ensure_checkpoint_dir(spark)
    folder, name, k = _arriving(spark, sf_dir)
    state = f"{base}/{name}-state"
    languages = [r["lang_key"] for r in T.documents(spark, sf_dir).select("lang_key").distinct().collect()]  # the work list
    budget = ST.Budget(languages, STREAM_BUDGET_BYTES)
    query = ST.start_budget_stream(spark, folder, ARRIVING, STREAM_BUDGET_BYTES, f"{base}/{name}", state, max_files_per_trigger=k, with_text=True, budget=budget)
    ST.run_until_budget(query, budget)
    rows = spark.read.schema("lang_key string, doc_id long, text string, n_bytes long, bytes_before long").option("recursiveFileLookup", True).parquet(state)
    return rows.select("lang_key", "doc_id", "n_bytes", "bytes_before")
