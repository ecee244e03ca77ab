"""DuckDB SQL for the result and report queries: one WITH list ending in ``rows`` and ``ranks``."""

from __future__ import annotations

from ..operators import report as R
from ..operators.results import REPORT_GLOBAL_COLUMNS
from ..sources import catalog as CAT
from . import oracle as O
from . import oracle_catalog as OC

TIMESTAMP = 1_700_000_000.0


def rows_with(toks, docs_cte: str | None = None, size_mb: float = 1.0, samples: bool = False) -> str:
    """WITH list ending in ``rows`` over all sources, or over the ``docs`` of ``docs_cte``; with the snippets' columns if asked."""
    ctes = O.language_metrics_ctes(toks, with_code=True)
    if docs_cte is not None:
        ctes[0] = docs_cte
    ctes += [O.decoded_vocab_ctes(toks), O.VOCAB_ANALYSIS]
    ctes += O.sampled_tokens_ctes(toks)
    ctes += [O.annotated_vocab_cte(), O.ANNOTATED_SAMPLE.strip()]
    gm_cols = []
    for c in REPORT_GLOBAL_COLUMNS:
        if c == "total_tokens_analyzed":
            e = "CAST(t.total AS DOUBLE)"
        elif c == "tokens_starting_with_space_pct":
            e = "CAST(t.sp AS DOUBLE) / t.total * 100.0"
        elif c == "tokens_with_whitespace_in_middle_pct":
            e = "CAST(t.inn AS DOUBLE) / t.total * 100.0"
        elif c == "tokens_with_script_overlap_pct":
            e = "CAST(t.ov AS DOUBLE) / t.total * 100.0"
        else:
            script = c[len("tokens_with_") : -len("_unicode_pct")]
            e = f"(SELECT CAST(s.n AS DOUBLE) / t.total * 100.0 FROM scr s WHERE s.tokenizer = t.tokenizer AND lower(s.script) = '{script}' AND s.n > 0)"
        gm_cols.append(f"{e} AS {c}")
    ctes.append("gm AS (SELECT t.tokenizer, " + ", ".join(gm_cols) + " FROM tot t WHERE t.total > 0)")
    if docs_cte is None:  # else it comes with the documents
        ctes.append(OC.catalogue_ctes())
    eng = CAT.ENGLISH_RANK_NAME
    ctes.append(f"""present AS (SELECT DISTINCT language FROM metrics),
natpos AS (
  SELECT name AS language, max(idx) AS pos FROM (
    SELECT name, row_number() OVER (ORDER BY {OC.parse_size_sql('disk_size')} DESC, catalog_pos) - 1 AS idx
    FROM catalogue WHERE name IS NOT NULL AND disk_size IS NOT NULL AND iso_code IS DISTINCT FROM {O.q(CAT.TOTAL)})
  GROUP BY name
),
blocks AS (
  SELECT 0 AS block, language, 0 AS pos FROM present WHERE language = {O.q(eng)}
  UNION ALL SELECT 1, language, pos FROM natpos WHERE NOT suffix(language, '(code)')
  UNION ALL SELECT 2, name, catalog_pos FROM {OC.code_catalogue_sql()}
  UNION ALL SELECT 3, language, 0 FROM present
),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY block, pos) AS k FROM blocks) WHERE k = 1),
ranked AS (SELECT language, CAST(row_number() OVER (ORDER BY block, pos, language) - 1 AS INTEGER) AS language_rank FROM firsts),
ranks AS (SELECT p.language, r.language_rank FROM present p LEFT JOIN ranked r USING (language))""")
    sample_cols = sample_join = ""
    if samples:
        snip = O.snippet_sql().split(O.SEP_DOCS + ",\n", 1)[1]
        per = O.sample_preview_sql(toks).split(O.decoded_vocab_ctes(toks), 1)[1].rsplit("\nSELECT t.tokenizer, s.lang_key", 1)[0]
        ctes.append(snip + ",\n" + O.ordered_encode_ctes("sn", "snip", ["lang_key"], "text", toks) + per)
        sample_cols = """, s.byte_offset AS sample_byte_offset, CAST(strlen(s.text) AS BIGINT) AS sample_text_bytes, md5(s.text) AS sample_text_md5,
         CAST(len(p.ts) AS INTEGER) AS sample_token_count, p.p AS sample_tokens_preview"""
        sample_join = " LEFT JOIN snip s ON s.lang_key = m.lang_key LEFT JOIN prev p ON p.lang_key = m.lang_key AND p.tokenizer = m.tokenizer"
    ctes.append(f"""rows AS (
  SELECT m.tokenizer AS tokenizer_key, m.tokenizer AS tokenizer_name, m.language, m.iso_code, m.script, m.source, m.lang_key,
         m.bytes_per_token, m.total_bytes, m.total_tokens, m.unique_tokens, m.vocab_size, CAST({size_mb!r} AS DOUBLE) AS benchmark_size_mb,
         CAST({TIMESTAMP} AS DOUBLE) AS timestamp, m.subword_fertility, m.word_split_pct, 'word_split_pct' AS word_split_source,
         va.tokens_without_leading_space_pct, va.tokens_without_leading_space_count, va.analyzed_sample_size,
         {", ".join("gm." + c for c in REPORT_GLOBAL_COLUMNS)}, r.language_rank, va.sample_non_space_tokens, va.sample_space_tokens{sample_cols}
  FROM metrics m LEFT JOIN va USING (tokenizer) LEFT JOIN gm USING (tokenizer) LEFT JOIN ranks r USING (language){sample_join}
)""")
    return "WITH " + ",\n".join(ctes)


FLAT_DOUBLES = {
    "bytes_per_token",
    "subword_fertility",
    "word_split_pct",
    "tokens_without_leading_space_pct",
    "benchmark_size_mb",
    "timestamp",
    *REPORT_GLOBAL_COLUMNS,
}
FLAT_COLUMNS = (
    "tokenizer_key", "tokenizer_name", "language", "iso_code", "script", "source", "lang_key", "bytes_per_token",
    "total_bytes", "total_tokens", "unique_tokens", "vocab_size", "benchmark_size_mb", "timestamp", "subword_fertility",
    "word_split_pct", "word_split_source", "tokens_without_leading_space_pct", "tokens_without_leading_space_count",
    "analyzed_sample_size", *REPORT_GLOBAL_COLUMNS,
)


def flat_select(cols=FLAT_COLUMNS, table: str = "rows") -> str:
    return "SELECT " + ", ".join(O.rnd(c) + f" AS {c}" if c in FLAT_DOUBLES else c for c in cols) + f" FROM {table}"


def categories_sql(toks) -> str:
    o = "rank_key, language"
    eu_tags = " OR ".join(f"contains(lower(script), '{t}')" for t in R.EUROPEAN_SCRIPT_TAGS)
    fam = ", ".join(O.q(f) for f in R.EUROPEAN_FAMILIES)
    exc = ", ".join(O.q(x) for x in R.EUROPEAN_NAME_EXCEPTIONS)
    cjk = " OR ".join(f"contains(lower(script), '{t}')" for t in R.CJK_SCRIPT_TAGS)

    def numbered(src: str, cat: str, order: str = o) -> str:
        return f"SELECT '{cat}' AS category, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS position, language FROM {src}"

    bands = " UNION ALL ".join(
        f"SELECT '{name}', CAST(position - {lo} AS INTEGER), language FROM natrank WHERE position >= {lo} AND position < {hi}"
        for name, lo, hi in R.RANK_BANDS
    )
    return rows_with(toks) + f""",
lfirst AS (
  SELECT language, coalesce(script, '') AS script FROM (
    SELECT language, script, row_number() OVER (PARTITION BY language ORDER BY tokenizer_key, lang_key) AS k FROM rows) WHERE k = 1
),
lfam AS (SELECT name, max_by(family, catalog_pos) AS family FROM catalogue GROUP BY name),
langs_t AS (
  SELECT f.language, f.script,
         CASE WHEN contains(lower(f.language), '(code)') OR lower(f.script) = 'code' THEN 'code'
              WHEN contains(lower(f.language), 'english') THEN 'english' ELSE 'natural' END AS kind,
         coalesce(CAST(mr.language_rank AS DOUBLE), {R.NO_RANK}) AS rank_key, coalesce(lf.family, '') AS family
  FROM lfirst f JOIN (SELECT language, min(language_rank) AS language_rank FROM rows GROUP BY language) mr USING (language)
  LEFT JOIN lfam lf ON lf.name = f.language
),
nat AS (SELECT * FROM langs_t WHERE kind = 'natural'),
eng AS (SELECT * FROM langs_t WHERE kind = 'english'),
code AS (SELECT * FROM langs_t WHERE kind = 'code'),
allb AS (SELECT language, 0 AS b, {o} FROM eng UNION ALL SELECT language, 1, {o} FROM nat UNION ALL SELECT language, 2, {o} FROM code),
topeng AS (SELECT * FROM eng ORDER BY language LIMIT 1),
natrank AS (
  SELECT language, row_number() OVER (ORDER BY b, {o}) - 1 AS position
  FROM (SELECT language, 0 AS b, {o} FROM topeng UNION ALL SELECT language, 1, {o} FROM nat)
),
eu AS (SELECT * FROM nat WHERE language IN ({exc}) OR (({eu_tags}) AND family IN ({fam}))),
noneu AS (SELECT * FROM nat WHERE language NOT IN (SELECT language FROM eu)),
cats AS (
  {numbered('allb', 'All Languages', 'b, ' + o)}
  UNION ALL {bands}
  UNION ALL {numbered('code', 'Coding')}
  UNION ALL {numbered('eu', 'European')}
  UNION ALL {numbered('noneu', 'Non-European')}
  UNION ALL {numbered("(SELECT * FROM langs_t WHERE contains(lower(script), 'latn'))", 'Latin Script')}
  UNION ALL {numbered("(SELECT * FROM langs_t WHERE contains(lower(script), 'cyrl'))", 'Cyrillic Script')}
  UNION ALL {numbered("(SELECT * FROM langs_t WHERE contains(lower(script), 'arab'))", 'Arabic Script')}
  UNION ALL {numbered(f"(SELECT * FROM langs_t WHERE {cjk})", 'CJK Scripts')}
)"""
