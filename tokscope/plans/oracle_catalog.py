"""DuckDB SQL for catalogue, corpus and scalar queries."""

from __future__ import annotations

from ..functions import scalars as S
from ..sources import catalog as CAT
from ..sources.text import LANGUAGE_CODES
from .oracle import _values, q


def codes_sql() -> str:
    return _values(list(LANGUAGE_CODES), ["code", "iso_code", "script", "language", "family"])


def _two_decimals_sql(n: str, per_unit: int) -> str:
    cents = f"(CAST({n} AS BIGINT) * 100 // {per_unit})"
    return f"(CAST({cents} // 100 AS VARCHAR) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"


def size_string_sql(n: str) -> str:
    whens = " ".join(
        f"WHEN {n} >= {int(CAT.SIZE_SCALE * div)} THEN {_two_decimals_sql(n, int(CAT.SIZE_SCALE * div))} || ' {unit}'"
        for unit, div in CAT.SIZE_STEPS
    )
    return f"(CASE {whens} ELSE {_two_decimals_sql(n, int(CAT.SIZE_SCALE))} || ' MB' END)"


def parse_size_sql(col: str) -> str:
    s = f"trim(coalesce(CAST({col} AS VARCHAR), 'None'))"
    whens = []
    for unit, op, factor in S.SIZE_UNITS:
        num = f"TRY_CAST(trim(replace({s}, '{unit}', '')) AS DOUBLE)"
        whens.append(f"WHEN contains({s}, '{unit}') THEN {num} {op} {factor}")
    return f"(CASE {' '.join(whens)} ELSE 0.0 END)"


def catalogue_ctes() -> str:
    return f"""cat_per AS (
  SELECT lang, sum(strlen(text)) AS n_bytes FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY lang
),
cat_rows AS (
  SELECT coalesce(c.language, p.lang) AS name, c.script, coalesce(c.iso_code, p.lang) AS iso_code, p.n_bytes,
         CASE WHEN c.script IS NOT NULL THEN coalesce(c.iso_code, p.lang) || '_' || c.script END AS subset, c.family
  FROM cat_per p LEFT JOIN {codes_sql()} c ON p.lang = c.code
  UNION ALL
  SELECT {q(CAT.UNDETERMINED[1])}, NULL, {q(CAT.UNDETERMINED[0])}, n_bytes, NULL, NULL
  FROM (SELECT sum(strlen(text)) AS n_bytes FROM conversations WHERE text IS NOT NULL AND text <> '') WHERE n_bytes IS NOT NULL
),
cat_all AS (
  SELECT CAST(row_number() OVER (ORDER BY n_bytes DESC, name) - 1 AS INTEGER) AS catalog_pos, name, script, iso_code, n_bytes, subset, family FROM cat_rows
  UNION ALL
  SELECT CAST(count(*) AS INTEGER), {q(CAT.TOTAL)}, {q(CAT.TOTAL)}, {q(CAT.TOTAL)}, sum(n_bytes), NULL, NULL FROM cat_rows
),
catalogue AS (
  SELECT catalog_pos, name, script, iso_code, {size_string_sql('n_bytes')} AS disk_size, subset, family FROM cat_all
),
valid AS (
  SELECT *, {parse_size_sql('disk_size')} AS size_gb FROM catalogue
  WHERE name IS NOT NULL AND script IS NOT NULL AND iso_code IS DISTINCT FROM {q(CAT.TOTAL)}
)"""


def code_catalogue_sql() -> str:
    rows = [(str(i), name, name[:1].upper() + name[1:].lower() + " (code)") for i, (name, _) in enumerate(CAT.CODE_LANGUAGES)]
    return f"(SELECT CAST(pos AS INTEGER) AS catalog_pos, language, name FROM {_values(rows, ['pos', 'language', 'name'])})"


def code_rows_sql() -> str:
    parts = []
    for name, pattern in CAT.CODE_LANGUAGES:
        text = "html" if pattern is None else f"array_to_string(regexp_extract_all(html, {q(pattern)}, 1), chr(10))"
        parts.append(f"SELECT {q(name)} AS lang, page_id AS doc_id, {text} AS text FROM pages WHERE html IS NOT NULL AND html <> ''")
    return " UNION ALL ".join(parts)


def byte_budget_sql(target: int) -> str:
    from .oracle import documents_cte

    return "WITH " + documents_cte() + f""",
bb AS (
  SELECT lang_key, doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, text,
         CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY lang_key ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before
  FROM docs
)
SELECT lang_key, doc_id, n_bytes, bytes_before FROM bb WHERE bytes_before < {target}"""


def corpus_sample_sql(target: int) -> str:
    def cont(p: str) -> str:
        return f"({p} < strlen(seg) AND substr(h, 2 * {p} + 1, 1) IN ('8', '9', 'A', 'B'))"

    return byte_budget_sql(target).replace(
        f"SELECT lang_key, doc_id, n_bytes, bytes_before FROM bb WHERE bytes_before < {target}",
        f""", kept AS (SELECT *, row_number() OVER (PARTITION BY lang_key ORDER BY doc_id) - 1 AS doc_seq FROM bb WHERE bytes_before < {target}),
segs AS (
  SELECT lang_key, doc_seq, doc_id,
         CAST(CASE WHEN doc_seq = 0 THEN 0 ELSE bytes_before + doc_seq - 1 END AS BIGINT) AS start_byte,
         CASE WHEN doc_seq = 0 THEN text ELSE chr(10) || text END AS seg
  FROM kept
),
k0 AS (SELECT *, least(strlen(seg), {target} - start_byte) AS c0, hex(encode(seg)) AS h FROM segs WHERE least(strlen(seg), {target} - start_byte) > 0),
k1 AS (SELECT *, CASE WHEN {cont('c0')} THEN c0 - 1 ELSE c0 END AS c1 FROM k0),
k2 AS (SELECT *, CASE WHEN {cont('c1')} THEN c1 - 1 ELSE c1 END AS c2 FROM k1),
k3 AS (SELECT *, CASE WHEN {cont('c2')} THEN c2 - 1 ELSE c2 END AS c3 FROM k2),
cut AS (SELECT *, CASE WHEN c0 < strlen(seg) THEN decode(unhex(substr(h, 1, 2 * c3))) ELSE seg END AS out FROM k3)
SELECT lang_key, CAST(doc_seq AS BIGINT) AS doc_seq, doc_id, start_byte, CAST(strlen(out) AS BIGINT) AS n_bytes, md5(out) AS text_md5 FROM cut""",
    )


def fallback_sql(target: int) -> str:
    from ..operators import corpus as CO
    from .oracle import documents_cte

    phrase = "replace(" + q(CO.FALLBACK_PHRASE) + ", '{name}', name)"
    markers = " AND ".join(f"contains(t, {q(m)})" for m in CO.FALLBACK_MARKERS)
    return "WITH " + catalogue_ctes() + ",\n" + documents_cte() + f""",
present AS (SELECT DISTINCT lang_key FROM docs),
fb AS (
  SELECT v.iso_code || '-' || v.script AS lang_key, v.name, p.lang_key IS NULL AS is_fallback,
         left(repeat({phrase}, greatest({CO.FALLBACK_REPETITIONS}, CAST({target} // strlen({phrase}) AS INTEGER) + 1)), {target}) AS t
  FROM valid v LEFT JOIN present p ON p.lang_key = v.iso_code || '-' || v.script
)
SELECT lang_key, name, is_fallback, CAST(strlen(t) AS BIGINT) AS n_bytes, md5(t) AS text_md5, ({markers}) AS has_markers FROM fb"""


def quarantine_sql() -> str:
    from ..sources.text import UNKNOWN_SCRIPT
    from .oracle import documents_cte

    return "WITH " + documents_cte(with_code=True) + f""",
conv AS (
  SELECT 'und-{UNKNOWN_SCRIPT}/' || role AS lang_key, '{UNKNOWN_SCRIPT}' AS script, 'conversations' AS source, text
  FROM conversations WHERE text IS NOT NULL AND text <> ''
),
src AS (SELECT lang_key, script, source, text FROM docs UNION ALL SELECT * FROM conv),
per AS (SELECT source, lang_key, script, count(*) AS n_docs, sum(strlen(text)) AS n_bytes FROM src GROUP BY ALL),
chk AS (
  SELECT *, CASE WHEN script = '{UNKNOWN_SCRIPT}' THEN 'unknown language code'
                 WHEN coalesce(n_bytes, 0) = 0 THEN 'empty corpus'
                 WHEN count(*) OVER (PARTITION BY lang_key) > 1 THEN 'duplicate language key' END AS reason
  FROM per
)
SELECT source, lang_key, CAST(n_docs AS BIGINT) AS n_docs, CASE WHEN reason IS NULL THEN 'ok' ELSE 'error' END AS status, reason FROM chk"""


def work_list_sql(natural_n: int) -> str:
    """U1 over the catalogue CTEs: a SELECT of its own, with duplicate keys flagged."""
    iso, script, name, source = CAT.ENGLISH_ROW
    return f"""
WITH top AS (SELECT * FROM valid ORDER BY size_gb DESC, catalog_pos LIMIT {natural_n}),
blocks AS (
  SELECT 0 AS block, 0 AS pos, {q(iso)} AS iso_code, {q(script)} AS script, {q(name)} AS name, {q(source)} AS source, NULL::VARCHAR AS data_dir
  UNION ALL SELECT 1, catalog_pos, iso_code, script, name, 'fineweb2', NULL FROM top
  UNION ALL SELECT 2, catalog_pos, language, 'code', name, 'starcoder', language FROM {code_catalogue_sql()}
),
numbered AS (
  SELECT *, CAST(row_number() OVER (ORDER BY block, pos) - 1 AS INTEGER) AS position,
         CASE WHEN source = 'starcoder' THEN iso_code || '-code' ELSE iso_code || '-' || script END AS lang_key
  FROM blocks
)
SELECT position, lang_key, iso_code, script, name, source, data_dir,
       row_number() OVER (PARTITION BY lang_key ORDER BY position) > 1 AS duplicate_key
FROM numbered"""
