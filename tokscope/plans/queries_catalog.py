"""Registered catalogue, corpus and scalar queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import corpus as CO
from ..session import ensure_checkpoint_dir, materialize
from ..sources import catalog as CAT
from ..sources import registry as REG
from ..sources import text as T
from . import context as C
from . import oracle as O
from . import oracle_catalog as OC
from .queries import register

# ---------------------------------------------------------------------------
# Fixed parameters of the registered queries.
TOP_N = 3
LISTED_SUBSETS = ["fra_Latn", " deu_Latn ", "xxx_Yyyy"]
BUDGET_BYTES = 100_000
FALLBACK_BYTES = 2 * 1024 * 1024
# ---------------------------------------------------------------------------


def _cat(spark, sf_dir):
    return CAT.natural_catalogue(spark, sf_dir)


@register("catalog_valid", lambda: "WITH " + OC.catalogue_ctes() + "\nSELECT catalog_pos, name, script, iso_code, disk_size, subset, family FROM valid")
def q_catalog_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The natural catalogue without the total row and rows lacking name or script."""
    return CAT.catalog_valid(_cat(spark, sf_dir))


@register("parse_size", lambda: "WITH " + OC.catalogue_ctes() + f"\nSELECT catalog_pos, name, disk_size, {OC.parse_size_sql('disk_size')} AS size_gb FROM catalogue")
def q_parse_size(spark, sf_dir):
    """catalogue size strings as GB (every catalogue row, the total row included)."""
    return _cat(spark, sf_dir).select("catalog_pos", "name", "disk_size", S.parse_size_gb(F.col("disk_size")).alias("size_gb"))


@register("top_languages", lambda: "WITH " + OC.catalogue_ctes() + f"\nSELECT catalog_pos, name, iso_code, script, size_gb FROM valid ORDER BY size_gb DESC, catalog_pos LIMIT {TOP_N}")
def q_top_languages(spark, sf_dir):
    """The largest languages of the catalogue (a top-k report)."""
    return CAT.top_languages(_cat(spark, sf_dir), TOP_N).select("catalog_pos", "name", "iso_code", "script", "size_gb")


@register(
    "listed_languages",
    lambda: "WITH " + OC.catalogue_ctes() + "\nSELECT catalog_pos, name, iso_code, script, subset FROM catalogue WHERE name IS NOT NULL AND script IS NOT NULL AND subset IN ("
    + ", ".join(O.q(s.strip()) for s in LISTED_SUBSETS) + ")",
)
def q_listed_languages(spark, sf_dir):
    """Catalogue languages named in a list of subsets."""
    return CAT.listed_languages(_cat(spark, sf_dir), LISTED_SUBSETS).select("catalog_pos", "name", "iso_code", "script", "subset")


@register(
    "catalogue_csv",
    lambda: "WITH " + OC.catalogue_ctes() + "\nSELECT CAST(row_number() OVER (ORDER BY catalog_pos) - 1 AS INTEGER) AS catalog_pos, "
    "name, script, iso_code, disk_size, subset, family FROM catalogue",
)
def q_catalogue_csv(spark, sf_dir):
    """The natural catalogue written as one CSV file (a row per language) and read back with its file order."""
    cols = ["name", "script", "iso_code", "disk_size", "subset", "family"]
    path = f"{ensure_checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    CAT.write_csv(_cat(spark, sf_dir).coalesce(1).sortWithinPartitions("catalog_pos").select(*cols), path)
    back = CAT.read_catalogue_csv(spark, path, ", ".join(f"{c} string" for c in cols))
    return back.select("catalog_pos", *cols)


@register("metrics_csv", lambda: O.language_metrics_sql())
def q_metrics_csv(spark, sf_dir):
    """The metric records exported as CSV and read back with their schema."""
    rows = C.metrics(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/metrics-{uuid.uuid4().hex}"
    CAT.write_csv(rows, path)
    return C.rounded(spark.read.schema(rows.schema).option("header", True).csv(path))


def _work_list_sql() -> str:
    return "WITH " + OC.catalogue_ctes() + ",\n" + "work AS (" + OC.work_list_sql(TOP_N) + ")\nSELECT * FROM work"


@register("work_list", _work_list_sql)
def q_work_list(spark, sf_dir):
    """English + top natural languages + code languages, duplicate keys flagged."""
    wl = CAT.work_list(spark, _cat(spark, sf_dir), natural_n=TOP_N)
    return wl.withColumn("position", F.col("position").cast("int"))


@register(
    "lang_key",
    lambda: "WITH " + O.documents_cte(with_code=True) + "\nSELECT DISTINCT lang_key, iso_code, script, source FROM docs",
)
def q_lang_key(spark, sf_dir):
    """Language keys of every text source (natural and code)."""
    docs = T.documents(spark, sf_dir).unionByName(CAT.code_sources(spark, sf_dir))
    return docs.select("lang_key", "iso_code", "script", "source").distinct()


@register(
    "display_name",
    lambda: """SELECT DISTINCT source AS raw, array_to_string(list_transform(regexp_extract_all(source, '[\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+'),
       lambda r: CASE WHEN regexp_matches(r, '^[\\p{Lu}\\p{Ll}\\p{Lt}]') THEN upper(r[1]) || lower(r[2:]) ELSE r END), '') || ' (code)' AS display_name
FROM (SELECT source FROM documents UNION ALL SELECT role FROM conversations UNION ALL SELECT regexp_extract(url, '^https?://([^/]+)', 1) FROM pages)""",
)
def q_display_name(spark, sf_dir):
    """Python-style title case of names found in the tables (document origins, roles, hosts)."""
    d = T.read_table(spark, sf_dir, "documents").select(F.col("source").alias("raw"))
    c = T.read_table(spark, sf_dir, "conversations").select(F.col("role").alias("raw"))
    p = T.read_table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("raw"))
    names = d.unionByName(c).unionByName(p).distinct()
    return names.select("raw", F.concat(S.title_case(F.col("raw")), F.lit(" (code)")).alias("display_name"))


@register(
    "language_seed",
    lambda: "WITH " + O.documents_cte(with_code=True)
    + "\nSELECT DISTINCT lang_key, CAST(CAST('0x' || substr(sha1(iso_code || ':' || script), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM docs",
)
def q_language_seed(spark, sf_dir):
    """per-language sampling seed (first 8 bytes of SHA-1, unsigned) as text."""
    docs = T.documents(spark, sf_dir).unionByName(CAT.code_sources(spark, sf_dir))
    langs = docs.select("lang_key", "iso_code", "script").distinct()
    return langs.select("lang_key", S.language_seed(F.col("iso_code"), F.col("script")).cast("string").alias("seed"))


@register(
    "safe_output_name",
    lambda: "SELECT DISTINCT lang || '/' || source || '-v1' AS name, translate(lang || '/' || source || '-v1', '/-', '__') AS output_name FROM documents",
)
def q_safe_output_name(spark, sf_dir):
    """Output names for per-(language, origin) result files ('/' and '-' become '_')."""
    d = T.read_table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("-v1")).alias("name")).distinct()
    return d.select("name", S.safe_output_name(F.col("name")).alias("output_name"))


@register(
    "scan_documents",
    lambda: "WITH " + O.documents_cte() + "\nSELECT lang_key, iso_code, script, language, source, doc_id, text FROM docs",
)
def q_scan_documents(spark, sf_dir):
    """The documents text source (non-empty texts, language keyed)."""
    return C.documents(spark, sf_dir)


@register(
    "units_whitespace",
    lambda: f"SELECT doc_id, CAST(len(u) AS BIGINT) AS n_units, md5(array_to_string(u, chr(1))) AS units_md5 FROM (SELECT doc_id, {O.ws_units('text')} AS u FROM documents WHERE text IS NOT NULL AND text <> '')",
)
def q_units_whitespace(spark, sf_dir):
    """whitespace units of every document (count and a digest of the whole list)."""
    d = C.documents(spark, sf_dir)
    u = S.whitespace_units(F.col("text"))
    return d.select("doc_id", F.size(u).cast("long").alias("n_units"), F.md5(F.array_join(u, "\u0001")).alias("units_md5"))


@register(
    "units_character",
    lambda: f"SELECT doc_id, CAST(len(u) AS BIGINT) AS n_units, md5(array_to_string(u, chr(1))) AS units_md5 FROM (SELECT doc_id, {O.char_units('text')} AS u FROM documents WHERE text IS NOT NULL AND text <> '')",
)
def q_units_character(spark, sf_dir):
    """character units (printable, non-space) of every document."""
    d = C.documents(spark, sf_dir)
    joined = S.joined_character_units(F.col("text"), "\u0001")
    return d.select("doc_id", S.character_unit_count(F.col("text")).cast("long").alias("n_units"), F.md5(joined).alias("units_md5"))


@register("byte_budget", lambda: OC.byte_budget_sql(BUDGET_BYTES))
def q_byte_budget(spark, sf_dir):
    """Documents taken per language while the bytes before them stay under the budget."""
    return CO.byte_budget(C.documents(spark, sf_dir), BUDGET_BYTES).select("lang_key", "doc_id", "n_bytes", "bytes_before")


@register("corpus_sample", lambda: OC.corpus_sample_sql(BUDGET_BYTES))
def q_corpus_sample(spark, sf_dir):
    """The budgeted corpus cut to exactly the budget (separators counted, UTF-8 safe)."""
    c = CO.corpus_sample(C.documents(spark, sf_dir), BUDGET_BYTES)
    return c.select("lang_key", "doc_seq", "doc_id", "start_byte", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


@register("fallback_text", lambda: OC.fallback_sql(FALLBACK_BYTES))
def q_fallback_text(spark, sf_dir):
    """Fallback text of every catalogue language; ``is_fallback`` where no text exists."""
    return CO.fallback_rows(spark, _cat(spark, sf_dir), C.documents(spark, sf_dir), FALLBACK_BYTES)


@register("quarantine", lambda: OC.quarantine_sql())
def q_quarantine(spark, sf_dir):
    """Per (source, language) validation; failing languages go to the error side."""
    # the sources' document keys differ in type, and only their texts matter here
    parts = [C.documents(spark, sf_dir), T.conversations(spark, sf_dir), CAT.code_sources(spark, sf_dir)]
    first, *others = [p.drop("doc_id") for p in parts]
    for p in others:
        first = first.unionByName(p)
    return CO.quarantine(first)


# --- source registry (S4), code catalogue from CSV (S2), refused texts (D2) ---------------------

#: How the registered query lays out the documents of each language: kind of source, and the kind itself.
LAYOUT = {
    "en": ("lines_json", REG.SourceKind("json", "content", "{iso_code}_{script}")),
    "de": ("table_csv", REG.SourceKind("csv", "text", "{data_dir}", {"multiLine": "true", "escape": '"'})),
    "fr": ("lines_text", REG.SourceKind("text", "value", "{iso_code}")),
    "es": ("fineweb2", REG.DEFAULT_KINDS["fineweb2"]),
}


def _laid_out(spark: SparkSession, sf_dir: str, root: str, registry: REG.Registry) -> DataFrame:
    """Writes the documents of each language the way its kind of source holds them; returns the work list.

    A stand-in for a corpus of mixed sources: it only writes the rows, with a further column beside the text.
    """
    docs = T.read_table(spark, sf_dir, "documents").where(T.non_empty(F.col("text"))).select("lang", "text", "source")
    names = {code: (iso, script) for code, iso, script, *_ in T.LANGUAGE_CODES}
    work = []
    for code, (kind, k) in LAYOUT.items():
        iso, script = names[code]
        language = {"lang_key": f"{iso}-{script}", "iso_code": iso, "script": script, "source": kind, "data_dir": f"{iso} data" if kind == "table_csv" else None}
        rows = docs.where(F.col("lang") == code).select(F.col("text").alias(k.column), "source")
        writer = (rows.select(k.column) if k.fmt == "text" else rows).write.format(k.fmt)
        writer.options(**({"header": True, "escape": '"'} if k.fmt == "csv" else {})).save(registry.folder(root, language))
        work.append(language)
    work.append({"lang_key": "kor-Hang", "iso_code": "kor", "script": "Hang", "source": "fineweb2", "data_dir": None})
    work.append({"lang_key": "xxx-Latn", "iso_code": "xxx", "script": "Latn", "source": "no such kind", "data_dir": None})
    return spark.createDataFrame([tuple(w.values()) for w in work], "lang_key string, iso_code string, script string, source string, data_dir string")


def _source_kinds_sql() -> str:
    code_of = {code: f"{iso}-{script}" for code, iso, script, *_ in T.LANGUAGE_CODES}
    parts = []
    for code, (_, k) in LAYOUT.items():
        rows = f"SELECT text FROM documents WHERE lang = {O.q(code)} AND text IS NOT NULL AND text <> ''"
        if k.fmt == "text":
            rows = f"SELECT text FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS text FROM ({rows})) WHERE text <> ''"
        parts.append(
            f"SELECT {O.q(code_of[code])} AS lang_key, count(*) AS n_docs, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_bytes, "
            f"CAST(coalesce(sum(CAST(('0x' || substr(md5(text), 1, 8)) AS BIGINT)), 0) AS BIGINT) AS text_sum, NULL AS problem FROM ({rows}) HAVING count(*) > 0"
        )
    return " UNION ALL ".join([*parts, "SELECT 'xxx-Latn', 0, 0, 0, 'unknown source: no such kind'"])


@register("source_kinds", _source_kinds_sql)
def q_source_kinds(spark, sf_dir):
    """The documents laid out as JSON, CSV, text and Parquet sources by language, read back through the registry; a
    missing folder gives no rows, an unknown kind of source a problem."""
    registry = REG.Registry()
    for name, kind in LAYOUT.values():
        registry.register(name, kind)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    work = _laid_out(spark, sf_dir, root, registry)
    rows = registry.scan_all(spark, root, work)
    part = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long")
    return rows.groupBy("lang_key").agg(
        F.count("text").alias("n_docs"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.sum(part), F.lit(0)).alias("text_sum"),
        F.min("problem").alias("problem"),
    )


CODE_N = 10


@register(
    "code_catalogue",
    lambda: f"""SELECT CAST(pos AS INTEGER) AS catalog_pos, s AS iso_code, 'code' AS script,
  array_to_string(list_transform(regexp_extract_all(s, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'),
       lambda r: CASE WHEN regexp_matches(r, '^[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]') THEN upper(r[1]) || lower(r[2:]) ELSE r END), '') || ' (code)' AS name,
  'starcoder' AS source, s AS data_dir
FROM (SELECT s, row_number() OVER (ORDER BY n DESC, s) - 1 AS pos FROM (SELECT source AS s, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source))
WHERE pos < {CODE_N}""",
)
def q_code_catalogue(spark, sf_dir):
    """A code catalogue read from CSV (the documents' origins, the most frequent first): its first rows in file order."""
    origins = T.read_table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/code-{uuid.uuid4().hex}"
    rows = origins.coalesce(1).sortWithinPartitions(F.col("n").desc(), "source")  # one row an origin
    CAT.write_csv(rows.select(F.col("source").alias("Language")), path)
    return CAT.code_languages(spark, CODE_N, CAT.read_code_catalogue(spark, path))


@register(
    "text_violations",
    lambda: " UNION ALL ".join(
        f"SELECT '{table}' AS origin, CASE WHEN {col} IS NULL THEN 'text is None' ELSE 'text is empty' END AS reason, count(*) AS n FROM {table} WHERE {col} IS NULL OR {col} = '' GROUP BY ALL"
        for table, col in (("documents", "text"), ("conversations", "text"), ("pages", "html"), ("benchmark", "text"))
    ),
)
def q_text_violations(spark, sf_dir):
    """Rows of the text tables that the library wrapper refuses, by reason."""
    from ..operators import metrics as M

    tables = (("documents", "text"), ("conversations", "text"), ("pages", "html"), ("benchmark", "text"))
    parts = [T.read_table(spark, sf_dir, t).select(F.lit(t).alias("origin"), F.col(c).alias("text")) for t, c in tables]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return M.text_violations(every, ["origin"])


# --- pytest-planned scalar keys, run over the whole documents table --------------------------

SLICE_START, SLICE_END = 7, 107


def _slice_sql() -> str:
    def cont(p: str) -> str:
        return f"({p} < n AND substr(h, 2 * {p} + 1, 1) IN ('8', '9', 'A', 'B'))"

    steps = [f"s0 AS (SELECT doc_id, h, n, {SLICE_START} AS s, least({SLICE_END}, n) AS e FROM (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''))"]
    for i in range(3):
        steps.append(f"s{i + 1} AS (SELECT doc_id, h, n, CASE WHEN {cont('s')} THEN s + 1 ELSE s END AS s, e FROM s{i})")
    for i in range(3, 6):
        steps.append(f"s{i + 1} AS (SELECT doc_id, h, n, s, CASE WHEN e > 0 AND {cont('e')} THEN e - 1 ELSE e END AS e FROM s{i})")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, CAST(strlen(t) AS BIGINT) AS n_bytes, md5(t) AS text_md5
FROM (SELECT doc_id, CASE WHEN e > s THEN decode(unhex(substr(h, 2 * s + 1, 2 * (e - s)))) ELSE '' END AS t FROM s6)"""


@register("utf8_slice", _slice_sql)
def q_utf8_slice(spark, sf_dir):
    """bytes [7, 107) of every document, broken edge characters dropped."""
    d = C.documents(spark, sf_dir)
    t = S.utf8_slice(F.col("text"), F.lit(SLICE_START), F.lit(SLICE_END))
    return d.select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.md5(t).alias("text_md5"))


@register(
    "units_syllable",
    lambda: f"""WITH u AS (
  SELECT lang, doc_id, CAST(len({O.syl_units('text')}) AS BIGINT) AS n_syl, CAST(len({O.syl_chars('text')}) AS BIGINT) AS n_syl_chars
  FROM documents WHERE text IS NOT NULL AND text <> ''
)
SELECT lang, doc_id, n_syl, n_syl_chars,
       CASE WHEN sum(n_syl) OVER (PARTITION BY lang) < {S.MIN_SYLLABLES} THEN n_syl_chars ELSE n_syl END AS n_units
FROM u""",
)
def q_units_syllable(spark, sf_dir):
    """every document segmented as a syllable language (tsheg split; a language with fewer
    than three syllables in all falls back to characters)."""
    d = T.read_table(spark, sf_dir, "documents").where(T.non_empty(F.col("text")))
    u = d.select(
        "lang",
        "doc_id",
        S.syllable_unit_count(F.col("text")).cast("long").alias("n_syl"),
        S.character_unit_count_without_tsheg(F.col("text")).cast("long").alias("n_syl_chars"),
    )
    u = materialize(u)  # slim, and read twice: the texts are scanned once
    tot = u.groupBy("lang").agg(F.sum("n_syl").alias("t"))
    j = u.join(F.broadcast(tot), "lang")  # one row per language
    n = F.when(F.col("t") < S.MIN_SYLLABLES, F.col("n_syl_chars")).otherwise(F.col("n_syl"))
    return j.select("lang", "doc_id", "n_syl", "n_syl_chars", n.alias("n_units"))


@register("snippet", lambda: O.snippet_sql() + "\nSELECT lang_key, byte_offset, CAST(strlen(text) AS BIGINT) AS text_bytes, md5(text) AS text_md5 FROM snip")
def q_snippet(spark, sf_dir):
    """a 300-byte snippet of every language; the seed modulo the span draws its offset."""
    from ..operators import metrics as M
    from ..operators import snippet as SN

    docs = C.documents(spark, sf_dir)
    heads = M.language_heads(docs)
    sep = M.with_separators(docs, heads, ["lang_key"])
    s = SN.snippets(sep, heads.select("lang_key", "iso_code", "script", "total_bytes"), draw="modulo")
    return s.select("lang_key", "byte_offset", F.octet_length("text").cast("long").alias("text_bytes"), F.md5("text").alias("text_md5"))
