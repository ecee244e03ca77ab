"""Language catalogues (S1-S3), their hygiene and selection (P1, P2, T1, U1), derived from data.

The natural catalogue has one row per language of ``documents`` (sizes written as strings
like ``"612.35 MB"``), one row for the undetermined language of ``conversations`` (no
script) and a ``Total`` row, so that the hygiene rules have something to remove.  The code
catalogue lists code languages in a meaningful order; their texts come from ``pages``.
Row order is explicit (``catalog_pos``) because ranks and ties depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import materialize
from . import text as T

# ---------------------------------------------------------------------------
# Fixed values.
# Code languages extracted from ``pages`` in catalogue order, with the pattern whose group 1
# is the code (``None`` = the whole page).
CODE_LANGUAGES: tuple[tuple[str, str | None], ...] = (
    ("html", None),
    ("css", r"(?s)<style[^>]*>(.*?)</style>"),
    ("javascript", r"(?s)<script[^>]*>(.*?)</script>"),
)
# The English row put in front of every work list.
ENGLISH_ROW = ("eng", "Latn", "English (FineWeb)", "fineweb")
ENGLISH_RANK_NAME = "English (FineWeb)"
# Name of the catalogue's total row and of the language of ``conversations``.
TOTAL = "Total"
UNDETERMINED = ("und", "Undetermined")
# Catalogue sizes: bytes are scaled by 1/1000 and written in the largest unit reaching 1.
SIZE_SCALE = 1000.0
SIZE_STEPS: tuple[tuple[str, float], ...] = (("TB", 1e6), ("GB", 1e3), ("MB", 1.0))
# ---------------------------------------------------------------------------

NATURAL_COLUMNS = ("catalog_pos", "name", "script", "iso_code", "disk_size", "subset", "family")


def _two_decimals(n_bytes: Column, per_unit: int) -> Column:
    """``n_bytes / per_unit`` truncated to two decimals, formatted with integer arithmetic only."""
    cents = F.floor((n_bytes * F.lit(100)).cast("long") / F.lit(per_unit)).cast("long")
    return F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def size_string(n_bytes: Column) -> Column:
    """Catalogue size text: bytes / 1000 in the largest unit reaching 1 (MB, GB, TB), 2 decimals."""
    out = None
    for unit, div in SIZE_STEPS:
        per_unit = int(SIZE_SCALE * div)
        s = F.concat(_two_decimals(n_bytes, per_unit), F.lit(" " + unit))
        cond = n_bytes >= F.lit(per_unit)
        out = F.when(cond, s) if out is None else out.when(cond, s)
    return out.otherwise(F.concat(_two_decimals(n_bytes, int(SIZE_SCALE)), F.lit(" MB")))


def natural_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(catalog_pos, name, script, iso_code, disk_size, subset, family)``; order = size desc."""
    docs = T.read_table(spark, sf_dir, "documents").select("lang", "text").where(T.non_empty(F.col("text")))
    per = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    codes = F.broadcast(T.language_codes(spark))
    langs = per.join(codes, per.lang == codes.code, "left").select(
        F.coalesce("language", "lang").alias("name"),
        F.col("script"),
        F.coalesce("iso_code", "lang").alias("iso_code"),
        "n_bytes",
        F.when(F.col("script").isNotNull(), F.concat_ws("_", F.coalesce("iso_code", "lang"), "script")).alias("subset"),
        F.col("family"),
    )
    conv = T.read_table(spark, sf_dir, "conversations").select("text").where(T.non_empty(F.col("text")))
    und = conv.agg(F.sum(F.octet_length("text")).alias("n_bytes")).where(F.col("n_bytes").isNotNull()).select(
        F.lit(UNDETERMINED[1]).alias("name"),
        F.lit(None).cast("string").alias("script"),
        F.lit(UNDETERMINED[0]).alias("iso_code"),
        "n_bytes",
        F.lit(None).cast("string").alias("subset"),
        F.lit(None).cast("string").alias("family"),
    )
    rows = materialize(langs.unionByName(und))  # one row per language, read twice: the texts are scanned once
    # at most a few hundred rows (one per language): a global window is cheap here
    ordered = rows.withColumn("catalog_pos", F.row_number().over(Window.orderBy(F.col("n_bytes").desc(), "name")) - 1)
    total = rows.agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n")).select(
        F.col("n").cast("int").alias("catalog_pos"),
        F.lit(TOTAL).alias("name"),
        F.lit(TOTAL).alias("script"),
        F.lit(TOTAL).alias("iso_code"),
        "n_bytes",
        F.lit(None).cast("string").alias("subset"),
        F.lit(None).cast("string").alias("family"),
    )
    both = ordered.select(F.col("catalog_pos").cast("int"), "name", "script", "iso_code", "n_bytes", "subset", "family").unionByName(total)
    return both.select(
        "catalog_pos", "name", "script", "iso_code", size_string(F.col("n_bytes")).alias("disk_size"), "subset", "family"
    )


def code_catalogue(spark: SparkSession) -> DataFrame:
    """S2 source: ``(catalog_pos, language)`` in catalogue order."""
    return spark.createDataFrame([(i, name) for i, (name, _) in enumerate(CODE_LANGUAGES)], "catalog_pos int, language string")


def read_code_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """S2 source from a CSV with a ``Language`` column: ``(catalog_pos, language)`` in file order."""
    rows = read_catalogue_csv(spark, path, "Language string")
    return rows.select("catalog_pos", F.col("Language").alias("language"))


def code_languages(spark: SparkSession, n: int = 20, catalogue: DataFrame | None = None) -> DataFrame:
    """First ``n`` code languages of a catalogue (the shipped one if none is given) as language info rows."""
    cat = (code_catalogue(spark) if catalogue is None else catalogue).where(F.col("catalog_pos") < n)
    lang = F.trim(F.col("language"))
    return cat.select(
        "catalog_pos",
        lang.alias("iso_code"),
        F.lit("code").alias("script"),
        F.concat(S.title_case(lang), F.lit(" (code)")).alias("name"),
        F.lit("starcoder").alias("source"),
        lang.alias("data_dir"),
    )


def code_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 for code: the text of each code language, cut out of ``pages`` (column-pruned scan)."""
    pg = T.read_table(spark, sf_dir, "pages").select("page_id", "html").where(T.non_empty(F.col("html")))
    parts = []
    for name, pattern in CODE_LANGUAGES:
        if pattern is None:
            text = F.col("html")
        else:
            text = F.array_join(F.regexp_extract_all(F.col("html"), F.lit(pattern), 1), "\n")
        parts.append(F.struct(F.lit(name).alias("lang"), text.alias("text")))
    rows = pg.select("page_id", F.inline(F.array(*parts))).where(T.non_empty(F.col("text")))
    iso = F.col("lang")
    return T.dealt(
        rows.select(
            T.lang_key(iso, F.lit("code"), F.lit("starcoder")).alias("lang_key"),
            iso.alias("iso_code"),
            F.lit("code").alias("script"),
            F.concat(S.title_case(iso), F.lit(" (code)")).alias("language"),
            F.lit("starcoder").alias("source"),
            F.col("page_id").alias("doc_id"),
            "text",
        ),
        "doc_id",
    )


def english_row(spark: SparkSession) -> DataFrame:
    """S3: the fixed English row."""
    return spark.createDataFrame([ENGLISH_ROW], "iso_code string, script string, name string, source string")


# --- P1, P2, T1, U1 ------------------------------------------------------------


def catalog_valid(cat: DataFrame) -> DataFrame:
    """Drop rows without name or script, and the total row."""
    return cat.dropna(subset=["name", "script"]).where(F.col("iso_code").isNull() | (F.col("iso_code") != F.lit(TOTAL)))


def with_size(cat: DataFrame) -> DataFrame:
    return cat.withColumn("size_gb", S.parse_size_gb(F.col("disk_size")))


def top_languages(cat: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest valid languages; ties keep catalogue order (a top-k, not a sort)."""
    v = with_size(catalog_valid(cat))
    return v.orderBy(F.col("size_gb").desc(), F.col("catalog_pos").asc()).limit(n)


def listed_languages(cat: DataFrame, subsets: list[str]) -> DataFrame:
    """Languages whose subset is listed (entries trimmed); catalogue order kept."""
    wanted = sorted({s.strip() for s in subsets if s and s.strip()})
    return cat.dropna(subset=["name", "script"]).where(F.col("subset").isin(*wanted))


def language_info(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("iso_code", "script", "name", F.lit(source).alias("source"), F.lit(None).cast("string").alias("data_dir"))


def work_list(spark: SparkSession, cat: DataFrame, natural_n: int = 99, code_n: int = 20, listed: list[str] | None = None) -> DataFrame:
    """English, then the natural choice (listed subsets, else the top ``natural_n``), then code.

    ``position`` keeps the order; ``lang_key`` duplicates are flagged, not dropped silently.
    """
    eng = english_row(spark).select("iso_code", "script", "name", "source", F.lit(None).cast("string").alias("data_dir"))
    natural = listed_languages(cat, listed) if listed else top_languages(cat, natural_n)
    nat = natural.select(
        "catalog_pos", "iso_code", "script", "name", F.lit("fineweb2").alias("source"), F.lit(None).cast("string").alias("data_dir")
    )
    code = code_languages(spark, code_n)
    blocks = (
        eng.select(F.lit(0).alias("block"), F.lit(0).alias("pos"), "*")
        .unionByName(nat.select(F.lit(1).alias("block"), F.col("catalog_pos").alias("pos"), "iso_code", "script", "name", "source", "data_dir"))
        .unionByName(code.select(F.lit(2).alias("block"), F.col("catalog_pos").alias("pos"), "iso_code", "script", "name", "source", "data_dir"))
    )
    w = Window.orderBy("block", "pos")
    key = T.lang_key(F.col("iso_code"), F.col("script"), F.col("source"))
    out = blocks.withColumn("position", F.row_number().over(w) - 1).withColumn("lang_key", key)
    dup = Window.partitionBy("lang_key").orderBy("position")
    return out.withColumn("duplicate_key", F.row_number().over(dup) > 1).select(
        "position", "lang_key", "iso_code", "script", "name", "source", "data_dir", "duplicate_key"
    )


def read_catalogue_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A catalogue CSV with a header; header names are trimmed and ``catalog_pos`` keeps the
    file order (``monotonically_increasing_id`` grows with partition index and row order)."""
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema else r).csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    pos = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1
    return df.withColumn("catalog_pos", pos.cast("int"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header; array and map columns are written as JSON text."""
    from pyspark.sql import types as T

    cols = [
        F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
