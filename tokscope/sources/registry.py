"""Source registry (S4): where the text of a language lies and how it is read, by the kind of its source.

A kind names a format, the column that holds the text, and the folder of a language below the corpus root.  All
languages of a kind are one column-pruned scan of just their folders (partition pruning by path), read by Spark's own
readers, so any store that Spark can open will do.  A row that the reader cannot parse is kept with a ``problem``
instead of a text, so that the run can report its language (:mod:`..operators.run`).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import non_empty

CORRUPT = "_corrupt_record"
UNREADABLE = "unreadable row"


@dataclass(frozen=True)
class SourceKind:
    fmt: str  # parquet, json, csv or text
    column: str  # the column that holds the text
    folder: str  # of a language, below the corpus root: its columns in braces
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.fmt not in ("parquet", "json", "csv", "text"):
            raise ValueError(f"unknown format {self.fmt!r}")

    def read(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """``(file, block, row, text, problem)`` of the files below ``paths``; only the text column is read."""
        r = spark.read.options(**self.options)
        where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        row = F.monotonically_increasing_id().alias("row")  # in file order within a file's block
        none = F.lit(None).cast("string").alias("problem")
        if self.fmt == "text":
            return r.text(paths).select(*where, row, F.col("value").alias("text"), none)
        column = F.col(f"`{self.column}`").cast("string").alias("text")
        if self.fmt == "parquet":
            return r.schema(f"`{self.column}` string").parquet(*paths).select(*where, row, column, none)
        r = r.schema(f"`{self.column}` string, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        if self.fmt == "csv":
            # columns are named by the header, whatever else the files hold
            df = spark.read.options(**self.options).option("header", True).csv(paths)
            return df.select(*where, row, column, none)
        df = r.json(paths)
        return df.select(*where, row, column, F.when(F.col(CORRUPT).isNotNull(), F.lit(UNREADABLE)).alias("problem"))


# ---------------------------------------------------------------------------
# The benchmark's kinds of source, their folders and text columns.
DEFAULT_KINDS: dict[str, SourceKind] = {
    "fineweb2": SourceKind("parquet", "text", "{iso_code}_{script}"),
    "fineweb": SourceKind("parquet", "text", "sample-10BT"),
    "starcoder": SourceKind("parquet", "content", "{data_dir}"),
}
# ---------------------------------------------------------------------------


class Registry:
    """Kinds of source by name."""

    def __init__(self, kinds: Mapping[str, SourceKind] | None = None):
        self.kinds = dict(DEFAULT_KINDS if kinds is None else kinds)

    def register(self, name: str, kind: SourceKind) -> None:
        if not name:
            raise ValueError("a kind of source needs a name")
        self.kinds[name] = kind

    def kind(self, name: str) -> SourceKind:
        if name not in self.kinds:
            raise ValueError(f"unknown source: {name}")
        return self.kinds[name]

    def folder(self, root: str, language: Mapping[str, str | None]) -> str:
        """The folder of a language (``iso_code, script, source, data_dir``); code without a folder of its own lies under its code."""
        values = {k: v if v is not None else "" for k, v in language.items()}
        values["data_dir"] = language.get("data_dir") or language["iso_code"]
        return f"{root.rstrip('/')}/{language['source']}/{self.kind(language['source']).folder.format(**values)}"

    def scan(self, spark: SparkSession, root: str, language: Mapping[str, str | None]) -> DataFrame:
        """``(doc_id, text, problem)`` of one language; an unknown kind of source is an error."""
        return _documents(self.kind(language["source"]).read(spark, [self.folder(root, language)])).drop("file")

    def scan_all(self, spark: SparkSession, root: str, work: DataFrame) -> DataFrame:
        """``(lang_key, doc_id, text, problem)`` of a work list (a catalogue's rows, collected): a scan per kind.

        A language whose folder is missing has no rows; one whose kind is unknown has a single row with that problem.
        """
        found: dict[str, dict[str, str]] = {}
        lost: list[tuple[str, str]] = []
        for r in work.select("lang_key", "iso_code", "script", "source", "data_dir").distinct().collect():
            if r["source"] not in self.kinds:
                lost.append((r["lang_key"], f"unknown source: {r['source']}"))
                continue
            path = self.folder(root, r.asDict())
            if _exists(spark, path):
                found.setdefault(r["source"], {})[path] = r["lang_key"]
        out = spark.createDataFrame(lost, "lang_key string, problem string").select(
            "lang_key", F.lit(None).cast(DOC_ID).alias("doc_id"), F.lit(None).cast("string").alias("text"), "problem"
        )
        for name, folders in sorted(found.items()):
            rows = _documents(self.kind(name).read(spark, sorted(folders)))
            # a folder is named by its last two parts: the kind and the language's
            below = {"/".join(p.split("/")[-2:]): k for p, k in folders.items()}
            keys = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
            folder = F.url_decode(F.replace(F.regexp_extract("file", "([^/]+/[^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))
            out = out.unionByName(rows.select(F.element_at(keys, folder).alias("lang_key"), "doc_id", "text", "problem"))
        return out


DOC_ID = "struct<file:string,block:bigint,row:bigint>"


def _documents(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("problem").isNotNull() | non_empty(F.col("text")))
    return rows.select("file", F.struct("file", "block", "row").alias("doc_id"), "text", "problem")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
