"""Helpers shared by the operators of this subpackage: inputs, shared tables, words, Arrow batches."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Workers get the functions of this package with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])

#: Bytes of one Arrow batch sent to Python (a longer row is a batch of its own): bounds a worker's memory.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the named columns; everything else is dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the session's shared checkpoint folder and read it back.

    Cuts the lineage at a table every executor can read, so a lost executor costs no earlier stage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders written by this process, by application.
_WRITTEN: dict[str, list[str]] = {}


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that operators of this session wrote to the shared folder; returns their number.

    To be called when the results have been used or saved: a result that still reads such a table is lost.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of about BATCH_BYTES bytes (the session's setting, lowered if it is larger)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("b")) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str) -> list[bytes]:
    """The contracts' words ``[^\\x20\\x09-\\x0D]+`` in UTF-8: bytes.split() cuts at just these six bytes."""
    return text.encode("utf-8", "surrogatepass").split()


class WordCodes(dict):
    """word -> code, given out in order of first sight; ``code64`` has each code's 64-bit hash.

    ``trim()`` between batches empties it once it holds more than ``limit`` words, which bounds a worker's memory.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit, self.words = limit, []
        self.code64 = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self.words)
        self.words.append(word)
        return code

    def trim(self) -> bool:
        if len(self.words) <= self.limit:
            return False
        self.clear()
        self.words, self.code64 = [], np.empty(0, np.uint64)
        return True

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def hashes(self) -> np.ndarray:
        """Of all codes so far."""
        if (old := len(self.code64)) < len(self.words):
            from xxhash import xxh3_64_intdigest as digest

            new = self.words[old:]
            self.code64 = np.concatenate([self.code64, np.fromiter(map(digest, new), np.uint64, len(new))])
        return self.code64


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` consecutive values (order matters)."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : len(h) - n + 1 + i]
    return mix64(out)
