"""Substring dedup by recompression (operator 6).

A window is WINDOW consecutive words of one document.  Each word that lies in a window whose words also start in
a document with a smaller doc_id is removed; windows are judged on the input.

1. Recompression: rounds name runs of equal symbols and pairs of neighbours; a name is a hash of what it stands
   for, so it is the same in every task.  Only short symbols take part in a round, so an edge between symbols
   depends on CONTEXT words around it: equal word sequences hold the same symbols but near their ends.
2. Each window is stood for by the least symbol well inside it.  Consecutive windows with one symbol are one row:
   ``k``, a hash of the words that all of them share, and ``e``, a hash of all their words.  This is about one row
   for 18 words.  (A window without an inside symbol, in a long repeat of one word, is known by its own words.)
   In periodic text a group recurs and overlaps itself: all its repetitions are one row.
3. Spark groups by ``k``.  A ``k`` of one document is done.  Where all rows of a ``k`` agree in ``e``, all windows
   of all documents but the first go.  Where they don't, rows agree or not by ``e``; and for one document of each
   ``e`` the single windows are hashed and compared, which settles the ends of repeats.
4. The removed stretches of each document meet its text again, and the remaining words are joined.

Groups are counted by partial aggregates, so a passage that a third of all documents share is one row per task;
rows never form pairs.  Equality is that of two independent 64-bit hashes of the words.

Result: doc_id, n_words, n_removed, kept (the remaining words, joined by one blank).  Defined results: null or
empty text has no words; texts of fewer than WINDOW words keep all; repeated rows (equal doc_id) are no earlier
document for each other, and each gives a row; a null doc_id is neither before nor after any other, so its words
stay and it removes none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCodes, batch, map_arrow, mix64, table, texts, words_of, written
from .recompression import CONTEXT, Prefix, chosen, parse

WINDOW = 50
_LONE = np.uint64(0x5851F42D4C957F2D)


def window_groups(lens: np.ndarray, h: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(first word, number of windows, distance to its last repetition, k, e) of the groups of windows.

    ``h`` holds documents of ``lens`` words one after the other.  A group that recurs at once is one row: its
    repetitions overlap, so they cover one stretch of words.
    """
    ends = np.cumsum(lens)
    edge = np.zeros(len(h), dtype=bool)
    edge[(ends - lens)[lens > 0]] = True
    at = np.arange(len(h), dtype=np.int64)
    at = at[np.repeat(ends, lens) - at >= window]
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    name, start, end = parse(h, edge)
    symbol = chosen(name, start, end, at, window)
    new = (np.diff(symbol, prepend=-2) != 0) | (symbol < 0) | (np.diff(at, prepend=-2) != 1)
    cut = np.flatnonzero(new)
    n = np.diff(np.append(cut, len(at)))
    lo, symbol = at[cut], symbol[cut]
    doc = np.searchsorted(ends, lo, side="right")
    inside, prefix = symbol >= 0, Prefix(h)
    here = np.maximum(symbol, 0)
    k = np.where(
        inside,
        prefix.of(np.where(inside, start[here] - CONTEXT, lo), np.where(inside, end[here] + CONTEXT, lo + window), 0),
        mix64(prefix.of(lo, lo + window, 0) ^ _LONE),
    )
    shift = np.where(inside, start[here] - lo, 0).astype(np.uint64)
    e = mix64(prefix.of(lo, lo + n - 1 + window, 1) + shift)
    # equal groups of one document, each starting within the one before (periodic text): one row
    order = np.lexsort((lo, e, k, doc))
    lo, n, k, e, doc = (x[order] for x in (lo, n, k, e, doc))
    alike = (k[1:] == k[:-1]) & (e[1:] == e[:-1]) & (doc[1:] == doc[:-1]) & (np.diff(lo) <= window)
    first = np.flatnonzero(np.append(True, ~alike))
    span = lo[np.append(first[1:], len(lo)) - 1] - lo[first]
    order = np.argsort(lo[first], kind="stable")
    return tuple(x[order] for x in (lo[first], n[first], span, k[first].view(np.int64), e[first].view(np.int64)))


GROUPS = "doc_id long, text_key long, k array<long>, e array<long>, lo array<int>, n array<int>, span array<int>"


def keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def parsed(docs: DataFrame, window: int) -> DataFrame:
    """The window groups of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for b in batches:
            codes.trim()
            at = [codes.of(words_of(t)) for t in b.column("text").to_pylist()]
            lens = np.fromiter(map(len, at), np.int64, len(at))
            h = codes.hashes()[np.concatenate(at)] if len(at) else np.empty(0, np.uint64)
            lo, n, span, k, e = window_groups(lens, h, window)
            starts = np.cumsum(lens) - lens
            doc = np.searchsorted(np.cumsum(lens), lo, side="right")
            cut = pa.array(np.searchsorted(doc, np.arange(len(at) + 1)), pa.int32())
            lists = lambda x, kind: pa.ListArray.from_arrays(cut, pa.array(x, kind))
            yield batch(
                doc_id=b.column("doc_id"),
                text_key=b.column("text_key"),
                k=lists(k, pa.int64()),
                e=lists(e, pa.int64()),
                lo=lists(lo - starts[doc] if len(lo) else lo, pa.int32()),
                n=lists(n, pa.int32()),
                span=lists(span, pa.int32()),
            )

    return map_arrow(keyed(docs), run, GROUPS)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, z: the words of each text, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [pack(b" ".join(words_of(t))) for t in b.column("text").to_pylist()]
            yield batch(doc_id=b.column("doc_id"), text_key=b.column("text_key"), z=pa.array(z, pa.binary()))

    return map_arrow(keyed(docs), run, "doc_id long, text_key long, z binary")


def single_windows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """w1, w2 (a window's hashes), doc_id, k, e, j: each window of the wanted groups (doc_id, text_key, k, e, lo, n)."""
    per_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("k", "e", "lo", "n")).alias("groups"))
    rows = packed(docs).join(per_doc, ["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codes, unpack = WordCodes(), zstandard.ZstdDecompressor().decompress
        for b in batches:
            codes.trim()
            for r in b.to_pylist():
                at = codes.of(unpack(r["z"]).split())
                prefix = Prefix(codes.hashes()[at])
                n = np.array([g["n"] for g in r["groups"]], dtype=np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                lo = np.array([g["lo"] for g in r["groups"]], dtype=np.int64)[owner] + j
                of = lambda name: np.array([g[name] for g in r["groups"]], dtype=np.int64)[owner]  # noqa: B023, E731
                yield batch(
                    w1=pa.array(prefix.of(lo, lo + window, 0).view(np.int64)),
                    w2=pa.array(prefix.of(lo, lo + window, 1).view(np.int64)),
                    doc_id=pa.array([r["doc_id"]] * len(owner), pa.int64()),
                    k=pa.array(of("k")),
                    e=pa.array(of("e")),
                    j=pa.array(j, pa.int32()),
                )

    return map_arrow(rows, run, "w1 long, w2 long, doc_id long, k long, e long, j int")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, lo, hi: stretches of words covered by windows that an earlier document has."""
    groups = written(parsed(docs, window).where(F.col("doc_id").isNotNull()), "window-groups")
    rows = groups.select("doc_id", "text_key", F.inline(F.arrays_zip("k", "e", "lo", "n", "span")))
    shared = (
        rows.groupBy("k")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("e").alias("e0"), F.max("e").alias("e1"))
        .where("first < last")
        .select("k", "first", (F.col("e0") == F.col("e1")).alias("alike"))
    )
    hits = written(rows.join(shared, "k"), "shared-groups")
    whole = lambda df: df.select("doc_id", "text_key", "lo", (F.col("lo") + F.col("span") + F.col("n") - 1 + window).alias("hi"))

    alike = hits.where("alike and doc_id > first")
    differ = hits.where("not alike")
    first_of = differ.groupBy("k", "e").agg(F.min(F.struct("doc_id", "text_key", "lo", "n")).alias("r"))
    first_of = written(first_of.select("k", "e", "r.*"), "first-groups")
    both = differ.join(first_of.select("k", "e", F.col("doc_id").alias("m")), ["k", "e"])
    single = written(single_windows(docs, first_of, window), "single-windows")
    seen = single.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    again = single.join(seen, ["w1", "w2"]).where(F.col("doc_id") > F.col("first")).select("k", "e", "j").distinct()
    ends = both.where(F.col("doc_id") == F.col("m")).join(again, ["k", "e"])
    return (
        whole(alike)
        .unionByName(whole(both.where(F.col("doc_id") > F.col("m"))))
        .unionByName(ends.select("doc_id", "text_key", (F.col("lo") + F.col("j")).alias("lo"), (F.col("lo") + F.col("j") + F.col("span") + window).alias("hi")))
    )


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of ``docs``."""
    found = repeats(docs, window).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("gone"))
    rows = packed(docs).join(found, ["doc_id", "text_key"], "left").select("doc_id", "z", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out: list[tuple] = []
            for doc_id, z, gone in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), b.column("gone").to_pylist(), strict=True):
                raw = unpack(z)
                words = raw.split()
                n = len(words)
                if gone:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [g["lo"] for g in gone], 1)
                    np.add.at(edge, [g["hi"] for g in gone], -1)
                    left = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
                    words = [words[i] for i in left]
                    raw = b" ".join(words)
                out.append((doc_id, n, n - len(words), raw))
            ids, total, removed, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield batch(
                doc_id=pa.array(ids, pa.int64()),
                n_words=pa.array(total, pa.int64()),
                n_removed=pa.array(removed, pa.int64()),
                kept=pa.array(kept, pa.binary()).cast(pa.string()),
            )

    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
