"""N-gram Jaccard join: MinHash bands with exact verification (operator 4).

Two documents are linked if the Jaccard similarity of their sets of word five-grams is 0.8 or more.

1. Each text becomes the set of its five-grams (64-bit fingerprints of five consecutive words; a text of fewer
   words has one shingle, all its words).  Texts with equal sets form a *class*; one row stands for it.
2. Banding of fixed depth, in place of an LSH forest: every class has TREES bands of ``depth`` MinHash values each,
   hashed into one node name per band.  The depth is the same for all and chosen before any data is read: the
   greatest up to MAX_DEPTH for which the expected recall of a pair right at the threshold,
   ``1 - (1 - t**depth) ** TREES``, reaches TARGET_RECALL (6).  Classes under one node are candidates.  More similar
   pairs have a higher recall.  There are no tries, no full labels and no shortening by the density of the data.
3. A node's classes meet in the group of the node's least class: one row per (group, class), never a row per
   pair.  Large groups are cut into chunks of about CHUNK classes, and each pair of chunks is a task's unit, so
   memory is bounded and no class is dropped.
4. Verification compares the exact sets of all pairs of a unit (bit matrices of shared shingles).  A pair that
   several groups hold counts in the least of them alone.  Only counts and a spanning star per linked cluster
   leave the task.
5. Connected components give each document its class id: the least doc_id it is linked with, directly or over
   others.

Cost within a cluster of n different near copies is n**2 comparisons of bit rows, as all its links count.

Result: doc_id, class_id, n_links (documents linked with this one, its equals among them).  Defined results:
null or empty text, or one without a word, has no shingles, so no links, and is its own class; repeated rows
give repeated rows, each a link of the other; a null doc_id can't be named in a link, so it has a null class and
no links; rows that share a doc_id but not the text are compared each by its own text, and belong to the class of
that text; an empty table gives no rows; a very long text is one row of its task's unit; ties (equal least ids) name the
same class id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCodes, batch, map_arrow, mix64, table, texts, window_hashes, words_of, written
from .components import components

SHINGLE = 5
#: The threshold as a fraction, so that equality is exact.
THRESHOLD = (4, 5)
TREES = 32
MAX_DEPTH = 10
TARGET_RECALL = 0.9999
CHUNK = 1000
SALTS = 16


def recall(depth: int, trees: int = TREES, threshold: tuple[int, int] = THRESHOLD) -> float:
    """Expected share of pairs right at the threshold that meet under some node of this depth."""
    return 1 - (1 - (threshold[0] / threshold[1]) ** depth) ** trees


def matched_depth(target: float = TARGET_RECALL, trees: int = TREES, threshold: tuple[int, int] = THRESHOLD) -> int:
    """The greatest depth up to MAX_DEPTH that reaches the target recall."""
    depth = MAX_DEPTH
    while depth > 1 and recall(depth, trees, threshold) < target:
        depth -= 1
    return depth


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct fingerprints of the n-grams of hashed words."""
    return np.unique(window_hashes(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def prefixes(s: np.ndarray, trees: int, depth: int, rng_seed: int = 11) -> np.ndarray:
    """For each band its node: a 64-bit name of ``depth`` MinHash values and the band."""
    rng = np.random.default_rng(rng_seed)
    a = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    low = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        v = x[None, i : i + 2048] * a[:, None]
        v += b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    name = np.arange(1, trees + 1, dtype=np.uint64)
    for column in low.reshape(trees, depth).T:
        name = mix64(name * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return name.view(np.int64)


def sketches(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, text_key, a and b (128 bits that name the shingle set; null without shingles), nodes, z (compressed words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from xxhash import xxh3_128_digest

        codes, pack = WordCodes(), zstandard.ZstdCompressor(level=3).compress
        for got in batches:
            codes.trim()
            a, b, nodes, z = [], [], [], []
            for t in got.column("text").to_pylist():
                words = words_of(t)
                at = codes.of(words)
                s = shingles(codes.hashes()[at])
                if not len(s):
                    a.append(None), b.append(None), nodes.append(None), z.append(None)
                    continue
                pair = np.frombuffer(xxh3_128_digest(s.tobytes()), "<i8")
                a.append(int(pair[0])), b.append(int(pair[1]))
                nodes.append(prefixes(s, trees, depth))
                z.append(pack(b" ".join(words)))
            yield batch(
                doc_id=got.column("doc_id"),
                text_key=got.column("text_key"),
                a=pa.array(a, pa.int64()),
                b=pa.array(b, pa.int64()),
                nodes=pa.array(nodes, pa.list_(pa.int64())),
                z=pa.array(z, pa.binary()),
            )

    named = texts(docs).withColumn("text_key", F.xxhash64("text"))
    return map_arrow(named, run, "doc_id long, text_key long, a long, b long, nodes array<long>, z binary")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Square boolean matrix: which pairs (one of ``left``, one of ``right``) reach the threshold."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, ids, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[ids] > 1
    ids, owner = np.unique(ids[shared], return_inverse=True)[1], owner[shared]
    both = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(ids, kind="stable")
    ids, owner, step = ids[order], owner[order], 2048
    width = int(ids[-1]) + 1 if len(ids) else 0
    for lo in range(0, width, step):
        i, j = np.searchsorted(ids, (lo, lo + step))
        bits = np.zeros((n, min(step, width - lo)), dtype=np.float32)
        bits[owner[i:j], ids[i:j] - lo] = 1
        both += bits @ bits.T
    both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    out = both * threshold[1] >= union * threshold[0]
    np.fill_diagonal(out, False)
    side = left[:, None] & right[None, :]
    return out & (side | side.T)


UNIT = "a long, b long, links long, root long"


def verified(units: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Per unit and linked class: its links counted here, and the least class name (a) of its cluster within the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, codes = zstandard.ZstdDecompressor().decompress, WordCodes()

        def unit(rows: list[dict]) -> pa.RecordBatch | None:
            codes.trim()
            at = [codes.of(unpack(r["z"]).split()) for r in rows]
            sets = [shingles(codes.hashes()[x]) for x in at]
            chunk = np.array([r["chunk"] for r in rows])
            m, i, j = (rows[0][k] for k in ("m", "i", "j"))
            ok = linked(sets, chunk == i, chunk == j, threshold)
            near = ok.any(axis=1)
            if not near.any():
                return None
            counted, earlier = ok.copy(), {}
            for k, r in enumerate(rows):
                for other in r["groups"]:
                    if other < m:
                        earlier.setdefault(other, []).append(k)
            for members in earlier.values():  # these pairs count in that group
                if len(members) > 1:
                    counted[np.ix_(members, members)] = False
            links = counted @ np.array([r["size"] for r in rows], dtype=np.int64)
            root = np.array([r["a"] for r in rows], dtype=np.int64)
            while True:  # least name of the cluster
                low = np.minimum(root, np.where(ok, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (low == root).all():
                    break
                root = low
            keep = np.flatnonzero(near)
            return batch(
                a=pa.array([rows[k]["a"] for k in keep], pa.int64()),
                b=pa.array([rows[k]["b"] for k in keep], pa.int64()),
                links=pa.array(links[keep], pa.int64()),
                root=pa.array(root[keep]),
            )

        rows, key = [], None
        for got in batches:
            for r in got.to_pylist():
                if (now := (r["m"], r["i"], r["j"])) != key:
                    if len(rows) > 1 and (out := unit(rows)) is not None:
                        yield out
                    rows, key = [], now
                rows.append(r)
        if len(rows) > 1 and (out := unit(rows)) is not None:
            yield out

    return map_arrow(units, run, UNIT)


def join(
    docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs``."""
    return named_join(docs, threshold, target, trees, chunk).select("doc_id", "class_id", "n_links")


def named_join(
    docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, text_key (hash of the text), root (names the class; null without shingles or id), class_id, n_links."""
    sketch = written(sketches(docs, trees, matched_depth(target, trees, threshold)), "sketches")
    named = sketch.where(F.col("doc_id").isNotNull() & F.col("a").isNotNull())
    classes = named.groupBy("a", "b").agg(F.count("*").alias("size"), F.first("z").alias("z"))

    under = named.select("a", "b", F.explode("nodes").alias("node"))
    shared = under.groupBy("node").agg(F.min("a").alias("m"), F.max("a").alias("last")).where("m < last").select("node", "m")
    member = written(under.join(shared, "node").select("m", "a", "b").distinct(), "members")
    # a large group's rows are spread over SALTS tasks, its one size row is repeated for each
    sizes = member.groupBy("m").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    groups = member.groupBy("a", "b").agg(F.array_sort(F.collect_set("m")).alias("groups"))
    units = (
        classes.join(groups, ["a", "b"])
        .withColumn("m", F.explode("groups"))
        .withColumn("salt", F.pmod(F.xxhash64("b", "a"), F.lit(SALTS)).cast("int"))
        .join(sizes, ["m", "salt"])
        .withColumn("chunk", F.pmod(F.xxhash64("a", "b"), F.col("chunks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .select("m", "i", "j", "chunk", "a", "b", "size", "groups", "z")
        .repartition("m", "i", "j")
        .sortWithinPartitions("m", "i", "j")
    )
    found = written(verified(units, threshold), "links")
    roots = components(found.select(F.col("a").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("a", "b").agg(F.sum("links").alias("links"))
    per_class = (
        named.groupBy("a", "b")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
        .join(links, ["a", "b"], "left")
        .join(roots.withColumnRenamed("node", "a"), "a", "left")
        .select("a", "b", F.coalesce("root", "a").alias("root"), "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    ids = per_class.groupBy("root").agg(F.min("rep").alias("class_id"))
    per_class = per_class.join(ids, "root").select("a", "b", "root", "class_id", "n_links")
    none = F.lit(None).cast("long")
    rest = sketch.where(F.col("doc_id").isNull() | F.col("a").isNull())
    return (
        named.select("doc_id", "text_key", "a", "b")
        .join(per_class, ["a", "b"])
        .select("doc_id", "text_key", "root", "class_id", "n_links")
        .unionByName(rest.select("doc_id", "text_key", none.alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one of the least (doc_id, text hash); null ids all stay.

    Rows that agree in doc_id and text are one row; unlike texts under one doc_id are judged each by its own class.
    """
    key = "__text_key"
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = named_join(docs).where(F.col("doc_id").isNotNull())
    least = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    least = least.unionByName(rows.where(F.col("root").isNull()).select("doc_id", "text_key"))
    least = least.select(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key")).distinct()
    kept = named.join(least, (F.col("doc_id").cast("long") == F.col("__kept_id")) & (F.col(key) == F.col("__kept_key")), "left_semi")
    return kept.dropDuplicates(["doc_id", key]).drop(key).unionByName(docs.where(F.col("doc_id").isNull()))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
