"""Phrase collocation mining: phrases of 2 to MAX_WORDS words that stand together more often than their parts suggest.

Method (mergeable Misra-Gries summaries, then an exact count):

1. One scan packs normalised text into blocks of one language and about BLOCK_BYTES, and writes them. Each block gives its
   n-grams of 1 to MAX_WORDS words as cells: for each hash partition (leading bits of a 64-bit hash of language, length
   and words) the sorted 32-bit rests of the hashes with their counts in the block. The number of hash partitions follows
   from the corpus, so that one has about PARTITION_MASS n-grams.
2. All cells of a hash partition meet in one task and are merged into a Misra-Gries summary: counters are added and,
   beyond the capacity, all are lowered by the first counter over it. The capacity, ROOM * mass // least + 1 counters,
   exceeds mass / least; everything taken off is at most mass / (capacity + 1) < least / ROOM, so each n-gram with
   ``least`` occurrences keeps a counter. Counters that even with all that was taken off stay under ``least`` go.
   What survives is returned to each block as one bit for each entry of its cell.
3. Each block meets its bits and counts the surviving n-grams by their words (equal hashes only let more survive). The
   counts are dealt out by hash and added up: exact counts of all n-grams with ``least`` or more occurrences.

Every part of such a phrase is at least as frequent, so scores need no further scan. Looking up a part's count joins on
the part; parts with a HOT-th of all words or more (at most HOT a length, hence a bounded table) are broadcast, and no
other part can have more than words / HOT / least phrases.

Defined results: null text: empty; null lang: ``und``; texts without two words in a piece: no phrase; repeated rows:
each counts; empty table: no rows; ties of score and count: by phrase in UTF-8 byte order; other columns are ignored. A
text of any length is cut into blocks at the ends of pieces; only a piece without an end makes a longer block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordCodes, map_arrow, mix64, table, written

# Fixed by the contract.
MAX_WORDS, LEAST, TOP, SHARE, SCALE = 3, 10, 2000, 50, 1_000_000
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Normalised bytes of a block; bytes turned into words at a time; n-grams of a hash partition; see above.
BLOCK_BYTES, STEP_BYTES, PARTITION_MASS, ROOM, HOT = 2 << 20, 1 << 20, 4 << 20, 4, 10_000

_UPPER = bytes(range(65, 91))
#: Words that a task keeps the codes of between two blocks.
LIMIT = 100_000
#: No byte of UTF-8: stands where a piece ends.
END = b"\xff"
_TABLE = bytes.maketrans(_UPPER + ENDS, _UPPER.lower() + END * len(ENDS))


def normalised(text: str | None) -> bytes:
    """A-Z in lower case, ends of pieces as END."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def packed(x: np.ndarray) -> bytes:
    """Bytes of an integer array, compressed plane by plane if that pays."""
    if len(x) < 64:
        return b"\0" + x.tobytes()
    return b"\1" + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unpacked(body: bytes, kind) -> np.ndarray:
    if body[:1] == b"\0":
        return np.frombuffer(body, kind, offset=1)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


class Words:
    """Codes of a block's words; code ``end`` stands for the end of a piece."""

    def __init__(self):
        self.codes = WordCodes(LIMIT)

    def of(self, body: bytes) -> np.ndarray:
        self.codes.trim()
        self.end = self.codes[END]
        out, at = [], 0
        while at < len(body):
            to = body.find(b" ", at + STEP_BYTES)
            to = len(body) if to < 0 else to
            out.append(self.codes.of(body[at:to].replace(END, b" \xff ").split()))
            at = to
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def grams(self, codes: np.ndarray, lang: str, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, starts, 64-bit hashes) of the n-grams within pieces, for n from 1 to ``most``."""
        from xxhash import xxh3_64_intdigest

        w = self.codes.hashes()[codes]
        word = codes != self.end
        seed = xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        h, whole = np.zeros(len(w), np.uint64), np.ones(len(w), bool)
        for n in range(1, most + 1):
            if len(codes) < n:
                return
            h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + w[n - 1 :]
            whole = whole[: len(codes) - n + 1] & word[n - 1 :]
            starts = np.flatnonzero(whole)
            yield n, starts, mix64(h[starts] + np.uint64((seed + n * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))


def _keys(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hash partition and 32 bits of the rest, as one number."""
    return hashes >> np.uint64(32 - bits)


BLOCK = "block long, lang string, body binary"
CELL = "bucket int, block long, mass long, body binary, counts binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held, size = {}, {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal block
            body = END.join(held.pop(lang))
            del size[lang]
            at = 0
            while at < len(body):
                to = body.find(END, at + block_bytes)
                to = len(body) if to < 0 else to
                yield _batch([(block, lang, zstandard.ZstdCompressor(1).compress(body[at:to]))], BLOCK)
                at = to + 1
                block += 1

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                body = normalised(text.as_py())
                if not body:
                    continue
                held.setdefault(lang, []).append(body)
                size[lang] = size.get(lang, 0) + len(body) + 1
                if size[lang] >= block_bytes:
                    yield from flush(lang)
                elif sum(size.values()) >= 4 * block_bytes:
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return run


def _cells(bits: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for block, lang, body in zip(b.column("block").to_pylist(), b.column("lang").to_pylist(), b.column("body"), strict=True):
                codes = words.of(zstandard.ZstdDecompressor().decompress(body.as_py()))
                keys, n = np.unique(_block_keys(words, codes, lang, bits, most), return_counts=True)
                out = []
                for bucket, a, b_ in _borders(keys, bits):
                    out.append((bucket, block, int(n[a:b_].sum()), packed(_steps(keys[a:b_].astype(np.uint32))), packed(n[a:b_].astype(np.uint32))))
                    if len(out) == 4096:
                        yield _batch(out, CELL)
                        out = []
                if out:
                    yield _batch(out, CELL)

    return run


def _block_keys(words: Words, codes: np.ndarray, lang: str, bits: int, most: int) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(_keys(h, bits) for _, _, h in words.grams(codes, lang, most))])


def _borders(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(hash partition, from, to) of the sorted keys that lie in it."""
    if not len(keys):
        return
    at = np.flatnonzero(np.diff(keys >> np.uint64(32), prepend=np.uint64((1 << bits) + 1)))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
        yield int(keys[a] >> np.uint64(32)), a, b


class Summary:
    """Misra-Gries counters over sorted 32-bit keys; ``taken`` is what any counter may have lost."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add other counters (of a summary with this capacity, or exact ones); keys may repeat."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint32(1)) != 0) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        if len(self.keys) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            left = self.counts > off
            self.keys, self.counts, self.taken = self.keys[left], self.counts[left] - off, self.taken + off

    def survivors(self, least: int) -> np.ndarray:
        return self.keys[self.counts + self.taken >= least]


def summarised(cells: list[tuple[bytes, bytes]], mass: int, least: int) -> Summary:
    """The summary of a hash partition's cells, merged when their entries exceed its capacity."""
    out = Summary(ROOM * mass // least + 1)
    keys, counts, n = [], [], 0
    for body, count in cells:
        keys.append(np.cumsum(unpacked(body, np.uint32), dtype=np.uint32))
        counts.append(unpacked(count, np.uint32).astype(np.int64))
        n += len(keys[-1])
        if n > out.capacity:
            out.merge(np.concatenate(keys), np.concatenate(counts))
            keys, counts, n = [], [], 0
    if keys:
        out.merge(np.concatenate(keys), np.concatenate(counts))
    return out


BITS = "block long, bucket int, bits binary"


def _replies(least: int):
    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        cells = [(a.as_py(), b.as_py()) for a, b in zip(rows.column("body"), rows.column("counts"), strict=True)]
        alive = summarised(cells, sum(rows.column("mass").to_pylist()), least).survivors(least)
        blocks, bits = [], []
        for block, (body, _) in zip(rows.column("block").to_pylist(), cells, strict=True):
            keys = np.cumsum(unpacked(body, np.uint32), dtype=np.uint32)
            if len(alive) and (stays := alive[np.minimum(np.searchsorted(alive, keys), len(alive) - 1)] == keys).any():
                blocks.append(block)
                bits.append(zstandard.ZstdCompressor(1).compress(np.packbits(stays).tobytes()))
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


#: A block's counts for one hash partition: lines of phrases (an empty one for the number of words), and their counts.
PART = "part int, lang string, phrases binary, counts binary"
COUNT = "lang string, phrase string, k int, n long"
#: Rows of one batch of counts.
OUT_ROWS = 50_000


def _counts(bits: int, most: int):
    """Rows of a block (its bits by hash partition first, then its text) -> its counts of the surviving n-grams, by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replies: dict[int, bytes] = {}
        for b in batches:
            for i, lang in enumerate(b.column("lang").to_pylist()):
                if lang is None:
                    replies[b.column("bucket")[i].as_py()] = b.column("bits")[i].as_py()
                else:
                    yield from counted(lang, b.column("body")[i].as_py(), replies)
                    replies = {}

    def counted(lang: str, body: bytes, replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        words = Words()
        codes = words.of(zstandard.ZstdDecompressor().decompress(body))
        out: dict[int, tuple[list[bytes], list[np.ndarray]]] = {0: ([b""], [np.array([(codes != words.end).sum()])])}
        keys = np.unique(_block_keys(words, codes, lang, bits, most))
        alive = []
        for bucket, a, b in _borders(keys, bits):
            if bucket in replies:
                stays = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(replies[bucket]), np.uint8), count=b - a)
                alive.append(keys[a:b][stays.astype(bool)])
        alive = np.concatenate([np.empty(0, np.uint64), *alive])
        said = words.codes.words
        for n, starts, hashes in words.grams(codes, lang, most):
            if not len(alive):
                break
            keys = _keys(hashes, bits)
            stays = alive[np.minimum(np.searchsorted(alive, keys), len(alive) - 1)] == keys
            starts, part = starts[stays], (keys[stays] >> np.uint64(32)).astype(np.int64)
            ids = codes[starts]
            for i in range(1, n):  # name the n-grams by their words: prefix's number, next word
                ids = np.unique(ids, return_inverse=True)[1] * len(said) + codes[starts + i]
            _, at, found = np.unique(ids, return_index=True, return_counts=True)
            order = np.argsort(part[at], kind="stable")
            mine, cut = part[at][order], np.flatnonzero(np.diff(part[at][order], prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)] if len(cut) else [], strict=True):
                columns = [codes[starts[at[order[a:b]]] + i].tolist() for i in range(n)]
                phrases, counts = out.setdefault(int(mine[a]), ([], []))
                phrases += [b" ".join([said[c] for c in x]) for x in zip(*columns, strict=True)]
                counts.append(found[order[a:b]])
        rows = [(p, lang, _lines(phrases), packed(np.concatenate(counts).astype(np.int64))) for p, (phrases, counts) in out.items()]
        for i in range(0, len(rows), 256):
            yield _batch(rows[i : i + 256], PART)

    return run


def _lines(phrases: list[bytes]) -> bytes:
    """No phrase has a line end in it."""
    return zstandard.ZstdCompressor(1).compress(b"\n".join(phrases))


def _added(least: int):
    """Counts of one part after the other, sorted by part -> the phrases that reach ``least``, and the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in sums.items():
                kept = [(lang, p.decode("utf-8", "surrogatepass"), p.count(b" ") + 1 if p else 0, n) for p, n in counts.items() if n >= least or not p]
                for i in range(0, len(kept), OUT_ROWS):
                    yield _batch(kept[i : i + OUT_ROWS], COUNT)

        for b in batches:
            for part, lang, phrases, counts in zip(*(b.column(c) for c in ("part", "lang", "phrases", "counts")), strict=True):
                if part.as_py() != now:
                    yield from rows()
                    now, sums = part.as_py(), {}
                have = sums.setdefault(lang.as_py(), {})
                get = have.get
                for p, n in zip(zstandard.ZstdDecompressor().decompress(phrases.as_py()).split(b"\n"), unpacked(counts.as_py(), np.int64).tolist(), strict=True):
                    have[p] = get(p, 0) + n
        yield from rows()

    return run


def frequent(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, block_bytes: int = BLOCK_BYTES, mass: int = PARTITION_MASS) -> DataFrame:
    """lang, phrase, k, n: the exact counts of all phrases of 1 to ``max_words`` words with ``least`` or more
    occurrences in their language, and (k = 0, phrase empty) all words of each language."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # a word and what parts it take two bytes at least
    estimate = (rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // 2
    bits = min(max(-(-estimate // mass) - 1, 0).bit_length(), 28)
    blocks = written(map_arrow(rows, _blocks(block_bytes), BLOCK), "collocation-blocks")
    cells = map_arrow(blocks, _cells(bits, max_words), CELL)
    replies = cells.groupBy("bucket").applyInArrow(_replies(least), BITS)
    none = F.lit(None)
    replies = replies.select("block", none.cast("string").alias("lang"), none.cast("binary").alias("body"), "bucket", "bits")
    texts = blocks.select("block", "lang", "body", none.cast("int").alias("bucket"), none.cast("binary").alias("bits"))
    # a block's bits come first (they have no language), then its text
    meets = replies.unionByName(texts).repartition("block").sortWithinPartitions("block", F.col("lang").asc_nulls_first())
    counts = map_arrow(meets, _counts(bits, max_words), PART)
    return map_arrow(counts.repartition("part").sortWithinPartitions("part"), _added(least), COUNT)


def _looked_up(cuts: DataFrame, grams: DataFrame, part: str, name: str, hot: int) -> DataFrame:
    """``cuts`` with the count of ``part`` as ``name``; see the module's text on frequent parts."""
    often = grams.where(F.col("n") >= hot).select("lang", F.col("phrase").alias(part), F.col("n").alias("often"))
    others = grams.where(F.col("n") < hot).select("lang", F.col("phrase").alias("key"), F.col("n").alias("seldom"))
    df = cuts.join(F.broadcast(often), ["lang", part], "left")
    # what is found already gets a key that no phrase has, spread over the tasks
    df = df.withColumn("key", F.when(F.col("often").isNull(), F.col(part)).otherwise(F.concat(F.lit(" "), F.col("phrase"))))
    df = df.join(others, ["lang", "key"], "left").withColumn(name, F.coalesce("often", "seldom"))
    return df.drop("often", "seldom", "key")


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, share: int = SHARE, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    counts = written(frequent(docs, least, max_words, **sizes), "collocation-counts")
    totals = counts.where("k = 0").select("lang", F.col("n"))
    words = totals.agg(F.sum("n")).first()[0] or 0
    grams = counts.where("k > 0").select("lang", "phrase", "n")
    found = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "k", "a", "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("first"),
        F.array_join(F.expr("slice(w, cut + 1, k)"), " ").alias("rest"),
    )
    hot = max(words // HOT, 1)
    cuts = _looked_up(_looked_up(cuts, grams, "first", "l", hot), grams, "rest", "r", hot)
    big = "CAST({} AS DECIMAL(19, 0))".format
    score = F.expr(f"({SCALE}BD * ({big('a')} * {big('a')})) div ({big('l')} * {big('r')})")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "cut", "l", "r").alias("best"), F.lit(0).cast("long").alias("within"))
    inner = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    longer = found.where("k > 2").select("lang", F.explode(F.expr(inner)).alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(None).cast(scored.schema["best"].dataType).alias("best"), F.col("a").alias("within"))
    judged = scored.unionByName(longer).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("best").alias("best"), F.max("within").alias("within"))
    kept = judged.where(100 * F.col("within") < share * F.col("a")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER.decode()}', '{_UPPER.lower().decode()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS MATERIALIZED (
  SELECT lang, phrase, k, count(*) AS f FROM (
    SELECT lang, 1 AS k, w[i] AS phrase FROM starts
    UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM starts WHERE i + 1 <= len(w)
    UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM starts WHERE i + 2 <= len(w)
  ) GROUP BY ALL HAVING count(*) >= {LEAST}
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang
), found AS MATERIALIZED (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM found
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM found WHERE k = 3
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = c.head JOIN grams r ON r.lang = c.lang AND r.phrase = c.rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM found WHERE k = 3
  ) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r,
  CAST(t.n AS BIGINT) AS n, CAST(b.score AS BIGINT) AS score
FROM best b JOIN totals t USING (lang) LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE coalesce(100 * x.a < {SHARE} * b.a, true)
QUALIFY rank <= {TOP}
"""
