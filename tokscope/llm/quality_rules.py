"""Quality rules: tokeniser fertility with rejection bands (operator 5).

Base measures of the contract: words, their code points, symbols, repeated lines and words in repeated
eight-word windows; ``base_failed`` follows from them.

Method: a public vocabulary with byte fallback (PIECES) measures each text:

- ``chars_per_token``: code points of the words (with the mark that begins each) per token,
- ``fallback_share``: tokens that stand for a single byte of a character without a piece,
- ``entropy``: of the document's token distribution, as a share of the highest possible one for its length.

Each word is encoded on its own, as the vocabulary's pieces never cross a word's beginning; a task encodes each
distinct word once.

Bands are per language, over all documents: the median plus or minus SPREAD times the median absolute deviation
(at least FLOOR) of each measure; a text of n < STEADY words has a band wider by sqrt(STEADY / n), as a mean over
few words strays further.  Measures are rounded to thousandths and counted, so medians are exact and come
from a histogram of bounded size, never from a sorted column.  A language's middle and reach are blended with those of
all languages, which weigh as much as PRIOR of its documents.  ``kept``: no base failure, and at most TOLERATED measures outside their band (texts of fewer than
MIN_WORDS words are judged by the base rule alone).

Result: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then lang,
chars_per_token, fallback_share, entropy, rejected_by.  Defined results: null or empty text has no words, fails the
base rule and has null measures; a null language is a language of its own; repeated rows give repeated rows and count
each in the bands; an empty table gives no rows; ties at a median: the lower of the two middle values; a very long text is
measured whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordCodes, map_arrow, table, texts, window_hashes, words_of, written

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
SPREAD = {"chars_per_token": 8.0, "fallback_share": 8.0, "entropy": 5.0}
FLOOR = {"chars_per_token": 0.1, "fallback_share": 0.02, "entropy": 0.03}
PRIOR = 30
STEADY = 200
TOLERATED = 0


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def repeated_words(h: np.ndarray, words: list[bytes], n: int = WINDOW) -> int:
    """Words within windows of n words that the text has twice or more."""
    windows = window_hashes(h, n)
    if not len(windows):
        return 0
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    if not len(at):
        return 0
    seen: dict[tuple, list[int]] = {}  # the words themselves decide, not their hash
    for i in at.tolist():
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    start = np.array(sorted(i for found in seen.values() if len(found) > 1 for i in found), dtype=np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.split():
            n += line in seen
            seen.add(line)
    return n


class Fertility:
    """Tokens of words, kept for the distinct words met lately."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.fallback = np.fromiter((self.model.is_byte(i) for i in range(size)), bool, size)
        self.codes = WordCodes()
        self._empty()

    def _empty(self) -> None:
        self.flat, self.start = [np.empty(0, np.int64)], np.zeros(1, np.int64)
        self.chars, self.symbols = np.empty(0, np.int64), np.empty(0, np.int64)

    def trim(self) -> None:
        if self.codes.trim():
            self._empty()

    def learn(self) -> None:
        old = len(self.chars)
        new = self.codes.words[old:]
        if not new:
            return
        said = [w.decode("utf-8", "replace") for w in new]
        ids = self.model.encode(said, num_threads=1)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = [np.concatenate([*self.flat, np.fromiter((i for x in ids for i in x), np.int64, int(lens.sum()))])]
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lens)])
        self.chars = np.concatenate([self.chars, np.fromiter(map(len, said), np.int64, len(said))])
        drop = bytes(set(range(256)) - set(SYMBOLS))
        self.symbols = np.concatenate([self.symbols, np.fromiter((len(w.translate(None, drop)) for w in new), np.int64, len(new))])

    def measures(self, at: np.ndarray) -> tuple[float, float, float]:
        """Of the words with these codes: characters per token, share of byte tokens, relative entropy."""
        size = self.start[at + 1] - self.start[at]
        n = int(size.sum())
        before = np.cumsum(size) - size
        ids = self.flat[0][np.repeat(self.start[at] - before, size) + np.arange(n)]
        kinds = np.sort(ids)
        cuts = np.flatnonzero(np.diff(kinds, prepend=-1))
        p = np.diff(np.append(cuts, n)) / n
        high = np.log(min(n, len(self.fallback)))
        return float((self.chars[at].sum() + len(at)) / n), float(self.fallback[ids].mean()), float(-(p * np.log(p)).sum() / high) if n > 1 else 1.0


MEASURES = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "chars_per_token double, fallback_share double, entropy double"
)


def measures(docs: DataFrame, pieces: str | None = None) -> DataFrame:
    """The base measures and the fertility of each whole text; no shuffle."""
    path = pieces or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(path)
        names = [x.split()[0] for x in MEASURES.split(", ")]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, *[pa.float64()] * 3]
        for b in batches:
            fertility.trim()
            out = []
            found = b.column("text").to_pylist()
            split = [words_of(t) for t in found]
            coded = [fertility.codes.of(w) for w in split]
            fertility.learn()
            code64 = fertility.codes.hashes()
            for doc_id, lang, text, words, at in zip(b.column("doc_id").to_pylist(), b.column("lang").to_pylist(), found, split, coded, strict=True):
                if not words:
                    out.append((doc_id, lang, 0, 0, 0, 0, 0, None, None, None))
                    continue
                out.append(
                    (
                        doc_id, lang, len(words), int(fertility.chars[at].sum()), int(fertility.symbols[at].sum()),
                        repeated_lines(text.encode("utf-8", "surrogatepass")), repeated_words(code64[at], words), *fertility.measures(at),
                    )
                )
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return map_arrow(texts(docs, F.col("lang").cast("string").alias("lang")), run, MEASURES)


def _median(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Lower median of ``value`` weighted by n, per keys; counts hold one row per key and value."""
    run = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    return (
        counts.withColumn("upto", F.sum("n").over(run))
        .withColumn("all", F.sum("n").over(whole))
        .where(F.col("upto") * 2 >= F.col("all"))
        .groupBy(*keys)
        .agg(F.min(value).alias(name), F.max("all").alias("all"))
    )


def bands(measured: DataFrame) -> DataFrame:
    """lang, measure, mid, reach (thousandths); and rows with the mark ``every`` for all languages together.

    The histograms have at most a few thousand rows per language and measure.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * 1000).cast("long").alias("v")) for m in FLOOR]))
    counts = measured.where(F.col("n_words") >= MIN_WORDS).select("lang", each.alias("x")).select("lang", "x.*").groupBy("lang", "measure", "v").agg(F.count("*").alias("n"))
    counts = counts.withColumn("every", F.lit(False)).unionByName(
        counts.groupBy("measure", "v").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "measure", "v", "n", F.lit(True).alias("every"))
    )
    counts = written(counts, "histogram")
    keys = ["every", "lang", "measure"]
    middle = _median(counts, keys, "v", "mid")
    same = F.col("c.every").eqNullSafe(F.col("m.every")) & F.col("c.lang").eqNullSafe(F.col("m.lang")) & (F.col("c.measure") == F.col("m.measure"))
    off = counts.alias("c").join(middle.alias("m"), same).select("c.every", "c.lang", "c.measure", "mid", F.abs(F.col("v") - F.col("mid")).alias("off"), "n")
    off = off.groupBy(*keys, "mid", "off").agg(F.sum("n").alias("n"))
    mad = _median(off, [*keys, "mid"], "off", "mad")
    floor = F.coalesce(*[F.when(F.col("measure") == m, F.lit(x * 1000)) for m, x in FLOOR.items()])
    spread = F.coalesce(*[F.when(F.col("measure") == m, F.lit(x)) for m, x in SPREAD.items()])
    reach = F.greatest(F.col("mad") * spread, floor)
    return mad.select(*keys, "all", F.col("mid").cast("double").alias("mid"), reach.cast("double").alias("reach"))


def judge(docs: DataFrame, pieces: str | None = None) -> DataFrame:
    """One row per document: base measures, base_failed, kept, and the fertility measures."""
    measured = written(measures(docs, pieces), "fertility")
    by = bands(measured)
    wide = by.groupBy("every", "lang").agg(
        F.max("all").alias("all"),
        *[F.max(F.when(F.col("measure") == m, F.struct("mid", "reach"))).alias(m) for m in FLOOR],
    )
    # one row per language; written, so that both uses read it
    wide = written(wide, "bands")
    own = wide.where("not every").select(F.col("lang").alias("own_lang"), F.col("all").alias("own_n"), *[F.col(m).alias(f"own_{m}") for m in FLOOR])
    every = wide.where("every").first()
    joined = measured.join(own, measured["lang"].eqNullSafe(own["own_lang"]), "left")
    outside = []
    wider = F.sqrt(F.greatest(F.lit(1.0), STEADY / F.col("n_words")))
    for m in FLOOR:
        mid, reach = F.col(f"own_{m}.mid"), F.col(f"own_{m}.reach")
        if every is not None:
            blend = lambda mine, all_: (F.coalesce(mine * F.col("own_n"), F.lit(0.0)) + PRIOR * F.lit(all_)) / (F.coalesce("own_n", F.lit(0)) + PRIOR)
            mid, reach = blend(mid, every[m]["mid"]), blend(reach, every[m]["reach"])
        stray = F.abs(F.round(F.col(m) * 1000) - mid) > reach * wider
        outside.append(F.when((F.col("n_words") >= MIN_WORDS) & stray, F.lit(m)))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    named = F.filter(F.array(*outside), lambda x: x.isNotNull())
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.size(named) <= TOLERATED)).alias("kept"),
        "lang", "chars_per_token", "fallback_share", "entropy",
        F.array_join(named, ",").alias("rejected_by"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
