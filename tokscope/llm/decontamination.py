"""Benchmark decontamination: BM25 inverted index of the test items, searched by block-max WAND (operator 2).

Index.  Each test item is cut into segments of up to SEGMENT tokens (lower-cased runs of letters, digits and
non-ASCII characters).  Spark counts terms and document frequencies and gives each posting its BM25 weight as a
share of the segment's own score, so a passage that holds a whole segment scores 1 on it.  Postings lie in
shards of whole items, with about SHARD_POSTINGS postings each; a shard is what a task holds, and a larger test
set means more passes over the documents, not a larger broadcast.

Search.  Every document is cut into passages of 2 * SEGMENT tokens that start every SEGMENT tokens, so any run
as long as a segment lies within one passage.  Each passage is a query, and all segments that score at least
MIN_SCORE are retrieved:

- pivot: a passage's terms are ordered by their highest weight; the low ones that cannot reach the threshold
  together name no candidates, and a passage whose highest weights sum to less is done;
- block maxima: segments lie in blocks of BLOCK; a block that an other term names is skipped if the highest
  weights of the passage's terms within it sum to less than the threshold;
- the postings of the remaining blocks are summed exactly.

Verification.  The item's question (all but the last line, or else all but the last sentence) and answer (the
rest) are compared with the document by word three-grams.  A document leaks an item if it has

- OVERLAP or more of the three-grams of the question, or of the whole item; or
- OVERLAP of the answer's and half as many of the question's; or
- EXCERPT or more of the three-grams of a retrieved segment (an excerpt of a long item);

and an item of fewer than SHORT tokens has to stand in it word for word.

Result: one row per document row and leaked item: doc_id, item_id, score (best passage), n_passages,
question_overlap, answer_overlap (null if the item is a single sentence), item_overlap.  Defined results: null or
empty texts leak nothing; items with a null or empty text, or with fewer tokens than an n-gram has (NGRAM), are no
evidence; equal items count once; repeated rows give repeated rows; an empty table of documents or items: no leaks; a very
long document is searched passage by passage; ties in score: all are retrieved; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, table, texts, written

SEGMENT = 48
SHORT = 8
MIN_SCORE = 0.4
OVERLAP = 0.5
EXCERPT = 0.8
NGRAM = 3
BLOCK = 32
K1, B = 1.2, 0.75
SHARD_POSTINGS = 500_000
CHUNK_CHARS = 300_000
#: Letters and digits stay, other ASCII characters become blanks; bytes of other characters stay.
_CLEAN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is the last line, or the last sentence of a single line; empty if there is just one sentence."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    cut = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)", text)]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


def ngrams(words: list[bytes], n: int = NGRAM) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def postings(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """item, segment, term, weight (share of the segment's own BM25 score); and the items themselves: item, item_id, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"item": [], "segment": [], "terms": []}
            for item, text in zip(*(b.column(c).to_pylist() for c in ("item", "text")), strict=True):
                words = tokens(text)
                if len(words) < NGRAM:
                    continue
                for k, i in enumerate(range(0, len(words), SEGMENT)):
                    # the last segment reaches back, so that none is short
                    i = max(0, min(i, len(words) - SEGMENT))
                    for name, value in zip(out, (item, k, words[i : i + SEGMENT]), strict=True):
                        out[name].append(value)
            yield batch(
                item=pa.array(out["item"], pa.int64()),
                segment=pa.array(out["segment"], pa.int32()),
                terms=pa.array(out["terms"], pa.list_(pa.binary())),
            )

    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    named = named.withColumn("item", F.xxhash64("item_id", "text"))
    named = written(named.select("item", "item_id", "text"), "items")
    segments = map_arrow(named.select("item", "text"), cut, "item long, segment int, terms array<binary>")
    segments = written(segments, "segments")
    stats = segments.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean")).first()
    n, mean = stats["n"] or 0, stats["mean"] or 1.0
    tf = segments.select("item", "segment", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("item", "segment", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    scored = tf.join(df, "term").withColumn("raw", raw)
    own = scored.groupBy("item", "segment").agg(F.sum("raw").alias("own"))
    return scored.join(own, ["item", "segment"]).select("item", "segment", "term", (F.col("raw") / F.col("own")).alias("weight")), named


@dataclass
class Shard:
    """One shard of the index, as arrays: postings by (term, segment), and block maxima by (term, block).

    Terms are numbered by their highest weight, the lowest first.
    """

    terms: dict[bytes, int]
    seg_item: np.ndarray  # segment -> item
    items: list[tuple]  # (item_id, text)
    term: np.ndarray
    seg: np.ndarray
    weight: np.ndarray
    n_blocks: int = field(init=False)
    block_key: np.ndarray = field(init=False)  # term * n_blocks + block, ascending
    block_max: np.ndarray = field(init=False)
    block_at: np.ndarray = field(init=False)  # first posting of the key
    term_max: np.ndarray = field(init=False)
    term_at: np.ndarray = field(init=False)  # first block key of the term

    def __post_init__(self) -> None:
        highest = np.zeros(len(self.terms))
        np.maximum.at(highest, self.term, self.weight)
        number = np.empty(len(highest), np.int64)
        number[np.argsort(highest, kind="stable")] = np.arange(len(highest))
        self.terms = {t: int(number[i]) for t, i in self.terms.items()}
        self.term = number[self.term]
        order = np.lexsort((self.seg, self.term))
        self.term, self.seg, self.weight = self.term[order], self.seg[order], self.weight[order]
        self.n_blocks = len(self.seg_item) // BLOCK + 1
        key = self.term * self.n_blocks + self.seg // BLOCK
        self.block_key, first = np.unique(key, return_index=True)
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.block_at = np.append(first, len(key))
        n = len(self.terms)
        self.term_at = np.searchsorted(self.block_key, np.arange(n + 1) * self.n_blocks)
        self.term_max = np.maximum.reduceat(self.block_max, self.term_at[:-1]) if n else np.empty(0)
        self.item_sets, self.short, self.segments = [], [], []
        for _, text in self.items:
            q, a = question_and_answer(text)
            words = tokens(text)
            self.item_sets.append((ngrams(tokens(q)), ngrams(tokens(a)), ngrams(words)))
            self.short.append(b" %s " % b" ".join(words) if len(words) < SHORT else None)
            # cut as in postings()
            self.segments += [ngrams(words[i : i + SEGMENT]) for i in (max(0, min(i, len(words) - SEGMENT)) for i in range(0, len(words), SEGMENT))]

    @staticmethod
    def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """start[0], start[0]+1, ... (size[0] of them), start[1], ..."""
        before = np.cumsum(size) - size
        return np.repeat(start - before, size) + np.arange(int(size.sum()))

    def search(self, passage: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, segment, score) of all that score ``least`` or more; passage and term: distinct ascending pairs."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        least = least - 1e-9
        high = self.term_max[term]  # ascending within a passage, as terms are numbered by it
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        size = np.diff(np.append(first, len(passage)))
        total = np.cumsum(high)
        within = total - np.repeat(total[first] - high[first], size)  # running sum within the passage
        names = within >= least  # from the pivot on, terms name candidates
        if not names.any():
            return none
        # blocks that the naming terms reach
        t, p = term[names], passage[names]
        reach = self.term_at[t + 1] - self.term_at[t]
        block = self.block_key[self.spans(self.term_at[t], reach)] % self.n_blocks
        pair = np.unique(np.repeat(p, reach) * self.n_blocks + block)
        p, block = pair // self.n_blocks, pair % self.n_blocks
        # each with all terms of its passage: the sum of the block maxima
        at = np.searchsorted(passage[first], p)
        each = self.spans(first[at], size[at])
        owner = np.repeat(np.arange(len(p)), size[at])
        key = term[each] * self.n_blocks + block[owner]
        where = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        hit = self.block_key[where] == key
        where, owner = where[hit], owner[hit]
        alive = np.bincount(owner, self.block_max[where], len(p)) >= least
        keep = alive[owner]
        where, owner = where[keep], owner[keep]
        if not len(where):
            return none
        # exact sums over the postings of these blocks
        count = self.block_at[where + 1] - self.block_at[where]
        post = self.spans(self.block_at[where], count)
        # a cell for each segment of each candidate block
        cell = np.repeat(owner, count) * BLOCK + self.seg[post] % BLOCK
        score = np.bincount(cell, self.weight[post], len(p) * BLOCK)
        ok = np.flatnonzero(score >= least)
        return p[ok // BLOCK], block[ok // BLOCK] * BLOCK + ok % BLOCK, score[ok]

    def leaks(self, found: list[str | None]) -> list[list[tuple]]:
        """For each text (item_id, score, n_passages, question, answer, item overlap) of each item that it leaks.

        Texts are searched a few at a time (CHUNK_CHARS, or one longer text), which bounds the arrays.
        """
        out: list[list[tuple]] = []
        part, size = [], 0
        for text in found:
            part.append(text)
            size += len(text or "")
            if size >= CHUNK_CHARS:
                out += self.leaks_of(part)
                part, size = [], 0
        return out + self.leaks_of(part)

    def leaks_of(self, found: list[str | None], least: float = MIN_SCORE, overlap: float = OVERLAP) -> list[list[tuple]]:
        get, words, keys, n_terms, base = self.terms.get, [], [], max(1, len(self.terms)), 0
        bases = []
        for text in found:
            w = tokens(text)
            words.append(w)
            ids = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
            at = np.flatnonzero(ids >= 0)
            bases.append(base)
            part = at // SEGMENT + 1  # a token lies in the passage of its stretch and in the one before
            keys.append((base + part) * n_terms + ids[at])
            keys.append((base + part - 1) * n_terms + ids[at])
            base += len(w) // SEGMENT + 2
        out: list[list[tuple]] = [[] for _ in found]
        pair = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        if not len(pair):
            return out
        passage, seg, score = self.search(pair // n_terms, pair % n_terms, least)
        if not len(passage):
            return out
        doc = np.searchsorted(bases, passage, side="right") - 1
        best: dict[tuple[int, int], tuple[float, set, set]] = {}
        for d, p, s_, item, s in zip(doc.tolist(), passage.tolist(), seg.tolist(), self.seg_item[seg].tolist(), score.tolist(), strict=True):
            high, seen, parts = best.get((d, item), (0.0, set(), set()))
            seen.add(p)
            parts.add(s_)
            best[d, item] = max(high, s), seen, parts
        sets: dict[int, set] = {}
        share = lambda a, b: len(a & b) / len(a) if a else None
        for (d, item), (s, seen, parts) in sorted(best.items()):
            if d not in sets:
                sets[d] = {tuple(words[d][i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(words[d]) - n + 1)}
            q, a, whole = (share(x, sets[d]) for x in self.item_sets[item])
            if self.short[item] is not None:
                leak = self.short[item] in b" %s " % b" ".join(words[d])
            else:
                leak = (
                    max(q or 0.0, whole or 0.0) >= overlap
                    or ((a or 0.0) >= overlap and (q or 0.0) >= overlap / 2)
                    or any(share(self.segments[x], sets[d]) >= EXCERPT for x in parts)
                )
            if leak:
                out[d].append((self.items[item][0], s, len(seen), q, a, whole))
        return out


def shards(items: DataFrame, shard_postings: int = SHARD_POSTINGS) -> Iterator[Shard]:
    """The index in shards; the driver holds one at a time."""
    index, named = postings(items)
    index = written(index, "postings")
    n = index.count()
    k = -(-n // shard_postings)
    for i in range(k):
        rows = index.where(F.pmod(F.col("item"), F.lit(k)) == i).orderBy("item", "segment", "term").toArrow()
        item, segment = rows.column("item").to_numpy(), rows.column("segment").to_numpy()
        if not len(item):
            continue
        new_item = np.diff(item, prepend=item[0] - 1) != 0
        new_seg = new_item | (np.diff(segment, prepend=-1) != 0)
        item_of, seg_of = np.cumsum(new_item) - 1, np.cumsum(new_seg) - 1
        have = named.where(F.pmod(F.col("item"), F.lit(k)) == i).toArrow()
        said = dict(zip(have.column("item").to_pylist(), zip(have.column("item_id").to_pylist(), have.column("text").to_pylist(), strict=True), strict=True))
        words = rows.column("term").to_pylist()
        terms = {t: j for j, t in enumerate(sorted(set(words)))}
        yield Shard(
            terms,
            item_of[new_seg],
            [said[x] for x in item[new_item].tolist()],
            np.array([terms[w] for w in words], dtype=np.int64),
            seg_of.astype(np.int64),
            rows.column("weight").to_numpy(),
        )


RESULT = "doc_id long, item_id long, score double, n_passages long, question_overlap double, answer_overlap double, item_overlap double"


def leaks(docs: DataFrame, items: DataFrame, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row per document row and leaked item."""

    def finder(shard: Shard):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = shard.leaks(b.column("text").to_pylist())
                rows = [(d, *x) for d, xs in zip(b.column("doc_id").to_pylist(), found, strict=True) for x in xs]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                names = [c.split()[0] for c in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        return run

    out = None
    for shard in shards(items, shard_postings):
        part = map_arrow(texts(docs), finder(shard), RESULT)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns: one pass per shard, no shuffle."""

    def keeper(shard: Shard):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = [not x for x in shard.leaks(b.column("text").to_pylist())]
                yield b.filter(pa.array(clean, pa.bool_()))

        return run

    for shard in shards(items, shard_postings):
        docs = map_arrow(docs, keeper(shard), docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
