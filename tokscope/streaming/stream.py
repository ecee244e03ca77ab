"""Structured Streaming: incremental global token metrics (X2), distinct ids (A3) and streamed ingest.

New text files are read with ``readStream`` (``maxFilesPerTrigger`` bounds each micro-batch).

* X2 is a streaming aggregation: characters are counted by class, known pieces are looked up in a bounded static table
  of what they add beyond their characters (other tokenizers: tokens are encoded and annotated one by one), and ``groupBy(tokenizer)`` keeps the counters in the state store.  In complete mode each
  micro-batch hands over the totals so far, which replace the earlier ones.  A restart goes on from the checkpoint.
* A3 keeps a distinct-count sketch of the ids of every (tokenizer, language) per micro-batch; sketches merge, so
  any grouping of the files gives the same estimate.  Its relative standard error is SKETCH_ERROR.
* X1 carries the bytes kept before a micro-batch into its running sums, and reads off the micro-batch's own write
  (``observe``) when every language has reached the budget.

What a micro-batch writes goes to ``<state>/batch_id=<n>`` with overwrite, so a replayed batch replaces itself.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import unicode_classes as uc
from ..operators.encode import encode_pieces, pieces, token_counts, token_stream
from ..operators.prefix import exclusive_prefix_sums
from ..operators.tokens import annotated_vocab
from ..operators.tokenizers import NativeTokenizer, Vocab
from ..session import materialize
from ..sources.text import dealt, documents_from, non_empty

#: log2 of the registers of a distinct-count sketch, and the relative standard error that gives (1.04 / sqrt(registers)).
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)

COUNT_COLUMNS = ("total", "space", "inner", "overlap", *[f"script_{label}" for label in uc.SCRIPT_LABELS])


def contributions(tokens: DataFrame, vocab: Vocab, keys: Sequence[str] = ()) -> DataFrame:
    """``(tokenizer, keys..., COUNT_COLUMNS...)``: what each annotated token (or ``(tokenizer, token_id, n)`` count) adds to the counters."""
    ann = F.broadcast(annotated_vocab(vocab).where(F.col("token_text").isNotNull()))
    a = tokens.join(ann, ["tokenizer", "token_id"])
    one = F.col("n").cast("long") if "n" in tokens.columns else F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    return a.select(
        "tokenizer",
        *keys,
        one.alias("total"),
        F.when(F.col("starts_with_space"), one).otherwise(zero).alias("space"),
        F.when(F.col("has_whitespace_in_middle"), one).otherwise(zero).alias("inner"),
        F.when(F.col("script_overlap"), one).otherwise(zero).alias("overlap"),
        *[F.when(F.array_contains("scripts", label), one).otherwise(zero).alias(f"script_{label}") for label in uc.SCRIPT_LABELS],
    )


def _atoms(vocab: Vocab) -> list[tuple[set[int], list[tuple[str, str]]]]:
    """Disjoint sets of decodable code points and the (tokenizer, counter) pairs that each of their characters adds to,
    those with ASCII first."""
    sets = vocab.char_sets()
    adds: dict[int, list[tuple[str, str]]] = {}
    for t in vocab.tokenizers:
        for p in set(range(128)) | set(sets.get(t.name, ())):
            marks = ["total", *(["space"] if chr(p).isspace() else []), *(f"script_{label}" for label in uc.py_scripts(chr(p)))]
            adds.setdefault(p, []).extend((t.name, m) for m in marks)
    atoms: dict[tuple, set[int]] = {}
    for p, marks in adds.items():
        atoms.setdefault(tuple(marks), set()).add(p)
    return [(points, list(marks)) for marks, points in sorted(atoms.items(), key=lambda x: (min(x[1]) >= 128, -len(x[1]), min(x[1])))]


def character_contributions(docs: DataFrame, vocab: Vocab, keys: Sequence[str] = ()) -> DataFrame:
    """The same where all tokens are characters, one row per text and tokenizer: they are counted by class, not exploded.

    A token that decodes is a known character, or an ASCII character by its byte; it has one character, so no white space
    within and one script at most.  The classes are disjoint, and each is counted by taking its runs out of what the
    earlier ones have left, so a text is passed about once however many classes there are.
    """
    atoms = _atoms(vocab)
    df = docs.select(*keys, F.col("text").alias("_left"))
    lengths = list(keys)
    for i, (points, _) in enumerate(atoms):  # step by step: what is left is read twice
        runs = uc.java_class(uc._ranges(sorted(points))) + "+"
        df = df.select(*lengths, F.char_length("_left").alias(f"_n{i}"), F.regexp_replace("_left", F.lit(runs), F.lit("")).alias("_left"))
        lengths.append(f"_n{i}")
    df = df.select(*lengths, F.char_length("_left").alias(f"_n{len(atoms)}"))

    def count(tokenizer: str, counter: str):
        mine = [F.col(f"_n{i}") - F.col(f"_n{i + 1}") for i, (_, marks) in enumerate(atoms) if (tokenizer, counter) in marks]
        return sum(mine[1:], mine[0]).cast("long") if mine else F.lit(0).cast("long")

    rows = [F.struct(F.lit(t.name).alias("tokenizer"), *[count(t.name, c).alias(c) for c in COUNT_COLUMNS]) for t in vocab.tokenizers]
    return df.select(*keys, F.inline(F.array(*rows))).select("tokenizer", *keys, *COUNT_COLUMNS)


def falls_back(t: NativeTokenizer, vocab: Vocab) -> bool:
    """Whether the pieces are all of the text and an unknown one is its characters, whose ids decode to them."""
    return t.char_level or (t.covers and t.unk_id is None and vocab.decode_table is None and vocab.words_bounded)


def known_pieces(vocab: Vocab) -> DataFrame:
    """``(tokenizer, piece, COUNT_COLUMNS...)``: what a known piece adds beyond what its characters would (bounded by the
    slots), so that a text's counters are those of its characters and of its known pieces."""
    names = [t.name for t in vocab.tokenizers]
    words = vocab.words.where(F.col("tokenizer").isin(*names))
    ids = contributions(words.select("tokenizer", "piece", F.explode("ids").alias("token_id")), vocab, ["piece"])
    spelt = words.select(F.col("tokenizer").alias("_of"), "piece").distinct().withColumn("text", F.col("piece"))
    spelt = character_contributions(spelt, vocab, ["_of", "piece"]).where(F.col("tokenizer") == F.col("_of"))
    less = spelt.select("tokenizer", "piece", *[(-F.col(c)).alias(c) for c in COUNT_COLUMNS])
    return ids.unionByName(less).groupBy("tokenizer", "piece").agg(*[F.sum(c).alias(c) for c in COUNT_COLUMNS])


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tokenizer").agg(*[F.sum(c).alias(c) for c in COUNT_COLUMNS])


def counters(tokens: DataFrame, vocab: Vocab) -> DataFrame:
    """``(tokenizer, total, space, inner, overlap, script_<label>...)`` over annotated tokens.

    ``tokens`` holds one row per token, or ``(tokenizer, token_id, n)`` counts.
    """
    return summed(contributions(tokens, vocab))


def counters_to_long(c: DataFrame) -> DataFrame:
    """Counters -> ``(tokenizer, metric, value)``, script keys only when their count is > 0."""
    pct = lambda x: F.col(x).cast("double") / F.col("total").cast("double") * F.lit(100.0)
    items = [
        F.struct(F.lit("total_tokens_analyzed").alias("metric"), F.col("total").cast("double").alias("value"), F.lit(1).alias("n")),
        F.struct(F.lit("tokens_starting_with_space_pct").alias("metric"), pct("space").alias("value"), F.lit(1).alias("n")),
        F.struct(F.lit("tokens_with_whitespace_in_middle_pct").alias("metric"), pct("inner").alias("value"), F.lit(1).alias("n")),
        F.struct(F.lit("tokens_with_script_overlap_pct").alias("metric"), pct("overlap").alias("value"), F.lit(1).alias("n")),
        *[
            F.struct(
                F.lit(f"tokens_with_{label.lower()}_unicode_pct").alias("metric"),
                pct(f"script_{label}").alias("value"),
                F.col(f"script_{label}").alias("n"),
            )
            for label in uc.SCRIPT_LABELS
        ],
    ]
    out = c.where(F.col("total") > 0).select("tokenizer", F.explode(F.array(*items)).alias("m"))
    return out.where(F.col("m.n") > 0).select("tokenizer", "m.metric", "m.value")


def document_tokens(docs: DataFrame, vocab: Vocab) -> DataFrame:
    """Tokens of every document encoded on its own (no separators, no special tokens)."""
    return token_stream(docs.select("doc_id", "text").where(non_empty(F.col("text"))), vocab, ["doc_id"])


def document_token_counts(docs: DataFrame, vocab: Vocab) -> DataFrame:
    """``(tokenizer, token_id, n)`` of every document encoded on its own, by the fold."""
    d = docs.select(F.lit(0).alias("_all"), "text").where(non_empty(F.col("text")))
    return token_counts(d, vocab, ["_all"]).drop("_all")


def file_stream(spark: SparkSession, folder: str, schema: str, glob: str, max_files_per_trigger: int) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("pathGlobFilter", glob)
        .parquet(folder)
    )


def start_global_metrics_stream(
    spark: SparkSession,
    folder: str,
    schema: str,
    vocab: Vocab,
    checkpoint: str,
    query_name: str,
    state: str,
    max_files_per_trigger: int = 1,
    glob: str = "*.parquet",
) -> StreamingQuery:
    """Stream the parquet files of ``folder`` matching ``glob`` into counters (``availableNow``: the query stops
    once the files present are read); read the totals with :func:`read_counters`.

    The counters are the query's state: one row per tokenizer, added up in the state store.
    """
    src = file_stream(spark, folder, schema, glob, max_files_per_trigger)
    docs = dealt(src.select("doc_id", "text"), "doc_id").where(non_empty(F.col("text")))
    # counters of the characters, corrected where pieces are known: only known pieces are looked up one by one
    spelt = replace(vocab, tokenizers=[t for t in vocab.tokenizers if falls_back(t, vocab)])
    cut = replace(spelt, tokenizers=[t for t in spelt.tokenizers if not t.char_level])
    others = replace(vocab, tokenizers=[t for t in vocab.tokenizers if not falls_back(t, vocab)])
    parts = [contributions(piece_tokens(docs, others), others)] if others.tokenizers else []
    if spelt.tokenizers:
        parts.append(character_contributions(docs, spelt))
    if cut.tokenizers:
        known = F.broadcast(materialize(known_pieces(cut)))  # bounded by the slots
        parts.append(pieces(docs, cut.tokenizers, []).join(known, ["tokenizer", "piece"]).select("tokenizer", *COUNT_COLUMNS))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    totals = summed(rows)

    def hand_over(so_far: DataFrame, batch_id: int) -> None:
        # one file; a shuffle, so that the state's partitions are still read by as many tasks
        so_far.repartition(1).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    return (
        totals.writeStream.outputMode("complete")
        .foreachBatch(hand_over)
        .queryName(query_name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def piece_tokens(docs: DataFrame, vocab: Vocab) -> DataFrame:
    """``(tokenizer, token_id)`` of every text encoded on its own, in no order: the rows of a stream."""
    p = pieces(docs, vocab.tokenizers, []).select("tokenizer", "piece")
    return encode_pieces(p, vocab, []).select("tokenizer", "token_id")


def read_counters(spark: SparkSession, state: str) -> DataFrame:
    """The running counters as of the last micro-batch that handed them over."""
    parts = spark.read.parquet(state)
    last = parts.select(F.max(F.struct("batch_id"))["batch_id"].alias("batch_id"))  # one row
    return parts.join(F.broadcast(last), "batch_id", "left_semi").drop("batch_id")


# --- A3 on streams: distinct ids by mergeable sketches ------------------------------------------


def id_sketches(docs: DataFrame, vocab: Vocab) -> DataFrame:
    """``(tokenizer, lang_key, sketch, n)``: the distinct ids of a table of texts as sketches, and how many tokens."""
    counts = token_counts(docs.select("lang_key", "text").where(non_empty(F.col("text"))), vocab, ["lang_key"])
    return counts.groupBy("tokenizer", "lang_key").agg(
        F.hll_sketch_agg("token_id", SKETCH_BITS).alias("sketch"), F.sum("n").alias("n")
    )


def start_unique_tokens_stream(
    spark: SparkSession,
    folder: str,
    schema: str,
    vocab: Vocab,
    checkpoint: str,
    state: str,
    max_files_per_trigger: int = 1,
    glob: str = "*.parquet",
) -> StreamingQuery:
    """A3 on a stream: one sketch per (tokenizer, language) and micro-batch under ``state``; read with :func:`read_unique_tokens`."""
    src = file_stream(spark, folder, schema, glob, max_files_per_trigger)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        docs = documents_from(dealt(batch.select("doc_id", "text", "lang", "source"), "doc_id"))
        id_sketches(docs, vocab).write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    return src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_unique_tokens(spark: SparkSession, state: str) -> DataFrame:
    """``(tokenizer, lang_key, n_batches, text_tokens, unique_tokens)``: the merged sketches' estimates."""
    parts = spark.read.parquet(state)
    return parts.groupBy("tokenizer", "lang_key").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n").alias("text_tokens"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_tokens"),
    )


# --- X1: streamed ingest under a byte budget, stopping early -----------------------------------


def start_budget_stream(
    spark: SparkSession,
    folder: str,
    schema: str,
    target_bytes: int,
    checkpoint: str,
    state: str,
    glob: str = "*.parquet",
    max_files_per_trigger: int = 1,
    with_text: bool = False,
    budget: Budget | None = None,
) -> StreamingQuery:
    """Keep documents of each language while the bytes kept before them stay below the budget.

    Each micro-batch continues the running total from the bytes already kept (read from
    ``state``); rows are written under ``<state>/batch_id=<n>`` (overwrite: replay-safe).  With
    files arriving in ``doc_id`` order this equals the batch budget (W1).  ``with_text`` writes the
    documents' texts too.  ``budget``: told when its languages have reached the budget (:func:`run_until_budget`).
    """
    src = file_stream(spark, folder, schema, glob, max_files_per_trigger)
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        docs = documents_from(batch.select("doc_id", "text", "lang", "source"))
        slim = docs.select("lang_key", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
        prev = kept_totals(spark, state, exclude_batch=batch_id)
        placed, _ = exclusive_prefix_sums(slim, ["lang_key"], "doc_id", {"in_batch": "n_bytes"}, below=target_bytes)
        rows = placed.join(F.broadcast(prev), "lang_key", "left").withColumn(  # one row per language
            "bytes_before", F.coalesce(F.col("kept_bytes"), F.lit(0)) + F.col("in_batch")
        )
        kept = rows.where(F.col("bytes_before") < F.lit(target_bytes)).select("lang_key", "doc_id", "n_bytes", "bytes_before")
        if with_text:
            kept = docs.select("lang_key", "doc_id", "text").join(kept, ["lang_key", "doc_id"])
        seen = Observation() if budget is not None else None
        if seen is not None:  # measured by the write itself, once a row
            kept = kept.observe(seen, *budget.measures())
        kept.write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        if seen is not None:
            budget.add(batch_id, seen.get)

    if budget is not None:
        budget.resume(spark, state)
    return src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Budget:
    """Early stop of X1: adds up the bytes by language that each micro-batch keeps, as its write observes them, and says
    when every one of ``languages`` has reached ``target_bytes``.

    A micro-batch that is replayed after a restart replaces its own figures.  What earlier runs kept is read once, when the
    query starts.
    """

    def __init__(self, languages, target_bytes: int):
        self.languages, self.target = list(languages), target_bytes
        self.seen: dict[int, list[int]] = {}
        self.reached = threading.Event()

    def measures(self) -> list:
        return [F.sum(F.when(F.col("lang_key") == k, F.col("n_bytes"))).alias(f"b{i}") for i, k in enumerate(self.languages)]

    def resume(self, spark: SparkSession, state: str) -> None:
        if folder_exists(spark, state):
            rows = spark.read.schema(KEPT).option("recursiveFileLookup", "true").parquet(state)
            batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch_id=(\d+)/", 1).cast("long").alias("batch")
            for r in rows.groupBy(batch, "lang_key").agg(F.sum("n_bytes").alias("n")).collect():  # one row a batch and language
                if r["lang_key"] in self.languages:
                    self.seen.setdefault(r["batch"], [0] * len(self.languages))[self.languages.index(r["lang_key"])] = r["n"]
        self._judge()

    def add(self, batch_id: int, measured: dict) -> None:
        self.seen[batch_id] = [measured.get(f"b{i}") or 0 for i in range(len(self.languages))]
        self._judge()

    def _judge(self) -> None:
        if all(sum(b[i] for b in self.seen.values()) >= self.target for i in range(len(self.languages))):
            self.reached.set()


def kept_totals(spark: SparkSession, state: str, exclude_batch: int | None = None) -> DataFrame:
    """``(lang_key, kept_bytes)`` over the kept rows written so far (one row per language)."""
    kept = spark.read.schema(KEPT).option("recursiveFileLookup", "true").parquet(state) if folder_exists(spark, state) else None
    if kept is None:
        return spark.createDataFrame([], "lang_key string, kept_bytes long")
    if exclude_batch is not None:
        of_batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch_id=(\d+)/", 1)
        kept = kept.where(of_batch != F.lit(str(exclude_batch)))
    return kept.groupBy("lang_key").agg(F.sum("n_bytes").cast("long").alias("kept_bytes"))


KEPT = "lang_key string, n_bytes long"


def table_folder(spark: SparkSession, path: str) -> tuple[str, str]:
    """(folder, glob) that a stream of the table at ``path`` reads, be it one file or a folder of files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return path, "*.parquet"
    return hadoop.getParent().toString(), hadoop.getName()


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder exists, asked of the file system that the path names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def run_until_budget(query: StreamingQuery, budget: Budget, poll: float = 0.2) -> None:
    """Early stop: stop the stream once ``budget``'s languages have reached it; returns when the query has ended."""
    while query.isActive and not budget.reached.wait(poll):
        pass
    if query.isActive:
        query.stop()
    query.awaitTermination()
