"""Tokenizers as data: a pre-tokenizer pattern plus bounded lookup tables.

A *native* tokenizer is fully described by DataFrames, so encoding is a Spark job:

* ``piece_pattern`` splits text into pieces (``regexp_extract_all``).
* A piece found in the **word table** becomes one id.
* Any other piece falls back to its characters; a character found in the **char table**
  becomes one id, any other character becomes its UTF-8 bytes (ids 0-255).
* ``bos`` adds one special id per encoded text when special tokens are requested.

Id layout (independent of how many table slots get filled, so ids never depend on counts):
``[0, 256)`` bytes, ``[256, 256+char_slots)`` characters by training rank,
``[256+char_slots, 256+char_slots+word_slots)`` pieces by training rank, then the BOS id.
Ids of unfilled slots decode to NULL, as do the lone bytes 0x80-0xFF.

Tables are learned from a training text by frequency (ties by the binary order of the
string) with a distributed top-K, so their size is bounded by the slot counts: that bound
is what makes broadcasting them safe at any corpus size.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import unicode_classes as uc

N_BYTES = 256
WORDS_SCHEMA = "tokenizer string, piece string, ids array<int>"
CHARS_SCHEMA = "tokenizer string, ch string, char_id int"
CHAR_PATTERN = "(?s)."
# Slots that a tokenizer's tables may have: they are broadcast, so this bounds what every task holds.
MAX_SLOTS = 1_000_000


@dataclass(frozen=True)
class NativeTokenizer:
    name: str
    piece_pattern: str
    char_slots: int = 0
    word_slots: int = 0
    bos: bool = False
    unk_id: int | None = None  # when set, an unknown piece becomes [unk_id] instead of falling back
    covers: bool = False  # the pieces of any text are all of it

    def __post_init__(self):
        if not self.name:
            raise ValueError("tokenizer name cannot be empty")
        if not (0 <= self.char_slots <= MAX_SLOTS and 0 <= self.word_slots <= MAX_SLOTS):
            raise ValueError(f"slot counts must lie between 0 and {MAX_SLOTS}")

    @property
    def char_base(self) -> int:
        return N_BYTES

    @property
    def word_base(self) -> int:
        return N_BYTES + self.char_slots

    @property
    def bos_id(self) -> int | None:
        return N_BYTES + self.char_slots + self.word_slots if self.bos else None

    @property
    def vocab_size(self) -> int:
        return N_BYTES + self.char_slots + self.word_slots + (1 if self.bos else 0)

    @property
    def n_special(self) -> int:
        return 1 if self.bos else 0

    @property
    def char_level(self) -> bool:
        """Pieces are single characters and none is in a word table: ids follow from the characters alone."""
        return self.piece_pattern == CHAR_PATTERN and self.word_slots == 0 and self.unk_id is None


def default_tokenizers() -> list[NativeTokenizer]:
    """The shipped set: byte level, character level with byte fallback, and word level."""
    return [
        NativeTokenizer("bytes", CHAR_PATTERN),
        NativeTokenizer("chars", CHAR_PATTERN, char_slots=512),
        NativeTokenizer("words", uc.words_piece_pattern(), char_slots=256, word_slots=4096, bos=True, covers=True),
    ]


def tokenizer_table(spark: SparkSession, tokenizers: list[NativeTokenizer]) -> DataFrame:
    """One row per tokenizer: name, vocab size, special-token count and ids."""
    rows = [(t.name, t.vocab_size, t.n_special, t.bos_id, t.piece_pattern) for t in tokenizers]
    return spark.createDataFrame(
        rows, "tokenizer string, vocab_size bigint, n_special int, bos_id int, piece_pattern string"
    )


def _top_k(items: DataFrame, col: str, k: int) -> DataFrame:
    """Distributed top-K by frequency, ties by the item's binary order; then ranks 1..K."""
    counted = items.groupBy(col).agg(F.count(F.lit(1)).alias("freq"))
    top = counted.orderBy(F.col("freq").desc(), F.col(col).asc()).limit(k)
    # ``top`` holds at most k rows, so an unpartitioned window over it is cheap.
    w = Window.orderBy(F.col("freq").desc(), F.col(col).asc())
    return top.withColumn("rank", F.row_number().over(w))


@dataclass
class Vocab:
    """Lookup tables of a set of tokenizers (all bounded by their slot counts)."""

    words: DataFrame  # tokenizer, piece, ids array<int>
    chars: DataFrame  # tokenizer, ch, char_id int
    tokenizers: list[NativeTokenizer]
    decode_table: DataFrame | None = None  # explicit (tokenizer, token_id, token_text), e.g. for mocks
    words_bounded: bool = True  # False: the word table grows with the corpus and is never broadcast
    _char_sets: dict[str, list[int]] | None = None

    def words_for_join(self) -> DataFrame:
        return F.broadcast(self.words) if self.words_bounded else self.words

    def chars_for_join(self) -> DataFrame:
        return F.broadcast(self.chars)

    def char_sets(self) -> dict[str, list[int]]:
        """Per tokenizer, the code points of its char table (at most its slots), collected once."""
        if self._char_sets is None:
            sets: dict[str, set[int]] = {}
            for r in self.chars.select("tokenizer", "ch").collect():
                sets.setdefault(r["tokenizer"], set()).add(ord(r["ch"]))
            self._char_sets = {name: sorted(points) for name, points in sets.items()}
        return self._char_sets

    def decoded(self, spark: SparkSession) -> DataFrame:
        """J3 target: ``(tokenizer, token_id, token_text)`` for every id below the vocab size.

        Undecodable ids (lone bytes >= 0x80, unfilled slots) carry NULL; the BOS id decodes
        to '' because special tokens are skipped when decoding.
        """
        if self.decode_table is not None:
            return self.decode_table
        parts = []
        for t in self.tokenizers:
            ids = spark.range(t.vocab_size).select(F.lit(t.name).alias("tokenizer"), F.col("id").cast("int").alias("token_id"))
            parts.append(ids)
        all_ids = parts[0]
        for p in parts[1:]:
            all_ids = all_ids.unionByName(p)
        words = self.words.where(F.size("ids") == 1).select(
            "tokenizer", F.col("ids")[0].alias("token_id"), F.col("piece").alias("w_text")
        )
        chars = self.chars.select("tokenizer", F.col("char_id").alias("token_id"), F.col("ch").alias("c_text"))
        bos = F.create_map(*[x for t in self.tokenizers if t.bos for x in (F.lit(t.name), F.lit(t.bos_id))]) if any(
            t.bos for t in self.tokenizers
        ) else None
        # one row per id on all sides: the planner picks the joins by size
        joined = all_ids.join(words, ["tokenizer", "token_id"], "left").join(chars, ["tokenizer", "token_id"], "left")
        byte_text = F.when(F.col("token_id") < 128, F.chr(F.col("token_id")))
        text = F.coalesce(F.col("w_text"), F.col("c_text"), byte_text)
        if bos is not None:
            text = F.when(F.element_at(bos, F.col("tokenizer")) == F.col("token_id"), F.lit("")).otherwise(text)
        return joined.select("tokenizer", "token_id", text.alias("token_text"))


def learn_vocab(training: DataFrame, tokenizers: list[NativeTokenizer], text_col: str = "text") -> Vocab:
    """Learn the word and char tables of every tokenizer from ``training[text_col]``."""
    spark = training.sparkSession
    word_parts, char_parts = [], []
    chars_of_training = None
    for t in tokenizers:
        if t.word_slots > 0:
            pieces = training.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(t.piece_pattern), 0)).alias("piece"))
            top = _top_k(pieces, "piece", t.word_slots)
            word_parts.append(
                top.select(
                    F.lit(t.name).alias("tokenizer"),
                    "piece",
                    F.array((F.col("rank") - 1 + F.lit(t.word_base)).cast("int")).alias("ids"),
                )
            )
        if t.char_slots > 0:
            if chars_of_training is None:
                chars_of_training = training.select(
                    F.explode(F.regexp_extract_all(F.col(text_col), F.lit(CHAR_PATTERN), 0)).alias("ch")
                )
            top = _top_k(chars_of_training, "ch", t.char_slots)
            char_parts.append(
                top.select(F.lit(t.name).alias("tokenizer"), "ch", (F.col("rank") - 1 + F.lit(t.char_base)).cast("int").alias("char_id"))
            )
    words = _union(word_parts) if word_parts else spark.createDataFrame([], WORDS_SCHEMA)
    chars = _union(char_parts) if char_parts else spark.createDataFrame([], CHARS_SCHEMA)
    # Both tables are bounded by the slot counts; keep them so every use shares one build.
    return Vocab(words=words.cache(), chars=chars.cache(), tokenizers=list(tokenizers))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_vocab(
    spark: SparkSession,
    rows: list[tuple[str, str, list[int]]],
    tokenizers: list[NativeTokenizer],
    decode_rows: list[tuple[str, int, str | None]] | None = None,
) -> Vocab:
    """A Vocab from explicit ``(tokenizer, piece, ids)`` rows, e.g. lookup-table mock tokenizers."""
    words = spark.createDataFrame(rows, WORDS_SCHEMA)
    decode = (
        spark.createDataFrame(decode_rows, "tokenizer string, token_id int, token_text string")
        if decode_rows is not None
        else None
    )
    return Vocab(words=words, chars=spark.createDataFrame([], CHARS_SCHEMA), tokenizers=list(tokenizers), decode_table=decode)


# --- D1, python form: a local tokenizer file applied to distinct pieces -----------------------


_PY_TOKENIZERS: dict[str, object] = {}  # per Python worker: tokenizer files loaded once


def _load_tokenizer(path: str):
    tok = _PY_TOKENIZERS.get(path)
    if tok is None:
        from tokenizers import Tokenizer

        tok = _PY_TOKENIZERS[path] = Tokenizer.from_file(path)
    return tok


def python_vocab(
    pieces_df: DataFrame,
    name: str,
    tokenizer_file: str,
    piece_pattern: str,
    bos_id: int | None = None,
) -> Vocab:
    """A Vocab whose word table is every distinct piece of ``pieces_df(piece)`` encoded by a local
    ``tokenizers`` file (no special tokens), with a pandas UDF; the file is loaded once per
    Python worker.  The word table grows with the corpus, so it is joined with a shuffle, not
    broadcast.  The decode table covers ids ``0..V-1`` (bounded by the vocabulary size).
    Exact for tokenizers whose tokens never cross piece borders.
    """
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(ps: pd.Series) -> pd.Series:
        encs = _load_tokenizer(tokenizer_file).encode_batch(list(ps), add_special_tokens=False)
        return pd.Series([e.ids for e in encs])

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        tok = _load_tokenizer(tokenizer_file)
        out = []
        for i in ids:
            try:
                out.append(tok.decode([int(i)], skip_special_tokens=True))
            except Exception:  # noqa: BLE001 - undecodable id -> NULL (P11)
                out.append(None)
        return pd.Series(out, dtype=object)

    spark = pieces_df.sparkSession
    distinct = pieces_df.select("piece").distinct()
    words = distinct.select(F.lit(name).alias("tokenizer"), "piece", encode(F.col("piece")).alias("ids"))
    size = _load_tokenizer(tokenizer_file).get_vocab_size(with_added_tokens=True)
    spec = PythonTokenizer(name, piece_pattern, tokenizer_file, bos_id, size)
    dec = spark.range(size).select(F.lit(name).alias("tokenizer"), F.col("id").cast("int").alias("token_id"))
    dec = dec.select("tokenizer", "token_id", decode(F.col("token_id")).alias("token_text"))
    empty_chars = spark.createDataFrame([], CHARS_SCHEMA)
    return Vocab(words=words, chars=empty_chars, tokenizers=[spec], decode_table=dec, words_bounded=False)


@dataclass(frozen=True)
class PythonTokenizer(NativeTokenizer):
    """D1 python form: pieces by ``piece_pattern``, ids from a local tokenizer file."""

    tokenizer_file: str = ""
    bos_token_id: int | None = None
    size: int = 0

    def __init__(self, name, piece_pattern, tokenizer_file, bos_token_id=None, size=0):
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "piece_pattern", piece_pattern)
        object.__setattr__(self, "char_slots", 0)
        object.__setattr__(self, "word_slots", 0)
        object.__setattr__(self, "bos", bos_token_id is not None)
        object.__setattr__(self, "unk_id", None)
        object.__setattr__(self, "covers", False)
        object.__setattr__(self, "tokenizer_file", tokenizer_file)
        object.__setattr__(self, "bos_token_id", bos_token_id)
        object.__setattr__(self, "size", size)

    @property
    def bos_id(self):
        return self.bos_token_id

    @property
    def vocab_size(self) -> int:
        return self.size
