"""Encoding as a Spark job.

One scan of the text produces the pieces of *every* tokenizer at once (an array of
``struct(tokenizer, pieces)`` built from literal patterns, then exploded), so adding a
tokenizer does not add a scan.  Pieces are looked up in the broadcast word table; unknown
pieces fall back to characters (broadcast char table) and then to UTF-8 bytes.  Every step
is a map-side projection or broadcast hash join: the token stream is never shuffled, and
``token_counts`` shuffles only its partial aggregates (at most vocab-size rows per group
and task).

Character-level tokenizers have no piece worth counting but characters; their ids are counted
from the distinct pieces of a *covering* pattern (one whose pieces are all of the text), so no
row per character of the corpus is ever made: only the characters of distinct pieces are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import unicode_classes as uc
from ..functions.scalars import utf8_bytes_of_char
from .tokenizers import CHAR_PATTERN, NativeTokenizer, Vocab


def pieces(df: DataFrame, tokenizers: Sequence[NativeTokenizer], keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``(keys..., tokenizer, pidx, piece)``: the pre-tokenized pieces of every tokenizer."""
    per_tok = F.array(
        *[
            F.struct(F.lit(t.name).alias("tokenizer"), F.regexp_extract_all(F.col(text_col), F.lit(t.piece_pattern), 0).alias("ps"))
            for t in tokenizers
        ]
    )
    exploded = df.select(*keys, F.inline(per_tok))
    return exploded.select(*keys, "tokenizer", F.posexplode("ps").alias("pidx", "piece"))


def _unk_map(tokenizers: Sequence[NativeTokenizer]) -> Column | None:
    pairs = [x for t in tokenizers if t.unk_id is not None for x in (F.lit(t.name), F.lit(t.unk_id))]
    return F.create_map(*pairs) if pairs else None


def encode_pieces(p: DataFrame, vocab: Vocab, keys: Sequence[str]) -> DataFrame:
    """``(keys..., tokenizer, [pidx,] cidx, bidx, token_id)`` from rows ``(keys..., tokenizer, [pidx,] piece)``.

    Known pieces take their ids from the broadcast word table (rows with a column ``ids`` are looked up
    already); unknown pieces fall back to characters (broadcast char table), unknown characters to their UTF-8 bytes.
    """
    toks = vocab.tokenizers
    pos = ["pidx"] if "pidx" in p.columns else []
    looked_up = "ids" in p.columns
    if not looked_up:
        p = p.join(vocab.words_for_join(), ["tokenizer", "piece"], "left")

    null_id = F.lit(None).cast("int")
    null_ch = F.lit(None).cast("string")
    items = F.when(
        F.col("ids").isNotNull(),
        F.transform("ids", lambda i: F.struct(i.alias("id"), null_ch.alias("ch"))),
    )
    unk = None if looked_up else _unk_map(toks)
    if unk is not None:
        unk_id = F.element_at(unk, F.col("tokenizer"))
        items = items.when(unk_id.isNotNull(), F.array(F.struct(unk_id.alias("id"), null_ch.alias("ch"))))
    items = items.otherwise(
        F.transform(F.regexp_extract_all("piece", F.lit(CHAR_PATTERN), 0), lambda c: F.struct(null_id.alias("id"), c.alias("ch")))
    )
    p = p.select(*keys, "tokenizer", *pos, F.posexplode(items).alias("cidx", "it"))
    p = p.select(*keys, "tokenizer", *pos, "cidx", F.col("it.id").alias("wid"), F.col("it.ch").alias("ch"))
    p = p.join(vocab.chars_for_join(), ["tokenizer", "ch"], "left")
    byte_ids = F.when(F.col("wid").isNull() & F.col("char_id").isNull(), utf8_bytes_of_char(F.col("ch")))
    p = p.select(*keys, "tokenizer", *pos, "cidx", "wid", "char_id", F.posexplode_outer(byte_ids).alias("bidx", "byte"))
    return p.select(
        *keys,
        "tokenizer",
        *pos,
        "cidx",
        F.coalesce(F.col("bidx"), F.lit(0)).alias("bidx"),
        F.coalesce(F.col("wid"), F.col("char_id"), F.col("byte")).alias("token_id"),
    )


def token_stream(
    df: DataFrame,
    vocab: Vocab,
    keys: Sequence[str],
    text_col: str = "text",
) -> DataFrame:
    """``(keys..., tokenizer, pidx, cidx, bidx, token_id)``: one row per token, in text order.

    The order of tokens inside one input row is ``(pidx, cidx, bidx)``.  Special tokens are
    not part of the stream; callers add them once per encoded text.
    """
    return encode_pieces(pieces(df, vocab.tokenizers, keys, text_col), vocab, keys)


def covering_pattern(tokenizers: Sequence[NativeTokenizer]) -> str:
    """A pattern whose pieces are all of any text: a tokenizer's own, else runs of white space and of other characters."""
    own = [t.piece_pattern for t in tokenizers if t.covers and not t.char_level]
    return own[0] if own else f"[^{uc.ws()}]+|[{uc.ws()}]+"


def java_covering_pattern(tokenizers: Sequence[NativeTokenizer]) -> str:
    """:func:`covering_pattern`, its own classes written for Java."""
    own = [t.piece_pattern for t in tokenizers if t.covers and not t.char_level]
    return own[0] if own else f"{uc.java_whitespace_unit_pattern()}|{uc.java_class(uc._tables()['WS'])}+"


def _folded_pieces(df: DataFrame, patterns: Sequence[str], g: list[str], text_col: str) -> DataFrame:
    """``(pat, group_cols..., piece, n)``: how often each piece of each pattern (by its number) occurs per group."""
    per_pat = F.array(
        *[F.struct(F.lit(i).alias("pat"), F.regexp_extract_all(F.col(text_col), F.lit(pat), 0).alias("ps")) for i, pat in enumerate(patterns)]
    )
    exploded = df.select(*g, F.inline(per_pat)).select(*g, "pat", F.explode("ps").alias("piece"))
    return exploded.groupBy("pat", *g, "piece").agg(F.count(F.lit(1)).alias("n"))


def _by_pattern(tokenizers: Sequence[NativeTokenizer], covering: bool) -> dict[str, list[NativeTokenizer]]:
    """The tokenizers of each pre-tokenizer pattern; ``covering``: character-level ones share the covering pattern."""
    cover = java_covering_pattern(tokenizers)
    out: dict[str, list[NativeTokenizer]] = {}
    for t in tokenizers:
        out.setdefault(cover if covering and t.char_level else t.piece_pattern, []).append(t)
    return out


def piece_counts(
    df: DataFrame, tokenizers: Sequence[NativeTokenizer], group_cols: Sequence[str], text_col: str = "text", covering: bool = False
) -> DataFrame:
    """``(tokenizer, group_cols..., piece, n)``: how often each piece occurs per group (the fold).

    Tokenizers sharing a pre-tokenizer pattern share one explode and one fold; the tokenizer
    names are attached to the folded (small) table only.  The aggregation is partial on the
    map side, so what crosses the shuffle is the set of distinct pieces per task.
    ``covering``: character-level tokenizers get the pieces of the covering pattern instead of
    characters (encoding these falls back to their characters, so ids and counts are the same).
    """
    g = list(group_cols)
    by_pattern = _by_pattern(tokenizers, covering)
    folded = _folded_pieces(df, list(by_pattern), g, text_col)
    names = F.create_map(*[x for i, ts in enumerate(by_pattern.values()) for x in (F.lit(i), F.array(*[F.lit(t.name) for t in ts]))])
    return folded.select(F.explode(F.element_at(names, F.col("pat"))).alias("tokenizer"), *g, "piece", "n")


def token_counts(df: DataFrame, vocab: Vocab, group_cols: Sequence[str], text_col: str = "text") -> DataFrame:
    """``(tokenizer, group_cols..., token_id, n)``: occurrences of every id per group (no specials).

    Fold, encode, fan out: pieces are counted first and looked up once each (pieces never share a
    token, so the ids of a text are the union of its pieces' ids).  What falls back to characters, be it
    an unknown piece or any piece for a character-level tokenizer, is folded once more: a character of a
    piece is one row for all tokenizers that want it, and each distinct one is encoded once.
    """
    g = list(group_cols)
    by_pattern = _by_pattern(vocab.tokenizers, covering=True)
    none = F.lit(None).cast("string")
    # each pattern's word-level tokenizers look its pieces up; the first of them also carries the character-level ones
    names: list[list[str]] = []  # sets of tokenizers that an item counts for, by number
    rows: list[Column] = []
    for i, ts in enumerate(by_pattern.values()):
        also, words = [t.name for t in ts if t.char_level], [t.name for t in ts if not t.char_level]
        rows.append(F.lit(i))
        rows.append(F.array(*[
            F.struct(
                (F.lit(w) if w else none).alias("tokenizer"), F.lit(len(names) + 3 * k).alias("_own"), F.lit(bool(also) and k == 0).alias("_also")
            )
            for k, w in enumerate(words or [""])
        ]))
        for k, w in enumerate(words or [""]):
            shared = also if k == 0 else []
            names += [[w] if w else [], shared + ([w] if w else []), shared]  # own ids; characters if unknown; if known
    p = _folded_pieces(df, list(by_pattern), g, text_col)
    p = p.select(*g, "piece", "n", F.inline(F.element_at(F.create_map(*rows), F.col("pat"))))
    p = p.join(vocab.words_for_join(), ["tokenizer", "piece"], "left")
    ids = F.col("ids")
    unk = _unk_map(vocab.tokenizers)
    if unk is not None:
        ids = F.coalesce(ids, F.when(F.element_at(unk, F.col("tokenizer")).isNotNull(), F.array(F.element_at(unk, F.col("tokenizer")))))
    p = p.select(*g, "n", "piece", "_own", "_also", F.col("tokenizer").isNotNull().alias("_looked"), ids.alias("ids"))
    unknown = F.col("ids").isNull()
    spelt = F.when(F.col("_also") | (F.col("_looked") & unknown), F.split("piece", ""))
    items = F.array(
        F.struct(F.col("_own").alias("_of"), F.lit(True).alias("_known"), F.col("ids").cast("array<string>").alias("xs")),
        F.struct(F.when(unknown, F.col("_own") + 1).otherwise(F.col("_own") + 2).alias("_of"), F.lit(False).alias("_known"), spelt.alias("xs")),
    )
    p = p.select(*g, "n", F.inline(items)).select(*g, "_of", "_known", "n", F.explode("xs").alias("x"))
    p = p.groupBy(*g, "_of", "_known", "x").agg(F.sum("n").alias("n"))
    p = p.select(*g, "_of", F.when(F.col("_known"), F.col("x").cast("int")).alias("_id"), F.when(~F.col("_known"), F.col("x")).alias("ch"), "n")
    sets = F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in names])
    p = p.select(F.explode(F.get(sets, F.col("_of"))).alias("tokenizer"), *g, F.col("ch").alias("piece"), "_id", "n")
    by_char = [t.name for t in vocab.tokenizers if t.char_level]
    p = p.groupBy("tokenizer", *g, "piece", "_id").agg(F.sum("n").alias("n"))  # a character known by one piece, not by another
    ids = F.when(F.col("_id").isNotNull(), F.array("_id"))
    if by_char:  # single characters may stand in the word table of an explicit vocabulary
        p = p.join(vocab.words_for_join().where(F.col("tokenizer").isin(*by_char)), ["tokenizer", "piece"], "left")
        ids = F.coalesce("ids", ids)
    p = p.select("tokenizer", *g, "n", "piece", ids.alias("ids"))
    return encode_pieces(p, vocab, [*g, "n"]).groupBy("tokenizer", *g, "token_id").agg(F.sum("n").alias("n"))


def tokens_per_row(df: DataFrame, vocab: Vocab, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``(tokenizer, keys..., n_tokens)`` for every input row and tokenizer (no specials).

    ``keys`` must identify a row.  Rows are never dropped: a row without tokens gets 0.
    """
    keys = list(keys)
    stream = token_stream(df, vocab, keys, text_col)
    counted = stream.groupBy("tokenizer", *keys).agg(F.count(F.lit(1)).alias("n_tokens"))
    names = F.array(*[F.lit(t.name) for t in vocab.tokenizers])
    every = df.select(*keys, F.explode(names).alias("tokenizer"))
    return every.join(counted, ["tokenizer", *keys], "left").select("tokenizer", *keys, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
