"""D1, native, for tokens that cross piece borders: greedy longest match over a bounded trie.

A token may be any string of up to ``max_len`` characters, be they letters, digits, symbols or the blank before them; the
text is cut only where white space begins or ends (the covering pattern), so a token may reach over the borders that a
word pattern would draw.  The trie is a table of all prefixes of the tokens, one level per length.

1. Chunks are folded first, so the work below is done once for each distinct chunk.
2. Every position of a chunk becomes a row, and one broadcast join per level follows its trie path: the join key of a level
   is NULL as soon as the path has ended, and the last token met on the path is the longest one that starts there.
3. A walk over these lengths marks the positions where tokens start.  It goes in stretches of FOLD positions: a stretch's
   exits are computed for each of the ``max_len`` ways to enter it, so a very long chunk takes linear time too.
4. A position without a token is a character of its own, written as its UTF-8 bytes (ids 0-255).

Everything is a DataFrame expression; the result is a :class:`Vocab`, so all metrics work on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import utf8_bytes_of_char
from .encode import covering_pattern, java_covering_pattern
from .tokenizers import CHAR_PATTERN, CHARS_SCHEMA, MAX_SLOTS, N_BYTES, NativeTokenizer, Vocab

#: Positions of one fold.
FOLD = 256


def learn_tokens(training: DataFrame, slots: int, max_len: int, text_col: str = "text") -> DataFrame:
    """``(token, token_id)``: the ``slots`` strings of 2 to ``max_len`` characters that save most characters in the chunks of
    ``training`` (occurrences times length less one; ties by the binary order of the string)."""
    if not 0 < slots <= MAX_SLOTS:
        raise ValueError(f"slots must lie between 1 and {MAX_SLOTS}")
    chunks = training.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(covering_pattern([])), 0)).alias("chunk"))
    chunks = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    chars = F.regexp_extract_all("chunk", F.lit(CHAR_PATTERN), 0)
    c = chunks.select("n", chars.alias("c"))
    c = c.select("n", "c", F.explode(F.sequence(F.lit(2), F.lit(max_len))).alias("k")).where(F.col("k") <= F.size("c"))
    tokens = c.select("n", "k", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - F.col("k") + 1), lambda i: F.array_join(F.slice("c", i, F.col("k")), ""))).alias("token"))
    saved = (F.sum("n") * (F.first("k") - 1)).alias("saved")
    top = tokens.groupBy("token").agg(saved).orderBy(F.col("saved").desc(), "token").limit(slots)
    # at most ``slots`` rows
    rank = F.row_number().over(Window.orderBy(F.col("saved").desc(), "token"))
    return top.select("token", (rank - 1 + N_BYTES).cast("int").alias("token_id"))


def trie_levels(tokens: DataFrame) -> DataFrame:
    """``(prefix, level, token_id)``: all prefixes of the tokens; ``token_id`` where the prefix is a token itself."""
    n = F.char_length("token")
    each = tokens.select("token_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("level"), F.substring(F.col("token"), F.lit(1), k).alias("prefix")))).alias("p"))
    whole = F.when(F.col("p.level") == F.col("n"), F.col("token_id"))
    return each.groupBy("p.prefix", "p.level").agg(F.min(whole).alias("token_id"))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _starts(lens: Column, max_len: int) -> Column:
    """Which positions a left-to-right walk with these token lengths starts a token at."""
    onward = lambda at, n: F.when(at == 0, n - 1).otherwise(at - 1)  # noqa: E731 - positions still inside a token

    def flags(stretch: Column, enter: Column) -> Column:
        zero = F.struct(enter.alias("at"), F.array().cast("array<boolean>").alias("out"))
        step = lambda acc, n: F.struct(onward(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(acc["at"] == 0)).alias("out"))
        return F.aggregate(stretch, zero, step, lambda acc: acc["out"])

    exits = lambda stretch: F.transform(F.sequence(F.lit(0), F.lit(max_len - 1)), lambda e: F.aggregate(stretch, e, onward))

    def enters(stretches: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(F.get(x, acc["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(F.transform(stretches, exits), zero, step, lambda acc: acc["out"])

    def walked(stretches: Column) -> Column:
        first = F.array(F.lit(0))
        at = F.when(F.size(stretches) == 1, first).otherwise(enters(stretches))
        return F.flatten(F.zip_with(stretches, at, flags))

    return _let(F.transform(F.sequence(F.lit(1), F.size(lens), F.lit(FOLD)), lambda s: F.slice(lens, s, FOLD)), walked)


def longest_match(chunks: DataFrame, tokens: DataFrame, max_len: int) -> DataFrame:
    """``(piece, ids)`` of distinct non-empty chunks (column ``piece``)."""
    chars = F.regexp_extract_all("piece", F.lit(CHAR_PATTERN), 0)
    tails = _let(
        chars,
        lambda c: F.transform(c, lambda ch, i: F.struct(ch.alias("ch"), F.array_join(F.slice(c, i + 1, max_len), "").alias("tail"))),
    )
    rows = chunks.select("piece", F.posexplode(tails).alias("i", "x")).select("piece", "i", "x.ch", "x.tail")
    rows = rows.withColumns({"alive": F.lit(True), "n": F.lit(1), "id": F.lit(None).cast("int")})
    levels = trie_levels(tokens)
    for k in range(1, max_len + 1):
        level = levels.where(F.col("level") == k).select(F.col("prefix").alias("_prefix"), F.col("token_id").alias("_id"))
        key = F.when(F.col("alive") & (F.char_length("tail") >= k), F.substring("tail", 1, k))
        # at most one row per token and level: bounded by the slots
        rows = rows.withColumn("_key", key).join(F.broadcast(level), F.col("_key") == F.col("_prefix"), "left")
        hit = F.col("_id").isNotNull()
        rows = rows.select(
            "piece", "i", "ch", "tail", F.col("_prefix").isNotNull().alias("alive"), F.when(hit, F.lit(k)).otherwise(F.col("n")).alias("n"), F.when(hit, F.col("_id")).otherwise(F.col("id")).alias("id")
        )
    found = rows.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("i", "n", "id", "ch"))).alias("xs"))
    found = found.withColumn("on", _starts(F.transform("xs", lambda x: x["n"]), max_len))
    taken = F.filter(F.zip_with("xs", "on", lambda x, on: F.struct(x["id"].alias("id"), x["ch"].alias("ch"), on.alias("on"))), lambda x: x["on"])
    ids = F.flatten(F.transform(taken, lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(utf8_bytes_of_char(x["ch"]))))
    return found.select("piece", ids.alias("ids"))


def longest_vocab(docs: DataFrame, tokens: DataFrame, name: str, max_len: int, slots: int, bos: bool = False) -> Vocab:
    """A :class:`Vocab` of one longest-match tokenizer for the texts of ``docs``: its word table holds each distinct chunk.

    The table grows with the corpus, so it is joined with a shuffle; ids 0-255 are bytes, then the tokens, then the BOS id.
    """
    spark = docs.sparkSession
    pattern = java_covering_pattern([])
    spec = NativeTokenizer(name, pattern, word_slots=slots, bos=bos, covers=True)
    chunks = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("piece")).distinct()
    words = longest_match(chunks, tokens, max_len).select(F.lit(name).alias("tokenizer"), "piece", "ids")
    texts = tokens.select(F.lit(name).alias("tokenizer"), "token_id", F.col("token").alias("token_text"))
    single = spark.range(N_BYTES).select(F.lit(name).alias("tokenizer"), F.col("id").cast("int").alias("token_id"), F.when(F.col("id") < 128, F.chr("id")).alias("token_text"))
    decode = single.unionByName(texts)
    if bos:
        decode = decode.unionByName(spark.range(1).select(F.lit(name).alias("tokenizer"), F.lit(spec.bos_id).alias("token_id"), F.lit("").alias("token_text")))
    return Vocab(words=words, chars=spark.createDataFrame([], CHARS_SCHEMA), tokenizers=[spec], decode_table=decode, words_bounded=False)
