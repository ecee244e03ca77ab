"""Token annotation and token-level metrics (D3, D4, A11, A12, A13, W5 on ids, W6).

Annotating the *vocabulary* once (F8-F11 on every decoded id) makes every later token
annotation a join on ``(tokenizer, token_id)`` with a table bounded by the vocabulary size,
so Unicode predicates cost O(vocabulary), not O(tokens).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import unicode_classes as uc
from ..session import materialize
from .encode import encode_pieces, pieces
from .prefix import DEFAULT_BLOCK_SIZE, exclusive_prefix_sums
from .segment import DEFAULT_TOKEN_SAMPLE, even_sample_step, sampled_positions
from .tokenizers import Vocab

# ---------------------------------------------------------------------------
# Fixed values of the vocabulary analysis.
VOCAB_SAMPLE = 10000  # ids analysed per tokenizer (stride sample)
EXAMPLES = 10  # examples kept on each side (with / without leading space)
# ---------------------------------------------------------------------------

#: Pieces between two marks of the rank index, and characters for character-level tokenizers.
INDEX_PIECES, INDEX_CHARS = 128, 1024


def annotated_vocab(vocab: Vocab) -> DataFrame:
    """``(tokenizer, token_id, token_text, starts_with_space, has_whitespace_in_middle, scripts, script_overlap)``.

    NULL ``token_text`` = undecodable id (P11); flags of NULL texts are false.
    """
    spark = vocab.words.sparkSession
    d = vocab.decoded(spark)
    t = F.col("token_text")
    scripts = F.when(t.isNotNull(), S.unicode_scripts(t)).otherwise(F.array().cast("array<string>"))
    return d.select(
        "tokenizer",
        "token_id",
        "token_text",
        S.starts_with_whitespace(t).alias("starts_with_space"),
        S.has_inner_whitespace(t).alias("has_whitespace_in_middle"),
        scripts.alias("scripts"),
    ).withColumn("script_overlap", F.size("scripts") > 1)


# --- A11 / W6 ---------------------------------------------------------------


def vocab_analysis(vocab: Vocab) -> DataFrame:
    """Per tokenizer: share of stride-sampled, decodable ids whose text does not start with ' '.

    Stride = ``max(1, V // min(V, 10000))`` over ids ``0..V-1`` (not capped: every multiple of
    the stride is analysed).  Empty texts count on the "space" side.  Examples: the first ten
    of each side in id order.
    """
    spark = vocab.words.sparkSession
    sizes = spark.createDataFrame([(t.name, t.vocab_size) for t in vocab.tokenizers], "tokenizer string, vocab_size bigint")
    d = vocab.decoded(spark).join(F.broadcast(sizes), "tokenizer")
    step = F.greatest(F.lit(1), F.floor(F.col("vocab_size") / F.greatest(F.least(F.col("vocab_size"), F.lit(VOCAB_SAMPLE)), F.lit(1))))
    sampled = d.where((F.col("token_id") % step) == 0).where(F.col("token_text").isNotNull())
    t = F.col("token_text")
    no_space = (F.length(t) > 0) & ~t.startswith(" ")
    side = sampled.withColumn("no_space", no_space)
    w = Window.partitionBy("tokenizer", "no_space").orderBy("token_id")
    ex = (
        side.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= EXAMPLES)
        .groupBy("tokenizer")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("no_space"), F.struct("token_id", "token_text")))).alias("ns"),
            F.sort_array(F.collect_list(F.when(~F.col("no_space"), F.struct("token_id", "token_text")))).alias("sp"),
        )
    )
    agg = side.groupBy("tokenizer", "vocab_size").agg(
        F.count(F.lit(1)).alias("analyzed_sample_size"), F.sum(F.col("no_space").cast("int")).alias("n_no_space")
    )
    share = F.col("n_no_space") / F.col("analyzed_sample_size")
    has = F.col("analyzed_sample_size") > 0
    return agg.join(ex, "tokenizer", "left").select(
        "tokenizer",
        "vocab_size",
        F.when(has, (share * F.col("vocab_size")).cast("long")).otherwise(F.lit(0).cast("long")).alias(
            "tokens_without_leading_space_count"
        ),
        F.when(has, share * F.lit(100.0)).otherwise(F.lit(0.0)).alias("tokens_without_leading_space_pct"),
        F.col("analyzed_sample_size").cast("long").alias("analyzed_sample_size"),
        F.coalesce(F.transform("ns", lambda s: s["token_text"]), F.array().cast("array<string>")).alias("sample_non_space_tokens"),
        F.coalesce(F.transform("sp", lambda s: s["token_text"]), F.array().cast("array<string>")).alias("sample_space_tokens"),
    )


# --- per-document token counts without exploding tokens ------------------------


def _fallback_counts(vocab: Vocab) -> Callable[[Column, Column], Column]:
    """``(tokenizer, text) -> n``: ids of a text whose characters fall back: one for each known character (tables are
    bounded by slots), one for each UTF-8 byte of the others.  Known characters of several bytes are made one byte
    long, then bytes are counted; a text of one-byte characters only needs no pass."""
    long = {name: [cp for cp in points if cp >= 128] for name, points in vocab.char_sets().items()}

    def counted(tokenizer: Column, text: Column) -> Column:
        n_bytes = F.octet_length(text)
        out = n_bytes
        for name, points in long.items():
            if points:
                made = F.octet_length(F.regexp_replace(text, F.lit(uc.java_class(uc._ranges(points))), F.lit("a")))
                out = F.when((tokenizer == name) & (F.char_length(text) < n_bytes), made).otherwise(out)
        return out

    return counted


def piece_token_counts(p: DataFrame, vocab: Vocab) -> Column:
    """Number of ids of each piece row (after the left join with the word table), without exploding.

    A known piece contributes ``size(ids)``; an unknown one its known characters (one id
    each) plus the UTF-8 bytes of the others.
    """
    n_fallback = _fallback_counts(vocab)(F.col("tokenizer"), F.col("piece"))
    unk = [t.name for t in vocab.tokenizers if t.unk_id is not None]
    n_unknown = F.when(F.col("tokenizer").isin(*unk), F.lit(1)).otherwise(n_fallback) if unk else n_fallback
    return F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(n_unknown)


def tokens_per_doc(docs: DataFrame, vocab: Vocab, keys: Sequence[str]) -> DataFrame:
    """``(tokenizer, keys..., n_tokens)`` per row, from pieces without materialising tokens.

    Character-level tokenizers are counted with one expression over the whole text (known
    characters count one, the others their UTF-8 bytes); the others explode pieces and join
    the word table.  Equal to the token stream's row count.
    """
    keys = list(keys)
    counted = _fallback_counts(vocab)
    direct = [t for t in vocab.tokenizers if t.char_level]
    other = [t for t in vocab.tokenizers if not t.char_level]
    parts = []
    if direct:
        text = F.col("text")
        items = [F.struct(F.lit(t.name).alias("tokenizer"), counted(F.lit(t.name), text).cast("long").alias("n_tokens")) for t in direct]
        parts.append(docs.select(*keys, F.inline(F.array(*items))).select("tokenizer", *keys, "n_tokens"))
    if other:
        p = pieces(docs, other, keys)
        p = p.join(vocab.words_for_join(), ["tokenizer", "piece"], "left")
        parts.append(p.groupBy("tokenizer", *keys).agg(F.sum(piece_token_counts(p, vocab)).cast("long").alias("n_tokens")))
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


# --- D4 / W5 on ids: positional sample of each language's token sequence ---------


def token_index(docs: DataFrame, vocab: Vocab, keys: Sequence[str]) -> DataFrame:
    """Rank index over token positions: ``(tokenizer, keys..., blk, n_tokens)``, the tokens of every
    stretch of INDEX_PIECES pieces (INDEX_CHARS characters for a character-level tokenizer).

    One scan of the text: pieces are counted by (row, stretch) on the map side, so what is shuffled
    and written is one slim row a stretch.  Rows without tokens are left out.
    """
    keys = list(keys)
    by_pattern: dict[tuple[str, int], list[str]] = {}
    for t in vocab.tokenizers:
        stretch = (f"(?s).{{1,{INDEX_CHARS}}}", 1) if t.char_level else (t.piece_pattern, INDEX_PIECES)
        by_pattern.setdefault(stretch, []).append(t.name)
    items = F.array(
        *[
            F.struct(
                F.array(*[F.lit(n) for n in names]).alias("names"),
                F.lit(size).alias("size"),
                F.regexp_extract_all("text", F.lit(pattern), 0).alias("ps"),
            )
            for (pattern, size), names in by_pattern.items()
        ]
    )
    p = docs.select(*keys, F.inline(items)).select(*keys, "names", "size", F.posexplode("ps").alias("pidx", "piece"))
    p = p.select(F.explode("names").alias("tokenizer"), *keys, F.expr("pidx div size").cast("int").alias("blk"), "piece")
    p = p.join(vocab.words_for_join(), ["tokenizer", "piece"], "left")
    n = F.sum(piece_token_counts(p, vocab)).cast("long")
    return p.groupBy("tokenizer", *keys, "blk").agg(n.alias("n_tokens")).where(F.col("n_tokens") > 0)


def _stretches(texts: DataFrame, vocab: Vocab, g: list[str]) -> DataFrame:
    """The chosen stretches of ``texts`` (``wanted``: array of ``(tokenizer, blk, start, step)``) as
    ``(tokenizer, group..., doc_id, start, step, ps)``: the pieces, or the one text, of each stretch."""
    def of_one(t) -> Column:
        of = F.filter("wanted", lambda w: w["tokenizer"] == t.name)
        if t.char_level:
            cut = F.transform(of, lambda w: w.withField("ps", F.array(F.substring(F.col("text"), w["blk"] * INDEX_CHARS + 1, F.lit(INDEX_CHARS)))))
        else:
            # the pieces are cut once a text (a lambda variable), then sliced for each stretch
            sliced = lambda ps: F.transform(of, lambda w: w.withField("ps", F.slice(ps, w["blk"] * INDEX_PIECES + 1, INDEX_PIECES)))
            cut = F.flatten(F.transform(F.array(F.regexp_extract_all("text", F.lit(t.piece_pattern), 0)), sliced))
        return F.when(F.size(of) > 0, cut).otherwise(F.slice(cut, 1, 0))

    by_tok = [of_one(t) for t in vocab.tokenizers]
    return texts.select(*g, "doc_id", F.inline(F.concat(*by_tok))).select("tokenizer", *g, "doc_id", "start", "step", "ps")


def _spread(text: Column, points: list[int]) -> Column:
    """The text with one character a token: a character outside of ``points`` as often as it has UTF-8 bytes."""
    unknown = uc._others(uc._ranges(points))
    for k, spans in ((2, [(0x80, 0x7FF)]), (3, [(0x800, 0xD7FF), (0xE000, 0xFFFF)]), (4, [(0x10000, 0x10FFFF)])):
        of_k = [r for lo, hi in spans for r in uc._clip(unknown, lo, hi)]
        text = F.regexp_replace(text, F.lit(uc.java_class(of_k)), F.lit("$0" * k)) if of_k else text
    return text


def _char_picks(stretches: DataFrame, vocab: Vocab, g: list[str], max_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Character-level tokenizers: sampled ids read from the stretch by position.  Without a table every byte is an
    id; with one, unknown characters are repeated, once a byte, so that every character is an id.

    Also returned, cut into characters: stretches with unknown characters whose document's key repeats, which are one."""
    s = stretches.where(F.col("tokenizer").isin(*[t.name for t in vocab.tokenizers if t.char_level]))
    here = ["tokenizer", *g, "doc_id", "start", "step"]
    again = s.groupBy(*here).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)  # at most a row a stretch
    s = s.withColumn("text", F.col("ps")[0]).join(F.broadcast(again), here, "left")
    unknown = F.lit(False)
    for name, points in vocab.char_sets().items():
        others = uc.java_class([r for lo, hi in ((0, 0xD7FF), (0xE000, 0x10FFFF)) for r in uc._clip(uc._others(uc._ranges(points)), lo, hi)])
        unknown = F.when(F.col("tokenizer") == name, F.col("text").rlike(others)).otherwise(unknown)
    shared = F.when(F.col("copies").isNotNull(), unknown).otherwise(F.lit(False))
    merged = s.where(shared).withColumn("ps", F.split("text", "")).select(*stretches.columns)
    s = s.where(~shared)
    text, has_table = F.col("text"), F.lit(False)
    for name, points in vocab.char_sets().items():
        mine = F.col("tokenizer") == name
        text = F.when(mine, _spread(F.col("text"), points)).otherwise(text)
        has_table = has_table | mine
    s = s.select("tokenizer", *g, "start", "step", text.alias("text"), has_table.alias("has_table"))
    n = F.when(F.col("has_table"), F.char_length("text")).otherwise(F.octet_length("text"))
    byte_of = lambda c, i: F.conv(F.hex(F.substring(F.encode(c, "UTF-8"), i + 1, F.lit(1))), 16, 10).cast("int")
    e = s.select("tokenizer", *g, "has_table", "text", "start", F.explode(sampled_positions(n, "start", max_tokens)).alias("rel"))
    e = e.withColumn("at", F.col("rel").cast("int"))
    ch = F.when(F.col("has_table"), F.substring("text", F.col("at") + 1, F.lit(1)))
    e = e.select(
        "tokenizer", *g, (F.col("start") + F.col("rel")).alias("tpos"), ch.alias("ch"),
        F.when(F.col("has_table"), F.substring("text", 1, F.col("at"))).alias("before"),
        F.when(~F.col("has_table"), byte_of(F.col("text"), F.col("at"))).alias("byte"),
    )
    e = e.join(vocab.chars_for_join(), ["tokenizer", "ch"], "left")
    same = F.char_length("before") - F.char_length(F.rtrim("before", F.col("ch")))  # copies of the character just before
    spelt = F.when(F.col("ch").isNotNull(), byte_of(F.col("ch"), (same % F.octet_length("ch")).cast("int")))
    return e.select("tokenizer", *g, "tpos", F.coalesce("byte", "char_id", spelt).alias("token_id")), merged


def _piece_picks(stretches: DataFrame, vocab: Vocab, g: list[str], max_tokens: int) -> DataFrame:
    """Sampled ids of stretches given as pieces: running token counts inside a stretch (a short array)
    point to the pieces that hold a sampled position, and only these are encoded token by token."""
    here = ["tokenizer", *g, "doc_id", "start", "step"]
    p = stretches.select(*here, F.posexplode("ps").alias("pidx", "piece"))
    p = p.join(vocab.words_for_join(), ["tokenizer", "piece"], "left")
    p = p.select(*here, F.struct("pidx", "piece", piece_token_counts(p, vocab).cast("long").alias("n")).alias("p"))
    s = p.groupBy(*here).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    none = F.array().cast("array<bigint>")
    ends = F.aggregate("ps", none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x["n"])))
    s = s.withColumn("ends", F.when(F.size("ps") > 0, ends).otherwise(none))
    placed = F.transform("ps", lambda x, i: F.struct(x["piece"].alias("piece"), (F.col("start") + F.get("ends", i) - x["n"]).alias("at"), x["n"].alias("n")))
    s = s.select(*here, F.explode(placed).alias("x")).select(*here, "x.*")
    first = F.expr("(at + step - 1) div step")
    hits = s.where((F.col("n") > 0) & (first * F.col("step") < F.col("at") + F.col("n")) & (first < max_tokens))
    enc = encode_pieces(hits.select("tokenizer", *g, "doc_id", "step", "at", "n", "piece"), vocab, [*g, "doc_id", "step", "at", "n"])
    ids = enc.groupBy("tokenizer", *g, "doc_id", "step", "at", "n").agg(F.sort_array(F.collect_list(F.struct("cidx", "bidx", "token_id"))).alias("ids"))
    ids = ids.withColumnRenamed("at", "start")
    picked = ids.select("tokenizer", *g, "start", "ids", F.explode(sampled_positions(F.col("n"), "start", max_tokens)).alias("rel"))
    return picked.select("tokenizer", *g, (F.col("start") + F.col("rel")).alias("tpos"), F.get("ids", F.col("rel").cast("int"))["token_id"].alias("token_id"))


def even_sample_tokens(
    docs: DataFrame,
    vocab: Vocab,
    firsts: DataFrame,
    group_cols: Sequence[str] = ("lang_key",),
    max_tokens: int = DEFAULT_TOKEN_SAMPLE,
    add_special_tokens: bool = True,
    block_size: int = DEFAULT_BLOCK_SIZE,
) -> DataFrame:
    """``(tokenizer, group..., tpos, token_id)``: every ``step``-th token of the language's ids.

    ``docs`` must carry separators already; ``firsts`` = ``(group..., first_doc)``.  With
    special tokens the BOS id sits at position 0 and document tokens start at 1.

    Rank and select: one scan of the text writes a rank index (:func:`token_index`); running sums
    over it name the stretches that hold a sampled position (at most ``max_tokens`` a tokenizer and
    group), and a second scan cuts just these out of their texts.
    """
    g = list(group_cols)
    spark = docs.sparkSession
    index = token_index(docs.select(*g, "doc_id", "text"), vocab, [*g, "doc_id"])
    index = materialize(index.withColumn("place", F.struct("doc_id", "blk")))
    specials = spark.createDataFrame(
        [(t.name, t.n_special if add_special_tokens else 0, t.bos_id) for t in vocab.tokenizers],
        "tokenizer string, n_special int, bos_id int",
    )
    with_off, totals = exclusive_prefix_sums(index, ["tokenizer", *g], "place", {"t_off": "n_tokens"}, block_size, written=True)
    total = F.col("n_tokens_total") + F.col("n_special")
    lt = totals.join(F.broadcast(specials), "tokenizer").select(
        "tokenizer", *g, "n_special", "bos_id", total.alias("total"), even_sample_step(total, max_tokens).alias("step")
    )
    sel = with_off.join(F.broadcast(lt), ["tokenizer", *g])  # one row per tokenizer and group
    # global position of the stretch's first token, and the first sampled index at or after it
    sel = sel.withColumn("start", F.col("t_off") + F.col("n_special"))
    first_kept = F.expr("(start + step - 1) div step")
    holds = (first_kept * F.col("step") < F.col("start") + F.col("n_tokens")) & (first_kept < max_tokens)
    wanted = sel.where(holds).groupBy(*g, "doc_id").agg(F.collect_list(F.struct("tokenizer", "blk", "start", "step")).alias("wanted"))
    # at most max_tokens stretches per tokenizer and group
    texts = docs.select(*g, "doc_id", "text").join(F.broadcast(wanted), [*g, "doc_id"])
    stretches = materialize(_stretches(texts, vocab, g))
    by_char = [t.name for t in vocab.tokenizers if t.char_level]
    rest = stretches.where(~F.col("tokenizer").isin(*by_char)) if by_char else stretches
    picks, merged = _char_picks(stretches, vocab, g, max_tokens) if by_char else (None, None)
    out = _piece_picks(rest.unionByName(merged) if by_char else rest, vocab, g, max_tokens)
    if by_char:
        out = out.unionByName(picks)
    # the special token at position 0 is always kept (0 % step = 0)
    bos = lt.where((F.col("n_special") > 0) & (F.col("total") > 0)).select(
        "tokenizer", *g, F.lit(0).cast("long").alias("tpos"), F.col("bos_id").alias("token_id")
    )
    # at most max_tokens rows per (tokenizer, language), and consumers read it more than once
    return materialize(out.select("tokenizer", *g, F.col("tpos").cast("long"), "token_id").unionByName(bos))


# --- A12 / A13 ------------------------------------------------------------------


def annotate(ids: DataFrame, vocab: Vocab, keep_empty: bool = True) -> DataFrame:
    """D3: join token occurrences with the annotated vocabulary; undecodable ids are dropped
    (P11) and, unless ``keep_empty``, so are empty decodes (P12)."""
    ann = F.broadcast(annotated_vocab(vocab))
    out = ids.join(ann, ["tokenizer", "token_id"], "inner").where(F.col("token_text").isNotNull())
    if not keep_empty:
        out = out.where(F.length("token_text") > 0)
    return out


def global_metrics_long(annotated: DataFrame, weight: Column | None = None) -> DataFrame:
    """A12 + A13 as a long table ``(tokenizer, metric, value)``; script keys only when count > 0."""
    wcol = weight if weight is not None else F.lit(1)
    a = annotated.withColumn("_w", wcol.cast("long"))
    base = a.groupBy("tokenizer").agg(
        F.sum("_w").alias("total"),
        F.sum(F.when(F.col("starts_with_space"), F.col("_w")).otherwise(0)).alias("space"),
        F.sum(F.when(F.col("has_whitespace_in_middle"), F.col("_w")).otherwise(0)).alias("inner"),
        F.sum(F.when(F.col("script_overlap"), F.col("_w")).otherwise(0)).alias("overlap"),
    )
    pct = lambda c: F.col(c).cast("double") / F.col("total").cast("double") * F.lit(100.0)
    fixed = base.where(F.col("total") > 0).select(
        "tokenizer",
        F.explode(
            F.array(
                F.struct(F.lit("total_tokens_analyzed").alias("metric"), F.col("total").cast("double").alias("value")),
                F.struct(F.lit("tokens_starting_with_space_pct").alias("metric"), pct("space").alias("value")),
                F.struct(F.lit("tokens_with_whitespace_in_middle_pct").alias("metric"), pct("inner").alias("value")),
                F.struct(F.lit("tokens_with_script_overlap_pct").alias("metric"), pct("overlap").alias("value")),
            )
        ).alias("m"),
    ).select("tokenizer", "m.metric", "m.value")
    per_script = (
        a.select("tokenizer", "_w", F.explode("scripts").alias("script"))
        .groupBy("tokenizer", "script")
        .agg(F.sum("_w").alias("n"))
        .where(F.col("n") > 0)
        .join(base.select("tokenizer", "total"), "tokenizer")
        .select(
            "tokenizer",
            F.concat(F.lit("tokens_with_"), F.lower("script"), F.lit("_unicode_pct")).alias("metric"),
            (F.col("n").cast("double") / F.col("total").cast("double") * F.lit(100.0)).alias("value"),
        )
    )
    return fixed.unionByName(per_script)
