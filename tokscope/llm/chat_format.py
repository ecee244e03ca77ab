"""Chat formatting: turns of a conversation -> one training text with a loss mask, by Spark expressions alone.

Method (relational formatting, DataFrame functions only):

1. Turns are collected by (conversation, SLICE consecutive turn numbers), so that a conversation with very many turns is
   spread over tasks; the collected structs are sorted and cut into chunks of at most SLICE turns.
2. In a chunk, control strings are escaped, adjacent turns of one role are merged into a message (their texts are
   gathered by ``slice`` and ``array_join``) and messages are concatenated. A short fold (at most SLICE steps) gives the
   byte spans of the trained role's texts.
3. A window over a conversation's chunks gives the glue between chunks (the same role may go on) and the bytes before
   each; the chunks are then collected, sorted and joined. Only this last join sees a whole conversation.

Format: a message is ``<|im_start|>role\\ntext<|im_end|>\\n``; the texts of merged turns are parted by ``<|im_sep|>``.
Inside texts and roles ``<``, k backslashes and ``|`` become ``<``, k+1 backslashes and ``|``, so that ``<|`` only
occurs in marks and reading back is exact; a line end in a role is written ``<|nl|>``. The loss mask is a list of
byte spans [start, end) of the formatted text, one for each text of the trained role; marks, roles and separators are
never under it.

Defined results: null text, null role: empty string; null conv_id: one conversation of its own; null turn: before all
others; equal turn numbers: by role, then text; repeated rows: each is a turn; empty text: a turn with an empty span;
empty table: no rows; other columns are ignored. A formatted conversation is one string, so it has to fit into a row
(2 GB); steps 1 and 2 hold SLICE turns at a time (more only where one conversation gives one turn number, or null, to
more than SLICE rows: these are collected together).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

# Fixed values of the template.
START, END, SEP, LINE = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|nl|>"
TRAINED = "assistant"
#: Turns handled as one array; a power of two.
SLICE = 512

#: The conversation that op12 adds to the table: control strings inside texts.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def _bytes(x: str) -> Column:
    return F.lit(len(x.encode()))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _chunks(turns: DataFrame) -> DataFrame:
    """conv_id, slice, chunk, turns: at most SLICE sorted turns a row."""
    turn = F.col("turn").cast("long")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.shiftright(turn, SLICE.bit_length() - 1).alias("slice"),
        F.struct(
            turn.isNotNull().alias("known"),
            F.coalesce(turn, F.lit(0)).alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_ = rows.groupBy("conv_id", "slice").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    starts = F.sequence(F.lit(1), F.size("ts"), F.lit(SLICE))
    return sorted_.select("conv_id", "slice", F.posexplode(F.transform(starts, lambda s: F.slice("ts", s, SLICE))).alias("chunk", "ts"))


def _same(es: Column, i: Column) -> Column:
    """Does element i (from 0, i > 0) have the role of the one before?"""
    return F.get(es, i).role == F.get(es, i - 1).role


def _formatted_chunks(turns: DataFrame, trained: str) -> DataFrame:
    """conv_id, slice, chunk, first and last role (escaped), body without first header and last end mark, spans in it."""
    es = F.transform(
        "ts",
        lambda t: F.struct(
            F.regexp_replace(escaped(t.role), "\n", LINE).alias("role"),
            escaped(t.text).alias("text"),
            (t.role == trained).alias("trained"),
        ),
    )
    df = _chunks(turns).select("conv_id", "slice", "chunk", es.alias("es"))
    e, n = F.col("es"), F.size("es")
    runs = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~_same(e, i))
    df = df.withColumn("runs", runs)
    r = F.col("runs")
    messages = F.transform(
        r,
        lambda s, j: F.struct(
            F.get(e, s).role.alias("role"),
            F.transform(F.slice(e, s + 1, F.coalesce(F.get(r, j + 1), n) - s), lambda x: x.text).alias("texts"),
        ),
    )
    body = F.array_join(
        F.transform(
            messages,
            lambda m, j: F.concat(F.when(j == 0, F.lit("")).otherwise(F.concat(F.lit(START), m.role, F.lit("\n"))), F.array_join(m.texts, SEP)),
        ),
        END,
    )
    sized = F.transform(
        e,
        lambda x, i: F.struct(
            F.when(i == 0, F.lit(0)).when(_same(e, i), _bytes(SEP)).otherwise(_bytes(END + START + "\n") + F.octet_length(x.role)).alias("glue"),
            F.octet_length(x.text).alias("size"),
            x.trained.alias("trained"),
        ),
    )
    spans_type = "array<struct<start:bigint,end:bigint>>"
    none = F.array().cast(spans_type)

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + x.glue
        span = F.array(F.struct(start.alias("start"), (start + x.size).alias("end")))
        return F.struct((start + x.size).alias("at"), F.when(x.trained, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    spans = F.aggregate(sized, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc.spans)
    return df.select(
        "conv_id",
        "slice",
        "chunk",
        F.get(e, F.lit(0)).role.alias("first_role"),
        F.element_at(e, -1).role.alias("last_role"),
        body.alias("body"),
        spans.alias("spans"),
    )


def format_chats(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, formatted (string), loss_spans (byte spans of the texts of role ``trained``): one row a conversation.

    ``turns``: conv_id, turn, role, text; other columns are ignored.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("slice").asc_nulls_first(), "chunk")
    before = F.lag("last_role").over(w)
    header = F.concat(F.lit(START), F.col("first_role"), F.lit("\n"))
    glue = F.when(before.isNull(), header).when(before == F.col("first_role"), F.lit(SEP)).otherwise(F.concat(F.lit(END), header))
    df = _formatted_chunks(turns, trained).withColumn("glue", glue)
    size = F.octet_length("glue") + F.octet_length("body")
    df = df.withColumns(
        {
            "at": F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.octet_length("glue"),
            "place": F.row_number().over(w),
        }
    )
    at = F.col("at")
    part = F.struct(
        "place",
        F.concat("glue", "body").alias("body"),
        F.transform("spans", lambda s: F.struct((s.start + at).alias("start"), (s.end + at).alias("end"))).alias("spans"),
    )
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return df.select(
        "conv_id",
        F.concat(F.array_join(F.transform("parts", lambda p: p.body), ""), F.lit(END)).alias("formatted"),
        F.flatten(F.transform("parts", lambda p: p.spans)).alias("loss_spans"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted text: array of (role, text), merged ones parted again."""
    inner = F.substring(formatted, F.lit(len(START) + 1), F.char_length(formatted) - len(START) - len(END))
    messages = F.split(inner, r"<\|im_end\|>\n<\|im_start\|>")

    def parted(m: Column) -> Column:
        role = F.substring_index(m, "\n", 1)
        texts = F.split(F.substring(m, F.char_length(role) + 2, F.char_length(m)), r"<\|im_sep\|>")
        said = unescaped(F.replace(role, F.lit(LINE), F.lit("\n")))
        return F.transform(texts, lambda x: F.struct(said.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(messages, parted))


def trained_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return _let(
        F.to_binary(formatted, F.lit("utf-8")),
        lambda b: F.array_join(F.transform(loss_spans, lambda s: unescaped(F.substring(b, s.start.cast("int") + 1, (s.end - s.start).cast("int")).cast("string"))), ""),
    )


def digests(chats: DataFrame) -> DataFrame:
    """op12's columns, read back from the operator's output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = chats.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), trained_text(F.col("formatted"), F.col("loss_spans")).alias("trained"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -1, whose two texts are control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    role = F.when(turn == 0, "user").otherwise(TRAINED)
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), F.lit(TRICKY).alias("text"))
    return digests(format_chats(turns.unionByName(tricky)))


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, '{TRAINED}', '{TRICKY}'
), placed AS (
  SELECT *, row_number() OVER w AS place, lag(role) OVER w AS before FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), written AS (
  SELECT conv_id, place, role, text,
    replace(regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g'), chr(10), '{LINE}') AS said,
    regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS safe, before
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = '{TRAINED}'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN before = role THEN {len(SEP)}
    WHEN before IS NULL THEN {len(START) + 1} + length(said) ELSE {len(END) + len(START) + 1} + length(said) END) + {len(END)} AS BIGINT)
    AS formatted_chars
FROM written GROUP BY conv_id
"""
