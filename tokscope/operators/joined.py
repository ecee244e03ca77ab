"""A group's joined text as rows that no piece and no unit reaches over.

The text of a group (a language, say) is its documents in ``doc_id`` order joined by ``"\\n"``.
Encoding it row by row is exact only if no piece crosses a row's end, so each document is cut
twice: what lies outside its first and last *cut* is joined with its neighbours' ends and the
separators between them, and becomes a row of its own (a *border*).

* For tokens the cut lies between white space and other characters: the white space between two
  documents is one border, also where it holds whole documents.
* For syllables the cut is the tsheg: the unit between the last tsheg of one document and the
  first of the next is one border.

Rows are ordered by ``struct(doc_id, part)``: 0 = the border before a document, 1 = its body,
2 = the border after the last one.  Borders come from a slim table of edge strings; the texts
themselves are cut by a projection, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import unicode_classes as uc
from ..session import materialize
from .prefix import DEFAULT_BLOCK_SIZE, exclusive_prefix_sums

SEPARATOR = "\n"


def whitespace_edges(text: Column) -> dict[str, Column]:
    """Leading and trailing white space; ``whole``: there is nothing else (then all of it is head)."""
    ws = f"[{uc.ws()}]"
    head = F.when(F.substring(text, 1, 1).rlike(ws), F.regexp_extract(text, f"^{ws}+", 0)).otherwise(F.lit(""))
    tail = F.when(F.substring(text, -1, 1).rlike(ws), F.regexp_extract(text, f"{ws}+$", 0)).otherwise(F.lit(""))
    whole = F.octet_length(head) == F.octet_length(text)
    return {"head": head, "tail": F.when(whole, F.lit("")).otherwise(tail), "whole": whole}


def syllable_edges(text: Column) -> dict[str, Column]:
    """Text before the first and after the last tsheg; ``whole``: there is no tsheg."""
    whole = ~text.contains(S.TSHEG)
    return {
        "head": F.substring_index(text, S.TSHEG, 1),
        "tail": F.when(whole, F.lit("")).otherwise(F.substring_index(text, S.TSHEG, -1)),
        "whole": whole,
    }


def body(text: Column, edges: dict[str, Column]) -> Column:
    """The text without its edges."""
    n = F.char_length(edges["head"])
    return F.substring(text, n + 1, F.char_length(text) - n - F.char_length(edges["tail"]))


def row_key(doc_id: Column, part: int) -> Column:
    return F.struct(doc_id.alias("doc_id"), F.lit(part).alias("part"))


def borders(edges: DataFrame, group_cols: Sequence[str], block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """``(group..., doc_id struct, text)`` from written ``(group..., doc_id, head, tail, whole)``, empty ones left out."""
    g = list(group_cols)
    slim = edges.select(*g, "doc_id", "head", "tail", "whole", (~F.col("whole")).cast("long").alias("solid"), F.lit(1).cast("long").alias("one"))
    placed, _ = exclusive_prefix_sums(slim, g, "doc_id", {"index": "solid", "before": "one"}, block_size, written=True)
    separated = F.when(F.col("before") == 0, F.col("head")).otherwise(F.concat(F.lit(SEPARATOR), F.col("head")))
    own = F.struct(
        F.col("index").alias("index"), F.lit(0).alias("seq"), separated.alias("s"), F.when(~F.col("whole"), F.col("doc_id")).alias("before_doc")
    )
    after = F.struct(
        (F.col("index") + 1).alias("index"), F.lit(1).alias("seq"), F.col("tail").alias("s"), F.when(F.lit(False), F.col("doc_id")).alias("before_doc")
    )
    parts = placed.select(*g, "doc_id", F.explode(F.when(F.col("whole"), F.array(own)).otherwise(F.array(own, after))).alias("c"))
    joined = parts.select(*g, "doc_id", "c.*").groupBy(*g, "index").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "seq", "s"))).alias("ps"),
        F.max("before_doc").alias("before_doc"),
        F.max("doc_id").alias("last_doc"),
    )
    key = F.struct(
        F.coalesce("before_doc", "last_doc").alias("doc_id"),
        F.when(F.col("before_doc").isNull(), F.lit(2)).otherwise(F.lit(0)).alias("part"),
    )
    text = F.array_join(F.transform("ps", lambda p: p["s"]), "")
    return joined.select(*g, key.alias("doc_id"), text.alias("text")).where(F.col("text") != "")


def token_rows(docs: DataFrame, group_cols: Sequence[str], edges: DataFrame | None = None, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """``(group..., doc_id struct, text)``: the joined text of each group, cut around white space.

    Exact for tokenizers whose pieces keep white-space runs of two characters or more, and line ends,
    apart from other characters, as all native ones do.  (A single blank may belong to the word after
    it: a border always holds a separator, and the first document keeps its head.)  ``edges`` =
    ``(group..., doc_id, head, tail, whole)`` when already computed.
    """
    g = list(group_cols)
    text = F.col("text")
    cut = whitespace_edges(text)
    if edges is None:
        edges = docs.select(*g, "doc_id", *[c.alias(n) for n, c in cut.items()])
    edges = materialize(edges)
    firsts = edges.groupBy(*g).agg(F.min("doc_id").alias("first_doc"))  # one row per group

    def uncut(df: DataFrame) -> tuple[DataFrame, Column]:
        return df.join(F.broadcast(firsts), g), F.col("doc_id") == F.col("first_doc")

    slim, first = uncut(edges)
    slim = slim.withColumn("head", F.when(first & ~F.col("whole"), F.lit("")).otherwise(F.col("head")))
    texts, first = uncut(docs)
    cut["head"] = F.when(first & ~cut["whole"], F.lit("")).otherwise(cut["head"])
    bodies = texts.select(*g, row_key(F.col("doc_id"), 1).alias("doc_id"), body(text, cut).alias("text")).where(F.col("text") != "")
    return bodies.unionByName(borders(slim.drop("first_doc"), g, block_size))
