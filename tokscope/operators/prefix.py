"""Ordered running sums without one task per group (the two-level prefix sum).

A window ``partition by lang order by doc_id`` puts a whole language into one task; a
language may hold a third of all documents.  Instead:

1. rows are dealt by range of (group, order) into blocks of about ``block_size`` rows, whatever
   the order values look like (dense, sparse, hashed, structs), and written;
2. per (group, block) totals are aggregated (partial aggregation, tiny shuffle);
3. a window over the *block totals* gives each block's offset (one row per block);
4. the exact running sum inside each (group, block) is a window partitioned by both, so a
   hot group is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_BLOCK_SIZE = 1 << 16


def blocked(df: DataFrame, part_cols: Sequence[str], order_col: str, block_size: int, written: bool = False) -> DataFrame:
    """``df`` with ``_blk``: number of the range of (group, order) that a row lies in.

    Both steps are written: the range bounds are sampled from slim rows (not from texts), and
    every reader must see the same blocks.  ``written``: ``df`` reads a written table already.
    """
    slim = df if written else materialize(df)
    n = max(1, -(-slim.count() // block_size))
    return materialize(slim.repartitionByRange(n, *part_cols, order_col).withColumn("_blk", F.spark_partition_id()))


def exclusive_prefix_sums(
    df: DataFrame,
    part_cols: Sequence[str],
    order_col: str,
    values: dict[str, str],
    block_size: int = DEFAULT_BLOCK_SIZE,
    below: int | None = None,
    written: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Add, for each ``out -> value`` in ``values``, the sum of ``value`` over earlier rows.

    ``order_col`` must be unique within a group; any orderable type will do.  Returns the
    augmented rows and a ``(part_cols..., <value>_total...)`` table of group totals.
    ``written``: ``df`` is slim and reads a written table, so it can be read more than once.
    With ``below`` (one output only, non-negative values), blocks whose offset already
    reaches ``below`` are dropped before the exact window: a budgeted prefix then only
    sorts the first blocks of each group.
    """
    part = list(part_cols)
    blk = blocked(df, part, order_col, block_size, written)
    totals = blk.groupBy(*part, "_blk").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()])
    wb = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, "_blk", *[F.coalesce(F.sum(f"_t_{o}").over(wb), F.lit(0)).alias(f"_o_{o}") for o in values]
    )
    if below is not None:
        (only,) = values
        offsets = offsets.where(F.col(f"_o_{only}") < F.lit(below))
    wr = Window.partitionBy(*part, "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    joined = blk.join(offsets, [*part, "_blk"], "inner")
    out_cols = [
        (F.col(f"_o_{o}") + F.coalesce(F.sum(v).over(wr), F.lit(0))).alias(o) for o, v in values.items()
    ]
    result = joined.select(*df.columns, *out_cols)
    group_totals = totals.groupBy(*part).agg(*[F.sum(f"_t_{o}").alias(f"{v}_total") for o, v in values.items()])
    return result, group_totals
