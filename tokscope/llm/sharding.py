"""Resharding by minimum-cost flow (operator 9).

Given the documents' old shards and the capacities of new ones, move as few bytes as possible:

1. Sizes: each old shard is cut into blocks by a hash, BLOCKS of rows over FINE bytes and BLOCKS of the others;
   Spark sums bytes per block.  Shards times blocks is a fixed number, whatever the corpus holds.
2. Flow: a minimum-cost flow from old shards (their bytes) to new shards (their capacities) says how many bytes
   of each old shard go where; a byte that stays in the shard of its number costs nothing, a moved one costs 1
   (or what ``cost`` says).  The graph has a node per shard.
3. Blocks to rows: blocks of large rows go whole to new shards that have room for them; the blocks of small rows
   (and what had no room) fill the shards up, cut at the row whose middle byte passes the shard's share.  Running
   sums are taken within a block only, so no task orders a whole shard.
4. Rewrite: only shards that lose or gain rows are written anew, each by several tasks (FILE_ROWS rows a file).

Result: doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless in each shard), grown_shard (null under
this law), old_shard, moved.  New shards differ by no more than the (small) rows at their cuts.

Defined results: a null text has the size 16 and the checksum of the empty string; a null doc_id has a hash like
any other; repeated rows lie side by side, each with a slot of its own; an empty table gives no rows; extra
columns are ignored by ``reshard`` and kept by ``rewrite``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import table, written

OLD_SHARDS = 32
SHARDS = 40
BLOCKS = 64
FINE = 1024
ROW_BYTES = 16
#: Rows of a file that rewrite() writes.
FILE_ROWS = 20_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] from i to j with least summed cost, all supply sent (successive cheapest paths)."""
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    inf = float("inf")
    while any(left):
        # cheapest distance of every node from the sources that still have something to send
        dist = [0.0 if left[i] else inf for i in range(n)] + [inf] * m
        via = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], via[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], via[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j], default=None)
        if end is None or dist[n + end] == inf:
            raise ValueError("the capacities are less than the supply")
        path, node = [], n + end
        while via[node] >= 0:
            path.append((via[node], node))
            node = via[node]
        amount = min(left[node], room[end], *[flow[b][a - n] for a, b in path if a >= n])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[node] -= amount
        room[end] -= amount
    return flow


def _equal(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def _stretches(old: int, sizes: dict[tuple[int, int], int], flow: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(old shard, block, new shard, lo, hi): which bytes of each block go where; the flow's amounts are met exactly."""
    left = {j: x for j, x in enumerate(flow) if x}
    own = sorted((b for s, b in sizes if s == old), key=lambda b: (b >= BLOCKS, -sizes[old, b], b))
    out, rest = [], []
    for b in own:
        to = max(left, key=lambda j: (left[j], -j))
        if b < BLOCKS and sizes[old, b] <= left[to]:
            out.append((old, b, to, 0, sizes[old, b]))
            left[to] -= sizes[old, b]
        else:
            rest.append(b)
    queue = sorted(left.items(), key=lambda x: (x[0] != old, x[0]))
    for b in rest:
        at = 0
        while at < sizes[old, b]:
            j, room = queue[0]
            if not room:
                queue.pop(0)
                continue
            take = min(room, sizes[old, b] - at)
            out.append((old, b, j, at, at + take))
            at += take
            queue[0] = (j, room - take)
    return out


def reshard(
    docs: DataFrame,
    old_shard: Column | None = None,
    capacities: list[int] | None = None,
    shards: int = SHARDS,
    old_shards: int = OLD_SHARDS,
    cost: list[list[int]] | None = None,
) -> DataFrame:
    """Every row's place; ``old_shard``: 0 to old_shards - 1 (a hash of doc_id if not given); ``capacities``: in bytes."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    old = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(old_shards)) if old_shard is None else old_shard
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        old.cast("int").alias("old_shard"),
    )
    slim = slim.withColumn("block", (F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BLOCKS)) + F.when(F.col("size") > FINE, 0).otherwise(BLOCKS)).cast("int"))
    slim = written(slim, "sizes")

    found = slim.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).collect()  # old_shards * BLOCKS rows at most
    sizes = {(r["old_shard"], r["block"]): r["bytes"] for r in found}
    supply = [sum(v for (s, _), v in sizes.items() if s == i) for i in range(old_shards)]
    capacities = _equal(sum(supply), shards) if capacities is None else capacities
    cost = [[int(i != j) for j in range(shards)] for i in range(old_shards)] if cost is None else cost
    flow = min_cost_flow(supply, capacities, cost)

    stretches = [x for i in range(old_shards) for x in _stretches(i, sizes, flow[i])]
    stretch = F.broadcast(spark.createDataFrame(stretches, "at int, part int, shard int, lo long, hi long"))  # a row per block and cut
    order = Window.partitionBy("old_shard", "block").orderBy("text_crc32", "doc_id", "size")
    line = slim.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    middle = F.col("upto") - F.floor(F.col("size") / 2)
    placed = line.join(stretch, (F.col("old_shard") == F.col("at")) & (F.col("block") == F.col("part")) & (middle > F.col("lo")) & (middle <= F.col("hi")))
    placed = written(placed.select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", "upto"), "placed")

    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n")).collect()  # a row per block and cut
    first, next_slot = [], dict.fromkeys(range(shards), 0)
    for r in sorted(counts, key=lambda r: (r["shard"], r["old_shard"], r["block"])):
        first.append((r["shard"], r["old_shard"], r["block"], next_slot[r["shard"]]))
        next_slot[r["shard"]] += r["n"]
    first_slot = F.broadcast(spark.createDataFrame(first, "shard int, old_shard int, block int, first long"))
    within = Window.partitionBy("old_shard", "block", "shard").orderBy("upto")  # rows of a block at most
    return (
        placed.withColumn("k", F.row_number().over(within) - 1)
        .join(first_slot, ["shard", "old_shard", "block"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("k")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "old_shard",
            (F.col("shard") != F.col("old_shard")).alias("moved"),
        )
    )


def rewrite(docs: DataFrame, places: DataFrame, path: str, file_rows: int = FILE_ROWS) -> list[int]:
    """Writes the shards that lose or gain rows below ``path`` (folders shard=N, with ``slot``); returns their numbers.

    Shards that keep exactly their rows are left as they are.  A shard is dealt out by stretches of ``file_rows`` slots, a
    task and a file each.  Rows that agree in doc_id and text are interchangeable: the k-th of them takes their k-th place.
    """
    lost = places.where("moved").select(F.col("old_shard").alias("shard"))
    gained = places.where("moved").select("shard")
    affected = sorted(r["shard"] for r in lost.unionByName(gained).distinct().collect())
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    places = places.select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    rows = docs.select(*names).withColumns({"__id": F.col("doc_id").cast("long"), "__crc": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    # rows and places of one key meet by a single shuffle; both windows keep to it
    both = rows.unionByName(places, allowMissingColumns=True).repartition("__id", "__crc")
    side = F.col("__slot").isNull()
    both = both.withColumn("__side", side).withColumn("__k", F.row_number().over(Window.partitionBy("__id", "__crc", "__side").orderBy("__shard", "__slot")))
    pair = Window.partitionBy("__id", "__crc", "__k")
    both = both.withColumns({"shard": F.max("__shard").over(pair), "slot": F.max("__slot").over(pair)})
    rows = both.where(F.col("__side") & F.col("shard").isin(affected)).select(*names, "shard", "slot")
    stretch = F.floor(F.col("slot") / file_rows)
    rows.repartition("shard", stretch).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("maxRecordsPerFile", file_rows).option("compression", "zstd").parquet(path)
    return affected


def rewritten(spark: SparkSession, places: DataFrame, affected: list[int], path: str) -> DataFrame:
    """The places read back: from the files of the shards that were written, from ``places`` for the others."""
    law = [F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")]
    kept = places.where(~F.col("shard").isin(affected)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    if not affected:
        return kept
    text = F.coalesce("text", F.lit(""))
    files = spark.read.parquet(path).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        law[0],
        F.col("shard").cast("int").alias("shard"),
        "slot",
        law[1],
    )
    return kept.unionByName(files)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places all of ``documents``, rewrites the affected shards into the shared folder and reads the result from the files."""
    docs = table(spark, sf_dir, "documents")
    places = reshard(docs)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    return rewritten(spark, places, rewrite(docs, places, path), path)
