"""Prefix trie of conversations: shared openings, their subtrees, leaves and the text saved by keeping each once.

Method: every conversation is a path of turn digests (128 bits of SHA-256 over role and text; equal digests are taken
for equal turns). Equal paths are counted together, in blocks of ID_BLOCK ids, before anything is sorted. Paths are
dealt out by range, so that a task holds consecutive paths, and cut into shards of at most SHARD_NODES nodes (a longer
path makes a longer shard). A shard is written as balanced parentheses; range min-max blocks over their excess find each
node's closing parenthesis, which delimits its subtree; the rank of ``()`` counts leaves; cumulative arrays over the
preorder give members and savings (``parentheses.py``).

Nodes on a shard's first or last path (its spines) may go on in the neighbouring shards. They are left open, with what
hangs on them below, and merged in rounds: FAN neighbours at a time, equal spine nodes are added up, those inside the
merged range are closed, those on its two edges go on to the next round, until one range is left. A task of a round
gets 2 * depth rows of each of its shards. A child whose parent was still open gets the parent's id by a join, salted, as
one opening may be shared by most conversations.

Defined results: null role or text: empty; null turn: before all others; equal turn numbers: by digest; repeated rows:
each is a turn; rows with null conv_id belong to no conversation and are left out; a conversation without turns after
rebuilding ends at the root; empty table: no rows; other columns are ignored; negative ids: c - c mod 100 rounds
downwards. A conversation's digests (16 bytes a turn) fit into a row; its texts are only hashed and measured in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, table, written
from .parentheses import Parentheses

#: Conversations of one block share a head conversation; at most HEAD - 1 of its turns open the others.
BLOCK, HEAD = 100, 6
#: Ids joined into one row before equal paths meet in a task.
ID_BLOCK = 4096
#: Nodes of a shard, shards merged in a task, copies of an open parent.
SHARD_NODES, FAN, SALTS = 200_000, 16, 16
WIDTH = 16

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A row with ``open`` is a spine node whose numbers only cover what is closed below it.
PART = f"{NODE}, name binary, parent_name binary, open boolean, first boolean, last boolean, size long, n_ends long, part long, seq long"
COLUMNS = [c.split()[0] for c in PART.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def own_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the digest and size (code points) of each turn, in order; dealt out by ``base``, the head's id."""
    conv = F.col("conv_id").cast("long")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).alias("size"))
    rows = turns.where("conv_id IS NOT NULL").select(conv.alias("conv_id"), (conv - F.pmod(conv, F.lit(BLOCK))).alias("base"), turn.alias("t"))
    return rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """The first h turns of the head conversation, then the own turns after the first h: conv_id, path, sizes."""
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, HEAD - 1)), ignorenulls=True)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    df = convs.withColumn("head", head.over(Window.partitionBy("base"))).withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    df = df.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), ""))
    return df.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t.size).alias("sizes"))


def whole(turns: DataFrame) -> DataFrame:
    """Conversations as they are: conv_id, path, sizes."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.digest)), ""))
    return own_turns(turns).select("conv_id", path.alias("path"), F.transform("turns", lambda t: t.size).alias("sizes"))


def _shared(a: bytes, b: bytes) -> int:
    """Leading cells that two paths have in common."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    x, y = (np.frombuffer(p, np.uint8, n * WIDTH).reshape(n, WIDTH) for p in (a, b))
    return int(np.argmax((x != y).any(axis=1)))


def _names(path: bytes) -> list[bytes]:
    """Names of the nodes on a path, root first."""
    h = hashlib.sha256()
    out = [h.digest()[:WIDTH]]
    for at in range(0, len(path), WIDTH):
        h.update(path[at : at + WIDTH])
        out.append(h.copy().digest()[:WIDTH])
    return out


class _Shard:
    """Consecutive distinct paths, added in order."""

    def __init__(self):
        self.bits, self.depth, self.size, self.parent = [1], [0], [0], [-1]
        self.ends, self.least, self.digest = [0], [np.iinfo(np.int64).max], [NO_ENDS]
        self.first = self.path = None
        self.stack = [0]

    def add(self, path: bytes, sizes: list[int], n: int, least: int, digest: str) -> None:
        depth = len(path) // WIDTH
        shared = 0 if self.path is None else _shared(self.path, path)
        self.bits += [0] * (len(self.stack) - 1 - shared)
        del self.stack[shared + 1 :]
        for d in range(shared, depth):
            self.bits.append(1)
            self.parent.append(self.stack[-1])
            self.stack.append(len(self.depth))
            self.depth.append(d + 1)
            self.size.append(sizes[d])
        new = depth - shared
        self.ends += [0] * new
        self.least += [np.iinfo(np.int64).max] * new
        self.digest += [NO_ENDS] * new
        node = self.stack[-1]
        self.ends[node], self.least[node], self.digest[node] = n, least, digest
        if self.path is None:
            self.first, self.first_nodes = path, list(self.stack)
        self.path = path

    def rows(self, part: int, seq: int) -> pa.RecordBatch:
        bits = np.array(self.bits + [0] * len(self.stack), np.uint8)
        end, leaves = Parentheses(bits).subtrees()
        n = len(self.depth)
        depth, size, parent, ends, least = (np.array(x, np.int64) for x in (self.depth, self.size, self.parent, self.ends, self.least))
        over = lambda v: (c := np.concatenate([[0], np.cumsum(v)]))[end] - c[:-1]  # noqa: E731 - sums over subtrees
        convs = over(ends)
        spine = {v: name for path, nodes in ((self.first, self.first_nodes), (self.path, self.stack)) for v, name in zip(nodes, _names(path), strict=True)}
        open_ = np.zeros(n, bool)
        open_[list(spine)] = True
        saved = over(np.where(open_, 0, (convs - 1) * size))
        # the least member, from the deepest level up; open nodes keep theirs apart
        order = np.argsort(depth, kind="stable")
        borders = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for d in range(int(depth.max()), 0, -1):
            level = order[borders[d] : borders[d + 1]]
            level = level[~open_[level]]
            np.minimum.at(least, parent[level], least[level])
        closed_kids = np.bincount(parent[1:][~open_[1:]], minlength=n) if n > 1 else np.zeros(n, np.int64)
        # what hangs below an open node, without open children and without its own members
        own_convs, own_leaves, own_saved = convs.copy(), leaves.copy(), saved.copy()
        inner = [v for v in spine if v]
        own_convs[list(spine)] -= ends[list(spine)]
        childless = end - np.arange(n) == 1
        own_leaves[open_ & childless] -= 1
        for v in inner:
            own_convs[parent[v]] -= convs[v]
            own_leaves[parent[v]] -= leaves[v]
            own_saved[parent[v]] -= saved[v]
        has_parent = parent >= 0
        up = np.where(has_parent, parent, 0)
        names = [spine.get(v) for v in range(n)]
        resolved = has_parent & ~open_ & ~open_[up]
        data = {
            "conv_id": least,
            "depth": depth,
            "parent_conv_id": pa.array(least[up], mask=~resolved),
            "n_convs": np.where(open_, own_convs, convs),
            "n_children": closed_kids,
            "n_leaves": np.where(open_, own_leaves, leaves),
            "saved_tokens": np.where(open_, own_saved, saved),
            "ends_sha256": pa.array(self.digest, pa.string()),
            "name": pa.array(names, pa.binary()),
            "parent_name": pa.array([names[p] if p >= 0 else None for p in self.parent], pa.binary()),
            "open": open_,
            "first": np.isin(np.arange(n), self.first_nodes),
            "last": np.isin(np.arange(n), self.stack),
            "size": size,
            "n_ends": ends,
            "part": np.full(n, part),
            "seq": np.full(n, seq),
        }
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in data.values()], names=COLUMNS)


def _build(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        shard, path, sizes, count, least, ids = _Shard(), None, None, 0, 0, None

        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("path", "sizes", "n", "least", "ids")), strict=True)
            yield None, None, 0, 0, ""

        for p, s, n, low, said in rows():
            if p is not None and p == path:  # a further block of ids of one path
                count, least = count + n, min(least, low)
                ids.update(b"," + said.encode())
                continue
            if path is not None:
                shard.add(path, sizes, count, least, ids.hexdigest())
                if len(shard.depth) >= limit:
                    yield shard.rows(part, seq)
                    shard, seq = _Shard(), seq + 1
            path, sizes, count, least, ids = p, s, n, low, hashlib.sha256(said.encode())
        if shard.path is not None:
            yield shard.rows(part, seq)

    return run


def _merged(top: bool):
    """Merge the spines of one group of neighbouring shards; with ``top`` all of them are closed."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.select(COLUMNS).to_pylist()
        order = [(r["part"], r["seq"]) for r in rows]
        low, high = min(order), max(order)
        nodes: dict[bytes, dict] = {}
        for at, r in zip(order, rows, strict=True):
            r["first"], r["last"] = r["first"] and at == low, r["last"] and at == high
            if (v := nodes.setdefault(r["name"], r)) is not r:
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    v[c] += r[c]
                v["conv_id"] = min(v["conv_id"], r["conv_id"])
                v["first"], v["last"] = v["first"] or r["first"], v["last"] or r["last"]
                if r["n_ends"]:
                    v["n_ends"], v["ends_sha256"] = r["n_ends"], r["ends_sha256"]
        for v in sorted(nodes.values(), key=lambda v: -v["depth"]):
            v["part"], v["seq"] = low[0] // FAN, 0
            v["open"] = not top and (v["first"] or v["last"])
            if v["open"]:
                continue
            v["n_convs"] += v["n_ends"]
            v["n_leaves"] += v["n_children"] == 0
            v["saved_tokens"] += (v["n_convs"] - 1) * v["size"]
            if (parent := nodes.get(v["parent_name"])) is not None:
                for c in ("n_convs", "n_leaves", "saved_tokens"):
                    parent[c] += v[c]
                parent["n_children"] += 1
                parent["conv_id"] = min(parent["conv_id"], v["conv_id"])
        for v in nodes.values():
            parent = nodes.get(v["parent_name"])
            if not v["open"] and parent is not None and not parent["open"]:
                v["parent_conv_id"] = parent["conv_id"]
        return pa.Table.from_pylist(list(nodes.values()), schema=SCHEMA)

    return run


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
SCHEMA = pa.schema([(c, _TYPES[t]) for c, t in (x.split() for x in PART.split(", "))])


def trie(paths: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row a node of the prefix trie of ``paths`` (conv_id, path, sizes): the columns of NODE."""
    spark = paths.sparkSession
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    block = F.shiftright("conv_id", ID_BLOCK.bit_length() - 1)
    counted = paths.groupBy("path", block.alias("block")).agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    counted = written(counted, "trie-paths")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(shards, "path").sortWithinPartitions("path", "block")
    parts = written(map_arrow(dealt.select("path", "sizes", "n", "least", "ids"), _build(shard_nodes), PART), "trie-shards")
    closed, spines = parts.where("NOT open"), parts.where("open")
    groups = (spines.agg(F.max("part")).first()[0] or 0) + 1
    named = None
    while True:
        groups = -(-groups // FAN)
        merged = spines.groupBy(F.expr(f"part div {FAN}").alias("g")).applyInArrow(_merged(groups == 1), PART)
        merged = written(merged, "trie-spines")
        done = merged.where("NOT open")
        named = done if named is None else named.unionByName(done)
        if groups == 1:
            break
        spines = merged.where("open")
    nodes = closed.unionByName(named)
    waits = nodes.where("parent_conv_id IS NULL AND parent_name IS NOT NULL")
    rest = nodes.where("parent_conv_id IS NOT NULL OR parent_name IS NULL")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    parents = named.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("found"), salts)
    waits = waits.withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    waits = waits.join(parents, ["parent_name", "salt"], "left").withColumn("parent_conv_id", F.col("found"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    return rest.select(columns).unionByName(waits.select(columns))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``, rebuilt with shared heads: one row a node."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(own_turns(turns)))


def _nibble(i: int) -> int:
    for _ in range(4):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


#: DuckDB has no crc32: four bits at a time.
_CRC = (
    "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''), lambda x: [ascii(x) & 15, ascii(x) >> 4]))), "
    f"lambda c, n: xor(xor(c, n) >> 4, {[_nibble(i) for i in range(16)]}[(xor(c, n) & 15) + 1])), 4294967295)"
)
_L = 2 * WIDTH
ORACLE = f"""
WITH own AS (
  SELECT conv_id, turn, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), {_L}) AS digest,
    length(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM own
), convs AS (
  SELECT conv_id, conv_id - (conv_id % {BLOCK} + {BLOCK}) % {BLOCK} AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % {HEAD} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, t.place, t.digest, t.size FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, t.place, t.digest, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), members AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, size FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved
  FROM members GROUP BY path
), kids AS (
  SELECT left(path, length(path) - {_L}) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), ends AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS said
  FROM (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id) JOIN members USING (conv_id, depth) GROUP BY path
), above AS (
  SELECT n.path, left(n.path, {_L} * d) AS up, n.saved FROM nodes n, LATERAL (SELECT unnest(generate_series(0, n.depth)) AS d)
), subtrees AS (
  SELECT up AS path, sum(saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM above a LEFT JOIN kids k ON k.path = a.path GROUP BY up
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.said, sha256('')) AS ends_sha256
FROM nodes n JOIN subtrees s USING (path) LEFT JOIN kids k USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - {_L})
"""
