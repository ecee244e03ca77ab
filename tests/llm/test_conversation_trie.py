"""The conversation trie against plain Python, whatever the shards and rounds; the parentheses against a stack."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokscope.llm import conversation_trie
from tokscope.llm.parentheses import Parentheses

SCHEMA = "conv_id long, turn long, role string, text string, path string, n_convs int"


def key(role, text):
    said = f"{len((role or '').encode())}:{role or ''}{text or ''}"
    return hashlib.sha256(said.encode()).digest()[:16], len(text or "")


def conversations(rows):
    out = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            out.setdefault(conv_id, []).append((turn is not None, turn or 0, *key(role, text)))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Set of node rows."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (p[-1][1] if p else 0)
            leaves[p[:d]] += p not in kids
    out = []
    for p, m in members.items():
        said = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[1], r[0]))


def awkward():
    rng = random.Random(13)
    rows = [(None, 0, "user", "lost", "x", 1), (5, None, None, None, "x", 1), (5, None, "", "", None, None), (5, 2, "user", "é日", "", 0), (-7, 0, "user", "minus", "", 0)]
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", ""]), "", 0) for c in range(90, 700) for t in range(rng.randint(1, 8)) if c != 300]
    rows += [(c, t, "user", f"same {t}", "", 0) for c in range(9000, 9300) for t in range(7)]  # copies in several id blocks
    rows += [(7000, t, "user", f"deep {t}", "", 0) for t in range(500)] + [(7001, t, "user", f"deep {t}", "", 0) for t in range(450)]
    rows += [(800, 0, "user", "twice", "", 0)] * 2
    return rows


@pytest.mark.parametrize("nodes", [3, 60, 200_000])
def test_equals_plain_python(spark, monkeypatch, nodes):
    rows = awkward()
    monkeypatch.setattr(conversation_trie, "ID_BLOCK", 128)
    convs = conversation_trie.rebuilt(conversation_trie.own_turns(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got(conversation_trie.trie(convs, nodes)) == brute(rebuilt(conversations(rows)))


def test_several_rounds_of_merging(spark, monkeypatch):
    rows = awkward()
    monkeypatch.setattr(conversation_trie, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        convs = conversation_trie.whole(spark.createDataFrame(rows, SCHEMA))
        assert got(conversation_trie.trie(convs, 50)) == brute(conversations(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_registered_query_and_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(conversation_trie.op13_conversation_trie(spark, sf)) == brute(rebuilt(conversations(rows)))
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.own_turns(none))).collect() == []


def test_parentheses_equal_a_stack():
    rng = random.Random(1)
    for _ in range(150):
        bits, depth = [1], 1
        p = rng.choice([0.3, 0.5, 0.7])
        for _ in range(rng.choice([0, 1, 5, 50, 400, 3000])):
            up = rng.random() < p or depth == 1
            bits.append(int(up))
            depth += 1 if up else -1
        bits += [0] * depth
        close, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree = Parentheses(np.array(bits, np.uint8))
        assert tree.find_close(tree.opens).tolist() == [close[o] for o in tree.opens.tolist()]
        end, leaves = tree.subtrees()
        for o, e, n in zip(tree.opens.tolist(), end.tolist(), leaves.tolist(), strict=True):
            assert e == sum(bits[: close[o] + 1]) and n == sum(bits[j] and not bits[j + 1] for j in range(o, close[o]))
