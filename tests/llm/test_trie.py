"""Conversation prefix trie against a version by plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierline.llm import trie


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_bytes = len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * own_bytes + sum(saved[x] for x in children[node])
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(node)).encode()).hexdigest())
                  for node, m in members.items())


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, p0 string")
    turns, convs = trie.spliced(trie.placed(df.repartition(3)), lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, 8)
    out = trie.trie(turns, convs)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out.collect())


def sample(seed, convs=60):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 else rng.choice(["é", "b", "cc"])))
    same = [("user", "hot"), ("assistant", "copy"), ("user", "é" * 30)] * 4
    for c in range(1000, 1040):
        rows += [(c, t, *x) for t, x in enumerate(same)]
    long = [(2001, t, "user", f"t{t % 7}") for t in range(90)]
    rows += long + [(2002, t, r, x) for _, t, r, x in long[:60]]
    # nulls, ties, repeated rows, a missing base
    rows += [(None, 0, "user", "gone"), (3003, None, None, None), (3003, 1, "b", "x"), (3003, 1, "a", "y"), (3003, 1, "a", "y"),
             (3004, 5, "a", ""), (3005, None, "user", "n"), (3005, None, "user", "n")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("light,chunk,ends", [(1024, 4096, 4096), (40, 4, 3), (6, 7, 1), (1, 1, 16)])
def test_equals_plain_loops(spark, monkeypatch, light, chunk, ends):
    """With all nodes in shards, and with subtrees, conversations and lists of
    ends cut up."""
    for name, value in (("LIGHT_ROWS", light), ("SHARD_ROWS", light), ("CHUNK", chunk), ("ENDS", ends)):
        monkeypatch.setattr(trie, name, value)
    rows = sample(light)
    assert found(spark, rows) == brute(rows)


def test_nothing_and_turnless(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []
    alone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(alone, 0, "a", "b")]                     # its head is absent, its own turn is replaced
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_long_texts(spark):
    rows = [(c, t, "user", "long " * 200_000 + str(t)) for c in (5, 6) for t in range(10)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_gives_each_key_its_slot(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
    table = trie.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))


def test_slots_tell_digests_with_one_key_apart(monkeypatch):
    digests = np.array([[1, 2, 3], [4, 5, 6], [1, 2, 3]])
    real = trie.NodeTable._keys
    monkeypatch.setattr(trie.NodeTable, "_keys", lambda self, d: real(self, d) * np.uint64(self.seed > 1))     # two seeds that collide
    table = trie.NodeTable(digests)
    assert table.seed == 2 and table.slot_of_rows[0] == table.slot_of_rows[2] != table.slot_of_rows[1]
    with pytest.raises(RuntimeError):
        table.slots(np.array([[7, 8, 9]]))
