"""The prefix trie against a dictionary of prefixes, and the roll-up against plain recursion."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from khata.llm import prefix_trie

from . import helpers as H

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in [*range(150), -7, -10, 1000, 10**12]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t, rng.choice(["user", "a", None]) if rng.random() < 0.2 else "u", rng.choice(["x", "yé", None, "z"])))
    same = [(c, t, "u", "same") for c in range(3000, 3030) for t in range(4)]
    return [*rows, *same, (7, None, "u", "n"), (None, 1, "u", "x"), *((2000, t, "u", "x") for t in range(60))]


def given(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}


def rebuilt(rows):
    turns = given(rows)
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = c % 5 if c >= 0 else -(-c % 5)
        out[c] = turns.get(c - rest, [])[:h] + own[h:]
    return out


def naive_trie(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    ends = {k: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k)) for k, m in members.items()}
    return H.ordered((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest())
                     for k, m in members.items())


@pytest.mark.parametrize("big", [2, 60, prefix_trie.BIG])
def test_rebuilt_conversations(spark, big):
    rows = conversations()
    data = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", depth int").repartition(5)
    got = prefix_trie.trie(*prefix_trie.branched(data), big=big)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert H.ordered(map(tuple, got.collect())) == naive_trie(rebuilt(rows))


def test_given_conversations_long_chunks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    monkeypatch.setattr(prefix_trie, "HOT", 3)
    rows = conversations(9)
    got = prefix_trie.trie(*prefix_trie.as_given(spark.createDataFrame(rows, SCHEMA)), big=100)
    assert H.ordered(map(tuple, got.collect())) == naive_trie(given(rows))


def test_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    ends = spark.createDataFrame([(i * 37 % 1009, i % 2, 5) for i in range(1000)], "conv_id long, depth long, name long").repartition(7)
    want = {(5, d): hashlib.sha256(",".join(str(c) for c in sorted(i * 37 % 1009 for i in range(d, 1000, 2))).encode()).hexdigest() for d in (0, 1)}
    assert {(r[0], r[1]): r[2] for r in prefix_trie._ends(ends).collect()} == want


def test_ties_nulls_and_repeated_rows(spark):
    """Equal turn numbers have one order, whatever the partitions; repeated rows are turns of their own."""
    rows = [(1, 1, "u", "a"), (1, 1, "u", "b"), (1, 1, "u", "b"), (1, None, None, None), (2, 1, "u", "b"), (2, 1, "u", "a"), (2, 1, "u", "b"), (2, None, "", "")]
    sets = [H.ordered(map(tuple, prefix_trie.trie(*prefix_trie.as_given(spark.createDataFrame(rows, SCHEMA).repartition(n))).collect())) for n in (1, 5)]
    assert sets[0] == sets[1] and max(r[1] for r in sets[0]) == 4 and len(sets[0]) == 5  # both conversations are one path


def test_no_conversations(spark):
    none = spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)
    assert prefix_trie.trie(*prefix_trie.branched(none)).collect() == []


@pytest.mark.parametrize("shape", ["path", "star", "random", "caterpillar"])
def test_roll_up(shape):
    rng, n = random.Random(3), 400
    above = {"path": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i), "caterpillar": lambda i: max(0, i - 1 - i % 2)}[shape]
    parent = np.array([0, *(above(i) for i in range(1, n))])
    weight, own = np.ones(n, np.int64), np.array([[rng.randrange(9), i] for i in range(n)])
    want, more = own.copy(), np.array([[i % 3, 0] for i in range(n)])
    for i in range(n - 1, 0, -1):
        weight[parent[i]] += weight[i]
        want[parent[i]] += want[i]
    assert np.array_equal(prefix_trie.roll_up(parent, weight, own, more.copy()), want + more)
