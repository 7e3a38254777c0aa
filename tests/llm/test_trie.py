"""The conversation trie against one that is spelled out in dictionaries."""

import hashlib
import math
import random
import zlib

import pytest
from tidegate.llm import trie


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [(r, x) for _, _, r, x in sorted(turns)] for conv, turns in own.items()}
    seqs = {}
    for conv, turns in own.items():
        head = zlib.crc32(str(conv).encode()) % 6
        seqs[conv] = tuple(own.get(conv - int(math.fmod(conv, 100)), [])[:head] + turns[head:])
    members, kids = {}, {}
    for conv, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(conv)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below)
        if node:
            saved[node] += (len(members[node]) - 1) * len(node[-1][1])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(seqs[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[node]), len(node), up, len(members[node]), len(below), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def check(spark, rows, slab=4096):
    turns = [(*row, "x", 1) for row in rows]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, seq string, range int")
    found = trie.trie(frame.repartition(5), slab)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def mixed():
    """Shared heads, ties, nulls, repeated rows, negative ids and one missing first conversation."""
    rng, rows = random.Random(1), []
    for conv in [*range(25), *range(100, 120), 250, 251, -7, -3, -107]:
        for turn in range(rng.choice([1, 2, 3, 4, 7, 9, 12])):
            kept = turn if rng.random() > 0.1 else rng.choice([None, 0])
            text = rng.choice(["ab", None, "", "dé\U0001f600"]) if rng.random() < 0.3 else "same"
            rows.append((conv, kept, rng.choice(["u", None]), text))
    return [*rows, (None, 1, "u", "x"), *rows[:5]]


@pytest.mark.parametrize(("slab", "per_range"), [(4096, 20_000), (4096, 6), (3, 20_000), (3, 5)])
def test_mixed_conversations(spark, monkeypatch, slab, per_range):
    monkeypatch.setattr(trie, "ROWS_PER_RANGE", per_range)
    monkeypatch.setattr(trie, "TURNS_PER_RANGE", 10 * per_range)
    check(spark, mixed(), slab)


@pytest.mark.parametrize(("slab", "per_range"), [(4096, 9), (4, 40)])
def test_hot_copies_and_one_long_conversation(spark, monkeypatch, slab, per_range):
    monkeypatch.setattr(trie, "ROWS_PER_RANGE", per_range)
    monkeypatch.setattr(trie, "TURNS_PER_RANGE", 60)
    monkeypatch.setattr(trie, "IDS_PER_PIECE", 4)
    rows = [(c, t, "u", "same" * (t % 3)) for c in range(150) for t in range(6)]
    rows += [(c, t, "u", f"x{t % 5 if c != 1 else t}") for c in (0, 1, 100, 101, 207) for t in range(100, 125)]
    check(spark, rows, slab)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")], [(1, None, None, None)], [(7, 0, "u", "a"), (100, 0, "u", "a")]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_common_turns():
    a, b, c = b"a" * 16, b"b" * 16, b"ab" * 8
    assert trie.common_turns(a + b, a + c) == 1
    assert trie.common_turns(a + b, a + b + c) == 2
    assert trie.common_turns(b"", a) == 0
    assert trie.common_turns(c, a) == 0
