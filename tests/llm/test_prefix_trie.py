"""The prefix trie against a plain one, double arrays against dictionaries, odd and long conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from labelmill.llm import prefix_trie
from labelmill.llm.ship import ship
from tests.conftest import spark  # noqa: F401

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, seg int, bytes string, rank int"


@pytest.fixture
def table(spark):  # noqa: F811
    return lambda rows: ship(spark).createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)


def order(turn, role, text):
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    return turn is not None, turn or 0, role, digest


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((order(t, r or "", x or ""), (r or "", x or "")))
    own = {c: [turn for _, turn in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = (*own.get(c - c % 5, [])[:h], *v[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                children[v[: d - 1]].add(v[:d])
    below, out = {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in children[p]) if children[p] else 1
        saved = sum(below[k][1] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        below[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[p]), len(p), parent, len(members[p]), len(children[p]), leaves, saved, digest))
    return sorted(out)


def found(df, **knobs):
    return sorted(tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie_nodes(df, **knobs).collect())


@pytest.mark.parametrize("length", [64, 3])
def test_nodes_equal_a_plain_trie(table, length):
    rng = random.Random(3)
    rows = [
        (c, t if rng.random() < 0.9 else None, rng.choice(["u", "a", None]), rng.choice(["x", "yy", "", "é", None]))
        for c in range(60)
        for t in range(rng.randint(0, 12))
    ]
    rows += [(7, 3, "u", "dup")] * 5 + [(None, 1, "u", "x")]
    # long ones, on the same path for hundreds of turns
    rows += [(c, i, "u", "a" if c > 200 else rng.choice("ab")) for c, n in ((200, 300), (205, 200), (210, 210)) for i in range(n)]
    rng.shuffle(rows)
    assert found(table(rows).repartition(6), length=length) == brute(rows)


def test_copies_ends_and_turnless_conversations(table):
    rows = [(c, t, "u", f"t{t}") for c in range(0, 2000, 5) for t in range(2)]  # one long list of ends
    short = [c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 3][:40]
    lost = [(c, t, "u", "own") for c in short for t in range(2)]  # own turns all replaced by those of the base
    alone = next(c for c in range(100_001, 200_000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows += lost + [(alone, 0, "u", "z")]  # no base, and too short: only the root
    assert found(table(rows)) == brute(rows)


def test_empty_and_single(table):
    assert found(table([])) == []
    assert found(table([(None, 0, "u", "x")])) == []
    assert found(table([(4, 0, "u", "x")])) == brute([(4, 0, "u", "x")])


def test_double_array_holds_its_sequences():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 9, 400)
    first = np.cumsum(n) - n
    symbols = prefix_trie.dense(np.arange(n.sum()), rng.integers(0, 40, n.sum())) + 1
    root = np.sort(rng.integers(0, 3, 400))
    root = prefix_trie.dense(np.arange(400), root)
    trie = prefix_trie.DoubleArray(root, first, n, symbols)
    states = trie.walk(root, first, n, symbols)
    names = {}
    for i in range(400):
        for d in range(n[i]):
            prefix = (root[i], *symbols[first[i] : first[i] + d + 1].tolist())
            assert names.setdefault(prefix, states[first[i] + d]) == states[first[i] + d]
    assert len(set(names.values())) == len(names)
    used = np.flatnonzero(trie.check[: trie.end] >= 0)
    assert len(used) == len(names) + 3
