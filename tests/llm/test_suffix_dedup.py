"""Suffix intervals against counted windows; whole removal against a plain version; odd, long and hot texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from labelmill.llm import suffix_dedup
from tests.conftest import spark  # noqa: F401


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def found(df, **knobs):
    rows = suffix_dedup.remove_repeats(df, keep=True, **knobs).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in rows}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)

    def made(n):
        return "".join(rng.choice("abcdé \n\x00日") for _ in range(n))

    shared = [made(n) for n in (90, 60, 41, 40, 39, 25)]
    out = [None, "", "a", made(39), made(40), "ab" * 70, "z" * 500, shared[0], shared[0]]
    for i in range(60):
        out.append(made(rng.randint(0, 60)) + rng.choice(shared) + made(rng.randint(0, 60)) + rng.choice(["", rng.choice(shared)]))
    edited = made(300)
    out += [edited, edited[:150] + "#" + edited[150:], edited[:30] + edited[60:], edited[20:280]]
    out += [shared[0] + made(rng.randint(5, 30)) for _ in range(80)]  # many unlike edges of one passage
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_removal_equals_brute_force(docs, texts, monkeypatch, shard_bytes):
    """With a small bound the stretches of common anchors are broken into windows; results stay."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
    got = found(docs(texts).repartition(4), length=40, gram=12)
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_long_texts_are_screened_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) + passage + "tail" for n in (5000, 3, 2500)]
    lo, hi = texts[0][3990:4405], "x" * 700 + texts[0][3990:4405]
    texts += [lo, hi]
    got = found(docs(texts))
    assert [got[i] for i in range(len(texts))] == brute(texts, 400)


def test_repeated_ids_and_empty(docs):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(450))
    rows = suffix_dedup.remove_repeats(docs([t, t, t[:399], None], ids=[5, 5, 5, 6])).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in rows) == [(5, 399, 0), (5, 450, 450), (5, 450, 450), (6, 0, 0)]
    assert suffix_dedup.remove_repeats(docs([])).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_intervals_equal_counted_windows(seed):
    rng = random.Random(seed)
    length = rng.choice([1, 2, 3, 5, 8])
    pieces = list({bytes(rng.choice(b"ab\x00c"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))): 0 for _ in range(12)})
    weights = np.array([rng.randint(1, 3) for _ in pieces])
    seen = Counter()
    for p, w in zip(pieces, weights.tolist()):
        for i in range(len(p) - length + 1):
            seen[p[i : i + length]] += w
    want = [len(p) - i >= length and seen[p[i : i + length]] > 1 for p in pieces for i in range(len(p))]
    offsets = np.append(0, np.cumsum([len(p) for p in pieces]))
    got = suffix_dedup.repeated_windows(np.frombuffer(b"".join(pieces), np.uint8), offsets, weights, length)
    assert got.tolist() == want
    of, first, last = suffix_dedup.runs(got, offsets)
    back = np.zeros(len(got), bool)
    for k, a, b in zip(of, first, last):
        back[offsets[k] + a : offsets[k] + b + 1] = True
    assert (back == got).all()


def test_suffixes_are_sorted_and_common_prefixes_found():
    pieces = [b"banana", b"ananas", b"nan", b"", b"banana\x00b"]
    symbols = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, 0) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in pieces])
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    rest = ends[piece] - np.arange(len(symbols))
    order = suffix_dedup.sort_suffixes(symbols, rest, piece)
    suffixes = [(symbols[i : i + rest[i]].tolist(), piece[i]) for i in order]
    assert suffixes == sorted(suffixes)
    common = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in zip(suffixes, suffixes[1:])]
    for length in range(1, 8):
        assert suffix_dedup.divided(symbols, order, length).tolist() == [c < length for c in common]
