"""Token counts by byte-level BPE, merged rank by rank in numpy arrays over whole batches.

Texts are cut into pre-tokens; the distinct ones of a batch lie in one flat array of symbols
with the index of the sequence each belongs to. In every round each sequence applies its
lowest-ranked pair at all of its places at once; sequences without a pair leave, and the
symbols they still have are their token count. Only the counts are kept.

Cases: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result;
repeated rows are counted each; other columns are not read. Special strings of the vocabulary
inside a text are one token each, as the library's default has it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from labelmill.llm.arrays import chunks, select_text
from labelmill.llm.word_cache import WordCache

MAX_TOKENS = 1024
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

# Unicode White_Space, the pre-token pattern of byte-level BPE.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: White space with the visible run after it. No pre-token reaches across its ends.
UNIT = f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"


def byte_letters() -> list[str]:
    """The visible letter by which the vocabulary writes each byte: itself, or the next one from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class ByteMerges:
    """Merge ranks of a vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pattern, self.unit = regex.compile(PRE_TOKEN), re.compile(UNIT)
        self.cache = WordCache(self.count_units)

    def merge(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        sizes = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        out = sizes.copy()
        none = len(self.ranks)
        symbols = self.first[np.frombuffer(b"".join(pre_tokens), np.uint8)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        while len(symbols) > 1:
            keys = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where((self.keys[at] == keys) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(heads, len(owner)))
            low = np.minimum.reduceat(rank, heads)
            lowest = np.repeat(low, lengths)
            hit = (rank == lowest) & (lowest < none)
            # of hits that touch (a pair of equal symbols), every second one counts from the left
            run = np.arange(len(hit))
            begin = hit & ~np.append(False, hit[:-1])
            hit &= (run - np.maximum.accumulate(np.where(begin, run, 0))) % 2 == 0
            symbols = np.where(hit, self.made[np.where(hit, rank, 0)], symbols)
            stay = ~np.append(False, hit[:-1]) & (lowest < none)
            out[owner[heads]] = np.add.reduceat((~np.append(False, hit[:-1])).astype(np.int64), heads)
            symbols, owner = symbols[stay], owner[stay]
        return out

    def count_units(self, units: list[str]) -> list[int]:
        parts = [self.pattern.findall(u) for u in units]
        distinct = list({p for ps in parts for p in ps})
        count = dict(zip(distinct, self.merge([p.encode() for p in distinct]).tolist())) if distinct else {}
        return [sum(map(count.__getitem__, ps)) for ps in parts]

    def count(self, texts: list[str]) -> list[int]:
        pieces, owner, totals = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special is not None else [text]
            totals[i] = len(parts) - 1
            for part in parts:
                pieces.append(self.unit.findall(part))
                owner.append(i)
        self.cache.fill(chain.from_iterable(pieces))
        for i, units in zip(owner, pieces):
            totals[i] += sum(map(self.cache.__getitem__, units))
        return totals


@lru_cache(maxsize=2)
def merges(path: str) -> ByteMerges:
    return ByteMerges(path)


def count_tokens(
    docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; ``path`` is a vocabulary file on every worker."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges(path)
        for part in chunks(batches):
            n_tokens = bpe.count(part.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": pc.binary_length(part.column("text")).cast(pa.int64()),
                    "n_tokens": pa.array(n_tokens, pa.int64()),
                    "over_limit": pa.array([n > max_tokens for n in n_tokens], pa.bool_()),
                }
            )

    return select_text(docs, id_col, text_col).mapInArrow(count, SCHEMA)
