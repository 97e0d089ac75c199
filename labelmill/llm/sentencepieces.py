"""SentencePiece encoding and decoding by a batched numpy Viterbi over equal-length words.

The model is of the merging kind, so the best path is the one its merges give. A list of pieces
is what merging gives exactly if each two neighbours, merged alone, stay these two pieces. That
makes the score of a step local: 1 if the piece before and the piece fit, else nothing. All
distinct words of one length advance together, position by position: substring hashes probe the
sorted hashes of the pieces, the longest that fits is the maximum (one fits at most), and a
backpointer keeps it. Whether two pieces fit is worked out once per pair and remembered.

Words start where a blank follows something else, and are cut once more where no piece has the
two characters side by side; no piece reaches across. Characters without a
piece become their bytes. Cases: a null or empty text has no ids and decodes to an empty text;
the sign that stands for a blank decodes to a blank, as in the library; repeated rows are
encoded each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelmill.llm.arrays import chunks, mix, range_hashes, rolling_hashes, select_text
from labelmill.llm.word_cache import WordCache

BLANK = "▁"
WORDS_A_BLOCK = 4096
CHARACTERS_A_BLOCK = 1 << 17
#: Distinct words, their parts, and pairs of pieces that a worker keeps in each of two generations.
WORDS = 250_000
PAIRS = 400_000
#: Text bytes encoded and decoded at once.
ROUND_TRIP_BYTES = 1 << 20
NO_TOKEN = np.iinfo(np.int64).min
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def as_bytes(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class Pieces:
    """A merging SentencePiece model read for the Viterbi: sorted piece hashes and the fit of pairs."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
        self.ids = {p: i for i, p, _ in normal}
        self.scores = {p: s for _, p, s in normal}
        self.text = [p.piece for p in model.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.longest = max(len(p) for p in self.ids)
        self.by_length = {}
        for n in range(1, self.longest + 1):
            same = [(p, i) for p, i in self.ids.items() if len(p) == n]
            if same:
                hashes = self.hashes("".join(p for p, _ in same), n)
                order = np.argsort(hashes)
                self.by_length[n] = hashes[order], np.array([i for _, i in same], np.int64)[order]
        alone = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
        self.characters, self.character_ids = np.array(alone, np.int64).T
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        self.adjacent = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in pairs], np.int64))
        self.fits = WordCache(self.fit_pairs, PAIRS)
        self.cache, self.parts = WordCache(self.encode_words, WORDS), WordCache(self.encode_parts, WORDS)
        self.bytes_of = [BLANK.encode() if p is None else p.replace(BLANK, " ").encode() for p in self.text]
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        for i, p in enumerate(model.pieces):
            if p.type == p.CONTROL:
                self.bytes_of[i] = b""
        self.byte_sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_first = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    @staticmethod
    def hashes(words: str, n: int) -> np.ndarray:
        """Hash of each of the words of ``n`` characters that stand one after another."""
        codes = np.frombuffer(words.encode("utf-32-le"), "<u4")
        starts = np.arange(0, len(codes), n)
        return range_hashes(codes, starts, starts + n)

    def spelling(self, token: int) -> str:
        """Text of a token of the Viterbi: a piece, or a character without one (negative)."""
        return self.text[token] if token >= 0 else chr(-2 - token)

    def stays(self, left: str, right: str) -> bool:
        """Whether merging both texts as one, best score first and leftmost among equals, ends with these two."""
        parts, score, edge = [*left, *right], self.scores.get, len(left)
        none = -np.inf
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            if i == edge - 1:
                return False
            if i < edge:
                edge -= 1
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
        return len(parts) == (2 if left else 1)

    def fit_pairs(self, keys: list[int]) -> list[bool]:
        out = []
        for key in keys:
            before, token = (key >> 22) - (1 << 21), (key & ((1 << 22) - 1)) - (1 << 21)
            left = "" if before == -1 else self.spelling(before)
            out.append(self.stays(left, self.spelling(token)))
        return out

    def fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = (before + (1 << 21)) << 22 | (token + (1 << 21))
        distinct, back = np.unique(keys, return_inverse=True)
        distinct = distinct.tolist()
        self.fits.fill(distinct)
        return np.fromiter(map(self.fits.__getitem__, distinct), bool, len(distinct))[back]

    def steps(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(end, row, length, piece) of every piece of two characters or more in the words, by end and length."""
        n, length = codes.shape
        flat, found = codes.reshape(-1), []
        for size, (hashes, ids) in self.by_length.items():
            if 1 < size <= length:
                probe = mix(rolling_hashes(flat, size, 0) + np.uint64(size))  # the hash of ``range_hashes``
                at = np.minimum(np.searchsorted(hashes, probe), len(hashes) - 1)
                place = np.flatnonzero(hashes[at] == probe)
                place, at = place[inside := place % length <= length - size], at[place][inside]
                found.append((place % length + size, place // length, np.full(len(place), size), ids[at]))
        if not found:
            return tuple(np.zeros((4, 0), np.int64))
        ends, rows, sizes, tokens = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(ends, kind="stable")
        return ends[order], rows[order], sizes[order], tokens[order]

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as uint32 bytes."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64).reshape(n, length)
        ends, rows, sizes, tokens = self.steps(codes)
        last = np.full((n, length + 1), -1, np.int64)  # the piece that ends at a position
        back = np.ones((n, length + 1), np.int64)  # its length
        back[:, 0] = 0
        single = np.searchsorted(self.characters, codes)
        single = np.minimum(single, len(self.characters) - 1)
        last[:, 1:] = np.where(self.characters[single] == codes, self.character_ids[single], -2 - codes)
        bounds = np.searchsorted(ends, np.arange(1, length + 2)).tolist()
        for end, (lo, hi) in enumerate(zip(bounds, bounds[1:]), start=1):
            if lo == hi:
                continue
            row, size, token = rows[lo:hi], sizes[lo:hi], tokens[lo:hi]
            fits = self.fit(last[row, end - size], token)
            row, size = row[fits], size[fits]  # exactly one step fits, so where no longer one does it is the character
            last[row, end], back[row, end] = token[fits], size
        ends, steps = np.full(n, length), []
        while (ends > 0).any():
            here = np.arange(n), ends
            steps.append(np.where(ends > 0, last[here], NO_TOKEN))
            ends = ends - back[here]
        path = np.array(steps[::-1]).T
        sizes = (path != NO_TOKEN).sum(axis=1)
        found = as_bytes(path[path != NO_TOKEN], sizes)
        for i in np.flatnonzero((path < 0).any(axis=1) & ((path < 0) & (path != NO_TOKEN)).any(axis=1)).tolist():
            found[i] = self.with_bytes(path[i][path[i] != NO_TOKEN].tolist())
        return found

    def with_bytes(self, tokens: list[int]) -> bytes:
        """Ids where characters without a piece are their bytes."""
        ids = [i for t in tokens for i in ([t] if t >= 0 else map(self.byte_ids.get, chr(-2 - t).encode()))]
        return np.array(ids, "<u4").tobytes()

    def cut(self, words: list[str]) -> list[list[str]]:
        """Each word cut where no piece of the vocabulary has the two characters side by side."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        keys = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.adjacent, keys), len(self.adjacent) - 1)
        cuts = np.flatnonzero(self.adjacent[at] != keys) + 1
        ends = np.cumsum([len(w) for w in words])
        bounds = np.union1d(cuts, ends)
        text, bounds = "".join(words), bounds.tolist()
        parts = [text[a:b] for a, b in zip([0, *bounds], bounds)]
        stops = (np.searchsorted(bounds, ends) + 1).tolist()
        return [parts[a:b] for a, b in zip([0, *stops], stops)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        by_length: dict[int, list[str]] = {}
        for p in parts:
            by_length.setdefault(len(p), []).append(p)
        found = {}
        for same in by_length.values():
            step = max(1, min(WORDS_A_BLOCK, CHARACTERS_A_BLOCK // len(same[0])))
            for lo in range(0, len(same), step):
                block = same[lo : lo + step]
                found.update(zip(block, self.viterbi(block)))
        return [found[p] for p in parts]

    def encode_words(self, words: list[str]) -> list[bytes]:
        parts = self.cut(words)
        self.parts.fill(chain.from_iterable(parts))
        return [b"".join(map(self.parts.__getitem__, ps)) for ps in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [_WORD.findall((BLANK + t).replace(" ", BLANK)) if t else [] for t in texts]
        self.cache.fill(chain.from_iterable(words))
        return [b"".join(map(self.cache.__getitem__, ws)) for ws in words]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of lists of ids that stand one after another."""
        n = self.byte_sizes[ids]
        ends = np.cumsum(n)
        raw = self.byte_pool[np.repeat(self.byte_first[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        bounds = np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist()
        return [raw[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids): ``ids`` is an array of piece ids, ``text`` the text they were made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for part in chunks(batches):
            ids = model.encode(part.column("text").to_pylist())
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": part.column("doc_id"), "text": part.column("text"), "ids": lists}
            )

    return select_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, text, ids) with the text its ``ids`` stand for as ``decoded``; null ids give ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for part in batches:
            ids = part.column("ids")
            ends, flat = np.asarray(ids.offsets), np.asarray(ids.values)
            texts = model.decode(flat[ends[0] : ends[-1]], np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"]
            )

    columns = encoded.select("doc_id", "text", "ids")
    return columns.mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded, round_trip): both in the same worker; the text itself does not travel back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for part in chunks(batches, ROUND_TRIP_BYTES):
            texts = part.column("text").to_pylist()
            ids = model.encode(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            decoded = model.decode(flat, sizes)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat)),
                    "decoded": pa.array(decoded, pa.string()),
                    "round_trip": pa.array([a == b for a, b in zip(decoded, texts)], pa.bool_()),
                }
            )

    return select_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string, round_trip boolean")
