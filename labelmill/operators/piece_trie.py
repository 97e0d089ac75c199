"""A vocabulary of word pieces as a trie with failure links, walked by built-in expressions.

Greedy longest match with one look at each letter (linear maximum matching). A state that has no edge
for the next letter emits the pieces that are certain by then and falls back to the state of the
letters they leave over. The trie is stored as a double array: the child of state s by letter
code c is BASE[s] + c, if CHECK there is s. Walking is one ``aggregate`` of at most two steps a
letter, in the JVM; the arrays are constants of the expression.

A vocabulary is a small artefact of a model, held on the driver; its size is checked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the continuation mark.
CONTINUATION = "##"
#: Letters of all pieces, and piece numbers emitted by all states, that a trie may hold.
MAX_LETTERS = 1 << 21
MAX_EMITTED = 1 << 21
#: Free places tried for the children of a state before the end of the array is taken.
TRIES = 16
#: Steps of a walk between which the pieces found are put away.
RUN = 128

START, INSIDE, NONE = 0, 1, -1


@dataclass(frozen=True)
class PieceTrie:
    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    codes: list[int]  # letter code by code point, 0 for letters of no piece
    base: list[int]
    check: list[int]
    fail: list[int]
    emits: list[str]  # piece numbers, a comma after each

    def walk(self, words: Column) -> Column:
        """For each of ``words`` (an array): the numbers of its pieces, each with a comma after it; null if it cannot be spelled."""
        codes, base, check, fail = (_constant(x) for x in (self.codes, self.base, self.check, self.fail))
        emits = F.split(F.lit(";".join(self.emits)), ";")

        def coded(word: Column) -> Column:
            return F.transform(F.split(word, ""), lambda c: F.coalesce(F.get(codes, F.ascii(c)), F.lit(0)))

        def state(pos: Column, at: Column, out: Column) -> Column:
            return F.struct(pos.alias("pos"), at.alias("at"), out.alias("out"))

        def spelled(letters: Column) -> Column:
            size = F.size(letters)

            def step(acc: Column, _: Column) -> Column:
                pos, at, out = (acc[c] for c in ("pos", "at", "out"))
                child = F.get(base, at) + F.get(letters, pos)
                return (
                    F.when(F.get(check, child) == at, state(pos + 1, child, out))
                    .when((at < 0) | ((at == INSIDE) & (pos == size)), acc)
                    .otherwise(state(pos, F.get(fail, at), F.concat(out, F.get(emits, at))))
                )

            # Spark copies what an aggregate carries at each step, so the pieces of a long word are
            # carried by the outer one, which takes one step where the inner one takes RUN
            def run(acc: Column, k: Column) -> Column:
                steps = F.sequence(F.lit(1), F.least(F.lit(RUN), size * 2 + 1 - k * RUN))
                done = lambda a: state(a["pos"], a["at"], F.concat(acc["out"], a["out"]))
                return F.aggregate(steps, state(acc["pos"], acc["at"], F.lit("")), step, done)

            begin = state(F.lit(0), F.lit(START), F.lit(""))
            end = lambda a: F.when((a["at"] == INSIDE) & (a["pos"] == size), a["out"])
            return F.aggregate(F.sequence(F.lit(0), F.floor(size * 2 / RUN).cast("int")), begin, run, end)

        return F.transform(F.transform(words, coded), spelled)

    def numbers(self, spelled: Column) -> Column:
        """Piece numbers of one word of :meth:`walk`."""
        return F.split(F.rtrim(spelled, F.lit(",")), ",").cast("array<int>")

    def piece_ids(self, spelled: Column) -> Column:
        ids = _constant(self.ids)
        return F.transform(self.numbers(spelled), lambda k: F.get(ids, k))

    def piece_texts(self, spelled: Column) -> Column:
        texts = F.split(F.lit("\x00".join(self.pieces)), "\x00")
        return F.transform(self.numbers(spelled), lambda k: F.get(texts, k))


def _constant(numbers: Sequence[int]) -> Column:
    """An array constant; one text is quicker to plan than as many literals."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def collect_trie(vocab: DataFrame) -> PieceTrie | None:
    """The trie of ``vocab(piece, token_id)``, or None if it is beyond the bounds."""
    letters = vocab.agg(F.sum(F.length("piece"))).first()[0] or 0
    if letters > MAX_LETTERS:
        return None
    rows = sorted((r["piece"], r["token_id"]) for r in vocab.select("piece", "token_id").collect() if r["piece"])
    return build(rows)


def build(pieces: Sequence[tuple[str, int]]) -> PieceTrie | None:
    """Trie of (piece, id) pairs; None if its states would emit more than ``MAX_EMITTED`` numbers."""
    alphabet = {c: i for i, c in enumerate(sorted({c for p, _ in pieces for c in p}), start=1)}
    children: list[dict[int, int]] = [{}, {}]
    piece_at: dict[int, int] = {}
    for number, (piece, _) in enumerate(pieces):
        inside = piece.startswith(CONTINUATION) and len(piece) > len(CONTINUATION)
        at = INSIDE if inside else START
        for c in piece[len(CONTINUATION) :] if inside else piece:
            code = alphabet[c]
            if code not in children[at]:
                children[at][code] = len(children)
                children.append({})
            at = children[at][code]
        piece_at.setdefault(at, number)

    fail, emits = [NONE] * len(children), [[] for _ in children]
    order, emitted = [START, INSIDE], 0
    for at in order:  # by depth, since children are appended
        for code, child in children[at].items():
            order.append(child)
            if child in piece_at:
                fail[child], emits[child] = INSIDE, [piece_at[child]]
            else:
                back, out = fail[at], emits[at]
                while back != NONE and code not in children[back]:
                    out, back = out + emits[back], fail[back]
                if back != NONE:
                    fail[child], emits[child] = children[back][code], out
            emitted += len(emits[child])
            if emitted > MAX_EMITTED:
                return None
    place, base, check = _pack(children, order)

    def moved(at: int) -> int:
        return at if at < 0 else place[at]

    size = len(check)
    fail_, emits_ = [NONE] * size, [""] * size
    for at in order:
        fail_[place[at]], emits_[place[at]] = moved(fail[at]), "".join(f"{k}," for k in emits[at])
    codes = [0] * (max(map(ord, alphabet), default=0) + 1)
    for c, code in alphabet.items():
        codes[ord(c)] = code
    return PieceTrie(tuple(p for p, _ in pieces), tuple(i for _, i in pieces), codes, base, check, fail_, emits_)


def _pack(children: list[dict[int, int]], order: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(place of each state, BASE, CHECK): the children of a state stand at BASE + code; the roots stay at 0 and 1."""
    place, base, check = [0] * len(children), [0, 0], [-2, -2]
    place[INSIDE] = INSIDE
    first_free = 2
    for at in order:
        codes = sorted(children[at])
        if not codes:
            continue
        spread = [c - codes[0] for c in codes]
        tries, spot = 0, first_free
        while spot < len(check) and tries < TRIES:
            if check[spot] == -1 and all(spot + d >= len(check) or check[spot + d] == -1 for d in spread):
                break
            tries += check[spot] == -1
            spot += 1
        else:
            spot = len(check)
        more = spot + spread[-1] + 1 - len(check)
        if more > 0:
            check += [-1] * more
            base += [0] * more
        base[place[at]] = spot - codes[0]
        for c, d in zip(codes, spread):
            check[spot + d] = place[at]
            place[children[at][c]] = spot + d
        while first_free < len(check) and check[first_free] != -1:
            first_free += 1
    return place, base, check
