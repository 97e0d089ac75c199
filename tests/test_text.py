import unicodedata

import random

import pytest
from pyspark.sql import functions as F

from labelmill.functions import text as tx
from labelmill.operators import piece_trie
from labelmill.operators import subwords as sub
from labelmill.operators import tokens
from labelmill.scratch import materialize
from tests.conftest import values


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("o")).first()["o"]


def test_strip_and_words(spark):
    assert one(spark, "\t   Hi there\x0b\r\n", tx.strip) == "Hi there"
    assert one(spark, "Don't STOP: 50% Öffnung_x!", tx.words) == ["don", "t", "stop", "50", "öffnung", "x"]
    assert one(spark, "a $5!", tx.words_and_marks) == ["a", "$", "5", "!"]
    assert one(spark, " .. ", tx.words) == []


@pytest.mark.parametrize("pct, full", [(37.4, 7), (100.0, 20), (0.0, 0), (4.99, 0), (5.0, 1)])
def test_bar(spark, pct, full):
    assert one(spark, pct, tx.bar, "double") == "█" * full + "░" * (20 - full)


def test_number_formats(spark):
    assert one(spark, 0.952712, lambda c: tx.fixed(c, 4), "double") == "0.9527"
    line = spark.range(1).select(tx.class_line(F.lit("normal"), F.lit(37.4)).alias("l")).first()["l"]
    assert line == "normal          " + "█" * 7 + "░" * 13 + "  37.40%"


def test_cut(spark):
    assert one(spark, "x" * 120, tx.cut) == "x" * 120
    assert one(spark, "x" * 121, tx.cut) == "x" * 120 + "..."


def test_vocabulary_counts_and_dense_ids(spark, make):
    rng = random.Random(1)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(40)) for _ in range(200)]
    stats = {}
    for t in texts:
        for w in t.split():
            stats.setdefault(w, [0, 0])[0] += 1
        for w in set(t.split()):
            stats[w][1] += 1
    kept = sorted((w for w in stats if stats[w][1] >= 2), key=lambda w: (-stats[w][0], w))
    want = [(w, *stats[w], i) for i, w in enumerate(kept, start=4)]
    got = values(tokens.vocabulary(make([(t, "x") for t in texts]), min_df=2).orderBy("token_id"), "token", "n", "doc_freq", "token_id")
    assert got == want


def test_encode_truncate_pad_mask(spark, make):
    df = make([("Good good price", "x"), ("", "x"), (" ".join(["good"] * 70), "y"), ("nothing known", "y")])
    vocab = spark.createDataFrame([("good", 4), ("price", 5)], "token string, token_id int")
    whole = tokens.encode_ids(df, vocab, keep=["label"])
    assert {r["id"]: r["input_ids"] for r in whole.collect()} == {
        0: [2, 4, 4, 5, 3], 1: [2, 3], 2: [2] + [4] * 70 + [3], 3: [2, 1, 1, 3],
    }
    cut = materialize(tokens.encode_ids(df, vocab, max_length=64))
    padded = {r["id"]: r for r in tokens.pad_and_mask(cut, max_length=64).collect()}
    assert padded[2]["input_ids"] == [2] + [4] * 62 + [3]
    assert sum(padded[2]["attention_mask"]) == 64
    assert padded[0]["input_ids"] == [2, 4, 4, 5, 3] + [0] * 59
    assert padded[0]["attention_mask"] == [1] * 5 + [0] * 59


def test_padding_goes_to_the_longest_row_only(spark):
    df = spark.createDataFrame([(1, [2, 9, 3]), (2, [2, 3])], "id int, input_ids array<int>")
    got = {r["id"]: (r["input_ids"], r["attention_mask"]) for r in tokens.pad_and_mask(df).collect()}
    assert got == {1: ([2, 9, 3], [1, 1, 1]), 2: ([2, 3, 0], [1, 1, 0])}
    folds = spark.createDataFrame([(1, [2, 9, 3], "a"), (2, [2, 3], "b"), (3, [2], None)], "id int, input_ids array<int>, fold string")
    got = {r["id"]: r["input_ids"] for r in tokens.pad_and_mask(folds, by="fold").collect()}
    assert got == {1: [2, 9, 3], 2: [2, 3], 3: [2]}
    assert tokens.pad_and_mask(folds.limit(0)).columns == ["id", "input_ids", "fold", "attention_mask"]


def greedy(word, vocab):
    out, at = [], 0
    while at < len(word):
        ends = [e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab]
        if not ends:
            return ["[UNK]"]
        out.append(("##" if at else "") + word[at : ends[0]])
        at = ends[0]
    return out


@pytest.mark.parametrize("max_letters", [piece_trie.MAX_LETTERS, 0])
def test_subwords_against_brute_force(spark, make, monkeypatch, max_letters):
    """By the trie, and by the joins that stand in for it beyond its bound."""
    monkeypatch.setattr(piece_trie, "MAX_LETTERS", max_letters)
    rng = random.Random(7)
    pieces = ["un", "aff", "##aff", "##able", "##a", "##ab", "##le", "a", "b", "##b", "ab", "##ba", "é", "##é"]
    vocab = spark.createDataFrame([(p, i) for i, p in enumerate(pieces, start=4)], "piece string, token_id int")
    words = ["unaffable", "unable", "é", "bé", "abba", "a" * 101, "zz", "a" + "b" * 99]
    words += ["".join(rng.choice("abelfunzé") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    ids = {p: i for i, p in enumerate(pieces, start=4)} | {"[UNK]": 1}
    want = {i: [ids[p] for w in t.split() for p in greedy(w, ids)] for i, t in enumerate(texts)}
    got = sub.subwords(make([(t, "x") for t in texts]), vocab)
    assert {r["id"]: r["input_ids"] for r in got.collect()} == want

    distinct = spark.createDataFrame([(w,) for w in set(words)], "word string")
    spelled = {r["word"]: (r["pieces"], r["piece_ids"]) for r in sub.segment_words(distinct, vocab).collect()}
    by_hand = {w: greedy(w, ids) for w in words}
    assert spelled == {w: (p, [ids[x] for x in p]) for w, p in by_hand.items() if p != ["[UNK]"]}
    short = {r["word"] for r in sub.segment_words(distinct, vocab, max_word_chars=100).collect()}
    assert short == {w for w in spelled if len(w) <= 100} and short < set(spelled)


def test_folding_by_pieces_keeps_blanks_and_ascii(spark):
    texts = ["  a  é ", "e\u0301 b", "", " ", "가 x가", "\u0301 \u0301", "tab\té\n é"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r[0] for r in rows.select(tx.fold_marks(F.col("t"))).collect()]
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    assert got == [*map(fold, texts), None]
