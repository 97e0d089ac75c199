"""Words looked up in texts, most of them near, all of them, or none."""

import random

import pytest
from pyspark.sql import functions as F

from labelmill.operators import subwords, tokens, word_lookup
from labelmill.scratch import materialize


@pytest.mark.parametrize("near_words", [1 << 19, 40, 1])
def test_rare_words_are_put_back_in_their_places(spark, monkeypatch, near_words):
    monkeypatch.setattr(word_lookup, "SLICE_WORDS", 50)
    rng = random.Random(3)
    ids = {f"w{i}": [10 * i + k for k in range(i % 4)] for i in range(90)} | {"é" * 70: [7, 8]}
    names = [*ids, "unknown", "other"]
    texts = [[rng.choice(names) for _ in range(rng.choice([0, 1, 5, 120]))] for _ in range(60)] + [None, [], ["é" * 70] * 3]
    df = spark.createDataFrame([(i // 2, t, f"kept {i}") for i, t in enumerate(texts)], "id int, w array<string>, k string")
    known = spark.createDataFrame([(w, n, x) for n, (w, x) in enumerate(ids.items())], "word string, n int, ids array<int>")
    got = word_lookup.with_word_ids(df, "w", materialize(known), -F.col("n"), 1, "ids", near_words).collect()
    want = [(i // 2, f"kept {i}", [x for w in t or [] for x in ids.get(w, [1])]) for i, t in enumerate(texts)]
    assert sorted((r["id"], r["k"], r["ids"]) for r in got) == sorted(want)


def test_no_word_of_a_small_vocabulary_is_shuffled(spark):
    """Nothing but the written files moves: the plan of the looked-up texts has no exchange and no sort."""
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string")
    vocab = materialize(spark.createDataFrame([("a", 4), ("b", 5)], "token string, token_id int"))
    encoded = tokens.encode_ids(df, vocab)
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Generate" not in plan
    assert sorted((r["id"], r["input_ids"]) for r in encoded.collect()) == [(1, [2, 4, 5, 4, 3]), (2, [2, 3])]


def test_no_word_of_a_text_is_shuffled_for_its_pieces(spark):
    df = spark.createDataFrame([(1, "ab a abx"), (1, "b"), (2, None)], "id int, text string")
    vocab = materialize(spark.createDataFrame([("a", 4), ("##b", 5)], "piece string, token_id int"))
    found = subwords.subwords(df, vocab)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Generate" not in plan
    assert sorted((r["id"], r["input_ids"]) for r in found.collect()) == [(1, [1]), (1, [4, 5, 4, 1]), (2, [])]
