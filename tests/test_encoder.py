import random
import sys
import unicodedata

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from labelmill.functions.text import _folding, fold_marks
from labelmill.operators import piece_trie
from labelmill.operators.encoder import SubwordEncoder, SubwordEncoderModel, encoder
from labelmill.sources.vocabulary import numbered_lines, read_vocabulary, write_vocabulary
from tests.conftest import values
from tests.test_text import greedy

LINES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "a", "##b", "", "ab", "$", "!", "é", "e"]


def walk(trie, word):
    """The expression's rule in plain Python."""
    pos, at, out = 0, piece_trie.START, []
    while pos < len(word) or at != piece_trie.INSIDE:
        code = trie.codes[ord(word[pos])] if pos < len(word) and ord(word[pos]) < len(trie.codes) else 0
        child = trie.base[at] + code
        if pos < len(word) and child < len(trie.check) and trie.check[child] == at:
            pos, at = pos + 1, child
        elif trie.fail[at] < 0:
            return ["[UNK]"]
        else:
            out += [int(k) for k in trie.emits[at].split(",") if k]
            at = trie.fail[at]
    return [trie.pieces[k] for k in out]


def test_trie_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(400):
        letters = "abcé"[: rng.randint(1, 4)]
        pieces = {
            ("##" if rng.random() < 0.6 else "") + "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
            for _ in range(rng.randint(1, 14))
        }
        trie = piece_trie.build(sorted((p, i) for i, p in enumerate(pieces)))
        for _ in range(20):
            word = "".join(rng.choice(letters + "z") for _ in range(rng.randint(1, 14)))
            assert walk(trie, word) == greedy(word, pieces)


def test_expression_equals_the_rule_and_long_words_are_walked_in_place(spark):
    rng = random.Random(2)
    pieces = ["a", "b", "ab", "##a", "##ba", "##b", "##abba", "abab", "##aaaa"]
    trie = piece_trie.build([(p, i) for i, p in enumerate(pieces)])
    words = ["".join(rng.choice("abz") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    words += ["ab" * 200, "a" * 127, "a" * 128, "a" * 129]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = df.select("word", trie.walk(F.array("word"))[0].alias("s")).select("word", trie.piece_texts(F.col("s")).alias("p"))
    for word, found in values(got):
        assert (found or ["[UNK]"]) == greedy(word, pieces)
    long_word = spark.createDataFrame([("ab" * 50_000,)], "word string").select(trie.walk(F.array("word"))[0].alias("s"))
    long_ids = long_word.select(trie.piece_ids(F.col("s")).alias("ids"))
    assert long_ids.count() == 1 and long_ids.select(F.size("ids")).first()[0] == len(walk(trie, "ab" * 50_000))


def test_too_large_a_vocabulary_is_told(monkeypatch):
    monkeypatch.setattr(piece_trie, "MAX_EMITTED", 3)
    assert piece_trie.build([("abcd", 0), ("##e", 1), ("a", 2), ("##b", 3)]) is None
    with pytest.raises(ValueError):
        SubwordEncoderModel([("abcd", 4), ("##e", 5), ("a", 6), ("##b", 7)]).trie


@pytest.fixture
def vocabulary(spark, tmp_path):
    path = tmp_path / "vocabulary.txt"
    path.write_bytes("\n".join(LINES).encode())
    return str(path)


TEXTS = ["Unaffable $5!", None, "", "ab " * 100, "Éab unaffb", "unaffable " * 30, "x"]


def expected(text, length, pad=True):
    ids = {p: i for i, p in enumerate(LINES) if p}
    tokens = "".join(c if c.isalnum() else f" {c} " for c in (text or "").lower()).split()
    found = [ids[p] for t in tokens for p in greedy(t, ids)][: length - 2]
    row = [2, *found, 3]
    gap = length - len(row) if pad else 0
    return row + [0] * gap, [1] * len(row) + [0] * gap


def test_saved_stage_gives_equal_ids_in_batch_and_stream(spark, vocabulary, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    fitted = Pipeline(stages=[SubwordEncoder(vocabularyPath=vocabulary, maxLength=20)]).fit(df)
    want = {i: expected(t, 20) for i, t in enumerate(TEXTS)}
    assert {i: (a, b) for i, a, b in values(fitted.transform(df), "id", "input_ids", "attention_mask")} == want
    fitted.write().save(str(tmp_path / "pipeline"))
    loaded = PipelineModel.load(str(tmp_path / "pipeline"))
    assert loaded.stages[0].uid == fitted.stages[0].uid and loaded.stages[0].vocabulary == fitted.stages[0].vocabulary
    df.repartition(3).write.json(str(tmp_path / "in"))
    stream = loaded.transform(spark.readStream.schema("id int, text string").json(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {i: (a, b) for i, a, b in values(got, "id", "input_ids", "attention_mask")} == want


def test_stage_options(spark, vocabulary):
    df = spark.createDataFrame([("éab!",), ("unaffable a",)], "t string")
    table = read_vocabulary(spark, vocabulary)

    def ids(**params):
        return [r[0] for r in encoder(table, inputCol="t", padding=False, **params).transform(df).select("input_ids").collect()]

    assert ids() == [[2, 1, 12, 3], [2, 4, 5, 6, 7, 3]]
    assert ids(marks=False) == [[2, 1, 3], [2, 4, 5, 6, 7, 3]]
    assert ids(folding=True)[0] == [2, 1, 12, 3]  # "eab" has no piece "##a"
    assert ids(maxWordChars=5)[1] == [2, 1, 7, 3]
    assert ids(maxLength=4)[1] == [2, 4, 5, 3]


def test_lines_are_numbered_over_byte_ranges(spark, tmp_path):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines[:1200]).encode() + b"\n")
    (tmp_path / "b.txt").write_bytes("\r\n".join(lines[1200:]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = dict(values(numbered_lines(spark, str(tmp_path))))
        pieces = {i: p for p, i in values(read_vocabulary(spark, str(tmp_path)))}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(lines))
    assert pieces == {i: p for i, p in enumerate(lines) if p}


def test_vocabulary_round_trip_with_missing_ids(spark, tmp_path):
    rows = [("b", 5), ("a", 2), ("##c", 9)]
    write_vocabulary(spark.createDataFrame(rows, "piece string, token_id int"), str(tmp_path / "v"))
    assert sorted(values(read_vocabulary(spark, str(tmp_path / "v")))) == sorted(rows)


def test_folding_rule_over_all_code_points(spark):
    def rule(c):
        return "".join(d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn")

    source, target, several = _folding()
    one = dict(zip(source, target)) | {c: "" for c in source[len(target) :]}
    korean = range(0xAC00, 0xD7A4)
    for n in range(sys.maxunicode + 1):
        if not 0xD800 <= n <= 0xDFFF and n not in korean:
            c = chr(n)
            folded = "".join(one.get(x, x) for x in several.get(c, c))
            assert folded == rule(c), hex(n)
    texts = ["Crème Brûlée", "한국어 각", "áb", "日本語", "".join(several), "".join(map(chr, korean)), None, "ABC"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fold_marks(F.col("t")).alias("f"))
    assert [r["f"] for r in got.collect()] == [None if t is None else "".join(map(rule, t)) for t in texts]
