"""The pipeline's stages on a small table, step by step against plain versions."""

import random

import corpus_pipeline
from tests.llm.test_operators import plain_repeats


def test_stages(docs, tmp_path):
    rng = random.Random(6)

    def some(n):
        return [f"w{'abcdefgh'[rng.randrange(8)]}{rng.randrange(999)}" for _ in range(n)]

    base = [some(150) for _ in range(12)]
    passage = some(60)
    texts = [" ".join(b) for b in base] + ["  ".join(base[0])]  # 12 equals 0 and is longer
    texts += [" ".join([*base[1][:-1], "other"])]  # 13 is near 1
    texts += [" ".join(some(40) + passage + some(30)) for _ in range(3)] + [None, "", "123 456"]
    table = docs(texts, langs=["en"] * len(texts))
    seen = {}
    spark = table.sparkSession
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, table, str(tmp_path)).write.parquet(path)
        before, table = table, spark.read.parquet(path)
        if name != "packing":
            assert table.columns == before.columns
        seen[name] = table
    ids = {n: sorted(r["doc_id"] for r in d.select("doc_id").distinct().collect()) for n, d in seen.items()}
    assert ids["language_id"] == list(range(17))
    assert ids["exact_dedup"] == list(range(1, 17))
    assert ids["near_dedup"] == [i for i in range(1, 17) if i != 13]
    left = {r["doc_id"]: r for r in seen["substring_dedup"].collect()}
    for i, _, n_removed, kept in plain_repeats([texts[i] for i in ids["near_dedup"]], ids["near_dedup"]):
        assert left[i]["text"] == (kept if n_removed else texts[i]) and left[i]["n_chars"] == len(left[i]["text"])
    assert ids["packing"] == ids["near_dedup"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_documents_without_labels(docs, tmp_path):
    table = docs(["one two", "ünï", "日本", "12 #", "", None, "x"])
    kept = corpus_pipeline.known_language(table.sparkSession, table, str(tmp_path))
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 6]


def test_language_stage_rejects_what_is_like_no_language(docs, tmp_path):
    rng = random.Random(3)
    letters = {"en": "etaoinshrdlu", "fr": "éàêçesaitnru", "ru": "оеаинтсрвлкм"}

    def text(lang, n):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 9))) for _ in range(n))

    langs = [("en", "fr")[i % 2] for i in range(300)]
    texts = [text(lang, rng.randint(1, 150)) for lang in langs]
    odd = [text("ru", 400), text("ru", 300), "жы", "x", "12 #", None, ""]
    table = docs(texts + odd, langs=langs + [None] * len(odd))
    kept = corpus_pipeline.known_language(table.sparkSession, table, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(300), 302, 303]


def test_language_sample_is_bounded_for_any_number_of_languages(docs, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.language_id, "MAX_SAMPLE", 1600)
    table = docs([f"text number {i}" for i in range(3000)], langs=[f"l{i % 1500}" for i in range(3000)])
    sample = corpus_pipeline.language_id.training_sample(table, 400, "doc_id", "text", "lang")
    rows = sample.collect()
    assert len(rows) <= 1500 and len({r["lang"] for r in rows}) == len(rows) > 1300


def test_stages_on_empty_tables_and_odd_rows(docs, tmp_path):
    rng = random.Random(8)
    long_text = " ".join(f"w{rng.randrange(9999)}" for _ in range(20_000))
    texts = [None, "", "a", "one two three", "one two three", long_text, long_text, "x " * 3000]
    odd = docs(texts, ids=[1, 2, None, 4, 4, None, 7, 7], langs=["en", None, "en", "fr", "fr", "en", "en", None])
    names = {"lang": "lang", "kept": "row", "row_id": "bucket"}  # columns with names the operators use
    odd = odd.withColumnsRenamed(names).withColumn("__row_id", odd["source"])
    spark = odd.sparkSession
    for label, table in (("odd", odd), ("empty", odd.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{label}-{name}"
            stage(spark, table, str(tmp_path)).write.parquet(path)
            before, table = table, spark.read.parquet(path)
            if name != "packing":
                assert table.columns == before.columns
            if label == "empty":
                assert table.count() == 0
    kept = sorted(str(r["text"])[:13] for r in spark.read.parquet(f"{tmp_path}/odd-exact_dedup").collect())
    assert kept == ["a", "one two three", long_text[:13], "x x x x x x x"]
