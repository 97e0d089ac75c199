"""Each operator against a plain version, and its cases: nulls, empty, long, ties, repeats, empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from labelmill.llm import (
    binary_fuse,
    exact_dedup,
    language_id,
    lm_scores,
    near_dedup,
    packing,
    quality_rules,
    sentencepieces,
    substring_dedup,
    token_counts,
    url_filters,
)
from labelmill.llm.components import components
from labelmill.llm.queries import RULES, vocabulary

ODD = [
    None, "", " \t\n", "a", "  a", "a  ", "a \xa0 b", "a\xa0\xa0 b", "x<|endoftext|> y <|startoftext|>z", "日本語 テキスト  です",
    "don't I'LL we've", "e\u0301 é", "a\x85b\x1cc", "İSTANBUL ΣΑΣ ß", "🎉🎉 👩‍👧", "▁▁a▁b", "ᚠ xᚠy", "<s></s>", "\x00 a", "12 345",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeht é.") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(40)]
    long_text = " ".join(rng.choice(words) for _ in range(20_000))
    return [*ODD, *made, made[0], made[0].upper(), long_text, "ab" * 3000]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_equal_the_library(docs, texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = by_id(token_counts.count_tokens(docs(texts), path))
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert [got[i]["n_bytes"] for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(got[i]["over_limit"] == (n > 1024) for i, n in enumerate(want))


def test_packing_is_gapless_and_has_the_library_ids(docs, texts):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack(docs(texts).repartition(5), path, window=64).collect()
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert places[0][:2] == (0, 0)
    for (s, o, n), (t, p, _) in itertools.pairwise(places):
        assert (t, p) == ((s, o + n) if o + n < 64 else (s + 1, 0))
    parts = collections.defaultdict(list)
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], r["length"]))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(parts[i]):
            assert start == at
            at += length
        assert at == len(ids)


def test_sentencepiece_equals_the_library_both_ways(docs, texts):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*texts, *(" " * n + "ab" + " " * n for n in range(1, 36))]
    got = by_id(sentencepieces.decode(sentencepieces.encode(docs(texts), path), path))
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or ""), t
        assert got[i]["decoded"] == (t or "").replace("▁", " ")


def test_exact_dedup(docs, texts):
    more = [*texts, "a b", "ab ", "a  b", None]
    ids = [*range(len(texts)), 900, 901, 3000, 902]
    got = exact_dedup.dedup(docs(more, ids)).collect()
    keys = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in zip(ids, more)}
    size = {i: len(t or "") for i, t in zip(ids, more)}
    assert len(got) == len(more)
    for r in got:
        same = [i for i in ids if keys[i] == keys[r["doc_id"]]]
        keep = min(same, key=lambda i: (-size[i], i))
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(same), keep == r["doc_id"])
        assert r["text_sha256"] == hashlib.sha256(keys[r["doc_id"]].encode()).hexdigest()


def test_exact_dedup_keeps_one_of_repeated_rows_and_null_ids(docs):
    got = exact_dedup.dedup(docs(["a"] * 40 + ["b"] * 2, [1] * 20 + [None] * 20 + [None] * 2)).collect()
    kept = [r for r in got if r["kept"]]
    assert [(r["doc_id"], r["group_size"]) for r in sorted(kept, key=lambda r: -r["group_size"])] == [(1, 40), (None, 2)]


def test_binary_fuse_has_all_keys_and_few_others():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 20_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        built = binary_fuse.build(keys)
        assert binary_fuse.contains(keys, *built).all()
        others = rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
        assert binary_fuse.contains(others, *built).mean() < 0.02


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return words


def test_near_dedup_equals_brute_force(docs):
    rng = random.Random(3)
    base = [[f"v{rng.randrange(5000)}" for _ in range(120)] for _ in range(25)]
    lists = [edited(rng, b, k) for b in base for k in (0, 0, 1, 2, 4)]
    lists += [edited(rng, base[0], 1) for _ in range(60)]  # one large group
    lists += [b + b[:40] * 3 for b in base[:5]]
    texts = [*(" ".join(w) for w in lists), None, "", "one two", "one  two", "three"]
    got = by_id(near_dedup.near_dedup(docs(texts)))

    def shingles(t):
        w = words_of(t)
        return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))

    def weight(c):
        return 1 + math.log(c)

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        both = a.keys() & b.keys()
        alike = words_of(texts[i]) == words_of(texts[j])
        if not alike and len(both) >= 0.5 * max(len(a), len(b)):
            p = sum(
                1 / sum(max(weight(a[e]) / weight(a[d]) if e in a else 0, weight(b[e]) / weight(b[d]) if e in b else 0) for e in a | b)
                for d in both
            )
            alike = p >= 0.8
        if alike:
            low, high = sorted((top(i), top(j)))
            parent[high] = low
    sizes = collections.Counter(top(i) for i in range(len(texts)))
    for i in range(len(texts)):
        assert (got[i]["class_id"], got[i]["class_size"], got[i]["kept"]) == (top(i), sizes[top(i)], top(i) == i), i


def test_near_dedup_connects_stars_and_keeps_strangers_in_large_buckets(docs, monkeypatch):
    rng = random.Random(9)
    texts, stars = [], []
    for c in range(2):
        base = [f"s{c}x{rng.randrange(5000)}" for _ in range(120)]
        at = len(texts)
        for k in range(60):  # 0.84 to the original, less than 0.8 to nearly all others
            words = list(base)
            for p in rng.sample(range(5, 115), 2):
                words[p] = f"e{c}x{k}x{p}"
            texts.append(" ".join(words))
        texts.append(" ".join(base))
        stars.append(set(range(at, len(texts))))
    common = [f"c{i}" for i in range(100)]
    alone = range(len(texts), len(texts) + 30)
    texts += [" ".join([*common, *(f"a{k}x{i}" for i in range(30))]) for k in range(30)]  # 0.6 to each other
    for size in (near_dedup.BLOCK, 7):
        monkeypatch.setattr(near_dedup, "BLOCK", size)
        got = by_id(near_dedup.near_dedup(docs(texts)))
        for star in stars:
            assert {got[i]["class_id"] for i in star} == {min(star)} and got[min(star)]["class_size"] == 61
        assert all(got[i]["class_size"] == 1 and got[i]["kept"] for i in alone)


def test_links_left_are_found_without_pivots(docs, monkeypatch):
    rng = random.Random(10)
    base = [f"t{rng.randrange(5000)}" for _ in range(120)]
    texts = [" ".join(base)] + [" ".join(edited(rng, base, 2)) for _ in range(60)]
    plain = near_dedup.candidates
    for size in (near_dedup.BLOCK, 7):
        monkeypatch.setattr(near_dedup, "BLOCK", size)
        monkeypatch.setattr(near_dedup, "candidates", lambda nodes: (plain(nodes)[0].limit(0), plain(nodes)[1]))
        sizes = {r["class_size"] for r in near_dedup.near_dedup(docs(texts)).where("doc_id = 0").collect()}
        assert sizes.pop() > 55


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def plain_repeats(texts, ids, n=50):
    owner = {}
    lists = [words_of(t) for t in texts]
    for i, w in zip(ids, lists):
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            owner[key] = min(owner.get(key, i), i)
    for i, w in zip(ids, lists):
        gone = set()
        for p in range(len(w) - n + 1):
            if owner[tuple(w[p : p + n])] < i:
                gone.update(range(p, p + n))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def test_substring_dedup_equals_brute_force(docs):
    rng = random.Random(5)

    def some(n):
        return [f"w{rng.randrange(900)}" for _ in range(n)]

    passages = [some(n) for n in (49, 50, 51, 80, 130)]
    lists = [some(rng.randrange(120)) + rng.choice(passages) + some(rng.randrange(90)) for _ in range(60)]
    lists += [edited(rng, lists[0], k) for k in (0, 1, 3)] + [["x"] * 200, ["x"] * 70, some(3000), passages[3] * 3]
    texts = [*("\t".join(w) for w in lists), None, "", " ", "short"]
    ids = rng.sample(range(-50, 1000), len(texts))
    got = substring_dedup.remove_repeats(docs(texts, ids)).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_repeats(texts, ids))


def test_repeated_rows_keep_their_words_and_are_scored_each(docs, monkeypatch):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    table = docs([text] * 300 + ["a " + text], [5] * 300 + [7])
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 4000)
    got = substring_dedup.remove_repeats(table).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(5, 120, 0)] * 300 + [(7, 121, 120)]
    scores = lm_scores.score(table, bucket_bytes=4000).where("doc_id = 5").collect()
    assert len(scores) == 300 and len({round(r["score"], 9) for r in scores}) == 1


def test_lm_scores(docs, texts):
    got = by_id(lm_scores.score(docs(texts), bucket_bytes=20_000))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lists = {i: [*words_of((t or "").translate(low)), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in lists}
    one = collections.Counter(w for i, t in lists.items() if not held[i] for w in t)
    two = collections.Counter(p for i, t in lists.items() if not held[i] for p in zip([None, *t], t))
    n, v = sum(one.values()), len(one)
    for i, t in lists.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(one[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t))
        model = 0.0
        for h, w in zip([None, *t], t):
            c = two[h, w]
            c = min((3 * 2 ** int(math.log2(c)) - 1) / 2 if c else 0, one[h], one[w])
            model += math.log10((c + 50 * (one[w] + 1) / (n + v + 1)) / (one[h] + 50))
        assert abs(r["score"] - model) < 0.1 * len(t)


def test_lm_scores_do_not_depend_on_the_bits_sent(docs, texts):
    table = docs(texts)
    sent = by_id(lm_scores.score(table, bucket_bytes=20_000))
    asked = by_id(lm_scores.score(table, bucket_bytes=20_000, max_bits=1 << 10))
    assert sent.keys() == asked.keys()
    for i, r in sent.items():
        assert asked[i]["score"] == pytest.approx(r["score"], abs=1e-9) and asked[i]["n_known"] == r["n_known"], i


def test_url_filters(spark):
    from labelmill.llm.ship import ship

    urls = [
        "http://A.example.org/es/1", "https://example.org/en/12?x", "https://org/en", "http://x.com/fr/", "http://x.com/de/1#y",
        "http://x.com/en/", "http://bad.net/a/?q", "http://BAD.net/a", "http://bad.net/b", "http://notexample.org/es/", "nothing", None, "", "x://",
    ]
    pages = ship(spark).createDataFrame([(i, u, "h") for i, u in enumerate([*urls, *urls])], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("http://bad.net/a/",), (None,), ("http://x.com/fr",), ("http://bad.net/a",)], "url string")
    want = [
        "block", "block", "allow", "allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow",
    ]
    for most in (0, 1 << 20):
        got = {r["page_id"]: r for r in url_filters.filter_urls(pages, listed, RULES, max_bytes=most).collect()}
        assert [got[i]["verdict"] for i in range(2 * len(urls))] == want * 2
    assert (got[0]["host"], got[0]["path"], got[0]["rule"]) == ("a.example.org", "/es/1", "example.org/es/")
    assert (got[11]["host"], got[11]["path"], got[11]["rule"]) == ("", "", None)


def test_quality_rules(docs, spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(("red", "blue", "green", "grey", "pink")) for _ in range(60)) for _ in range(30)]
    bad = ["\n".join(f"{rng.choice('abcdef')}### |" for _ in range(60)) for _ in range(10)]
    texts = [*good, *bad, *ODD, "one two\none two\n \n \none two", " ".join(map(str, range(30))) + " " + " ".join(map(str, range(10)))]
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    counts = quality_rules.gram_counts(docs(texts), trusted)
    got = by_id(quality_rules.judge(docs(texts), quality_rules.log_ratios(counts, prior=2000)))
    for i, text in enumerate(texts):
        w, t = words_of(text), text or ""
        seen = collections.Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
        twice = {q for p in range(len(w) - 7) if seen[tuple(w[p : p + 8])] > 1 for q in range(p, p + 8)}
        lines = [x for x in t.split("\n") if words_of(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(twice)), text
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t)) and r["n_dup_lines"] == len(lines) - len(set(lines)), text
        assert r["base_failed"] == (len(w) < 20 or 100 * len(twice) > 30 * len(w))
    cells = []
    for text in texts:
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), x).encode() for x in words_of(text)]
        data, ends = np.frombuffer(b"".join(low), np.uint8), np.cumsum([0, *map(len, low)], dtype=np.int64)
        cells.append(quality_rules.buckets(data, ends[:-1], ends[1:], np.array([0, len(low)]))[0].tolist())
    raw = collections.Counter(itertools.chain.from_iterable(cells))
    target = collections.Counter(itertools.chain.from_iterable(cells[:20]))
    n, m = sum(raw.values()), sum(target.values())
    for i, mine in enumerate(cells):
        want = [math.log((target[b] * n / raw[b] + 2000) / (m + 2000)) for b in mine]
        assert got[i]["llr"] == pytest.approx(sum(want) / max(1, len(want)), abs=1e-9)
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["llr"] >= quality_rules.THRESHOLD)
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(len(good)))
    assert not any(got[i]["kept"] for i in range(len(good), len(good) + len(bad)))


def test_quality_of_few_trusted_documents(docs, spark):
    rng = random.Random(8)
    kinds = [[f"{k}{i}" for i in range(40)] for k in ("good", "bad")]
    texts = [" ".join(rng.choice(kinds[i >= 200]) for _ in range(60)) for i in range(260)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(i, 0, 0) for i in range(250, 260)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.judge_by_labels(docs(texts), labels))
    assert not any(r["base_failed"] for r in got.values())
    assert [got[i]["kept"] for i in range(260)] == [True] * 200 + [False] * 60
    assert all(r["kept"] for r in quality_rules.judge_by_labels(docs(texts), labels.where("quality = 0")).collect())


def test_quality_counts_every_trusted_document(spark):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "cast(null AS int) AS toxic")
    assert quality_rules.trusted_ids(labels.union(labels)).count() == 25_000
    scores = [0.5, -1.0, 2.0, 2.0, 7.25, 3.0, -4.0]
    table = spark.createDataFrame([(x,) for x in scores], "llr double")
    assert quality_rules.quantiles(table, "llr", (0.05, 0.5, 1.0)) == pytest.approx(np.quantile(scores, (0.05, 0.5, 1.0)))
    assert quality_rules.quantiles(table.limit(0), "llr", (0.5,)) == []


def test_language_id(docs):
    rng = random.Random(4)
    kinds = {"aa": ["the", "and", "with", "hither"], "bb": ["der", "über", "nicht", "schön"], "cc": ["だ", "です", "これ", "それ"]}
    rows = [(" ".join(rng.choice(kinds[k]) for _ in range(20)), k) for k in kinds for _ in range(30)]
    rows += [("12 #$", "aa"), (None, None), ("", "bb"), ("the and with", None)]
    got = by_id(language_id.predict(docs([t for t, _ in rows], langs=[k for _, k in rows]), language_id.fit(docs([t for t, _ in rows], langs=[k for _, k in rows]))))
    assert all(got[i]["lang_pred"] == rows[i][1] for i in range(90))
    assert [got[i]["lang_pred"] for i in range(90, 94)] == ["und", "und", "und", "aa"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i]["score"] <= 1 for i in got)
    without = docs(["a b"])
    assert language_id.predict(without, language_id.fit(without)).first()["lang_pred"] == "und"


def test_empty_tables(docs, spark):
    none = docs([])
    assert exact_dedup.dedup(none).count() == near_dedup.near_dedup(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == lm_scores.score(none).count() == 0
    assert packing.pack(none, vocabulary("word_bpe_49k.json")).count() == 0
    assert token_counts.count_tokens(none, vocabulary("byte_bpe_50k.json")).count() == 0
    path = vocabulary("piece_bpe_32k.model")
    assert sentencepieces.decode(sentencepieces.encode(none, path), path).count() == 0
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    trusted = spark.createDataFrame([], "doc_id long")
    assert quality_rules.judge(none, quality_rules.log_ratios(quality_rules.gram_counts(none, trusted))).count() == 0
