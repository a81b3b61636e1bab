"""BPE against the file's own library, quality rules against plain Python and held-out labels, and the pipeline against brute force."""

import hashlib
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeseek.llm.bpe import TreeEncoder, bpe_decode, bpe_encode, bpe_round_trip, check_spec, default_path, read_vocabulary
from lodeseek.llm.quality import Model, Words, buckets, quality_filter, quality_rules, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "中", "1", "23", "'s", "'ll", "!!", "<|endoftext|>", "<|end", "x" * 30, " " * 20, "ab" * 20, "🎉", " ", "\r\n", "ZZ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def test_small_leaves_agree_with_the_library(library):
    encoder = TreeEncoder(*read_vocabulary(default_path()), leaf_chars=24, leaf_bytes=12)
    random.seed(8)
    for _ in range(1500):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 50)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables(spark, library):
    texts = ["plain words", "", None, "a<|endoftext|>b", "word " * 40_000, "z" * 20_000, "same", "same"]
    rows = spark.createDataFrame([(k if k else None, t, [1], "x") for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>, id string")
    ids = {r.doc_id: r.ids for r in bpe_encode(rows).collect()}
    back = {r.doc_id: r.text for r in bpe_decode(bpe_encode(rows)).collect()}
    for k, t in enumerate(texts):
        assert ids[k or None] == library.encode(t or "", add_special_tokens=False).ids and back[k or None] == (t or "")
    for keep in (False, True):
        for r in bpe_round_trip(rows, keep_ids=keep).collect():
            own = ids[r.doc_id]
            assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id or 0] or "").encode()).hexdigest()
            assert not keep or r.ids == own
    assert bpe_round_trip(rows.limit(0)).count() == 0


def test_other_tokenizer_files_are_refused():
    with open(default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    check_spec(spec)
    changes = {
        "model": spec["model"] | {"type": "Unigram"}, "normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "Whitespace"}, "decoder": {"type": "WordPiece"},
        "added_tokens": [spec["added_tokens"][0] | {"lstrip": True}],
    }
    for key, value in changes.items():
        with pytest.raises(ValueError, match="can't be used"):
            check_spec(spec | {key: value})
    for part in ({"merges": spec["model"]["merges"][::-1]}, {"byte_fallback": True}, {"dropout": 0.1}):
        with pytest.raises(ValueError, match="can't be used"):
            check_spec(spec | {"model": spec["model"] | part})
    for other in ("prefix", "regex"):
        split = spec["pre_tokenizer"] | ({"add_prefix_space": True} if other == "prefix" else {"use_regex": False})
        with pytest.raises(ValueError, match="splits"):
            check_spec(spec | {"pre_tokenizer": split})


def test_character_grams():
    """Buckets count characters, whatever their bytes; ASCII and other texts are hashed alike."""
    for text in ("abcde", "äbcdé", "中文字符串", "a中b🎉c"):
        _, _, three, four = buckets(text, Words(text.encode()))
        assert (len(three), len(four)) == (max(0, len(text) - 2), max(0, len(text) - 3))
    plain, mixed = (buckets(t, Words(t.encode()))[2] for t in ("abcabc", "abcabcé"))
    assert plain.tolist() == mixed.tolist()[:4] and plain[0] == plain[3]
    assert [len(b) for b in buckets("", Words(b""))] == [0, 0, 0, 0]


def test_sample_of_bounded_bytes(spark):
    docs = spark.createDataFrame([(k, clean(k) if k % 2 else junk(k)) for k in range(200)] + [(0, clean(0))], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(1, 0), (3, 1)], "doc_id long, quality int")
    whole, bounded = train(docs, labels), train(docs, labels, most_bytes=60_000)
    assert abs(whole.weights - bounded.weights).max() > 0 and abs(bounded.weights).max() > 0
    none = train(docs, labels, most_bytes=10)
    assert not none.weights.any()


def base(text):
    text = text or ""
    words = WORD.findall(text)
    at = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if at[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def junk(k):
    r = random.Random(k)
    words = ["".join(r.choice("aeiourstnl") for _ in range(r.randint(2, 8))) for _ in range(r.randint(15, 60))]
    return " ".join(w.upper() + "!!" for w in words) if k % 4 < 2 else " ".join(w + "###" for w in words)


def clean(k):
    r = random.Random(k)
    return " ".join("".join(r.choice("aeiourstnl") for _ in range(r.randint(2, 8))) for _ in range(r.randint(15, 60))) + "."


def test_quality(spark):
    texts = [None, "", "few words", "one two three four five " * 4, "a b c d e f g h i j k l m n o", "x\nx\n\n \ny|&<>\nx", "é " * 30, clean(1) * 200]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, clean(k)) for k in range(120)] + [(300 + k, junk(k)) for k in range(120)]
    rows += [(None, clean(5)), (101, clean(1))]
    docs = spark.createDataFrame([(i, t, 1, True, "p") for i, t in rows], "doc_id long, text string, n_words int, kept boolean, id string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows if i and i >= 100 and i % 2] + [(None, 1, 0), (5, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    got = quality_rules(docs, model).collect()
    want = Counter((i, *base(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.probability >= 0.5) for r in got)
    held = [r for r in got if r.doc_id and r.doc_id >= 100 and r.doc_id % 2 == 0]
    assert sum(r.kept == (r.doc_id < 300) for r in held) >= 0.97 * len(held)
    again = train(docs.repartition(3), labels)
    assert abs(again.weights - model.weights).max() < 1e-6
    kept = quality_filter(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in got)
    one_class = train(docs, labels.where("quality = 1"))
    assert isinstance(one_class, Model) and quality_rules(docs.limit(0), one_class).count() == 0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = train(docs, labels.where("doc_id % 3 <> 0"))
    judged = quality_rules(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id")
    wrong = judged.where("NOT base_failed AND kept <> (quality = 1)").count()
    assert wrong <= 0.03 * judged.count()


def test_pipeline_stages_against_brute_force(spark):
    from tests.llm.test_operators import brute_components, brute_lines

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, quality), (_, lines), (_, near), (_, mixing), (_, encode) = corpus_pipeline.STAGES
    good = quality(spark, docs, folder)
    assert good.columns == docs.columns
    verdicts = {r.doc_id: r.kept for r in quality_rules(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    have = [tuple(r) for r in good.select("doc_id", "text").collect()]
    assert sorted(i for i, _ in have) == sorted(i for i, kept in verdicts.items() if kept)

    fewer = lines(spark, good, folder)
    want = {i: t for (i, _), t in brute_lines(have).items() if WORD.search(t)}
    assert {r.doc_id: r.text for r in fewer.collect()} == want and fewer.where(F.length("text") != F.col("n_chars")).isEmpty()

    single = near(spark, fewer, folder)
    groups = brute_components(sorted(want.items()))
    assert {r.doc_id for r in single.collect()} == {component for _, _, component in groups}

    mixed = mixing(spark, single, folder)
    assert mixed.columns == docs.columns and set(Counter(r.doc_id for r in mixed.collect()).values()) <= {1, 2}
    out = encode(spark, mixed, folder)
    assert out.count() == mixed.count()
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in out.collect())
