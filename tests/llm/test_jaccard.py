import random
import re

import pytest

import corpus_pipeline
from tapewright.llm import jaccard
from tests.llm.test_simhash import plain_fingerprint


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)])


def plain_kept(rows, similarity=0.8):
    """doc_ids that stay: the smallest of each component, pair by pair on the texts."""
    sets = {i: plain_set(t) for i, t in rows}
    near = {i: [j for j in sets if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity] for i in sets}
    low = {i: i for i in sets}
    while (new := {i: min(low[j] for j in near[i]) for i in near}) != low:
        low = new
    return {i for i in low if low[i] == i}


def corpus(seed=3):
    """Texts with planted near copies on both sides of 0.8, a common passage, and a large group of near copies."""
    r = random.Random(seed)
    plain = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, texts = plain(40), []
    for _ in range(60):
        words = plain(r.randrange(30, 200))
        texts.append(words)
        for share in (0.01, 0.02, 0.022, 0.03):
            texts.append([f"x{r.randrange(5000)}" if r.random() < share else w for w in words])
    texts += [plain(r.randrange(3, 12)) + passage for _ in range(60)]
    centre = plain(120)
    texts += [centre[: (at := r.randrange(120))] + [f"y{k}"] + centre[at + 1 :] for k in range(120)]
    texts += [["a"], ["A"], ["a", "b"], [], []]
    r.shuffle(texts)
    return list(enumerate(map(" ".join, texts)))


@pytest.mark.parametrize("common", [2, 10**9])
def test_stage_against_brute_force(spark, common, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == plain_kept(rows)


def alike(n, seed=5):
    """n texts that share most words with one another, near 0.8 on both sides, and none of which is the middle."""
    r = random.Random(seed)
    centre = [f"w{k * 7919 % 1009}" for k in range(150)]
    texts = []
    for k in range(n):
        words = list(centre)
        for at in r.sample(range(150), r.choice((3, 4, 4))):
            words[at] = f"z{k}x{at}" if k % 5 else f"z{at}"
        texts.append(" ".join(words))
    return list(enumerate(texts))


def test_crowd_of_alike_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = alike(240)
    kept = plain_kept(rows)
    assert 20 < len(kept) < 240
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == kept


def test_links_that_three_bits_miss(spark):
    words = [f"w{k * 7919 % 1009}" for k in range(100)]
    texts = [" ".join(words), " ".join([*words[:30], "other", *words[31:60], "another", *words[61:]])]
    assert (plain_fingerprint(texts[0]) ^ plain_fingerprint(texts[1])).bit_count() > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in jaccard.keep_one(docs).collect()] == [0]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == plain_kept(rows)
