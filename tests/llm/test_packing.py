import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapewright.llm import packing

TEXTS = [
    "", " ", "\n", "a", " a", "a ", "a b", "a  b", "a\nb", "a\n\nb", "a \n b", "a\tb", "it's we'll 'tis", "été ça\nÉté", "x y z", "a b",
    "<|endoftext|> end <|endoftext|>", "12 345 6,7 %% $$$ a_b", "日本語 テキスト\nです", "😀 😀\n😀", "a\r\nb", "end\n", "\n\nstart", "ab\x1cc d",
]


def test_ids_equal_the_tokenizer():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = packing.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in TEXTS + TEXTS:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("capacity", [8, 100, 1024])
def test_cuts(capacity):
    for n in range(1, 3 * capacity):
        got = packing.cuts(n, capacity)
        assert sum(got) == n and min(got) > 0 and max(got) <= capacity


def holds(rows, docs, capacity=1024):
    """Every id once, sequences gapless, checksums right; returns the padding's share."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, texts in docs.items():
        got = sorted(by_doc.pop(doc_id), key=lambda r: r.start)
        ids = np.array(plain.encode(texts[0] or "", add_special_tokens=False).ids + [0], "<u4")
        assert sum(r.length for r in got) == len(ids) * len(texts)
        for r in got:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    assert not by_doc
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    padded = 0
    for got in by_sequence.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padded += capacity - at if at & (at - 1) else 0
    return padded / (capacity * max(1, len(by_sequence)))


def test_pack(spark, documents):
    docs = defaultdict(list)
    for r in documents.collect():
        docs[r.doc_id].append(r.text)
    holds(packing.pack(documents).collect(), docs)


def test_padding_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: [r.text] for r in docs.select("doc_id", "text").collect()}
    assert holds(packing.pack(docs).collect(), texts) < 0.01


def test_nothing_and_null_ids(spark, no_documents, documents):
    assert packing.pack(no_documents).collect() == []
    nulls = documents.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.doc_id, r.length) for r in packing.pack(nulls).orderBy("start").collect()] == [(None, 2)]


def test_sequences_hold_the_ids(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(k, t * (k % 3 * 40 + 1)) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    packed = packing.pack(docs, capacity=100)
    whole = {r.sequence_id: r for r in packing.sequences(packed, 100, pad_id=7).collect()}
    rows = sorted(packed.collect(), key=lambda r: (r.doc_id, r.start))
    assert whole.keys() == {r.sequence_id for r in rows}
    got, filled = defaultdict(list), defaultdict(int)
    for r in rows:
        ids = whole[r.sequence_id].ids[r.offset : r.offset + r.length]
        assert ids == np.frombuffer(r.ids, "<u4").tolist()
        got[r.doc_id] += ids
        filled[r.sequence_id] += r.length
    for r in docs.collect():
        assert got[r.doc_id] == [*plain.encode(r.text, add_special_tokens=False).ids, 0]
    assert all(len(r.ids) == 100 and r.n_tokens == filled[k] and set(r.ids[r.n_tokens :]) <= {7} for k, r in whole.items())


def test_ids_are_shuffled_once(spark, documents):
    """The pieces' ids are the bulk of the data: one exchange deals them, and what the ranks need beside it is broadcast."""
    packed = packing.pack(documents)
    packed.collect()
    plan = packed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and plan.count("ids_crc32") and sum("Exchange hashpartitioning(" in line and "_part" in line for line in plan.split("\n")) == 2
