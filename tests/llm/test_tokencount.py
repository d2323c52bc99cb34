import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from tapewright.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces):
    t = Tokenizer(models.Unigram(list(pieces), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_library(spark):
    plain, ours = library(tokencount.vocabulary(PATH)), tokencount.Counter(tokencount.vocabulary(PATH))
    texts = ["", " ", "a", " a", "a  b ", "x▁y", "▁", "日本語テキスト", "😀é\n\tz", "\x00\x01", "a\nb\nc", "ab" * 300, "<s> </s> <0x0A>"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert ours.text(text)[0] == len(plain.encode(text, add_special_tokens=False).ids), repr(text[:80])


def test_ties_as_in_the_library():
    rng = random.Random(0)
    for _ in range(60):
        pieces = {"<unk>": 0.0, **{f"<0x{i:02X}>": -30.0 for i in range(256)}}
        for _ in range(rng.randint(3, 25)):
            pieces["".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4)))] = -float(rng.randint(1, 4))
        plain, ours = library(pieces.items()), tokencount.Counter(list(pieces.items()))
        for _ in range(20):
            text = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 14)))
            assert ours.text(text)[0] == len(plain.encode(text, add_special_tokens=False).ids), (pieces, text)


def test_edge_cases(spark, documents, no_documents):
    plain = library(tokencount.vocabulary(PATH))
    rows = tokencount.count_tokens(documents).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    assert len(rows) == documents.count()
    assert all(r.n_tokens == len(plain.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in rows)
    assert tokencount.count_tokens(no_documents).collect() == []
