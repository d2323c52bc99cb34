import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewright.llm import alignment


@pytest.fixture(scope="module")
def plain_tokens():
    """Token ids and bytes of both tokenizers by the libraries themselves, on whole texts."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}

    def tokens(text):
        if not text:
            return [], []
        own = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(of_char[c] for c in a.id_to_token(i))) for i in own.ids]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
            return [], []
        return left, right

    return tokens


def plain(tokens, rows):
    made, counts = [], Counter()
    for doc_id, text in rows:
        left, right = tokens(text)
        ends = []
        for side in (left, right):
            at, own = 0, []
            for _, x in side:
                at += len(x)
                own.append(at)
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links = [], []
        i = j = 0
        for e in common:
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(",".join(str(x) for x, _ in left[i:p]) + "|" + ",".join(str(x) for x, _ in right[j:q]))
            i, j = p, q
            links.append((left[p - 1][0], right[q - 1][0]))
        counts.update(links)
        made.append((doc_id, len(left), len(right), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    most = {}
    for (a, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = [(d, n, m, g, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), h) for d, n, m, g, ls, h in made]
    return sorted(out, key=str), counts, most


def check(tokens, docs):
    made = alignment.digest(docs)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected, counts, most = plain(tokens, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, made.collect()), key=str) == expected
    return counts, most


ODD = ["a▁b", "é̂ é ﬁ ①", "two  spaces", " lead", "trail ", "line\nbreak", "line\n\nbreak", "a \n b", "tab\tbed", "<|endoftext|> <s> </s> <unk>", "x<0x0A>y", "日本語 テキスト", "😀 emoji 👩‍👩‍👧", " nbsp", "　wide", "nul\x00l", "\r\nwin", "'s don't I'LL", "1234567 3.14", "﻿bom", "end\n"]


def test_odd_texts(spark, plain_tokens):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (7, "same"), (7, "same"), (8, None), (9, "")]
    check(plain_tokens, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_a string, block long"))


def test_edge_cases(documents, no_documents, plain_tokens):
    counts, most = check(plain_tokens, documents)
    pairs = {(r["a_id"], r["b_id"]): (r["count"], r["best"]) for r in alignment.pair_counts(documents).collect()}
    assert pairs == {x: (n, n == most[x[1]]) for x, n in counts.items()}
    assert alignment.digest(no_documents).count() == 0


def test_given_table(spark, plain_tokens):
    check(plain_tokens, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5))


def test_small_blocks(spark, plain_tokens):
    """Many parts, so many blocks of a text or two, some empty: counts still are the corpus's."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 10 = 0").repartition(20)
    check(plain_tokens, docs)


def test_blocks_end(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "BLOCK_TOKENS", 50)
    both = alignment.tokenizers(*alignment.paths(None, None))
    texts = [b"word " * 200 + b"x", b"", b"a b c", b"tail " * 9 + b"y"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts, pa.binary())], ["doc_id", "text"])
    blocks = list(alignment._blocks(both, iter([batch])))
    assert [d for ids, _, _ in blocks for d in ids] == list(range(12)) and len(blocks) > 3
    assert sum(len(have) for _, have, _ in blocks) == 9


def test_groups_are_the_same_bytes(spark, documents):
    both = alignment.tokenizers(*alignment.paths(None, None))
    for r in alignment.align(documents).collect():
        i = j = 0
        for p, q in zip(r["a_ends"], r["b_ends"], strict=True):
            assert b"".join(both.a_bytes[x] for x in r["a_ids"][i:p]) == b"".join(both.b_bytes[x] for x in r["b_ids"][j:q])
            i, j = p, q
        assert (i, j) == (len(r["a_ids"]), len(r["b_ids"]))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 3000)), st.sets(st.integers(0, 3000)), st.integers(1, 8), st.integers(1, 9))
def test_gallop(a, b, lanes, lane):
    short, long = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    old = alignment.LANES, alignment.LANE
    alignment.LANES, alignment.LANE = lanes, lane
    try:
        i, j = alignment.gallop(short, long)
    finally:
        alignment.LANES, alignment.LANE = old
    assert short[i].tolist() == long[j].tolist() == sorted(a & b)
