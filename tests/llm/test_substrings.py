import hashlib

import duckdb
import numpy as np
import pytest

from tapewright.llm import substrings


def plain(docs, window=20):
    """docs: (doc_id, text). Per document (id and text): words, removed, hash of what is kept."""
    texts = {(i, (t or "").encode()) for i, t in docs}
    seen, out = {}, {}
    for i, text in sorted(texts, key=lambda d: (d[0] is None, d[0] or 0, hashlib.md5(d[1]).digest())):
        words = text.split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if seen.setdefault(b" ".join(words[s : s + window]), (i, text, s)) != (i, text, s):
                gone[s : s + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i, text] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def agree(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.digest(substrings.remove_repeats(frame)).collect()
    want = plain(docs)
    rows = [(i, *want[i, (t or "").encode()]) for i, t in docs]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_random_texts_with_runs_and_periods(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    passage = [" ".join(rng.choice(words, n)) for n in (19, 20, 21, 60)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(words, rng.integers(0, 50)))]
        for _ in range(rng.integers(0, 4)):
            kind = rng.integers(0, 4)
            parts.append(
                passage[rng.integers(0, 4)]
                if kind < 2
                else " ".join(["a"] * int(rng.integers(1, 70)))
                if kind == 2
                else " ".join(["x", "y", "z"][: rng.integers(2, 4)] * int(rng.integers(1, 30)))
            )
            parts.append(" ".join(rng.choice(words, rng.integers(0, 30))))
        docs.append((i, "\n".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, " \t ")]
    agree(spark, docs)


def test_edge_cases(spark, documents, no_documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    agree(spark, docs)
    assert substrings.remove_repeats(no_documents).collect() == []
    text = " ".join(map(str, range(30)))
    agree(spark, [(5, text), (None, text)])
    other = " ".join(f"u{i}" for i in range(45))
    agree(spark, [(5, text), (None, text), (None, other), (None, other), (None, None), (2, other + " x"), (2, text + " y"), (2, text + " y")])


def thue_morse(n, one, other):
    return "".join(one if bin(i).count("1") % 2 else other for i in range(n))


def test_words_and_passages_that_defeat_polynomial_hashes(spark):
    rest = " ".join(f"r{i}" for i in range(19))
    long = [thue_morse(2048, *x) for x in ("ab", "ba")]
    docs = [(i, f"{w} {rest}") for i, w in enumerate(long)]
    docs += [(i + 5, thue_morse(2048, *x)) for i, x in enumerate((("p ", "q "), ("q ", "p ")))]
    agree(spark, docs)


@pytest.mark.parametrize("seed", range(3))
def test_passages_that_begin_and_end_in_repeated_words_and_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    edges = ["a b a b a b", "a a a", "b a b a", "a b", "c c a b a b", "a a b b a a b b", "c a c a c c"]
    inner = [" ".join(f"k{rng.integers(0, 30)}" for _ in range(rng.integers(8, 30))) for _ in range(6)]
    docs = []
    for i in range(300):
        passage = f"{edges[rng.integers(0, 7)]} {inner[rng.integers(0, 6)]} {edges[rng.integers(0, 7)]}"
        docs.append((i, " ".join([*rng.choice(list("abcxy"), rng.integers(0, 9)), passage, *rng.choice(list("abcxy"), rng.integers(0, 9))])))
    agree(spark, docs)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(4)
    seen = {}
    for _ in range(400):
        edge = list(rng.choice(["a", "b"], 6)) * 2
        words = [*rng.choice(list("ab"), rng.integers(0, 6)), *edge, *(f"k{i}" for i in rng.integers(0, 3, 9)), *rng.choice(list("ab"), 12)]
        hashes, _ = substrings.word_hashes([" ".join(words).encode()])
        start, anchor = substrings.anchors(hashes, np.zeros(len(words), np.int64), 20)
        for s, a in zip(start, anchor, strict=True):
            assert seen.setdefault(tuple(words[s : s + 20]), a - s) == a - s


def test_sql(spark):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = substrings.digest(substrings.remove_repeats(docs)).collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(substrings.SQL).fetchall())


def test_against_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    agree(spark, [tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("n", [0, 1, 19, 20, 33, 300])
def test_every_window_has_an_anchor_inside(n):
    rng = np.random.default_rng(n)
    words = rng.integers(0, 5, n).astype(np.uint64) * np.uint64(977)
    start, anchor = substrings.anchors(words, np.zeros(n, np.int64), 20)
    assert len(start) == max(0, n - 19)
    assert ((anchor - substrings.BEFORE >= start) & (anchor + substrings.AFTER <= start + 20)).all()
