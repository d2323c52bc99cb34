import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from tapewright.llm import langid


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    moves = rng.normal(size=(3, 3))
    lengths = np.array([4, 1, 6])
    scores = rng.normal(size=(lengths.sum(), 3))
    got, expected = langid.marginals(scores, lengths, moves, True)
    want, pairs, at = [], np.zeros((3, 3)), 0
    for n in lengths:
        s, mass, own = scores[at : at + n], np.zeros((n, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=n):
            start = np.exp(moves)[:, y[0]].sum()
            w = start * np.exp(sum(s[t, y[t]] for t in range(n)) + sum(moves[a, b] for a, b in itertools.pairwise(y)))
            for t in range(n):
                mass[t, y[t]] += w
            for a, b in itertools.pairwise(y):
                own[a, b] += w
        want.append(mass / mass[0].sum())
        pairs += own / mass[0].sum()
        at += n
    assert np.allclose(got, np.concatenate(want)) and np.allclose(expected, pairs)


def test_marginals_across_blocks():
    rng = np.random.default_rng(4)
    moves, n = rng.normal(size=(2, 2)), 3 * langid.BLOCK + 5
    scores = rng.normal(size=(n, 2))
    got = langid.marginals(scores, np.array([n]), moves)
    a, forward = np.ones(2), []
    for t in range(n):
        a = (a @ np.exp(moves)) * np.exp(scores[t])
        a /= a.sum()
        forward.append(a)
    b, want = np.ones(2), []
    for t in range(n - 1, -1, -1):
        p = forward[t] * b
        want.append(p / p.sum())
        b = np.exp(moves) @ (b * np.exp(scores[t]))
        b /= b.sum()
    assert np.allclose(got, want[::-1])


def test_held_out_accuracy_and_code_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    en, de = (next(" ".join(r.text.split()[:40]) for r in tested if r.lang == x and len(r.text.split()) > 60) for x in ("en", "de"))
    mixed = langid.annotate(spark.createDataFrame([(1, f"{en} {de} {en}")], "doc_id long, text string"), langid.fit(docs)).first()
    assert mixed.lang_pred == "en" and 2 <= mixed.n_switches <= 6 and 0.5 < mixed.score < 0.85


def test_edge_cases(spark, documents, no_documents):
    got = {r.doc_id: r for r in langid.identify(documents).collect()}
    assert langid.identify(documents).count() == documents.count()
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[4].score == 0
    assert langid.identify(no_documents).collect() == []
    assert {r.lang_pred for r in langid.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_known(documents)
    assert kept.columns == documents.columns and not {4, 5, 6} & {r.doc_id for r in kept.collect()}
