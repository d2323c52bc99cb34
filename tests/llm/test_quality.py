import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tapewright.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def agree(rows, docs):
    want = {i: plain(t) for i, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, lines, repeats = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id], r.doc_id
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)


def test_table_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.rate_documents(docs, labels).collect()
    agree(rows, [(r.doc_id, r.text) for r in docs.collect()])
    score = {r.doc_id: r.score for r in rows}
    tested = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((score[r.doc_id] >= 0.5) == (r.quality == 1) for r in tested) >= 0.95 * len(tested)


def test_edge_cases(spark, documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (8, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.rate_documents(documents, labels).collect()
    agree(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert quality.rate_documents(no_documents, labels).collect() == []
    rows = quality.rate_documents(documents, labels.where("false")).collect()
    assert all(r.kept != r.base_failed for r in rows)


def test_words_that_defeat_polynomial_hashes(spark):
    words = ["".join(x[bin(i).count("1") % 2] for i in range(2048)) for x in ("ab", "ba")]
    text = " ".join(f"{w} k1 k2 k3 k4" for w in words)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    agree(quality.counted(docs).selectExpr("*", "n_words < 10 as base_failed", "false as kept").collect(), [(1, text)])


def test_trees_are_monotonic_and_flat_scores_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 0]) - x[:, 1] + rng.normal(0, 0.3, 600)) > 0).astype(int)
    for signs in ((-1, 0), (1, -1)):
        model = quality.grow(x, y, trees=20, signs=signs)
        grid = np.linspace(0, 1, 50)
        for f, sign in enumerate(signs):
            for other in (0.1, 0.5, 0.9):
                z = np.full((50, 2), other)
                z[:, f] = grid
                assert sign == 0 or (np.diff(model.score(z)) * sign >= -1e-12).all()
    for row, got in zip(x[:20], model.score(x[:20])):
        total = model.base
        for node in model.roots:
            while model.feature[node] >= 0:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        assert np.isclose(got, 1 / (1 + np.exp(-total)))


def test_columns_with_clashing_names(spark, documents):
    docs = documents.withColumn("kept", F.lit("x")).withColumn("score", F.lit(1)).withColumn("n_words", F.lit(0))
    assert quality.rate_documents(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == documents.count()
