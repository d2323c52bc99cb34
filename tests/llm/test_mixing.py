import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import mixing


def plain_sainte_lague(weights, seats, limits):
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if got[i] < limits[i] and weights[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (Fraction(weights[i]) / (2 * got[i] + 1), -i))] += 1
    return got


@pytest.mark.parametrize("seed", range(8))
def test_sainte_lague(seed):
    rng = np.random.default_rng(seed)
    weights = rng.integers(0, 50, 7)
    limits = rng.integers(0, 40, 7)
    seats = int(rng.integers(0, 150))
    assert mixing.sainte_lague(weights, seats, limits).tolist() == plain_sainte_lague(weights.tolist(), seats, limits.tolist())


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.targets([10, 1000, 1000, 0], [1, 2, 3, 1])
    assert got[0] == 30 and got[3] == 0 and sum(got) == pytest.approx(2010) and got[2] / got[1] == pytest.approx(1.5)


def check(docs, rows):
    sizes = defaultdict(int)
    texts = docs.select("doc_id", "source", "text").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in texts:
        sizes[r.source] += size(r.text)
    assert Counter((r.doc_id, r.size, r.source_size) for r in rows) == Counter((r.doc_id, size(r.text), sizes[r.source]) for r in texts)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([sizes[s] for s in names], [i % 3 + 1 for i in range(len(names))])))
    source = {r.doc_id: r.source for r in texts}
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.epochs * r.size + sum(hi - lo for lo, hi in r.ranges)
        assert all(0 <= lo < hi <= r.size for lo, hi in r.ranges)
        taken[source[r.doc_id]] += r.taken
    return {s: (taken[s], want[s]) for s in names}


def test_mix_edge_cases(spark, documents):
    check(documents, mixing.mix(documents, block_words=8).collect())


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    for got, want in check(docs, rows).values():
        assert abs(got - want) <= max(64, 0.005 * want)
    assert Counter(map(str, rows)) == Counter(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_small_and_null_sources(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (2, "a " * 5000, "x"), (None, "b " * 4000, ""), (4, None, "y"), (4, None, "y")], "doc_id long, text string, source string")
    got = check(docs.where("doc_id is not null"), mixing.mix(docs.where("doc_id is not null")).collect())
    assert got[None] == (9, 9.0)
    assert mixing.mix(docs).count() == 5


def test_no_documents(spark, no_documents):
    assert mixing.mix(no_documents).collect() == []
    assert mixing.mix(no_documents.withColumn("source", F.lit(None).cast("string"))).collect() == []
