import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapewright.llm import simhash
from tapewright.llm.components import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance=3):
    root = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, f in zip(ids, fps):
            low = min(root[j] for j, g in zip(ids, fps) if bin(f ^ g).count("1") <= distance)
            changed |= low < root[i]
            root[i] = min(root[i], low)
    return root


def test_near_duplicates_against_brute_force(spark, documents):
    got = simhash.near_duplicates(documents).collect()
    rows = documents.select("doc_id", "text").collect()
    want = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    assert len(got) == len(rows)
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == plain_components(list(want), list(want.values()))


@pytest.mark.parametrize("bucket_rows", [8, 1024])
def test_close_edges_lose_no_link(spark, bucket_rows):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(50)}
    fps |= set(map(int, rng.integers(0, 1 << 63, 100, dtype=np.uint64)))
    fps = sorted(fps)
    reps = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, root long")
    got = {r.node: r.component for r in connected_components(simhash.close_edges(reps, 3, bucket_rows)).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == plain_components(list(range(len(fps))), fps)


def test_links_through_documents_without_id(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    texts = []
    for i in range(60):
        words[int(rng.integers(0, 400))] = f"new{i}"
        texts.append(" ".join(words))
    fps = [plain_fingerprint(t) for t in texts]
    far = lambda i, j: bin(fps[i] ^ fps[j]).count("1")
    a, b, c = next((a, b, c) for a in range(60) for b in range(60) for c in range(60) if far(a, b) <= 3 and far(b, c) <= 3 < far(a, c))
    rows = [(1, texts[a]), (None, texts[b]), (3, texts[c]), (None, "alone and without an id")]
    docs = spark.createDataFrame([(*r, "x", 5, 6) for r in rows * 2], "doc_id long, text string, fp string, node int, part int")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("1", "1"), ("None", "1"), ("3", "1"), ("None", "None")] * 2)


def test_chain_of_components(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_no_documents(spark, no_documents):
    assert simhash.near_duplicates(no_documents).collect() == []
