import inspect

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tapewright.llm import embeddings


def plain(rows, cosine=0.95):
    """rows: (vec_id, list or None). vec_id -> (links, smallest reachable)."""
    sound = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: [m for m, (_, w) in enumerate(sound) if m != k and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= cosine] for k, (_, v) in enumerate(sound)}
    low = {k: sound[k][0] for k in near}
    while True:
        new = {k: min([low[k], *(low[m] for m in near[k])]) for k in near}
        if new == low:
            break
        low = new
    return {**{i: (0, i) for i, _ in rows}, **{sound[k][0]: (len(near[k]), low[k]) for k in near}}


def vectors(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = np.concatenate([rng.normal(size=(n // 2, dim)), centres[rng.integers(0, 6, n // 2)] + rng.normal(0, 0.12, (n // 2, dim))])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[200][1]) for i in range(30)]  # copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * dim), (2003, [float("nan")] * dim), (2004, [None] * dim), (2005, [float("inf")] * dim)]
    return rows + [(2006, [2 * v for v in rows[0][1]]), (2007, [1.0, 2.0]), (2008, [2.0, 4.0]), (2009, [-1.0, 2.0])]


@pytest.mark.parametrize("chunk_rows", [16, 512])
def test_against_brute_force(spark, chunk_rows):
    rows = vectors(1)
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame, chunk_rows=chunk_rows, shared=2).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    found = sum(r.n_links for r in got.values())
    assert all(r.n_links <= want[i][0] for i, r in got.items())
    assert found >= 0.99 * sum(n for n, _ in want.values())
    assert sum(r.component_id == want[i][1] for i, r in got.items()) >= 0.99 * len(got)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert got[2006].n_links >= 1 and got[2007].n_links == 1 and got[2009].n_links == 0


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = {r.vec_id: int(n) - 1 for r, n in zip(rows, (x @ x.T >= 0.95).sum(axis=1))}
    got = embeddings.near_duplicates(frame).collect()
    assert all(r.n_links <= links[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.99 * sum(links.values())


@pytest.mark.parametrize("wanted", [128, 1024, 4096])
def test_recall_of_planted_pairs(wanted):
    """Pairs at cosine 0.95 to 0.96, with the defaults of the query."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.95, 0.96, (len(x), 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * other
    refs = embeddings.pivots(list(rng.normal(size=(wanted, 64))), wanted)[64]
    given = {k: p.default for k, p in inspect.signature(embeddings.similar_links).parameters.items()}
    a, b = (embeddings.described(v, refs, given["nearest"]) for v in (x, y))
    found = [len(np.intersect1d(p, q)) >= given["shared"] for p, q in zip(a, b)]
    assert len(refs) >= wanted * 0.95 and np.mean(found) > 0.99, (len(refs), np.mean(found))


def test_empty_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embeddings.near_duplicates(frame.where("vec_id = 1")).collect())
    assert got == [("1", 1, 1), ("1", 1, 1)]
    assert embeddings.near_duplicates(frame).count() == 3
    assert embeddings.near_duplicates(frame.where("false")).collect() == []


def test_links_through_vectors_without_id(spark):
    turned = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [(1, turned(0.0)), (None, turned(0.3)), (2, turned(0.6)), (None, turned(2.0)), (9, turned(-2.0))]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node int, part int")
    got = sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()), key=str)
    assert got == sorted([("1", 1, 1, True), ("None", 2, 1, False), ("2", 1, 1, False), ("None", 0, None, True), ("9", 0, 9, True)], key=str)


def test_sql(spark):
    rows = vectors(3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    duck = duckdb.connect()
    embeddings_table = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})
    duck.register("embeddings", embeddings_table)
    got = {tuple(r) for r in embeddings.near_duplicates(frame, shared=1).collect()}
    want = set(duck.execute(embeddings.SQL).fetchall())
    assert len(got ^ want) <= 0.02 * len(want) and {r[0] for r in got} == {r[0] for r in want}
