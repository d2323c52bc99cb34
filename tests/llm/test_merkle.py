import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tapewright.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root, and for each node the (siblings before, siblings after) of every level."""
    paths, below = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, up_below = [], []
        for i in range(0, len(nodes), 16):
            run = nodes[i : i + 16]
            for k in range(len(run)):
                for b in below[i + k]:
                    paths[b].append((run[:k], run[k + 1 :]))
            up.append(H("".join(run)))
            up_below.append(sum(below[i : i + 16], []))
        nodes, below = up, up_below
    return nodes[0], paths


def plain(rows):
    out, trees = [], {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        built[s] = plain_tree([plain_leaf(r, r["text"]) for r in trees[s]])
    root, above = plain_tree([built[s][0] for s in order])
    for k, s in enumerate(order):
        for r, path in zip(trees[s], built[s][1], strict=True):
            path = path + above[k]
            leaf = folded = plain_leaf(r, r["text"])
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                folded = plain_leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for before, after in path:
                folded = H("".join([*before, folded, *after]))
            proof = H("".join(x for before, after in path for x in before + after))
            out.append((r["doc_id"], leaf, built[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def check(docs):
    made = merkle.prove(docs, merkle.tamper_fifth())
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == plain(docs.select("doc_id", "source", "lang", "n_chars", "text").collect())
    return got


def test_edge_cases(documents, no_documents):
    more = documents.where("doc_id = 11")  # in capitals
    for k in range(1, 9):
        more = more.union(documents.where("doc_id = 11").withColumn("doc_id", F.lit(1000 + k).cast("long")))
    assert {r[-1] for r in check(documents.union(more))} == {True, False}
    assert merkle.prove(no_documents).count() == 0
    assert merkle.roots(no_documents).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097])
def test_sizes(spark, n):
    """One source of n rows, many small ones, one without a name, rows without doc_id."""
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"))
    small = spark.range(40).select((F.col("id") + 10**6).alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("source"), F.lit("É a").alias("text"))
    none = spark.createDataFrame([(None, None, "A"), (None, None, None), (None, "hot", "A"), (5, None, "B")], "doc_id long, source string, text string")
    check(rows.union(small).union(none).select("*", F.lit(None).cast("string").alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.lit("x").alias("leaf"), F.lit("y").alias("tree")))


def test_alone(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1, "T")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = merkle.prove(docs).collect()
    assert row["root"] == row["subroot"] == row["leaf"] and row["proof_sha256"] == H("") and row["verified"]


def test_witnesses_grow_as_siblings_complete():
    stream, witnesses = merkle.Subtrees(2), []
    leaves = [H(str(k)) for k in range(40)]
    for k, leaf in enumerate(leaves):
        witnesses.append([])
        stream.append(leaf, [witnesses[-1]])
        assert [len(w) for w in witnesses] == [1 if i < (k + 1) // 16 * 16 else 0 for i in range(k + 1)]
    root = stream.close()
    assert all(merkle.fold(leaf, w) == root for leaf, w in zip(leaves, witnesses, strict=True))
    assert root == plain_tree(leaves)[0]


def test_manifest(spark, documents):
    rows = {r["source"]: r for r in merkle.roots(documents).collect()}
    proofs = merkle.prove(documents).join(documents.select("doc_id", "source").distinct(), "doc_id").collect()
    assert {(r["source"], r["subroot"], r["root"]) for r in proofs} == {(s, r["subroot"], r["root"]) for s, r in rows.items()}
    assert sum(r["n_rows"] for r in rows.values()) == documents.count()
    again = {r["source"]: r["subroot"] for r in merkle.roots(documents.repartition(7)).collect()}
    assert again == {s: r["subroot"] for s, r in rows.items()}
