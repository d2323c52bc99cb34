"""The pipeline's near-duplicates: SimHash pigeonhole blocks, verified by the Jaccard similarity of word shingles.

Fingerprints within a few bits of each other, found by op8's blocks, are verified on their shingle
sets: that finds copies, and most near copies, of large groups at little cost. A fingerprint of 64
bits can't tell a similarity of 0.8 (about ten bits) from chance, so what the blocks don't connect
goes through an exact search, and no pair is lost: two sets of similarity t or more share one of the
first n - ceil(t * n) + 1 members of each, n being its size, in any order of members that holds for
all sets. Only those members become keys. The order puts shingles that a sample shows to be common
last, so that keys are rare; what the sample holds changes the work, never the result.

Where many sets share a key, they are first compared with one of them, then with others that each key
draws by lot, and what that links needs no further comparison: a large group of near copies costs a
few comparisons for each key of a set. Then the pairs that aren't connected yet are compared, all of them. Pairs that can't be similar are left out by bounds
first: sets differ in no fewer members than their parity bits do. In the last comparison the rows of crowded
keys hold those bits, so that the join itself leaves such pairs out and none of them is written or shuffled; a
crowd of different sets costs a comparison of bits for each pair and key, in tasks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import release, staged, text_table
from tapewright.llm.components import connected_components
from tapewright.llm.simhash import close_edges, majority, shingle_hashes

#: One text of so many is in the sample, a shingle of so many texts there is common, and at most so many are put last.
SAMPLED, COMMON, COMMON_KEPT = 8, 4, 100_000
#: Rounds in which the sets of a key are compared with one of them, if there are more than so many.
ROUNDS, MANY = 3, 32
#: Words of 64 parity bits of a set.
PARITY = 16
#: A key of more rows than this is compared in blocks of about so many, each with all rows of the key.
BLOCK = 2_048


def signature(text: bytes) -> int:
    """Hash of the lower-case words, as a signed long; texts that have it in common are copies."""
    h = xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))
    return h - (1 << 64) if h >> 63 else h


def shingle_set(text: bytes, shingle_words: int, seed: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; empty for a text without words."""
    words = text.lower().split()
    return np.unique(shingle_hashes(words, shingle_words, seed)) if words else np.empty(0, np.uint64)


def parity(members: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY parts of the members whether their number is odd, as signed longs."""
    odd = np.bincount((members % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) % 2
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def keys(members: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members of a set; common: sorted hashes that come last, by rank."""
    n = len(members)
    taken = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
    if not len(common):
        return members[:taken]
    at = np.minimum(np.searchsorted(common, members), len(common) - 1)
    late = np.where(common[at] == members, rank[at], 0)
    return members[np.lexsort((members, late))[:taken]]


def _each_text(make, names: list[str]):
    """make(text) -> arrays of one length for `names`; a row each, after the text's signature."""

    def each(batches):
        for batch in batches:
            signs, parts = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                sign = signature(text)
                made = make(text, sign)
                signs.append(np.full(len(made[0]), sign, np.int64))
                parts.append(made)
            columns = [np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64) for c in zip(*parts, strict=True)] or [np.empty(0, np.int64)] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *signs])), *map(pa.array, columns)], ["sign", *names])

    return each


def _common(texts: DataFrame, shingle_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rank) of the shingles that are common in the sample."""

    def make(text, sign):
        return (shingle_set(text, shingle_words, seed).view(np.int64) if sign % SAMPLED == 0 else np.empty(0, np.int64),)

    counts = texts.select("text").mapInArrow(_each_text(make, ["key"]), "sign long, key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(COMMON_KEPT).toArrow()
    hashes = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


def _alike(one: str, other: str, similarity: float):
    """Whether sets of the sizes and parity bits in size<one>, bits<one>, size<other>, bits<other> may be similar enough."""
    differing = F.expr(" + ".join(f"bit_count(bits{one}[{k}] ^ bits{other}[{k}])" for k in range(PARITY)))
    most = (F.col(f"size{one}") + F.col(f"size{other}")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return differing <= most


def _unconnected(rows: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """All pairs of rows of one key and two parts, without those of crowded keys whose parity bits forbid the similarity.

    The second row's columns end in 2. Keys of MANY rows or fewer give at most so many pairs for each
    row. A row of a larger key takes its bits along; such keys are dealt to blocks by signature, and
    every block meets all rows of its key, so no pair is lost, and rows are copied once for each BLOCK.
    """
    own = ["sign", "size", "rest", "part"]
    second = lambda names: [F.col(c).alias(f"{c}2") for c in names]
    counts = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY), "crowds")
    few = rows.join(counts, "key", "left_anti").select("key", *own)
    few = few.join(few.select("key", *second(own)), "key").where("part < part2")
    crowd = rows.join(counts.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    crowd = staged(crowd.join(roots.select("sign", "bits"), "sign"), "parities")
    one = crowd.select("key", F.pmod(F.xxhash64("sign"), F.col("blocks")).cast("int").alias("block"), *own, "bits")
    other = crowd.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *second([*own, "bits"]))
    many = one.join(other, ["key", "block"]).where("part < part2").where(_alike("", "2", similarity))
    return few.unionByName(many.select(*few.columns))


def _verified(found: DataFrame, docs: DataFrame, roots: DataFrame, similarity: float, shingle_words: int, seed: int) -> DataFrame:
    """The pairs (a, b) of signatures whose shingle sets are similar enough."""

    def each(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sets = [shingle_set(t, shingle_words, seed).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([signature(t) for t in texts], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["sign", "members"])

    both = found.distinct()
    for c in "ab":
        both = both.join(roots.select(F.col("sign").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    found = staged(both.where(_alike("_a", "_b", similarity)).select("a", "b"), "candidates")
    nodes = found.select(F.col("a").alias("sign")).union(found.select("b")).distinct()
    ids = roots.join(nodes, "sign", "left_semi").select(F.col("root").alias("doc_id"))
    texts = text_table(docs).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    sets = staged(texts.mapInArrow(each, "sign long, members array<long>").dropDuplicates(["sign"]), "sets")
    both = found.join(sets.select(F.col("sign").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("sign").alias("b"), F.col("members").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    near = shared / (F.size("x") + F.size("y") - shared) >= F.lit(similarity)
    verified = staged(both.where(near).select("a", "b"), "near")
    release(found, sets)
    return verified


def _components(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """rows, a staged table that is read for the last time, with the component of each signature, without keys whose sets are all connected."""
    parts = connected_components(edges)
    named = rows.drop("part").join(parts, rows["sign"] == parts["node"], "left").withColumn("part", F.coalesce("component", "sign")).drop("node", "component")
    named = staged(named, "named")
    out = staged(_open(named, "part"), "open")
    release(named, rows)
    return out


def _open(rows: DataFrame, part: str) -> DataFrame:
    """rows of the keys that more than one `part` has."""
    split = rows.groupBy("key").agg(F.min(part).alias("low"), F.max(part).alias("high")).where("low != high")
    return rows.join(split.select("key"), "key", "left_semi")


def _close_fingerprints(roots: DataFrame) -> DataFrame:
    """Edges (a, b) of signatures that connect all whose fingerprints are close."""
    roots = roots.select("sign", "fp")
    reps = staged(roots.groupBy("fp").agg(F.min("sign").alias("root")), "fps")
    alike = roots.join(reps, "fp").where("sign != root").select(F.col("root").alias("a"), F.col("sign").alias("b"))
    return close_edges(reps).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(alike)


def similar_pairs(docs: DataFrame, roots: DataFrame, similarity: float, shingle_words: int, seed: int) -> DataFrame:
    """Edges (a, b) of signatures that connect all texts of docs with similar shingle sets."""
    texts = text_table(docs)
    common, rank = _common(texts, shingle_words, seed)
    cast = texts.sparkSession.sparkContext.broadcast((common, rank))

    def make(text, sign):
        members = shingle_set(text, shingle_words, seed)
        first = keys(members, similarity, *cast.value)
        return first.view(np.int64), np.full(len(first), len(members)), len(members) - np.arange(len(first))

    rows = texts.select("text").mapInArrow(_each_text(make, ["key", "size", "rest"]), "sign long, key long, size long, rest long")
    every = staged(rows.select("key", "sign", F.col("size").cast("int"), F.col("rest").cast("int")), "keys")
    rows = staged(_open(every, "sign").dropDuplicates(["key", "sign"]).withColumn("part", F.col("sign")), "keyed")
    release(every)

    def compared(pairs):
        # Sets of these sizes, of which no member before this key is shared, may still share enough.
        may = F.least("rest", "rest2") * (1 + similarity) >= (F.col("size") + F.col("size2")) * similarity - 1e-6
        pairs = pairs.where(may).select(F.least("sign", "sign2").alias("a"), F.greatest("sign", "sign2").alias("b"))
        return _verified(pairs, docs, roots, similarity, shingle_words, seed)

    own = ("sign", "size", "rest", "part")
    edges = _verified(_close_fingerprints(roots), docs, roots, similarity, shingle_words, seed)
    rows = _components(edges, rows)
    for k in range(ROUNDS):
        hot = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("key"), "hot")
        if hot.isEmpty():
            break
        crowd, lot = rows.join(hot, "key"), F.xxhash64(F.lit(k), "key", "sign")
        if k == 0:
            # The set that has most of these keys is the middle of its group: the text that others are copies of.
            fame = crowd.groupBy("sign").agg(F.count(F.lit(1)).alias("fame"))
            crowd, lot = crowd.join(fame, "sign"), F.struct("fame", F.xxhash64("sign"))
        # Later every key draws its own, so a set far from the middle meets as many others as it has keys.
        many = staged(crowd.groupBy("key").agg(F.max_by(F.struct(*own), lot).alias("one")), "many")
        near = compared(rows.join(many.select("key", *[F.col(f"one.{c}").alias(f"{c}2") for c in own]), "key").where("part != part2"))
        edges = edges.union(near)
        rows = _components(edges, rows)
    near = compared(_unconnected(rows, roots, similarity))
    return edges.union(near)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, component_id) for every row of docs that has a doc_id.

    Texts are linked if their sets of shingles have a Jaccard similarity of `similarity` or more, or
    if their lower-case words are the same; a text of fewer words than a shingle is one shingle.
    """

    def each(batches):
        for batch in batches:
            signs, sizes, bits, fps = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.lower().split()
                hashes = shingle_hashes(words, shingle_words, seed) if words else np.empty(0, np.uint64)
                members = np.unique(hashes)
                signs.append(signature(text))
                sizes.append(len(members))
                bits.append(parity(members))
                fps.append(majority(hashes))
            columns = [pa.array(signs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "sign", "size", "bits", "fp"])

    docs = docs.where("doc_id is not null")
    fps = staged(text_table(docs).mapInArrow(each, "doc_id long, sign long, size int, bits array<long>, fp long"), "signs")
    firsts = (F.first(c).alias(c) for c in ("size", "bits", "fp"))  # the same for all of a signature
    roots = staged(fps.groupBy("sign").agg(F.min("doc_id").alias("root"), *firsts), "roots")
    edges = similar_pairs(docs, roots, similarity, shingle_words, seed)
    for c in ("a", "b"):
        edges = edges.join(roots.select("sign", "root"), F.col(c) == F.col("sign")).drop(c, "sign").withColumnRenamed("root", c)
    parts = connected_components(edges)
    named = staged(roots.join(parts, roots["root"] == parts["node"], "left").select("sign", F.coalesce("component", "root").alias("component_id")), "named")
    return fps.join(named, "sign").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the near-duplicates of a document with a smaller doc_id.

    Rows with one doc_id are one document and go or stay together; of rows that repeat a doc_id and
    its text one stays. Rows whose doc_id is null stay. Null and empty texts, and those without
    words, are copies of one another. An empty table gives an empty result.
    """
    found = staged(near_duplicates(docs, **options), "near")
    later = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(later, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is null").union(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
