"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by its `nearest` closest reference vectors (pivots). Inverted lists hold, for
each pivot, the vectors that have it among theirs; two vectors are compared if they share at least
`shared` pivots, and linked if their cosine, in double precision, reaches the threshold.

A pair that shares enough pivots meets in the list of its first common pivot, which is among the
first nearest - shared + 1 of both, so a vector is put into so many lists only. Long lists are cut
into chunks, and every two chunks are compared in a task of their own. Tasks give back sums of
links and edges that connect what is linked, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import staged
from tapewright.llm.components import connected_components

#: Two pivots are less similar than this, so that no dense group of vectors takes up many of them.
PIVOT_COSINE = 0.6


def pivots(sample: list[np.ndarray], wanted: int) -> dict[int, np.ndarray]:
    """At most `wanted` unit vectors by dimension, greedily taken from the sample in its order."""
    out = {}
    for dim in sorted({len(v) for v in sample}):
        x = np.stack([v / np.linalg.norm(v) for v in sample if len(v) == dim])
        near, chosen = np.full(len(x), -1.0), []
        while len(chosen) < wanted and (free := np.flatnonzero(near < PIVOT_COSINE)).size:
            chosen.append(free[0])
            near = np.maximum(near, x @ x[free[0]])
            near[free[0]] = 1.0
        out[dim] = x[chosen]
    return out


def described(x: np.ndarray, refs: np.ndarray | None, nearest: int) -> np.ndarray:
    """(vectors, nearest) numbers of the closest pivots, ascending; only number 0 for a dimension without pivots."""
    if refs is None or not len(refs):
        return np.zeros((len(x), 1), np.int64)
    near = x / np.linalg.norm(x, axis=1, keepdims=True) @ refs.T
    k = min(nearest, len(refs))
    return np.sort(np.argsort(-near, axis=1, kind="stable")[:, :k], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, values) of a list column whose lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _postings(reps: DataFrame, refs: dict[int, np.ndarray], nearest: int, shared: int) -> DataFrame:
    """(dim, p, node, copies, of, v): a row for each list that a vector is in; of: its pivots."""

    def each(batches):
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(sizes):
                own = batch.filter(pa.array(sizes == dim))
                of = described(_matrix(own.column("v")), refs.get(int(dim)), nearest)
                lists = max(1, of.shape[1] - shared + 1)
                row = np.repeat(np.arange(len(own)), lists)
                taken = own.take(pa.array(row))
                sets = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * of.shape[1]), pa.array(of[row].astype(np.int32).ravel()))
                columns = [pa.array(np.full(len(row), dim, np.int32)), pa.array(of[:, :lists].astype(np.int32).ravel()), taken.column("node"), taken.column("copies"), sets, taken.column("v")]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "p", "node", "copies", "of", "v"])

    value = reps.schema["v"].dataType.elementType.simpleString()
    return reps.mapInArrow(each, f"dim int, p int, node long, copies long, of array<int>, v array<{value}>")


def _masks(of: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros((len(of), words), np.uint64)
    for column in of.T:
        out[np.arange(len(of)), column // 64] |= np.uint64(1) << (column % 64).astype(np.uint64)
    return out


def _linked(p: int, left: slice, right: slice, of: np.ndarray, v: np.ndarray, shared: int, cosine: float):
    """Index pairs of linked rows, from left x right, whose first common pivot is p."""
    own, of = np.unique(of, return_inverse=True)  # only the pivots of these rows, in their order
    of, p = of.reshape(len(v), -1), int(np.searchsorted(own, p))
    words = len(own) // 64 + 1
    masks = _masks(of, words)
    below = np.array([(1 << max(0, min(64, p - 64 * w))) - 1 for w in range(words)], np.uint64)
    least = min(shared, of.shape[1])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = [], []
    for lo in range(left.start, left.stop, 256):
        rows = slice(lo, min(lo + 256, left.stop))
        common = np.zeros((rows.stop - rows.start, right.stop - right.start), np.uint8)
        for w in range(words):
            common += np.bitwise_count(masks[rows, w][:, None] & masks[right, w][None, :])
        i, j = np.nonzero(common >= least)
        i, j = i + rows.start, j + right.start
        here = (i < j) & ~(masks[i] & masks[j] & below).any(axis=1)
        i, j = i[here], j[here]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        a.append(i[near])
        b.append(j[near])
    return np.concatenate(a) if a else np.empty(0, np.int64), np.concatenate(b) if b else np.empty(0, np.int64)


def _compare(shared: int, cosine: float):
    """For a group (dim, p, i, j) of two chunks, or one if i = j: (a, b, n) of linked rows: node, smallest node of its part, links."""

    def each(key, table):
        p, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        table = table.combine_chunks().sort_by([("chunk", "ascending"), ("node", "ascending")])
        node, copies, chunk = (table.column(c).to_numpy() for c in ("node", "copies", "chunk"))
        v, of = _matrix(table.column("v").chunk(0)), _matrix(table.column("of").chunk(0)).astype(np.int64)
        cut = int((chunk == i).sum()) if i != j else len(node)
        a, b = _linked(p, slice(0, cut), slice(cut if i != j else 0, len(node)), of, v, shared, cosine)
        n = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        low = node.copy()
        while True:
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            if (new == low).all():
                break
            low = new
        some = np.flatnonzero(n > 0)
        return pa.table({"a": node[some], "b": low[some], "n": n[some].astype(np.int64)})

    return each


def similar_links(reps: DataFrame, cosine: float = 0.95, nearest: int = 12, shared: int = 4, sample: int = 16_384, most_pivots: int = 8192, chunk_rows: int = 4096) -> DataFrame:
    """reps: distinct (node, copies, v). (a, b, n): pieces of the links of a, and an edge to b, perhaps a itself.

    There are about 4 sqrt(vectors) pivots, `most_pivots` at most; beyond that, from about four
    million vectors on, lists grow with their number.
    """
    count = reps.count()
    wanted = min(most_pivots, 1 << max(4, round(math.log2(4 * math.sqrt(max(1, count))))))
    drawn = reps.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(min(sample, max(4096, 2 * wanted))).select("v").collect()
    refs = pivots([np.array(r["v"], float) for r in drawn], wanted)
    rows = staged(_postings(reps, refs, nearest, shared), "postings")
    sizes = rows.groupBy("dim", "p").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))
    dealt = rows.join(staged(sizes, "sizes"), ["dim", "p"]).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = dealt.select("dim", "p", "node", "copies", "of", "v", "chunk", other)
    dealt = dealt.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other")
    return dealt.groupBy("dim", "p", "i", "j").applyInArrow(_compare(shared, cosine), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, **index) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id long, embedding array of floats).

    n_links counts the other vectors linked directly, copies included; component_id is the smallest
    vec_id reachable by links. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different dimensions with one another. Equal
    vectors always link and are compared as one; repeated rows are vectors of their own. Rows whose
    vec_id is null link like others, and others through them; a component without any id is null, and
    such rows are kept. Other columns are ignored; an empty table gives an empty result.
    """
    v = F.col("embedding")
    if vectors.schema["embedding"].dataType.elementType.simpleString() not in ("float", "double"):
        v = v.cast("array<double>")
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), v).alias("v"))
    rows = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"))
    ids = staged(rows.select("vec_id", "h1", "h2"), "ids")
    reps = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    # Nodes of the links are numbers of their own, fixed as the table is written, so that rows without id link too.
    reps = staged(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    found = staged(similar_links(reps.select("node", "copies", "v"), cosine, **index), "found")
    sums = found.groupBy("a").agg(F.sum("n").alias("n"))
    components = connected_components(found.select("a", "b"))
    named = reps.drop("v").join(sums, F.col("node") == F.col("a"), "left").drop("a")
    named = named.join(components.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    links = (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    named = staged(named.select("h1", "h2", "first_id", links, F.coalesce("component", "node").alias("part")), "named")
    smallest = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    labels = staged(named.join(smallest, "part").select("h1", "h2", "n_links", "component_id"), "labels")
    out = ids.join(labels, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


#: The same by comparing every two vectors.
SQL = """
WITH RECURSIVE sound AS (
    SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.k <> b.k AND len(a.v) = len(b.v)
    AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.95
), reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), low AS (
    SELECT a, min(b) AS component_id FROM reached GROUP BY a
), counts AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""
