"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through pigeonhole blocks.

Two fingerprints that differ in at most d bits agree on one of d + 1 blocks. Only distinct
fingerprints are compared; copies of a text meet in the groupBy that makes them distinct. A block
bucket with more than `bucket_rows` fingerprints isn't compared as it is: its undecided bits are cut
into d + 1 blocks again, and so on, which loses no pair. After six cuts at most 2**11 fingerprints
can share a bucket, so buckets are bounded whatever the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import staged, text_table
from tapewright.llm.components import connected_components

#: Cuts after which a bucket is compared whatever its size.
MAX_CUTS = 6


def shingle_hashes(words: list[bytes], shingle_words: int, seed: int) -> np.ndarray:
    """XXH64 of every run of shingle_words words, or of all words if there are fewer."""
    joined = b" ".join(words)
    n = len(words) - shingle_words + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[:n].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in spans), np.uint64, n)


def simhash(text: bytes, shingle_words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; 0 for a text without words."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    return majority(shingle_hashes(words, shingle_words, seed))


def majority(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of shingle hashes: the bits that over half of them have."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over_half = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over_half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def each(batches):
        for batch in batches:
            fps = [simhash(t, shingle_words, seed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return text_table(docs).mapInArrow(each, "doc_id long, fp long")


def block_masks(distance: int) -> list[dict[int, tuple[int, ...]]]:
    """For each cut: path -> masks (as signed longs) of the buckets below it; path 0 is the start."""

    def cut(mask: int, free: list[int]):
        parts = [p for p in np.array_split(np.array(free, dtype=np.int64), distance + 1) if len(p)]
        return [(mask | sum(1 << int(b) for b in p), [b for b in free if b not in set(p.tolist())]) for p in parts]

    level, out = {0: (0, list(range(64)))}, []
    for _ in range(MAX_CUTS):
        below, masks = {}, {}
        for path, (mask, free) in level.items():
            children = cut(mask, free)
            masks[path] = tuple(m - (1 << 64) if m >> 63 else m for m, _ in children)
            below.update({path * (distance + 1) + k + 1: c for k, c in enumerate(children)})
        out.append(masks)
        level = below
    return out


def _close_pairs(groups: np.ndarray, fps: np.ndarray, roots: np.ndarray, distance: int):
    """Edges between rows of one group (rows sorted by group) whose fingerprints are close.

    Small groups: every pair at offsets 1, 2, ... at once. Large groups: a search that takes what is
    close to a reached fingerprint out of those still to be reached, so that a dense group of m costs
    little more than m comparisons; its edges span the group's components.
    """
    a, b = [], []
    start = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    size = np.diff(np.r_[start, len(groups)])
    large = np.repeat(size > 32, size)
    at = np.flatnonzero(~large)
    for k in range(1, 32):
        i = at[: max(0, len(at) - k)]
        j = i + k
        same = (j < len(groups)) & (groups[np.minimum(j, len(groups) - 1)] == groups[i])
        if not same.any():
            break
        i, j = i[same], j[same]
        close = np.bitwise_count(fps[i] ^ fps[j]) <= distance
        a.append(roots[i[close]])
        b.append(roots[j[close]])
    for s, m in zip(start[size > 32], size[size > 32], strict=True):
        f, r = fps[s : s + m], roots[s : s + m]
        left = np.arange(m)
        while len(left):
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                x = reached.pop()
                close = np.bitwise_count(f[left] ^ f[x]) <= distance
                got, left = left[close], left[~close]
                a.append(np.full(len(got), r[x]))
                b.append(r[got])
                reached.extend(got.tolist())
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _linked(buckets: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) inside the buckets (path, key) of rows (path, key, fp, root)."""

    def each(frames):
        held = None
        for frame in frames:
            if not len(frame):
                continue
            rows = frame if held is None else _concat(held, frame)
            same = (rows["path"].to_numpy() == rows["path"].iloc[-1]) & (rows["key"].to_numpy() == rows["key"].iloc[-1])
            cut = len(rows) - int(same.sum())  # rows are sorted: the last bucket may go on in the next frame
            held, rows = rows.iloc[cut:], rows.iloc[:cut]
            yield from pairs(rows)
        if held is not None:
            yield from pairs(held)

    def pairs(rows):
        if len(rows) > 1:
            path, key = rows["path"].to_numpy(), rows["key"].to_numpy()
            groups = np.cumsum(np.r_[False, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
            a, b = _close_pairs(groups, rows["fp"].to_numpy().view(np.uint64), rows["root"].to_numpy(), distance)
            yield _frame(a, b)

    return buckets.repartition("path", "key").sortWithinPartitions("path", "key").mapInPandas(each, "a long, b long")


def _concat(x, y):
    import pandas as pd

    return pd.concat([x, y], ignore_index=True)


def _frame(a, b):
    import pandas as pd

    return pd.DataFrame({"a": a, "b": b})


def close_edges(reps: DataFrame, distance: int = 3, bucket_rows: int = 1024) -> DataFrame:
    """reps: distinct (fp, root). Edges (a, b) between roots that connect all close fingerprints."""
    masks = block_masks(distance)
    rows, edges = reps.select(F.lit(0).alias("path"), "fp", "root"), None
    for cut in range(MAX_CUTS):
        step = F.create_map(*[x for path, ms in masks[cut].items() for x in (F.lit(path), F.array(*map(F.lit, ms)))])
        rows = rows.select("path", "fp", "root", F.posexplode(step[F.col("path")]).alias("k", "mask"))
        rows = rows.select((F.col("path") * (distance + 1) + F.col("k") + 1).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "root")
        rows = staged(rows, "blocks") if cut else rows
        sizes = staged(rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        last = cut == MAX_CUTS - 1
        small = rows.join(sizes if last else sizes.where(F.col("n") <= bucket_rows), ["path", "key"]).select("path", "key", "fp", "root")
        found = staged(_linked(small, distance), "links")
        edges = found if edges is None else edges.union(found)
        if last or sizes.where(F.col("n") > bucket_rows).isEmpty():
            return edges
        rows = rows.join(sizes.where(F.col("n") > bucket_rows), ["path", "key"]).select("path", "fp", "root")
    return edges


def near_duplicates(docs: DataFrame, distance: int = 3, shingle_words: int = 3, seed: int = 42, bucket_rows: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id long, text string).

    Null or empty texts, and texts of white space, have fingerprint 0 and are linked like any other.
    Repeated rows come back as often as they came. A null doc_id is never a component's smallest id,
    but links like any other; component_id is null where all ids of a component are. Extra columns are ignored;
    an empty table gives an empty result.
    """
    fps = staged(fingerprints(docs, shingle_words, seed), "fps")
    # Fingerprints are the nodes of the links, so that rows without id link too; ids come in at the end.
    reps = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "reps")
    components = staged(connected_components(close_edges(reps.select("fp", F.col("fp").alias("root")), distance, bucket_rows)), "components")
    named = reps.join(components, reps["fp"] == components["node"], "left")
    named = staged(named.select("fp", "first_id", F.coalesce("component", "fp").alias("part")), "named")
    smallest = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    labels = staged(named.join(smallest, "part").select("fp", "component_id"), "labels")
    out = fps.join(labels, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
