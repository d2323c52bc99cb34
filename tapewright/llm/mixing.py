"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Each source's documents are dealt to shards by hash; a (source, shard) cell is one stream of words
in seeded order, cut into equal blocks. Blocks are apportioned to the sources by highest quotients,
then each source's quota to its cells the same way. A cell takes all its blocks quota // blocks
times and the rest of its quota by a seeded permutation of its blocks.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import WORD, gapless_rank, staged

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Most copies of a source or document in the mix.
MOST = 3
#: Most rows of the table of cells, which the driver apportions.
CELLS = 1_000_000


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * size; what is over goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(weights: np.ndarray, seats: int, limits: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients weight / (2 k + 1), at most limits; ties go to the lower index.

    A divisor found by bisection gives the seats whose quotients are surely among the highest, a heap
    the few that are left.
    """
    weights, limits = np.asarray(weights, float), np.asarray(limits, np.int64)
    seats = min(int(seats), int(limits[weights > 0].sum()))

    def at(divisor):
        return np.minimum(np.floor(weights / divisor + 0.5), limits).astype(np.int64)

    got = np.zeros(len(weights), np.int64)
    if seats > 0:
        low, high = 0.0, 2 * weights.max() + 1
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if mid > 0 and at(mid).sum() > seats else (low, mid)
        got = at(high)
        if got.sum() > seats:  # quotients too close for the bisection
            got[:] = 0
        heap = [(-weights[i] / (2 * got[i] + 1), i) for i in range(len(weights)) if weights[i] > 0 and got[i] < limits[i]]
        heapq.heapify(heap)
        for _ in range(seats - int(got.sum())):
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < limits[i]:
                heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _quotas(cells: dict[tuple[int, int], int], wanted: list[float], block_words: int, seed: int):
    """cells: words by (source, shard). Rows (source, shard, words, blocks, quota, seed)."""
    keys = sorted(k for k, n in cells.items() if n > 0)
    words = np.array([cells[k] for k in keys], np.int64)
    blocks = np.maximum(1, np.rint(words / block_words)).astype(np.int64)
    source = np.array([k[0] for k in keys], np.int64)
    n_source, b_source = (np.bincount(source, x, len(wanted)) for x in (words, blocks))
    in_blocks = np.divide(np.array(wanted) * b_source, n_source, out=np.zeros(len(wanted)), where=n_source > 0)
    quota_of = sainte_lague(in_blocks, round(float(in_blocks.sum())), MOST * b_source.astype(np.int64))
    quota = np.zeros(len(keys), np.int64)
    for s in range(len(wanted)):
        at = np.flatnonzero(source == s)
        quota[at] = sainte_lague(blocks[at], int(quota_of[s]), MOST * blocks[at])
    rows = []
    for k, n, b, q in zip(keys, words.tolist(), blocks.tolist(), quota.tolist(), strict=True):
        rows.append((*k, n, b, q, zlib.crc32(f"{seed}:{k[0]}:{k[1]}".encode())))
    return rows


def permuted(i: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Place of i in a permutation of 0 ... n - 1 that the seed gives: a Feistel network over the next
    power of four, gone through again while the place isn't below n."""
    i, seed = i.astype(np.uint64), seed.astype(np.uint64)
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = i.copy(), np.arange(len(i))
    while len(open_):
        x, h, m, s = out[open_], half[open_], low[open_], seed[open_]
        left, right = x >> h, x & m
        for k in range(4):
            f = (right + s * np.uint64(2 * k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((f >> np.uint64(33)) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= n[open_].astype(np.uint64)]
    return out.astype(np.int64)


def _sizes(docs: DataFrame, *more) -> DataFrame:
    """`more`, and (doc_id, source, text_md5, size) of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*more, F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.md5(text).alias("text_md5"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of every row of docs (doc_id long, text string, source string); see `mix_sizes`."""
    return mix_sizes(staged(_sizes(docs), "sizes"), **options).drop("source", "copy")


def mix_sizes(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block_words: int = 64, shard_rows: int = 1024, seed: int = 7) -> DataFrame:
    """What the mix takes of every row of sizes: (doc_id, source, text_md5, size).

    Sources are ordered by code point, null last, and weigh `weights` in turn. Returns doc_id, source,
    text_md5, copy, size (words), source_size, target, epochs (whole copies taken), ranges (array of
    {lo, hi}: words taken once more) and taken (words, repeats counted). Null and empty texts have
    size 0 and nothing of them is taken. Repeated rows count as often as they come: they are placed
    as one, one after the other, and told apart by copy (0, 1, ...). A null doc_id is a row like any
    other. An empty table gives an empty result. Shards: a power of two near rows / shard_rows, and no
    more than CELLS cells; cells are windows in Spark, only their sums go to the driver.
    """
    spark = sizes.sparkSession
    found = [(r["source"], r["size"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([r[1] for r in found], [weights[i % len(weights)] for i in range(len(found))])
    table = spark.createDataFrame([(r[0], i, r[1], wanted[i]) for i, r in enumerate(found)], "name string, src int, source_size long, target double")
    rows = sum(r[2] for r in found)
    shards = max(1, min(1 << max(0, round(math.log2(max(1, rows / shard_rows)))), CELLS // max(1, len(found))))
    order, shard = F.xxhash64("doc_id", "text_md5", F.lit(seed)), F.pmod(F.xxhash64("doc_id", "text_md5", F.lit(seed + 1)), F.lit(shards)).cast("int")
    alike = sizes.groupBy("doc_id", "source", "text_md5", "size").agg(F.count(F.lit(1)).alias("n"))
    cells = alike.join(table, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumns({"order": order, "shard": shard})
    cells = staged(cells, "cells")
    sums = {(r["src"], r["shard"]): r["n"] for r in cells.groupBy("src", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()}
    quotas = spark.createDataFrame(_quotas(sums, wanted, block_words, seed), "src int, shard int, words long, blocks long, quota long, seed long")
    before = Window.partitionBy("src", "shard").orderBy("order", "doc_id", "size", "text_md5").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)))
    placed = placed.join(quotas, ["src", "shard"], "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    names = ["doc_id", "source", "text_md5", "copy", "size", "source_size", "target"]
    placed = placed.select(*names, (F.col("start") + F.col("copy") * F.col("size")).alias("start"), "words", "blocks", "quota", "seed")

    def each(batches):
        for batch in batches:
            c = {k: batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("size", "start", "words", "blocks", "quota", "seed")}
            epochs, ranges, taken = _taken(c)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(epochs), ranges, pa.array(taken)], [*names, "epochs", "ranges", "taken"])

    return placed.mapInArrow(each, "doc_id long, source string, text_md5 string, copy long, size long, source_size long, target double, epochs long, ranges array<struct<lo:long,hi:long>>, taken long")


def apply(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: whole copies of a row, and one row more for words taken beside them.

    That row's text is the chosen blocks, each as it stands in the text, joined by line breaks;
    n_chars is set anew in it. Rows of which nothing is taken go. Rows that repeat a doc_id, source
    and text are told apart by a row number that is fixed as the table is written; whatever the
    columns are called, they come back as they were.
    """
    rows = _sizes(docs, F.struct(*docs.columns).alias("row"))
    rows = staged(rows.withColumn("k", F.monotonically_increasing_id()), "rows")
    key = ["doc_id", "source", "text_md5"]
    sizes = rows.select(*key, "size", "k")
    mixed = staged(mix_sizes(sizes.drop("k"), **options).where("taken > 0").select(*key, "copy", "epochs", "ranges"), "mixed")
    again = staged(mixed.where("copy > 0").select(*key).distinct(), "again")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    if again.isEmpty():
        numbered = sizes.select(*key, "k", F.lit(0).cast("long").alias("copy"))
    else:  # number what may repeat, in parts, so that a very large group is no single task
        numbered = gapless_rank(sizes.select(*key, "k"), key, ["k"], 64, "copy")
    taken = numbered.alias("a").join(mixed.alias("b"), [*same, F.col("a.copy") == F.col("b.copy")]).select("k", "epochs", "ranges")
    chosen = rows.select("row", "k").join(taken, "k").select("row", "epochs", "ranges")

    def each(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                yield from _copies(batch.slice(lo, 500))

    return chosen.mapInArrow(each, docs.schema)


def _copies(batch: pa.RecordBatch):
    row = batch.column("row")
    names = [f.name for f in row.type]
    own = pa.RecordBatch.from_arrays(row.flatten(), names)
    texts = own.column("text").cast(pa.binary()).to_pylist()
    at, new = [], []
    for i, (n, ranges) in enumerate(zip(batch.column("epochs").to_pylist(), batch.column("ranges").to_pylist(), strict=True)):
        at += [i] * n
        new += [None] * n
        if ranges:
            space = _SPACE[np.frombuffer(texts[i], np.uint8)]
            start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
            end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
            at.append(i)
            new.append(b"\n".join(texts[i][start[r["lo"]] : end[r["hi"] - 1]] for r in ranges))
    if at:
        taken = own.take(pa.array(at))
        columns = dict(zip(names, taken.columns, strict=True))
        made = pa.array([t if t is not None else texts[i] for i, t in zip(at, new, strict=True)], pa.binary())
        columns["text"] = made.cast(columns["text"].type)
        if "n_chars" in columns:
            old = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([o if t is None else len(t.decode("utf-8", "replace")) for o, t in zip(old, new, strict=True)], columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names)


def _taken(c: dict):
    """Epochs, extra ranges and words taken of documents that lie in their cells' streams at start.

    Block i of a cell of n words and b blocks is the words from ceil(i n / b) to ceil((i + 1) n / b);
    it is among the quota % b chosen ones if its place in the cell's permutation is below that number.
    """
    size, start = c["size"], c["start"]
    n, b = np.maximum(c["words"], 1), np.maximum(c["blocks"], 1)
    epochs, extra = c["quota"] // b, c["quota"] % b
    some = (size > 0) & (extra > 0)
    first = start * b // n
    last = np.where(some, (start + np.maximum(size, 1) - 1) * b // n, first - 1)
    count = last - first + 1
    row = np.repeat(np.arange(len(size)), count)
    i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
    chosen = permuted(i, b[row], c["seed"][row]) < extra[row]
    row, i = row[chosen], i[chosen]
    lo = np.maximum(-(-i * n[row] // b[row]) - start[row], 0)
    hi = np.minimum(-(-(i + 1) * n[row] // b[row]) - start[row], size[row])
    row, lo, hi = (x[hi > lo] for x in (row, lo, hi))
    taken = epochs * size + np.bincount(row, hi - lo, len(size)).astype(np.int64)
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(size)))].astype(np.int32)
    ranges = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], ["lo", "hi"]))
    return np.where(size > 0, epochs, 0), ranges, taken
