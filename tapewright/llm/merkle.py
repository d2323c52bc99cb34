"""Merkle dataset manifest: a tree over each source, a tree over the sources, and a proof for every row.

Nodes are appended to open subtrees of `FAN` children. Every node keeps a partial witness, the
siblings on its way up so far; when a run of siblings is complete, the witnesses of all nodes below
it grow by what stands left and right of their own branch. Rows are dealt into aligned blocks, one
append stream each, whose roots are appended to the level above in the same way; the witnesses of
those roots then complete the witnesses of the rows. No task sees more than a block at a time, and
a source may have any number of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import staged

#: Children of a node.
FAN = 16
#: Levels inside a block: FAN ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 2
BLOCK = FAN**BLOCK_LEVELS
#: The columns of a leaf, in the order in which they are hashed.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What stands left and right of a node among its siblings, as joined hex digests, from the bottom up.
Witness = list[tuple[str, str]]


def node(children: str) -> str:
    """Digest of joined hex digests."""
    return hashlib.sha256(children.encode()).hexdigest()


class Subtrees:
    """Open subtrees under aligned appends of nodes that come in order."""

    def __init__(self, levels: int):
        self.open: list[list[tuple[str, list[Witness]]]] = [[] for _ in range(levels)]
        self.root: str | None = None

    def append(self, digest: str, below: list[Witness], level: int = 0) -> None:
        """Adds a node and the witnesses of what is below it; they grow whenever a run of siblings is complete."""
        if level == len(self.open):
            self.root = digest
            return
        self.open[level].append((digest, below))
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        joined = "".join(digest for digest, _ in run)
        all_below = []
        for k, (digest, below) in enumerate(run):
            step = (joined[: k * len(digest)], joined[(k + 1) * len(digest) :])
            for witness in below:
                witness.append(step)
            all_below += below
        self.append(node(joined), all_below, level + 1)

    def close(self) -> str:
        """The root, after runs that aren't full are completed as they are."""
        for level in range(len(self.open)):
            if self.open[level]:
                self._complete(level)
        return self.root


def levels_of(n: int) -> int:
    """Levels of a block in a tree of n nodes: as many as n needs, at most BLOCK_LEVELS."""
    levels = 0
    while levels < BLOCK_LEVELS and FAN**levels < n:
        levels += 1
    return levels


def fold(digest: str, witness: Witness) -> str:
    """The root that a digest and its siblings lead to."""
    for left, right in witness:
        digest = node(left + digest + right)
    return digest


def proof(*witnesses: Witness) -> str:
    """Digest of all siblings, level by level, left to right."""
    state = hashlib.sha256()
    for witness in witnesses:
        for left, right in witness:
            state.update(left.encode())
            state.update(right.encode())
    return state.hexdigest()


def field(column) -> F.Column:
    """A value as it is hashed: `-` if null, else its UTF-8 length, a colon and itself."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: F.Column | None = None) -> DataFrame:
    """(doc_id, tree, leaf, forged): forged is the leaf after text's capitals are lowered where `tampered` holds, else null.

    tree names the row's source; it sorts as sources do, null first, in the order of UTF-8 bytes.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:])
    if tampered is None:
        tampered = F.lit(False)
    forged_text = F.when(tampered, F.translate("text", CAPITALS, SMALL))
    head = F.concat(*[field(c) for c in COLUMNS[:-1]])
    return own.withColumn("_forged", forged_text).select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
        F.sha2(F.concat(head, field("text")), 256).alias("leaf"),
        F.when(tampered, F.sha2(F.concat(head, field("_forged")), 256)).alias("forged"),
    )


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `rank`, gapless from 0 inside each tree in the given order, and `n`, the tree's rows; the result is staged.

    Rows are dealt by ranges of (tree, order), so a large tree lies in many parts; each part numbers its
    own rows and the parts' counts give the offsets. Rows that are equal in all of `order` may be
    numbered either way round; a last, arbitrary key deals many of them to several parts.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["tree", *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*keys).drop("_tie")
    fields = [*dealt.schema.fieldNames(), "_place"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, k = None, 0
        for batch in batches:
            places = []
            for t in batch.column("tree").to_pylist():
                if t != tree:
                    tree, k = t, 0
                places.append(k)
                k += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], fields)

    kept = staged(dealt.mapInArrow(numbered, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema.fields)}, _place long"), name)
    counts = kept.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(by_tree).alias("n"))
    joined = kept.join(offsets, ["tree", "_part"])
    return joined.withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


NODES = "tree string, n long, rank long, digest string"
WITNESSES = "tree string, rank long, lefts array<string>, rights array<string>"


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows with `block`, one block after the other, in order of rank."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["block"]) != key:
                if held:
                    yield held
                held, key = [], (row["tree"], row["block"])
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[list], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list = []
    for more in rows:
        held += more
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


_NODES_ARROW = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("rank", pa.int64()), ("digest", pa.string())])
_WITNESSES_ARROW = pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))])


def _parents(nodes: DataFrame) -> DataFrame:
    """The roots of the nodes' blocks, which are the nodes of the level above."""

    def each(batches):
        def roots():
            for rows in _runs(batches):
                first = rows[0]
                stream = Subtrees(levels_of(first["n"]))
                for r in rows:
                    stream.append(r["digest"], [])
                yield [(first["tree"], -(-first["n"] // BLOCK), first["block"], stream.close())]

        return _batches(roots(), _NODES_ARROW)

    return _in_blocks(nodes.withColumn("block", F.expr(f"rank div {BLOCK}"))).mapInArrow(each, NODES)


def _with_upper(nodes: DataFrame, upper: DataFrame, each, schema: str) -> DataFrame:
    """mapInArrow over blocks that begin with the row of their root's witness, as rank -1."""
    empty = F.lit(None)
    own = nodes.withColumn("block", F.expr(f"rank div {BLOCK}")).withColumn("lefts", empty.cast("array<string>")).withColumn("rights", empty.cast("array<string>"))
    above = upper.select("tree", F.col("rank").alias("block"), F.lit(-1).cast("long").alias("rank"), "lefts", "rights")
    return _in_blocks(own.unionByName(above, allowMissingColumns=True)).mapInArrow(each, schema)


def _open_block(rows: list[dict]) -> tuple[Witness, list[tuple[dict, Witness]], str]:
    """The witness above a block, and its rows with their witnesses inside it, and its root, as streamed appends leave them."""
    above = list(zip(rows[0]["lefts"], rows[0]["rights"], strict=True))
    stream, held = Subtrees(levels_of(rows[1]["n"])), []
    for r in rows[1:]:
        witness: Witness = []
        held.append((r, witness))
        stream.append(r["digest"], [witness])
    return above, held, stream.close()


def _lowered(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Witnesses of the nodes from the witnesses of their blocks' roots."""

    def each(batches):
        def made():
            for rows in _runs(batches):
                above, held, _ = _open_block(rows)
                yield [(r["tree"], r["rank"], [left for left, _ in w + above], [right for _, right in w + above]) for r, w in held]

        return _batches(made(), _WITNESSES_ARROW, 200)

    return _with_upper(nodes, upper, each, WITNESSES)


def _climb(nodes: DataFrame, largest: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round but the last, which has one node, the root, for each tree, and that last one."""
    rounds = []
    while True:
        rounds.append(nodes)
        nodes = staged(_parents(nodes), name)
        largest = -(-largest // BLOCK)
        if largest <= 1:
            return rounds, nodes


def _descend(rounds: list[DataFrame], upper: DataFrame, name: str) -> DataFrame:
    """The witnesses of the blocks' roots of the lowest round, from the witnesses of the trees' roots."""
    for nodes in reversed(rounds[1:]):
        upper = staged(_lowered(nodes, upper), name)
    return upper


def _largest(rows: DataFrame) -> int:
    return rows.agg(F.max("n")).first()[0] or 0


def manifest(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame, DataFrame]:
    """Rounds of the sources' trees, rounds of the tree over them, (tree, subroot), and the root (one row, column digest).

    rows: (tree, n, rank, leaf). Without rows all are empty.
    """
    lowest = rows.select("tree", "n", "rank", F.col("leaf").alias("digest"))
    rounds, subroots = _climb(lowest, _largest(rows), "merkle-source")
    sources = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["of"], "merkle-sources")
    top, root = _climb(sources.select("tree", "n", "rank", "digest"), _largest(sources), "merkle-top")
    return rounds, top, sources.select(F.col("of").alias("tree"), F.col("rank").alias("place"), F.col("digest").alias("subroot")), root


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOFS_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def tamper_fifth() -> F.Column:
    """Every document whose decimal doc_id has a CRC-32 that 5 divides; rows without doc_id are not tampered with."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def prove(docs: DataFrame, tampered: F.Column | None = None) -> DataFrame:
    """Leaf, its source's root, the root, the digest of its proof, and whether the proof holds, for every row of docs.

    docs: doc_id long, source, lang and text string, n_chars long; other columns are ignored. Where
    `tampered` holds, the proof is tried on the row with its text's capitals lowered. Nulls in any
    column are hashed as `-`; rows without doc_id come first in their source, rows without source are a
    source of their own; rows with equal doc_id are ordered by leaf, equal rows either way round. Very
    long texts count whole. An empty table gives an empty result.
    """
    rows = ranked(leaves(docs, tampered), ["doc_id", "leaf"], "merkle-leaves")
    rounds, top, subroots, root = manifest(rows)
    one = staged(root.select("tree", F.lit(0).cast("long").alias("rank"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.col("digest").alias("root")), "merkle-root")
    top_upper = _descend(top, one.drop("root"), "merkle-upper")
    of_sources = _lowered(top[0], top_upper)
    of_trees = of_sources.withColumnRenamed("rank", "place").drop("tree").join(subroots, "place").crossJoin(F.broadcast(one.select("root")))  # the root is one row
    carried = staged(of_trees.select("tree", F.lit(0).cast("long").alias("rank"), "lefts", "rights", "subroot", "root"), "merkle-trees")
    upper = _descend(rounds, carried.select("tree", "rank", "lefts", "rights"), "merkle-blocks")

    def each(batches):
        def made():
            for rows in _runs(batches):
                above, held, _ = _open_block(rows)
                # the steps above the block are the same for all its rows, so their strings are shared
                out = []
                for r, w in held:
                    folded = fold(fold(r["forged"] or r["digest"], w), above)
                    out.append((r["doc_id"], r["digest"], r["subroot"], r["root"], proof(w, above), folded, folded == r["root"]))
                yield out

        return _batches(made(), _PROOFS_ARROW)

    known = rows.withColumnRenamed("leaf", "digest").join(carried.select("tree", "subroot", "root"), "tree")
    return _with_upper(known, upper, each, PROOFS)


def roots(docs: DataFrame) -> DataFrame:
    """The manifest itself: (source, n_rows, subroot, root), one row for each source."""
    rows = ranked(leaves(docs), ["doc_id", "leaf"], "merkle-leaves")
    _, _, subroots, root = manifest(rows)
    sizes = rows.groupBy("tree").agg(F.first("n").alias("n_rows"))
    source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source")
    return subroots.join(sizes, "tree").crossJoin(F.broadcast(root.select(F.col("digest").alias("root")))).select(source, "n_rows", "subroot", "root")


def _sql() -> str:
    """DuckDB SQL of prove(docs, tamper_fifth()): eight levels of each tree, which is enough for 16 ** 8 rows and as many sources."""
    levels = 8
    value = lambda c: f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    bit = "lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8], {bit})), 4294967295)"
    head = " || ".join(value(c) for c in COLUMNS[:-1])
    out = [
        f"WITH marked AS (SELECT *, coalesce({crc} % 5 = 0, false) AS tampered FROM documents)",
        f"hashed AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({head} || {value('text')}) AS leaf, CASE WHEN tampered THEN sha256({head} || {value(f"translate(text, '{CAPITALS}', '{SMALL}')")}) END AS forged FROM marked)",
        "a0 AS (SELECT doc_id, tree, leaf, forged, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM hashed)",
    ]

    def climb(prefix: str, key: str) -> str:
        """Levels prefix0, prefix1, ...: (key, r, h); returns the name of the roots' table."""
        for k in range(levels):
            out.append(f"{prefix}c{k} AS (SELECT {key} AS t, count(*) AS n FROM {prefix}{k} GROUP BY ALL)")
            out.append(
                f"{prefix}{k + 1} AS (SELECT {key}, r // {FAN} AS r, sha256(string_agg(h, '' ORDER BY r)) AS h FROM {prefix}{k} JOIN {prefix}c{k} ON t = {key} WHERE n > 1 GROUP BY {key}, r // {FAN}"
                f" UNION ALL SELECT {key}, r, h FROM {prefix}{k} JOIN {prefix}c{k} ON t = {key} WHERE n = 1)"
            )
        return f"{prefix}{levels}"

    subroots = climb("a", "tree")
    out.append(f"b0 AS (SELECT '' AS top, tree AS of_tree, h, row_number() OVER (ORDER BY tree) - 1 AS r FROM {subroots})")
    top = climb("b", "top")

    def siblings(prefix: str, key: str, k: int) -> str:
        """What stands left and right of each node in its run; nothing where the tree has one node."""
        run = f"(PARTITION BY {key}, r // {FAN} ORDER BY r ROWS BETWEEN"
        return (
            f"{prefix}s{k} AS (SELECT {key}, r, n, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
            f" coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS g FROM {prefix}{k} JOIN {prefix}c{k} ON t = {key})"
        )

    for prefix, key in (("a", "tree"), ("b", "top")):
        out += [siblings(prefix, key, k) for k in range(levels)]

    def walk(start: str, prefix: str, key: str, name: str) -> str:
        """Folds `f` and collects `p` upwards from the rows of `start` (with key, spot, f, p)."""
        previous = start
        for k in range(levels):
            out.append(
                f"{name}{k + 1} AS (SELECT w.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || w.f || s.g) ELSE w.f END AS f, CASE WHEN s.n > 1 THEN w.p || s.l || s.g ELSE w.p END AS p,"
                f" CASE WHEN s.n > 1 THEN w.spot // {FAN} ELSE w.spot END AS spot) FROM {previous} w JOIN {prefix}s{k} s ON s.{key} = w.{key} AND s.r = w.spot)"
            )
            previous = f"{name}{k + 1}"
        return previous

    out.append("w0 AS (SELECT doc_id, tree, leaf, coalesce(forged, leaf) AS f, '' AS p, r AS spot FROM a0)")
    inner = walk("w0", "a", "tree", "w")
    out.append(f"v0 AS (SELECT w.* REPLACE (b0.r AS spot), b0.h AS subroot, '' AS top FROM {inner} w JOIN b0 ON b0.of_tree = w.tree)")
    outer = walk("v0", "b", "top", "v")
    return ", ".join(out) + f" SELECT v.doc_id, v.leaf, v.subroot, t.h AS root, sha256(v.p) AS proof_sha256, v.f AS folded_root, v.f = t.h AS verified FROM {outer} v CROSS JOIN {top} t"


SQL = _sql()
