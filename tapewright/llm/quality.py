"""Quality rules: gradient-boosted trees over document statistics, with fixed base rules before them.

Trees are grown on histograms with monotonic constraints (a larger share of symbols, repeated words
or repeated lines never raises the score) and flattened into numpy node arrays, which score a whole
batch of documents level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import staged, text_table
from tapewright.llm.substrings import PASS_BYTES, Stretch, word_hashes

#: Counts of a document, in the order in which they are computed.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper", "n_marks", "n_other_bytes")
#: Features of the trees and the direction in which each may move the score (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "line_words": 0,
    "distinct_share": 0, "digit_share": 0, "upper_share": 0, "mark_share": 0, "other_share": 0,
}
WINDOW = 5

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_STARTS = (np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)  # bytes that begin a code point
_DIGITS, _UPPER = (np.isin(np.arange(256), list(x)) for x in (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_MARKS = np.isin(np.arange(256), list(b".,;:!?\"'()-"))
_OTHER = np.arange(256) >= 0x80


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and lines with a word."""
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: list[bytes]) -> np.ndarray:
    """(texts, COUNTS) of whole UTF-8 texts."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    salt = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out[:, 0] = counts
    out[:, 6] = np.bincount(doc[np.unique(words ^ salt, return_index=True)[1]], minlength=len(texts))
    if len(words) >= WINDOW:
        s = np.arange(len(words) - WINDOW + 1)
        s = s[doc[s] == doc[s + WINDOW - 1]]
        _, kind, often = np.unique(Stretch(words, 0xD1342543DE82EF97).of(s, s + WINDOW) ^ salt[s], return_inverse=True, return_counts=True)
        again = s[often[kind] > 1]
        edge = np.bincount(again, minlength=len(words) + 1) - np.bincount(again + WINDOW, minlength=len(words) + 1)
        out[:, 4] = np.bincount(doc, np.cumsum(edge)[:-1] > 0, len(texts))
    for i, t in enumerate(texts):
        seen = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        out[i, 1] = seen[_STARTS & ~_BLANK].sum()
        out[i, 2] = seen[_SYMBOLS].sum()
        out[i, 3], out[i, 5] = duplicate_lines(t)
        out[i, 7:] = [seen[m].sum() for m in (_DIGITS, _UPPER, _MARKS, _OTHER)]
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) from (documents, COUNTS)."""
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_words"] / lines,
            c["n_distinct"] / words, c["n_digits"] / chars, c["n_upper"] / chars, c["n_marks"] / chars, c["n_other_bytes"] / chars,
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Node arrays of all trees; a leaf's feature is -1. roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality 1 for every row, all trees at once, one level after the other."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            down = np.where(x[row, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(f < 0, node, down)
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 10, ridge: float = 1.0, signs=tuple(FEATURES.values())) -> Trees:
    """Boosts log-loss. A split on a constrained feature must order its children's values, and their
    subtrees stay on their side of the middle between them, so whole trees are monotonic."""
    nodes, roots = [], []
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        trees = 0
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if trees else []
    code = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1) if trees else None
    total = np.full(len(y), base)

    def split(rows, g, h, low, high, level):
        me = len(nodes)
        G, H = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, me, me, float(np.clip(-G / (H + ridge), low, high)) * rate])
        best = (1e-6, None)
        for f, e in enumerate(edges if level < depth and len(rows) >= 2 * least else []):
            n, gs, hs = (np.cumsum(np.bincount(code[rows, f], w, len(e) + 1))[:-1] for w in (None, g[rows], h[rows]))
            vl, vr = np.clip(-gs / (hs + ridge), low, high), np.clip(-(G - gs) / (H - hs + ridge), low, high)
            gain = gs**2 / (hs + ridge) + (G - gs) ** 2 / (H - hs + ridge) - G**2 / (H + ridge)
            ok = (n >= least) & (len(rows) - n >= least) & ((vr - vl) * signs[f] >= 0)
            if ok.any() and (top := np.where(ok, gain, -1)).max() > best[0]:
                k = int(top.argmax())
                best = (top[k], (f, k, vl[k], vr[k]))
        if best[1]:
            f, k, vl, vr = best[1]
            mid, goes = (vl + vr) / 2, code[rows, f] <= k
            limits = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
            nodes[me][:2] = [f, float(edges[f][k])]
            nodes[me][2] = split(rows[goes], g, h, *limits[0], level + 1)
            nodes[me][3] = split(rows[~goes], g, h, *limits[1], level + 1)
        return me

    for _ in range(trees):
        q = 1 / (1 + np.exp(-total))
        start = len(nodes)
        roots.append(split(np.arange(len(y)), q - y, q * (1 - q), -4.0, 4.0, 0))
        own = nodes[start:]
        a = [np.array(c) for c in zip(*own, strict=True)]
        one = Trees(a[0].astype(np.int64), a[1], a[2] - start, a[3] - start, a[4], np.array([0]), 0.0, depth)
        s = one.score(x)
        total += np.log(s / (1 - s))
    a = [np.array(c) for c in zip(*nodes, strict=True)] or [np.zeros(0)] * 5
    return Trees(a[0].astype(np.int64), a[1], a[2].astype(np.int64), a[3].astype(np.int64), a[4], np.array(roots, np.int64), base, depth)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS) for every row of docs."""

    def each(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found, lo, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= PASS_BYTES or i == len(texts) - 1:
                    found.append(statistics(texts[lo : i + 1]))
                    lo, size = i + 1, 0
            counts = np.concatenate(found) if found else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, counts.T)], ["doc_id", *COUNTS])

    return text_table(docs).mapInArrow(each, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def fit(counts: DataFrame, labels: DataFrame, sample_docs: int = 20_000, seed: int = 5) -> Trees:
    """Learns quality from at most `sample_docs` labelled documents, those with the lowest seeded hash of doc_id.

    A fifth of the documents (crc32 of doc_id mod 5 is 0) is left out, to measure accuracy on.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id", F.lit(seed))).limit(sample_docs)
    joined = counts.join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "quality", *COUNTS)
    rows = sorted(joined.select("quality", *COUNTS).limit(sample_docs).collect())
    a = np.array([list(r) for r in rows], np.int64).reshape(len(rows), len(COUNTS) + 1)
    return grow(features(a[:, 1:]), a[:, 0])


def judge(counts: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """counts with base_failed, score and kept: false if base_failed, else whether the score reaches `least`."""

    def each(batches):
        for batch in batches:
            c = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in COUNTS], axis=1)
            failed = (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])
            score = model.score(features(c))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))], [*batch.schema.names, "base_failed", "score", "kept"])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "score double", "kept boolean"])
    return counts.select("doc_id", *COUNTS).mapInArrow(each, schema)


def rate_documents(docs: DataFrame, labels: DataFrame, sample_docs: int = 20_000, least: float = 0.5) -> DataFrame:
    """Counts and verdict for every row of docs (doc_id long, text string); labels: doc_id, quality 0/1.

    A null, empty or blank text has 0 words and fails the base rules. Texts of any length count
    whole. Repeated rows come back as often as they came; labels that contradict count as 1. Without
    labels of both kinds the trees are empty and keep what the base rules pass, unless all labels
    are 0. Extra columns are ignored; an empty table gives an empty result.
    """
    counts = staged(counted(docs), "counts")
    return judge(counts, fit(counts, labels, sample_docs), least)
