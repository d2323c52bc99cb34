"""Removal of long repeated passages through recompression.

Words are level-0 symbols. A round merges neighbouring symbols into pairs (where the left one's hash
bit is 0 and the right one's is 1) and runs of equal symbols that stayed unmerged into blocks. A new
symbol's name is a 64-bit hash of what it is made of, so every task gives a pair or run the same
name without a dictionary that all tasks would have to build together, and equal stretches of text
get equal symbols up to a few words from their ends. Each symbol knows the words on which its being
there depends; only symbols that depend on few words serve below.

Every window of `window` words takes the highest symbol inside it as its anchor (ties: smallest
name, then leftmost). Equal windows have equal anchors, so windows that occur twice are found where
anchors, with the words around them, are shared; consecutive windows with one anchor are a stretch.
Names only propose: what shares an anchor is verified on its words, by a 128-bit BLAKE2b digest of them.
Stretches are compared as wholes first. Only where stretches share an anchor but differ, at the ends
of repeats, are their windows compared one by one.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import release, staged

#: Words before and after an anchor's start that a window must hold for the anchor to serve it.
BEFORE, AFTER = 2, 6
ROUNDS = 4
#: Bytes of text handled together.
PASS_BYTES = 2_000_000
#: Stands for a null doc_id: after all others.
NO_ID = (1 << 63) - 1

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D], np.uint64)
_KEY_BASE = 0xD1342543DE82EF95 | 3


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[3]
    return h ^ (h >> np.uint64(29))


@cache
def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64; sizes are rounded up so that few are kept."""
    return _all_powers(base, 1 << max(20, (n - 1).bit_length()))[:n]


class Stretch:
    """Hashes of stretches of a sequence by prefix sums: equal stretches have equal hashes wherever they are."""

    def __init__(self, values: np.ndarray, base: int):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(values)), dtype=np.uint64)])
        self.back = _powers(pow(base, -1, 1 << 64), len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _ODD[4])


class WordHashes(dict):
    """Keyed hashes of words; those met before are kept, up to `most`."""

    def __init__(self, key: int, most: int = 500_000):
        super().__init__()
        self.key, self.most = key, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word, self.key)
        return found


@cache
def _hashes(key: int) -> WordHashes:
    return WordHashes(key)


def word_hashes(texts: list[bytes], key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the number of words of each text."""
    of = _hashes(key).__getitem__
    rows = [np.fromiter(map(of, text.split()), np.uint64) for text in texts]
    return np.concatenate([np.empty(0, np.uint64), *rows]), np.fromiter(map(len, rows), np.int64, len(rows))


def symbols(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word the level and name of the highest symbol that starts there and depends on few words.

    doc: the text of each word. A symbol at word i may serve if its being there depends on words
    i - BEFORE to i + AFTER - 1 only, all of one text.
    """
    best, name = np.zeros(len(words), np.int8), words.copy()
    sym, pos = words, np.arange(len(words))
    low, high = pos.copy(), pos + 1  # the words on which each symbol depends
    far = np.int64(1 << 40)
    for level in range(1, ROUNDS + 1):
        n = len(sym)
        if n < 2:
            break
        d = doc[pos]
        joined = d[1:] == d[:-1]  # symbol i and the next are of one text
        bit = (_mixed(sym + _ODD[:1] * np.uint64(level)) >> np.uint64(40)) & np.uint64(1)
        pair = np.zeros(n, bool)
        pair[:-1] = joined & (bit[:-1] == 0) & (bit[1:] == 1)
        second = np.concatenate([[False], pair[:-1]])
        single = ~pair & ~second
        more = np.zeros(n, bool)  # goes on a run that the symbol before began
        more[1:] = joined & single[1:] & single[:-1] & (sym[1:] == sym[:-1])
        head = np.flatnonzero(~second & ~more)
        size = np.diff(np.append(head, n))  # 2 for pairs, else the run's length
        last = head + size - 1
        is_pair = pair[head]
        is_run = ~is_pair & (size > 1)
        made = np.where(is_pair, _mixed(sym[head] * _ODD[1] + sym[np.minimum(head + 1, n - 1)] * _ODD[2] + _ODD[0]), sym[head])
        made = np.where(is_run, _mixed(sym[head] * _ODD[2] + size.astype(np.uint64) * _ODD[1]), made)
        # A symbol stays alone, and a run ends, because of its neighbours; an equal neighbour is in a pair, so that one's partner counts too.
        near, next_ = np.maximum(head - 1, 0), np.minimum(last + 1, n - 1)
        has, goes_on = np.concatenate([[False], joined])[head], np.concatenate([joined, [False]])[last]
        left, right = np.where(has, low[near], -far), np.where(goes_on, high[next_], far)
        left = np.where(has & (sym[near] == sym[head]), np.minimum(left, np.where(head > 1, low[np.maximum(head - 2, 0)], -far)), left)
        right = np.where(goes_on & (sym[next_] == sym[last]), np.maximum(right, np.where(last < n - 2, high[np.minimum(last + 2, n - 1)], far)), right)
        low = np.where(is_pair, low[head], np.minimum(left, low[head]))
        high = np.where(is_pair, high[last], np.maximum(right, high[last]))
        sym, pos = made, pos[head]
        fit = (is_pair | is_run) & (low >= pos - BEFORE) & (high <= pos + AFTER)
        best[pos[fit]] = level
        name[pos[fit]] = sym[fit]
    return best, name


def anchors(words: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window that lies in one text, and its anchor's word."""
    n = len(words)
    width = window - BEFORE - AFTER + 1  # places that an anchor may have in a window
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    level, name = symbols(words, doc)
    key = ((ROUNDS - level).astype(np.uint64) << np.uint64(60)) | (name >> np.uint64(4))
    at = np.arange(n)

    def lower(key, at, shift):
        other = key[shift:] < key[:-shift]  # ties: the left one
        return np.where(other, key[shift:], key[:-shift]), np.where(other, at[shift:], at[:-shift])

    have = 1
    while 2 * have <= width:
        key, at = lower(key, at, have)
        have *= 2
    if have < width:
        key, at = lower(key, at, width - have)
    start = np.arange(n - window + 1)
    start = start[doc[start] == doc[start + window - 1]]
    return start, at[start + BEFORE]


def stretches(texts: list[bytes], window: int):
    """Stretches of windows with one anchor: key, text number, first window in its text, windows."""
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    start, anchor = anchors(words, doc, window)
    if not len(start):
        return [np.empty(0, np.int64)] * 4
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    s, a = start[first], anchor[first]
    key = Stretch(words, _KEY_BASE).of(a - BEFORE, a + AFTER)
    offset = np.cumsum(counts) - counts
    return key.view(np.int64), doc[s], s - offset[doc[s]], n


def _passes(batch, *columns):
    """Rows of a batch, a few megabytes of text at a time: lists of texts and of the other columns' values."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    others = [batch.column(c).to_pylist() for c in columns]
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PASS_BYTES or i == len(texts) - 1:
            yield texts[lo : i + 1], *(o[lo : i + 1] for o in others)
            lo, size = i + 1, 0


#: What tells a document from all others: its id, and a digest of its text where the id alone doesn't.
DOCUMENT = ["doc_id", "digest"]


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, digest, text), and whether a document may be there more than once."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = staged(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", F.lit(True).alias("again")), "repeated")
    if repeated.isEmpty():
        return rows.select("doc_id", F.lit(b"").alias("digest"), "text"), False
    rows = rows.join(repeated, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("again"), F.unhex(F.md5("text"))).otherwise(F.lit(b"")).alias("digest"), "text"), True


def _all_stretches(docs: DataFrame, window: int) -> DataFrame:
    def each(batches):
        for batch in batches:
            for texts, ids, digests in _passes(batch, *DOCUMENT):
                key, doc, start, n = stretches(texts, window)
                columns = [key, np.array(ids, np.int64)[doc], pa.array(digests, pa.binary()).take(pa.array(doc)), start.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["k", *DOCUMENT, "s", "n"])

    return docs.mapInArrow(each, "k long, doc_id long, digest binary, s int, n int")


def content(words: list[bytes], start: int, end: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start:end]), digest_size=16).digest()


def _verified(docs: DataFrame, wanted: DataFrame, window: int, single: bool) -> DataFrame:
    """(k, h, doc_id, digest, s, n): stretches wanted (k, doc_id, digest, s, n) with the digest h of their words; single: each of their windows."""
    lists = wanted.groupBy(*DOCUMENT).agg(F.collect_set(F.struct("s", "n", "k")).alias("w"))  # a text's own stretches

    def each(batches):
        for batch in batches:
            for texts, ids, digests, own in _passes(batch, *DOCUMENT, "w"):
                rows = []
                for text, doc_id, digest, w in zip(texts, ids, digests, own, strict=True):
                    words = text.split()
                    if single:
                        starts = sorted({i for x in w for i in range(x["s"], x["s"] + x["n"])})
                        rows += [(0, content(words, i, i + window), doc_id, digest, i, 1) for i in starts]
                    else:
                        rows += [(x["k"], content(words, x["s"], x["s"] + x["n"] + window - 1), doc_id, digest, x["s"], x["n"]) for x in w]
                if rows:
                    types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["k", "h", *DOCUMENT, "s", "n"])

    return docs.join(lists, DOCUMENT).mapInArrow(each, "k long, h binary, doc_id long, digest binary, s int, n int")


def _firsts(rows: DataFrame, *by: str) -> DataFrame:
    """(by, d0, g0, s0, n0, c): the first of each kind of rows, and how many there are."""
    first = rows.groupBy(*by).agg(F.min(F.struct(*DOCUMENT, "s", "n")).alias("first"), F.count(F.lit(1)).alias("c"))
    return first.select(*by, F.col("first.doc_id").alias("d0"), F.col("first.digest").alias("g0"), F.col("first.s").alias("s0"), F.col("first.n").alias("n0"), "c")


def _later(rows: DataFrame, firsts: DataFrame, *by: str) -> DataFrame:
    """The rows that aren't the first of their kind."""
    return rows.join(firsts.where("c > 1"), [*by]).where("doc_id != d0 or digest != g0 or s != s0").select(*DOCUMENT, "s", "n")


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, digest, s, n): windows s to s + n - 1 of a text, each of which also starts earlier. docs: distinct documents."""
    rows = staged(_all_stretches(docs, window), "stretches")
    # Keys that occur once are gone after this; most are.
    shared = staged(rows.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k"), "shared")
    found = staged(rows.join(shared, "k"), "found")
    release(rows, shared)
    known = staged(_verified(docs, found, window, False), "known")
    release(found)
    firsts = staged(_firsts(known, "k", "h"), "firsts")
    later = staged(_later(known, firsts, "k", "h"), "later")
    release(known)
    mixed = firsts.groupBy("k").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("k")
    wanted = firsts.join(mixed, "k").select("k", F.col("d0").alias("doc_id"), F.col("g0").alias("digest"), F.col("s0").alias("s"), F.col("n0").alias("n"))
    single = staged(_verified(docs, wanted, window, True), "windows")
    alone = staged(_firsts(single, "h"), "alone")
    out = staged(later.union(_later(single, alone, "h")), "repeats")
    release(firsts, later, single, alone)
    return out


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """Removes every word covered by a window of `window` words whose words also start earlier.

    docs: doc_id long, text string. Earlier means in a row with a smaller doc_id, or in the same
    document at an earlier start; windows are judged on the input. Returns doc_id, n_words,
    n_removed and kept_text (kept words joined by one space) for every row. Null and empty texts,
    and those without words, have 0 words and an empty kept_text; texts shorter than a window keep
    all. Rows that repeat a doc_id and its text are one document and get the same result; different
    texts under one doc_id are documents in the order of their MD5 digests. Rows whose doc_id is
    null come after all others, told apart and ordered likewise. Texts of any length are handled
    whole; extra columns are ignored; an empty table gives an empty result.
    """
    keyed, repeated = _keyed(docs)
    found = repeats(keyed.dropDuplicates(DOCUMENT) if repeated else keyed, window)
    lists = staged(found.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("s", "n")).alias("w")), "lists")
    release(found)

    def each(batches):
        for batch in batches:
            for texts, ids, own in _passes(batch, "doc_id", "w"):
                out = []
                for doc_id, text, w in zip(ids, texts, own, strict=True):
                    words = text.split()
                    n, removed = len(words), 0
                    if w:
                        edge = np.zeros(n + 1, np.int64)
                        s = np.array([(x["s"], x["s"] + x["n"] + window - 1) for x in w], np.int64)
                        np.add.at(edge, s[:, 0], 1)
                        np.add.at(edge, s[:, 1], -1)
                        kept = np.cumsum(edge[:-1]) == 0
                        removed = n - int(kept.sum())
                        words = [words[i] for i in np.flatnonzero(kept)]
                    out.append((None if doc_id == NO_ID else doc_id, n, removed, b" ".join(words)))
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays[:3], arrays[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return keyed.join(lists, DOCUMENT, "left").mapInArrow(each, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same by plain windows.
SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS s FROM words
), windows AS (
    SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS body FROM starts
), later AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later
), places AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
    SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS body FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
), counts AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM words d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
