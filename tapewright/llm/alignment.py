"""Cross-tokenizer alignment: where two tokenizations of a text end together, and which tokens meet there.

Both tokenizations are lists of byte offsets at which tokens end. The shorter list drives a galloping
intersection: for each of its ends, an exponential search from the last place found brackets the end
in the longer list, and a binary search settles it. The common ends cut both lists into groups, and
the differences of their ranks say which ranges of tokens belong together. The pairs of tokens that
end together are counted over the corpus: tasks count their own blocks of texts first, the blocks'
tables of pairs are summed up, and each block gets back the totals of its own pairs only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import staged, text_table
from tapewright.llm.packing import ODD_SPACE

#: What stands for a space in the second tokenizer's pieces.
MARK = "▁"
#: Words whose ids a worker remembers.
REMEMBERED = 300_000
#: Tokens of both tokenizers after which a block of texts ends; a longer text is a block of its own.
BLOCK_TOKENS = 1_500_000
#: Lanes of the galloping search that advance together, and the ends that each has at least.
LANES, LANE = 4096, 64


class Tokenizers:
    """Ids of a text by both tokenizers, and the bytes that each id stands for.

    Both cut before a space or line break that follows anything else, whatever stands around: no
    piece of the second reaches over such a place (which is checked here), and the first one's
    pre-tokens don't either. So plain texts are encoded word by word, and words are remembered.
    """

    def __init__(self, ranks_path: str, piece_path: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        self.by_word = not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _checked(self, a: list[int], b: list[int], data: str) -> tuple[bytes, bytes] | None:
        """Ids as little-endian unsigned 16-bit integers, if both stand for the same bytes, else None."""
        want = data.encode()
        if b"".join([self.a_bytes[i] for i in a]) != want or b"".join([self.b_bytes[i] for i in b]) != want:
            return None
        return np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes()

    def _word(self, word: str) -> tuple[bytes, bytes] | None:
        """Ids of a space and a word, or of a word that begins with a line break."""
        if word[:1] == "\n":
            a, b, data = self.a.encode_ordinary(word), self.b.encode(word), word
            b = b[1:] if b[:1] == [self.mark] else []
        else:
            data = " " + word
            a, b = self.a.encode_ordinary(data), self.b.encode(word)
        ids = self._checked(a, b, data)
        if len(self.known) < REMEMBERED:
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> tuple[bytes, bytes] | None:
        """Ids of a space and the text by both, None if the text is empty or the tokens' bytes aren't the text's."""
        if not text:
            return None
        if not self.by_word or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in ODD_SPACE):
            return self._checked(self.a.encode_ordinary(" " + text), self.b.encode(text), " " + text)
        known, words = self.known, text.replace("\n", " \n").split(" ")
        ids = [known[w] if w in known else self._word(w) for w in words]
        if None in ids:
            return None
        return b"".join([x[0] for x in ids]), b"".join([x[1] for x in ids])


@cache
def tokenizers(ranks_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(ranks_path, piece_path)


def paths(ranks_path: str | None, piece_path: str | None) -> tuple[str, str]:
    if ranks_path is None or piece_path is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        piece_path = piece_path or public_tokenizers.path("piece_bpe_32k.model")
    return ranks_path, piece_path


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with short[i] == long[j]; both lists ascend strictly.

    The short list is cut into lanes; each has its own cursor into the long one, and all lanes take
    their next element together.
    """
    if not len(short) or not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, end = len(short), len(long)
    padded = np.append(long, np.iinfo(np.int64).max)
    size = max(LANE, -(-n // LANES))
    starts = np.arange(0, n, size)
    cursor = np.searchsorted(long, short[starts])
    places = np.full(n, -1, np.int64)
    for k in range(size):
        i = starts + k
        if i[-1] >= n:  # only the last lane can be shorter
            i = i[:-1]
            cursor = cursor[: len(i)]
            if not len(i):
                break
        want, low, high = short[i], cursor, cursor.copy()
        behind, step = np.flatnonzero(padded[high] < want), 1
        low = low.copy()
        while len(behind):  # exponential: the wanted end lies behind `high`
            low[behind] = high[behind] + 1
            high[behind] = np.minimum(high[behind] + step, end)
            behind = behind[padded[high[behind]] < want[behind]]
            step *= 2
        wide = np.flatnonzero(low < high)
        while len(wide):  # binary, between `low` and `high`
            mid = (low[wide] + high[wide]) // 2
            less = padded[mid] < want[wide]
            low[wide[less]] = mid[less] + 1
            high[wide[~less]] = mid[~less]
            wide = wide[low[wide] < high[wide]]
        found = padded[low] == want
        places[i[found]] = low[found]
        cursor = low
    hits = np.flatnonzero(places >= 0)
    return hits, places[hits]


class Aligned:
    """A block of texts with tokens: ids of both tokenizers one text after the other, and where they end together."""

    def __init__(self, both: Tokenizers, ids: list[tuple[bytes, bytes]]):
        self.n_a = np.array([len(a) // 2 for a, _ in ids], np.int64)
        self.n_b = np.array([len(b) // 2 for _, b in ids], np.int64)
        self.a = np.frombuffer(b"".join([a for a, _ in ids]), "<u2").astype(np.int64)
        self.b = np.frombuffer(b"".join([b for _, b in ids]), "<u2").astype(np.int64)
        # a text's tokens have the same bytes in all, so the ends go on from text to text on both sides
        ends_a, ends_b = np.cumsum(both.a_sizes[self.a]), np.cumsum(both.b_sizes[self.b])
        a_drives = self.n_a <= self.n_b
        in_a, in_b = np.repeat(a_drives, self.n_a), np.repeat(a_drives, self.n_b)
        self.at_a, self.at_b = [], []
        for own_a, own_b, turned in ((in_a, in_b, False), (~in_a, ~in_b, True)):
            place_a, place_b = np.flatnonzero(own_a), np.flatnonzero(own_b)
            if turned:
                j, i = gallop(ends_b[place_b], ends_a[place_a])
            else:
                i, j = gallop(ends_a[place_a], ends_b[place_b])
            self.at_a.append(place_a[i])
            self.at_b.append(place_b[j])
        self.at_a, self.at_b = np.sort(np.concatenate(self.at_a)), np.sort(np.concatenate(self.at_b))
        self.last_a, self.last_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        groups = np.searchsorted(self.at_a, self.last_a)
        self.n_groups = np.diff(groups, prepend=0)

    def text_of_links(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_groups)), self.n_groups)

    def codes(self) -> np.ndarray:
        """A number for the two ids that end together at each common end."""
        return (self.a[self.at_a] << 16) | self.b[self.at_b]

    def digests(self) -> list[str]:
        """Hash of each text's groups, `a1,a2|b1;a3|b2,b3`."""
        total = len(self.a) + len(self.b)
        marks_a, marks_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        marks_a[self.at_a] = True
        marks_b[self.at_b] = True
        # a token's place in the text of groups: its rank, and the rank at which the other side's group begins or ends
        place_a = np.arange(len(self.a)) + np.append(0, self.at_b + 1)[np.cumsum(marks_a) - marks_a]
        place_b = np.arange(len(self.b)) + (self.at_a + 1)[np.cumsum(marks_b) - marks_b]
        ids, after = np.empty(total, np.int64), np.empty(total, np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a] = np.where(marks_a, ord("|"), ord(","))
        after[place_b] = np.where(marks_b, ord(";"), ord(","))
        digits, counts = decimals()
        sizes = counts[ids]
        ends = np.cumsum(sizes + 1)
        out, begins = np.empty(ends[-1] if total else 0, np.uint8), ends - sizes - 1
        for d in range(5):
            longer = sizes > d
            out[begins[longer] + d] = digits[ids[longer], d]
        out[ends - 1] = after
        stops = ends[self.last_a + self.last_b - 1]
        view = memoryview(out)
        return [hashlib.sha256(view[i : j - 1]).hexdigest() for i, j in zip(np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True)]


@cache
def decimals() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below 2 ** 16, and how many each has."""
    numbers = np.arange(1 << 16)
    counts = np.array([len(str(n)) for n in numbers.tolist()], np.int64)
    digits = np.frombuffer(b"".join(str(n).ljust(5).encode() for n in numbers.tolist()), np.uint8).reshape(-1, 5)
    return digits, counts


def _blocks(both: Tokenizers, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int], Aligned]]:
    """(ids of documents, which of them have tokens, those aligned), a block at a time."""
    doc_ids, ids, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            doc_ids.append(doc_id)
            ids.append(both.encode(text.decode("utf-8", "replace")))
            held += len(ids[-1][0]) + len(ids[-1][1]) if ids[-1] else 0
            if held >= 2 * BLOCK_TOKENS:
                have = [k for k, x in enumerate(ids) if x]
                yield doc_ids, have, Aligned(both, [ids[k] for k in have])
                doc_ids, ids, held = [], [], 0
    if doc_ids:
        have = [k for k, x in enumerate(ids) if x]
        yield doc_ids, have, Aligned(both, [ids[k] for k in have])


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, ranks_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends) for every row of docs (doc_id long, text string).

    Group k of a text is tokens a_ends[k-1] to a_ends[k] - 1 of the first tokenizer and b_ends[k-1] to
    b_ends[k] - 1 of the second (0 before the first), which stand for the same bytes of space + text. A
    text that is null, empty, or that the tokens' bytes don't give back has empty lists. Very long texts
    are aligned whole; repeated rows come back as often as they came; extra columns are ignored.
    """
    where = paths(ranks_path, piece_path)

    def each(batches):
        both = tokenizers(*where)
        for doc_ids, have, made in _blocks(both, batches):
            counts = lambda n: np.bincount(have, n, len(doc_ids)).astype(np.int64) if have else np.zeros(len(doc_ids), np.int64)
            first_a, first_b = np.repeat(made.last_a - made.n_a, made.n_groups), np.repeat(made.last_b - made.n_b, made.n_groups)
            groups = counts(made.n_groups)
            lists = [(made.a, counts(made.n_a)), (made.b, counts(made.n_b)), (made.at_a + 1 - first_a, groups), (made.at_b + 1 - first_b, groups)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *[_lists(v, n, pa.int32()) for v, n in lists]], ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return text_table(docs).mapInArrow(each, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


_TEXTS = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<long>, codes array<long>"


def _texts(docs: DataFrame, where: tuple[str, str]) -> DataFrame:
    """A row for each text, with its distinct pairs as indices into its block's pairs, and a row for each block with those pairs' codes."""
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times", "codes"]

    def each(batches):
        both, part = tokenizers(*where), TaskContext.get().partitionId()
        for k, (doc_ids, have, made) in enumerate(_blocks(both, batches)):
            n, block = len(doc_ids), (part << 32) + k
            codes, pair, times = np.unique(made.codes(), return_inverse=True, return_counts=True)
            own, own_times = np.unique(made.text_of_links() * max(1, len(codes)) + pair, return_counts=True)
            of, pair = own // max(1, len(codes)), own % max(1, len(codes))
            full = lambda v: np.bincount(have, v, n).astype(np.int64) if have else np.zeros(n, np.int64)
            hashes = [""] * n
            for i, h in zip(have, made.digests() if have else [], strict=True):
                hashes[i] = h
            sizes = full(np.bincount(of, minlength=len(have)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block), pa.int64()), pa.array(doc_ids, pa.int64()), *[pa.array(full(x), pa.int64()) for x in (made.n_a, made.n_b, made.n_groups)],
                    pa.array(hashes, pa.string()), _lists(pair, sizes, pa.int32()), _lists(own_times, sizes, pa.int64()), pa.nulls(n, pa.list_(pa.int64())),
                ],
                names,
            )
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))]
            one = np.array([len(codes)])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, _lists(times, one, pa.int64()), _lists(codes, one, pa.int64())], names)

    return staged(text_table(docs).mapInArrow(each, _TEXTS), "alignment")


def _totals(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair, code, times) of every block's pairs, and (code, count, best) of every pair of the corpus."""
    own = texts.where("codes is not null").select("block", F.posexplode(F.arrays_zip("codes", "times")).alias("pair", "of")).select("block", "pair", F.col("of.codes").alias("code"), F.col("of.times").alias("times"))
    counts = own.groupBy("code").agg(F.sum("times").alias("count")).withColumn("b_id", F.col("code").bitwiseAND(0xFFFF))
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    return own, counts.join(most, "b_id").select("code", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, ranks_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """(a_id, b_id, count, best): how often two ids end together in the corpus; best: no other a_id does so more often with that b_id."""
    _, totals = _totals(_texts(docs, paths(ranks_path, piece_path)))
    return totals.select(F.shiftrightunsigned("code", 16).cast("int").alias("a_id"), F.col("code").bitwiseAND(0xFFFF).cast("int").alias("b_id"), "count", "best")


_DIGESTS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def digest(docs: DataFrame, ranks_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Counts of tokens, groups and links of every row of docs, how common the links are in the corpus, and the groups' hash.

    A text without tokens (see align) has zeros and an empty hash. n_best counts the links whose pair no
    other a_id exceeds for its b_id, ties included; count_sum adds up the corpus counts of all links. The
    corpus is all rows, repeated ones as often as they come. An empty table gives an empty result.
    """
    texts = _texts(docs, paths(ranks_path, piece_path))
    own, totals = _totals(texts)
    back = own.select(F.col("block").alias("of_block"), "pair", "code").join(totals, "code").select("of_block", "pair", "count", "best")

    def each(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        rows, pairs = rows.combine_chunks(), pairs.combine_chunks()
        order = pairs.column("pair").to_numpy()
        counts, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        counts[order], best[order] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        lists = rows.column("pairs").combine_chunks()
        times = rows.column("times").combine_chunks().flatten().to_numpy()
        pair = lists.flatten().to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        summed = lambda v: np.diff(np.append(0, np.cumsum(v))[ends], prepend=0)
        more = {"n_links": rows.column("n_groups"), "n_best": pa.array(summed(times * best[pair]), pa.int64()), "count_sum": pa.array(summed(times * counts[pair]), pa.int64())}
        return pa.table({c: more[c] if c in more else rows.column(c) for c in _DIGESTS})

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.where("codes is null").drop("codes").groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(each, schema)
