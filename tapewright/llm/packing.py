"""Harmonic packing of tokenized documents into fixed-length sequences.

A document's tokens are cut into pieces whose lengths fill a sequence almost exactly when repeated:
length L belongs to the reciprocal-capacity class C // L, and a bin of that length takes C // L
pieces, whatever they hold. So a piece's sequence and offset follow from its rank among the pieces
of its length, and ranks are made part by part. What stays over of each length (less than one bin)
is put together first-fit on the driver: one row per length, at most C of them.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import gapless_rank, staged, text_table

#: White space other than the plain space and the line break; texts that hold any are encoded whole.
ODD_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
END_OF_TEXT = "<|endoftext|>"


class Encoder:
    """Byte-level BPE ids of whole texts, as the tokenizers library gives them with the same vocabulary.

    A space or line break before anything but white space starts a new pre-token, so a text can be
    encoded chunk by chunk, and the chunks' ids are remembered. Other texts are encoded whole.
    """

    #: Chunks remembered; later ones are encoded each time.
    REMEMBERED = 600_000

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special={END_OF_TEXT}, disallowed_special=()), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        ids = np.array(self.bpe.encode_ordinary(chunk if chunk[0] == "\n" else " " + chunk), "<u4").tobytes()
        if len(self.known) < self.REMEMBERED:
            self.known[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or END_OF_TEXT in text or text[-1:] in (" ", "\n") or any(c in text for c in ODD_SPACE):
            return self._whole(text)
        first, *chunks = text.replace("\n", " \n").split(" ")
        known = self.known.get
        return self._whole(first) + b"".join([known(c) or self._chunk(c) for c in chunks])


@cache
def encoder(ranks_path: str) -> Encoder:
    return Encoder(ranks_path)


@cache
def piece_lengths(capacity: int) -> np.ndarray:
    """For each n up to capacity the longest piece to cut from n tokens: copies of it waste at most 1/200 of a sequence."""
    sizes = np.arange(1, capacity + 1)
    good = np.where(capacity - capacity // sizes * sizes <= capacity // 200, sizes, 0)
    return np.r_[0, np.maximum.accumulate(good)]


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    longest, out = piece_lengths(capacity), [capacity] * (n // capacity)
    n %= capacity
    while n:
        out.append(int(longest[n]))
        n -= out[-1]
    return out


#: Tokens after which pieces are handed on.
HANDED_TOKENS = 1_000_000


def pieces(docs: DataFrame, capacity: int, ranks_path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens) of every piece; each document ends with end_id.

    ids: little-endian unsigned 32-bit integers.
    """
    end = np.array([end_id], "<u4").tobytes()
    names, types = ["doc_id", "start", "length", "ids", "doc_tokens"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def made(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def each(batches):
        encode = encoder(ranks_path).encode
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids = encode(text.decode("utf-8", "replace")) + end
                start, n = 0, len(ids) // 4
                for length in cuts(n, capacity):
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n))
                    start += length
                held += n
                if held >= HANDED_TOKENS:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return text_table(docs).mapInArrow(each, "doc_id long, start long, length long, ids binary, doc_tokens long")


def bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """counts: pieces by length. Rows (length, per_bin, full, base, tail_sequence, tail_offset).

    Ranks below full * per_bin go to sequences from base on; the rest go to tail_sequence, from
    tail_offset on. Remainders are placed first-fit, longest first.
    """
    out, base, rests = [], 0, []
    for length, n in sorted(counts.items()):
        per_bin = capacity // length
        out.append([length, per_bin, n // per_bin, base, 0, 0])
        base += n // per_bin
        if n % per_bin:
            rests.append((n % per_bin * length, len(out) - 1))
    filled: list[int] = []
    for size, k in sorted(rests, reverse=True):
        at = next((i for i, f in enumerate(filled) if f + size <= capacity), len(filled))
        if at == len(filled):
            filled.append(0)
        out[k][4:] = [base + at, filled[at]]
        filled[at] += size
    return [tuple(r) for r in out]


def pack(docs: DataFrame, capacity: int = 1024, ranks_path: str | None = None, end_id: int = 0, parts: int = 256) -> DataFrame:
    """Packs every row of docs (doc_id long, text string) into sequences of at most `capacity` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    the piece's token ids as little-endian unsigned 32-bit integers; sequences() puts them together.
    A null or empty text is the end id alone. Very long texts become many pieces. Repeated rows are
    packed as often as they come. A null doc_id stays null. An empty table gives an empty result.
    Pieces of one length are ranked in `parts` parts, so a length that is very common is spread too.
    """
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = staged(pieces(docs, capacity, ranks_path, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = cut.sparkSession.createDataFrame(bins(counts, capacity), "length long, per_bin long, full long, base long, tail_sequence long, tail_offset long")
    cut = cut.withColumn("ids_crc32", F.crc32("ids"))
    ranked = gapless_rank(cut, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], parts, "rank", few=True)  # at most `capacity` lengths
    placed = ranked.join(F.broadcast(table), "length")  # at most `capacity` rows
    bin_ = F.expr("rank div per_bin")
    whole = bin_ < F.col("full")
    at = F.col("rank") % F.col("per_bin") * F.col("length")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(whole, F.col("base") + bin_).otherwise(F.col("tail_sequence")).alias("sequence_id"),
        F.when(whole, at).otherwise(F.col("tail_offset") + at).alias("offset"),
        "ids",
    )


def sequences(packed: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, n_tokens) of the rows of pack(): `capacity` ids each, pad_id after the first n_tokens."""

    def each(batches):
        for batch in batches:
            joined = [b"".join(p["ids"] for p in own) for own in batch.column("pieces").to_pylist()]
            ids = np.full((len(joined), capacity), pad_id, np.int32)
            for k, own in enumerate(joined):
                ids[k, : len(own) // 4] = np.frombuffer(own, "<u4")
            starts = pa.array(np.arange(len(joined) + 1, dtype=np.int32) * capacity)
            n = pa.array([len(own) // 4 for own in joined], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.ListArray.from_arrays(starts, pa.array(ids.ravel())), n], ["sequence_id", "ids", "n_tokens"])

    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return rows.mapInArrow(each, "sequence_id long, ids array<int>, n_tokens long")


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with their ids' checksum, which was taken of the ids themselves before they were ranked, in place of the ids."""
    return packed.drop("ids")
