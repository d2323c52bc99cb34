"""Token counts without tokens: best segmentation under a unigram vocabulary.

An Aho-Corasick automaton names all vocabulary pieces that end at each character; dynamic
programming carries the best score and the number of pieces to each end. Ties follow the tokenizers
library: among equal scores the piece that starts first wins. A character without a piece of its
own may be spelled in bytes, one token each, at a fixed penalty below the lowest score.
"""

from __future__ import annotations

import math
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tapewright.llm.common import text_table

#: What stands for a space and begins every word.
MARK = "▁"
#: Below the lowest score of the vocabulary, for characters that have no piece.
PENALTY = 10.0
#: Words whose counts a worker remembers.
REMEMBERED = 500_000


@cache
def vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces of a sentencepiece file with log-probabilities by rank (Zipf's law), in the file's order.

    The file's own scores only rank the pieces, so they can't be added up.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = math.log(sum(1 / (i + 3) for i in range(n)))
    return tuple((model.id_to_piece(i), -math.log(i + 3) - total) for i in range(n))


class Counter:
    """Counts the pieces of words under a vocabulary of (piece, score)."""

    def __init__(self, pieces):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n = len(word)
        best, count, start = [-math.inf] * (n + 1), [0] * (n + 1), [n] * (n + 1)
        best[0] = 0.0
        at = 0  # ends up to here are settled

        def settle(to):
            for e in range(at + 1, to + 1):
                if word[e - 1] not in self.single:
                    score = best[e - 1] + self.unknown
                    if score > best[e]:  # the longest reach back, so an equal score doesn't count
                        best[e], count[e] = score, count[e - 1] + len(word[e - 1].encode())

        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            if end - 1 > at:
                settle(end - 1)
                at = end - 1
            i = end - size
            total = best[i] + score
            if total > best[end] or (total == best[end] and i < start[end]):
                best[end], count[end], start[end] = total, count[i] + 1, i
        settle(n)
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text; every space, or mark, begins a word."""
        words = text.replace(" ", MARK).split(MARK)
        if not words[0]:
            del words[0]
        n, score, known = 0, 0.0, self.known
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.word(MARK + w)
                if len(known) < REMEMBERED:
                    known[w] = found
            n += found[0]
            score += found[1]
        return n, score


@cache
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, score) for every row of docs (doc_id long, text string); path: a sentencepiece file.

    Null and empty texts have no tokens and score 0. Texts of any length are counted whole, repeated
    rows each time; extra columns are ignored; an empty table gives an empty result.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")

    def each(batches):
        count = _counter(path).text
        for batch in batches:
            found = [count(t.decode("utf-8", "replace")) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n, score = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return text_table(docs).mapInArrow(each, "doc_id long, n_tokens long, score double")
