"""Language identification: a linear-chain conditional random field over the words of a text.

Word scores come from hashed affixes and character n-grams and from lexicons of frequent words;
transitions are learned with them. Forward-backward gives every word a distribution over languages,
and a document's language is the one with the largest share of its letters. Training sequences are
spliced from spans of different documents as well, since the labels are per document and code
switching has to be learned.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import fresh, staged

#: Words of one block: transfer matrices are multiplied inside blocks, then along each document's blocks.
BLOCK = 32
#: Words of one pass over a batch, and word types whose scores a worker remembers.
PASS_WORDS, REMEMBERED = 200_000, 300_000
UNKNOWN = "und"
#: Most languages whose counts are sent to every executor.
MOST_BROADCAST = 10_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass
class Model:
    """labels: L languages; weights: (2**bits, L) of hashed features; lexicon: word -> row of lexical; moves: (L, L)."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexical: np.ndarray
    moves: np.ndarray


def feature_ids(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed affix and n-gram features of words of similar length: ids (words, features) and which of them exist."""
    n, width = len(words), max(map(len, words))
    codes = np.zeros((n, width + 2), np.uint64)
    codes[:, 1 : width + 1] = np.array(words, f"U{width}").view(np.uint32).reshape(n, width)
    length = np.fromiter(map(len, words), np.int64, n)
    row = np.arange(n)
    codes[:, 0] = 2  # the word's borders
    codes[row, length + 1] = 3
    ids, there = [], []

    def add(h, salt, exists):
        h = (h + np.uint64(salt)) * _MIX[3]
        ids.append((h ^ (h >> np.uint64(29))) % np.uint64(size))
        there.append(exists)

    at = np.arange(width + 1)
    two = codes[:, :-1] * _MIX[0] + codes[:, 1:] * _MIX[1]
    add(two, 1, at[None, :] <= length[:, None])
    if width > 1:
        three = two[:, :-1] * _MIX[2] + codes[:, 2:]
        add(three, 2, at[None, :-1] < length[:, None])
    for k in (2, 3, 4):  # affixes of whole characters, without the borders
        if width >= k:
            start = np.zeros(n, np.uint64)
            end = np.zeros(n, np.uint64)
            for i in range(k):
                start = start * _MIX[0] + codes[:, 1 + i]
                end = end * _MIX[1] + codes[row, np.maximum(length - k + 1 + i, 0)]
            has = (length >= k)[:, None]
            add(start[:, None], 10 + k, has)
            add(end[:, None], 20 + k, has)
    return np.concatenate(ids, axis=1).astype(np.int64), np.concatenate(there, axis=1)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """(words, L) scores; words are handled together by powers of two of their length, each of them whole."""
    out = np.zeros((len(words), len(model.labels)))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    group = np.ceil(np.log2(np.maximum(sizes, 8))).astype(np.int64)
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        for part in np.array_split(at, max(1, len(at) * (1 << int(g)) // 400_000)):
            if len(part):
                ids, there = feature_ids([words[i] for i in part], len(model.weights))
                out[part] = np.einsum("wfl,wf->wl", model.weights[ids], there.astype(model.weights.dtype))
    known = np.fromiter((model.lexicon.get(w, -1) for w in words), np.int64, len(words))
    return out + np.where(known[:, None] >= 0, model.lexical[known], 0)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, expected_moves: bool = False):
    """Posterior (words, L) of sequences that lie one after the other in scores, by forward-backward.

    With expected_moves also the expected number of moves from one label to another, (L, L).

    Blocks of BLOCK words are multiplied into transfer matrices, all blocks at once; vectors are then
    carried along each sequence's blocks, and through the words of every block from both ends.
    """
    n_labels = scores.shape[1]
    A = np.exp(moves - moves.max())
    lengths = lengths[lengths > 0]
    blocks = -(-lengths // BLOCK)
    first_block = np.cumsum(blocks) - blocks
    first_word = np.cumsum(lengths) - lengths
    block_of = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    at = (np.repeat(first_word, blocks) + block_of * BLOCK)[:, None] + np.arange(BLOCK)
    there = at < np.repeat(first_word + lengths, blocks)[:, None]
    E = np.exp(scores - scores.max(axis=1, keepdims=True))[np.where(there, at, 0)]
    nb = len(E)

    def scaled(x, axes):
        return x / x.max(axis=axes, keepdims=True)

    M = np.broadcast_to(np.eye(n_labels), (nb, n_labels, n_labels))
    for t in range(BLOCK):
        step = (M.reshape(-1, n_labels) @ A).reshape(nb, n_labels, n_labels) * E[:, t, None, :]
        M = np.where(there[:, t, None, None], scaled(step, (1, 2)), M)
    into, after = np.ones((nb, n_labels)), np.ones((nb, n_labels))
    for k in range(1, int(blocks.max(initial=0))):
        i = first_block[blocks > k] + k
        into[i] = scaled(np.einsum("bl,blm->bm", into[i - 1], M[i - 1]), 1)
    for k in range(2, int(blocks.max(initial=0)) + 1):
        own = blocks >= k
        i = first_block[own] + blocks[own] - k
        after[i] = scaled(np.einsum("blm,bm->bl", M[i + 1], after[i + 1]), 1)
    forward, backward = np.empty_like(E), np.empty_like(E)
    v = into
    for t in range(BLOCK):
        v = np.where(there[:, t, None], scaled((v @ A) * E[:, t], 1), v)
        forward[:, t] = v
    v = after
    for t in range(BLOCK - 1, -1, -1):
        backward[:, t] = v
        v = np.where(there[:, t, None], scaled((v * E[:, t]) @ A.T, 1), v)
    posterior = (forward * backward)[there]
    posterior /= posterior.sum(axis=1, keepdims=True)
    if not expected_moves:
        return posterior
    follows = there.copy()
    follows[first_block, 0] = False
    left = np.concatenate([into[:, None], forward[:, :-1]], axis=1)[follows]
    pairs = left[:, :, None] * A * (E * backward)[follows][:, None, :]
    return posterior, (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def letters(text: str) -> list[str]:
    """Lower-case words of a text that have a letter, without what surrounds their letters."""
    out = []
    for w in text.lower().split():
        if not w.isalpha():
            i, j = 0, len(w)
            while i < j and not w[i].isalpha():
                i += 1
            while j > i and not w[j - 1].isalpha():
                j -= 1
            w = w[i:j]
        if w:
            out.append(w)
    return out


def train(spans: list[tuple[str, str]], bits: int = 15, lexicon_words: int = 2000, rounds: int = 8, rate: float = 0.3, seed: int = 5) -> Model:
    """Fits the field to (language, text) spans by adaptive gradient steps on the log-likelihood."""
    labels = sorted({lang for lang, _ in spans})
    rng = np.random.default_rng(seed)
    docs = [(labels.index(lang), w) for lang, text in spans if (w := letters(text))]
    counts = [Counter() for _ in labels]
    for y, words in docs:
        counts[y].update(words)
    lexicon = {w: i for i, w in enumerate(sorted({w for c in counts for w, k in c.most_common(lexicon_words) if k > 1}))}
    n = len(labels)
    model = Model(labels, np.zeros((1 << bits, n), np.float32), lexicon, np.zeros((len(lexicon) + 1, n), np.float32), np.zeros((n, n)))
    if n < 2:
        return model
    # Half the sequences are spans of one document, half are spliced from two or three.
    words, gold, lengths = [], [], []
    for k in range(len(docs)):
        cut = np.sort(rng.integers(1, BLOCK, rng.integers(1, 3))).tolist() if k % 2 else []
        of = [k, *rng.integers(0, len(docs), len(cut)).tolist()]
        got = 0
        for d, lo, hi in zip(of, [0, *cut], [*cut, BLOCK], strict=True):
            y, w = docs[d]
            w = w[lo:hi] or w[: hi - lo]
            words += w
            gold += [y] * len(w)
            got += len(w)
        lengths.append(got)
    gold, lengths = np.array(gold), np.array(lengths)
    types = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, there = feature_ids(list(types), 1 << bits)
    lex = np.fromiter((lexicon.get(w, len(lexicon)) for w in types), np.int64, len(types))
    of = np.fromiter((types[w] for w in words), np.int64, len(words))
    sums = [np.full_like(x, 1e-6, np.float64) for x in (model.weights, model.lexical, model.moves)]
    ends = np.cumsum(lengths)
    inner = np.ones(len(words), bool)
    inner[ends - lengths] = False
    per_step = max(1, len(lengths) // 16)
    for _ in range(rounds):
        for s in range(0, len(lengths), per_step):
            lo, hi = int(ends[s] - lengths[s]), int(ends[min(len(ends), s + per_step) - 1])
            used, local = np.unique(of[lo:hi], return_inverse=True)
            own = np.einsum("wfl,wf->wl", model.weights[ids[used]], there[used].astype(np.float32)) + model.lexical[lex[used]]
            post, expected = marginals(own[local].astype(np.float64), lengths[s : s + per_step], model.moves, True)
            y = gold[lo:hi]
            diff = -post
            diff[np.arange(hi - lo), y] += 1
            by_type = np.stack([np.bincount(local, diff[:, c], len(used)) for c in range(n)], axis=1)
            at, type_of = ids[used][there[used]], np.nonzero(there[used])[0]
            grads = [
                np.stack([np.bincount(at, by_type[type_of, c], 1 << bits) for c in range(n)], axis=1) / (hi - lo),
                np.stack([np.bincount(lex[used], by_type[:, c], len(lexicon) + 1) for c in range(n)], axis=1) / (hi - lo),
                np.zeros((n, n)),
            ]
            i = np.flatnonzero(inner[lo:hi])
            np.add.at(grads[2], (y[i - 1], y[i]), 1 / (hi - lo))
            grads[2] -= expected / (hi - lo)
            for x, g, total in zip((model.weights, model.lexical, model.moves), grads, sums, strict=True):
                total += g * g
                x += (rate * g / np.sqrt(total)).astype(x.dtype)
    model.lexical[-1] = 0
    return model


def held_out() -> F.Column:
    """True for a fifth of the documents, which are never learned from; also where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample_docs: int = 4000, span_words: int = 64, seed: int = 5) -> Model:
    """Learns from one span of `span_words` words of each of at most `sample_docs` documents.

    Every language gets an equal part of them, so that rare ones are learned too: the documents with
    the lowest seeded hash of doc_id among those that aren't held out. A span's place in its text is
    seeded too. First all but about twice that part go by the hash, whose values are uniform, so that
    what is ranked is small.
    """
    lang, text = F.col("lang").alias("lang"), F.col("text").alias("text")
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", lang, text)
    counts = staged(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "counts")
    kinds = counts.count()
    if not kinds:
        return train([])
    part = max(1, sample_docs // kinds)
    hashed = F.xxhash64("doc_id", F.lit(seed))
    few = F.broadcast(counts) if kinds <= MOST_BROADCAST else counts
    near = known.join(few, "lang").where((hashed / F.lit(2.0**64) + 0.5) * F.col("n") < 2 * part + 20)
    words = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.greatest(F.lit(1), F.size(words) - span_words + 1)).cast("int")
    spans = near.select("lang", hashed.alias("h"), F.array_join(F.slice(words, start, span_words), " ").alias("span")).distinct()
    ranked = spans.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "span"))).where(F.col("rank") <= part)
    rows = ranked.orderBy("h", "lang", "span").limit(sample_docs).select("lang", "span").collect()
    return train(sorted((r["lang"], r["span"]) for r in rows))


class _Labeller:
    """Labels the documents of a task; word scores are kept from one pass to the next."""

    def __init__(self, model: Model):
        self.model = model
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.labels)))

    def label(self, texts: list[list[str]]):
        """For each document: language (index, -1 if it has no letter), share, changes of language between words."""
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
            self.scores = self.scores[:0]
        ids, new = self.ids, []
        flat = []
        for words in texts:
            for w in words:
                k = ids.get(w)
                if k is None:
                    k = ids[w] = len(ids)
                    new.append(w)
                flat.append(k)
        if new:
            self.scores = np.concatenate([self.scores, word_scores(new, self.model)])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        lang, share, changes = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        if not flat or not self.model.labels:
            return lang, share, changes
        flat = np.array(flat)
        post = marginals(self.scores[flat], lengths, self.model.moves)
        size = np.fromiter((len(w) for words in texts for w in words), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), lengths)
        mass = np.stack([np.bincount(doc, post[:, c] * size, len(texts)) for c in range(post.shape[1])], axis=1)
        some = lengths > 0
        lang[some] = mass[some].argmax(axis=1)
        share[some] = mass[some].max(axis=1) / mass[some].sum(axis=1)
        best = post.argmax(axis=1)
        moved = np.r_[False, (best[1:] != best[:-1]) & (doc[1:] == doc[:-1])]
        return lang, np.clip(share, 0.0, 1.0), np.bincount(doc, moved, len(texts)).astype(np.int64)


def annotate(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "n_switches")) -> DataFrame:
    """docs with the predicted language, its share of the letters and the changes of language between words.

    A null text, or one without a letter, gets `und`, share 0 and no changes. Whole texts count, very
    long ones too. `names` names the new columns; other columns stay as they are.
    """
    added = dict(zip(names, (T.StringType(), T.DoubleType(), T.LongType()), strict=True))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, t) for k, t in added.items())])
    said = np.array([*model.labels, UNKNOWN], dtype=object)

    def each(batches):
        labeller = _Labeller(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found, held, words = [], [], 0
            for t in texts:
                held.append(letters(t.as_py() or ""))
                words += len(held[-1])
                if words >= PASS_WORDS:
                    found.append(labeller.label(held))
                    held, words = [], 0
            found.append(labeller.label(held))
            lang, share, changes = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said[lang], pa.string()), pa.array(share), pa.array(changes)], [*batch.schema.names, *added])

    return docs.mapInArrow(each, schema)


def identify(docs: DataFrame, sample_docs: int = 4000, seed: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_switches) for every row of docs (doc_id, text, lang).

    Learns from the documents that aren't held out (`fit`) and predicts from the text alone. Repeated
    rows come back as often as they came; an empty table, or one without languages, gives `und` at most.
    """
    model = fit(docs, sample_docs, seed=seed)
    found = annotate(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_switches")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs with the predicted language in `lang`, without those that are rejected.

    Rejected is a text without letters, and one of which no language has `least` of the letters: too
    many languages in one, or none that was learned. A text in two languages stays.
    """
    lang, share, changes = fresh(docs.columns, "lang_pred", "share", "changes")
    found = annotate(docs, fit(docs), (lang, share, changes)).where((F.col(lang) != UNKNOWN) & (F.col(share) >= least))
    return found.select(*[F.col(lang).cast(docs.schema[c].dataType).alias(c) if c == "lang" else c for c in docs.columns])
