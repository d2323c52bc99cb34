"""From documents to packed training sequences, one operator after the other.

Each stage reads what the one before wrote. Language identification writes the language it predicts
into lang and drops documents that it rejects; near-duplicate removal keeps one document of each
group whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; secrets are redacted in
place, so their documents stay; mixing repeats and cuts documents to the sources' target shares; and
packing cuts them into the pieces of 1024-token sequences, each with its token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapewright.llm import jaccard, langid, mixing, packing, secrets
from tapewright.llm.common import release, scratch, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with lang set to the predicted language, without texts of no language or of too many (operator 1).

    Null texts and texts without letters go. Very long texts count whole, repeated rows get the same
    decision, other columns stay as they are, an empty table gives an empty one.
    """
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id (operator 8, verified exactly).

    Rows without doc_id stay; texts without words are copies of one another; of rows that repeat a
    doc_id and text one stays; other columns stay as they are; an empty table gives an empty one.
    """
    return jaccard.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret replaced by a mark, and n_chars set anew where that changed a text (operator 2).

    All rows stay, null, empty and repeated ones too, and very long texts are scanned whole.
    """
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs repeated and cut so that sources have their target shares of words (operator 9).

    Texts without words go, as nothing of them can be taken; rows without doc_id or source are rows
    like any others; repeated rows count as often as they come; an empty table gives an empty one.
    """
    return mixing.apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and places in sequences of 1024 tokens (operator 10).

    A null or empty text is its end id alone; repeated rows are packed as often as they come.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The models, fingerprints and tokenizer of the stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as used:
            made = staged(stage(spark, docs, sf_dir), name)
            used.pop()
        release(docs)
        docs = made
    packed = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)  # their pieces are staged
    return packed


def training_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded sequences that the pieces of run() make up."""
    return packing.sequences(run(spark, sf_dir))
