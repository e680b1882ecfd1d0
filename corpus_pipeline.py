"""Documents to training tokens, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its
result is written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents`` and whatever other columns came with them, unchanged.
Texts of any length are worked on whole; an empty ``documents`` runs through to an empty
result, and with an empty ``benchmark`` no document is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, decontam, jaccard, langid, secrets
from corvane.llm.common import settle, table, unstage

#: No SQL expresses a classifier or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: null, empty and letterless texts, or a posterior below one half.

    Repeated rows share their fate; without any label all documents go.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity the one with the smallest doc_id stays.

    Rows that share that id all stay, and so does a row without an id; a text without words is
    linked with nothing and stays.
    """
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a window of a benchmark item, also of one without an id; null and empty texts stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in ``text`` (and ``n_chars`` agrees); no document goes, and null and empty texts stay as they are."""
    return secrets.redact_documents(docs)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the token ids of each document; repeated rows each, none for a null or empty text."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokenization", tokenization),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what a stage staged for itself goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        after = settle(lambda step=step, docs=docs: step(spark, docs, sf_dir), name)
        unstage(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
