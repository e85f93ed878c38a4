"""Corpus preparation: quality, near duplicates, benchmark leaks, personal data, token ids.

Every stage takes whole tables of documents (doc_id, text and any other columns, which it
leaves as they are). Defined results for awkward rows: a null text counts as an empty one
and stays null unless a stage says otherwise; a null doc_id is an id like any other that
equals nothing; rows that repeat are treated alike; an empty table stays empty; columns
of any name may be there, also names that the operators use inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata.llm import bpe, contamination, neardup, pii, quality
from blockstrata.llm.queries import split_pattern, vocabulary
from blockstrata.runtime import keep, remove, table_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Null and empty texts are scored as a text without words; repeated rows go or stay
    together. Labels of rows that ``docs`` does not hold do not train.
    """
    return quality.keep_good(docs, quality.fit(docs, table_dir(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of documents that share 0.8 of their five-word shingles.

    Documents without words and rows without an id stay; all rows of a repeated id go or stay together.
    """
    gone = neardup.near_duplicates(docs, shingle=5).filter(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold eight words in a row of a benchmark item, or the whole of a shorter one.

    Null and empty texts hold none and stay; so do all documents if the benchmark is empty.
    """
    return contamination.drop_contaminated(docs, table_dir(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data and secrets in the texts; ``n_chars``, if there, follows. Null texts stay null."""
    return pii.mask_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the text decoded from them, a row for each row; null and empty texts have no ids."""
    return bpe.encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern())


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("pii", mask_private), ("bpe", to_tokens)]

#: The learned scores and the merges of byte pairs are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage keeps is written once, and gone when the next one is."""
    df, path = table_dir(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if k + 1 < len(STAGES):
            df, written = keep(df)
            if path:
                remove(spark, path)
            path = written
    return df
