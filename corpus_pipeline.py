"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Every stage takes any table with the columns of ``documents`` and passes further columns on, whatever
their names. An empty table goes through all stages. Rows are treated as follows.

- Null, empty and blank texts: rejected by the quality rules. Texts without a word: never near copies.
- Null languages and sources: groups and a source of their own. Null ids: kept, last to stay in a
  group of near copies, mixed in by the hash of their text.
- Very long texts: measured, compared, scanned and encoded whole.
- Ties: a value at a cutoff passes; of near copies the least id stays, of equal ids the least hash.
- Repeated rows: near copies of each other, so one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symgrid.llm import bpe, mixing, quality, secrets, simhash
from symgrid.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of their language and source go."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id."""
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced by a mark and ``n_chars`` follows; every document stays."""
    return secrets.redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are emitted as often as the sources' target weights need, however small a source is."""
    return mixing.mix(docs, mixing.WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, exact`` of each copy that the mixing emitted."""
    return bpe.encode_documents(docs)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("secret scan", secret_scan), ("source mixing", source_mixing), ("bpe", tokenize)]

#: SimHash groups and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. The last one's result is returned unwritten."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
