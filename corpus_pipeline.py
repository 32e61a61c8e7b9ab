"""Raw documents to token counts: quality, line dedup, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the columns of documents; the last returns a row of digests per document drawn.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import bpe, line_dedup, mixing, ngram_join, quality
from rillflow.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars stays that of the source document."""
    return line_dedup.drop_repeated_lines(docs).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8: what near-duplicate stages take without a contract."""
    return ngram_join.one_of_each(docs, n=5, percent=80).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_copies", drop_near_copies), ("mixing", mix), ("bpe", tokenize)]

#: SQL can express neither the estimation of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
