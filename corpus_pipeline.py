"""From raw documents to token ids: five stages, each an operator of ``threadloom.llm``.

1. language ID: documents that it rejects (``und``: null, or without a letter) go
2. exact dedup: of equal texts the longest stays, then the smallest id
3. n-gram Jaccard join: of each component of near copies one document stays
4. mixing sources to target weights: token prefixes of the leaves, one epoch
5. byte-level BPE: number and digest of the ids, and of the bytes they decode to
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.bpe import encode_documents
from threadloom.llm.dedup_exact import keep_first
from threadloom.llm.jaccard import keep_one
from threadloom.llm.langid import keep_identified
from threadloom.llm.mixing import WEIGHTS, Targets, mix
from threadloom.workspace import materialize, release

#: Share of the tokens that the mixture takes.
SHARE = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, Targets(WEIGHTS, share=SHARE))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: No SQL: language ID, the merges and the near copies aren't expressible; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
