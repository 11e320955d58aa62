"""From raw documents to tokens: the training-data pipeline.

A stage begins when its predecessor's rows have been written and reread, so it first removes the tables that the stage before wrote half-way; tables of other
operators stay. Stages that are called one by one are one run; ``run`` owns its tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wicker.llm.bpe import encode
from wicker.llm.mixing import mixed_documents
from wicker.llm.near_dedup import without_near_duplicates
from wicker.llm.scratch import Tables, written
from wicker.llm.substring_dedup import without_repeated
from wicker.llm.toxicity import without_toxic
from wicker.session import table


#: What the stage called last has written half-way.
_half_way = Tables()


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; learns from all labels of documents that are there."""
    _half_way.clear(spark)
    with _half_way:
        return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    _half_way.clear(spark)
    with _half_way:
        return without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that occur twice."""
    _half_way.clear(spark)
    with _half_way:
        return without_repeated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, by training position."""
    _half_way.clear(spark)
    with _half_way:
        return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, the bytes at which they begin, and the text that they decode to."""
    _half_way.clear(spark)
    with _half_way:
        return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("bpe", bpe)]
#: Learnt weights and byte-pair merges are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are a table that goes as soon as the next one is written; the last stays until the application ends."""
    docs, before = table(spark, sf_dir, "documents"), Tables()
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        now = Tables()
        if stage is STAGES[-2][1]:
            docs = written(made, name)
        else:
            with now:
                docs = written(made, name)
        before.clear(spark)
        before = now
    return STAGES[-1][1](spark, docs, sf_dir)
