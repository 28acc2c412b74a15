"""A training corpus from ``documents``, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the rows
for the next stage, which are written as Parquet in between. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetlake.llm.decontamination import decontaminated
from assetlake.llm.language_id import identified
from assetlake.llm.mixing import mixed
from assetlake.llm.ngram_join import one_of_each
from assetlake.llm.session import written
from assetlake.llm.token_output import materialised


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters and those no language fits go."""
    return identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of word-shingle similarity 0.75 or more join, the smallest id stays; of repeated rows
    and of rows without an id one stays (``one_of_each``)."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token sequences in training order."""
    return materialised(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing), ("token-ID / binary output", output)]

#: Language ID and tokenization cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
