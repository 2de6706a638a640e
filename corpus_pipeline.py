"""A corpus pipeline of the training-data operators: each stage reads what the one before kept.

quality keeps documents that the classifier accepts, near_duplicates one document of each group of
similar ones, decontamination those that hold no benchmark item, encoding turns the rest into ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafpress.llm.bpe import bpe_digests
from leafpress.llm.common import persist, read
from leafpress.llm.decontaminate import keep_clean
from leafpress.llm.jaccard_join import keep_one_each
from leafpress.llm.quality import fit_quality, keep_quality
from leafpress.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text the classifier accepts; null and empty texts are judged as empty ones, ids play no part."""
    return keep_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar texts, that with the smallest id; rows with equal or null ids are rows like others."""
    return keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, whatever their id; null and empty texts hold none."""
    return keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row, as digests; null and empty texts have no ids."""
    return bpe_digests(docs, tokenizer_path(spark, "byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: No SQL states the classifier or the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
