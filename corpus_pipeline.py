"""The corpus pipeline: quality, line dedup, near duplicates, decontamination and packing, one stage after another.

Every stage works on all that the stage before it kept, written as Parquet to the shared folder and read again.
Stages return the columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import Workspace
from tidewake.llm.decontamination import keep_clean
from tidewake.llm.line_dedup import dedup_lines
from tidewake.llm.ngram_join import similar_components
from tidewake.llm.packing import pack
from tidewake.llm.quality_classifier import keep_quality, train
from tidewake.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels of `labels`; documents without a label count too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs.select(*COLUMNS), train(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller id holds; n_chars follows the text."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates: five-word shingles, Jaccard 0.8 or more. Repeated rows of one id and text give one row; rows without an id stay."""
    docs = docs.select(*COLUMNS)
    groups = similar_components(docs)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no stretch of a benchmark item."""
    return keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", packing)]
#: SQL can express neither the trained classifier nor the differencing; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
