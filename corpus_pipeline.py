"""The corpus pipeline: quality, toxicity, near copies, benchmark leaks, mixing.

Each stage works on all documents that the stage before it kept; the rows between
stages are written as Parquet in the cluster's shared folder and read again, and a stage's
folder is removed once the next one is written.

Odd rows. Null and empty texts are rejected by the quality stage where it knows any grade
or not; where labels are missing altogether, all other documents stay, and the toxicity
stage keeps all. Repeated rows count as documents of their own until the near-copy stage, which
keeps one. Null ids, sources and languages pass. The stages of an empty table are
empty. Columns that documents have besides their own pass all stages but the mix; one
that is named like a column that an operator adds (expected_grade, tail_prob, selected,
score, hits) is dropped on the way by that operator, so documents must not use these names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm.common import prepare, read_table
from twinfold.llm.decontaminate import find_items
from twinfold.llm.mixing import mix_sources
from twinfold.llm.near_join import near_groups, one_of_each
from twinfold.llm.quality import grade_documents, train_quality
from twinfold.llm.toxicity import score_toxicity, train_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likelier than not; null and empty texts go."""
    model = train_quality(docs, read_table(spark, sf_dir, "labels"))
    return grade_documents(docs, model).where("selected").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, or exactly 0.5 as all do where no labels are known."""
    labels = read_table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels)
    known = F.lit(bool(model.vocabulary))
    return score_toxicity(docs, model).where((F.col("score") < 0.5) | ~known).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id, null ids last; texts without words have no near copies, but one of equal rows stays."""
    prepare(spark)
    return one_of_each(docs, near_groups(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty items are none."""
    found = find_items(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left, one row a document with the shards of its draws and its place in each; a null source is a source of its own."""
    prepare(spark)
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "shards", "order_keys")


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("mix", mix)]

#: The classifiers, MinHash values and the splitting tree can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to the mix."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path  # type: ignore[union-attr]
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done is not None:
            old = path(done)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        done = f"{folder}/{name}"
    return docs
