"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, BPE."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from groundmesh.llm.bpe import encode_documents
from groundmesh.llm.common import shared_folder, table
from groundmesh.llm.lines import drop_recurring_lines
from groundmesh.llm.mixing import mixed_documents
from groundmesh.llm.neardup import keep_one
from groundmesh.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the n-gram ratio reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go; no document does."""
    return drop_recurring_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays; the others go."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, with the words taken."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row's text, as little-endian 16-bit integers, with their digests."""
    return encode_documents(docs, keep_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_dedup), ("source mix", mix), ("bpe", encode)]

#: No SQL: n-gram hashing, sketches and BPE are not for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
