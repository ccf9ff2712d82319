"""A corpus pipeline of five operators: toxicity, line dedup, n-gram join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
`documents`. A text that changes has its n_chars counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import stored, table
from corvane.llm.line_dedup import dedup_lines
from corvane.llm.mixing import mixed_documents
from corvane.llm.ngram_join import first_of_groups
from corvane.llm.packing import pack_query
from corvane.llm.toxicity import held_out, score, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 1/2."""
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model, out_col="_corvane_score").where("_corvane_score < 0.5").drop("_corvane_score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one line of every component of near-equal lines; emptied ones keep their row."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies; rows that agree in doc_id and text are one; rows
    without words or without a doc_id stay; an empty table stays empty."""
    return first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return pack_query(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack_windows)]

#: The classifier, the flow and the packing can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
