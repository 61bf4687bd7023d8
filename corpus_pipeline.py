"""Training-corpus pipeline over ``documents``: STAGES in order, each written and read again by its caller or by ``run``.

Defined results of every stage: columns of the input are passed on, whatever their
names; a null or empty text is clean, and stays null or empty; rows without an id, and
rows that repeat one, stay unless their text goes; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from quarry.llm.common import drop_scratch, scratch_made, stored, table

#: Domains of the mixing stage, and the shares of tokens they are to have; toxic documents are gone by then.
DOMAIN = "CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' END"
WEIGHTS = {"high": 0.88, "low": 0.12}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity score rejects; learns from the labelled documents of its input."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat or nearly repeat an earlier line, and documents that consist of such lines."""
    return line_dedup.dedup_lines(docs, **line_dedup.WHOLE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the n-gram Jaccard join."""
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of domains below their target share; none is dropped."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), WEIGHTS, DOMAIN)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and of the decoded bytes."""
    return bpe.round_trip(docs, *bpe.public_vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: No stage but the joins can be stated in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), scratch_made()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        drop_scratch(spark, since)  # only the stage's result is read again
    return STAGES[-1][1](spark, docs, sf_dir)
