"""Queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, chat, fingerprints, html_extract, jaccard_join, language, line_dedup, media, mixing, ranked, repair, toxicity, warc
from quarry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The others can't be stated in DuckDB's SQL; the tests hold each against brute force, a round trip or held-out rows.
ORACLES: dict[str, str] = {"op3_warc": warc.ORACLE, "op7_chat_pairs": chat.ORACLE, "op10_jaccard_join": jaccard_join.ORACLE, "op11_repair": repair.ORACLE, "op12_ranked": ranked.ORACLE}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *bpe.public_vocabulary())


@query
def op7_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(chat.branched_pairs(table(spark, sf_dir, "conversations")))


@query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"), **line_dedup.WHOLE)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"))


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(repair.damaged(table(spark, sf_dir, "conversations")))


@query
def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))
