"""Queries of the llm operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leakscope.llm import mixture, overlap, ranking, shapes, tokens, topn
from leakscope.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found_pairs(table(spark, sf_dir, "records"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(table(spark, sf_dir, "records"))


def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.record_coverage(table(spark, sf_dir, "records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = topn.top_scores(table(spark, sf_dir, "member_scores"), table(spark, sf_dir, "attack_names"))
    return top.select("target_id", "attack_name", "score_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.exposed_records(*[table(spark, sf_dir, t) for t in ("member_scores", "attack_names", "structural_records", "rank_requests")]).select("target_id", "record_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"))[1]


def p7_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a mixture as large as the listed sources: who falls short at its cap, and by how much."""
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_mix"), total="available")[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.stuffed_pages(table(spark, sf_dir, "documents"))


def p8_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.shape_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (p1_found, p1_report, p1_coverage, p2_found, p3_found, p6_ids, p7_mix, p7_report, p7_full, p8_found, p8_shapes)
    return {q.__name__: q for q in found}
