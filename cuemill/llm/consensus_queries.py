"""Queries of the consensus operator over the assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.consensus import Consensus
from cuemill.session import read


N_LABELS = 11


def _fitted(spark: SparkSession, sf_dir: str) -> Consensus:
    valid = read(spark, sf_dir, "assessments").where((F.col("scored_by") == "evaluator") & F.col("valid"))
    return Consensus(valid, "anonymous_id", "evaluator_id", "score", "scored_at", N_LABELS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).labels().select("anonymous_id", "score")


def p4_found_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote by log-odds of the triplet accuracies alone, without counting labels against the consensus."""
    return _fitted(spark, sf_dir).plain_labels()


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes that count for each item: how many, the lowest, the highest and their sum."""
    codes = F.transform("codes", lambda c: c % N_LABELS)
    items = _fitted(spark, sf_dir).items
    return items.select(F.col("item").alias("anonymous_id"), F.size("codes").alias("n_labels"), F.array_min(codes).alias("lowest"), F.array_max(codes).alias("highest"), F.aggregate(codes, F.lit(0), lambda a, x: a + x).alias("total"))


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of every labelled item, with its agreement and the posterior of the score."""
    return _fitted(spark, sf_dir).labels(least=1)


def p4_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).reliability(spark)


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of all evaluators beyond chance, and the agreement chance alone gives."""
    fit = _fitted(spark, sf_dir)
    return spark.createDataFrame([(len(fit.who), int(fit.votes.sum()), fit.agreement, fit.chance)], "evaluators int, labels bigint, beyond_chance double, by_chance double")


QUERIES = {"p4_found": p4_found, "p4_found_plain": p4_found_plain, "p4_items": p4_items, "p4_consensus": p4_consensus, "p4_reliability": p4_reliability, "p4_agreement": p4_agreement}
SQL = {
    "p4_items": """WITH v AS (SELECT anonymous_id, score FROM assessments WHERE scored_by = 'evaluator' AND valid AND evaluator_id IS NOT NULL AND score BETWEEN 0 AND 10
  QUALIFY row_number() OVER (PARTITION BY anonymous_id, evaluator_id ORDER BY scored_at DESC, score DESC) = 1)
SELECT anonymous_id, CAST(count(*) AS INTEGER) AS n_labels, min(score) AS lowest, max(score) AS highest, CAST(sum(score) AS INTEGER) AS total FROM v GROUP BY anonymous_id""",
}
