"""Queries of the mixing operator over the documents and their targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.mixing import Mix, mix
from cuemill.session import read


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen documents with their repeats."""
    return _mix(spark, sf_dir).documents.select("doc_id", "source", "tokens", "repeats")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares


def p7_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets, what is left of them where sources have no documents, and whether the mix reaches that within half a percent."""
    s = _mix(spark, sf_dir).shares
    return s.select("source", "target_share", F.round("fitted_share", 9).alias("fitted_share"), "max_repeats", (F.abs(F.col("actual_share") - F.col("fitted_share")) < 0.005).alias("reached"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_reached": p7_reached}
SQL = {
    "p7_reached": """WITH d AS (SELECT DISTINCT source FROM documents WHERE length(text) > 0), t AS (SELECT m.source, target_share, max_repeats, d.source IS NOT NULL AND target_share > 0 AS live FROM mix_targets m LEFT JOIN d USING (source))
SELECT source, target_share, round(CASE WHEN live THEN target_share / (SELECT sum(target_share) FROM t WHERE live) ELSE 0 END, 9) AS fitted_share, CASE WHEN live THEN max_repeats ELSE 0 END AS max_repeats, true AS reached FROM t""",
}
