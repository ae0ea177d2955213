"""Queries of the pair checks over the translation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.pairs import find_defects
from cuemill.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_defects(read(spark, sf_dir, "translate_results"), "result_id")


def p1_defects_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and defects of each model."""
    results = read(spark, sf_dir, "translate_results")
    models = results.groupBy("result_id").agg(F.max_by("model_alias", "created_at").alias("model_alias"))
    return models.join(find_defects(results, "result_id"), "result_id", "left").groupBy("model_alias", "defect").agg(F.count("*").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_defects_by_model": p1_defects_by_model}
SQL: dict[str, str] = {}
