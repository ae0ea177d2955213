"""Queries of the encoding repair over the cue texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuemill.llm.garbled import find_garbled
from cuemill.session import read


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled cues with the chains that explain them and the restored text."""
    return find_garbled(read(spark, sf_dir, "cues"), ["episode_id", "id"], "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_garbled(read(spark, sf_dir, "cues"), ["episode_id", "id"], "text", restore=False)
    return found.select("episode_id", "id").distinct()


QUERIES = {"p3_found": p3_found, "p3_restored": p3_restored}
SQL: dict[str, str] = {}
