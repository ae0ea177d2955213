"""Queries of the packing operator over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.llm.packing import CAPACITY, pack_texts
from cuemill.llm.tokens import with_tokens
from cuemill.session import materialize, read


def _packed(spark: SparkSession, sf_dir: str, top_up: bool = True) -> DataFrame:
    return pack_texts(read(spark, sf_dir, "documents"), ["doc_id"], "text", top_up=top_up)


def p6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document with its container and how full that is."""
    packed = materialize(_packed(spark, sf_dir))
    fill = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("container_tokens"))
    return packed.join(fill, "container", "left").select(
        "doc_id", "piece", "tokens", "container", "container_tokens", (F.col("container_tokens") / CAPACITY).alias("fill")
    )


def _report(packed: DataFrame) -> DataFrame:
    fill = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("used"), F.count("*").alias("n"))
    return fill.agg(
        F.count("*").alias("containers"),
        F.sum("n").alias("pieces"),
        F.sum("used").alias("tokens"),
        F.ceil(F.sum("used") / CAPACITY).alias("least_containers"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * CAPACITY), 6).alias("fill"),
    )


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(_packed(spark, sf_dir))


def p6_fill_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of the plain harmonic bins, without topping up."""
    return _report(_packed(spark, sf_dir, top_up=False))


def p6_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document: whether its pieces add up to its size, are numbered from 0, are full but for the last, and lie in containers within the capacity."""
    sizes = with_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "size")
    packed = p6_assignment(spark, sf_dir)
    ok = (F.col("tokens") == CAPACITY) | (F.col("piece") == F.col("last"))
    rows = packed.withColumn("last", F.max("piece").over(Window.partitionBy("doc_id")))
    per = rows.groupBy("doc_id").agg(
        F.sum("tokens").alias("total"), (F.max("piece") + 1 == F.count("*")).alias("numbered"), F.bool_and(ok).alias("undivided"),
        F.bool_and(F.coalesce(F.col("container_tokens") <= CAPACITY, F.col("tokens") == 0)).alias("fits"),
    )
    return sizes.join(per, "doc_id", "left").select("doc_id", F.coalesce(F.col("total") == F.col("size"), F.lit(False)).alias("whole"), "numbered", "undivided", "fits")


QUERIES = {"p6_assignment": p6_assignment, "p6_fill": p6_fill, "p6_fill_plain": p6_fill_plain, "p6_whole": p6_whole}
SQL = {"p6_whole": "SELECT doc_id, true AS whole, true AS numbered, true AS undivided, true AS fits FROM documents"}
