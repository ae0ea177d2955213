"""Queries of the splitting operator over the cue texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.split import LIMIT, OVERLAP, split_oversized
from cuemill.session import read


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read(spark, sf_dir, "cues"), ["episode_id", "id"], "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where(F.col("cut").isNotNull()).select("episode_id", "id", "cut").distinct()


def p5_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue put together again from its pieces without their overlaps, and whether all pieces keep the limits."""
    pieces = p5_pieces(spark, sf_dir)
    core = F.struct("piece", F.substring(F.col("piece_text"), F.col("overlap_chars") + 1, F.lit(1 << 30)).alias("t"))
    fits = (F.char_length("piece_text") <= LIMIT) & (F.col("overlap_chars") <= OVERLAP)
    ordered = F.transform(F.array_sort(F.collect_list(core)), lambda x: x["t"])
    whole = pieces.groupBy("episode_id", "id", F.col("cut").isNotNull().alias("is_cut")).agg(F.array_join(ordered, "").alias("text"), F.coalesce(F.bool_and(fits | F.col("cut").isNull()), F.lit(True)).alias("fits"), (F.max("piece") + 1 == F.max("n_pieces")).alias("numbered"))
    return whole.where("is_cut").drop("is_cut")


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_rebuilt": p5_rebuilt}

SQL = {
    "p5_found": r"""
SELECT DISTINCT episode_id, id,
  CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \t\n\r\x{A0}\x{3000}.,;:!?…。，、；：！？]'), lambda x: length(x))) > 200
       THEN 'forced' ELSE 'natural' END AS cut
FROM cues WHERE length(text) > 200""",
    "p5_rebuilt": "SELECT DISTINCT episode_id, id, text, true AS fits, true AS numbered FROM cues WHERE length(text) > 200",
}
