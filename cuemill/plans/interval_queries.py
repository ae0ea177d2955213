"""Queries and SQL of the interval operator over the cues of each episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.timecode import lenient_ms
from cuemill.operators.intervals import periods_and_gaps
from cuemill.session import read


def _cue_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = read(spark, sf_dir, "cues")
    return cues.select("episode_id", lenient_ms(F.col("start_tc")).alias("s"), lenient_ms(F.col("end_tc")).alias("e"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(_cue_intervals(spark, sf_dir), "episode_id", "s", "e")


def p2_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and uncovered time per episode."""
    found = periods_and_gaps(_cue_intervals(spark, sf_dir), "episode_id", "s", "e")
    length = F.col("end_ms") - F.col("start_ms")
    is_gap = F.col("kind") == "gap"
    return found.groupBy("episode_id").agg(
        F.count_if(~is_gap).alias("n_periods"),
        F.count_if(is_gap).alias("n_gaps"),
        F.sum(F.when(~is_gap, length)).alias("covered_ms"),
        F.coalesce(F.sum(F.when(is_gap, length)), F.lit(0).cast("bigint")).alias("gap_ms"),
        F.coalesce(F.max(F.when(is_gap, length)), F.lit(0).cast("bigint")).alias("longest_gap_ms"),
    )


_PARSE = r"""CASE WHEN regexp_full_match(trim({c}, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)||chr(12288)), '[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}[,.][0-9]{{1,3}}') THEN
  (CAST(split_part(trim({c}, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)||chr(12288)), ':', 1) AS BIGINT) * 3600
   + CAST(split_part({c}, ':', 2) AS BIGINT) * 60
   + CAST(substr(split_part({c}, ':', 3), 1, 2) AS BIGINT)) * 1000
   + CAST(rpad(trim(substr(split_part({c}, ':', 3), 4), chr(32)||chr(9)||chr(10)||chr(13)||chr(160)||chr(12288)), 3, '0') AS BIGINT) END"""

_FOUND_SQL = f"""
WITH iv AS (
  SELECT episode_id, {_PARSE.format(c='start_tc')} AS s, {_PARSE.format(c='end_tc')} AS e FROM cues),
ok AS (SELECT DISTINCT episode_id, s, e FROM iv WHERE e > s),
reach AS (SELECT *, max(e) OVER (PARTITION BY episode_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ok),
runs AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM reach),
periods AS (SELECT episode_id, run, min(s) AS start_ms, max(e) AS end_ms FROM runs GROUP BY episode_id, run),
gaps AS (SELECT episode_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY episode_id ORDER BY start_ms) AS end_ms FROM periods),
found AS (
  SELECT episode_id, 'period' AS kind, start_ms, end_ms FROM periods
  UNION ALL SELECT episode_id, 'gap' AS kind, start_ms, end_ms FROM gaps WHERE end_ms IS NOT NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_coverage": p2_coverage}

SQL = {
    "p2_found": _FOUND_SQL + "SELECT episode_id, kind, start_ms, end_ms FROM found",
    "p2_coverage": _FOUND_SQL
    + """SELECT episode_id, count(*) FILTER (WHERE kind = 'period') AS n_periods, count(*) FILTER (WHERE kind = 'gap') AS n_gaps,
  CAST(sum(end_ms - start_ms) FILTER (WHERE kind = 'period') AS BIGINT) AS covered_ms,
  CAST(coalesce(sum(end_ms - start_ms) FILTER (WHERE kind = 'gap'), 0) AS BIGINT) AS gap_ms,
  CAST(coalesce(max(end_ms - start_ms) FILTER (WHERE kind = 'gap'), 0) AS BIGINT) AS longest_gap_ms
FROM found GROUP BY episode_id""",
}
