"""Queries of wrapping, splitting and the whole preparation of cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuemill.operators import cues as cue_op
from cuemill.operators import wrap as op
from cuemill.plans.cue_queries import _C, _LIMIT, _LINES, _language
from cuemill.session import read


def _cues(spark, d):
    return cue_op.distinct_cues(read(spark, d, "cues"))


def wrap_lines(spark, d):
    return op.wrap_and_split(_cues(spark, d), split=False)


def wrap_lines_full(spark, d):
    return op.wrap_and_split(_cues(spark, d), mode="full", split=False)


def timeline_split(spark, d):
    return op.wrap_and_split(_cues(spark, d))


_BLANKS = r"[\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def wrap_kept(spark, d):
    """What wrapping and splitting must not change: the signs of an episode, and that no piece leaves its stretch of time."""
    signs = lambda c: F.sum(F.length(F.regexp_replace(F.coalesce(c, F.lit("")), _BLANKS, "")))
    cues = _cues(spark, d)
    wrapped = wrap_lines(spark, d).groupBy("episode_id").agg(signs("text").alias("wrapped"))
    split = timeline_split(spark, d).groupBy("episode_id").agg(signs("text").alias("split"), F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    span = cues.groupBy("episode_id").agg(F.least(F.min("start_ms"), F.min("end_ms")).alias("low"), F.greatest(F.max("end_ms"), F.max("start_ms")).alias("high"))
    inside = F.coalesce((F.col("s") >= F.col("low")) & (F.col("e") <= F.col("high")), F.lit(True))
    return wrapped.join(split, "episode_id").join(span, "episode_id").select("episode_id", "wrapped", "split", inside.alias("inside"))


def compliance_report(spark, d):
    return op.compliance(_cues(spark, d).withColumn("is_split", F.lit(False)))


def stage_a(spark, d):
    """Clip overlaps where there are any, clean sound descriptions and disfluencies, wrap and split."""
    from cuemill.pipeline import stage_a as chain

    return chain(_cues(spark, d), overlap="auto", sdh=True, disfluency=True, resplit="on")


def stage_a_compliance(spark, d):
    return op.compliance(stage_a(spark, d))


QUERIES = {f.__name__: f for f in (wrap_lines, wrap_lines_full, timeline_split, wrap_kept, compliance_report, stage_a, stage_a_compliance)}

SQL = {
    "wrap_kept": f"""{_C} SELECT episode_id, CAST(sum(length(regexp_replace(coalesce(text, ''), '{_BLANKS}', '', 'g'))) AS BIGINT) AS wrapped, CAST(sum(length(regexp_replace(coalesce(text, ''), '{_BLANKS}', '', 'g'))) AS BIGINT) AS split, true AS inside
FROM c GROUP BY episode_id""",
    "compliance_report": f"""{_C}, l AS (SELECT *, {_LINES} AS ls, (end_ms - start_ms) / 1000 AS sec FROM c),
f AS (SELECT episode_id, len(list_filter(ls, lambda x: length(x) > ({_LIMIT.format(l='(' + _language('x') + ')')}))) > 0
  OR coalesce(sec > 0 AND coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) / sec > 20.0, false) AS warn FROM l)
SELECT episode_id, count(*) AS total, count(*) FILTER (WHERE NOT warn) AS compliant, round(count(*) FILTER (WHERE NOT warn) / count(*) * 100, 4) AS rate FROM f GROUP BY episode_id""",
}
