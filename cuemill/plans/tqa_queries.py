"""Quality-assessment queries, with the SQL they are checked against.

The tables hold no blind map: the candidates are dealt to the cases of the grid
by their number, every seventh of them in the rescue lane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators import bench
from cuemill.operators import tqa as op
from cuemill.session import number_rows, read

ARMS = ((None, None), (0.3, None), (0.7, 0.9))  # temperature and top_p, null where they are not sent
_DEAL = 7919


def _records(spark: SparkSession, d: str) -> DataFrame:
    return op.ledger(read(spark, d, "assessments"))


def _scores(spark, d):
    return op.final_scores(_records(spark, d))


def _weights(spark, d):
    return read(spark, d, "dimension_weights")


def _episodes(spark, d):
    return op.episodes(_scores(spark, d), _weights(spark, d))


def _cases(spark, d):
    models = read(spark, d, "translate_results").select(F.col("model_alias").alias("model")).where("model <> ''").distinct()
    return bench.cases(models, ARMS, read(spark, d, "episodes").select("episode_id").distinct())


def _blind_map(spark, d, cases):
    a = read(spark, d, "assessments")
    refused = a.groupBy("candidate_id").agg(F.coalesce(F.bool_and(F.when(F.col("valid"), F.col("refusal_detected"))), F.lit(False)).alias("refused"))
    numbered = number_rows(refused, ["candidate_id"], "k")
    n = cases.count()
    lane = F.when(F.col("k") % 7 == 0, "rescue").otherwise("primary")
    dealt = numbered.select("candidate_id", lane.alias("lane"), F.when(F.col("refused"), "provider_refusal").otherwise("completed").alias("status"), (F.col("k") * _DEAL % max(n, 1) + 1).alias("case_number"))
    return dealt.join(cases.select("case_number", "case_id"), "case_number").drop("case_number")


def _unblinded(spark, d):
    cases = _cases(spark, d)
    return op.unblinded(_episodes(spark, d), _blind_map(spark, d, cases), cases)[0]


def final_scores(spark, d):
    return _scores(spark, d).withColumn("hard", F.array_join("hard", ","))


def divergence(spark, d):
    return op.divergence(_records(spark, d))


def dimension_mean(spark, d):
    return op.dimension_means(_scores(spark, d))


def episode_score(spark, d):
    return _episodes(spark, d).drop("raw")


def sample_display(spark, d):
    return op.sample_display(_scores(spark, d), _weights(spark, d))


def unblinded_episodes(spark, d):
    return _unblinded(spark, d).select("candidate_id", "case_id", "lane", "outcome", "episode_id", "model", *op.SAMPLING, "score", "status")


def model_report(spark, d):
    return op.models(_unblinded(spark, d)).where("lane = 'primary'").drop("lane")


def rescue_lane(spark, d):
    return op.models(_unblinded(spark, d)).where("lane = 'rescue'").select("model", *op.SAMPLING, "score", "sample_count", "episodes", "rank")


def progress_counts(spark, d):
    """How far a bench is: cases and what became of them, items, records and enabled hard failures."""
    cases = _cases(spark, d)
    return bench.progress(cases, _blind_map(spark, d, cases), read(spark, d, "assessments"))


def hard_failure_counts(spark, d):
    """Enabled hard failures, each kind once an item."""
    return op.hard_failures(_records(spark, d), "anonymous_id", "hard_failures").groupBy("kind").agg(F.count("*").alias("n"))


def assessment_problems(spark, d):
    return op.problems(read(spark, d, "assessments"))


def resume_antijoin(spark, d):
    """Base runs of every item that no valid record holds yet."""
    a = read(spark, d, "assessments")
    return bench.open_runs(a.select("anonymous_id").distinct(), a.where("valid"), op.DEFAULT)


def run_ids(spark, d):
    items = read(spark, d, "assessments").select("anonymous_id", "run_index").distinct()
    return items.select("anonymous_id", "run_index", op.run_id(F.col("anonymous_id"), F.col("run_index").cast("string")).alias("run_id"))


def shuffled_items(spark, d):
    return op.shuffled(read(spark, d, "assessments").select("anonymous_id").distinct(), "anonymous_id")


def case_grid(spark, d):
    """Every model and sampling arm for every episode, numbered in that order, with its slug."""
    return _cases(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        final_scores, divergence, dimension_mean, episode_score, sample_display, unblinded_episodes, model_report, rescue_lane, progress_counts, hard_failure_counts, assessment_problems, resume_antijoin,
        run_ids, shuffled_items, case_grid,
    )
}

_A = """WITH rec AS (SELECT DISTINCT anonymous_id, sample_id, candidate_id, dimension, evaluator_run_id, score, hard_failures, scored_by, refusal_detected, run_index FROM assessments WHERE valid),
fin AS (SELECT anonymous_id, sample_id, candidate_id, dimension, round(median(score), 4) AS median, round(avg(score), 4) AS mean,
  round(CASE WHEN count(score) >= 3 THEN (sum(score) - min(score) - max(score)) / (count(score) - 2) ELSE avg(score) END, 4) AS trimmed_mean,
  list_sort(list_distinct(flatten(list(coalesce(hard_failures, []))))) AS hard, bool_or(refusal_detected) AS refused, count(*) AS runs FROM rec GROUP BY ALL),
dim AS (SELECT candidate_id, dimension, round(avg(median), 4) AS mean, count(*) AS n FROM fin GROUP BY ALL),
b AS (SELECT candidate_id, round(coalesce(sum(weight * mean) / nullif(sum(weight), 0), 0.0), 9) AS raw, count(*) FILTER (WHERE mean < 4.0) AS failed FROM dim JOIN dimension_weights USING (dimension) GROUP BY candidate_id),
h AS (SELECT candidate_id, count(*) AS hard_count FROM (SELECT DISTINCT candidate_id, sample_id, unnest(hard) AS kind FROM fin) WHERE kind <> 'OFFENSIVE_MISTRANSLATION' GROUP BY candidate_id),
s AS (SELECT candidate_id, count(DISTINCT sample_id) AS sample_count, count(DISTINCT CASE WHEN refused THEN sample_id END) AS refusal_count FROM fin GROUP BY candidate_id),
e0 AS (SELECT b.*, s.sample_count, s.refusal_count, coalesce(hard_count, 0) AS hard_count FROM b JOIN s USING (candidate_id) LEFT JOIN h USING (candidate_id)),
ep AS (SELECT candidate_id, floor(round(raw * 10000, 5) + 0.5) / 10000 AS score, failed, hard_count, sample_count, refusal_count, CASE WHEN hard_count > 3 THEN 'VETO' WHEN raw < 6.5 OR failed > 2 OR hard_count > 3 THEN 'FAIL'
  WHEN failed > 0 OR hard_count > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS status FROM e0),
mo AS (SELECT model_alias AS model, row_number() OVER (ORDER BY model_alias) - 1 AS mp FROM (SELECT DISTINCT model_alias FROM translate_results WHERE model_alias <> '')),
ar AS (SELECT * FROM (VALUES (0, false, NULL, false, NULL), (1, true, 0.3, false, NULL), (2, true, 0.7, true, 0.9)) t(ap, temperature_sent, temperature, top_p_sent, top_p)),
es AS (SELECT episode_id, row_number() OVER (ORDER BY episode_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT episode_id FROM episodes)),
gr AS (SELECT (mp * 3 + ap) * n + pos + 1 AS case_number, model, temperature_sent, CAST(temperature AS DOUBLE) AS temperature, top_p_sent, CAST(top_p AS DOUBLE) AS top_p, episode_id FROM mo, ar, es),
ca AS (SELECT *, printf('%03d__%s__%s__temperature-%s__topP-%s', case_number, episode_id, replace(model, '/', '_'), coalesce(CAST(temperature AS VARCHAR), 'OMIT'), coalesce(CAST(top_p AS VARCHAR), 'OMIT')) AS case_id FROM gr),
cd AS (SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) AS k, coalesce(bool_and(refusal_detected) FILTER (WHERE valid), false) AS refused FROM assessments GROUP BY candidate_id),
bm AS (SELECT candidate_id, CASE WHEN k % 7 = 0 THEN 'rescue' ELSE 'primary' END AS lane, CASE WHEN refused THEN 'provider_refusal' ELSE 'completed' END AS outcome, k * 7919 % (SELECT count(*) FROM ca) + 1 AS case_number FROM cd),
lab AS (SELECT bm.candidate_id, case_id, lane, outcome, episode_id, model, temperature_sent, temperature, top_p_sent, top_p, coalesce(score, 0) AS score, coalesce(ep.status, 'FAIL') AS status, coalesce(sample_count, 0) AS sample_count
  FROM bm JOIN ca USING (case_number) LEFT JOIN ep ON bm.candidate_id = ep.candidate_id),
m0 AS (SELECT model, temperature_sent, temperature, top_p_sent, top_p, lane, round(coalesce(sum(score * sample_count) / nullif(sum(sample_count), 0), 0), 9) AS raw,
  max(CASE status WHEN 'VETO' THEN 3 WHEN 'FAIL' THEN 2 WHEN 'CONDITIONAL_PASS' THEN 1 ELSE 0 END) AS p, CAST(sum(sample_count) AS BIGINT) AS sample_count, count(*) AS episodes FROM lab GROUP BY ALL),
m AS (SELECT model, temperature_sent, temperature, top_p_sent, top_p, lane, floor(round(raw * 10000, 5) + 0.5) / 10000 AS score, CASE WHEN p < 2 AND raw < 6.5 THEN 'FAIL' WHEN p = 3 THEN 'VETO' WHEN p = 2 THEN 'FAIL' WHEN p = 1 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS status, sample_count, episodes,
  row_number() OVER (PARTITION BY lane ORDER BY floor(round(raw * 10000, 5) + 0.5) / 10000 DESC, model, temperature_sent, temperature NULLS FIRST, top_p_sent, top_p NULLS FIRST) AS rank FROM m0)
"""

SQL = {
    "final_scores": _A + "SELECT anonymous_id, sample_id, candidate_id, dimension, median, mean, trimmed_mean, array_to_string(hard, ',') AS hard, refused, runs FROM fin",
    "divergence": _A + "SELECT anonymous_id, max(score) - min(score) AS spread, count(*) AS runs FROM rec WHERE run_index < 3 GROUP BY anonymous_id HAVING count(*) >= 2 AND max(score) - min(score) >= 3",
    "dimension_mean": _A + "SELECT *, CASE WHEN mean <= 3 THEN 'CRITICAL' WHEN mean <= 5 THEN 'MAJOR' WHEN mean <= 7 THEN 'MINOR' ELSE 'PASS' END AS severity FROM dim",
    "episode_score": _A + "SELECT * FROM ep",
    "sample_display": _A + """, d AS (SELECT candidate_id, sample_id, round(sum(weight * median) / nullif(sum(weight), 0), 9) AS w, min(median) AS lowest,
  CASE WHEN min(median) = 0 THEN 0.0 ELSE count(*) / sum(1.0 / nullif(median, 0)) END AS h FROM fin JOIN dimension_weights USING (dimension) GROUP BY candidate_id, sample_id)
SELECT candidate_id, sample_id, floor(round(w * 10000, 5) + 0.5) / 10000 AS weighted, lowest, floor(round(h * 10000, 5) + 0.5) / 10000 AS harmonic, CASE WHEN w <= 3 THEN 'CRITICAL' WHEN w <= 5 THEN 'MAJOR' WHEN w <= 7 THEN 'MINOR' ELSE 'PASS' END AS severity FROM d""",
    "unblinded_episodes": _A + "SELECT candidate_id, case_id, lane, outcome, episode_id, model, temperature_sent, temperature, top_p_sent, top_p, score, status FROM lab",
    "model_report": _A + "SELECT model, temperature_sent, temperature, top_p_sent, top_p, score, status, sample_count, episodes, rank FROM m WHERE lane = 'primary'",
    "rescue_lane": _A + "SELECT model, temperature_sent, temperature, top_p_sent, top_p, score, sample_count, episodes, rank FROM m WHERE lane = 'rescue'",
    "progress_counts": _A + """SELECT (SELECT count(*) FROM ca) AS cases_total, (SELECT count(DISTINCT case_id) FROM lab WHERE outcome = 'completed') AS cases_completed, (SELECT count(DISTINCT case_id) FROM lab WHERE outcome = 'provider_refusal') AS provider_refusals,
  0 AS technical_failures, (SELECT count(DISTINCT anonymous_id) FROM assessments) AS assessment_inputs, (SELECT count(*) FROM (SELECT DISTINCT anonymous_id, run_index, evaluator_run_id FROM assessments WHERE valid)) AS assessment_records,
  (SELECT count(*) FROM (SELECT DISTINCT anonymous_id, unnest(hard_failures) AS kind FROM assessments WHERE valid) WHERE kind <> 'OFFENSIVE_MISTRANSLATION') AS hard_failures""",
    "hard_failure_counts": "SELECT kind, count(*) AS n FROM (SELECT DISTINCT anonymous_id, unnest(hard_failures) AS kind FROM assessments WHERE valid) WHERE kind <> 'OFFENSIVE_MISTRANSLATION' GROUP BY kind",
    "assessment_problems": """SELECT DISTINCT evaluator_run_id, retry_index, codes FROM (SELECT *, array_to_string(list_filter([CASE WHEN score IS NULL THEN 'no_score' END,
  CASE WHEN score IS NOT NULL AND score NOT BETWEEN 0 AND 10 THEN 'score_range' END, CASE WHEN coalesce(trim(rationale), '') = '' THEN 'no_rationale' END,
  CASE WHEN confidence IS NULL THEN 'no_confidence' END, CASE WHEN confidence IS NOT NULL AND confidence NOT BETWEEN 0 AND 1 THEN 'confidence_range' END, CASE WHEN len(list_distinct(hard_failures)) <> len(hard_failures) THEN 'repeated_failure' END,
  CASE WHEN len(list_filter(hard_failures, lambda x: x NOT IN ('SEMANTIC_INVERSION', 'IDENTITY_CONFUSION', 'CRITICAL_OMISSION', 'FABRICATION', 'OFFENSIVE_MISTRANSLATION'))) > 0 THEN 'unknown_failure' END,
  CASE WHEN scored_by = 'evaluator' AND evaluator_id IS NULL THEN 'no_evaluator' END,
  CASE WHEN evaluator_run_id IS DISTINCT FROM 'eval-' || substr(sha256(anonymous_id || ':' || CAST(run_index AS VARCHAR)), 1, 20) THEN 'run_id' END], lambda x: x IS NOT NULL), ',') AS codes FROM assessments) WHERE codes <> ''""",
    "resume_antijoin": """SELECT p.anonymous_id, p.run_index FROM (SELECT DISTINCT anonymous_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS run_index FROM assessments) p
WHERE NOT EXISTS (SELECT 1 FROM assessments a WHERE a.valid AND a.anonymous_id = p.anonymous_id AND a.run_index = p.run_index)""",
    "run_ids": "SELECT DISTINCT anonymous_id, run_index, 'eval-' || substr(sha256(anonymous_id || ':' || CAST(run_index AS VARCHAR)), 1, 20) AS run_id FROM assessments",
    "shuffled_items": """SELECT anonymous_id, CAST(run_index AS INTEGER) AS run_index, row_number() OVER (PARTITION BY run_index ORDER BY sha256(CAST(20260811 + run_index AS VARCHAR) || ':' || anonymous_id)) AS place
FROM (SELECT DISTINCT anonymous_id FROM assessments), range(3) t(run_index)""",
    "case_grid": _A + "SELECT case_id, case_number, episode_id, model, temperature_sent, temperature, top_p_sent, top_p FROM ca",
}
