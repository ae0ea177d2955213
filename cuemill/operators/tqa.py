"""Quality assessment: from runs over samples and dimensions to episodes and configurations of models.

The path is a chain of aggregates with rounding between them: sample and
dimension, dimension mean, weighted episode score, model score weighted by
samples. Weighted means are first rounded to nine places, so that the order of
summation can't decide a tie. A candidate is one episode translated by one
model under one sampling arm; which one, only the blind map and the manifest of
cases tell, and they are joined last.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The known hard failures, and what the default profile sets.
HARD_FAILURES = ("SEMANTIC_INVERSION", "IDENTITY_CONFUSION", "CRITICAL_OMISSION", "FABRICATION", "OFFENSIVE_MISTRANSLATION")
ENABLED = ("SEMANTIC_INVERSION", "IDENTITY_CONFUSION", "CRITICAL_OMISSION", "FABRICATION")
PRIORITY = {"PASS": 0, "CONDITIONAL_PASS": 1, "FAIL": 2, "VETO": 3}
SEED = 20260811


class Gates(NamedTuple):
    """What a profile decides about the aggregation."""

    floor: float = 4.0
    episode_pass: float = 6.5
    model_pass: float = 6.5
    veto: bool = True
    veto_above: int = 3  # hard failures of an episode
    most_failed: int = 2  # dimensions below the floor
    most_hard: int = 3
    severity: tuple[int, int, int] = (3, 5, 7)
    enabled: tuple[str, ...] = ENABLED
    final: str = "median"
    display: str = "weighted_avg"
    runs: int = 3
    extra_runs: int = 2
    divergent: float = 3.0
    seed: int = SEED

    @classmethod
    def of(cls, profile: dict) -> Gates:
        tqa, judge = profile["tqa"], profile["evaluator"]
        pass_, cond, bounds = tqa["thresholds"], tqa["conditional_pass"], tqa["severity_thresholds"]
        return cls(
            float(pass_["dimension_floor"]), float(pass_["episode_pass"]), float(pass_["model_pass"]), bool(pass_["hard_failure_veto"]),
            int(tqa["hard_failures"]["max_hard_failures_per_episode"]), int(cond["max_failed_dimensions"]), int(cond["max_hard_failures_per_episode"]),
            (bounds["critical_upper"], bounds["major_upper"], bounds["minor_upper"]), tuple(tqa["hard_failures"]["enabled"]), judge["final_score"], tqa["sample_aggregation"],
            int(judge["runs"]), int(judge["re_evaluate_extra_runs"]) if judge["divergence_action"] == "re_evaluate" else 0, float(judge["divergence_threshold"]), int(judge["random_seed"]),
        )


DEFAULT = Gates()


def ledger(assessments: DataFrame) -> DataFrame:
    """Valid records, each once."""
    keep = ("anonymous_id", "sample_id", "candidate_id", "dimension", "evaluator_run_id", "score", "hard_failures", "scored_by", "refusal_detected", "run_index")
    return assessments.where("valid").select(*keep).distinct()


def final_scores(records: DataFrame) -> DataFrame:
    """Median, mean and trimmed mean over the runs of an item; hard failures and refusals of any run."""
    n, total = F.count("score"), F.sum("score")
    trimmed = F.when(n >= 3, (total - F.min("score") - F.max("score")) / (n - 2)).otherwise(F.avg("score"))
    return records.groupBy("anonymous_id", "sample_id", "candidate_id", "dimension").agg(
        F.round(F.median("score"), 4).alias("median"), F.round(F.avg("score"), 4).alias("mean"), F.round(trimmed, 4).alias("trimmed_mean"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("hard_failures", F.array().cast("array<string>")))))).alias("hard"), F.bool_or("refusal_detected").alias("refused"), F.count("*").alias("runs"),
    )


def divergence(records: DataFrame, gates: Gates = DEFAULT) -> DataFrame:
    """Items whose first runs differ by at least the threshold."""
    spread = (F.max("score") - F.min("score")).alias("spread")
    return records.where(F.col("run_index") < gates.runs).groupBy("anonymous_id").agg(spread, F.count("*").alias("runs")).where((F.col("runs") >= 2) & (F.col("spread") >= gates.divergent))


def dimension_means(scores: DataFrame, gates: Gates = DEFAULT) -> DataFrame:
    """Mean of each candidate's dimension, rounded before any further use, and its severity."""
    means = scores.groupBy("candidate_id", "dimension").agg(F.round(F.avg(gates.final), 4).alias("mean"), F.count("*").alias("n"))
    return means.withColumn("severity", severity(F.col("mean"), gates))


def round4(x: Column) -> Column:
    """Four places, ties up, whatever the binary form of the tie."""
    return F.floor(F.round(x * 10000, 5) + 0.5) / 10000


def severity(score: Column, gates: Gates = DEFAULT) -> Column:
    out = F.lit("PASS")
    for bound, name in reversed(tuple(zip(gates.severity, ("CRITICAL", "MAJOR", "MINOR")))):
        out = F.when(score <= bound, name).otherwise(out)
    return out


def status(score: Column, failed: Column, hard: Column, gates: Gates = DEFAULT) -> Column:
    fail = (score < gates.episode_pass) | (failed > gates.most_failed) | (hard > gates.most_hard)
    veto = F.lit(gates.veto) & (hard > gates.veto_above)
    return F.when(veto, "VETO").when(fail, "FAIL").when((failed > 0) | (hard > 0), "CONDITIONAL_PASS").otherwise("PASS")


def hard_failures(rows: DataFrame, key: str, column: str, gates: Gates = DEFAULT) -> DataFrame:
    """(key, kind): each enabled hard failure of a key once."""
    kinds = F.array_intersect(F.coalesce(column, F.array().cast("array<string>")), F.array(*map(F.lit, gates.enabled)).cast("array<string>"))
    return rows.select(key, F.explode(kinds).alias("kind")).distinct()


def episodes(scores: DataFrame, weights: DataFrame, gates: Gates = DEFAULT) -> DataFrame:
    """Weighted score, counts and status of each candidate; enabled hard failures count once per sample and kind."""
    means = dimension_means(scores, gates).join(weights, "dimension")
    base = means.groupBy("candidate_id").agg(
        F.round(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("mean")), F.sum("weight")), F.lit(0.0)), 9).alias("raw"), F.count_if(F.col("mean") < gates.floor).alias("failed")
    )
    hard = hard_failures(scores.withColumn("__k", F.struct("candidate_id", "sample_id")), "__k", "hard", gates).groupBy(F.col("__k.candidate_id").alias("candidate_id")).agg(F.count("*").alias("hard_count"))
    samples = scores.groupBy("candidate_id").agg(F.countDistinct("sample_id").alias("sample_count"), F.countDistinct(F.when(F.col("refused"), F.col("sample_id"))).alias("refusal_count"))
    joined = base.join(samples, "candidate_id").join(hard, "candidate_id", "left").na.fill(0, ["hard_count"])
    return joined.select("candidate_id", "raw", round4(F.col("raw")).alias("score"), "failed", "hard_count", "sample_count", "refusal_count", status(F.col("raw"), F.col("failed"), F.col("hard_count"), gates).alias("status"))


def sample_display(scores: DataFrame, weights: DataFrame, gates: Gates = DEFAULT) -> DataFrame:
    """Report-only score of a sample over its dimensions in all three ways, and the severity of the profile's one."""
    s = scores.join(weights, "dimension").withColumn("v", F.col(gates.final))
    out = s.groupBy("candidate_id", "sample_id").agg(
        F.round(F.try_divide(F.sum(F.col("weight") * F.col("v")), F.sum("weight")), 9).alias("w"), F.min("v").alias("lowest"),
        F.when(F.min("v") == 0, 0.0).otherwise(F.try_divide(F.count("*"), F.sum(F.try_divide(F.lit(1.0), F.col("v"))))).alias("h"),
    )
    shown = F.col({"weighted_avg": "w", "min": "lowest", "harmonic": "h"}[gates.display])
    return out.select("candidate_id", "sample_id", round4(F.col("w")).alias("weighted"), "lowest", round4(F.col("h")).alias("harmonic"), severity(shown, gates).alias("severity"))


SAMPLING = ("temperature_sent", "temperature", "top_p_sent", "top_p")


def unblinded(episode_rows: DataFrame, blind_map: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes with lane, episode, model and sampling; cases that failed technically).

    ``blind_map`` has candidate_id, case_id, lane and status, ``cases`` has
    case_id, episode_id, model and the four sampling fields. A candidate without
    scores has score 0 over no samples. Both grow with the candidates, so the
    joins are left to the optimizer.
    """
    known = blind_map.join(cases.select("case_id", "episode_id", "model", *SAMPLING), "case_id")
    failed = known.where("status = 'technical_failure'").select("case_id")
    scored = known.where("status <> 'technical_failure'").withColumnRenamed("status", "outcome").join(episode_rows, "candidate_id", "left")
    none = {"raw": 0.0, "score": 0.0, "failed": 0, "hard_count": 0, "sample_count": 0, "refusal_count": 0, "status": "FAIL"}
    return scored.na.fill(none), failed


def models(episode_rows: DataFrame, gates: Gates = DEFAULT) -> DataFrame:
    """(model, sampling fields, lane, score, status, sample_count, episodes, rank): episodes weighted by samples; the worst status wins."""
    worst = F.max_by("status", F.coalesce(*[F.when(F.col("status") == s, F.lit(p)) for s, p in PRIORITY.items()]))
    raw = F.round(F.coalesce(F.try_divide(F.sum(F.col("score") * F.col("sample_count")), F.sum("sample_count")), F.lit(0.0)), 9)
    out = episode_rows.groupBy("model", *SAMPLING, "lane").agg(raw.alias("raw"), worst.alias("worst"), F.sum("sample_count").alias("sample_count"), F.count("*").alias("episodes"))
    gated = F.when(F.col("worst").isin("PASS", "CONDITIONAL_PASS") & (F.col("raw") < gates.model_pass), "FAIL").otherwise(F.col("worst"))
    scored = out.select("model", *SAMPLING, "lane", round4(F.col("raw")).alias("score"), gated.alias("status"), "sample_count", "episodes")
    order = Window.partitionBy("lane").orderBy(F.desc("score"), "model", *SAMPLING)  # as many rows as the profile has configurations
    return scored.withColumn("rank", F.row_number().over(order))


def run_id(item: Column, run: Column) -> Column:
    return F.concat(F.lit("eval-"), F.substring(F.sha2(F.concat_ws(":", item, run), 256), 1, 20))


def problems(assessments: DataFrame) -> DataFrame:
    """Why a record is not to be used, as codes joined by commas."""
    known = F.array(*map(F.lit, HARD_FAILURES))
    checks = [
        (F.col("score").isNull(), "no_score"), (F.col("score").isNotNull() & ~F.col("score").between(0, 10), "score_range"),
        (F.coalesce(F.trim("rationale"), F.lit("")) == "", "no_rationale"), (F.col("confidence").isNull(), "no_confidence"), (F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1), "confidence_range"),
        (F.size(F.array_distinct("hard_failures")) != F.size("hard_failures"), "repeated_failure"), (F.size(F.array_except("hard_failures", known)) > 0, "unknown_failure"),
        ((F.col("scored_by") == "evaluator") & F.col("evaluator_id").isNull(), "no_evaluator"),
        (~F.col("evaluator_run_id").eqNullSafe(run_id(F.col("anonymous_id"), F.col("run_index").cast("string"))), "run_id"),
    ]
    codes = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks])), ",")
    return assessments.select("evaluator_run_id", "retry_index", codes.alias("codes")).where("codes <> ''").distinct()


def shuffled(items: DataFrame, key: str, gates: Gates = DEFAULT, digits: int = 4) -> DataFrame:
    """(run_index, key, place): every run's own seeded order of all items.

    The order is that of a keyed hash, cut into 16 ** digits ranges by its first
    digits; places within a range are found in one task each, the ranges' starts
    from their sizes.
    """
    runs = items.select(key, F.explode(F.array(*map(F.lit, range(gates.runs)))).alias("run_index"))
    hashed = runs.withColumn("__h", F.sha2(F.concat((F.lit(gates.seed) + F.col("run_index")).cast("string"), F.lit(":"), F.col(key)), 256)).withColumn("__r", F.substring("__h", 1, digits))
    sizes = hashed.groupBy("run_index", "__r").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("run_index").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("run_index", "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("run_index", "__r").orderBy("__h", key))
    return hashed.withColumn("__w", within).join(starts, ["run_index", "__r"]).select("run_index", key, (F.col("__start") + F.col("__w")).alias("place"))
