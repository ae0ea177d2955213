"""A bench of models: its cases, the blinded items of its samples, their evaluation, progress and report."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.operators.mending import bare
from cuemill.operators.tqa import DEFAULT, HARD_FAILURES, Gates, hard_failures, run_id
from cuemill.session import number_rows

# Columns that must not reach an evaluator, how a reference is to be used, and the steps of a bench in their order.
FORBIDDEN = frozenset({"model_alias", "provider", "parameter_arm", "source_path", "case_path", "original_filename", "rescue_status", "refusal_detected"})
ROLES = ("anchor", "hint")
STAGES = ("plan", "collect", "evaluate", "report")
STATES = {"plan": "planned", "collect": "collected", "evaluate": "evaluated", "report": "awaiting_user_decision"}


def cases(models: DataFrame, arms: Sequence[tuple[float | None, float | None]], episodes: DataFrame) -> DataFrame:
    """(case_number, case_id, episode_id, model, temperature_sent, temperature, top_p_sent, top_p).

    Numbered from 1 by model, arm and episode. The grid is what a bench must
    run, so it is emitted whole: every episode is multiplied by the profile's
    models and arms, without a join between tables that grow. Numbers of models
    and episodes come from their ranges.
    """
    named = number_rows(models.select("model"), ["model"], "m")
    eps = number_rows(episodes.select("episode_id"), ["episode_id"], "e")
    n = eps.count()
    evidence = [F.struct(F.lit(j).alias("a"), F.lit(t is not None).alias("temperature_sent"), F.lit(t).cast("double").alias("temperature"), F.lit(p is not None).alias("top_p_sent"), F.lit(p).cast("double").alias("top_p")) for j, (t, p) in enumerate(arms)]
    armed = named.select("model", "m", F.inline(F.array(*evidence)))
    grid = eps.join(armed)
    number = ((F.col("m") - 1) * len(arms) + F.col("a")) * n + F.col("e")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("OMIT"))
    case_id = F.format_string("%03d__%s__%s__temperature-%s__topP-%s", number, "episode_id", F.replace("model", F.lit("/"), F.lit("_")), shown("temperature"), shown("top_p"))
    return grid.select(number.alias("case_number"), case_id.alias("case_id"), "episode_id", "model", "temperature_sent", "temperature", "top_p_sent", "top_p")


def absent_samples(samples: DataFrame, cues: DataFrame) -> DataFrame:
    """(episode_id, cue_id) of samples without their cue; a bench must not begin unless it is empty."""
    return samples.select("episode_id", "cue_id").distinct().join(cues.select("episode_id", F.col("seq").alias("cue_id")).distinct(), ["episode_id", "cue_id"], "left_anti")


def assessment_inputs(samples: DataFrame, cues: DataFrame, candidates: DataFrame, translations: DataFrame, references: DataFrame | None = None, role: str | None = None, width: int = 5) -> DataFrame:
    """One blinded item per candidate, sample and dimension, numbered in the order of candidate, cue and dimension.

    samples: episode_id, cue_id, dimensions, note; cues: episode_id, seq, text
    with one row per seq; candidates: candidate_id, episode_id, status;
    translations: candidate_id, cue_id, tr; references: episode_id, cue_id,
    reference_text. Candidates that failed technically are left out; a cue
    without a translation has an empty target. Context is the texts of up to
    ``width`` cues before and after, without the cue itself.
    """
    if role is not None and role not in ROLES:
        raise ValueError(f"role must be one of {', '.join(ROLES)}")
    near = Window.partitionBy("episode_id").orderBy("seq")
    text = F.coalesce("text", F.lit(""))
    shown = cues.select(
        "episode_id", F.col("seq").alias("cue_id"), text.alias("source_text"),
        F.collect_list(text).over(near.rowsBetween(-width, -1)).alias("context_before"), F.collect_list(text).over(near.rowsBetween(1, width)).alias("context_after"),
    )
    rows = samples.join(shown, ["episode_id", "cue_id"]).join(candidates.where("status <> 'technical_failure'").select("candidate_id", "episode_id"), "episode_id")
    rows = rows.join(translations.select("candidate_id", "cue_id", F.col("tr").alias("target_text")), ["candidate_id", "cue_id"], "left").na.fill("", ["target_text"])
    if references is None:
        rows = rows.withColumn("reference_text", F.lit(None).cast("string"))
    else:
        rows = rows.join(references.select("episode_id", "cue_id", "reference_text"), ["episode_id", "cue_id"], "left")
    sampled = number_rows(rows.withColumn("reference_role", F.lit(role).cast("string")), ["candidate_id", "cue_id"], "s").withColumn("sample_id", F.format_string("sample-%06d", F.col("s")))
    each = sampled.select("*", F.posexplode("dimensions").alias("d", "dimension"))
    numbered = number_rows(each, ["s", "d"], "a")
    out = numbered.select(
        F.format_string("assessment-%06d", F.col("a")).alias("anonymous_id"), "candidate_id", "sample_id", "dimension", "source_text", "target_text", "reference_text", "reference_role",
        "context_before", "context_after", F.col("note").alias("test_note"),
    )
    return without_provenance(out)


def without_provenance(items: DataFrame) -> DataFrame:
    """The items, unless a column tells who made them."""
    left = FORBIDDEN & {c.lower() for c in items.columns}
    if left:
        raise ValueError(f"forbidden columns: {', '.join(sorted(left))}")
    return items


def open_runs(items: DataFrame, records: DataFrame, gates: Gates = DEFAULT) -> DataFrame:
    """(anonymous_id, run_index) of the base runs that no record holds."""
    planned = items.select("anonymous_id", F.explode(F.array(*map(F.lit, range(gates.runs)))).alias("run_index"))
    return planned.join(records.select("anonymous_id", "run_index").distinct(), ["anonymous_id", "run_index"], "left_anti")


def extra_runs(divergent: DataFrame, records: DataFrame, gates: Gates = DEFAULT) -> DataFrame:
    """Further runs of the divergent items that no record holds."""
    planned = divergent.select("anonymous_id", F.explode(F.array(*map(F.lit, range(gates.runs, gates.runs + gates.extra_runs))).cast("array<int>")).alias("run_index"))
    return planned.join(records.select("anonymous_id", "run_index").distinct(), ["anonymous_id", "run_index"], "left_anti")


FIELDS = ("sample_id", "dimension", "score", "hard_failures", "rationale", "confidence", "evaluator_run_id")


def response_problems(response: object, item: dict, run: str) -> list[str]:
    """What is wrong with an evaluator's response; nothing if it may become a record."""
    if not isinstance(response, dict):
        return ["no_object"]
    plain_int = lambda x: isinstance(x, int) and not isinstance(x, bool)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    got = [f"missing {f}" for f in FIELDS if f not in response] + [f"unexpected {f}" for f in sorted(set(response) - set(FIELDS))]
    if got:
        return got
    want = {"sample_id": item["sample_id"], "dimension": item["dimension"], "evaluator_run_id": run}
    got += [f"other {f}" for f, v in want.items() if response[f] != v]
    score, hard, sure, why = (response[f] for f in ("score", "hard_failures", "confidence", "rationale"))
    checks = (
        (plain_int(score) and 0 <= score <= 10, "score"), (isinstance(hard, list) and all(isinstance(h, str) for h in hard) and len(set(hard)) == len(hard) and set(hard) <= set(HARD_FAILURES), "hard_failures"),
        (number(sure) and 0 <= sure <= 1, "confidence"), (isinstance(why, str) and bool(why.strip()), "rationale"),
    )
    return got + [name for ok, name in checks if not ok]


def read_response(text: str) -> object:
    """The JSON of an evaluator's answer, with or without a fence."""
    return json.loads(bare(text))


RECORD = "anonymous_id string, candidate_id string, sample_id string, dimension string, run_index int, evaluator_run_id string, score int, hard_failures array<string>, rationale string, confidence double, scored_by string, refusal_detected boolean, raw_response_hash string, valid boolean, retry_index int"
Evaluator = Callable[[dict], object]


def evaluate(items: DataFrame, runs: DataFrame, refused: DataFrame, evaluator: Evaluator, retries: int = 2, refusal_kind: str | None = "CRITICAL_OMISSION") -> DataFrame:
    """Records of the given runs (anonymous_id, run_index) of the items.

    Items of refused candidates (candidate_id) are scored 0 by the system. The
    others are handed to ``evaluator``, a function of the item as a mapping that
    returns a response or raises; a response that isn't well-formed is asked for
    again. A run that never succeeds comes out with valid false and the last
    reason as its rationale, so that one bad item doesn't stop the rest: check
    for such rows before a report. Write the result before use, as an evaluator
    need not answer the same twice.
    """
    asked = items.join(runs, "anonymous_id").join(refused.select("candidate_id", F.lit(True).alias("__no")).distinct(), "candidate_id", "left")
    asked = asked.withColumn("evaluator_run_id", run_id(F.col("anonymous_id"), F.col("run_index").cast("string")))
    schema = T._parse_datatype_string(RECORD)
    arrow = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int32()]

    def one(row: dict) -> tuple:
        no, run = row.pop("__no"), row["evaluator_run_id"]
        head = (row["anonymous_id"], row["candidate_id"], row["sample_id"], row["dimension"], row["run_index"], run)
        hashed = lambda v: hashlib.sha256(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
        if no:
            return (*head, 0, [refusal_kind] if refusal_kind else [], "Refused by the provider; scored by the system.", 1.0, "system", True, hashed(run), True, 0)
        wrong = ""
        for retry in range(retries + 1):
            try:
                got = evaluator(dict(row))
            except Exception as failure:  # whatever a provider raises is one failed try
                wrong = f"{type(failure).__name__}: {failure}"
                continue
            problems = response_problems(got, row, run)
            if not problems:
                return (*head, got["score"], got["hard_failures"], got["rationale"], float(got["confidence"]), "evaluator", False, hashed(got), True, retry)
            wrong = "; ".join(problems)
        return (*head, None, [], wrong, None, "evaluator", False, None, False, retries)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(arrow)], names=schema.names)

    return asked.mapInArrow(call, schema)


def progress(cases: DataFrame, blind_map: DataFrame, assessments: DataFrame, gates: Gates = DEFAULT) -> DataFrame:
    """One row of counts: cases, what became of them, items, valid records and enabled hard failures by item and kind."""
    of = lambda s: F.countDistinct(F.when(F.col("status") == s, F.col("case_id")))
    done = blind_map.agg(of("completed").alias("cases_completed"), of("provider_refusal").alias("provider_refusals"), of("technical_failure").alias("technical_failures"))
    valid = assessments.where("valid")
    counts = [
        cases.agg(F.count("*").alias("cases_total")), done, assessments.agg(F.countDistinct("anonymous_id").alias("assessment_inputs")),
        valid.select("anonymous_id", "run_index", "evaluator_run_id").distinct().agg(F.count("*").alias("assessment_records")),
        hard_failures(valid, "anonymous_id", "hard_failures", gates).agg(F.count("*").alias("hard_failures")),
    ]
    out = counts[0]
    for one_row in counts[1:]:  # each side is a single row
        out = out.join(one_row)
    return out


def next_state(state: str | None, stage: str) -> str:
    """The state after a stage; a stage may only follow those before it, or be repeated."""
    reached = -1 if state is None else [STATES[s] for s in STAGES].index(state)
    if STAGES.index(stage) > reached + 1:
        raise ValueError(f"{stage} requires a completed {STAGES[STAGES.index(stage) - 1]}")
    return STATES[STAGES[max(reached, STAGES.index(stage))]]


def report_tables(models: list[dict], rescued: list[dict]) -> str:
    """Markdown of the collected configurations, as many as the profile has."""
    sent = lambda row, name: row[name] if row[f"{name}_sent"] else "OMIT"

    def table(head: tuple[str, ...], rows: list[dict], cells: Callable[[dict], tuple]) -> list[str]:
        align = ["---" if h in ("model", "status") else "---:" for h in head]
        return [f"| {' | '.join(head)} |", f"|{'|'.join(align)}|", *(f"| {' | '.join(map(str, cells(r)))} |" for r in rows)]

    arm = lambda r: (r["model"], sent(r, "temperature"), sent(r, "top_p"))
    out = ["# TQA bench report", "", *table(("model", "temperature", "top_p", "score", "status", "samples"), models, lambda r: (*arm(r), r["score"], r["status"], r["sample_count"]))]
    if rescued:
        out += ["", "## Rescued quality (report only)", "", *table(("model", "temperature", "top_p", "rescued score", "samples"), rescued, lambda r: (*arm(r), r["score"], r["sample_count"]))]
    return "\n".join(out) + "\n"
