"""Profiles of a bench: a YAML file, its rules, and its paths made absolute.

The rules are data: where a value stands, what it must satisfy, and what to say
if it doesn't. Every violation is reported, not just the first.
"""

from __future__ import annotations

import copy
import os
from collections.abc import Callable, Iterator
from typing import Any

from cuemill.operators.tqa import HARD_FAILURES
from cuemill.provider import api_mode

# The parts of a profile and the words that its settings may have.
PARTS = ("profile_version", "framework", "project", "inputs", "translation", "sampling", "execution", "tqa", "evaluator", "output")
CHOICES = {
    "translation.summary.mode": ("generate_once", "none"), "tqa.reference_mode": ("no_reference", "single_reference"), "tqa.sample_aggregation": ("weighted_avg", "min", "harmonic"),
    "evaluator.final_score": ("median", "mean", "trimmed_mean"), "tqa.refusal_handling.mode": ("count_and_mark",), "tqa.refusal_handling.hard_failure_type": HARD_FAILURES, "framework.version": ("v2",),
}
REFERENCE_ROLES = ("anchor", "hint")

Test = Callable[[Any], bool]


def _whole(low: int) -> Test:
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= low


def _number(low: float = float("-inf"), high: float = float("inf"), above: bool = False, below: bool = False) -> Test:
    inside = lambda v: (v > low if above else v >= low) and (v < high if below else v <= high)
    return lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and inside(v)


_text: Test = lambda v: isinstance(v, str) and bool(v.strip())
_flag: Test = lambda v: isinstance(v, bool)
_temperature: Test = lambda v: v == "OMIT" or _number(0, 2, below=True)(v)
_top_p: Test = lambda v: v == "OMIT" or _number(0, 1, above=True)(v)
_path: Test = lambda v: v is None or _text(v)

RULES: tuple[tuple[str, Test, str], ...] = (
    ("profile_version", lambda v: str(v) == "1.0", "must be 1.0"),
    *((f"project.{f}", _text, "must be a text") for f in ("name", "source_language", "target_language")),
    ("translation.models", lambda v: isinstance(v, list) and bool(v) and all(map(_text, v)) and len(set(v)) == len(v), "must be different names"),
    *((f"translation.{f}", _path, "must be a path or null") for f in ("prompt", "glossary")),
    *((f"execution.{f}", _whole(1), "must be an integer from 1") for f in ("batch_size", "batch_jobs", "model_jobs", "max_output_tokens")),
    ("execution.max_retries", _whole(0), "must be an integer from 0"),
    *((f"execution.{f}", _number(0, above=True), "must be above 0") for f in ("timeout", "retry_backoff")),
    ("tqa.hard_failures.enabled", lambda v: isinstance(v, list) and set(map(str, v)) <= set(HARD_FAILURES), "must be known kinds"),
    ("tqa.hard_failures.max_hard_failures_per_episode", _whole(0), "must be an integer from 0"),
    *((f"tqa.thresholds.{f}", _number(0, 10), "must be within 0 and 10") for f in ("dimension_floor", "episode_pass", "model_pass")),
    ("tqa.thresholds.hard_failure_veto", _flag, "must be true or false"),
    *((f"tqa.conditional_pass.{f}", _whole(0), "must be an integer from 0") for f in ("max_failed_dimensions", "max_hard_failures_per_episode")),
    ("tqa.refusal_handling.default_score", lambda v: _whole(0)(v) and v == 0, "must be 0"),
    ("tqa.refusal_handling.mark_as_hard_failure", _flag, "must be true or false"),
    *((f"evaluator.{f}", _text, "must be a text") for f in ("model", "divergence_action")),
    ("evaluator.runs", _whole(1), "must be an integer from 1"),
    *((f"evaluator.{f}", _whole(0), "must be an integer from 0") for f in ("context_window", "max_retries", "re_evaluate_extra_runs")),
    ("evaluator.temperature", _temperature, "must be OMIT or in [0, 2)"),
    ("evaluator.divergence_threshold", _number(0, 10), "must be within 0 and 10"),
    ("evaluator.random_seed", lambda v: isinstance(v, int) and not isinstance(v, bool), "must be an integer"),
    ("output.root", _text, "must be a path"),
    *((where, lambda v, words=words: isinstance(v, str) and v in words, f"must be one of {', '.join(words)}") for where, words in CHOICES.items()),
)


def _at(profile: Any, where: str) -> Any:
    for part in where.split("."):
        if not isinstance(profile, dict) or part not in profile:
            raise KeyError(where)
        profile = profile[part]
    return profile


def _rows(profile: dict, where: str) -> list:
    try:
        found = _at(profile, where)
    except KeyError:
        return []
    return found if isinstance(found, list) else []


def _episodes(profile: dict) -> Iterator[str]:
    episodes = _rows(profile, "inputs.episodes")
    if not episodes:
        yield "inputs.episodes: must be a list with something in it"
    ids: list[Any] = []
    for n, e in enumerate(episodes):
        here = f"inputs.episodes[{n}]"
        if not isinstance(e, dict):
            yield f"{here}: must be a mapping"
            continue
        if not _text(e.get("id")) or e.get("id") in ids:
            yield f"{here}.id: must be a text of its own"
        ids.append(e.get("id"))
        if not _text(e.get("source_srt")):
            yield f"{here}.source_srt: must be a path"
        samples = e.get("samples")
        if not isinstance(samples, list) or not samples:
            yield f"{here}.samples: must be a list with something in it"
            continue
        cues: set[Any] = set()
        for k, sample in enumerate(samples):
            sample = sample if isinstance(sample, dict) else {}
            cue, dims = sample.get("cue_id"), sample.get("dimensions")
            if not _whole(1)(cue) or cue in cues:
                yield f"{here}.samples[{k}].cue_id: must be an integer from 1 of its own"
            elif cue is not None:
                cues.add(cue)
            if not isinstance(dims, list) or not dims or not all(isinstance(d, str) and d for d in dims):
                yield f"{here}.samples[{k}].dimensions: must be names"
            if not _text(sample.get("note")):
                yield f"{here}.samples[{k}].note: must be a text"


def _arms(profile: dict) -> Iterator[str]:
    arms = _rows(profile, "sampling.arms")
    if not arms:
        yield "sampling.arms: must be a list with something in it"
    seen: list[tuple] = []
    for n, arm in enumerate(arms):
        arm = arm if isinstance(arm, dict) else {}
        pair = (arm.get("temperature"), arm.get("top_p"))
        if not _temperature(pair[0]):
            yield f"sampling.arms[{n}].temperature: must be OMIT or in [0, 2)"
        if not _top_p(pair[1]):
            yield f"sampling.arms[{n}].top_p: must be OMIT or in (0, 1]"
        if pair in seen:
            yield f"sampling.arms[{n}]: is there twice"
        seen.append(pair)


def _dimensions(profile: dict) -> Iterator[str]:
    tqa = profile.get("tqa") if isinstance(profile.get("tqa"), dict) else {}
    weights = tqa.get("dimension_weights") if isinstance(tqa.get("dimension_weights"), dict) else {}
    instances = tqa.get("dimension_instances") if isinstance(tqa.get("dimension_instances"), dict) else {}
    used = {d for e in _rows(profile, "inputs.episodes") if isinstance(e, dict) for s in e.get("samples") or [] if isinstance(s, dict) for d in s.get("dimensions") or []}
    for name, have in (("dimension_instances", instances), ("dimension_weights", weights)):
        if used - set(have):
            yield f"tqa.{name}: lacks {', '.join(sorted(map(str, used - set(have))))}"
    if not all(_number(0)(w) for w in weights.values()):
        yield "tqa.dimension_weights: must be numbers from 0"
    elif abs(sum(weights.values()) - 1) > 1e-9:
        yield "tqa.dimension_weights: must add up to 1"
    bounds = [(tqa.get("severity_thresholds") or {}).get(k) for k in ("critical_upper", "major_upper", "minor_upper")]
    if not all(map(_whole(0), bounds)) or not bounds[0] < bounds[1] < bounds[2] < 10:
        yield "tqa.severity_thresholds: must be rising integers below 10"


def _together(profile: dict) -> Iterator[str]:
    translation, tqa, judge = (profile.get(k) if isinstance(profile.get(k), dict) else {} for k in ("translation", "tqa", "evaluator"))
    try:
        api_mode(translation.get("api_mode"))
    except ValueError:
        yield "translation.api_mode: is unknown"
    summary = translation.get("summary") if isinstance(translation.get("summary"), dict) else {}
    if summary.get("mode") == "generate_once":
        if not _whole(1)(summary.get("max_output_tokens")):
            yield "translation.summary.max_output_tokens: must be an integer from 1"
        if not _number(0, above=True)(summary.get("timeout")):
            yield "translation.summary.timeout: must be above 0"
    if tqa.get("reference_mode") == "single_reference":
        if tqa.get("reference_role") not in REFERENCE_ROLES:
            yield f"tqa.reference_role: must be one of {', '.join(REFERENCE_ROLES)}"
        for n, e in enumerate(_rows(profile, "inputs.episodes")):
            if not (isinstance(e, dict) and e.get("reference_srt")):
                yield f"inputs.episodes[{n}].reference_srt: is needed"
    if "top_p" in judge and not _top_p(judge["top_p"]):
        yield "evaluator.top_p: must be OMIT or in (0, 1]"


def check_profile(profile: object) -> list[str]:
    """What is wrong with a profile; an empty list if nothing is."""
    if not isinstance(profile, dict):
        return ["a profile must be a mapping"]
    wrong = [f"{k}: is missing" for k in PARTS if k not in profile] + [f"{k}: is unknown" for k in sorted(set(map(str, profile)) - set(PARTS))]
    for where, test, message in RULES:
        try:
            if not test(_at(profile, where)):
                wrong.append(f"{where}: {message}")
        except KeyError:
            if where.split(".")[0] in profile:
                wrong.append(f"{where}: is missing")
    for rule in (_episodes, _arms, _dimensions, _together):
        wrong += rule(profile)
    return wrong


def load_profile(path: str, default_prompt: str | None = None) -> dict:
    """A YAML profile with its paths made absolute; raises with everything that is wrong, missing files included."""
    import yaml

    with open(path, encoding="utf-8") as f:
        profile = copy.deepcopy(yaml.safe_load(f))
    wrong = check_profile(profile)
    if wrong:
        raise ValueError("; ".join(wrong))
    base = os.path.dirname(os.path.abspath(path))
    full = lambda p: os.path.normpath(os.path.join(base, p))
    places = [(e, k) for e in profile["inputs"]["episodes"] for k in ("source_srt", "reference_srt")] + [(profile["translation"], k) for k in ("prompt", "glossary")]
    for holder, key in places:
        if holder.get(key):
            holder[key] = full(holder[key])
            if not os.path.isfile(holder[key]):
                wrong.append(f"{key}: no such file {holder[key]}")
    if wrong:
        raise ValueError("; ".join(wrong))
    profile["translation"]["prompt"] = profile["translation"]["prompt"] or default_prompt
    profile["translation"]["api_mode"] = api_mode(profile["translation"]["api_mode"])
    profile["output"]["root"] = full(profile["output"]["root"])
    return profile
