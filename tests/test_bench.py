import copy
import json
import os
import stat

import pytest

from cuemill import pipeline, provider
from cuemill.operators import bench, runs, tqa
from cuemill.session import ensure_checkpoint_dir, number_rows
from cuemill.sources.profile import check_profile, load_profile

CUES = "episode_id string, id int, start_ms bigint, end_ms bigint, text string"
PROFILE = {
    "profile_version": "1.0", "framework": {"version": "v2"}, "project": {"name": "n", "source_language": "en", "target_language": "zh"},
    "inputs": {"episodes": [{"id": "E1", "source_srt": "a.srt", "samples": [{"cue_id": 1, "dimensions": ["x"], "note": "n"}]}]},
    "translation": {"models": ["m"], "api_mode": "ChatCompletion", "prompt": None, "glossary": None, "summary": {"mode": "none"}},
    "sampling": {"arms": [{"temperature": "OMIT", "top_p": "OMIT"}, {"temperature": 0, "top_p": "OMIT"}]},
    "execution": {"batch_size": 50, "batch_jobs": 1, "model_jobs": 1, "max_output_tokens": 8, "timeout": 1, "max_retries": 0, "retry_backoff": 1},
    "tqa": {"reference_mode": "no_reference", "dimension_instances": {"x": {}}, "dimension_weights": {"x": 1.0}, "sample_aggregation": "min", "severity_thresholds": {"critical_upper": 3, "major_upper": 5, "minor_upper": 7},
            "hard_failures": {"enabled": ["FABRICATION"], "max_hard_failures_per_episode": 0}, "thresholds": {"dimension_floor": 4, "episode_pass": 6.5, "model_pass": 6.5, "hard_failure_veto": True},
            "conditional_pass": {"max_failed_dimensions": 2, "max_hard_failures_per_episode": 3}, "refusal_handling": {"mode": "count_and_mark", "default_score": 0, "mark_as_hard_failure": True, "hard_failure_type": "FABRICATION"}},
    "evaluator": {"model": "j", "runs": 2, "temperature": 0.3, "context_window": 5, "divergence_threshold": 3, "divergence_action": "re_evaluate", "re_evaluate_extra_runs": 1, "final_score": "median", "random_seed": 7, "max_retries": 1},
    "output": {"root": "out"},
}


def changed(where, value):
    profile = copy.deepcopy(PROFILE)
    *path, last = where.split(".")
    at = profile
    for p in path:
        at = at[int(p)] if p.isdigit() else at[p]
    at[last] = value
    return profile


def test_profile_rules(tmp_path):
    import yaml

    assert check_profile(PROFILE) == [] and check_profile(None) and set(f"{k}: is missing" for k in PROFILE) <= set(check_profile({}))
    bad = [("profile_version", "2"), ("project.name", " "), ("translation.models", ["m", "m"]), ("translation.api_mode", "x"), ("sampling.arms", [{"temperature": True, "top_p": 0}]), ("sampling.arms", PROFILE["sampling"]["arms"] * 2),
           ("execution.batch_size", 0), ("tqa.dimension_weights", {"x": 0.5}), ("tqa.dimension_weights", {"y": 1.0}), ("tqa.severity_thresholds", {"critical_upper": 5, "major_upper": 5, "minor_upper": 7}), ("tqa.reference_mode", "single_reference"),
           ("tqa.hard_failures.enabled", ["X"]), ("tqa.thresholds.hard_failure_veto", 1), ("tqa.refusal_handling.default_score", False), ("evaluator.final_score", "best"), ("evaluator.random_seed", True), ("evaluator.runs", 0),
           ("translation.summary", {"mode": "generate_once"}), ("inputs.episodes.0.samples.0.cue_id", True), ("inputs.episodes.0.samples.0.note", ""), ("output.root", None), ("extra", 1)]
    for where, value in bad:
        assert check_profile(changed(where, value)), where
    assert check_profile(changed("tqa", None))
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(PROFILE))
    with pytest.raises(ValueError, match="no such file"):
        load_profile(str(tmp_path / "p.yaml"))
    (tmp_path / "a.srt").write_text("")
    loaded = load_profile(str(tmp_path / "p.yaml"))
    assert loaded["inputs"]["episodes"][0]["source_srt"] == str(tmp_path / "a.srt") and loaded["translation"]["api_mode"] == "chat_completions"
    gates = tqa.Gates.of(loaded)
    assert (gates.enabled, gates.veto_above, gates.runs, gates.extra_runs, gates.display) == (("FABRICATION",), 0, 2, 1, "min")


def test_provider_parts():
    assert provider.api_mode("Chat-Completion") == "chat_completions" and provider.api_mode("responses") == "responses"
    assert provider.sampling(0) == {"sent": True, "value": 0.0} and provider.sampling(None, {"sent": True, "value": 0.4})["value"] == 0.4 and not provider.sampling(None, {"sent": False, "value": 1})["sent"]
    assert provider.usage({"prompt_tokens": 3, "completion_tokens": 4, "completion_tokens_details": {"reasoning_tokens": 1}, "total_tokens": 7}) == {"input_tokens": 3, "output_tokens": 4, "reasoning_tokens": 1, "total_tokens": 7}
    assert provider.usage(None)["total_tokens"] == 0
    assert provider.reply_text({"output": [{"type": "message", "content": [{"type": "output_text", "text": "a"}, {"type": "x", "text": "b"}]}, {"type": "y"}]}) == "a"
    assert provider.reply_text({"choices": [{"message": {"content": [{"text": "a"}, {"text": None}, {"text": "b"}]}}]}) == "ab" and provider.reply_text({"choices": [{"message": {"content": "c"}}]}) == "c" and provider.reply_text({}) == ""
    assert provider.model_list(" ALL ", ["a", "b"]) == ["a", "b"] and provider.model_list("b, ,a", ["a", "b"]) == ["b", "a"]
    assert [r["model_alias"] for r in provider.in_order([{"model_alias": m} for m in "xcab"], list("abc"))] == list("abcx")
    told = provider.instructions("from ${sourceLanguage} to ${targetLanguage} ", "en", "zh", ["a = b"], " s ")
    assert told.startswith("from en to zh\n\n\n" + provider.GLOSSARY_HEADING) and told.endswith(provider.SUMMARY_HEADING + "\ns\n") and provider.instructions("t", "a", "b") == "t\n"
    assert provider.same_mode(None, {"api_mode": "chat"}) == "chat_completions"
    for wrong in (("responses", {"api_mode": "chat"}), (None, [])):
        with pytest.raises(ValueError):
            provider.same_mode(*wrong)
    with pytest.raises(ValueError, match="missing keys"):
        provider.same_keys('{"1": "a"}', {"1": "", "2": ""})
    assert pipeline.delivery_path("/x/a.srt") == "/x/a_zh.srt" and pipeline.delivery_path("/x/a.srt", "/y.srt") == "/y.srt" and pipeline.delivery_path("a.srt", "/y.srt", "m/1", 2) == "a_m_1_zh.srt"
    for options in ({"sdh": True}, {"overlap": "on"}):
        with pytest.raises(ValueError):
            pipeline.check_options(False, **options)
    pipeline.check_options(True, sdh=True)


def test_calls_are_repeated():
    asked = {"0": "a b"}
    good = provider.Reply(json.dumps({"0": {"src": "a b", "tr": "x"}}))
    waits: list[float] = []

    def answers(*replies):
        left = list(replies)

        def give(text, instructions):
            r = left.pop(0)
            if isinstance(r, Exception):
                raise r
            return r

        return give

    call = lambda *replies: provider.call(answers(*replies), "", "", asked, 2, 3.0, waits.append)
    assert call(good) == (good, 1, [])
    reply, tries, notes = call(good._replace(status="incomplete"), good._replace(incomplete_reason="length"), good)
    assert (reply, tries) == (good, 3) and notes == ["status incomplete", "incomplete length"] and waits == [3.0, 6.0]
    reply, tries, notes = call(good._replace(text="{}"), TimeoutError("x"), RuntimeError("503"))
    assert tries == 3 and reply.status == "error: RuntimeError: 503" and reply.text == "{}" and notes[0] == "invalid"
    assert call(RuntimeError("no"), good)[1] == 1


def test_repair_asks_in_parts(spark):
    cues = spark.createDataFrame([("e", i, i * 1000, i * 1000 + 900, f"Line {i}") for i in range(12)], CUES)

    def moody(text, instructions):
        asked = json.loads(text)
        if len(asked) > 5 or (len(asked) > 1 and "7" in asked):
            return provider.Reply("", "incomplete", "length")
        if "9" in asked:
            raise RuntimeError("never")
        return provider.stub_provider(text, instructions)

    called = pipeline.translate(cues, "into x", moody, 6, retries=0, backoff=0)
    assert called.where("status = 'incomplete'").count() == 2
    got = {r.key: r.tr for r in pipeline.repair(called, "into x", moody, retries=0, backoff=0).collect()}
    assert got == {str(i): f"[x] Line {i}" for i in range(12) if i != 9}
    report = pipeline.run_report(called).first()
    assert (report.n_batches, report.ok, len(report.errors)) == (2, False, 6)


def test_summaries_optimizing_and_sentences(spark):
    cues = spark.createDataFrame([("e", 0, 0, 900, "helo"), ("e", 1, 0, 900, "[door]"), ("f", 0, 0, 900, None)], CUES)
    models = spark.createDataFrame([("m",), ("n",)], "model string")
    rows = pipeline.summaries(cues, models, "", lambda text, _: provider.Reply(text.upper()), backoff=0).collect()
    assert {(r.episode_id, r.model, r.summary) for r in rows} == {("e", m, "0\tHELO\n1\t[DOOR]") for m in "mn"} | {("f", m, "0") for m in "mn"}

    def better(text, _):
        return provider.Reply(json.dumps({k: "hello" if v == "helo" else "" for k, v in json.loads(text).items()}))

    assert {(r.episode_id, r.id): r.text for r in pipeline.optimize(cues, "", better).collect()} == {("e", 0): "hello", ("e", 1): "[door]", ("f", 0): None}
    with pytest.raises(Exception, match="missing keys"):
        pipeline.optimize(cues, "", lambda *_: provider.Reply("{}")).collect()
    packs = spark.createDataFrame([(1, "a b c")], "k int, words string")
    assert pipeline.sentences(packs, "k", "words").first().sentences == ["a b c"]
    assert pipeline.sentences(packs, "k", "words", "", lambda t, _: provider.Reply("a<br> b c<br/>")).first().sentences == ["a", "b c"]


def test_gate_and_words(spark):
    cues = spark.createDataFrame([("long", 0, 0, 10000, "word " * 80), ("short", 0, 0, 10000, "a  b"), ("timed", 0, 0, 10000, "x")], CUES)
    words = spark.createDataFrame([("timed", i, w, float(i), i + 0.1) for i, w in enumerate(["Hello", " ", *["you"] * 20])], "episode_id string, pos int, text string, start_s double, end_s double")
    got = pipeline.stage_a(cues, resplit="auto", words=words).collect()
    assert sum(r.episode_id == "long" for r in got) >= 2 and [r.text for r in got if r.episode_id == "short"] == ["a  b"]
    timed = [r for r in got if r.episode_id == "timed"]
    assert len(timed) == 2 and timed[0].start_ms == 0 and all(r.is_split and r.end_ms > r.start_ms for r in timed)
    assert pipeline.stage_a(cues, resplit="off").count() == 3


def test_artefacts(spark, tmp_path):
    cues = spark.createDataFrame([(e, i, i * 1000, i * 1000 + 900, f"Line {i}") for e in "ab" for i in range(2)], CUES)
    called = pipeline.translate(cues, "into x", lambda t, i: provider.stub_provider(t, i), 50)
    broken = called.selectExpr("episode_id", "batch_index", "input_map", "IF(episode_id = 'b', '', raw_text) AS raw_text", "status", "incomplete_reason", "usage", "attempts", "notes")
    pipeline.write_run(broken, cues, str(tmp_path / "run"))
    read = lambda name: spark.read.parquet(str(tmp_path / "run" / name))
    assert [r.episode_id for r in read("partial").collect()] == ["b"] and read("srt").first().srt.startswith("1\n00:00:00,000 --> 00:00:00,900\n[x] Line 0\nLine 0\n")
    files = read("srt").selectExpr(f"concat('{tmp_path}/out/', episode_id, '_zh.srt') AS path", "srt")
    assert pipeline.write_files(files, "path", "srt") == 1 and os.listdir(tmp_path / "out") == ["a_zh.srt"]
    pipeline.write_private(str(tmp_path / "map.json"), {"b": 1})
    assert stat.S_IMODE(os.stat(tmp_path / "map.json").st_mode) == 0o600
    assert pipeline.freeze(str(tmp_path / "lock"), {"profile": "1"}) and not pipeline.freeze(str(tmp_path / "lock"), {"profile": "1"})
    with pytest.raises(ValueError, match="profile"):
        pipeline.freeze(str(tmp_path / "lock"), {"profile": "2"})
    after = pipeline.prepare_and_write(cues, str(tmp_path / "stage"), sdh=True)
    assert after.count() == 4 and spark.read.parquet(str(tmp_path / "stage/report")).count() == 2
    assert all(r.ok for r in pipeline.self_check(cues).collect())


def test_bench_round(spark):
    cues = spark.createDataFrame([("E1", s, f"cue {s}") for s in (1, 2, 3)], "episode_id string, seq int, text string")
    samples = spark.createDataFrame([("E1", 2, ["x", "y"], "n")], "episode_id string, cue_id int, dimensions array<string>, note string")
    candidates = spark.createDataFrame([("c1", "E1", "completed"), ("c2", "E1", "provider_refusal"), ("c3", "E1", "technical_failure")], "candidate_id string, episode_id string, status string")
    tr = spark.createDataFrame([("c1", 2, "t")], "candidate_id string, cue_id int, tr string")
    references = spark.createDataFrame([("E1", 2, "r")], "episode_id string, cue_id int, reference_text string")
    items = bench.assessment_inputs(samples, cues, candidates, tr, references, "hint", 1)
    rows = items.orderBy("anonymous_id").collect()
    assert [(r.anonymous_id, r.sample_id, r.dimension, r.target_text) for r in rows] == [("assessment-000001", "sample-000001", "x", "t"), ("assessment-000002", "sample-000001", "y", "t"), ("assessment-000003", "sample-000002", "x", ""), ("assessment-000004", "sample-000002", "y", "")]
    assert (rows[0].context_before, rows[0].context_after, rows[0].reference_text) == (["cue 1"], ["cue 3"], "r")
    with pytest.raises(ValueError, match="refusal_detected"):
        bench.without_provenance(items.selectExpr("*", "true AS Refusal_Detected"))
    assert bench.absent_samples(samples.selectExpr("episode_id", "explode(array(2, 9)) AS cue_id"), cues).count() == 1
    gates = tqa.DEFAULT._replace(runs=2, extra_runs=1, enabled=("FABRICATION",), veto_above=0)
    none = spark.createDataFrame([], "anonymous_id string, run_index int")
    open_ = bench.open_runs(items, none, gates)

    def judge(item):
        if item["dimension"] == "y" and item["run_index"] == 1:
            raise TimeoutError("slow")
        return {"sample_id": item["sample_id"], "dimension": item["dimension"], "score": 2 if item["run_index"] else 8, "hard_failures": [], "rationale": "ok", "confidence": 1, "evaluator_run_id": item["evaluator_run_id"]}

    records = bench.evaluate(items, open_, candidates.where("status = 'provider_refusal'"), judge, 1, "FABRICATION").collect()
    by = {(r.anonymous_id[-1], r.run_index): r for r in records}
    assert len(by) == 8 and (by["1", 0].score, by["1", 1].score, by["3", 0].score, by["3", 0].scored_by) == (8, 2, 0, "system") and not by["2", 1].valid and by["2", 1].rationale == "TimeoutError: slow"
    table = spark.createDataFrame(records, bench.RECORD)
    left = bench.open_runs(items, table.where("valid"), gates).collect()
    assert [(r.anonymous_id, r.run_index) for r in left] == [("assessment-000002", 1)]
    apart = tqa.divergence(tqa.ledger(table), gates)
    assert [(r.anonymous_id, r.run_index) for r in bench.extra_runs(apart, table, gates).collect()] == [("assessment-000001", 2)]
    weights = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "dimension string, weight double")
    episodes = tqa.episodes(tqa.final_scores(tqa.ledger(table)), weights, gates)
    cases = bench.cases(spark.createDataFrame([("m",)], "model string"), [(None, None), (0.0, None), (1.0, 0.5)], spark.createDataFrame([("E1",)], "episode_id string"))
    ids = [r.case_id for r in cases.orderBy("case_number").collect()]
    assert ids[1] == "002__E1__m__temperature-0.0__topP-OMIT"
    blind = spark.createDataFrame([("c1", ids[0], "primary", "completed"), ("c2", ids[1], "primary", "provider_refusal"), ("c3", ids[2], "primary", "technical_failure"), ("c4", ids[1], "rescue", "completed")], "candidate_id string, case_id string, lane string, status string")
    joined, failed = tqa.unblinded(episodes, blind, cases)
    assert [r.case_id for r in failed.collect()] == [ids[2]]
    models = {(r.temperature_sent, r.lane): (r.score, r.status, r.sample_count) for r in tqa.models(joined, gates).collect()}
    assert models == {(False, "primary"): (6.5, "PASS", 1), (True, "primary"): (0.0, "VETO", 1), (True, "rescue"): (0.0, "FAIL", 0)}
    done = bench.progress(cases, blind, table, gates).first()
    assert (done.cases_total, done.cases_completed, done.provider_refusals, done.technical_failures, done.assessment_inputs, done.hard_failures) == (3, 2, 1, 1, 4, 2)
    report = bench.report_tables([r.asDict() for r in tqa.models(joined, gates).where("lane = 'primary'").orderBy("rank").collect()], [r.asDict() for r in tqa.models(joined, gates).where("lane = 'rescue'").collect()])
    assert "| m | OMIT | OMIT | 6.5 | PASS | 1 |" in report and "## Rescued quality" in report


def test_responses_of_evaluators():
    item = {"sample_id": "s", "dimension": "d"}
    good = {"sample_id": "s", "dimension": "d", "score": 3, "hard_failures": ["FABRICATION"], "rationale": "r", "confidence": 0.5, "evaluator_run_id": "e"}
    assert bench.response_problems(good, item, "e") == [] and bench.read_response("```json\n{}\n```") == {}
    for k, v in (("score", True), ("score", 11), ("score", 2.0), ("hard_failures", ["X"]), ("hard_failures", ["FABRICATION"] * 2), ("confidence", 2), ("rationale", " "), ("sample_id", "t"), ("evaluator_run_id", "f")):
        assert bench.response_problems(good | {k: v}, item, "e"), k
    assert bench.response_problems(good | {"more": 1}, item, "e") == ["unexpected more"] and bench.response_problems([], item, "e") == ["no_object"]


def test_states():
    assert bench.next_state(None, "plan") == "planned" and bench.next_state("collected", "evaluate") == "evaluated" and bench.next_state("evaluated", "collect") == "evaluated"
    with pytest.raises(ValueError):
        bench.next_state("planned", "evaluate")


def test_windows_and_drift(spark):
    rows = lambda *texts: spark.createDataFrame([("e", i, t) for i, t in enumerate(texts)], "episode_id string, pos int, text string")
    assert runs.positions_equal(rows("a", None, "c"), rows("a", None, "d", "e")).first()[1:] == (4, 2)
    hashes = lambda *pairs: spark.createDataFrame(pairs, "episode_id string, sha256 string")
    assert {tuple(r) for r in runs.drifted(hashes(("a", "1"), ("b", "1"), ("c", "1")), hashes(("a", "1"), ("b", "2"))).collect()} == {("b", "2"), ("c", None)}


def test_numbers(spark):
    got = number_rows(spark.range(1000).selectExpr("id % 7 AS a", "id"), ["a", "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [(r.a, r.id) for r in got] == sorted((i % 7, i) for i in range(1000))
    assert number_rows(spark.range(0), ["id"], "n").count() == 0
    places = tqa.shuffled(spark.range(300).selectExpr("cast(id AS string) AS k"), "k", digits=1)
    assert sorted((r.run_index, r.place) for r in places.collect()) == [(r, p) for r in range(3) for p in range(1, 301)]


def test_no_machine_folder_on_a_cluster():
    class Context:
        master = "spark://x:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, key, default: default})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
