import datetime as dt
import json

import pytest

from cuemill.plans import response_queries, run_queries

RESULTS = (
    "result_id bigint, episode_id string, batch_index int, attempt int, model_alias string, input_map map<string,string>, raw_text string, "
    "status string, incomplete_reason string, elapsed_sec double, usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>, created_at timestamp"
)
CUES = "episode_id string, id int, seq int, start_tc string, end_tc string, text string"
ASKED = {"0": "Hello there", "1": "Good night"}
WHOLE = json.dumps({k: {"src": v, "tr": f"t{k}"} for k, v in ASKED.items()})


def result(n, raw, episode=None, batch=0, attempt=1, asked=ASKED, status="completed", incomplete=None):
    return (n, episode or f"e{n}", batch, attempt, "m", asked, raw, status, incomplete, 1.0, (1, 1, 2), dt.datetime(2025, 1, 1))


@pytest.fixture
def run(spark, tmp_path):
    def call(name, results, cues=()):
        spark.createDataFrame(results, RESULTS).write.mode("overwrite").parquet(f"{tmp_path}/translate_results.parquet")
        spark.createDataFrame(list(cues), CUES).write.mode("overwrite").parquet(f"{tmp_path}/cues.parquet")
        return (response_queries.QUERIES | run_queries.QUERIES)[name](spark, str(tmp_path)).collect()

    return call


BROKEN = [
    result(1, WHOLE),
    result(2, WHOLE[:-1]),
    result(3, WHOLE.replace('"0":', '0":', 1)),
    result(4, WHOLE[:-8]),
    result(5, "I can't help with that."),
    result(6, ""),
    result(7, None),
]


def test_broken_responses_are_mended(run):
    want = {(n, k) for n in (1, 2, 3) for k in ("0", "1")} | {(4, "0")}
    assert {(r.result_id, r.key) for r in run("response_rows", BROKEN)} == want
    assert {(r.result_id, r.key) for r in run("style_warnings", BROKEN)} == want
    assert {(r.result_id, r.key, r.kind) for r in run("src_alignment", BROKEN)} == {(*x, "ok") for x in want}
    told = {(f"e{n}", k) for n, k in want}
    assert {(r.episode_id, r.key) for r in run("merge_batches", BROKEN)} == told
    assert {(r.episode_id, r.key) for r in run("upsert_repair", BROKEN)} == told
    assert {(r.episode_id, r.key) for r in run("missing_translations", BROKEN)} == {(f"e{n}", k) for n in range(1, 8) for k in ("0", "1")} - told
    cues = [(f"e{n}", i, i, f"00:00:0{i},000", f"00:00:0{i},900", ASKED[str(i)]) for n in range(1, 8) for i in (0, 1)]
    assert len(run("anon_inputs", BROKEN, cues)) == len(told)
    srt = {r.episode_id: r.srt for r in run("bilingual_srt", BROKEN, cues)}
    assert all(f"t{k}\n{ASKED[k]}" in srt[e] for e, k in told)
    assert {r.episode_id for r in run("bilingual_srt", BROKEN, cues) if r.whole} == {"e1", "e2", "e3"}


def test_checks_count_every_response(run):
    rows = {r.result_id: r for r in run("validate_summary", BROKEN)}
    assert {n: (r.n_in, r.n_out, r.n_tr_ok, r.ok) for n, r in rows.items()} == {1: (2, 2, 2, True), 2: (2, 2, 2, True), 3: (2, 2, 2, True), 4: (2, 1, 1, False)} | {n: (2, 0, 0, False) for n in (5, 6, 7)}
    keys = {r.result_id: (r.missing, r.extra, r.more_missing, r.more_extra) for r in run("missing_extra", [*BROKEN, result(8, "", asked={})])}
    assert keys == {n: ("", "", 0, 0) for n in (1, 2, 3, 8)} | {4: ("1", "", 0, 0)} | {n: ("0,1", "", 0, 0) for n in (5, 6, 7)}


def test_half_a_surrogate_pair(run):
    assert len(run("response_rows", [result(1, '{"0": {"src": "Hello there", "tr": "\\ud83d"}}')])) == 1


def reply(**tr):
    return json.dumps({k[1:]: {"src": ASKED.get(k[1:], "x"), "tr": v} for k, v in tr.items()})


SWAPPED = json.dumps({"0": {"src": ASKED["1"], "tr": "a"}, "1": {"src": ASKED["1"], "tr": "b"}})
INVALID = [reply(k0="a"), reply(k0="a", k1="b", k2="c"), reply(k0="a", k1=" "), reply(k0="a", k1=5), '{"0": "a", "1": "b"}', "No.", SWAPPED, SWAPPED.replace(ASKED["1"], "Something else", 1)]
VALID = [WHOLE, WHOLE[:-1], WHOLE.replace("Hello there", "hello, there!"), WHOLE.replace("Hello there", "Hello thera"), WHOLE.replace('"src": "Hello there", ', "")]


def test_only_valid_responses_are_ok(run):
    made = [result(n, raw) for n, raw in enumerate(INVALID)] + [result(n, raw) for n, raw in enumerate(VALID, 100)]
    made += [result(200, WHOLE, incomplete="length"), result(201, WHOLE, status="failed"), result(202, WHOLE, incomplete="")]
    bad = {f"e{n}" for n in (*range(len(INVALID)), 200, 201)}
    assert {r.result_id for r in run("validate_summary", made) if not r.ok} == set(range(len(INVALID)))
    assert {r.episode_id for r in run("failed_batches", made)} == bad
    assert {r.episode_id for r in run("run_ok", made) if not r.ok} == bad
    assert {r.result_id: r.reason for r in run("retry_classify", made) if r.reason} == dict.fromkeys(range(len(INVALID)), "invalid") | {200: "incomplete", 201: "status"}
    (model,) = run("model_summary", made)
    assert (model.n, model.n_ok) == (len(made), len(made) - len(bad))
    assert not run("failed_batches", [result(1, INVALID[0], "e"), result(2, WHOLE, "e", attempt=2)])


def test_srt_has_every_cue(run):
    cues = [(e, i, i + 1, f"00:00:0{i},000", f"00:00:0{i},900", t) for e in ("e1", "e2") for i, t in enumerate(("Hello there", "Good night", "", "So long"))]
    cues += [cues[0], ("e1", 9, 10, "no time", "00:00:09,000", "x")]
    got = {r.episode_id: r.srt for r in run("bilingual_srt", [result(1, reply(k1="b"))], cues)}
    at = lambda n: f"{n}\n00:00:0{n - 1},000 --> 00:00:0{n - 1},900\n"
    blocks = lambda *tr: "\n".join(f"{at(n)}{t}" + (f"\n{s}" if s else "") + "\n" for n, (t, s) in enumerate(zip(tr, ("Hello there", "Good night", "", "So long")), 1))
    assert got == {"e1": blocks("", "b", "", ""), "e2": blocks("", "", "", "")}


def test_drift_and_errors(run):
    drifted = WHOLE.replace("Hello there", "Hello thera")
    strange = WHOLE.replace("Hello there", "Quite another thing")
    assert [(r.key, r.kind) for r in run("src_drift", [result(1, drifted), result(2, strange)])] == [("0", "drift"), ("0", "mismatch")]
    failed = [result(n, "", status=s) for n, s in enumerate(("error: RateLimitError: slow down", "error: BadRequestError: blocked", "error: ApiError: status 503", "error: X: code 409", "completed"))]
    assert {r.result_id: (r.name, r.retryable) for r in run("call_errors", failed)} == {0: ("RateLimitError", True), 1: ("BadRequestError", False), 2: ("ApiError", True), 3: ("X", True)}


def test_batches_to_repeat(spark):
    from cuemill.operators.responses import choose_batches

    reports = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("b", 0, True), ("b", 3, None)], "episode_id string, batch_index int, ok boolean")
    missing = spark.createDataFrame([("a", "7"), ("c", "120"), ("c", "x")], "episode_id string, key string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(choose_batches(reports, chosen=[0])) == {("a", 0), ("b", 0)}
    assert rows(choose_batches(reports)) == {("a", 1), ("b", 3)}
    assert rows(choose_batches(reports, missing=missing)) == {("a", 1), ("b", 3), ("c", 2)}
