"""Queries over the translation results, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.operators import cues as cue_op
from cuemill.operators import responses as op
from cuemill.session import read
from cuemill.sources.srt import bilingual


def _results(spark: SparkSession, d: str) -> DataFrame:
    return op.latest(read(spark, d, "translate_results"))


def _checks(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return op.checked(_results(spark, d), "result_id", *keep)


def json_repair(spark, d):
    return op.repaired(_results(spark, d))


def response_rows(spark, d):
    """Entries of all responses, mended where that is possible."""
    return op.entries(_checks(spark, d), "result_id").select("result_id", "key", "src", "tr", F.coalesce("fault", F.lit("")).alias("fault"))


def missing_extra(spark, d):
    """Keys of every response; one that is empty or beyond repair lacks all that was asked."""
    return op.key_report(_checks(spark, d))


def src_alignment(spark, d):
    return op.entries(_checks(spark, d), "result_id").where("echo <> 'extra'").select("result_id", "key", F.col("echo").alias("kind"), F.col("other").alias("other_key"))


def src_drift(spark, d):
    """Echoes that are neither the own text nor another entry's, with their likeness to the own."""
    return op.entries(_checks(spark, d), "result_id").where("echo IN ('drift', 'mismatch')").select("result_id", "key", "ratio", F.col("echo").alias("kind"))


def style_warnings(spark, d):
    return op.style(op.entries(_checks(spark, d), "result_id").where(op.accepted()))


def validate_summary(spark, d):
    """What was asked, answered and translated, what is wrong with it, and whether the response holds, for every response."""
    return op.summary(_checks(spark, d))


def refusal_classify(spark, d):
    return op.outcome(_results(spark, d))


def retry_classify(spark, d):
    return op.retry(_results(spark, d))


def call_errors(spark, d):
    """Calls that ended in an exception, taken apart, and whether they are worth another."""
    return op.errors(_results(spark, d))


def usage_sum(spark, d):
    u = F.col("usage")
    return _results(spark, d).groupBy("episode_id").agg(*[F.coalesce(F.sum(u[c]), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")], F.count("*").alias("n"))


def model_summary(spark, d):
    r = op.checked(_results(spark, d), "model_alias", "episode_id", "attempt", "status", "incomplete_reason", "elapsed_sec", "usage")
    return r.groupBy("model_alias").agg(
        F.count("*").alias("n"), F.count_if(op.fine()).alias("n_ok"), F.countDistinct("episode_id").alias("n_episodes"),
        F.round(F.sum("elapsed_sec"), 3).alias("elapsed_sec"), F.coalesce(F.sum("usage.total_tokens"), F.lit(0)).alias("tokens"), F.max("attempt").alias("most_attempts"),
    )


def run_ok(spark, d):
    """A run holds if every batch of the episode has a completed and valid try."""
    r = op.checked(_results(spark, d), "episode_id", "batch_index", "status", "incomplete_reason")
    batch = r.groupBy("episode_id", "batch_index").agg(F.bool_or(op.fine()).alias("ok"), F.count("*").alias("tries"))
    return batch.groupBy("episode_id").agg(F.count("*").alias("n_batches"), F.count_if("ok").alias("n_batches_ok"), F.bool_and("ok").alias("ok"), F.sum("tries").alias("tries"))


def _reports(spark, d):
    r = op.checked(_results(spark, d), "episode_id", "batch_index", "status", "incomplete_reason")
    return r.groupBy("episode_id", "batch_index").agg(F.bool_or(op.fine()).alias("ok"))


def failed_batches(spark, d):
    return op.choose_batches(_reports(spark, d))


def merge_batches(spark, d):
    return op.merged(_results(spark, d)).select("episode_id", "key", "tr", "n_versions")


def bilingual_srt(spark, d):
    """Per episode, all cues with times, translation (empty if there is none) above source, and whether every asked cue has one."""
    merged = op.merged(_results(spark, d))
    want = _asked_keys(spark, d).join(merged.select("episode_id", "key", F.lit(1).alias("done")), ["episode_id", "key"], "left")
    whole = want.groupBy("episode_id").agg((F.count("*") == F.count("done")).alias("whole"))
    tr = merged.select("episode_id", F.expr("try_cast(key AS int)").alias("id"), "tr")
    cues = cue_op.distinct_cues(read(spark, d, "cues")).where("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    return bilingual(cues.join(tr, ["episode_id", "id"], "left")).join(whole, "episode_id", "left").select("episode_id", "srt", F.coalesce("whole", F.lit(False)).alias("whole"))


def _asked_keys(spark, d):
    results = _results(spark, d)
    return results.select("episode_id", F.explode(F.map_keys("input_map")).alias("key")).distinct()


def missing_translations(spark, d):
    """Asked cues that no try of the episode translated."""
    return _asked_keys(spark, d).join(op.merged(_results(spark, d)), ["episode_id", "key"], "left_anti")


QUERIES = {
    f.__name__: f
    for f in (
        json_repair, response_rows, missing_extra, src_alignment, src_drift, style_warnings, validate_summary, refusal_classify, retry_classify, call_errors, usage_sum, model_summary, run_ok,
        failed_batches, merge_batches, bilingual_srt, missing_translations,
    )
}

_R = "WITH r AS (SELECT * FROM translate_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY created_at DESC) = 1)"
_BARE = "regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')"
_STRING = r'"(?:[^"\\]|\\.)*"'
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_MARKS = "[!\"''(),\\\\\\-.:;?\\[\\]`{}…‘’“”—–，。！？；：（）【】《》、]+"


def _visible(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{op.VISIBLE}'), false)"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(translate({x}, '{_WIDE}', '{_NARROW}')), '{_MARKS}', ' ', 'g'), '\\s+', ' ', 'g'))"


# Whole entries of a text that stops are found by their form, those of other texts by JSON functions; these let a comma before a brace pass, which isn't JSON.
_E = rf"""{_R}, b0 AS (SELECT result_id, CASE WHEN starts_with({_BARE}, '```') THEN regexp_replace(regexp_replace(regexp_replace({_BARE}, '^```(json|JSON)?\s*\n?', ''), '\n?```\s*$', ''), '^\s+|\s+$', '', 'g') ELSE {_BARE} END AS body FROM r),
b1 AS (SELECT *, regexp_replace(body, '([,{{]\s*)(\d+)"\s*:', '\1"\2":', 'g') AS quoted FROM b0),
b2 AS (SELECT *, quoted || repeat('}}', greatest(0, length(replace(quoted, '}}', '')) - length(replace(quoted, '{{', '')))) AS closed,
  regexp_extract_all(quoted, '"\d+"\s*:\s*\{{(?:[^{{}}"]|{_STRING})*?{_STRING}\}}') AS whole, regexp_extract(quoted, '^(\{{"\d+":\{{"src":{_STRING}),"', 1) AS tight FROM b1),
v AS (SELECT result_id, CASE WHEN json_valid(body) THEN body WHEN json_valid(quoted) THEN quoted WHEN json_valid(closed) AND NOT regexp_matches(quoted, ',\s*$') THEN closed
  WHEN starts_with(quoted, '{{') AND len(whole) > 0 THEN '{{' || array_to_string(whole, ',') || '}}' WHEN tight <> '' THEN tight || '}}}}' END AS body FROM b2),
k AS (SELECT result_id, unnest(json_keys(body)) AS key, body FROM v WHERE json_type(body) = 'OBJECT'),
e AS (SELECT result_id, key, json_extract_string(body, '$."' || key || '".src') AS src, json_extract_string(body, '$."' || key || '".tr') AS tr,
  json_type(body, '$."' || key || '"') AS value_type, json_type(body, '$."' || key || '".tr') AS tr_type FROM k),
f AS (SELECT *, CASE WHEN value_type <> 'OBJECT' THEN 'no_object' WHEN coalesce(tr_type, 'NULL') = 'NULL' OR (tr_type = 'VARCHAR' AND NOT {_visible('tr')}) THEN 'no_translation'
  WHEN tr_type <> 'VARCHAR' THEN 'no_text' END AS fault FROM e),
w AS (SELECT result_id, unnest(map_keys(input_map)) AS key, unnest(map_values(input_map)) AS text, unnest(range(len(map_keys(input_map)))) AS pos FROM r),
n AS (SELECT w.*, {_norm('text')} AS norm FROM w), o AS (SELECT result_id, norm AS echo, arg_min(key, pos) AS owner FROM n GROUP BY result_id, norm),
j AS (SELECT n.result_id, n.key, n.text, n.norm, f.src, f.tr, f.fault, {_norm('f.src')} AS echo FROM n JOIN f ON n.result_id = f.result_id AND n.key = f.key),
t AS (SELECT j.*, o.owner, CASE WHEN NOT {_visible('src')} THEN 'missing' WHEN src = text OR j.echo = norm THEN 'ok' WHEN o.owner IS NOT NULL THEN 'misaligned' ELSE 'mismatch' END AS kind
  FROM j LEFT JOIN o ON j.result_id = o.result_id AND j.echo = o.echo),
x AS (SELECT coalesce(w.result_id, f.result_id) AS result_id, coalesce(w.key, f.key) AS key, w.key IS NULL AS extra, f.key IS NULL AS missing FROM w FULL JOIN f ON w.result_id = f.result_id AND w.key = f.key),
z AS (SELECT result_id, coalesce(list(key ORDER BY try_cast(key AS INTEGER), key) FILTER (WHERE missing), []) AS m, coalesce(list(key ORDER BY try_cast(key AS INTEGER), key) FILTER (WHERE extra), []) AS e FROM x GROUP BY result_id),
g AS (SELECT result_id, count(*) FILTER (WHERE fault IS NULL) AS n_tr_ok, {", ".join(f"count(*) FILTER (WHERE fault = '{k}') AS n_{k}" for k in ("no_object", "no_translation", "no_text"))},
  {", ".join(f"count(*) FILTER (WHERE fault IS NULL AND kind = '{k}') AS {name}" for k, name in (("misaligned", "n_misaligned"), ("mismatch", "n_mismatch"), ("missing", "n_no_echo")))} FROM t GROUP BY result_id),
s0 AS (SELECT r.result_id, CASE WHEN NOT {_visible('r.raw_text')} THEN 'empty' WHEN v.body IS NULL OR json_type(v.body) = 'NULL' THEN 'unparsed' WHEN json_type(v.body) <> 'OBJECT' THEN 'no_object' END AS whole, len(map_keys(r.input_map)) AS n_in,
  (SELECT count(*) FROM e WHERE e.result_id = r.result_id) AS n_out, coalesce(n_tr_ok, 0) AS n_tr_ok, len(coalesce(z.m, [])) AS n_missing, len(coalesce(z.e, [])) AS n_extra, coalesce(n_no_object, 0) AS n_no_object,
  coalesce(n_no_translation, 0) AS n_no_translation, coalesce(n_no_text, 0) AS n_no_text, coalesce(n_misaligned, 0) AS n_misaligned, coalesce(n_mismatch, 0) AS n_mismatch, 0 AS n_drift, coalesce(n_no_echo, 0) AS n_no_echo
  FROM r JOIN v USING (result_id) LEFT JOIN z USING (result_id) LEFT JOIN g USING (result_id)),
s AS (SELECT *, whole IS NULL AND n_missing = 0 AND n_extra = 0 AND n_tr_ok = n_in AND n_misaligned = 0 AND n_mismatch = 0 AS ok FROM s0)"""
_FINE = "(r.status = 'completed' AND coalesce(r.incomplete_reason, '') = '' AND s.ok)"
_OK = "status = 'completed' AND incomplete_reason IS NULL AND trim(coalesce(raw_text, '')) <> ''"
_LOW = "lower(status || ' ' || coalesce(incomplete_reason, ''))"
_or = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_M = f"""{_E}, p AS (SELECT t.result_id, t.key, t.tr, r.episode_id, r.batch_index, r.attempt FROM t JOIN r USING (result_id) WHERE fault IS NULL),
m AS (SELECT episode_id, key, tr, count(*) OVER (PARTITION BY episode_id, key) AS n_versions FROM p
  QUALIFY row_number() OVER (PARTITION BY episode_id, key ORDER BY batch_index DESC, attempt DESC, result_id DESC) = 1)"""

SQL = {
    "response_rows": f"{_E} SELECT result_id, key, src, tr, coalesce(fault, '') AS fault FROM f",
    "missing_extra": f"""{_E} SELECT r.result_id, array_to_string(coalesce(m, [])[1:20], ',') AS missing, array_to_string(coalesce(e, [])[1:20], ',') AS extra,
  CAST(greatest(len(coalesce(m, [])) - 20, 0) AS INTEGER) AS more_missing, CAST(greatest(len(coalesce(e, [])) - 20, 0) AS INTEGER) AS more_extra FROM r LEFT JOIN z USING (result_id)""",
    "src_alignment": f"{_E} SELECT result_id, key, kind, CASE WHEN kind = 'misaligned' THEN owner END AS other_key FROM t",
    "style_warnings": f"""{_E}, c AS (SELECT *, length(regexp_replace(tr, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(tr, '[^一-鿿]', '', 'g')) AS han FROM t WHERE fault IS NULL)
SELECT result_id, key, contains(tr, '，') OR contains(tr, '。') AS wide_marks, contains(tr, '|') OR contains(tr, '｜') AS bars, contains(tr, '⋯') OR contains(tr, '...') AS bad_ellipsis, latin > 8 AND latin > han AS latin_residue FROM c""",
    "validate_summary": f"{_E} SELECT * FROM s",
    "refusal_classify": f"""{_R} SELECT result_id, CASE WHEN {_or(_LOW, op.REFUSAL_MARKERS)} OR (trim(coalesce(raw_text, '')) = '' AND NOT {_or(_LOW, op.TECHNICAL_MARKERS)}) THEN 'provider_refusal'
  WHEN {_OK} THEN 'completed' ELSE 'technical_failure' END AS outcome FROM r""",
    "retry_classify": f"""{_E} SELECT r.result_id, CASE WHEN starts_with(status, 'error') AND ({_or('status', op.RETRY_NAMES)} OR {_or('lower(status)', op.RETRY_NEEDLES)}) THEN 'error'
  WHEN status <> 'completed' THEN 'status' WHEN coalesce(incomplete_reason, '') <> '' THEN 'incomplete' WHEN NOT s.ok THEN 'invalid' END AS reason FROM r JOIN s USING (result_id)""",
    "call_errors": rf"""{_R}, x AS (SELECT result_id, status, regexp_extract(status, '^error: *([A-Za-z]*)', 1) AS name, regexp_replace(status, '^error: *[A-Za-z]*:? *', '') AS text, try_cast(regexp_extract(status, '\b([45][0-9][0-9])\b', 1) AS INTEGER) AS code
  FROM r WHERE starts_with(status, 'error'))
SELECT result_id, name, text, code, name IN ({", ".join(f"'{n}'" for n in op.RETRY_NAMES)}) OR {_or('lower(text)', op.RETRY_NEEDLES)} OR coalesce(code IN ({", ".join(map(str, op.RETRY_CODES))}), false) AS retryable FROM x""",
    "usage_sum": f"{_R} SELECT episode_id, " + ", ".join(f"CAST(coalesce(sum(usage.{c}), 0) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "total_tokens")) + ", count(*) AS n FROM r GROUP BY episode_id",
    "model_summary": f"""{_E} SELECT model_alias, count(*) AS n, count(*) FILTER (WHERE {_FINE}) AS n_ok, count(DISTINCT episode_id) AS n_episodes,
  round(sum(elapsed_sec), 3) AS elapsed_sec, CAST(coalesce(sum(usage.total_tokens), 0) AS BIGINT) AS tokens, max(attempt) AS most_attempts FROM r JOIN s USING (result_id) GROUP BY model_alias""",
    "run_ok": f"""{_E}, bt AS (SELECT episode_id, batch_index, coalesce(bool_or({_FINE}), false) AS ok, count(*) AS tries FROM r JOIN s USING (result_id) GROUP BY episode_id, batch_index)
SELECT episode_id, count(*) AS n_batches, count(*) FILTER (WHERE ok) AS n_batches_ok, bool_and(ok) AS ok, CAST(sum(tries) AS BIGINT) AS tries FROM bt GROUP BY episode_id""",
    "failed_batches": f"{_E} SELECT episode_id, batch_index FROM r JOIN s USING (result_id) GROUP BY episode_id, batch_index HAVING NOT coalesce(bool_or({_FINE}), false)",
    "merge_batches": f"{_M} SELECT episode_id, key, tr, n_versions FROM m",
    "missing_translations": f"{_M} SELECT DISTINCT r.episode_id, w.key FROM w JOIN r USING (result_id) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.episode_id = r.episode_id AND m.key = w.key)",
}
from cuemill.plans.interval_queries import _PARSE  # noqa: E402

_T = "printf('%02d:%02d:%02d,%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"
SQL["bilingual_srt"] = f"""{_M}, c AS (SELECT DISTINCT episode_id, id, {_PARSE.format(c='start_tc')} AS st, {_PARSE.format(c='end_tc')} AS et, text FROM cues),
l AS (SELECT c.episode_id, c.id, st, et, coalesce(text, '') AS text, regexp_replace(coalesce(m.tr, ''), '^\\s+|\\s+$', '', 'g') AS tr, row_number() OVER (PARTITION BY c.episode_id ORDER BY c.id) AS num
  FROM c LEFT JOIN m ON c.episode_id = m.episode_id AND c.id = try_cast(m.key AS INTEGER) WHERE st IS NOT NULL AND et IS NOT NULL),
y AS (SELECT a.episode_id, count(*) = count(m.key) AS whole FROM (SELECT DISTINCT r.episode_id, w.key FROM w JOIN r USING (result_id)) a LEFT JOIN m ON a.episode_id = m.episode_id AND a.key = m.key GROUP BY a.episode_id),
q AS (SELECT episode_id, string_agg(CAST(num AS VARCHAR) || chr(10) || {_T.format(c='st')} || ' --> ' || {_T.format(c='et')} || chr(10) || CASE WHEN text = '' THEN tr ELSE tr || chr(10) || text END || chr(10), chr(10) ORDER BY id) AS srt FROM l GROUP BY episode_id)
SELECT q.episode_id, srt, coalesce(whole, false) AS whole FROM q LEFT JOIN y USING (episode_id)"""
