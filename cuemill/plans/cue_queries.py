"""Queries over the cues, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import text as fx
from cuemill.functions.timecode import format_ms, lenient_ms, strict_ms
from cuemill.operators import cues as op
from cuemill.plans.interval_queries import _PARSE
from cuemill.session import read

COLUMNS = ("episode_id", "id", "start_ms", "end_ms", "text")


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.distinct_cues(read(spark, sf_dir, "cues"))


def cue_reindex(spark, d):
    return op.reindex(_cues(spark, d)).select("episode_id", "id", "seq", "text")


def cue_slice(spark, d):
    return op.slice_cues(_cues(spark, d), 5, 20).select("episode_id", "id", "seq", "text")


def cue_times(spark, d):
    return _cues(spark, d).select("episode_id", "id", "start_ms", "end_ms", format_ms(F.col("start_ms")).alias("start_text"), format_ms(F.col("end_ms")).alias("end_text"))


def batch_plan(spark, d):
    return op.batch_plan(op.batches(_cues(spark, d), 50))


def overlap_stats(spark, d):
    return op.overlap_stats(_cues(spark, d))


def overlap_clip(spark, d):
    return op.clip_overlaps(_cues(spark, d)).select(*COLUMNS)


def quality_per_cue(spark, d):
    return op.quality(_cues(spark, d)).withColumn("issues", F.array_join("issues", ","))


def quality_summary(spark, d):
    return op.quality_summary(op.quality(_cues(spark, d)))


def issue_cues(spark, d):
    return op.quality(_cues(spark, d)).where(F.size("issues") > 0).select("episode_id", "id", F.size("issues").alias("n_issues"))


def reading_speed(spark, d):
    return op.with_speed(_cues(spark, d))


def reading_speed_children(spark, d):
    """Speed against the limits for children, with descriptions of sounds."""
    return op.with_speed(_cues(spark, d), "children", sdh=True)


def long_lines_sdh(spark, d):
    """Cues with a line over its language's limit for the hard of hearing."""
    long = F.exists(fx.lines(F.col("text")), lambda x: F.length(x) > fx.line_limit(fx.language(x), sdh=True))
    return _cues(spark, d).where(long).select("episode_id", "id")


def strict_times(spark, d):
    """Times that the strict reader takes, beside those of the lenient one."""
    raw = read(spark, d, "cues").select("start_tc").distinct()
    return raw.select("start_tc", strict_ms(F.col("start_tc")).alias("strict"), lenient_ms(F.col("start_tc")).alias("lenient"))


def char_counts(spark, d):
    return _cues(spark, d).select("episode_id", "id", *[c.alias(k) for k, c in fx.counts(F.coalesce("text", F.lit(""))).items()])


def document_language(spark, d):
    return op.document_language(_cues(spark, d))


def bilingual_cues(spark, d):
    return op.bilingual(_cues(spark, d))


def needs_resplit(spark, d):
    return op.needs_resplit(_cues(spark, d))


def needs_split(spark, d):
    return op.needs_split(_cues(spark, d))


def sdh_clean(spark, d):
    return op.clean_sdh(_cues(spark, d)).select("episode_id", "id", "seq", "text")


def sdh_only(spark, d):
    return _cues(spark, d).where(fx.sdh_only(F.col("text"))).select("episode_id", "id", "text")


def disfluency(spark, d):
    return op.clean_disfluency(_cues(spark, d)).select("episode_id", "id", "seq", "text")


def fragment_flags(spark, d):
    return _cues(spark, d).select("episode_id", "id", op.fragment(F.coalesce("text", F.lit(""))).alias("is_fragment"))


def fragment_merge(spark, d):
    """Every third cue taken as a piece of a split."""
    pieces = op.reindex(_cues(spark, d)).withColumn("text", F.coalesce(fx.trimmed(F.col("text")), F.lit(""))).withColumn("is_split", F.col("id") % 3 != 0)
    return op.merge_fragments(pieces).drop("is_split")


def flatten_lines(spark, d):
    return _cues(spark, d).select("episode_id", "id", fx.flatten(fx.lines(F.col("text"))).alias("flat"))


def merge_lines_en(spark, d):
    return _cues(spark, d).select("episode_id", "id", F.array_join(fx.merge_lines(fx.lines(F.col("text")), 42, " ", ".!?", True), "|").alias("lines"))


def merge_lines_zh(spark, d):
    return _cues(spark, d).select("episode_id", "id", F.array_join(fx.merge_lines(fx.lines(F.col("text")), 16, "", "。！？", False), "|").alias("lines"))


def merge_lines_ko(spark, d):
    return _cues(spark, d).select("episode_id", "id", F.array_join(fx.merge_lines(fx.lines(F.col("text")), 16, " ", "。！？", False), "|").alias("lines"))


def context_window(spark, d):
    return op.context(_cues(spark, d))


def summary_payload(spark, d):
    """One text per episode: id, tab, text with line feeds as ' / '."""
    line = F.concat(F.col("id").cast("string"), F.lit("\t"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" / ")))
    return _cues(spark, d).groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))), lambda x: x["t"]), "\n").alias("payload"))


QUERIES = {
    f.__name__: f
    for f in (
        cue_reindex, cue_slice, cue_times, batch_plan, overlap_stats, overlap_clip, quality_per_cue, quality_summary, issue_cues, reading_speed, reading_speed_children, long_lines_sdh, strict_times, char_counts,
        document_language, bilingual_cues, needs_resplit, needs_split, sdh_clean, sdh_only, disfluency, fragment_flags, fragment_merge, flatten_lines,
        merge_lines_en, merge_lines_zh, merge_lines_ko, context_window, summary_payload,
    )
}

_C = f"WITH c AS (SELECT DISTINCT episode_id, id, seq, {_PARSE.format(c='start_tc')} AS start_ms, {_PARSE.format(c='end_tc')} AS end_ms, text FROM cues)"
_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_W = "(PARTITION BY episode_id ORDER BY id)"


def _count(expr: str, chars: str) -> str:
    return f"length(regexp_replace({expr}, '[^{chars}]', '', 'g'))"


def _n(x: str) -> dict[str, str]:
    return {
        "han": _count(x, "一-鿿"), "hangul": _count(x, "가-힯"), "kana": f"({_count(x, '぀-ゟ')} + {_count(x, '゠-ヿ')})", "ascii": _count(x, "a-zA-Z"),
        "zh_punct": _count(x, "。！？，：“”（）【】《》"), "ja_punct": _count(x, "。！？、：“”（）【】《》〈〉"), "total": f"length(replace({x}, ' ', ''))",
    }


def _scores(n: dict[str, str]) -> dict[str, str]:
    t = f"greatest({n['total']}, 1)"
    raw = {
        "zh": f"({n['han']} / {t} * 10 + {n['zh_punct']} / {t} * 2)",
        "en": f"({n['ascii']} / {t} * (CASE WHEN ({n['han']} + {n['hangul']} + {n['kana']}) / {t} < 0.1 THEN 10.0 ELSE 2.0 END))",
        "ko": f"({n['hangul']} / {t} * 10 + {n['zh_punct']} / {t} * 2)",
        "ja": f"(({n['kana']} + {n['han']} * 0.5) / {t} * 10 + {n['ja_punct']} / {t} * 2)",
    }
    return {k: f"CAST(CASE WHEN {v} < 0.01 THEN 0 ELSE {v} END AS DOUBLE)" for k, v in raw.items()}


def _best(s: dict[str, str]) -> str:
    top = f"greatest({', '.join(s.values())})"
    return "CASE " + " ".join(f"WHEN {s[k]} = {top} THEN '{k}'" for k in ("zh", "en", "ko")) + " ELSE 'ja' END"


def _language(x: str) -> str:
    return f"CASE WHEN regexp_replace({x}, '^\\s+|\\s+$', '', 'g') = '' THEN 'en' ELSE {_best(_scores(_n(x)))} END"


_LIMIT = "CASE {l} WHEN 'zh' THEN 16 WHEN 'en' THEN 42 WHEN 'ko' THEN 16 WHEN 'ja' THEN 13 ELSE 42 END"


def _quality_sql(cues: str) -> str:
    return f"""{cues}, ql AS (SELECT *, {_LINES} AS ls, round((end_ms - start_ms) / 1000, 3) AS seconds FROM c),
qm AS (SELECT *, len(ls) AS n_lines, CAST(coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS INTEGER) AS chars,
  CAST(coalesce(list_max(list_transform(ls, lambda x: length(x))), 0) AS INTEGER) AS max_line_chars, coalesce(seconds <= 0, true) AS bad FROM ql),
qk AS (SELECT *, CASE WHEN NOT bad AND n_lines > 0 THEN round(chars / seconds, 2) END AS cps FROM qm),
q AS (SELECT episode_id, id, CASE WHEN n_lines > 0 THEN seconds END AS seconds, chars, cps, n_lines, max_line_chars, list_filter([
  CASE WHEN n_lines = 0 THEN 'missing' END, CASE WHEN n_lines > 0 AND bad THEN 'bad_duration' END, CASE WHEN n_lines > 0 AND NOT bad AND seconds < 0.833 THEN 'too_short' END,
  CASE WHEN n_lines > 0 AND NOT bad AND seconds > 7.0 THEN 'too_long' END, CASE WHEN cps > 9.0 THEN 'cps' END,
  CASE WHEN n_lines > 0 AND max_line_chars > 16 THEN 'line' END, CASE WHEN n_lines > 2 THEN 'lines' END], lambda x: x IS NOT NULL) AS issues FROM qk)"""


_QUALITY = _quality_sql(_C)
_SUMMARY = """ SELECT episode_id, count(*) AS n, count(*) FILTER (WHERE list_contains(issues, 'missing')) AS n_missing, count(*) FILTER (WHERE list_contains(issues, 'cps')) AS n_cps_over,
  count(*) FILTER (WHERE list_contains(issues, 'line')) AS n_line_over, count(*) FILTER (WHERE list_contains(issues, 'lines')) AS n_lines_over,
  count(*) FILTER (WHERE list_contains(issues, 'bad_duration') OR list_contains(issues, 'too_short')) AS n_bad_duration, round(max(cps), 2) AS max_cps, floor(round(quantile_cont(cps, 0.95) * 100, 6) + 0.5) / 100 AS p95_cps
FROM q GROUP BY episode_id"""

_SDH_WHOLE = " OR ".join(f"regexp_matches(w, '{p}')" for p in fx.SDH_WHOLE)
_SDH_ONLY = f"""(w <> '' AND ({_SDH_WHOLE} OR len(list_filter(ls, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '♪+|🎵+|🎶+', '', 'g'),
  '\\[.*?\\]|\\(.*?\\)|【.*?】|《.*?》', '', 'g'), '^-\\s*', '')) <> '')) = 0))"""
_STRIP = "x"
for _p in fx.SDH_INLINE:
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '', 'g')"
_STRIP = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STRIP}, '\\s+', ' ', 'g'), '^-\\s*', '- '), '^-\\s*-\\s*', '- '), '^\\s+|\\s+$', '', 'g')"
_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_FRAG = f"(length({_TRIM.format(x='t')}) < 15 OR len(list_filter(regexp_split_to_array({_TRIM.format(x='t')}, '\\s+'), lambda w: w <> '')) < 3)"
_WIDE = "'^[一-鿿㐀-䶿가-힯぀-ゟ゠-ヿ。！？，：；''（）【】《》\"]$'"
_JOIN = f"a || (CASE WHEN regexp_matches(right(a, 1), {_WIDE}) AND regexp_matches(left(x, 1), {_WIDE}) THEN '' ELSE ' ' END) || x"
_FLAT = "CASE WHEN len({ls}) = 0 THEN '' ELSE list_reduce(CASE WHEN len({ls}) = 0 THEN [''] ELSE {ls} END, lambda a, x: " + _JOIN + ") END"



def _merge_sql(limit: int, gap: str, ends: str, mixed: bool) -> str:
    """Lines as lists of one, folded: the last line of what is done takes the next one in, or the next one is appended."""
    talk = "starts_with(x[1], '- ')"
    kinds = f"NOT {talk}" if mixed else f"starts_with(a[-1], '- ') = {talk}"
    joins = f"strpos('{ends}', right(a[-1], 1)) = 0 AND length(a[-1]) + {len(gap)} + length(x[1]) <= {limit} AND {kinds}"
    fold = f"list_reduce(list_transform(ls, lambda y: [y]), lambda a, x: CASE WHEN {joins} THEN list_concat(a[1:-2], [a[-1] || '{gap}' || x[1]]) ELSE list_concat(a, x) END)"
    return f"CASE WHEN len(ls) > 1 THEN array_to_string({fold}, '|') ELSE array_to_string(ls, '|') END"


SQL = {
    "cue_reindex": f"{_C} SELECT episode_id, CAST(row_number() OVER {_W} - 1 AS INTEGER) AS id, seq, text FROM c",
    "cue_slice": f"{_C}, r AS (SELECT *, row_number() OVER {_W} - 1 AS pos FROM c) SELECT episode_id, CAST(pos - 5 AS INTEGER) AS id, seq, text FROM r WHERE pos >= 5 AND pos < 25",
    "cue_times": f"""{_C} SELECT episode_id, id, start_ms, end_ms,
  CASE WHEN start_ms IS NOT NULL THEN printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) END AS start_text,
  CASE WHEN end_ms IS NOT NULL THEN printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) END AS end_text FROM c""",
    "batch_plan": f"""{_C}, r AS (SELECT *, row_number() OVER {_W} - 1 AS pos, count(*) OVER (PARTITION BY episode_id) AS n FROM c),
b AS (SELECT *, CAST(CASE WHEN n <= 50 THEN 0 ELSE pos // 50 END AS INTEGER) AS batch FROM r)
SELECT episode_id, batch, count(*) AS n, min(id) AS id_from, max(id) AS id_to FROM b GROUP BY episode_id, batch""",
    "overlap_stats": f"""{_C}, o AS (SELECT *, end_ms - lead(start_ms) OVER {_W} AS over_ms FROM c)
SELECT episode_id, count(*) - 1 AS pair_count, count(*) FILTER (WHERE over_ms >= 50) AS overlap_count, coalesce(max(over_ms) FILTER (WHERE over_ms >= 50), 0) AS max_overlap_ms,
  round(CASE WHEN count(*) > 1 THEN count(*) FILTER (WHERE over_ms >= 50) / (count(*) - 1) ELSE 0.0 END, 6) AS overlap_ratio FROM o GROUP BY episode_id""",
    "overlap_clip": f"""{_C}, o AS (SELECT *, lead(start_ms) OVER {_W} AS nxt FROM c),
g AS (SELECT *, bool_or(coalesce(end_ms - nxt >= 50, false)) OVER (PARTITION BY episode_id) AS gate FROM o),
k AS (SELECT episode_id, id, start_ms, CASE WHEN gate AND nxt < end_ms THEN nxt ELSE end_ms END AS end_ms, text FROM g WHERE NOT gate OR coalesce(regexp_matches(text, '\\S'), false))
SELECT episode_id, CAST(row_number() OVER {_W} - 1 AS INTEGER) AS id, start_ms, end_ms, text FROM k""",
    "quality_per_cue": _QUALITY + " SELECT episode_id, id, seconds, chars, cps, n_lines, max_line_chars, array_to_string(issues, ',') AS issues FROM q",
    "quality_summary": _QUALITY + _SUMMARY,
    "issue_cues": _QUALITY + " SELECT episode_id, id, CAST(len(issues) AS INTEGER) AS n_issues FROM q WHERE len(issues) > 0",
    "reading_speed": f"""{_C}, t AS (SELECT *, coalesce(text, '') AS x, (end_ms - start_ms) / 1000 AS sec FROM c),
s AS (SELECT episode_id, id, {_language('x')} AS language, round(CASE WHEN sec > 0 THEN length(replace(x, chr(10), '')) / sec ELSE 0.0 END, 4) AS speed FROM t)
SELECT *, speed <= (CASE language WHEN 'zh' THEN 9.0 WHEN 'en' THEN 20.0 WHEN 'ko' THEN 12.0 WHEN 'ja' THEN 4.0 ELSE 20.0 END) AS readable FROM s""",
    "reading_speed_children": f"""{_C}, t AS (SELECT *, coalesce(text, '') AS x, (end_ms - start_ms) / 1000 AS sec FROM c),
s AS (SELECT episode_id, id, {_language('x')} AS language, round(CASE WHEN sec > 0 THEN length(replace(x, chr(10), '')) / sec ELSE 0.0 END, 4) AS speed FROM t)
SELECT *, speed <= (CASE language WHEN 'zh' THEN 7.0 WHEN 'en' THEN 17.0 WHEN 'ko' THEN 9.0 WHEN 'ja' THEN 7.0 ELSE 20.0 END) AS readable FROM s""",
    "long_lines_sdh": f"{_C}, l AS (SELECT *, {_LINES} AS ls FROM c) SELECT episode_id, id FROM l WHERE len(list_filter(ls, lambda x: length(x) > (CASE {_language('x')} WHEN 'zh' THEN 18 WHEN 'en' THEN 42 WHEN 'ko' THEN 16 WHEN 'ja' THEN 16 ELSE 42 END))) > 0",
    "strict_times": f"""SELECT DISTINCT start_tc, CASE WHEN regexp_full_match(start_tc, '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}},[0-9]{{3}}') THEN {_PARSE.format(c='start_tc')} END AS strict, {_PARSE.format(c='start_tc')} AS lenient FROM cues""",
    "char_counts": f"{_C}, t AS (SELECT episode_id, id, coalesce(text, '') AS x FROM c) SELECT episode_id, id, " + ", ".join(f"{v} AS {k}" for k, v in _n("x").items()) + " FROM t",
    "document_language": f"{_C}, t AS (SELECT episode_id, coalesce(text, '') AS x FROM c), s AS (SELECT episode_id, " + ", ".join(f"sum({v}) AS {k}" for k, v in _n("x").items()) + " FROM t GROUP BY episode_id) SELECT episode_id, "
    + ", ".join(f"round({v}, 6) AS score_{k}" for k, v in _scores({k: k for k in _n('x')}).items()) + f", CASE WHEN total = 0 THEN 'en' ELSE {_best(_scores({k: k for k in _n('x')}))} END AS language FROM s",
    "bilingual_cues": f"""{_C}, l AS (SELECT *, {_LINES} AS ls FROM c), n AS (SELECT *, len(list_distinct(list_transform(ls, lambda x: {_language('x')}))) AS k FROM l)
SELECT episode_id, id, CAST(k AS INTEGER) AS n_languages, k > 1 AS bilingual, len(list_filter(ls, lambda x: starts_with(x, '-'))) > 0 AS dialogue FROM n""",
    "needs_resplit": f"{_C}, l AS (SELECT *, {_LINES} AS ls FROM c) SELECT episode_id, coalesce(bool_or(len(ls) > 2 OR len(list_filter(ls, lambda x: length(x) > 42)) > 0), false) AS resplit FROM l GROUP BY episode_id",
    "needs_split": f"""{_C}, l AS (SELECT *, {_LINES} AS ls, (end_ms - start_ms) / 1000 AS sec FROM c),
f AS (SELECT episode_id, id, len(ls) > 2 AS many_lines, len(list_filter(ls, lambda x: length(x) > ({_LIMIT.format(l='(' + _language('x') + ')')}))) > 0 AS long_line,
  coalesce(sec > 0 AND coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) / sec > 20.0, false) AS too_fast FROM l)
SELECT *, many_lines OR long_line OR too_fast AS split FROM f""",
    "sdh_only": f"{_C}, l AS (SELECT *, {_LINES} AS ls, {_TRIM.format(x='text')} AS w FROM c) SELECT episode_id, id, text FROM l WHERE {_SDH_ONLY}",
    "sdh_clean": f"""{_C}, l AS (SELECT *, {_LINES} AS ls, {_TRIM.format(x='text')} AS w FROM c), k AS (SELECT * FROM l WHERE NOT {_SDH_ONLY}),
s AS (SELECT episode_id, id, seq, list_filter(list_transform(list_transform(ls, lambda x: {_STRIP}), lambda y: CASE WHEN y = '-' THEN '' ELSE y END), lambda y: y <> '') AS p FROM k)
SELECT episode_id, CAST(row_number() OVER {_W} - 1 AS INTEGER) AS id, seq, array_to_string(p, chr(10)) AS text FROM s WHERE len(p) > 0""",
    "fragment_flags": f"{_C}, t AS (SELECT episode_id, id, coalesce(text, '') AS t FROM c) SELECT episode_id, id, {_FRAG} AS is_fragment FROM t",
    "fragment_merge": f"""{_C}, r AS (SELECT episode_id, row_number() OVER {_W} - 1 AS id, start_ms, end_ms, coalesce({_TRIM.format(x='text')}, '') AS t FROM c),
h AS (SELECT *, CASE WHEN NOT (id % 3 <> 0 AND {_FRAG}) OR id = 0 THEN 1 ELSE 0 END AS head FROM r),
g AS (SELECT *, sum(head) OVER (PARTITION BY episode_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM h)
SELECT episode_id, CAST(run - 1 AS INTEGER) AS id, CAST(min(id) AS INTEGER) AS first_id, min_by_null(start_ms, id) AS start_ms, max_by_null(end_ms, id) AS end_ms,
  {_FLAT.format(ls="list_filter(list(t ORDER BY id), lambda x: x <> '')")} AS text, count(*) AS n FROM g GROUP BY episode_id, run""".replace("min_by_null(start_ms, id)", "first(start_ms ORDER BY id)").replace("max_by_null(end_ms, id)", "last(end_ms ORDER BY id)"),
    "flatten_lines": f"{_C}, l AS (SELECT episode_id, id, {_LINES} AS ls FROM c) SELECT episode_id, id, {_FLAT.format(ls='ls')} AS flat FROM l",
    **{f"merge_lines_{code}": f"{_C}, l AS (SELECT episode_id, id, {_LINES} AS ls FROM c) SELECT episode_id, id, {_merge_sql(*how)} AS lines FROM l" for code, how in {"en": (42, " ", ".!?", True), "zh": (16, "", "。！？", False), "ko": (16, " ", "。！？", False)}.items()},
    "context_window": f"""{_C}, t AS (SELECT episode_id, id, coalesce(text, '') AS x FROM c)
SELECT episode_id, id, coalesce(string_agg(x, '|') OVER (PARTITION BY episode_id ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(x, '|') OVER (PARTITION BY episode_id ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '') AS after FROM t""",
    "summary_payload": f"{_C} SELECT episode_id, string_agg(CAST(id AS VARCHAR) || chr(9) || replace(coalesce(text, ''), chr(10), ' / '), chr(10) ORDER BY id) AS payload FROM c GROUP BY episode_id",
}
