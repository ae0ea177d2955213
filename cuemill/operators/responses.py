"""Model responses: checks against what was asked, and what follows from them.

A response and what it was asked for are one row, so mending, key check, echo
check and type check are one narrow pass over the rows, without a shuffle; the
tables of entries, keys and warnings are projections of its result.
"""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.operators.mending import mend

# Marks that don't count when an echo is compared, and words that tell refusals and technical failures.
ECHO_MARKS = "!\"'(),\\-.:;?[]`{}…‘’“”—–，。！？；：（）【】《》、"
REFUSAL_MARKERS = ("refusal", "safety", "content policy", "content_filter", "content filter", "blocked")
TECHNICAL_MARKERS = ("connection", "timeout", "timed out", "rate limit", "ratelimit", "network")
RETRY_NAMES = ("APIConnectionError", "APITimeoutError", "RateLimitError", "InternalServerError", "APIStatusError", "TimeoutError", "RemoteProtocolError", "ConnectError", "ReadTimeout")
RETRY_NEEDLES = ("429", "500", "502", "503", "504", "timeout", "rate limit", "overloaded")
RETRY_CODES = (408, 409, 429, 500, 502, 503, 504)
DRIFT = 0.85
SHOWN = 20  # keys named in a report; further ones are counted


_ENTRY = pa.struct([(n, pa.string()) for n in ("key", "src", "tr", "fault", "echo", "other")] + [("ratio", pa.float64())])
_ENTRY_SQL = "array<struct<key: string, src: string, tr: string, fault: string, echo: string, other: string, ratio: double>>"


def _canonical(value: dict) -> str:
    """Canonical text; half a surrogate pair, as a cut leaves it, becomes a question mark."""
    return _clean(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def repaired(results: DataFrame) -> DataFrame:
    """(result_id, body, notes): body is the mended JSON object as canonical text, null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [mend(raw) for raw in batch.column(1).to_pylist()]
            body = [_canonical(v) if isinstance(v, dict) else None for v, _ in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.string()), pa.array([", ".join(n) for _, n in done], pa.string())], names=["result_id", "body", "notes"])

    return results.select("result_id", "raw_text").mapInArrow(run, "result_id bigint, body string, notes string")


def normalize_src(text: str | None) -> str:
    """Compatibility form, case folded, marks as spaces, white space collapsed."""
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(_MARKS.sub(" ", folded).split())


_MARKS = re.compile("[" + re.escape(ECHO_MARKS) + "]+")


def number_first(key: str) -> tuple[int, int, str]:
    """Sorts keys that are numbers by their value, before all others."""
    return (0, int(key), key) if key.isdecimal() else (1, 0, key)


def _as_text(value: object) -> str | None:
    """Texts as they are, nothing for null, other values as JSON."""
    if value is None or isinstance(value, str):
        return None if value is None else _clean(value)
    return _canonical(value) if isinstance(value, dict) else _clean(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def _fault(value: object) -> str | None:
    if not isinstance(value, dict):
        return "no_object"
    tr = value.get("tr")
    if tr is None or (isinstance(tr, str) and not tr.strip()):
        return "no_translation"
    return None if isinstance(tr, str) else "no_text"


def echo_verdict(key: str, src: str | None, asked: dict[str, str | None], owners: dict[str, list[str]]) -> tuple[str, str | None, float | None]:
    """(kind, other key, likeness): missing, ok, misaligned (the text of another key, the first in order), drift or mismatch."""
    if src is None or not src.strip():
        return "missing", None, None
    if src == asked[key]:
        return "ok", None, 1.0
    mine, echo = normalize_src(asked[key]), normalize_src(src)
    if mine == echo:
        return "ok", None, 1.0
    if not owners:
        for k, text in asked.items():
            owners.setdefault(normalize_src(text), []).append(k)
    if echo in owners:
        return "misaligned", owners[echo][0], None
    ratio = difflib.SequenceMatcher(None, mine, echo).ratio()
    return ("drift" if ratio >= DRIFT else "mismatch"), None, round(ratio, 4)


def check_response(raw: str | None, asked: dict[str, str | None]) -> tuple[str | None, list[str], list[dict]]:
    """(what is wrong with the whole, notes of mending, entries in their order)."""
    value, notes = mend(raw)
    if not isinstance(value, dict):
        return ("empty" if notes == ["empty"] else "unparsed" if value is None else "no_object"), notes, []
    owners: dict[str, list[str]] = {}
    found = []
    for key, v in value.items():
        src = _as_text(v.get("src")) if isinstance(v, dict) else None
        kind, other, ratio = echo_verdict(key, src, asked, owners) if key in asked else ("extra", None, None)
        found.append({"key": _clean(key), "src": src, "tr": _as_text(v.get("tr")) if isinstance(v, dict) else None, "fault": _fault(v), "echo": kind, "other": other, "ratio": ratio})
    return None, notes, found


def checked(results: DataFrame, *keep: str) -> DataFrame:
    """The kept columns of each response, with

    whole (null, empty, unparsed or no_object), notes, n_in, n_out, n_tr_ok,
    missing and extra keys in numeric order, entries (key, src, tr, fault, echo,
    other, ratio), and ok: just the asked keys, each an object with a
    translation that isn't blank, and no echo of another text. A null input_map
    asks for nothing, a null raw_text is empty.
    """
    found = T._parse_datatype_string(f"whole string, notes string, n_in bigint, n_out bigint, n_tr_ok bigint, missing array<string>, extra array<string>, entries {_ENTRY_SQL}, ok boolean")
    schema = T.StructType([*(results.schema[c] for c in keep), *found.fields])
    texts = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, pairs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                asked = dict(pairs or ())
                whole, notes, entries = check_response(raw, asked)
                got = {e["key"] for e in entries}
                missing, extra = sorted(set(asked) - got, key=number_first), sorted(got - set(asked), key=number_first)
                good = [e for e in entries if e["echo"] != "extra" and e["fault"] is None]
                ok = whole is None and not missing and not extra and len(good) == len(asked) and all(e["echo"] not in ("misaligned", "mismatch") for e in good)
                rows.append((whole, ", ".join(notes), len(asked), len(entries), len(good), missing, extra, entries, ok))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), texts, texts, pa.list_(_ENTRY), pa.bool_())
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=schema.names)

    return results.select("raw_text", "input_map", *keep).mapInArrow(run, schema)


def entries(checks: DataFrame, *keep: str) -> DataFrame:
    """One row per entry of the checked responses."""
    return checks.select(*keep, F.inline("entries"))


def accepted() -> Column:
    """An asked entry whose translation counts: an object with a text that isn't blank."""
    return (F.col("echo") != "extra") & F.col("fault").isNull()


def key_report(checks: DataFrame) -> DataFrame:
    """Keys missing from and added to each response: the first SHOWN in numeric order, and how many more."""
    show = lambda c: F.array_join(F.slice(c, 1, SHOWN), ",")
    more = lambda c: F.greatest(F.size(c) - SHOWN, F.lit(0))
    return checks.select("result_id", show("missing").alias("missing"), show("extra").alias("extra"), more("missing").alias("more_missing"), more("extra").alias("more_extra"))


def summary(checks: DataFrame) -> DataFrame:
    """One row per response: counts of what is wrong, of what is worth a warning, and whether it holds."""
    good = lambda e: (e["echo"] != "extra") & e["fault"].isNull()
    of_fault = lambda f: F.size(F.filter("entries", lambda e: (e["echo"] != "extra") & (e["fault"] == f)))
    of_echo = lambda k: F.size(F.filter("entries", lambda e: good(e) & (e["echo"] == k)))
    return checks.select(
        "result_id", "whole", "n_in", "n_out", "n_tr_ok", F.size("missing").alias("n_missing"), F.size("extra").alias("n_extra"),
        *[of_fault(f).alias(f"n_{f}") for f in ("no_object", "no_translation", "no_text")],
        *[of_echo(k).alias(name) for k, name in (("misaligned", "n_misaligned"), ("mismatch", "n_mismatch"), ("drift", "n_drift"), ("missing", "n_no_echo"))],
        "ok",
    )


def messages() -> Column:
    """What is wrong with a checked response, as texts: the call, the whole, keys, then entries in their order."""
    def keys(name: str, column: str) -> Column:
        more = F.when(F.size(column) > SHOWN, F.concat(F.lit(" ...(+"), (F.size(column) - SHOWN).cast("string"), F.lit(")"))).otherwise("")
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{name} keys: "), F.array_join(F.slice(column, 1, SHOWN), ", "), more))

    def entry(e: Column) -> Column:
        bad_echo = F.when(e["echo"] == "misaligned", F.concat(F.lit("echoes "), e["other"])).when(e["echo"] == "mismatch", "echoes another text")
        return F.concat(F.lit("id "), e["key"], F.lit(": "), F.coalesce(e["fault"], bad_echo))

    call = [F.when(F.col("status") != "completed", F.concat(F.lit("status "), "status")), F.when(F.coalesce("incomplete_reason", F.lit("")) != "", F.concat(F.lit("incomplete "), "incomplete_reason"))]
    of_entries = F.transform(F.filter("entries", lambda e: e["echo"] != "extra"), entry)
    return F.array_compact(F.concat(F.array(*call, "whole", keys("missing", "missing"), keys("extra", "extra")), of_entries))


def fine() -> Column:
    """A call that was completed, is not incomplete and whose response holds."""
    return F.coalesce((F.col("status") == "completed") & (F.coalesce("incomplete_reason", F.lit("")) == "") & F.col("ok"), F.lit(False))


def style(got: DataFrame) -> DataFrame:
    """Style warnings of each translation."""
    latin, han = F.regexp_count("tr", F.lit("[A-Za-z]")), F.regexp_count("tr", F.lit("[一-鿿]"))
    return got.where("tr IS NOT NULL").select(
        "result_id", "key",
        (F.col("tr").contains("，") | F.col("tr").contains("。")).alias("wide_marks"),
        (F.col("tr").contains("|") | F.col("tr").contains("｜")).alias("bars"),
        (F.col("tr").contains("⋯") | F.col("tr").contains("...")).alias("bad_ellipsis"),
        ((latin > 8) & (latin > han)).alias("latin_residue"),
    )


def failure_text() -> Column:
    return F.lower(F.concat_ws(" ", "status", F.coalesce("incomplete_reason", F.lit(""))))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def outcome(results: DataFrame) -> DataFrame:
    """provider_refusal, technical_failure or completed; silence without a technical reason is a refusal."""
    text = failure_text()
    silent = F.trim(F.coalesce("raw_text", F.lit(""))) == ""
    refused = _any(text, REFUSAL_MARKERS) | (silent & ~_any(text, TECHNICAL_MARKERS))
    fine = (F.col("status") == "completed") & F.col("incomplete_reason").isNull() & ~silent
    return results.select("result_id", F.when(refused, "provider_refusal").when(fine, "completed").otherwise("technical_failure").alias("outcome"))


def usage(body: Column) -> dict[str, Column]:
    """Token counts in a provider's JSON under either spelling; what is missing is 0."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(body, f"$.{p}").try_cast("bigint") for p in paths], F.lit(0).cast("bigint"))
    return {
        "input_tokens": at("input_tokens", "prompt_tokens"), "output_tokens": at("output_tokens", "completion_tokens"),
        "reasoning_tokens": at("output_tokens_details.reasoning_tokens", "completion_tokens_details.reasoning_tokens"), "total_tokens": at("total_tokens"),
    }


def retryable(name: Column, text: Column, code: Column | None = None) -> Column:
    """Whether a failed call is worth another: by the name of its exception, words in its text or its status code."""
    by_code = F.lit(False) if code is None else F.coalesce(code.isin(*RETRY_CODES), F.lit(False))
    return F.coalesce(name.isin(*RETRY_NAMES), F.lit(False)) | F.coalesce(_any(F.lower(text), RETRY_NEEDLES), F.lit(False)) | by_code


def errors(results: DataFrame) -> DataFrame:
    """(result_id, name, text, code, retryable) of the calls that ended in an exception: status is 'error: Name: text'."""
    told = F.regexp_extract("status", r"^error: *([A-Za-z]*):? *([\s\S]*)$", 1)
    text = F.regexp_extract("status", r"^error: *([A-Za-z]*):? *([\s\S]*)$", 2)
    code = F.expr("try_cast(regexp_extract(status, '\\\\b([45][0-9]{2})\\\\b', 1) AS int)")
    rows = results.where(F.col("status").startswith("error")).select("result_id", told.alias("name"), text.alias("text"), code.alias("code"))
    return rows.withColumn("retryable", retryable(F.col("name"), F.col("text"), F.col("code")))


def retry(results: DataFrame) -> DataFrame:
    """Why a call is to be repeated, in the order error, status, incomplete, invalid, or null."""
    checks = checked(results, "result_id", "status", "incomplete_reason")
    error = _any(F.col("status"), RETRY_NAMES) | _any(F.lower("status"), RETRY_NEEDLES)
    reason = F.when(F.col("status").startswith("error") & error, "error").when(F.col("status") != "completed", "status").when(F.coalesce("incomplete_reason", F.lit("")) != "", "incomplete").when(~F.col("ok"), "invalid")
    return checks.select("result_id", reason.alias("reason"))


# Fixed value: a character that str.strip() keeps.
VISIBLE = r"[^\s\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]"


def latest(results: DataFrame) -> DataFrame:
    """One row per result: the last made."""
    by = Window.partitionBy("result_id").orderBy(F.desc("created_at"))
    return results.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def merged(results: DataFrame) -> DataFrame:
    """Accepted entries of an episode over its batches and tries: the last try of the last batch wins."""
    rows = entries(checked(results, "result_id", "episode_id", "batch_index", "attempt"), "result_id", "episode_id", "batch_index", "attempt").where(accepted())
    rank = F.struct("batch_index", "attempt", "result_id", "tr")
    best = rows.groupBy("episode_id", "key").agg(F.max(rank).alias("b"), F.count("*").alias("n_versions"))
    return best.select("episode_id", "key", "b.tr", "b.result_id", "n_versions")


def choose_batches(reports: DataFrame, chosen: list[int] | None = None, missing: DataFrame | None = None, size: int = 50) -> DataFrame:
    """(episode_id, batch_index) to repeat: those named; else those not ok; else those that lack keys.

    ``reports`` has episode_id, batch_index and ok; ``missing`` has episode_id
    and key, whose batch is the key over ``size``.
    """
    if chosen is not None:
        return reports.where(F.col("batch_index").isin(chosen)).select("episode_id", "batch_index").distinct()
    failed = reports.where(~F.coalesce("ok", F.lit(False))).select("episode_id", "batch_index").distinct()
    if missing is None:
        return failed
    lacking = missing.select("episode_id", F.expr(f"try_cast(key AS int) div {int(size)}").cast("int").alias("batch_index")).where("batch_index IS NOT NULL").distinct()
    return failed.unionByName(lacking.join(failed.select("episode_id").distinct(), "episode_id", "left_anti"))
