"""Calls of a model behind one function, and what is normalised around them.

A provider is a function of (input text, instructions) that returns a Reply or
raises. Everything here runs inside a task or on the driver for one call; the
tables are in cuemill.pipeline.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from typing import NamedTuple

from cuemill.operators.mending import bare
from cuemill.operators.responses import RETRY_CODES, RETRY_NAMES, RETRY_NEEDLES, check_response

# Names of the two ways to call, and the headings of an instruction's parts.
MODES = {"chat_completions": ("chat", "chatcompletion", "chatcompletions", "chatcompletionapi"), "responses": ("response", "responses", "responseapi", "responsesapi")}
GLOSSARY_HEADING = "## 专有名词（必须遵守，不得另译）"
SUMMARY_HEADING = "## 本集剧情摘要（翻译时请参考语境与人物状态，勿写入输出 JSON）"
SUMMARY_GLOSSARY_HEADING = "## 专有名词（摘要中使用表内译名，不要另造）"
OMIT = None


class Reply(NamedTuple):
    text: str
    status: str = "completed"
    incomplete_reason: str | None = None
    input_tokens: int = 0
    output_tokens: int = 0
    total_tokens: int = 0


Provider = Callable[[str, str], Reply]


def stub_provider(text: str, instructions: str) -> Reply:
    """An offline stand-in: echoes every source and puts its instructions' last word before it."""
    mark = (instructions.split() or ["?"])[-1]
    asked = json.loads(text)
    return Reply(json.dumps({k: {"src": v, "tr": f"[{mark}] {v}"} for k, v in asked.items()}, ensure_ascii=False), "completed", None, len(text), len(text), 2 * len(text))


def api_mode(spelling: str) -> str:
    """The name of a way to call, however it is spelled."""
    letters = "".join(ch for ch in str(spelling).lower() if ch.isalnum())
    for name, ways in MODES.items():
        if letters in ways:
            return name
    raise ValueError(f"unknown mode {spelling!r}")


def sampling(explicit: float | None, recorded: dict | None = None) -> dict:
    """{sent, value}: an explicit value, 0 included, else what was recorded as sent, else nothing is sent."""
    if explicit is not None:
        return {"sent": True, "value": float(explicit)}
    if isinstance(recorded, dict) and recorded.get("sent") is True and recorded.get("value") is not None:
        return {"sent": True, "value": float(recorded["value"])}
    return {"sent": False, "value": OMIT}


def usage(data: dict | None) -> dict[str, int]:
    """Token counts under either provider's spelling; what is missing is 0."""
    data = data or {}
    first = lambda *names: next((int(data[n]) for n in names if data.get(n)), 0)
    details = data.get("output_tokens_details") or data.get("completion_tokens_details") or {}
    return {
        "input_tokens": first("input_tokens", "prompt_tokens"), "output_tokens": first("output_tokens", "completion_tokens"),
        "reasoning_tokens": int(details.get("reasoning_tokens") or 0), "total_tokens": first("total_tokens"),
    }


def reply_text(body: dict) -> str:
    """The text of a response of either kind: output_text, message parts, or the first choice's content."""
    if body.get("output_text"):
        return body["output_text"]
    if body.get("choices"):
        content = (body["choices"][0].get("message") or {}).get("content")
        return content if isinstance(content, str) else "".join(str(part["text"]) for part in content or [] if part.get("text"))
    parts = [c for item in body.get("output") or [] if item.get("type") == "message" for c in item.get("content") or []]
    return "".join(c.get("text") or "" for c in parts if c.get("type") == "output_text")


def _fill(template: str, source: str, target: str) -> str:
    return template.replace("${sourceLanguage}", source).replace("${targetLanguage}", target).rstrip()


def instructions(template: str, source: str, target: str, glossary: Iterable[str] = (), summary: str | None = None, heading: str = GLOSSARY_HEADING) -> str:
    """The template with its languages, then a section for the glossary's lines and one for the summary, if there are any."""
    parts = [_fill(template, source, target)]
    lines = "\n".join(glossary)
    if lines.strip():
        parts.append(f"\n\n{heading}\n{lines}")
    if summary and summary.strip():
        parts.append(f"\n\n{SUMMARY_HEADING}\n{summary.strip()}")
    return "\n".join(parts).strip() + "\n"


def summary_instructions(template: str, source: str, target: str, glossary: Iterable[str] = ()) -> str:
    return instructions(template, source, target, glossary, None, SUMMARY_GLOSSARY_HEADING)


def model_list(spec: str | None, known: list[str]) -> list[str]:
    """'all', '*' or nothing means all known models, else a list parted by commas."""
    spec = (spec or "all").strip()
    return list(known) if spec.lower() in ("all", "*") else [m.strip() for m in spec.split(",") if m.strip()]


def in_order(rows: list[dict], models: list[str], key: str = "model_alias") -> list[dict]:
    """Results in the order in which the models were asked for; those of one model keep theirs."""
    place = {m: i for i, m in reversed(list(enumerate(models)))}
    return sorted(rows, key=lambda r: place.get(r[key], len(place)))


def same_mode(requested: str | None, meta: object) -> str:
    """The mode a repair must use: that of the run; another one, or meta that is no object, is an error."""
    if not isinstance(meta, dict):
        raise ValueError("meta must be an object")
    recorded = api_mode(meta["api_mode"]) if meta.get("api_mode") else None
    if requested and recorded and api_mode(requested) != recorded:
        raise ValueError(f"the run was made with {recorded}, not {requested}")
    return recorded or (api_mode(requested) if requested else "chat_completions")


def worth_retrying(failure: BaseException) -> bool:
    name, text = type(failure).__name__, str(failure).lower()
    return name in RETRY_NAMES or any(n in text for n in RETRY_NEEDLES) or getattr(failure, "status_code", None) in RETRY_CODES


def retry_reason(reply: Reply, asked: dict[str, str] | None) -> str | None:
    """Why a reply is not to be used, in the order status, incomplete, invalid; ``asked`` is null where it need not be JSON."""
    if reply.status != "completed":
        return f"status {reply.status}"
    if reply.incomplete_reason:
        return f"incomplete {reply.incomplete_reason}"
    if asked is None:
        return None if reply.text.strip() else "empty"
    whole, _, entries = check_response(reply.text, asked)
    good = [e for e in entries if e["echo"] != "extra" and e["fault"] is None]
    held = whole is None and len(good) == len(asked) == len(entries) and all(e["echo"] not in ("misaligned", "mismatch") for e in good)
    return None if held else f"invalid {whole or ''}".strip()


def call(provider: Provider, text: str, instructions: str, asked: dict[str, str] | None, retries: int = 2, backoff: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> tuple[Reply, int, list[str]]:
    """(last reply, tries, why each try but the last good one failed).

    After an exception the text of an earlier try is kept, its status is the error's; an exception that isn't worth
    another try ends the call.
    """
    notes: list[str] = []
    reply = Reply("", "error")
    for n in range(1, retries + 2):
        try:
            reply = provider(text, instructions)
            why = retry_reason(reply, asked)
        except Exception as failure:  # whatever a provider raises is one failed try
            why = f"{type(failure).__name__}: {failure}"
            reply = reply._replace(status=f"error: {why}")
            if not worth_retrying(failure):
                return reply, n, [*notes, why]
        if why is None:
            return reply, n, notes
        notes.append(why)
        if n <= retries:
            sleep(backoff * 2 ** (n - 1))
    return reply, retries + 1, notes


def same_keys(text: str, asked: dict[str, str]) -> dict[str, object]:
    """A JSON object of just the asked keys, or an error that names the others."""
    value = json.loads(bare(text))
    if not isinstance(value, dict):
        raise ValueError("no object")
    if set(value) != set(asked):
        raise ValueError(f"missing keys {sorted(set(asked) - set(value))}, unexpected keys {sorted(set(value) - set(asked))}")
    return value
