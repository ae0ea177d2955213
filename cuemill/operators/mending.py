"""Reading of JSON objects that a model left broken.

The text is read field by field. Keys may lack their opening quote, and the
text may stop anywhere; what was whole before that is kept. Strings are read as
strings, so braces inside them don't count.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

_FENCE = re.compile(r"^```(?:json|JSON)?\s*\n?|\n?```\s*$")
_BARE_KEY = re.compile(r'(\d+)"')
_BLANK = re.compile(r"\s*")
_JSON = json.JSONDecoder()


class Mended(NamedTuple):
    value: object | None
    notes: list[str]


class _Read(NamedTuple):
    fields: dict
    end: int
    closed: bool  # its brace is there
    clean: bool  # nothing half-read at its end
    tight: bool  # the comma before what is missing has no blank behind it
    last: int = 0  # fields up to the last object with a text right before its brace


def bare(text: str) -> str:
    """The text without a code fence around it."""
    inner = text.strip()
    return _FENCE.sub("", inner).strip() if inner.startswith("```") else inner


def _skip(text: str, at: int) -> int:
    return _BLANK.match(text, at).end()


def _read(text: str, at: int, quoted: list[int]) -> _Read:
    """Fields of the object whose brace is before ``at``; places of keys that lacked a quote are added to ``quoted``."""
    fields: dict = {}
    comma, last = -1, 0
    while True:
        here = _skip(text, at)
        if here >= len(text):
            return _Read(fields, here, False, comma < 0, False, last)
        if text[here] == "}" and (comma < 0 or not fields):
            return _Read(fields, here + 1, True, True, False, last)
        stopped = _Read(fields, here, False, False, comma >= 0 and here == comma + 1 and text[here] == '"', last)
        try:
            lone = _BARE_KEY.match(text, here)
            if lone:
                key, here = lone.group(1), lone.end()
                quoted.append(here)
            elif text[here] == '"':
                key, here = _JSON.raw_decode(text, here)
            else:
                return stopped
            here = _skip(text, here)
            if text[here : here + 1] != ":":
                return stopped
            here = _skip(text, here + 1)
            if text[here : here + 1] == "{":
                inner = _read(text, here + 1, quoted)
                if not inner.closed:
                    if inner.clean:
                        return _Read(fields | {key: inner.fields}, inner.end, False, True, False, last)
                    return _Read({key: inner.fields}, inner.end, False, False, True) if inner.tight and not last else stopped
                value, here = inner.fields, inner.end
            else:
                value, here = _JSON.raw_decode(text, here)
        except ValueError:
            return stopped
        fields[key] = value
        if isinstance(value, dict) and text[here - 2 : here] == '"}':
            last = len(fields)
        here = _skip(text, here)
        comma = here if text[here : here + 1] == "," else -1
        if comma < 0 and text[here : here + 1] not in ("}", ""):
            return _Read(fields, here, False, False, False, last)
        at = here + 1 if comma >= 0 else here


def mend(raw: str | None) -> Mended:
    """The value and what had to be done for it; null where nothing whole is left.

    Of a text that stops short, entries count up to the last object with a text
    right before its brace; without any, what stands before the last comma that
    has no blank behind it.
    """
    if not raw or not raw.strip():
        return Mended(None, ["empty"])
    text = bare(raw)
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        value = None
    if value is not None:
        return Mended(value, [])
    if not text.startswith("{"):
        return Mended(None, ["unrecoverable"])
    quoted: list[int] = []
    read = _read(text, 1, quoted)
    notes = ["quoted keys"] * bool(quoted)
    if read.closed and _skip(text, read.end) == len(text):
        return Mended(read.fields, notes)
    if not read.closed and read.clean:
        return Mended(read.fields, [*notes, "closed braces"])
    if read.last:
        return Mended(dict(list(read.fields.items())[: read.last]), [*notes, "cut after the last whole entry"])
    if read.tight and read.fields:
        return Mended(read.fields, [*notes, "dropped the last entry"])
    return Mended(None, [*notes, "unrecoverable"])
