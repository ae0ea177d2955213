"""Reading of model answers that should be objects {id: {src, tr}}, whole or not."""

from __future__ import annotations

import json
import re
import unicodedata
from typing import NamedTuple

_FENCE = re.compile(r"```[A-Za-z]*")
_KEY = re.compile(r'[{,]\s*"?([^"{}:,\s]+)"\s*:\s*')
_FIELD = re.compile(r'"(src|tr)"\s*:\s*')
_TEXT = re.compile(r'"((?:[^"\\]|\\.)*)("?)', re.S)
_MARKUP = re.compile(r"<[^<>]*>|\{\\[^{}]*\}")


class Entry(NamedTuple):
    key: str
    src: str | None
    tr: str | None
    whole: bool


class Answer(NamedTuple):
    entries: list[Entry]
    said: list[str]  # what stands outside the entries
    cut: bool  # the text stops inside an entry


def _unescape(text: str) -> str:
    try:
        return json.loads(f'"{text}"', strict=False)
    except ValueError:
        return text.rstrip("\\")


def _texts(value: object) -> tuple[str | None, str | None]:
    if isinstance(value, dict):
        pick = lambda k: None if value.get(k) is None else str(value[k])
        return pick("src"), pick("tr")
    return None, None if value is None else str(value)


def read_answer(raw: str | None) -> Answer:
    """Entries in their order; a missing fence, bracket or opening quote of a key costs nothing."""
    text = _FENCE.sub("", raw or "").strip()
    start = text.find("{")
    if start < 0:
        bare = text.strip('[]" \t\r\n')
        return Answer([], [] if bare in ("", "null") else [bare], False)
    said = [text[:start].strip()] if text[:start].strip() else []
    body = text[start:]
    fixed = re.sub(r'([{,]\s*)(\d+)"(\s*:)', r'\1"\2"\3', body)
    for tail in ("", "}", "}}"):
        try:
            whole, end = json.JSONDecoder(strict=False).raw_decode(fixed + tail)
        except ValueError:
            continue
        after = (fixed + tail)[end:].strip(" }\n\r\t")
        entries = []
        for key, value in whole.items():
            if isinstance(value, str) and not key.strip().lstrip("-").isdigit():
                said.append(value)
            else:
                entries.append(Entry(key, *_texts(value), True))
        return Answer(entries, said + [after] * bool(after), False)
    return Answer(*_scan(body, said))


def _scan(body: str, said: list[str]) -> tuple[list[Entry], list[str], bool]:
    """Reads entry by entry until the text stops."""
    entries: list[Entry] = []
    at = 0
    while m := _KEY.search(body, at):
        key, at = m.group(1), m.end()
        if at >= len(body):
            return [*entries, Entry(key, None, None, False)], said, True
        if body[at] == '"':
            t = _TEXT.match(body, at)
            entries.append(Entry(key, None, _unescape(t.group(1)), bool(t.group(2))))
            at = t.end()
            if not t.group(2):
                return entries, said, True
            continue
        found: dict[str, str] = {}
        cut = body[at] != "{" and not body.startswith("null", at)
        at += body[at] == "{"
        while f := _FIELD.match(body, len(body) - len(body[at:].lstrip(" \t\r\n,"))):
            at = f.end()
            if body.startswith("null", at):
                at += 4
                continue
            t = _TEXT.match(body, at)
            if t is None:
                cut = True
                break
            found[f.group(1)] = _unescape(t.group(1))
            at = t.end()
            if not t.group(2):
                cut = True
                break
        rest = body[at:].strip()
        unfinished = cut or (not rest.startswith("}") and "tr" not in found)
        entries.append(Entry(key, found.get("src"), found.get("tr"), not unfinished))
        if unfinished:
            return entries, said, True
    return entries, said, bool(re.search(r'[,"]\s*\w*$', body[at:].strip("} \n\r\t")) and body[at:].strip("} \n\r\t").rstrip(",").strip())


_NOT_PLAIN = re.compile(r"[\W_]+")
_PLAIN = re.compile(r"[^\W_]")


def plain(text: str | None) -> str:
    """Letters and digits only, without case, width or markup."""
    text = text or ""
    if "<" in text or "{" in text:
        text = _MARKUP.sub("", text)
    return _NOT_PLAIN.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())


def blank(text: str | None) -> bool:
    return not text or not (_PLAIN.search(text) or any(unicodedata.category(ch)[0] in "SP" for ch in text))


_CLAUSE = re.compile(r"[\n\r.,;:!?。，、；：！？…—–()\[\]{}\"“”«»|]+")
_DIGITS = re.compile(r"\d+")
OPENING = 2  # clauses of a text that may tell what kind of reply it is
TELLING = 9  # letters of a clause that tells something; ideographs and syllables count twice


def openings(text: str) -> list[str]:
    """The first clauses that tell something, digits levelled; of a text without any, the whole of it."""
    text = _MARKUP.sub("", text) if "<" in text or "{" in text else text
    out: list[str] = []
    at = 0
    while len(out) < OPENING and at <= len(text):
        cut = _CLAUSE.search(text, at)
        part = text[at : cut.start() if cut else len(text)]
        at = cut.end() if cut else len(text) + 1
        part = _level(part)
        if len(part) + (0 if part.isascii() else sum(ch > "\u2e7f" for ch in part)) >= TELLING:
            out.append(part)
    return out or [whole for whole in (_level(text),) if _PLAIN.search(whole)]


def _level(part: str) -> str:
    return _DIGITS.sub("#", " ".join((part if part.isascii() else unicodedata.normalize("NFKC", part)).casefold().split()))
