"""Forms that words take when they are decoded with a wrong encoding."""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

SINGLE = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp1250", "koi8-r", "cp437", "cp850", "cp866", "iso8859-15")
DOUBLE = ("gb18030", "big5", "cp932", "cp949", "euc_jp")
TWICE = ("cp1252", "latin-1", "cp1251", "mac_roman")

_WRITTEN = {
    "latin": ("utf-8", "cp1252", "mac_roman", "cp1250", "cp437", "cp850", "gb18030"),
    "cyrillic": ("utf-8", "cp1251", "koi8-r", "cp866"),
    "hangul": ("utf-8", "cp949"),
    "cjk": ("utf-8", "gb18030", "big5", "cp932", "cp949", "euc_jp"),
    "sign": ("utf-8", "cp1252", "mac_roman", "cp1251", "gb18030", "cp949", "cp932"),
}
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿　-〿！-･]")
RUN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=None)
def _table(codec: str) -> str:
    """A single-byte code page; bytes it leaves undefined keep their number, as browsers do."""
    out = []
    for byte in range(256):
        try:
            out.append(bytes([byte]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(byte))
    return "".join(out)


@lru_cache(maxsize=None)
def _bytes(codec: str) -> dict[str, int]:
    return {ch: byte for byte, ch in enumerate(_table(codec))}


def read_as(data: bytes, codec: str) -> str:
    if codec in SINGLE:
        return codecs.charmap_decode(data, "strict", _table(codec))[0]
    return data.decode(codec, "replace")


def write_as(text: str, codec: str) -> bytes | None:
    if codec in SINGLE:
        table = _bytes(codec)
        try:
            return bytes([table[ch] for ch in text])
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def script(word: str) -> str | None:
    """latin, cyrillic, hangul, cjk or sign if a word could be clean: letters of one script, signs apart."""
    kinds = set()
    for ch in word:
        if ch.isascii():
            if ch.isalpha():
                kinds.add("latin")
            continue
        category = unicodedata.category(ch)
        if _CJK.match(ch):
            kinds.add("cjk")
        elif category[0] == "L" and category != "Lo":
            name = unicodedata.name(ch, "")
            kinds.add("latin" if name.startswith("LATIN") else "cyrillic" if name.startswith("CYRILLIC") else "other")
        elif "가" <= ch <= "힣":
            kinds.add("hangul")
        elif category in ("Cc", "Co", "Cn", "Cs", "Zs") or ch == "�":
            return None
        elif category[0] in "SN" or category == "Lo":
            kinds.add("sign")
    if len(kinds) == 1:
        return kinds.pop() if "other" not in kinds else None
    return "sign" if not kinds else None


@lru_cache(maxsize=1 << 18)
def _start(char: str, *chain: str) -> str | None:
    """What a form by a chain of right and single-byte wrong encodings begins with, after the ASCII before ``char``; null if it can't be written."""
    for right, wrong in zip(chain[::2], chain[1::2]):
        data = write_as(char, right)
        if data is None:
            return None
        char = read_as(data, wrong)
    return char


def forms(word: str, kind: str, pairs: bool = False, deep: bool = False, met: Callable[[str], bool] | None = None) -> dict[str, str]:
    """{wrong form: chain} of a clean word; the first chain that makes a form names it.

    ``met`` tells whether a form with this beginning need be made at all.

    Every right encoding of the script is read by every wrong one. ``deep`` adds
    the forms of words that were read wrongly twice, by any two of TWICE, and
    those of two-byte units read byte by byte. Of a pair of characters only
    UTF-8 read by twos is asked, where the forms of single characters straddle.
    """
    out: dict[str, str] = {}
    again: list[tuple[str, str, tuple[str, str]]] = []
    first = next((ch for ch in word if not ch.isascii()), None) if met else None
    begins = lambda *chain: first is None or ((start := _start(first, *chain)) is not None and met(start))
    for right in ("utf-8",) if pairs else _WRITTEN[kind]:
        data = write_as(word, right)
        if data is None:
            continue
        for wrong in DOUBLE if pairs else (*SINGLE, *DOUBLE, "utf-8"):
            if wrong == right or (wrong in SINGLE and not (deep and wrong in TWICE) and not begins(right, wrong)):
                continue
            form = read_as(data, wrong)
            if form == word or (wrong == "utf-8" and "�" not in form):
                continue  # bytes of another encoding that are valid UTF-8 by chance are not met
            out.setdefault(form, f"{right}>{wrong}")
            if deep and wrong in TWICE and "�" not in form:
                again += [(form, second, (right, wrong)) for second in TWICE if begins(right, wrong, "utf-8", second)]
    for form, second, (right, wrong) in again:
        out.setdefault(read_as(form.encode("utf-8"), second), f"{right}>{wrong}>utf-8>{second}")
    return out | wide_forms(word) if deep else out


def wide_forms(word: str) -> dict[str, str]:
    """{form: chain} of a word whose two-byte units were read byte by byte."""
    form = word.encode("utf-16-le", "replace").decode("latin-1").strip("\0")
    return {form: "utf-16>latin-1"} if form != word else {}


def byte_pairs(text: str) -> dict[str, str]:
    """{pair of ASCII characters: chain} of an ideograph or syllable whose escapes were taken for text."""
    out = {}
    for right in ("iso2022_jp", "iso2022_kr"):
        try:
            data = text.encode(right)
        except UnicodeEncodeError:
            continue
        inner = re.search(rb"(?:\x1b\$[@B]|\x0e)(..)(?:\x1b\([BJ]|\x0f|$)", data)
        if inner:
            out.setdefault(inner.group(1).decode("ascii"), f"{right}>ascii")
    return out


@lru_cache(maxsize=1)
def residues() -> dict[str, str]:
    """{what the replacement character itself turns into: chain}, and single signs that no text has; texts with them have lost bytes."""
    found = {"�": "lost"}
    for codec in SINGLE:
        form = read_as("�".encode(), codec)
        if len(form) > 1:
            found.setdefault(form, f"lost>utf-8>{codec}")
    for codec in DOUBLE:
        form = read_as("��".encode(), codec)
        for part in {form, *form.split("�")}:
            if len(part) > 1 and "�" not in part:
                found.setdefault(part[:3], f"lost>utf-8>{codec}")
        for byte in range(0x40, 0xFF):  # the last byte of the one taken together with what stands behind it
            try:
                form = (b"\xef\xbf\xbd" + bytes([byte])).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(form) == 2:
                found.setdefault(form, f"lost>utf-8>{codec}")
    found.setdefault("斤拷", "lost>utf-8>gb18030")
    for c in range(0x80, 0xA0):
        if c != 0x85:
            found.setdefault(chr(c), "lost>latin-1")
    return found
