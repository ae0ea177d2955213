"""Time codes as Column expressions; times are BIGINT milliseconds."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks that str.strip() removes: Unicode white space plus the four separators.
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_LENIENT = r"(?U)^\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}\z"
_COMMON = r"^[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}\z"
_STRICT = r"^[0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}\z"


def _decimal_digits() -> tuple[str, str]:
    """All Unicode decimal digits but the ASCII ones, and their values."""
    chars = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.digit(c)) for c in chars)


_DIGITS, _VALUES = _decimal_digits()


def strip(col: Column) -> Column:
    return F.regexp_replace(col, _STRIP, "")


def _to_ms(text: Column) -> Column:
    parts = F.split(text, "[:,.]")
    return (
        (parts[0].cast("bigint") * 3600 + parts[1].cast("bigint") * 60 + parts[2].cast("bigint")) * 1000
        + F.rpad(parts[3], 3, "0").cast("bigint")
    )


def _fixed_ms(col: Column) -> Column:
    """HH:MM:SS,mmm at fixed places."""
    part = lambda at, n: F.substring(col, at, n).cast("bigint")
    return ((part(1, 2) * 60 + part(4, 2)) * 60 + part(7, 2)) * 1000 + part(10, 3)


def lenient_ms(col: Column) -> Column:
    """1-2 digit hours, comma or point, 1-3 digit fraction padded right; null when unreadable.

    The common spelling takes a short way, without stripping or splitting.
    """
    text = strip(col)
    ascii_text = F.when(text.rlike(r"^\p{ASCII}*\z"), text).otherwise(F.translate(text, _DIGITS, _VALUES))
    return F.when(col.rlike(_COMMON), _fixed_ms(col)).when(text.rlike(_LENIENT), _to_ms(ascii_text))


def strict_ms(col: Column) -> Column:
    """Exactly HH:MM:SS,mmm; null otherwise."""
    return F.when(col.rlike(_STRICT), _fixed_ms(col))


def format_ms(ms: Column) -> Column:
    """BIGINT milliseconds to HH:MM:SS,mmm, truncating; null stays null."""
    text = F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    return F.when(ms.isNotNull(), text)
