"""Text functions of cues as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, limits of a line and reading speeds (characters a second).
HAN, HANGUL, HIRAGANA, KATAKANA, ASCII = "[一-鿿]", "[가-힯]", "[぀-ゟ]", "[゠-ヿ]", "[a-zA-Z]"
ZH_PUNCTUATION = "[。！？，：“”（）【】《》]"
JA_PUNCTUATION = "[。！？、：“”（）【】《》〈〉]"
LINE_LIMIT = {"zh": 16, "en": 42, "ko": 16, "ja": 13}
LINE_LIMIT_SDH = {"zh": 18, "ja": 16}
SPEED = {"adult": {"zh": 9.0, "en": 20.0, "ko": 12.0, "ja": 4.0}, "children": {"zh": 7.0, "en": 17.0, "ko": 9.0, "ja": 4.0}}
DEFAULT_LIMIT, DEFAULT_SPEED, SDH_SPEED_JA = 42, 20.0, 7.0
MAX_CPS, MAX_LINE, MAX_LINES, MIN_SECONDS, MAX_SECONDS = 9.0, 16, 2, 0.833, 7.0
SDH_WHOLE = (r"^♪+$", r"^🎵+$", r"^🎶+$", r"^\[\s*.*?\s*\]$", r"^\(\s*.*?\s*\)$", r"^（\s*.*?\s*）$", r"^【\s*.*?\s*】$", r"^《\s*.*?\s*》$", r"^［\s*.*?\s*］$", r"^〔\s*.*?\s*〕$", r"^〈\s*.*?\s*〉$")
SDH_INLINE = (r"\[\s*[^\]]*\s*\]", r"\(\s*[^)]*\s*\)", r"（\s*[^）]*\s*）", r"【\s*[^】]*\s*】", r"《\s*[^》]*\s*》", r"♪+", r"🎵+", r"🎶+", r"［\s*[^］]*\s*］", r"〔\s*[^〕]*\s*〕", r"〈\s*[^〉]*\s*〉", r"「\s*[^」]*\s*」")


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trimmed), lambda x: x != "")


def counts(text: Column) -> dict[str, Column]:
    """Characters by class; total leaves out U+0020 only."""
    one = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "han": one(HAN), "hangul": one(HANGUL), "kana": one(HIRAGANA) + one(KATAKANA), "ascii": one(ASCII),
        "zh_punct": one(ZH_PUNCTUATION), "ja_punct": one(JA_PUNCTUATION), "total": F.length(F.replace(text, F.lit(" "), F.lit(""))),
    }


def scores(n: dict[str, Column]) -> dict[str, Column]:
    """Language scores from (possibly summed) counts; below 0.01 a score is 0."""
    t = F.greatest(n["total"], F.lit(1)).cast("double")
    cjk = n["han"] + n["hangul"] + n["kana"]
    raw = {
        "zh": n["han"] / t * 10 + n["zh_punct"] / t * 2,
        "en": n["ascii"] / t * F.when(cjk / t < 0.1, 10.0).otherwise(2.0),
        "ko": n["hangul"] / t * 10 + n["zh_punct"] / t * 2,
        "ja": (n["kana"] + n["han"] * 0.5) / t * 10 + n["ja_punct"] / t * 2,
    }
    return {k: F.when(v < 0.01, 0.0).otherwise(v) for k, v in raw.items()}


def best(s: dict[str, Column]) -> Column:
    """The highest score; ties go in the order zh, en, ko, ja."""
    top = F.greatest(*s.values())
    out = F.lit("ja")
    for code in ("ko", "en", "zh"):
        out = F.when(s[code] == top, code).otherwise(out)
    return out


def bound(values: dict[str, Column], use: Callable[[dict[str, Column]], Column]) -> Column:
    """use(values) with every value computed once, also within lambdas, which share no subexpressions."""
    one = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.transform(one, lambda s: use({k: s[k] for k in values}))[0]


_PLAIN = r"^[\x00-\x7f]{0,999}\z"


def language(text: Column) -> Column:
    """Language of a line; blank lines count as English, and so do short ASCII lines with a letter."""
    general = bound(counts(text), lambda n: bound(scores(n), best))
    return F.when(text.rlike(_PLAIN) & text.rlike("[a-zA-Z]"), "en").when(trimmed(text) == "", "en").otherwise(general)


def lookup(code: Column, values: dict, default: object) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(code == key, F.lit(value)).otherwise(out)
    return out


def line_limit(code: Column, sdh: bool = False) -> Column:
    """Characters of a line; texts for the hard of hearing have more room in some languages."""
    return lookup(code, LINE_LIMIT | LINE_LIMIT_SDH if sdh else LINE_LIMIT, DEFAULT_LIMIT)


def speed_limit(code: Column, audience: str = "adult", sdh: bool = False) -> Column:
    """Characters a second."""
    return lookup(code, SPEED[audience] | ({"ja": SDH_SPEED_JA} if sdh else {}), DEFAULT_SPEED)


def dialogue(text: Column) -> Column:
    return F.exists(lines(text), lambda x: x.startswith("-"))


_MARKED = r"[♪🎵🎶\[(（【《［〔〈「]"
_DASHES = r"(?m)^\s*-\s*$"
_WHOLE = "|".join(SDH_WHOLE)
_MUSIC = r"♪+|🎵+|🎶+"
_ASIDE = r"\[.*?\]|\(.*?\)|【.*?】|《.*?》"


def suspect(text: Column) -> Column:
    """Holds a sign of a sound description, or a line of nothing but a dash; one look spares the others all patterns."""
    return text.rlike(_MARKED + "|" + _DASHES)


def sdh_only(text: Column) -> Column:
    """Nothing but sound descriptions and music signs."""
    whole = trimmed(text)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, _MUSIC, ""), _ASIDE, "")
    nothing = F.forall(lines(text), lambda x: bare(x).rlike(r"^\s*(?:-\s*)?\z"))
    return F.when(suspect(text), (whole != "") & (whole.rlike(_WHOLE) | nothing)).when(text.isNotNull(), False)


def sdh_strip(parts: Column) -> Column:
    """Lines without their sound descriptions, blanks levelled, a dash and a space before speech; emptied lines go.

    Every step is a transform of its own, so that no line is computed twice.
    """
    def unmarked(line: Column) -> Column:
        out = line
        for pattern in SDH_INLINE:  # one after the other: brackets of one kind may hold half of another
            out = F.regexp_replace(out, pattern, "")
        return F.when(line.rlike(_MARKED), out).otherwise(line)

    level = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    dashed = lambda x: F.when(x.startswith("-"), F.trim(F.regexp_replace(x, r"^-\s*(?:-\s*)?", "- "))).otherwise(x)
    steps = F.transform(F.transform(F.transform(parts, unmarked), level), dashed)
    return F.filter(steps, lambda x: ~x.isin("", "-"))


def _wide_edge(ch: Column) -> Column:
    return ch.rlike("^[一-鿿㐀-䶿가-힯぀-ゟ゠-ヿ。！？，：；'（）【】《》]$") | ch.isin('"')


def flatten(parts: Column) -> Column:
    """Joins lines: no space between two wide characters, else one."""
    join = lambda a, x: F.when(a == "", x).otherwise(
        F.concat(a, F.when(_wide_edge(F.substring(a, -1, 1)) & _wide_edge(F.substring(x, 1, 1)), "").otherwise(" "), x)
    )
    return F.aggregate(parts, F.lit(""), join)


def merge_lines(parts: Column, limit: int, gap: str, endings: str, mixed_dialogue: bool) -> Column:
    """Joins short neighbouring lines up to the limit.

    ``mixed_dialogue`` lets a plain line follow a dialogue line, as in English;
    otherwise both must be of one kind. A new dialogue line never joins.
    """
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, x: Column) -> Column:
        cur, talk = s["cur"], x.startswith("- ")
        fits = F.length(cur) + len(gap) + F.length(x) <= limit
        kinds = ~talk if mixed_dialogue else cur.startswith("- ") == talk
        joins = (cur != "") & ~F.substring(cur, -1, 1).isin(*endings) & fits & kinds
        return F.struct(
            F.when(joins | (cur == ""), s["done"]).otherwise(F.concat(s["done"], F.array(cur))).alias("done"),
            F.when(joins, F.concat(cur, F.lit(gap), x)).otherwise(x).alias("cur"),
        )

    merged = F.aggregate(parts, state, step, lambda s: F.when(s["cur"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))
    return F.when(F.size(parts) > 1, merged).otherwise(parts)


# Spoken fillers, repetitions and what they leave behind, in their order.
FILLERS = ((r"\b[Uu]h\b,?\s*", ""), (r"\b[Uu]m\b,?\s*", ""), (r",?\s*\byou know\b,?\s*", ", "), (r",?\s*\bI mean\b,?\s*", ", "), (r"(?<=,)\s*like,?\s+", " "), (r"\blike like\b", "like"))
REPEATS = ((r"\b(\w)-\s+(?:\w+-\s+)*", ""), (r"(?i)\b(\w+)(\s+\1){2,}\b", "$1"), (r"(?i)\b(\w+\s+\w+)\s+\1\b", "$1"), (r"(?i)\b(\w+)\s+\1\b", "$1"))
LEFTOVERS = ((r"\s*,\s*,\s*", ", "), (r"^\s*,\s*", ""), (r",\s*\.", "."), (r"\s{2,}", " "))


# A line without any of these is fluent as it is; one look spares it the replacements.
_SUSPECT = r"(?i)\b(?:uh|um|you know|i mean|like)\b|(?U)\w-\s|\s{2}|,\s*,|^\s*,|,\s*\.|\b(\w+(?:\s+\w+)?)\s+\1\b"


def fluent(line: Column) -> Column:
    """English without fillers and stutters; lines that are mostly ideographs stay."""
    out = line
    for pattern, to in FILLERS + REPEATS + LEFTOVERS:
        out = F.regexp_replace(out, "(?U)" + pattern, to)
    out = trimmed(out)
    first, was = F.substring(out, 1, 1), F.substring(line, 1, 1)
    lost = first.rlike(r"^\p{Ll}$") & was.rlike(r"^\p{Lu}$")
    out = F.when(lost, F.concat(F.upper(first), F.substring(out, 2, 1 << 30))).otherwise(out)
    wide = F.regexp_count(line, F.lit("[一-鿿぀-ゟ゠-ヿ가-힯]"))
    return F.when(wide > F.length(line) * 0.3, line).when(line.rlike(_SUSPECT), out).otherwise(trimmed(line))
