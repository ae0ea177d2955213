"""Line wrapping by language and splitting of overlong cues along the timeline.

Wrapping looks back from the limit for the best place to cut, which depends on
the text before it; that is the one part that runs in Python, in Arrow batches.
What a language prefers is a table of (what to look for, where to cut), not code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions import text as fx
from cuemill.operators.cues import merge_fragments

# Words and marks that lines may be cut at, and endings that go on.
ZH_HELPERS = ("的", "地", "得", "了", "吧", "呢", "啊", "哦", "嗯", "呀", "哇", "吗", "嘛")
WIDE_MARKS = "。！？，：；“”''（）【】《》"
KO_PARTICLES = ("은", "는", "이", "가", "을", "를", "에", "에서", "로", "으로", "와", "과", "의", "도", "만", "까지", "부터", "보다", "처럼", "다", "요", "죠", "네", "지", "니", "까", "야", "아", "어", "고", "서", "면", "려고", "하고", "때문에", "가지고")
EN_CONJUNCTIONS = ("and", "but", "or", "nor", "for", "so", "yet", "because", "since", "although", "though", "while", "whereas", "however", "therefore", "moreover", "furthermore", "nevertheless", "nonetheless")
EN_PREPOSITIONS = ("in", "on", "at", "by", "for", "with", "from", "to", "of", "about", "under", "over", "through", "between", "among", "during", "before", "after", "above", "below", "across", "around", "behind", "beside")
ZH_OPEN_WORDS = ("，", "、", "和", "或", "但", "而", "因为", "所以", "如果", "那么")
KO_OPEN_ENDINGS = ("고", "서", "면", "며", "는데", "지만", "하고", "가지고", "때문에", "하면서", "다가", "으면서", "으니까", "니까", "하여", "해서", "에서", "으로", "로", "와", "과")
GAP_US, LEAST_PIECE_US, SPLIT_SPEED = 40_000, 200_000, 1.5

Cut = Callable[[str, int], int]  # the cut that position i allows, or -1


def _after(marks: tuple[str, ...] | str, width: int = 1) -> Cut:
    return lambda line, i: i + width if line[i : i + width] in marks and len(line[i : i + width]) == width else -1


def _before_space(line: str, i: int) -> int:
    return i if line[i] == " " else -1


class Rule(NamedTuple):
    back: int  # how far before the limit a cut may lie
    ahead: int  # how far behind it the search starts
    cuts: tuple[Cut, ...]
    least_over: int  # lines over by less stay whole
    least_tail: int  # no tail shorter than this


RULES = {
    "zh": Rule(10, 3, (_after(ZH_HELPERS), _after(WIDE_MARKS), _before_space), 3, 5),
    "ko": Rule(8, 3, (_before_space, _after(KO_PARTICLES, 2), _after(KO_PARTICLES), _after(WIDE_MARKS)), 3, 4),
    "en": Rule(20, 0, (_after(".,!?;:"),), 1, 20),
}


def find_cut(line: str, limit: int, code: str) -> int:
    """The preferred cut, the rightmost of the best kind; -1 if there is none."""
    rule = RULES[code]
    low, high = max(0, limit - rule.back), min(len(line), limit + rule.ahead)
    for cut in rule.cuts:
        for i in range(high - 1, low - 1, -1):
            at = cut(line, i)
            if 0 <= at <= limit:
                return at
    if code == "en":
        starts = [(m.start(), m.group()) for m in re.finditer(r"\b\w+\b", line.lower()) if low <= m.start() <= high]
        for group in (EN_CONJUNCTIONS, EN_PREPOSITIONS):
            hits = [at for at, word in starts if word in group]
            if hits:
                return hits[-1]
    return -1


def break_line(line: str, limit: int, code: str) -> list[str]:
    """Cuts a line until the rest fits or no cut leaves a decent rest."""
    rule, out = RULES[code], []
    while len(line) > limit and len(line) - limit >= rule.least_over:
        at = find_cut(line, limit, code)
        if code == "en":
            rest = line[at:].strip()
            if at <= 0 or len(line[limit:].split()) < 4 or len(rest) < rule.least_tail or len(rest.split()) < 3:
                break
        at = limit if at == -1 else at
        head, tail = line[:at].rstrip(), line[at:].lstrip()
        if len(tail) < rule.least_tail or len(tail) >= len(line):
            break
        out.append(head)
        line = tail
    return [*out, line]


def join_lines(lines: list[str], limit: int, code: str) -> list[str]:
    """Joins neighbours that fit into one line and belong together."""
    gap, ends = ("", "。！？") if code == "zh" else (" ", "。！？" if code == "ko" else ".!?")
    out: list[str] = []
    for line in lines:
        if out and out[-1][-1] not in ends and len(out[-1]) + len(gap) + len(line) <= limit:
            talk, new = out[-1].startswith("- "), line.startswith("- ")
            if not new if code == "en" else talk == new:
                out[-1] += gap + line
                continue
        out.append(line)
    return out


def pair_short(lines: list[str], limit: int) -> list[str]:
    """English: a short line takes the next one in, once, if both fit."""
    out, i = [], 0
    while i < len(lines):
        pair = [x.strip() for x in lines[i : i + 2]]
        if len(pair) == 2 and all(pair) and (len(pair[1]) < 20 or len(pair[0]) < 25) and not pair[1].startswith("- "):
            made = f"- {pair[0][2:].strip()} {pair[1]}" if pair[0].startswith("- ") else " ".join(pair)
            if len(made) <= limit:
                out.append(made)
                i += 2
                continue
        out.append(lines[i])
        i += 1
    return out


def end_mark(lines: list[str], code: str) -> list[str]:
    """Adds a full stop to a last line that neither ends nor goes on."""
    last = lines[-1].strip() if lines else ""
    if not last or last[-1] in WIDE_MARKS or last.endswith("...") or last.startswith("♪"):
        return lines
    if code == "zh":
        goes_on = last[-1] in "，、" or last.split()[-1] in ZH_OPEN_WORDS or len(last) < 8
        return lines if goes_on else [*lines[:-1], last + "。"]
    return lines if last.endswith(KO_OPEN_ENDINGS) or len(last) < 6 else [*lines[:-1], last + "."]


def wrap(lines: list[str], code: str, limit: int, marks: bool) -> list[str]:
    """The lines of one cue by the rules of its language; languages without rules stay as they are."""
    if code not in RULES:
        return lines
    tidy = [re.sub(r"^-\s*(.*)$", lambda m: "- " + m.group(1).strip(), x.strip()) for x in lines if x.strip()]
    if len(tidy) > 1:
        tidy = join_lines(tidy, limit, code)
    tidy = [piece for line in tidy for piece in break_line(line, limit, code)]
    if code == "en":
        return pair_short(tidy, limit)
    return end_mark(tidy, code) if marks else tidy


def cut_hard(text: str, limit: int) -> list[str]:
    """Lines within the limit at any price: at the last space near it, else right there."""
    out = []
    while len(text) > limit:
        at = text.rfind(" ", max(0, limit - 20), limit)
        at = at if at > 0 else limit
        out.append(text[:at].rstrip())
        text = text[at:].lstrip()
    return [*out, text.strip()] if text.strip() else out


def lines_within(text: str, code: str, limit: int, wrap_limit: int, marks: bool) -> list[str]:
    if len(text) <= limit:
        return [text]
    made = [x for x in wrap([text], code, wrap_limit, marks) if x.strip()] if code in RULES else [text]
    return [piece for line in made for piece in ([line] if len(line) <= limit else cut_hard(line, limit))] or [text]


def allot(sizes: list[int], start: int, end: int) -> list[tuple[int, int]]:
    """Shares a stretch of microseconds by size, with gaps and a least length, inside the stretch."""
    n, span = len(sizes), end - start
    if n <= 1:
        return [(start, end)]
    gap = GAP_US
    if gap * (n - 1) >= span * 0.5:
        gap = 1000 * max(10, int(span / 1e6 * 500 / (n - 1)))
    usable = span - gap * (n - 1)
    if usable <= 0:
        usable, gap = span, 0
    total, at, out = sum(sizes) or 1, start, []
    for size in sizes:
        stop = min(at + max(LEAST_PIECE_US, round(usable * (size / total))), end)
        out.append((at, stop))
        at = min(stop + gap, end)
    return out


def _flat(lines: list[str]) -> str:
    out = ""
    wide = re.compile("[一-鿿㐀-䶿가-힯぀-ゟ゠-ヿ。！？，：；'\"（）【】《》]")
    for line in (x.strip() for x in lines):
        if line:
            out += ("" if not out or (wide.match(out[-1]) and wide.match(line[0])) else " ") + line
    return out


def split_pieces(lines: list[str], codes: list[str], code: str, wrap_limit: int, marks: bool) -> list[list[str]]:
    """Groups of lines for the pieces of a cue: two lines each, or one of either language in bilingual cues."""
    limit_of = lambda c: fx.LINE_LIMIT.get(c, fx.DEFAULT_LIMIT)
    if len(set(codes)) > 1:
        first = codes[0]
        second = next(c for c in codes if c != first)
        sides = []
        for c, side in ((first, [x for x, k in zip(lines, codes) if k == first]), (second, [x for x, k in zip(lines, codes) if k != first])):
            sides.append(lines_within((" " if c == "en" else "").join(side), c, limit_of(c), wrap_limit, marks))
        return [[s[i] for s in sides if i < len(s)] for i in range(max(map(len, sides)))]
    limit = limit_of(code) if wrap_limit != fx.DEFAULT_LIMIT else fx.DEFAULT_LIMIT if code == "en" else limit_of(code)
    made = lines_within(_flat(lines), code, limit, wrap_limit, marks)
    return [made[i : i + 2] for i in range(0, len(made), 2)]


_OUT = "episode_id string, id int, pos int, is_split boolean, start_ms bigint, end_ms bigint, text string"


def wrap_and_split(cues: DataFrame, mode: str = "stage_a", split: bool = True, gate: str = "on") -> DataFrame:
    """Wraps every cue and splits the overlong ones; (episode_id, id, is_split, start_ms, end_ms, text).

    In mode stage_a every cue counts as English with a limit of 42 and no marks
    are added; in mode full the episode's language sets the limit and the cue's
    own language the rules. Cues without readable times are wrapped, not split.
    With gate auto, episodes without a line or cue too long stay as they are.
    """
    base = cues.withColumn("__lines", fx.lines(F.col("text")))
    base = base.withColumn("__codes", F.transform("__lines", fx.language))
    if gate == "auto":
        long = (F.size("__lines") > fx.MAX_LINES) | F.exists("__lines", lambda x: F.length(x) > fx.DEFAULT_LIMIT)
        base = base.withColumn("__gate", F.max(long).over(Window.partitionBy("episode_id")))
    else:
        base = base.withColumn("__gate", F.lit(True))
    if mode == "full":
        n = fx.counts(F.coalesce("text", F.lit("")))
        whole = Window.partitionBy("episode_id")
        base = base.withColumns({f"__{k}": F.sum(c).over(whole) for k, c in n.items()})
        base = base.withColumn("__doc", F.when(F.col("__total") == 0, "en").otherwise(fx.best(fx.scores({k: F.col(f"__{k}") for k in n})))).withColumn("__own", fx.language(F.coalesce("text", F.lit(""))))
    else:
        base = base.withColumn("__doc", F.lit("auto")).withColumn("__own", F.lit("en"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ep, id_, start, end, lines, codes, own, doc, gated, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(ep, id_, *r) for r in (_one(lines, codes, own, doc, start, end, mode == "full", split) if gated else [(0, False, start, end, text)])]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
            names = ("episode_id", "id", "pos", "is_split", "start_ms", "end_ms", "text")
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    made = base.select("episode_id", "id", "start_ms", "end_ms", "__lines", "__codes", "__own", "__doc", "__gate", F.when(~F.col("__gate"), F.col("text")).alias("__text")).mapInArrow(run, _OUT)
    order = Window.partitionBy("episode_id").orderBy("id", "pos")
    pieces = made.withColumn("id", (F.row_number().over(order) - 1).cast("int")).select("episode_id", "id", "is_split", "start_ms", "end_ms", "text")
    if not split:
        return pieces
    return merge_fragments(pieces).select("episode_id", "id", "is_split", "start_ms", "end_ms", "text")


def _one(lines: list[str], codes: list[str], own: str, doc: str, start: int | None, end: int | None, marks: bool, split: bool) -> list[tuple]:
    limit = fx.LINE_LIMIT.get(doc, fx.DEFAULT_LIMIT)
    if len(set(codes)) > 1:
        made, at = [], 0
        while at < len(lines):
            stop = at
            while stop < len(lines) and codes[stop] == codes[at]:
                stop += 1
            made += wrap(lines[at:stop], codes[at], fx.LINE_LIMIT.get(codes[at], fx.DEFAULT_LIMIT), marks)
            at = stop
    else:
        made = wrap(lines, own, limit, marks)
    whole = [(0, False, start, end, "\n".join(made))]
    if not split or start is None or end is None:
        return whole
    by_line = codes if len(codes) == len(made) else [codes[0] if codes else own] * len(made)
    seconds = (end - start) / 1000
    speed = sum(map(len, made)) / seconds if seconds > 0 else 0
    top = fx.SPEED["adult"].get(own if marks else "auto", fx.DEFAULT_SPEED)
    if not (len(made) > 2 or any(len(x) > fx.LINE_LIMIT.get(c, fx.DEFAULT_LIMIT) for x, c in zip(made, by_line)) or speed > top):
        return whole
    groups = split_pieces(made, by_line, own, limit, marks)
    if len(groups) <= 1:
        return [(0, False, start, end, "\n".join(groups[0] if groups else made))]
    times = allot([sum(map(len, g)) for g in groups], start * 1000, end * 1000)
    return [(i, True, s // 1000, e // 1000, "\n".join(g)) for i, (g, (s, e)) in enumerate(zip(groups, times))]


def compliance(cues: DataFrame) -> DataFrame:
    """Cues without a warning about line lengths or speed, per episode; split cues may be half as fast again."""
    parts = fx.lines(F.col("text"))
    long = F.exists(parts, lambda x: F.length(x) > fx.line_limit(fx.language(x)))
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    chars = F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
    fast = F.coalesce((seconds > 0) & (chars / seconds > fx.DEFAULT_SPEED * F.when(F.col("is_split"), SPLIT_SPEED).otherwise(1.0)), F.lit(False))
    out = cues.withColumn("warn", long | fast).groupBy("episode_id").agg(F.count("*").alias("total"), F.count_if(~F.col("warn")).alias("compliant"))
    return out.withColumn("rate", F.round(F.col("compliant") / F.col("total") * 100, 4))
