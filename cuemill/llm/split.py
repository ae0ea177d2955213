"""Cutting oversized texts at natural boundaries by structure-tree packing.

A text is read as a tree: block elements of its markup nest by their paired
tags, sections by the level of their headings, list items by their indent;
below them stand paragraphs, lines, sentences, clauses and words. Whole sibling
subtrees are merged up to the limit, bottom-up; only a node over the limit is
opened, and its pieces end where it ends. A run without any boundary that is
longer than the limit is cut by force.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 200, 20
DEEPEST = 64  # nodes below are read as paragraphs, whatever they hold

# The boundary characters of the task.
BOUNDARY = " \t\n\r 　.,;:!?…。，、；：！？"

_TAG = re.compile(r"<(/?)(?:p|div|section|article|blockquote|pre|ul|ol|li|dl|dt|dd|table|thead|tbody|tr|td|th|h[1-6])\b[^<>]*>", re.I)
_NAME = re.compile(r"\w+")
_BLANK = re.compile(r"\s*")
_HEADING = re.compile(r"^[ \t]*(#{1,6})[ \t]", re.M)
_ITEM = re.compile(r"^([ \t]*)(?:[-*•·+–]|\d{1,3}[.)]|[A-Za-z][.)])[ \t]", re.M)
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")
_LINE = re.compile(r"(?:\r\n|\n|\r|<(?:br|hr)\b[^<>]*>)+", re.I)
_SENTENCE = re.compile(r"[。！？]+[\"'”’»」』）)]*|[.!?…]+[\"'”’»)]*(?=[\s　])")
_CLAUSE = re.compile(r"[,;:，、；：]")
_WORD = re.compile(r"(?:<[^<>]*>|[^ \t\n\r 　<]|<)+[ \t\n\r 　]*")
_ATOM = re.compile(f"[^{re.escape(BOUNDARY)}]+|[{re.escape(BOUNDARY)}]")

Span = tuple[int, int]
Cuts = Callable[[str, int, int], list[int]]


class Elements:
    """The block elements of a text that have a partner, by their start: start, end of the opening tag, start and end of the closing one."""

    def __init__(self, text: str) -> None:
        open_: list[tuple[str, int, int]] = []
        places: dict[str, list[int]] = {}
        found: list[tuple[int, int, int, int]] = []
        for m in _TAG.finditer(text) if "<" in text else ():
            name = _NAME.search(m.group()).group().lower()
            if not m.group(1):
                places.setdefault(name, []).append(len(open_))
                open_.append((name, m.start(), m.end()))
            elif places.get(name):
                at = places[name][-1]
                found.append((open_[at][1], open_[at][2], m.start(), m.end()))
                while len(open_) > at:  # what was opened inside has no partner
                    places[open_.pop()[0]].pop()
        self.text = text
        self.all = sorted(found)
        self.starts = [f[0] for f in self.all]

    def cuts(self, text: str, low: int, high: int) -> list[int]:
        """Borders of the outermost elements of a node; a node's own tags stay with its content."""
        while True:
            found, i = [], bisect_left(self.starts, low)
            while i < len(self.all) and self.all[i][0] < high:
                if self.all[i][3] > high:
                    i += 1
                    continue
                found.append(self.all[i])
                i = bisect_left(self.starts, self.all[i][3], i + 1)
            if len(found) != 1 or not _BLANK.fullmatch(text, low, found[0][0]) or not _BLANK.fullmatch(text, found[0][3], high):
                return [c for f in found for c in (f[0], f[3]) if not _BLANK.fullmatch(text, low, c) and not _BLANK.fullmatch(text, c, high)]
            _, low, high, _ = found[0]


def _ranked(marks: list[tuple[int, int]], low: int) -> list[int]:
    """Places of the marks of the highest rank but the node's own."""
    inner = [(at, rank) for at, rank in marks if at > low]
    top = min((rank for _, rank in inner), default=0)
    return [at for at, rank in inner if rank == top]


def _sections(text: str, low: int, high: int) -> list[int]:
    return _ranked([(m.start(), len(m.group(1))) for m in _HEADING.finditer(text, low, high)], low)


def _items(text: str, low: int, high: int) -> list[int]:
    return _ranked([(m.start(), len(m.group(1).expandtabs(4))) for m in _ITEM.finditer(text, low, high)], low)


def _ends(pattern: re.Pattern) -> Cuts:
    return lambda text, low, high: [m.end() for m in pattern.finditer(text, low, high)]


# What a node is opened by after its elements, in this order; a node of the first kinds may hold others of its kind.
_KINDS: tuple[Cuts, ...] = (_sections, _items, _ends(_PARAGRAPH), _ends(_LINE), _ends(_SENTENCE), _ends(_CLAUSE), _ends(_WORD), _ends(_ATOM))
_NESTED = 3  # elements, sections, items


def children(elements: Elements, span: Span, kind: int, depth: int) -> tuple[list[Span], int]:
    """The child nodes of a node, and the kind their own children begin with; no child is a node without parts."""
    text, (low, high) = elements.text, span
    for k in range(kind, 1 + len(_KINDS)):
        if k < _NESTED and depth > DEEPEST:
            continue
        cuts = sorted({c for c in (_KINDS[k - 1] if k else elements.cuts)(text, low, high) if low < c < high})
        if cuts:
            return list(zip([low, *cuts], [*cuts, high])), k if k < _NESTED else k + 1
    return [], 1 + len(_KINDS)


def _force(text: str, span: Span, room: Callable[[int], int]) -> list[Span]:
    """Cuts a run without boundaries, never before a combining mark if that can be helped."""
    out, at = [], span[0]
    while span[1] - at > room(at):
        cut = at + room(at)
        while cut > at + room(at) // 2 and unicodedata.combining(text[cut]):
            cut -= 1
        out.append((at, cut))
        at = cut
    return [*out, (at, span[1])]


def pack(text: str, limit: int, overlap: int) -> tuple[list[Span], list[int]]:
    """(pieces, places of forced cuts). Every piece but the first leaves room for the overlap."""
    forced: list[int] = []
    elements = Elements(text)
    room = lambda at: limit if at == 0 else limit - overlap
    fits = lambda low, high: high - low <= room(low)

    def opened(span: Span, kind: int, depth: int) -> list[Span]:
        if fits(*span):
            return [span]
        kids, inner = children(elements, span, kind, depth)
        if not kids:
            if span[1] - span[0] <= limit:
                return [span]
            parts = _force(text, span, room)
            forced.extend(p[0] for p in parts[1:])
            return parts
        out: list[Span] = []
        whole = False  # the last piece is made of whole siblings and may take in the next
        for kid in kids:
            if whole and fits(out[-1][0], kid[1]):
                out[-1] = (out[-1][0], kid[1])
                continue
            if whole and inner > _NESTED and not fits(*kid) and _HEADING.match(text, out[-1][0]) and "\n" not in text[out[-1][0] : out[-1][1]].strip():
                kid = (out.pop()[0], kid[1])  # a heading stays with what it heads
            parts = opened(kid, inner, depth + 1)
            out += parts
            whole = len(parts) == 1
        return out

    return opened((0, len(text)), 0, 0), forced


def cut_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(start, core start, end, forced) per piece; piece = text[start:end], cores partition the text.

    ``forced`` tells that the cut before the core is one inside a run that is longer than the limit.
    """
    out: list[tuple[int, int, int, bool]] = []
    pieces, forced = pack(text, limit, overlap)
    for core, end in pieces:
        start = core
        if core:
            least = max(out[-1][1], core - min(overlap, limit - (end - core)))
            start = next((i for i in range(least, core) if i and text[i - 1] in BOUNDARY and text[i] not in BOUNDARY), least)
        at = bisect_left(forced, core)
        out.append((start, core, end, at < len(forced) and forced[at] == core))
    return out


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of at most ``limit`` code points: keys, piece, n_pieces, piece_text, overlap_chars, cut.

    A text within the limit, blank or null is its own single piece with cut
    null. Repeated rows give one set of pieces. cut is 'forced' for every piece
    of a text that had to be cut inside a run without boundaries, else
    'natural'. Columns other than keys and text are left out.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below limit")
    rows = df.select(*keys, F.col(text).alias("piece_text")).distinct()
    long = F.coalesce(F.char_length("piece_text") > limit, F.lit(False))
    whole = rows.where(~long).select(
        *keys, F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), "piece_text", F.lit(0).alias("overlap_chars"), F.lit(None).cast("string").alias("cut")
    )
    piece = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("piece_text", T.StringType()), T.StructField("overlap_chars", T.IntegerType()), T.StructField("forced", T.BooleanType())]))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("pieces", piece)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(pa.struct([("piece", pa.int32()), ("piece_text", pa.string()), ("overlap_chars", pa.int32()), ("forced", pa.bool_())]))
        for batch in batches:
            made = [
                [{"piece": n, "piece_text": t[s:e], "overlap_chars": c - s, "forced": f} for n, (s, c, e, f) in enumerate(cut_text(t, limit, overlap))]
                for t in batch.column(len(keys)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, arrow)], names=[*keys, "pieces"])

    pieces = (
        rows.where(long)
        .mapInArrow(cut, schema)
        .withColumn("cut", F.when(F.exists("pieces", lambda p: p["forced"]), "forced").otherwise("natural"))
        .withColumn("n_pieces", F.size("pieces"))
        .select(*keys, "n_pieces", "cut", F.inline("pieces"))
        .select(*keys, "piece", "n_pieces", "piece_text", "overlap_chars", "cut")
    )
    return whole.unionByName(pieces)
