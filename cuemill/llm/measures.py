"""Statistics of many texts at once, by arrays over the characters of all of them.

The texts are laid one after the other; every count is an aggregate of a mask
over characters, runs or lines, so that Python does a fixed number of steps for
a batch, not for a text. Words are told by a 64-bit hash of their lower-case
letters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

SPACE, NEWLINE, LETTER, HANGUL, IDEOGRAPH, DIGIT, BROKEN, OTHER = range(8)
_LAST = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
GRAM, ENOUGH_GRAMS = 8, 4000

# Signs by what they do in a line.
STOPS, WIDE_STOPS = ".!?…", "。！？"
CLOSERS = "\"'”’»)]"
BULLETS = "-–—*•·+"
SEPARATORS = ",;，、；•·|\t"
MOJIBAKE_HEADS = "ÃÂÐÑ" + "".join(map(chr, range(0xE2, 0xF0)))
MOJIBAKE_TAILS = "".join(map(chr, range(0x80, 0xC0))) + "ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"


@lru_cache(maxsize=None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of every code point."""
    kind = np.full(_LAST, OTHER, np.uint8)
    lower = np.arange(_LAST, dtype=np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        category = unicodedata.category(ch)
        if ch == "\n":
            kind[c] = NEWLINE
        elif ch.isspace():
            kind[c] = SPACE
        elif 0xAC00 <= c <= 0xD7A3:
            kind[c] = HANGUL
        elif 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or c == 0x3005 or c >= 0x20000:
            kind[c] = IDEOGRAPH
        elif category[0] in "LM":
            kind[c] = LETTER
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif ch.isdigit():
            kind[c] = DIGIT
        elif category in ("Cc", "Co", "Cn", "Cs") or ch in "�■" or 0x25A0 <= c <= 0x25FF:
            kind[c] = BROKEN
    return kind, lower


@lru_cache(maxsize=None)
def _set(chars: str) -> np.ndarray:
    found = np.zeros(_LAST, bool)
    found[[ord(c) for c in chars]] = True
    return found


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretches of an array of code points, from one pass over it."""

    def __init__(self, codes: np.ndarray) -> None:
        up, self.down = _power(len(codes))
        spread = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * up[: len(codes)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of a mask."""
    padded = np.zeros(len(mask) + 2, np.int8)
    padded[1:-1] = mask
    turn = np.diff(padded)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hash(word: str) -> int:
    """The hash under which a word is counted."""
    codes = _tables()[1][[ord(c) for c in word]]
    return int(Hashes(codes).of(np.array([0]), np.array([len(codes)]))[0].astype(np.int64))


class Texts:
    """A batch of texts laid out as characters, lines, blocks (parted by blank lines) and documents."""

    def __init__(self, texts: list[str]) -> None:
        tidy = [t.replace("\r\n", "\n").replace("\r", "\n") if "\r" in t else t for t in texts]
        self.n = len(tidy)
        whole = "\n\n".join(tidy) + "\n"
        self.code = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        kinds, lower = _tables()
        self.kind = kinds[self.code]
        self.low = lower[self.code]
        newline = self.kind == NEWLINE
        self.line = np.cumsum(newline) - newline
        self.n_lines = int(newline.sum())
        starts = np.concatenate([[0], np.cumsum([len(t) + 2 for t in tidy])[:-1]]) if self.n else np.zeros(0, int)
        line_starts = np.concatenate([[0], np.flatnonzero(newline)[:-1] + 1])
        self.doc_of_line = np.searchsorted(starts, line_starts, side="right") - 1
        self.solid = self.kind > NEWLINE
        self.full = self.per_line(self.solid) > 0
        first = self.full.copy()
        first[1:] &= ~self.full[:-1] | (self.doc_of_line[1:] != self.doc_of_line[:-1])
        self.block_of_line = np.where(self.full, np.cumsum(first) - 1, -1)
        self.n_blocks = int(first.sum())
        self.doc_of_block = self.doc_of_line[first]
        self.hashes = Hashes(self.low)

    def per_line(self, mask: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        at = np.flatnonzero(mask)
        return np.bincount(self.line[at], None if weight is None else weight[at], self.n_lines)

    def at_lines(self, places: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.line[places], weight, self.n_lines)

    def per_block(self, line_values: np.ndarray) -> np.ndarray:
        return np.bincount(self.block_of_line[self.full], line_values[self.full], self.n_blocks)

    def per_doc(self, line_values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc_of_line, line_values, self.n)

    def ends(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the mask in every line, -1 where there is none."""
        at = np.flatnonzero(mask)
        first, last = np.full(self.n_lines, -1), np.full(self.n_lines, -1)
        line = self.line[at]
        if len(at):
            turn = np.flatnonzero(line[1:] != line[:-1])
            head, tail = np.concatenate([[0], turn + 1]), np.concatenate([turn, [len(at) - 1]])
            first[line[head]], last[line[tail]] = at[head], at[tail]
        return first, last

    def words(self, outside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, hash) of the words: runs of three letters or more, of Hangul (told by two syllables), single ideographs."""
        letter = (self.kind == LETTER) | (self.kind == HANGUL)
        single = self.kind == IDEOGRAPH
        if outside is not None:
            letter, single = letter & outside, single & outside
        start, end = _edges(letter)
        korean = self.kind[start] == HANGUL
        keep = (end - start > 2) | korean
        start, end, korean = start[keep], end[keep], korean[keep]
        stem = np.where(korean, np.minimum(end, start + 2), end)  # what follows two syllables is mostly an ending
        alone = np.flatnonzero(single)
        place = np.concatenate([start, alone])
        return place, np.concatenate([end, alone + 1]) - place, self.hashes.of(place, np.concatenate([stem, alone + 1]))


def document_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, number of the text): every word of every text once."""
    t = Texts(texts)
    place, _, found = t.words(~_tags(t))
    doc = t.doc_of_line[t.line[place]]
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new].astype(np.int64), doc[new]


def _tags(t: Texts) -> np.ndarray:
    """Characters inside tags and entities."""
    inside = np.zeros(len(t.code) + 1, np.int32)
    for head, tail, longest in (("<", ">", 400), ("&", ";", 10)):
        opens = np.flatnonzero(t.code == ord(head))
        if not len(opens):
            continue
        closes = np.flatnonzero(t.code == ord(tail))
        if not len(closes):
            continue
        after = np.append(t.kind, OTHER)[opens + 1] == LETTER
        if head == "<":
            after |= np.append(t.code, 0)[opens + 1] == ord("/")
        nxt = np.searchsorted(closes, opens)
        end = np.append(closes, 1 << 40)[nxt]
        other = np.append(opens[1:], 1 << 40)
        ok = after & (end - opens <= longest) & (end < other)
        np.add.at(inside, opens[ok], 1)
        np.add.at(inside, end[ok] + 1, -1)
    return np.cumsum(inside)[:-1] > 0


def _regular(t: Texts, count: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """(most common number of fields of a block's lines, share of the lines that have it)."""
    lines = np.flatnonzero(t.full)
    block, fields = t.block_of_line[lines], count[lines].astype(np.int64)
    n_lines = np.bincount(block, minlength=t.n_blocks)
    many = fields > 1
    block, fields = block[many], fields[many]
    width, share = np.ones(t.n_blocks, np.int64), np.zeros(t.n_blocks)
    if not len(block):
        return width, share
    key, n = np.unique(block * 100_000 + np.minimum(fields, 99_999), return_counts=True)
    b, w = key // 100_000, key % 100_000
    order = np.lexsort((-w, n, b))
    last = np.flatnonzero(np.append(b[order][1:] != b[order][:-1], True))
    best = order[last]
    width[b[best]], share[b[best]] = w[best], n[best]
    if near:  # an empty last field may be left out
        share = np.bincount(block, np.abs(fields - width[block]) < 2, t.n_blocks)
    return width, share / np.maximum(n_lines, 1)


def _distinct_grams(t: Texts, group_of_line: np.ndarray, n: int) -> np.ndarray:
    """Different grams of a group's text without white space, as a share of all or of ENOUGH_GRAMS; 1 for short ones.

    Long texts repeat themselves without being repetitions: what counts is that
    there are few different grams.
    """
    at = np.flatnonzero(t.solid & (group_of_line[t.line] >= 0))
    group = group_of_line[t.line[at]]
    start = np.flatnonzero(group[: -GRAM + 1] == group[GRAM - 1 :]) if len(at) >= GRAM else np.zeros(0, np.int64)
    total = np.bincount(group[start], minlength=n)
    if not len(start):
        return np.ones(n)
    found = Hashes(t.code[at]).of(start, start + GRAM) + group[start].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    order = np.argsort(found)
    new = np.ones(len(order), bool)
    new[1:] = found[order][1:] != found[order][:-1]
    different = np.bincount(group[start][order[new]], minlength=n)
    return np.where(total > 16, np.minimum(different / np.clip(total, 1, ENOUGH_GRAMS), 1.0), 1.0)


def measure(texts: list[str], common: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(statistics of the documents, statistics of their blocks); ``common`` holds the sorted hashes of common words."""
    t = Texts(texts)
    code, kind, line = t.code, t.kind, t.line
    is_ = lambda chars: _set(chars)[code]
    after = np.append(kind[1:], NEWLINE)
    next_code = np.append(code[1:], 10)
    blank_after = after <= NEWLINE
    tag = _tags(t)
    wide = (kind == LETTER) | (kind == HANGUL) | (kind == IDEOGRAPH)

    dense, letters, digits = t.per_line(t.solid), t.per_line(wide), t.per_line(kind == DIGIT)
    token = t.solid.copy()
    token[1:] &= ~t.solid[:-1]
    tokens = t.per_line(token)
    first, last = t.ends(t.solid)
    _, body = t.ends(t.solid & ~is_(CLOSERS))
    stops = is_(STOPS) | is_(WIDE_STOPS)
    stopped = (body >= 0) & stops[body]
    place, length, found = t.words(~tag)
    known = np.zeros(len(found), bool)
    if len(common):
        known = common[np.minimum(np.searchsorted(common, found.view(np.int64)), len(common) - 1)] == found.view(np.int64)
    n_words, n_known, in_words = t.at_lines(place), t.at_lines(place, known), t.at_lines(place, length)

    docs: dict[str, np.ndarray] = {}
    n_tokens, n_dense = t.per_doc(tokens), t.per_doc(dense)
    full_lines = t.per_doc(t.full)
    docs["n_words"] = n_tokens
    docs["n_lines"] = full_lines
    docs["mean_word_length"] = n_dense / np.maximum(n_tokens, 1)
    docs["symbol_ratio"] = np.where(n_dense > 0, 1 - (t.per_doc(letters) + t.per_doc(digits)) / np.maximum(n_dense, 1), 0.0)
    docs["end_punctuation"] = t.per_doc(stopped & t.full) / np.maximum(full_lines, 1)
    docs["common_words"] = t.per_doc(n_known) / np.maximum(t.per_doc(n_words), 1)

    # Length in words: two syllables or ideographs count about as a word.
    starts, _ = _edges((kind == LETTER) & ~tag)
    units = t.at_lines(starts) + 0.55 * t.per_line((kind == IDEOGRAPH) & ~tag) + 0.5 * t.per_line((kind == HANGUL) & ~tag)
    head = np.maximum(first, 0)
    look = lambda k: np.append(code, [10] * 8)[head + k]
    bullet = _set(BULLETS)[look(0)] & (_tables()[0][look(1)] == SPACE)
    for k in range(1, 5):  # 12. or 3) or a)
        numbered = np.logical_and.reduce([_tables()[0][look(i)] == DIGIT for i in range(k)])
        if k == 1:
            numbered |= (look(0) < 128) & (_tables()[0][look(0)] == LETTER)
        bullet |= numbered & _set(".)")[look(k)] & (_tables()[0][look(k + 1)] == SPACE)
    bullet |= (look(0) == ord("[")) & ((look(1) == ord("]")) | (look(2) == ord("]")))
    bullet &= first >= 0

    places = np.arange(len(code))
    inside_line = (places > first[line]) & (places < last[line])  # between the first and the last sign of its line
    tabs = t.per_line((code == 9) & inside_line)
    pipes = t.per_line(code == ord("|"))
    edge_pipes = (code[head] == ord("|")).astype(int) + (code[np.maximum(last, 0)] == ord("|"))
    gap_start, gap_end = _edges((kind == SPACE) & (code != 9) & inside_line)
    gap = gap_end - gap_start
    wide_gaps = t.at_lines(gap_start[gap > 1])
    aligned = t.at_lines(gap_start[gap > 2]) > 0
    commas, semicolons = (t.per_line((code == ord(mark)) & (after != SPACE)) for mark in ",;")
    dash = np.zeros(len(code), bool)
    dash[1:] = _set("-–—")[code[1:]] & (kind[:-1] == SPACE) & (after[1:] == SPACE)
    dash &= inside_line
    colon = (code == ord(":")) & (after == SPACE)
    comma = (code == ord(",")) & (after == SPACE)
    pair_marks = t.per_line((dash | colon | comma) & inside_line)
    # What stands before the only separator of a line, and behind it, in tokens.
    sep_first, _ = t.ends((dash | colon | comma) & inside_line)
    upto = np.cumsum(token)
    left = upto[np.maximum(sep_first, 0)] - upto[head] + 1 - (dash[np.maximum(sep_first, 0)]) - bullet
    right = upto[np.maximum(last, 0)] - upto[np.maximum(sep_first, 0)]
    other_marks = t.per_line((is_(",:.!?;") & ~(comma | colon)) & inside_line)
    pair = (pair_marks == 1) & (left >= 1) & (left <= 4) & (right >= 1) & (right <= 4) & ((other_marks == 0) | (bullet & (other_marks == 1)))
    inline_bullet = t.at_lines(np.flatnonzero((is_(",;") & (after == SPACE))[:-2] & _set("•·*")[code[2:]]))
    items = t.per_line((is_(SEPARATORS) & inside_line) | dash)
    hexed = t.per_line(t.solid & ~_set("0123456789abcdefABCDEF")[code]) == 0
    hexed &= (tokens > 1) & t.full
    plain_token = t.solid & (_set("+/=_-")[code] | ((code < 128) & (wide | (kind == DIGIT))))
    blob_start, blob_end = _edges(plain_token)
    long = blob_end - blob_start >= 24
    blob = t.at_lines(blob_start[long], (blob_end - blob_start)[long])
    broken = t.per_line((kind == BROKEN) & (code != 9))
    garbled = 2 * t.per_line(_set(MOJIBAKE_HEADS)[code] & _set(MOJIBAKE_TAILS)[next_code])
    tagged = t.per_line(tag)
    braces = t.per_line(is_("{}")) > 0
    markup = ((tagged > 0) | braces | (code[np.maximum(last, 0)] == ord(";"))) & (n_words < 3) & t.full
    sentence_ends = t.per_line((is_(STOPS) & (blank_after | _set(CLOSERS)[next_code]) & ~_set(STOPS)[next_code]) | (is_(WIDE_STOPS) & ~_set(WIDE_STOPS)[next_code]))
    sentences = sentence_ends + ~stopped

    b: dict[str, np.ndarray] = {"doc": t.doc_of_block}
    n = np.maximum(t.per_block(np.ones(t.n_lines)), 1)
    chars = np.maximum(t.per_block(dense), 1)
    share = lambda flag: t.per_block(flag.astype(float)) / n
    total_units = t.per_block(units)
    b["chars"] = t.per_block(dense)
    b["n_lines"] = n
    b["symbol_ratio"] = 1 - (t.per_block(letters) + t.per_block(digits)) / chars
    b["digit_ratio"] = t.per_block(digits) / chars
    b["end_punctuation"] = share(stopped)
    b["common_words"] = t.per_block(n_known) / np.maximum(t.per_block(n_words), 1)
    b["letters_in_words"] = np.minimum(1.0, t.per_block(in_words) / chars)
    b["bullets"] = share(bullet)
    b["inline_bullets"] = t.per_block(inline_bullet)
    b["pairs"] = np.where(n > 1, share(pair), 0.0)
    b["units_per_line"] = total_units / n
    b["longest_line"] = np.zeros(t.n_blocks)
    np.maximum.at(b["longest_line"], t.block_of_line[t.full], units[t.full])
    b["units_per_sentence"] = total_units / np.maximum(t.per_block(sentences), 1)
    b["items"] = t.per_block(items) + n
    b["units_per_item"] = total_units / b["items"]
    b["pipes"] = share((pipes > 1) | ((look(0) == ord("+")) & (look(1) == ord("-"))))
    b["tabs"] = share(tabs > 0)
    b["aligned"] = share(aligned)
    b["markup"] = share(markup)
    b["tagged"] = t.per_block(tagged) / np.maximum(t.per_block(t.per_line(tag | t.solid)), 1)
    b["hex"] = share(hexed)
    b["broken"] = t.per_block(broken) / chars
    b["mojibake"] = t.per_block(garbled) / chars
    b["blob"] = t.per_block(blob) / chars
    width, regular = np.ones(t.n_blocks, np.int64), np.zeros(t.n_blocks)
    for count, near in ((tabs + 1, True), (pipes - edge_pipes + 1, False), (wide_gaps + 1, True), (semicolons + 1, False), (commas + 1, False)):
        w, r = _regular(t, np.maximum(count, 1), near)
        better = (r > regular) | ((r == regular) & (w > width))
        width, regular = np.where(better, w, width), np.where(better, r, regular)
    flat = (n < 2) | (regular < 0.6) | (b["symbol_ratio"] > 0.9)
    b["fields"], b["regular_fields"] = np.where(flat, 1, width), regular
    b["distinct_grams"] = _distinct_grams(t, t.block_of_line, t.n_blocks)
    several = np.bincount(t.doc_of_block, minlength=t.n) > 1
    of_doc = _distinct_grams(t, np.where(t.full & several[t.doc_of_line], t.doc_of_line, -1), t.n)
    b["distinct_grams_of_document"] = np.where(several[t.doc_of_block], of_doc[t.doc_of_block], b["distinct_grams"])
    return docs, b
