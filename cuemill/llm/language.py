"""Language of short texts, learned from labelled ones."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

# Names of languages as instructions spell them.
NAMES = {
    "english": "en", "french": "fr", "german": "de", "spanish": "es", "russian": "ru", "japanese": "ja", "korean": "ko", "chinese": "zh", "italian": "it", "portuguese": "pt", "dutch": "nl", "polish": "pl",
    "turkish": "tr", "arabic": "ar", "hebrew": "he", "greek": "el", "hindi": "hi", "thai": "th", "vietnamese": "vi", "ukrainian": "uk", "czech": "cs", "swedish": "sv", "danish": "da", "finnish": "fi", "hungarian": "hu",
}
LEAST_ANSWERS = 12  # labelled texts a language needs to be told
MARGIN = 3.0  # log-odds by which another language must lead
LEAST_GRAMS = 8  # for the share of unknown ones to mean anything
STRANGE = 0.35  # share of unknown letter triples from which a text is in none of the known languages, at least
_WORD = re.compile(r"[^\W\d_]+")
_DENSE = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL")


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0]


def grams(text: str) -> list[str]:
    """Words and their letter triples; signs and pairs where a sign is a syllable or a word; the scripts."""
    out = []
    for word in _WORD.findall(text.lower()):
        kind = script(word[0])
        out.append(f"\0{kind}")
        if kind in _DENSE:
            out += word
            out += [word[i : i + 2] for i in range(len(word) - 1)]
        else:
            out.append(word)
            padded = f" {word} "
            out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


class Languages:
    """Fitted on (text, language) pairs, some of whose labels may be wrong.

    A language with fewer than LEAST_ANSWERS texts isn't known: texts asked for
    in it are not judged. A text of a known target is judged to be in another
    language if another known one leads by MARGIN, or if most of its letter
    triples were never seen in texts of the target, more than in nearly all
    held-out ones.
    """

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        texts: dict[str, list[str]] = defaultdict(list)
        for text, code in samples:
            texts[code].append(text)
        known = {c: t for c, t in texts.items() if len(t) >= LEAST_ANSWERS}
        self.codes = sorted(known)
        counts = {c: Counter(g for t in known[c] for g in grams(t)) for c in self.codes}
        kept = {g for n in counts.values() for g, k in n.items() if k > 1}
        totals = {c: sum(k for g, k in counts[c].items() if g in kept) + 0.5 * len(kept) for c in self.codes}
        self.index = {g: i for i, g in enumerate(sorted(kept))}
        n = np.array([[counts[c][g] for c in self.codes] for g in self.index], float).reshape(len(self.index), len(self.codes))
        self.weights = np.log((n + 0.5) / np.array([totals[c] for c in self.codes]))
        # What is met far more seldom than its language's texts may come from wrongly labelled ones.
        self.met = n > 1 + 0.0002 * np.array([len(known[c]) for c in self.codes])
        self.strange = {c: self._limit(c, known[c]) for c in self.codes}

    def _limit(self, code: str, texts: list[str]) -> float:
        """Share of unknown grams that almost no held-out text of the language has."""
        seen = {g for t in texts[::2] for g in grams(t)}
        shares = []
        for text in texts[1::2]:
            found = [g for g in grams(text) if g[0] != "\0"]
            shares.append(sum(g not in seen for g in found) / len(found) if len(found) >= LEAST_GRAMS else 0.0)
        shares.sort()
        return max(STRANGE, (shares[int(0.98 * (len(shares) - 1))] if shares else 1.0) + 0.1)

    def other(self, text: str, target: str) -> bool | None:
        """Whether a text is in another language than the target; null if that can't be told."""
        if target not in self.strange:
            return None
        found = grams(text)
        told = sum(g[0] != "\0" for g in found)
        if told < 4:
            return None
        rows = [i for g in found if (i := self.index.get(g)) is not None]
        at = self.codes.index(target)
        scores = self.weights[rows].sum(0)
        mine, scores[at] = scores[at], -np.inf
        lead = scores.max() - mine if len(self.codes) > 1 else 0.0
        if lead >= MARGIN:
            return True
        known = int(self.met[[i for g in found if g[0] != "\0" and (i := self.index.get(g)) is not None], at].sum())
        if told >= LEAST_GRAMS and 1 - known / told > self.strange[target]:
            return True
        return False if lead <= -MARGIN or len(self.codes) == 1 else None
