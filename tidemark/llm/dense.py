"""Dense features of a text for the toxicity trees (operator 5): what runs inside the tasks.

Character counts come from one class table over code points, word shapes from sums between word
borders, and only the lexicon is asked word by word. A text is read in slices of about ``SLICE``
characters, cut at white space, so a very long one needs no more memory than a slice.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np

#: Second-person words of the supported languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ya du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú usted ustedes vosotros ti tus su sus".split()
)
#: Signs that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans("013457@$!*", "oieastasi_")
NAMES = (
    "lexicon_density", "lexicon_weight", "lexicon_hits", "lexicon_kinds", "near_you", "you_density", "capitals",
    "shouted_words", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_hits", "digits", "longest_run", "log_words",
)
PREFIXES = (4, 5)
SLICE = 500_000
#: Words of a task's memo and the longest of them; it is emptied when full.
MEMO_SIZE, MEMO_WORD = 100_000, 64

_EDGE = re.compile(r"^\W+|\W+$")
_RUN = re.compile(r"([!?*$%#&@])\1+")
_SPACE, _LETTER, _UPPER, _DIGIT, _ALNUM, _WORD, _JOIN, _BANG, _ASK = (1 << k for k in range(9))


def _classes(codes: range) -> np.ndarray:
    out = np.zeros(len(codes), np.uint16)
    for k, code in enumerate(codes):
        c = chr(code)
        out[k] = (
            _SPACE * c.isspace() + _LETTER * c.isalpha() + _UPPER * c.isupper() + _DIGIT * c.isdigit() + _ALNUM * c.isalnum()
            + _WORD * (c.isalnum() or c == "_") + _JOIN * (c in "-'’") + _BANG * (c == "!") + _ASK * (c == "?")
        )
    return out


def terms_of(word: str) -> list[str]:
    """A word's lexicon keys: itself and, if it is longer, its prefixes (marked by '~')."""
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) > k)]


def slices(text: str, size: int = SLICE):
    """The text in parts of about ``size`` characters that end at white space (a longer word stays whole)."""
    at = 0
    while len(text) - at > size:
        m = re.compile(r"\s").search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


class Features:
    """Dense features of a text. Scores see the text alone, never lang, source, doc_id or labels."""

    def __init__(self, lexicon: dict[str, float], near: int = 5, size: int = MEMO_SIZE):
        self.lexicon, self.near, self.size = lexicon, near, size
        self.memo: dict[str, int] = {}
        #: Distinct word values: (weight, is second person, hidden hit, key of the term); 0 is 'nothing'. Keys are hashes,
        #: so a value costs about 200 bytes; there is one a distinct lexicon word.
        self.kinds: list[tuple[float, bool, bool, int]] = [(0.0, False, False, 0)]
        self.number: dict[tuple, int] = {self.kinds[0]: 0}
        self.table = _classes(range(0x3000))

    def word(self, low: str) -> int:
        """The number of a lower-case word's value."""
        w = low if low.isalnum() else _EDGE.sub("", low)
        get = self.lexicon.get
        weight = max(get(w, 0.0), get(f"{w[:4]}~", 0.0) if len(w) > 4 else 0.0, get(f"{w[:5]}~", 0.0) if len(w) > 5 else 0.0)
        hidden = False
        if not weight and not w.isalpha() and any(c.isalpha() for c in w):
            weight = max((get(t, 0.0) for t in terms_of(w.translate(LOOKALIKE))), default=0.0)
            hidden = weight > 0
        value = (weight, w in SECOND_PERSON, hidden, hash(w) if weight else 0)
        got = self.number.get(value)
        if got is None:
            got = self.number[value] = len(self.kinds)
            self.kinds.append(value)
        return got

    def _words(self, low: list[str]) -> list[tuple[int, tuple[float, bool, bool, int]]]:
        """Place and value of the words that say anything."""
        if len(self.memo) > self.size:
            self.memo = {}
        get = self.memo.get
        numbers = np.fromiter(map(get, low, repeat(-1)), np.int64, len(low))
        out = {}
        for k in np.flatnonzero(numbers).tolist():
            number = numbers[k]
            if number < 0:
                number = self.memo.get(low[k])
            if number is None:
                number = self.word(low[k])
                if len(low[k]) <= MEMO_WORD:
                    self.memo[low[k]] = number
            if number:
                out[k] = self.kinds[number]
        return list(out.items())

    def _shapes(self, text: str) -> np.ndarray:
        """Letters, capitals, signs, digits, '!', '?', shouted words, words with inner signs."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(codes, len(self.table) - 1)
        cls = self.table[low]
        far = np.flatnonzero(codes >= len(self.table))
        if len(far):
            cls[far] = [int(_classes(range(c, c + 1))[0]) for c in codes[far].tolist()]
        letter, upper, solid = (cls & _LETTER) > 0, (cls & _UPPER) > 0, (cls & _SPACE) == 0
        begins = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
        ends = np.flatnonzero(solid & np.concatenate([~solid[1:], [True]])) + 1
        total = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int32)])
        letters, capitals, odd = total(letter), total(upper), total(~letter & ((cls & _JOIN) == 0))
        n_letters = letters[ends] - letters[begins]
        n_capitals = capitals[ends] - capitals[begins]
        # the first and last word character of each word bound its inside
        at = np.flatnonzero(cls & _WORD)
        first, last = np.searchsorted(at, begins), np.searchsorted(at, ends) - 1
        some = np.flatnonzero((n_letters > 0) & (first <= last))
        inner = odd[at[last[some]] + 1] - odd[at[first[some]]] if len(some) else np.zeros(0)
        return np.array([
            letter.sum(), upper.sum(), (solid & ((cls & _ALNUM) == 0)).sum(), ((cls & _DIGIT) > 0).sum(), ((cls & _BANG) > 0).sum(), ((cls & _ASK) > 0).sum(),
            ((n_letters > 2) & (n_capitals == n_letters)).sum(), (inner > 0).sum(),
        ], float)

    def __call__(self, text: str) -> list[float]:
        n, sums = 0, np.zeros(8)
        hits: list[int] = []
        you: list[int] = []
        weight, hidden, keys, run = 0.0, 0, set(), 0
        for part in slices(text):
            if not part or part.isspace():
                continue
            sums += self._shapes(part)
            low = part.lower().split()
            for k, (w, second, veiled, key) in self._words(low):
                if w:
                    hits.append(n + k)
                    weight += w
                    hidden += veiled
                    keys.add(key)
                if second:
                    you.append(n + k)
            n += len(low)
            run = max(run, max((len(m[0]) for m in _RUN.finditer(part)), default=0))
        if not n:
            return [0.0] * len(NAMES)
        close = 0
        if hits and you:
            h, y = np.array(hits), np.array(you)
            at = np.searchsorted(y, h)
            left = np.abs(h - y[np.maximum(at - 1, 0)])
            right = np.abs(y[np.minimum(at, len(y) - 1)] - h)
            close = int((np.minimum(left, right) <= self.near).sum())
        letters, chars = max(sums[0], 1.0), len(text)
        return [
            len(hits) / n, weight / n, float(len(hits)), float(len(keys)), close / n, len(you) / n, sums[1] / letters, sums[6] / n, sums[4] / n,
            sums[5] / n, sums[2] / chars, sums[7] / n, hidden / n, sums[3] / chars, float(run), float(np.log1p(n)),
        ]
