"""Text folding shared by the operators here, for code that runs in Python workers.

Folding goes through str.translate with tables that grow by the characters met, at most one entry a code point.
"""

from __future__ import annotations

import unicodedata

#: Letters that Unicode doesn't take apart, as people write them without their signs.
_ALONE = {"đ": "d", "Đ": "d", "ð": "d", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ħ": "h", "ı": "i"}
#: First and last code points of scripts written without spaces: each of their characters is a word.
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))


class Folding(dict):
    """Table for str.translate that works out a character when it is met first."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, c: int) -> str:
        self[c] = self.of(chr(c))
        return self[c]


def _stripped(c: str) -> str:
    low = c.lower()
    if low < "\x80":
        return low
    return "d" if low == "đ" else unicodedata.normalize("NFD", low)[0] if len(low) == 1 else low


def _folded(c: str) -> str:
    """Lower-case letters and digits without marks, or nothing."""
    plain = "".join(_ALONE.get(x, x) for x in unicodedata.normalize("NFKD", c))
    return "".join(x for x in plain.lower() if not unicodedata.combining(x))


def word_part(c: str) -> str:
    """What a character gives to a word: itself folded, nothing for marks, or a blank."""
    if unicodedata.category(c) in ("Mn", "Me", "Cf"):
        return ""
    part = "".join(x if x.isalnum() or unicodedata.category(x) == "Mc" else " " for x in _folded(c))
    return f" {part} " if any(a <= ord(c) <= b for a, b in _UNSPACED) else part


_STRIP, _WORDS = Folding(_stripped), Folding(word_part)


def strip_marks(text: str) -> str:
    """Lower-case text without accents; every character keeps its place where the input is precomposed.

    Letters outside ASCII that have no ASCII base stay as they are.
    """
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).translate(_STRIP)


def words_of(text: str) -> list[str]:
    """The folded words of a text: runs of letters and digits of any script, lower case, without accents.

    A character of a script that is written without spaces is a word of its own.
    """
    return text.translate(_WORDS).split()


def osa_distance(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or limit + 1 if more."""
    if a == b:
        return 0
    la, lb = len(a), len(b)
    if abs(la - lb) > limit:
        return limit + 1
    start = 0
    short = min(la, lb)
    while start < short and a[start] == b[start]:
        start += 1
    while la > start and lb > start and a[la - 1] == b[lb - 1]:
        la -= 1
        lb -= 1
    a, b = a[start:la], b[start:lb]
    if not a or not b:
        return min(limit + 1, max(len(a), len(b)))
    n, far = len(b), limit + 1
    before, row = None, [j if j <= limit else far for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        first, last = max(1, i - limit), min(n, i + limit)  # cells further from the diagonal are beyond the limit
        new = [far] * (n + 1)
        if i <= limit:
            new[0] = i
        left = new[first - 1]
        best = left
        for j in range(first, last + 1):
            y = b[j - 1]
            v = row[j - 1]
            if x != y:
                if row[j] < v:
                    v = row[j]
                if left < v:
                    v = left
                v += 1
                if before is not None and j > 1 and x == b[j - 2] and y == a[i - 2] and before[j - 2] + 1 < v:
                    v = before[j - 2] + 1
            new[j] = left = v
            if v < best:
                best = v
        if best > limit:
            return far
        before, row = row, new
    return min(row[-1], far)
