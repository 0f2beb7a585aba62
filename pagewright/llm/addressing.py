"""Postal addresses in free text: finding them and taking them apart. Used by problems 2 and 3.

The forms of an address (words for house numbers, streets, wards, districts and provinces) are fixed values; the words
that place and street names consist of are learned from the corpus, see place_words().
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import remove_accents
from .textkit import osa_distance, strip_marks

#: A word is part of place or street names if it stands in such a position so often, and in this part of all its places in addresses,
LEAST_COUNT, LEAST_PART = 3, 0.1
#: and no word an edit away is so many times more frequent there (it is a misspelling then, and is_place() knows it as one).
MISSPELLED = 8
#: Words that go to the tasks, at most: more are an error. They are words of a language, so their number doesn't follow the data.
MAX_WORDS = 500_000

_BREAK = re.compile(r"(?<=[^\W\d_])[-¬=‐]\n(?=[^\W\d_])")


def joined(text: str) -> tuple[str, Sequence[int]]:
    """The text on one line, words broken across lines joined, and the place of each character in the original."""
    if "\n" not in text:
        return text, range(len(text))
    breaks = [m for m in _BREAK.finditer(text) if text[m.end()].islower() or text[max(0, m.start() - 1)].isupper()]
    if not breaks:
        return text.replace("\n", " "), range(len(text))
    out: list[str] = []
    at: list[int] = []
    last = 0
    for m in breaks:
        out.append(text[last : m.start()])
        at.extend(range(last, m.start()))
        last = m.end()
    out.append(text[last:])
    at.extend(range(last, len(text)))
    return "".join(out).replace("\n", " "), at


# Forms of the parts of an address, on folded text. Every pattern keeps places in the text.
_NUMBER = r"(?:(?:so nha|so|sn|lo|lot)\s+)?(?:[a-h]\s?-?\s?\d{1,5}(?![\d/])|[a-z]\d{1,5}(?=/\d)(?:/\d{1,5}){1,5}|\d{1,5}(?:\s?/\s?\d{1,5}){0,5}(?:\s?[a-h](?![a-z.]))?)"
_STREET_WORD = r"(?:duong|pho|dg|d|p)\b\.?"
_NAME = r"[a-z]+\s+(?:[a-z]\s?\.|[a-z]+)\s+[a-z]+"
_ANCHOR, _ANCHOR_3 = (
    re.compile(rf"(?<![\w/.\-+])(?P<num>{_NUMBER})(?![\w/])\s*,?\s*(?:(?P<sw>(?:duong|pho|dg|d)\b\.?)\s*)?(?P<street>{street})(?![a-z])")
    for street in ("[a-z]+", _NAME)
)
_WORD = re.compile(r"[a-z]\s?\.|[a-z]+(?![a-z])")
_LEVELS = {
    "province": r"(?:tinh|tp|t|thanh pho)", "district": r"(?:huyen|quan|h|q|thi xa)", "ward": r"(?:phuong|p|xa|thi tran)",
}
_DELIMITER = r"\s*[,;]\s*|\s+-\s+|\s*–\s*"
_DELIMITED = re.compile(_DELIMITER)
_PART = re.compile(
    rf"(?:(?P<province>{_LEVELS['province']})(?:\s*\.\s*|\s+)|(?P<district>{_LEVELS['district']})(?:\s*\.\s*|\s+|(?<=q)(?=\d))|(?P<ward>{_LEVELS['ward']})(?:\s*\.\s*|\s+|(?=\d)))?"
    r"(?:(?P<digits>\d{1,2})(?![\d/])|(?P<name>[a-z]+\s+[a-z]+)(?![a-z]))"
)
# A part of one to four words, bounded by what follows.
_LONG = re.compile(
    rf"(?:(?P<province>{_LEVELS['province']})(?:\s*\.\s*|\s+)|(?P<district>{_LEVELS['district']})(?:\s*\.\s*|\s+)|(?P<ward>{_LEVELS['ward']})(?:\s*\.\s*|\s+))?"
    r"(?P<digits>$^)?(?P<name>[a-z]+(?:\s+[a-z]+){0,3})(?=\s*(?:[,;–()]|\.(?!\w)|$)|\s+-\s)"
)
_BOUND = re.compile(r"\s*(?:[,;–()]|\.(?!\w)|$)|\s+-\s")
_TWO = re.compile(r"(?P<province>$^)?(?P<district>$^)?(?P<ward>$^)?(?P<digits>$^)?(?P<name>[a-z]+\s+[a-z]+)(?![a-z])")
_GAP, _DIGIT, _GROUP = re.compile(r"\s+"), re.compile(r"\d"), re.compile(r"\d{3}[\s.)]*$")
_NUMBER_WORD, _NUMBERED = re.compile(r"(?:so nha|so|sn|lo|lot)\s+$"), re.compile(r"(?:phuong|p|quan|q)\b|[pq]\d")
_DELIMITED_END, _COUNTRY_END = re.compile(rf"(?:{_DELIMITER})$"), re.compile(r"(?:viet nam|vn)$")
_OPEN = re.compile(r"(?:^|[,;:(–]|\s-)\s*$")
_COUNTRY = re.compile(r"(?:viet nam|vn)\b")
_PART_END = re.compile(
    r"(?:(?:(?:tinh|tp|t|huyen|quan|h|q|phuong|p)(?:\s*\.\s*|\s+))?[a-z]+\s+[a-z]+|(?:phuong|p)\s*\.?\s*\d{1,2})$"
)


@dataclass
class Address:
    """A place as written; parts that are missing are None. bare holds parts without a word for their level."""

    start: int
    end: int
    number: str
    street: str
    ward: str | None = None
    district: str | None = None
    province: str | None = None
    bare: list[str] = field(default_factory=list)


class PlaceWords:
    """Folded words of place names and first words of street names."""

    def __init__(self, places: set[str], streets: set[str]) -> None:
        self.places, self.streets = places, streets
        self.near = [Deletions(w for w in ws if len(w) >= 3) for ws in (places, streets)]

    def is_place(self, word: str) -> bool:
        """Whether a folded word is part of place names, also with a letter or so wrong."""
        return word in self.places or (len(word) >= 3 and self.near[0].holds(word))

    def is_street(self, word: str) -> bool:
        return word in self.streets or (len(word) >= 3 and self.near[1].holds(word))


class Deletions:
    """Words by what is left of them without a letter: words within one edit of each other share one of these."""

    def __init__(self, words) -> None:
        self.of: dict[str, list[str]] = {}
        for w in words:
            for v in self._left(w):
                self.of.setdefault(v, []).append(w)
        self.memo: dict[str, bool] = {}

    @staticmethod
    def _left(word: str) -> set[str]:
        return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}

    def near(self, word: str) -> set[str]:
        return {w for v in self._left(word) for w in self.of.get(v, ()) if osa_distance(word, w, 1) <= 1}

    def holds(self, word: str) -> bool:
        """Whether a word within one edit is there."""
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = any(osa_distance(word, w, 1) <= 1 for v in self._left(word) for w in self.of.get(v, ()))
        return self.memo[word]


def fold_places(text: str) -> str:
    """strip_marks that keeps the number of characters (the text must be in composed form)."""
    out = strip_marks(text)
    return out if len(out) == len(text) else "".join((strip_marks(c) or c)[0] for c in text)


def find_addresses(text: str, words: PlaceWords, folded: str | None = None) -> list[Address]:
    """The addresses in a one-line text in composed form, from left to right; folded is that of fold_places(), if it is at hand."""
    folded = fold_places(text) if folded is None else folded
    found: list[Address] = []
    at = 0
    while m := _ANCHOR.search(folded, at):
        at = m.start() + 1
        if not (m["sw"] or m["num"][0] in "sl" or words.is_street(m["street"])):
            continue
        # The last digits of a phone or identity number are a house number only if three words and a delimiter say so.
        group = bool(_GROUP.search(folded[max(0, m.start() - 8) : m.start()]))
        for n, street, r, first in _streets(text, folded, m, words):
            if group and n != 3:
                continue
            named = r["num"].startswith(("so", "sn", "lo"))
            sure = words.is_street(first) if n == 3 else first in words.streets
            if not (sure or r["sw"] or named):
                continue
            end = r.start("street") + len(street)
            a = Address(r.start(), end, _number(r["num"]), re.sub(r"\s+", " ", re.sub(r"\s*\.", ".", street)))
            # The number word may have been cut off by the pattern's leftmost digit; take it in.
            w = _NUMBER_WORD.search(folded[max(0, a.start - 8) : a.start])
            if w and not named:
                a.start -= len(w[0])
            a.end = _parts_after(folded, end, a, words, not group)
            if n > 3 and a.end == end:
                continue
            a.start = _parts_before(folded, a.start, a, words, text)
            if a.ward or a.district or a.province or a.bare or (n == 3 and sure and (r["sw"] or named)):
                found.append(a)
                at = max(a.end, m.start() + 1)
                break
    return found


def _streets(text: str, folded: str, m: re.Match, words: PlaceWords):
    """The ways to read a street of one to five words at an anchor: (words, text, match, first word), the likeliest first.

    A street ends at a delimiter, a word for a level with its name, or, if it is written with capitals, at a small letter. Three words
    are also read where nothing ends them.
    """
    three = _ANCHOR_3.match(folded, m.start())
    at = end = m.start("street")
    n, bound = 0, False
    while n < 5 and (w := _WORD.match(folded, end)):
        small = n and text[at].isupper() and text[end].islower()
        if n and (small or _level_follows(folded, end, words, n >= 3)):
            end, bound = at + len(folded[at:end].rstrip()), not small or n < 3
            break
        n, end = n + 1, w.end()
        if bound := bool(_BOUND.match(folded, end)):
            break
        if not folded[end : end + 1].isspace():
            break
        end += len(folded[end:]) - len(folded[end:].lstrip()) if n < 5 else 0
    if n == 5 and not bound:
        bound = _level_follows(folded, end + len(folded[end : end + 1]), words)
    street = folded[at:end]
    if n == 2 and three and three.end() == end:
        # The same words with the street word as the first of the name, as in "Phó Sỹ Chuẩn".
        first = three["street"].split()[0]
        if first in words.streets and text[three.start("street") :][: len(first)].lower() not in ("phố", "đường"):
            n = 3
        else:
            three = None
    whole = bool(bound and n != 3)
    parts = whole and bool(_next_part(folded, end, words))
    if parts:
        yield n, street, m, street.split()[0]
    if three:
        yield 3, three["street"], three, three["street"].split()[0]
    if whole and not parts and n < 3:
        yield n, street, m, street.split()[0]


def _level_follows(s: str, at: int, words: PlaceWords, initials: bool = True) -> bool:
    """Whether a word for a level and its name begin here without a delimiter before them.

    One letter needs digits, or two words of places where it is no initial of a street.
    """
    for m in _readings(s, at):
        level = m["province"] or m["district"] or m["ward"]
        if level and _valid(m, words):
            name = (m["name"] or "").split()
            if m["digits"] or (len(level) > 1 and level != "xa") or (initials and len(name) > 1 and all(words.is_place(x) for x in name)):
                return True
    return False


def _next_part(s: str, at: int, words: PlaceWords) -> re.Match | None:
    """The part that begins behind a delimiter here."""
    if d := _DELIMITED.match(s, at):
        return next((m for m in _readings(s, d.end()) if _valid(m, words)), None)
    gap = _GAP.match(s, at)
    if gap and _level_follows(s, gap.end(), words):
        return next((m for m in _readings(s, gap.end()) if (m["province"] or m["district"] or m["ward"]) and _valid(m, words)), None)
    return None


def _number(text: str) -> str:
    text = re.sub(r"^(?:so nha|so|sn|lot|lo)\s+", "", text)
    return re.sub(r"[\s\-]", "", text)


def _take(a: Address, m: re.Match, words: PlaceWords) -> bool:
    level = next((k for k in ("province", "district", "ward") if m[k]), None)
    if m["digits"]:
        if not _valid(m, words):
            return False
        if getattr(a, level) is None:
            setattr(a, level, str(int(m["digits"])))
        return True
    name = re.sub(r"\s+", " ", m["name"])
    if not _valid(m, words):
        return False
    if level is not None and getattr(a, level) is None:
        setattr(a, level, name)
    else:
        a.bare.append(name)
    return True


def _parts_after(s: str, at: int, a: Address, words: PlaceWords, first: bool = True) -> int:
    """The end of the parts behind a street; the first may do without a delimiter if `first`."""
    while (d := _DELIMITED.match(s, at)) or first:
        if d and (c := _COUNTRY.match(s, d.end())):
            at, first = c.end(), False
            continue
        # "t. phieu suong" may also read as a bare name when its level word belongs to the name ("huyen que")
        best = _next_part(s, at, words)
        if not best or not _take(a, best, words):
            break
        at, first = best.end(), False
    return at


def _readings(s: str, at: int):
    """The ways to read a part at a place: with a word for its level, and as a bare name; longer bounded names first, single words last."""
    long = _LONG.match(s, at)
    size = len(long["name"].split()) if long else 2
    if size > 2:
        yield long
    if m := _PART.match(s, at):
        yield m
    if m := _TWO.match(s, at):
        yield m
    if size == 1:
        yield long


def _valid(m: re.Match, words: PlaceWords) -> bool:
    if m["digits"]:
        return bool(m["ward"]) or m["district"] in ("quan", "q")
    name = m["name"].split()
    level = m["province"] or m["district"] or m["ward"]
    if len(name) == 1:
        return name[0] in words.places or bool(level) and len(name[0]) >= 4 and words.is_place(name[0])
    if len(name) > 2:
        return all(words.is_place(x) for x in name)
    x, y = name
    if level:
        return words.is_place(x) and words.is_place(y) or ((words.is_place(x) or words.is_place(y)) and len(x) + len(y) >= 5)
    if x in ("tinh", "quan", "phuong", "xa") and x not in words.places:
        return False
    return words.is_place(x) and words.is_place(y)


def _parts_before(s: str, at: int, a: Address, words: PlaceWords, text: str) -> int:
    before: list[re.Match] = []
    while d := _DELIMITED_END.search(s, max(0, at - 12), at):
        end = d.start()
        if c := _COUNTRY_END.search(s, max(0, end - 8), end):
            at = c.start()
            continue
        best = None
        for k in (48, 3):  # the longest reading that ends here and is valid
            window = max(0, end - k)
            for b in range(window, end):
                if b and (s[b - 1].isalnum()):
                    continue
                if _DIGIT.search(s, b, end) and not _NUMBERED.match(s, b, end):
                    continue
                m = _PART.fullmatch(s, b, end)
                if not (m and _valid(m, words)):
                    m = next((r for r in _readings(s, b) if r.end() == end and _valid(r, words)), None)
                    # Names of other lengths than two end at a delimiter on both sides.
                    if m and m["name"] and len(m["name"].split()) != 2 and not _OPEN.search(s[max(0, b - 8) : b]):
                        m = None
                    # A person's name ("Quản ...") may read as the word for a level.
                    if m and m["district"] == "quan" and text[m.start() : m.start() + 4].lower() not in ("quan", "quận"):
                        m = None
                if m:
                    best = m
                    break
            if best:
                break
        if not best:
            break
        before.append(best)
        at = best.start()
    for m in before:  # from the street outwards, so the bare parts come from the narrowest to the widest
        _take(a, m, words)
    return at


def compose(text: str) -> str:
    """Composed form with as many characters as possible kept in place."""
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def place_words(results: DataFrame, field_name: str = "dia_chi", column: str = "extracted_fields", reference: list[str] | None = None) -> PlaceWords:
    """Learn the words of place and street names from the values of an address field.

    Words that follow a word for a level, or a house number, are counted over all rows, beside all places where they stand; see
    LEAST_COUNT, LEAST_PART and MISSPELLED. Names of a reference list are added.
    """
    value = F.lower(remove_accents(F.regexp_replace(F.col(column)[field_name], r"\s+", " ")))
    places = r"(?:^|[,;\-] ?)(?:tinh|tp|t|huyen|quan|h|q|phuong|p)(?: ?\. ?| )([a-z]+(?: [a-z]+){0,3})(?= ?(?:[,;\-(]|$))"
    streets = r"(?:so|sn|lo|^|[,;] ?) ?[a-h]?-?\d+(?:/\d+)? ?[a-h]?,? (?:(?:duong|pho|dg|d)\.? )?([a-z]+)(?: (?:[a-z]\.|[a-z]+)){0,4}(?= ?(?:[,;\-(]|$))"
    found = lambda kind, pattern: F.transform(
        F.split(F.array_join(F.regexp_extract_all("v", F.lit(pattern), F.lit(1)), " "), " "), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w"))
    )
    everywhere = F.transform(F.split("v", "[^a-z]+"), lambda w: F.struct(F.lit("all").alias("kind"), w.alias("w")))
    rows = results.select(value.alias("v")).where("v is not null").select(F.explode(F.concat(found("place", places), found("street", streets), everywhere)).alias("x"))
    n = lambda kind: F.count_if(F.col("x.kind") == kind)
    counted = rows.where("length(x.w) > 1").groupBy("x.w").agg(n("place").alias("place"), n("street").alias("street"), n("all").alias("n"))
    # Words for a level stand everywhere, and may be part of names too.
    levels = ("tinh", "huyen", "quan", "phuong", "duong", "pho", "tp", "xa", "thi", "lo")
    usual = lambda c: (F.col(c) >= LEAST_COUNT) & ((F.col(c) >= LEAST_PART * F.col("n")) | F.col("w").isin(*levels))
    kept = counted.where(usual("place") | usual("street")).limit(MAX_WORDS + 1).collect()
    if len(kept) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words of places")

    def sound(kind: str) -> set[str]:
        counts = {r["w"]: r[kind] for r in kept if r[kind] >= LEAST_COUNT and (r[kind] >= LEAST_PART * r["n"] or r["w"] in levels)}
        index = Deletions(counts)
        return {w for w, c in counts.items() if not any(counts[o] >= MISSPELLED * c for o in index.near(w))}

    names = sound("place") | {w for name in reference or [] for w in strip_marks(name).split()}
    level_words = {"tinh", "huyen", "quan", "phuong", "duong", "pho", "tp"}
    return PlaceWords({w for w in names if w == "huyen" or w not in level_words}, {w for w in sound("street") if w not in level_words - {"pho", "quan"}})
