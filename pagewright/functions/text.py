"""Text functions as column expressions: they run in the JVM, inside code generation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode database."""
    src, dst = [], []
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(c)
        base = "d" if ch == "đ" else "D" if ch == "Đ" else unicodedata.normalize("NFD", ch)[0]
        if base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FROM, _TO = _fold_table()


def remove_accents(col: Column | str) -> Column:
    """The text without accents: precomposed Latin letters become their base, đ becomes d, combining marks go."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")


def fold_key(col: Column | str) -> Column:
    """Lower-case ASCII letters and digits of the text only: equal for texts that differ in case, accents, spaces or signs."""
    return F.regexp_replace(F.lower(remove_accents(col)), "[^a-z0-9]+", "")


def nfc(col: Column | str) -> Column:
    """Composed form. Only text with a combining mark leaves the JVM, in Arrow batches; null stays null.

    The few code points that change under composition without a mark (singletons such as the Angstrom sign) are kept.
    """
    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t) if t is not None and not t.isascii() else t)

    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike(r"\p{Mn}"), compose(F.when(c.rlike(r"\p{Mn}"), c))).otherwise(c)


def natural_key(col: Column | str) -> Column:
    """Array that sorts names as people do: digit runs by value, the rest in lower case.

    A name that begins with a digit gets an empty first part, so that parts of one kind meet; digit runs longer than
    30 digits compare as text.
    """
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    parts = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    padded = F.transform(parts, lambda p: F.when(p.rlike(r"^\d{1,30}$"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 30, "0")).otherwise(p))
    return F.when(c.rlike(r"^\d"), F.concat(F.array(F.lit("")), padded)).otherwise(padded)


def word_count(col: Column | str) -> Column:
    """Number of words parted by white space; 0 for blank text, null for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")))


def peel(col: Column | str) -> Column:
    """(lead, stem, tail) of a token: opening brackets and quotes before it, closing ones and stops after it."""
    c = F.col(col) if isinstance(col, str) else col
    lead = F.regexp_extract(c, r"^[(\[{\"']*", 0)
    rest = F.substr(c, F.length(lead) + 1)
    tail = F.regexp_extract(rest, r"[.,;:!?)'\"}\]]*$", 0)
    return F.struct(lead.alias("lead"), F.substr(rest, F.lit(1), F.length(rest) - F.length(tail)).alias("stem"), tail.alias("tail"))


def typography(col: Column | str) -> Column:
    """Spacing of stops and stray signs: no blank before a stop, one after a comma or colon outside numbers and paths,
    lone accents and quotes between blanks dropped, runs of blanks made one, white space at the ends trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"\s+([:,.?!;])", "$1")
    c = F.regexp_replace(c, r"([,:])([^\s0-9/])", "$1 $2")
    c = F.regexp_replace(c, r"(?<=\s)[~^`'\"](?=\s)", "")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"^\s+|\s+$", "")


def like_case(original: Column, word: Column) -> Column:
    """The word in the case of the original: all upper, capitalised, or as it is."""
    upper = (original == F.upper(original)) & (original != F.lower(original)) & (F.length(original) > 1)
    titled = F.substring(original, 1, 1) != F.lower(F.substring(original, 1, 1))
    return F.when(upper, F.upper(word)).when(titled, F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))).otherwise(word)


def stem_of_file(path: Column | str) -> Column:
    """Name of a file without folder and last extension."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_extract(c, r"[^/\\]*$", 0), r"\.[^.]*$", "")
