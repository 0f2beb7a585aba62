"""One form for text that looks the same (problem 6).

Method: texts that hold a character outside the plain set are exploded into positioned code points; a broadcast join
with a mapping (decompositions, compatibility forms, spaces, invisible characters, look-alike letters) replaces each;
the marks of a base are put in canonical order, recomposed by a second mapping, and the texts are rebuilt.

Both mappings are built by rule from the Unicode database of Python's standard library, plus the look-alike letters
stated below; they don't grow with the data (a few thousand rows).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that look like a Latin letter, and the Latin letter.
LOOKALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "κ": "k", "τ": "t",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "с": "c", "е": "e", "һ": "h",
    "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ԁ": "d", "ү": "y",
    "ӏ": "l", "Ӏ": "I", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "Ꭺ": "A", "ո": "n", "ս": "u", "օ": "o", "հ": "h",
}
# Latin letters outside Vietnamese and English that look like one of theirs.
LATIN_LOOKALIKE = {"ɑ": "a", "ı": "i", "ɡ": "g", "Ð": "Đ", "ð": "đ", "Ɖ": "Đ", "ɖ": "đ", "ȷ": "j", "ʏ": "Y", "ɩ": "i", "ƌ": "đ", "Ƌ": "Đ"}
# Signs that stay as they are (units, superscripts, dashes, quotes, currency, numbering).
KEPT_SIGNS = "°±²³¹µ×÷·½¼¾№–—―‘’“”„…•€£¥©®™§¶«»¬ΩΩ℃℉KÅ←→↑↓≤≥≠≈∞√∆∑"
#: Marks that make a Vietnamese vowel letter come before its tone mark, whatever their order in the text.
_VOWEL_MARKS = "̛̂̆"
_STROKES = "̵̶̷̸"


def vietnamese_letters() -> str:
    """The precomposed letters beyond ASCII of Vietnamese, both cases."""
    out = set("đĐ")
    for base in "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY":
        for tone in ("", "̀", "́", "̃", "̉", "̣"):
            c = unicodedata.normalize("NFC", base + tone)
            if len(c) == 1 and c > "\x7f":
                out.add(c)
    return "".join(sorted(out))


def _spaces() -> list[str]:
    return [chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]


def _invisible() -> list[str]:
    out = [chr(c) for c in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0)]
    out += [chr(c) for lo, hi in ((0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F)) for c in range(lo, hi + 1)]
    return out


def code_point_map() -> list[tuple[str, list[str], bool]]:
    """(character, its code points in decomposed plain form, whether it is replaced only inside Latin words)."""
    out: dict[str, tuple[list[str], bool]] = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):  # Latin letters: canonical decompositions
        ch = chr(c)
        d = unicodedata.normalize("NFD", ch)
        if d != ch:
            out[ch] = (list(d), False)
    for lo, hi in ((0xFF01, 0xFF5E), (0xFB00, 0xFB06), (0x1D400, 0x1D7FF), (0x2460, 0x2460 - 1)):
        for c in range(lo, hi + 1):
            ch = chr(c)
            d = unicodedata.normalize("NFKD", ch)
            if d != ch and d.isascii():
                out[ch] = (list(d), False)
    for c in range(0x340, 0x345):  # marks that stand for other marks
        if (d := unicodedata.normalize("NFD", chr(c))) != chr(c):
            out[chr(c)] = (list(d), False)
    out |= {ch: ([" "], False) for ch in _spaces()}
    out |= {ch: ([], False) for ch in _invisible()}
    out |= {k: (list(v), True) for k, v in LOOKALIKE.items()}
    out |= {k: (list(v), False) for k, v in LATIN_LOOKALIKE.items()}
    return [(k, v, only) for k, (v, only) in sorted(out.items())]


def mark_rank(mark: str) -> int:
    """Order of a mark after its base: by combining class, vowel marks before tones, strokes first."""
    if mark in _STROKES:
        return 1
    return unicodedata.combining(mark) * 10 - (5 if mark in _VOWEL_MARKS else 0)


def compose_map() -> list[tuple[str, str]]:
    """(base with its marks in the order of mark_rank, the precomposed letter)."""
    out = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1:
            out["".join([d[0], *sorted(d[1:], key=mark_rank)])] = chr(c)
    for s in _STROKES:
        out["d" + s], out["D" + s] = "đ", "Đ"
    return sorted(out.items())


def _klass(chars: str) -> str:
    """The characters as the inside of a Java regex class."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


#: Texts that match hold something outside the plain set and go through the operator; the rest are plain.
GATE = f"[^\\x00-\\x7f{_klass(vietnamese_letters())}{_klass(KEPT_SIGNS)}]"
#: A word is a run of letters, marks, digits and invisible characters.
_WORD = "[\\p{L}\\p{M}\\p{N}\\p{Cf}]+"
_CLUSTERS = f"\\P{{M}}[\\p{{M}}{_klass(''.join(_invisible()))}]*|\\p{{M}}+"


def plain_form(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys..., raw, plain) of the rows whose text holds a character outside the plain set.

    Rows with a null or plain text are left out: their plain form is the text itself. Rows that repeat key and text
    give one row, texts of one key a row each. Extra columns are ignored, whatever their names. A look-alike letter is replaced
    only in a word that also holds a Latin letter; words wholly in another script stay.
    """
    spark = df.sparkSession
    key = F.struct(*[F.col(k) for k in keys], F.xxhash64(text_col).alias("__text"))
    suspects = df.where(F.col(text_col).rlike(GATE)).select(key.alias("k"), F.col(text_col).alias("raw")).dropDuplicates(["k"])
    points = F.broadcast(
        spark.createDataFrame(
            [(c, [(p, mark_rank(p) if unicodedata.combining(p) else 0) for p in to], only) for c, to, only in code_point_map()],
            "cp string, parts array<struct<p:string,rank:int>>, latin_only boolean",
        )
    )
    marks = F.broadcast(
        spark.createDataFrame([(chr(c), mark_rank(chr(c))) for c in range(0x300, 0x370)], "cp string, rank int")
    )
    composed = F.broadcast(spark.createDataFrame(compose_map(), "joined string, one string"))

    words = suspects.select("k", F.posexplode(F.regexp_extract_all("raw", F.lit(f"{_WORD}|(?:(?!{_WORD})[\\s\\S])+"), F.lit(0))).alias("w", "word"))
    clusters = words.select(
        "k", "w",
        F.expr("word rlike '\\\\p{IsLatin}|[\\\\x{ff21}-\\\\x{ff3a}\\\\x{ff41}-\\\\x{ff5a}]'").alias("latin"),
        F.posexplode(F.regexp_extract_all("word", F.lit(_CLUSTERS), F.lit(0))).alias("c", "cluster"),
    )
    coded = (
        clusters.select("k", "w", "c", "latin", F.posexplode(F.split("cluster", "")).alias("i", "cp"))
        .where("cp <> ''")
        .join(points, "cp", "left")
        .join(marks, "cp", "left")
    )
    parts = F.when(
        F.col("parts").isNotNull() & (~F.col("latin_only") | F.col("latin")), F.col("parts")
    ).otherwise(F.array(F.struct(F.col("cp").alias("p"), F.coalesce("rank", F.lit(0)).alias("rank"))))
    ordered = (
        coded.select("k", "w", "c", F.col("i"), F.posexplode(parts).alias("j", "part"))
        .groupBy("k", "w", "c")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part.rank", "i", "j", "part.p"))), lambda x: x["p"]), "").alias("joined"))
        .join(composed, "joined", "left")
    )
    rebuilt = ordered.groupBy("k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "c", F.coalesce("one", "joined").alias("s")))), lambda x: x["s"]), "").alias("plain")
    )
    return suspects.join(rebuilt, "k", "left").select(*[F.col("k")[c].alias(c) for c in keys], "raw", F.coalesce("plain", F.lit("")).alias("plain"))


def with_plain(df: DataFrame, keys: list[str], text_col: str = "text", out_col: str = "plain_text") -> DataFrame:
    """df with its text in plain form in out_col; null stays null. keys must identify a row and be free of nulls."""
    changed = plain_form(df, keys, text_col).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("plain").alias("__plain"))
    on: Column = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (df[k] == changed[f"__k{i}"])
    return df.join(changed, on, "left").select(*[df[c] for c in df.columns if c != out_col], F.coalesce("__plain", df[text_col]).alias(out_col))
