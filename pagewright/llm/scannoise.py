"""Noise in text from scanned pages (problem 4).

Method: the lines at the edges of a file's pages, as text and as boxes, are folded and clustered: characters that recognisers
confuse count as one, and lines that share a third of their letters join the most frequent one if they are near it. A cluster that
stands on most pages of a stretch is a running head or foot, unless the same line stands on single pages elsewhere, as form titles
do. Page numbers are edge lines that count along with the page, at the offset most pages of the file agree on; the words before them are
those that stand before such numbers in the corpus. A word broken across lines, or holding a wrong character, is repaired if that
gives a word of the corpus vocabulary; what was found is reported and the lines are joined into paragraphs.

Counts are made in Spark over all pages. To the tasks go the vocabulary, of at most VOCABULARY words by its share, the openers of
heads and the words of page numbers (their number is checked), and with each page the running lines of its file.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_key, remove_accents
from ..plans.persist import cut
from .plainform import code_point_map, vietnamese_letters
from .textkit import osa_distance, strip_marks

VOCABULARY = 1_000_000
LEAST_COUNT = 3
#: A running line stands on two pages or more, on this part of the pages of its stretch, and of those of all its files; on less than that
#: part of its file, or if it is short, only if it stands on three.
HEAD_SHARE = 0.6
LEAST_HEAD = 8
#: Edits between lines of a cluster, and between a line and a running one: 1 in so many letters.
LETTERS_AN_EDIT = 8
#: Files in which a pair of first words must open a running head to mark one, and in which a word must stand before page numbers.
OPENER_FILES = 3
MAX_OPENERS = 100_000
#: Lines from the edge of a page that may be running lines or page numbers.
EDGE = 2
#: A file with 1 in HOT of all pages is joined by broadcast.
HOT = 200
#: A word counts as misread if the word it is repaired to is so many times more frequent.
RATIO = 8

# What recognisers write, and the letters that may have stood there.
CONFUSIONS = {
    "|n": ("h",), "rn": ("m",), "cl": ("d",), "vv": ("w",), "ii": ("u",), "0": ("o",), "1": ("l", "i"), "5": ("s",), "8": ("b",),
    "9": ("g",), "6": ("b",), "3": ("e",), "4": ("a",), "€": ("e",), "+": ("t",), "$": ("s",), "@": ("a",), "|": ("l", "i"), "!": ("i", "l"),
}
_SPOT = re.compile("|".join(re.escape(k) for k in sorted(CONFUSIONS, key=len, reverse=True)))
_SIGNS = "0-9|€+$@!"
_TOKEN = re.compile(rf"[^\W_{_SIGNS}]*(?:[{_SIGNS}]|[^\W_])+", re.U)
_CODE = re.compile(r"\S*@\S*\.\S*|\S*\[at\]\S*|https?:\S+|www\.\S+", re.I)
_HYPHEN = re.compile(r"([^\W\d_]|[|+€$@0-9])[-¬=‐­]\s*$")
_NUMBER = re.compile(r"^[\W_]*(?:([^\W\d_][\w+|€$]{0,6})[\s.:]+)?(\d+)(?:\s*(?:/|of|0f)\s*(\d+))?[\W_]*$", re.I)
# Words before a page number (folded), beside those of the corpus.
_PAGE_WORDS = ("trang", "page", "tr", "to", "p", "pg")


class Vocabulary:
    """Word -> count of the corpus, and repair of words by it."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.sorted: list[str] | None = None
        self.memo: dict[str, str | None] = {}

    def repaired(self, word: str) -> str | None:
        """The word that a lower-case word with wrong characters stands for; None if it isn't misread."""
        if word not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = self._repaired(word)
        return self.memo[word]

    def _repaired(self, word: str) -> str | None:
        spots = list(_SPOT.finditer(word))
        letters = sum(c.isalpha() for c in word)
        if not spots or not letters:
            return None
        foreign = any(not m[0].isalpha() for m in spots)
        seen = self.counts.get(word, 0)
        best, found = 0, None
        for fixed in self._readings(word, spots):
            if fixed != word and (n := self.counts.get(fixed, 0)) > best and fixed.isalpha():
                best, found = n, fixed
        if found and best >= max(LEAST_COUNT, RATIO * seen) and (len(found) > 1 or not foreign):
            # a number or code with one letter is no word
            digits = sum(c.isdigit() for c in word)
            if digits == 0 or letters > digits or (len(found) > 2 and letters == digits):
                return found
        if foreign and len(word) >= 4 and re.fullmatch(r"[^\W\d_]+(?:\|n|[0159€+$|])[^\W\d_]+", word):
            m = next(m for m in spots if not m[0].isalpha())
            return word[: m.start()] + CONFUSIONS[m[0]][0] + word[m.end() :]
        return None

    def _readings(self, word: str, spots: list[re.Match]) -> Iterator[str]:
        """What the word may have been, spot by spot; with many spots, only beginnings of words of the vocabulary go on."""
        many = len(spots) > 4
        if many and self.sorted is None:
            self.sorted = sorted(self.counts)
        heads, at = [""], 0
        for m in spots:
            heads = [h + word[at : m.start()] + c for h in heads for c in (m[0], *CONFUSIONS[m[0]])]
            at = m.end()
            if many:
                heads = [h for h in heads if (k := bisect_left(self.sorted, h)) < len(self.sorted) and self.sorted[k].startswith(h)]
        for h in heads:
            yield h + word[at:]

    def known(self, word: str) -> bool:
        return word in self.counts


def _like(word: str, found: str) -> str:
    return found.upper() if word.isupper() and len(word) > 1 else found.capitalize() if word[:1].isupper() else found


#: Look-alike letters, spaces and invisible characters; marks are composed before and after.
_CODED = re.compile(f"[^\x00-\x7f{vietnamese_letters()}¬€]")
_PLAIN = str.maketrans({c: "".join(to) for c, to, _ in code_point_map()})


def plain_line(text: str | None) -> str:
    """A line in one form: composed, without invisible characters, look-alike letters as Latin ones."""
    if not text or not _CODED.search(text):
        return text or ""
    text = re.sub("[\u0335-\u0338]", "", text.replace("d\u0335", "đ").replace("D\u0335", "Đ"))
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(_PLAIN))


def opener(line: str) -> str:
    """The first two words of a line, folded."""
    return " ".join(strip_marks(line).split()[:2])


@dataclass(frozen=True)
class Running:
    """Running lines of a file (folded) at the top and the bottom, and how far its page numbers are ahead of the page index."""

    heads: tuple[str, ...] = ()
    feet: tuple[str, ...] = ()
    offset: int = 1


def _is_near(key: str, lines: tuple[str, ...]) -> bool:
    return any(osa_distance(key, h, max(1, len(h) // LETTERS_AN_EDIT)) <= len(h) // LETTERS_AN_EDIT for h in lines)


def repair_page(
    units: list[str | None], running: Running, page_index: int | None, vocabulary: Vocabulary, openers: frozenset[str] = frozenset(), page_words: frozenset[str] = frozenset()
) -> tuple[str, list[tuple[int, str]]]:
    """The repaired text of a page and its noisy spots (number of the unit from 0, kind).

    Kinds are header, footer, page_number, hyphen and misread.
    """
    lines = [plain_line(u) for u in units]
    n = len(lines)
    spots: list[tuple[int, str]] = []
    kind: list[str | None] = [None] * n
    top = [k for k in range(n) if lines[k].strip()]
    for k in {*top[: EDGE + 1], *top[-EDGE - 1 :]}:
        near = k in top[:EDGE] or k in top[-EDGE:]
        m = _NUMBER.match(lines[k]) if near else None
        if m:
            word = strip_marks(m[1] or "").translate(str.maketrans("019|+€", "olglte")).rstrip(".:")
            if (not word or any(osa_distance(word, w, 1) <= (len(w) > 3) for w in (*_PAGE_WORDS, *page_words))) and (
                int(m[2]) == page_index + running.offset if page_index is not None else bool(word or m[3])
            ):
                kind[k] = "page_number"
                continue
        key = re.sub("[^a-z0-9]+", "", strip_marks(lines[k]))
        if len(key) < LEAST_HEAD:
            continue
        if k in top[:EDGE] and (_is_near(key, running.heads) or (len(key) >= 2 * LEAST_HEAD and opener(lines[k]) in openers)):
            kind[k] = "header"
        elif k in top[-EDGE:] and _is_near(key, running.feet):
            kind[k] = "footer"
    spots += [(k, v) for k, v in enumerate(kind) if v]
    broken = [False] * n
    after = [next((j for j in range(k + 1, n) if lines[j].strip()), None) for k in range(n)]
    for k in range(n):
        if kind[k] is None and _HYPHEN.search(lines[k]) and (j := after[k]) is not None and kind[j] is None and lines[j].lstrip()[:1].isalpha():
            left = re.search(r"[\w|+€$@]+[-¬=‐­]\s*$", lines[k])
            right = re.match(r"\s*[\w|+€$@]+", lines[j])
            a, b = left[0].rstrip()[:-1].lower(), right[0].strip().lower()
            joined = vocabulary.known(a + b) or vocabulary.repaired(a + b) is not None
            if joined or lines[j].lstrip()[0].islower():
                broken[k] = True
                spots.append((k, "hyphen"))
    out: list[tuple[str, bool]] = []  # a line, and whether it goes on with the line before
    carry = ""
    for k, line in enumerate(lines):
        if kind[k]:
            if kind[k] == "page_number" and re.search(r"[^\W\d_]", line) and _misread(line, vocabulary)[1]:
                spots.append((k, "misread"))
            continue
        text = carry + line.lstrip() if carry else line
        cut, goes_on = len(carry), bool(carry)
        carry = ""
        if broken[k]:
            tail = re.search(r"[\w|+€$@]+[-¬=‐­]\s*$", text)
            carry = tail[0].rstrip()[:-1]
            text = text[: tail.start()]
        fixed, wrong = _misread(text, vocabulary)
        for at in wrong:
            # the wrong character of a word that began on the line before may stand on that line
            spots.append((k - 1 if at < cut and k else k, "misread"))
        out.append((fixed.strip(), goes_on))
    if carry:
        out.append((carry, True))
    return _paragraphs(out), sorted(set(spots))


def _misread(text: str, vocabulary: Vocabulary) -> tuple[str, list[int]]:
    """The text with its misread words repaired, and the places of the wrong characters."""
    skip = [m.span() for m in _CODE.finditer(text)]
    parts, wrong, at = [], [], 0
    for m in _TOKEN.finditer(text):
        if not _SPOT.search(m[0].lower()) or any(a <= m.start() < b for a, b in skip):
            continue
        found = vocabulary.repaired(m[0].lower())
        if found:
            first = next((k for k, (x, y) in enumerate(zip(m[0].lower(), found, strict=False)) if x != y), 0)
            wrong.append(m.start() + first)
            parts += [text[at : m.start()], _like(m[0], found)]
            at = m.end()
    return "".join(parts) + text[at:], wrong


def _paragraphs(lines: list[tuple[str, bool]]) -> str:
    """Lines joined into paragraphs: those that go on by a broken word, or in lower case after a line of some length."""
    out: list[str] = []
    for line, goes_on in lines:
        if not line:
            continue
        last = out[-1] if out else ""
        full = len(last) > 30 and len(line) > 30 and not re.search(r"[:\d]$", last)
        if last and (goes_on or full or (line[:1].islower() and len(last) > 20 and not re.search(r"[.!?:]$", last))):
            out[-1] += " " + line
        else:
            out.append(line)
    return "\n".join(out)


def vocabulary(texts: DataFrame, text_col: str = "full_text", most: int = VOCABULARY, least: int = LEAST_COUNT) -> dict[str, int]:
    """Counts of the lower-case words that make up at least 1 in `most` of all words, and stand `least` times."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{M}]+")).alias("w")).where("length(w) between 1 and 40")
    counted = words.groupBy("w").count()
    floor = F.broadcast(counted.agg((F.sum("count") / most).alias("floor")))
    return {r["w"]: r["count"] for r in counted.where(F.col("count") >= least).join(floor, F.col("count") >= F.col("floor")).collect()}


def _edges(pages: DataFrame) -> DataFrame:
    """(side, file_path, page_index, line): the first and last lines of each page that aren't blank, once each."""
    lines = F.filter("units", lambda u: F.trim(u) != "")
    at = lambda side, some: F.transform(some, lambda u: F.struct(F.lit(side).alias("side"), u.alias("line")))
    parted = pages.where("file_path is not null and page_index is not null").select("file_path", "page_index", lines.alias("l")).where("size(l) > 0")
    both = F.concat(at("top", F.slice("l", 1, EDGE)), at("bottom", F.slice("l", -F.least(F.size("l"), F.lit(EDGE)), F.lit(EDGE))))
    return parted.select("file_path", "page_index", F.explode(F.array_distinct(both)).alias("e")).select("e.side", "file_path", "page_index", "e.line")


def _confused(key: Column) -> Column:
    """A folded line with what recognisers confuse made one."""
    for wrong, right in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u")):
        key = F.replace(key, F.lit(wrong), F.lit(right))
    return F.translate(key, "01589i634", "olsbglbea")


def running_lines(pages: DataFrame) -> tuple[DataFrame, frozenset[str], frozenset[str]]:
    """(file_path, heads, feet, offset, hot), the openers of heads, and the words before page numbers.

    pages has (file_path, page_index, units). heads and feet are folded lines; see HEAD_SHARE. The first two words of heads of at
    least OPENER_FILES files, if lines that begin so are heads for the most part, mark a head where only one page of a
    file is at hand.
    """
    edges = cut(_edges(pages).withColumn("key", fold_key("line")))
    own = edges.groupBy("file_path", "page_index").agg(F.lit(1).alias("one"))
    files = own.groupBy("file_path").agg(F.count("*").alias("file_pages"))
    shape = _confused(F.col("key"))
    lines = (
        edges.where(F.length("key") >= LEAST_HEAD).groupBy("side", "file_path", shape.alias("shape"), "page_index").agg(F.min("key").alias("key"), F.min("line").alias("line"))
        .groupBy("side", "file_path", "shape")
        .agg(F.count("*").alias("n_pages"), F.min("page_index").alias("first"), F.max("page_index").alias("last"), F.min("key").alias("key"), F.min("line").alias("line"))
    )
    lines = cut(lines)
    # The most frequent of the lines that share a third of their letters draws in those near it.
    third = F.ceil(F.length("shape") / F.lit(3)).cast("int")
    pieces = lines.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substr("shape", third * k + 1, third).alias("piece")) for k in range(3)])).alias("x")).select("*", "x.k", "x.piece")
    leaders = pieces.groupBy("side", "file_path", "k", "piece").agg(F.max(F.struct("n_pages", "shape")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    near = F.levenshtein(F.col("shape"), F.col("leader.shape")) <= F.floor(F.length("leader.shape") / LETTERS_AN_EDIT)
    drawn = pieces.join(leaders.select("side", "file_path", "k", "piece", "leader"), ["side", "file_path", "k", "piece"]).where(near & (F.col("shape") != F.col("leader.shape")))
    drawn = drawn.groupBy("side", "file_path", "shape").agg(F.max("leader").alias("leader")).select("side", "file_path", "shape", F.col("leader.shape").alias("cluster"))
    clusters = (
        lines.join(drawn, ["side", "file_path", "shape"], "left").withColumn("cluster", F.coalesce("cluster", "shape"))
        .groupBy("side", "file_path", "cluster")
        .agg(F.sum("n_pages").alias("n_pages"), F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("key", "n_pages").alias("key"), F.max_by("line", "n_pages").alias("line"))
        .join(files, "file_path")
    )
    stretch = F.col("last") - F.col("first") + 1
    # Files of several pages tell a running line from a title: it stands on most pages of each of its files.
    several = clusters.where("file_pages >= 2").groupBy("side", "cluster").agg((F.sum("n_pages") / F.sum(F.when(F.col("n_pages") >= 3, stretch).otherwise(F.col("file_pages")))).alias("share"))
    running = (
        clusters.where((F.col("n_pages") >= F.when(F.length("cluster") < 2 * LEAST_HEAD, 3).otherwise(2)) & (F.col("n_pages") >= HEAD_SHARE * stretch) & ((F.col("n_pages") >= 3) | (F.col("n_pages") >= HEAD_SHARE * F.col("file_pages"))))
        .join(several.where(F.col("share") >= HEAD_SHARE), ["side", "cluster"]).where("side = 'top' or n_pages >= 3")
    )
    running = cut(running.select("side", "file_path", "key", "line", "n_pages"))
    first_words = F.regexp_replace(F.lower(remove_accents(F.regexp_extract("line", r"^\s*(\S+\s+\S+)", 1))), r"\s+", " ")
    as_head = running.where("side = 'top'").groupBy(first_words.alias("opener")).agg(F.countDistinct("file_path").alias("head_files"), F.sum("n_pages").alias("as_head"))
    in_all = lines.where(F.col("side") == "top").groupBy(first_words.alias("opener")).agg(F.sum("n_pages").alias("in_all"))
    openers = as_head.join(in_all, "opener").where((F.col("opener") != "") & (F.col("head_files") >= OPENER_FILES) & (F.col("as_head") >= 0.6 * F.col("in_all")))
    number = r"^[^\p{L}\p{N}]*(?:(\p{L}[^\s.:]{0,6})[\s.:]+)?(\d{1,6})(?:\s*(?:/|of|0f)\s*\d+)?[^\p{L}\p{N}]*$"
    numbers = edges.where(F.col("line").rlike(number)).select(
        "file_path", "page_index", F.lower(remove_accents(F.regexp_extract("line", number, 1))).alias("word"), (F.regexp_extract("line", number, 2).cast("int") - F.col("page_index")).alias("offset")
    )
    counts = numbers.groupBy("file_path", "offset", "page_index").agg(F.lit(1).alias("one")).groupBy("file_path", "offset").agg(F.count("*").alias("n"))
    best = counts.groupBy("file_path").agg(F.max(F.struct("n", (F.col("offset") == 1).alias("usual"), "offset")).alias("b"))
    offsets = best.where("b.n >= 2 and b.offset <> 1").select("file_path", F.col("b.offset").alias("offset"))
    ahead = offsets.select("file_path", F.col("offset").alias("ahead"))
    along = numbers.where("word <> ''").join(ahead, "file_path", "left").withColumn("along", F.col("offset") == F.coalesce("ahead", F.lit(1)))
    words = along.groupBy("word").agg(F.countDistinct(F.when(F.col("along"), F.col("file_path"))).alias("files"), F.avg(F.col("along").cast("int")).alias("share")).where((F.col("files") >= OPENER_FILES) & (F.col("share") >= 0.5))
    total = F.broadcast(files.agg(F.sum("file_pages").alias("all_pages")))
    of_file = running.groupBy("file_path").agg(F.collect_set(F.when(F.col("side") == "top", F.col("key"))).alias("heads"), F.collect_set(F.when(F.col("side") == "bottom", F.col("key"))).alias("feet"))
    out = of_file.join(offsets, "file_path", "full").join(files, "file_path").join(total).select(
        "file_path", F.coalesce("heads", F.array().cast("array<string>")).alias("heads"), F.coalesce("feet", F.array().cast("array<string>")).alias("feet"),
        F.coalesce("offset", F.lit(1)).alias("offset"), (F.col("file_pages") * HOT >= F.col("all_pages")).alias("hot"),
    )
    return out, _few(openers.select("opener")), _few(words.select("word"))


def _few(rows: DataFrame) -> frozenset[str]:
    out = rows.limit(MAX_OPENERS + 1).collect()
    if len(out) > MAX_OPENERS:
        raise ValueError(f"more than {MAX_OPENERS} {rows.columns[0]}s")
    return frozenset(r[0] for r in out)


def repair(pages: DataFrame, running: DataFrame, words: dict[str, int], openers: frozenset[str] = frozenset(), page_words: frozenset[str] = frozenset()) -> DataFrame:
    """pages (result_id, unit, file_path, page_index, units, positions) -> (result_id, unit, repaired, spots<pos, kind>).

    A page whose units are all null or empty gives an empty text without spots; a null unit counts as empty; a page
    without a file path has no running lines; without a page index, only written-out page numbers count.
    """
    shared = pages.sparkSession.sparkContext.broadcast((words, openers, page_words))
    # Files that hold a good part of all pages are at most HOT: their lines are broadcast, so that no file is one join key
    # for many pages; the others meet by file.
    one = F.struct("heads", "feet", "offset").alias("running")
    hot = F.broadcast(running.where("hot").select("file_path", one).withColumnRenamed("running", "hot_running"))
    cold = running.where("not hot").select(F.col("file_path").alias("k"), one)
    own = F.concat(F.lit("\0"), F.col("result_id").cast("string"))
    keyed = pages.join(hot, "file_path", "left").withColumn("k", F.when(F.col("hot_running").isNull() & F.col("file_path").isNotNull(), F.col("file_path")).otherwise(own))
    joined = keyed.join(cold, "k", "left").withColumn("r", F.coalesce("hot_running", "running")).select("result_id", "unit", "page_index", "units", "positions", "r.heads", "r.feet", "r.offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, first, before = shared.value
        vocabulary = Vocabulary(counts)
        for batch in batches:
            texts, found = [], []
            for index, units, positions, heads, feet, offset in zip(*(batch[c] for c in ("page_index", "units", "positions", "heads", "feet", "offset")), strict=True):
                units = [] if units is None else list(units)
                own = Running() if heads is None else Running(tuple(heads), tuple(feet), int(offset))
                text, spots = repair_page(units, own, None if pd.isna(index) else int(index), vocabulary, first, before)
                texts.append(text)
                found.append([{"pos": int(positions[k]), "kind": kind} for k, kind in spots])
            yield pd.DataFrame({"result_id": batch["result_id"], "unit": batch["unit"], "repaired": texts, "spots": found})

    return joined.mapInPandas(run, "result_id bigint, unit string, repaired string, spots array<struct<pos:int,kind:string>>")


def text_pages(results: DataFrame) -> DataFrame:
    """The lines of full_text as pages; null texts are left out."""
    units = F.split("full_text", "\n")
    return results.where("full_text is not null and result_id is not null").select(
        "result_id", F.lit("line").alias("unit"), "file_path", "page_index", units.alias("units"), F.sequence(F.lit(1), F.size(units)).alias("positions")
    )


def box_pages(boxes: DataFrame, results: DataFrame) -> DataFrame:
    """The boxes of each page in reading order as pages. A page's boxes are few; a page without a result has no index."""
    grouped = (
        boxes.where("page_id is not null and box_id is not null")
        .groupBy(F.col("page_id").alias("result_id"))
        .agg(F.sort_array(F.collect_list(F.struct("box_id", "text"))).alias("b"), F.min("file_path").alias("file_path"))
    )
    index = results.where("result_id is not null").groupBy("result_id").agg(F.min("page_index").alias("page_index"))
    return grouped.join(index, "result_id", "left").select(
        "result_id", F.lit("box").alias("unit"), "file_path", "page_index",
        F.transform("b", lambda x: x["text"]).alias("units"), F.transform("b", lambda x: x["box_id"]).alias("positions"),
    )
