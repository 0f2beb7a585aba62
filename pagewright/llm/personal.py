"""Personal information in free text (problem 3).

Method: information-theoretic sanitisation. How strongly a term reveals a protected entity is estimated from the corpus:

* Words of names: the pointwise mutual information of standing at a place of a person's name (first, middle, last word, taken
  from the values of the field that holds persons) against standing anywhere in the texts. A run of two to four words whose
  disclosure exceeds a threshold is a person; a label or honorific before it lowers the threshold.
* Numbers: phones and identity numbers have written forms, which make candidates only. How often a candidate behind the same words
  is the phone or identity number that the record holds as a protected value tells how much these words disclose; slip,
  account and waybill numbers co-occur with none. Labels known beforehand are a prior that counts outweigh.
* Addresses: places and streets by words learned from the address field. E-mail addresses disclose themselves by their form.

Terms above the thresholds are generalised to typed placeholders; the rest of the text stays.

All counts are made in Spark over all rows and all fields. What goes to the tasks are words of names, and contexts of numbers in
which the decision differs from that of the shorter context; sizes are checked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import remove_accents
from ..plans.persist import cut
from .addressing import PlaceWords, compose, find_addresses, fold_places, joined

#: A word is learned at a place of names where it stands so often.
LEAST_COUNT = 2
#: Words of names, and contexts of numbers, that go to the tasks, at most: more are an error.
MAX_TERMS = 1_000_000
#: Bits that the words of a name must disclose together, and behind a label or honorific.
DISCLOSURE = 6.0
LABELLED = 0.0
#: Smoothed share of a place that a word has which isn't learned there.
RARE = 50_000
#: Fields whose values hold one item as a whole.
WHOLE = {"ho_ten": "person", "sdt": "phone", "fax": "phone", "cccd": "id_number", "email": "email"}
#: Fields whose plain numbers are taken for codes before anything is counted.
CODES = ("so_phieu", "mst")
#: A number is an item if at least this part of those in its context is one (two bits); what is thought of a context before counting, for a
#: form that speaks for an item, one that doesn't, and behind labels; and the observations that this is worth.
TERM_SHARE, LIKELY, UNLIKELY, PRIOR = 0.25, 0.9, 0.05, 20.0
PLACEHOLDER = {"person": "[PERSON]", "phone": "[PHONE]", "email": "[EMAIL]", "id_number": "[ID]", "address": "[ADDRESS]"}

_EMAIL = re.compile(r"(?<![\w.+])[a-z0-9][a-z0-9._+\-]*\s?(?:@|\[at\]|\(at\))\s?[a-z0-9\-]+(?:\.[a-z]{2,}(?![^\W\d_]))+", re.I)
_D = "[0-9oOlI]"
_PHONE = re.compile(
    rf"(?<![\w/.\-+(])(?:\(\s?\+84\s?\)|\+84|\(\s?[0oO]{_D}{{2,3}}\s?\)|[0oO](?=[\s.\-]?[0-9]))(?:[\s.\-]?{_D}){{6,10}}(?![\w/]|[.\-]\d)"
)
_ID12 = re.compile(r"(?<![\w/.\-+])0\d{2}(?:[ .]?\d){9}(?![\w/]|[.\-]\d)")
_ID_SHORT = re.compile(r"(?<![\w/.\-+])(?:[a-z]\s?\d{7}|\d{9}|\d{12}|\d{3}(?:[ .]\d{3}){3}|\d{4}(?: \d{4}){2})(?![\w/]|[.\-]\d)", re.I)
# Labels of identity numbers and of numbers that are nobody's (folded, at the end of what stands before).
_ID_LABEL = re.compile(
    r"(?:cccd|cmnd|cmt|gttt|ho chieu|passport|dinh danh(?: ca nhan)?|can cuoc(?: cong dan)?|giay to(?: tuy than)?|identity card|id card|id no|personal id)"
    r"(?:\s?(?:so|no|number))?[\s:.#(]*$"
)
_CODE_LABEL = re.compile(
    r"(?:so phieu|phieu so|ma van don|van don|mst|ma so thue|tax (?:code|id)|stk|so tk|so tai khoan|tai khoan|account(?: no)?|no\.|so hoa don|ma don|(?<![a-z])so\s?:)[\s:.#]*$"
)
# What announces a person (folded, at the end of what stands before).
_PERSON_LABEL = re.compile(
    r"(?<![a-z])(?:(?:ong|ba|anh|chi|mr|ms|mrs|miss)(?:\s?/\s?(?:ong|ba|anh|chi|mr|ms|mrs|miss))?\.?\s?:?|"
    r"(?:ho (?:va )?ten|ho ten|nguoi (?:nhan|gui|giao|lap|mua|ban|ky|lien he|dai dien)|full name|name|receiver|recipient|sender|contact|attn)\s?:)\s*$"
)
# Words for the level of a place, before its name (folded).
_PLACE_LABEL = re.compile(r"(?<![a-z])(?:tinh|thanh pho|tp|huyen|quan|phuong|thi xa|thi tran|xa)\.?\s*$")
_TITLE = re.compile(r"^(?:ong|ba|anh|chi|co|chu|bac|mr|ms|mrs|miss)\.?\s+", re.I)


@dataclass(frozen=True)
class Item:
    start: int
    end: int
    kind: str


class Names:
    """Bits that a folded word discloses at the first, a middle and the last place of a name.

    A fourth table holds the bits (below 0) of words that are common in texts, for places where they aren't learned;
    words in none of the tables disclose nothing.
    """

    def __init__(self, bits: list[dict[str, float]], least: float = DISCLOSURE) -> None:
        self.bits, self.least = bits[:3], least
        self.common = bits[3] if len(bits) > 3 else {}
        self.words = set().union(*self.bits)

    def disclosed(self, words: list[str]) -> tuple[float, int]:
        """Bits that the words disclose as a name, and how many of them are learned at their place."""
        total, learned = 0.0, 0
        last = len(words) - 1
        for k, w in enumerate(words):
            bits = self.bits[0 if k == 0 else 2 if k == last else 1].get(w)
            if bits is None:
                total += self.common.get(w, 0.0)
            else:
                learned += 1
                total += bits
        return total, learned

    def is_name(self, words: list[str], labelled: bool = False) -> bool:
        """Whether two to four words are a name; without a label, at most one of them may be unknown, and two must be known."""
        return 2 <= len(words) <= 4 and self._enough(*self.disclosed(words), len(words), labelled)

    def _enough(self, total: float, learned: int, n: int, labelled: bool) -> bool:
        return total >= LABELLED if labelled else total >= self.least and learned >= max(2, n - 1)


_CAPITAL = re.compile(r"[^\W\d_]+")
_UPPER = "".join(c for c in map(chr, (*range(0x41, 0x250), *range(0x370, 0x590), *range(0x1E00, 0x1F00))) if c.isupper())
#: Words written with capitals, parted by white space.
_RUN = re.compile(rf"(?<![^\W\d_])[{_UPPER}][^\W\d_]*(?:\s+[{_UPPER}][^\W\d_]*)+")
#: How what stands before a person may end.
_HONORIFICS = frozenset({"ong", "ba", "anh", "chi", "mr", "ms", "mrs", "miss"})
_BEFORE = (":", ".", "ong", "ba", "anh", "chi", "mr", "ms", "mrs", "miss")


def find_names(line: str, folded: str, taken: bytearray, names: Names, person: bool = False) -> list[tuple[int, int]]:
    """Places of the names in a line, at characters that aren't taken; of names that overlap, the one that discloses most.

    Words of a name are parted by white space; a word that isn't learned belongs to it only over a single space, as the
    next column or line of a page is no part of it. The start of a line that is to hold a person counts as labelled.
    """
    options = []
    for run in _RUN.finditer(line):
        tokens = [t.span() for t in _CAPITAL.finditer(line, run.start(), run.end())]
        if any(taken[run.start() : run.end()]):
            tokens = [(x, y) for x, y in tokens if not any(taken[x:y])]
        every = [folded[x:y] for x, y in tokens]
        known = [w in names.words for w in every]
        if sum(known) < 2 and not person and not folded[max(0, run.start() - 8) : run.start()].rstrip().endswith(_BEFORE) and _HONORIFICS.isdisjoint(every):
            continue
        for k, (start, end) in enumerate(tokens[:-1]):
            before = folded[max(0, start - 32) : start].rstrip()
            labelled = (before.endswith(_BEFORE) and bool(_PERSON_LABEL.search(folded[max(0, start - 32) : start]))) or (person and not before and not line[:start].strip())
            if not labelled and (sum(known[k : k + 4]) < 2 or _PLACE_LABEL.search(before)):
                continue
            words, near = [every[k]], True
            for w, (x, y) in zip(every[k + 1 : k + 4], tokens[k + 1 : k + 4], strict=True):
                gap = line[end:x]
                if not gap.isspace():
                    break
                near = near and gap == " "
                words.append(w)
                end = y
                total, learned = names.disclosed(words)
                if (near or learned == len(words)) and names._enough(total, learned, len(words), labelled):
                    options.append((-total, not labelled, -start, -end))
    found: list[tuple[int, int]] = []
    for _, _, start, end in sorted(options):
        if all(-end <= x or -start >= y for x, y in found):
            found.append((-start, -end))
    return found


@dataclass(frozen=True)
class Number:
    """A candidate: what it would be, where it stands, how it is written, what is thought of it beforehand, and the words before it."""

    kind: str
    start: int
    end: int
    shape: str
    prior: str
    word: str
    words: str


_LETTERS, _DIGIT = re.compile(r"[a-z]+"), re.compile(r"\d")


def find_numbers(line: str, folded: str, field: str) -> list[Number]:
    """Candidates for identity numbers and phones, the longer forms first."""
    found: list[Number] = []

    def put(kind: str, start: int, end: int, shape: str, likely: bool) -> None:
        before = folded[max(0, start - 40) : start]
        words = _LETTERS.findall(before)[-2:] or [f"@{field}"]
        if kind == "id_number" and _ID_LABEL.search(before):
            prior = "label"
        elif _CODE_LABEL.search(before) or (field in CODES and shape == "plain"):
            prior = "code"
        else:
            prior = "label" if likely else "none"
        found.append(Number(kind, start, end, shape, prior, words[-1], " ".join(words)))

    if not _DIGIT.search(line):
        return found
    for m in _ID12.finditer(line):
        if len(m[0]) - len(_DIGIT.sub("", m[0])) == 12:
            put("id_number", m.start(), m.end(), "plain" if m[0].isdigit() else "grouped", True)
    for m in _ID_SHORT.finditer(line):
        put("id_number", m.start(), m.end(), "plain" if m[0].isalnum() else "grouped", field == "cccd")
    for m in _PHONE.finditer(line):
        places = [m.start() + k for k, c in enumerate(m[0]) if c.isalnum()]
        # What follows on the next line may look like more digits: a number has 10 (11 on a land line), or 9 after +84.
        country = "+84" in m[0]
        full = 11 if country else 11 if re.match(r"\(?[0oO]2", m[0]) else 10
        if full - 1 <= len(places) <= full + 1:
            put("phone", m.start(), places[min(full, len(places)) - 1] + 1, "plain" if m[0].isalnum() else "grouped", True)
    return found


def is_item(n: Number, contexts: dict[tuple[str, ...], bool]) -> bool:
    """Whether a candidate discloses a person, by the longest context that says other than the shorter one."""
    key = (n.kind, n.shape, n.prior)
    return contexts.get((*key, n.words), contexts.get((*key, n.word), n.prior == "label"))


@dataclass
class Draft:
    """What a text holds for sure, and the numbers that may be items; places are those of the text in composed form, from 0."""

    items: list[Item]
    numbers: list[Number]

    def settled(self, contexts: dict[tuple[str, ...], bool]) -> list[Item]:
        """The items, with the numbers that their contexts speak for; of numbers at one place the first."""
        out = list(self.items)
        for n in self.numbers:
            if is_item(n, contexts) and all(n.end <= i.start or n.start >= i.end for i in out):
                out.append(Item(n.start, n.end, n.kind))
        return sorted(out, key=lambda i: i.start)


def draft(text: str, names: Names, words: PlaceWords, field: str = "full_text") -> Draft:
    """Look for items in a text; null and blank texts have none.

    A field that holds one item as a whole has it even where its form is unknown, as long as it holds a letter or digit of the right
    kind; its numbers need no context.
    """
    if not text or not text.strip():
        return Draft([], [])
    line, at = joined(text)
    folded = fold_places(line)
    taken = bytearray(len(line) + 1)
    found: list[Item] = []

    def take(start: int, end: int, kind: str) -> None:
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            found.append(Item(at[start], at[end - 1] + 1, kind))

    if "@" in line or "[at]" in folded or "(at)" in folded:
        for m in _EMAIL.finditer(line):
            take(m.start(), m.end(), "email")
    for a in find_addresses(line, words, folded):
        take(a.start, a.end, "address")
    numbers = find_numbers(line, folded, field)
    if field in WHOLE:
        for n in numbers:
            if is_item(n, {}):
                take(n.start, n.end, n.kind)
        numbers = []
    people = find_names(line, folded, taken, names, WHOLE.get(field) == "person")
    for x, y in people:  # a part of a value that may be a name as a whole must be known for certain
        if WHOLE.get(field) != "person" or names.disclosed(w := folded[x:y].split())[1] == len(w) >= 3:
            take(x, y, "person")
    if field in WHOLE and not found:
        body = line.strip()
        lead = len(line) - len(line.lstrip())
        kind = WHOLE[field]
        fits = {
            "person": len(body.split()) in (2, 3, 4) and not re.search(r"[\d?/]", body) and all(w[:1].isupper() for w in body.split()),
            "email": bool(re.search(r"@|\[at\]", body)),
            "phone": sum(c.isdigit() for c in body) >= 8,
            "id_number": sum(c.isdigit() for c in body) >= 7,
        }[kind]
        if fits:
            lead += len(m[0]) if kind == "person" and (m := _TITLE.match(body)) else 0
            take(lead, len(line.rstrip()), kind)
        for x, y in people:
            take(x, y, "person")
    return Draft(found, [replace(n, start=at[n.start], end=at[n.end - 1] + 1) for n in numbers if not any(taken[n.start : n.end])])


def find_items(text: str, names: Names, words: PlaceWords, field: str = "full_text", contexts: dict[tuple[str, ...], bool] | None = None) -> list[Item]:
    """The personal items of a text; contexts are those of learn_contexts()."""
    return draft(text, names, words, field).settled(contexts or {})


def masked(text: str, items: list[Item]) -> str:
    """The text with a typed placeholder for each item."""
    out, at = [], 0
    for i in items:
        out += [text[at : i.start], PLACEHOLDER[i.kind]]
        at = i.end
    return "".join(out) + text[at:]


def learn_names(results: DataFrame, field: str = "ho_ten", column: str = "extracted_fields", text: str = "full_text") -> list[dict[str, float]]:
    """For the first, a middle and the last place of a name of two to four words: folded word -> bits it discloses there.

    bits = log2(share of the word at that place of names / share of the word in all texts), over all rows, for words that stand
    there LEAST_COUNT times. The last table has the bits of words for places where they aren't learned, log2(1 / RARE / share of
    the word in all texts), where these are below 0, so of at most RARE words.
    """
    fold = lambda c: F.lower(remove_accents(c))
    name = F.split(F.trim(fold(F.regexp_replace(F.col(column)[field], r"\s+", " "))), " ")
    put = lambda place, w: F.struct(place.alias("place"), w.alias("w"))
    last = F.size("n") - 1
    at_places = F.when(F.size("n").between(2, 4), F.transform("n", lambda w, i: put(F.when(i == 0, 0).when(i == last, 2).otherwise(1), w)))
    anywhere = F.transform(F.split(fold(F.col(text)), "[^a-z]+"), lambda w: put(F.lit(3), w))
    none = F.array().cast("array<struct<place:int,w:string>>")
    rows = results.select(name.alias("n"), text).select(F.explode(F.concat(F.coalesce(at_places, none), F.coalesce(anywhere, none))).alias("x"))
    counted = cut(rows.where("x.w rlike '^[a-z]+$'").groupBy("x.place", "x.w").count())
    totals = {r["place"]: r["n"] for r in counted.groupBy("place").agg(F.sum("count").alias("n")).collect()}
    corpus = totals.get(3, 0)
    everywhere = counted.where("place = 3").select("w", F.col("count").alias("everywhere"))
    share = F.lit(0.0)
    for place in range(3):
        share = F.when(F.col("place") == place, F.col("count") / F.lit(float(totals.get(place, 1)))).otherwise(share)
    learned = counted.where((F.col("place") < 3) & (F.col("count") >= LEAST_COUNT)).join(everywhere, "w", "left")
    rows = learned.select("place", "w", F.log2(share / ((F.coalesce("everywhere", F.lit(0)) + 1) / F.lit(corpus + 1.0))).alias("bits"))
    common = everywhere.where(F.col("everywhere") * F.lit(RARE) > F.lit(corpus)).select(F.lit(3).alias("place"), "w", F.log2(F.lit(corpus / RARE) / F.col("everywhere")).alias("bits"))
    out: list[dict[str, float]] = [{}, {}, {}, {}]
    for r in _bounded(rows.union(common)):
        out[r["place"]][r["w"]] = r["bits"]
    return out


def _bounded(rows: DataFrame) -> list:
    out = rows.limit(MAX_TERMS + 1).collect()
    if len(out) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} learned terms")
    return out


#: Fields that hold protected numbers, by kind.
_PROTECTED = {"sdt": "phone", "fax": "phone", "cccd": "id_number"}
_LIKE_DIGITS = str.maketrans("oOlI", "0011")


def _digits(text: str) -> str:
    return "".join(c for c in text.translate(_LIKE_DIGITS) if c.isdigit())[-9:]


_ITEM = "array<struct<kind:string,start:int,end:int>>"
_NUMBER = "array<struct<kind:string,start:int,end:int,shape:string,prior:string,word:string,words:string,hit:boolean>>"


def drafts(results: DataFrame, bits: list[dict[str, float]], words: PlaceWords, column: str = "extracted_fields", text: str = "full_text") -> DataFrame:
    """(result_id, field_name, text, items, numbers) of every text and map value that holds text, the text in composed form.

    A number is a hit if it is the protected value of its kind that its record holds. Null and blank values give no rows; a result
    without a map has its text only.
    """
    shared = results.sparkSession.sparkContext.broadcast((bits, words.places, words.streets))
    rows = results.where("result_id is not null").select("result_id", F.col(text).alias("t"), F.coalesce(F.map_entries(column), F.array().cast("array<struct<key:string,value:string>>")).alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b, places, streets = shared.value
        names, known = Names(b), PlaceWords(places, streets)
        for batch in batches:
            out = []
            for rid, t, entries in zip(batch["result_id"].tolist(), batch["t"].tolist(), batch["e"].tolist(), strict=True):
                own: dict[str, set[str]] = {"phone": set(), "id_number": set()}
                for e in entries:
                    if e["value"] and (kind := _PROTECTED.get(e["key"])):
                        own[kind].add(_digits(e["value"]))
                for field, v in (("full_text", t), *((e["key"], e["value"]) for e in entries)):
                    if not v or not v.strip():
                        continue
                    c = compose(v)
                    d = draft(c, names, known, field)
                    numbers = [(n.kind, n.start, n.end, n.shape, n.prior, n.word, n.words, _digits(c[n.start : n.end]) in own[n.kind]) for n in d.numbers]
                    out.append((rid, field, c, [(i.kind, i.start, i.end) for i in d.items], numbers))
            yield pd.DataFrame(out, columns=["result_id", "field_name", "text", "items", "numbers"])

    return rows.mapInPandas(run, f"result_id bigint, field_name string, text string, items {_ITEM}, numbers {_NUMBER}")


def learn_contexts(drafted: DataFrame) -> dict[tuple[str, ...], bool]:
    """(kind, shape, prior, words before) -> whether numbers there are items, for contexts that say other than the shorter one.

    Over the drafts of all texts and values: the candidates in a context that are the protected value of their record (hits) are counted. As
    not every record holds what its text mentions, hits are set against the share of hits in contexts that have any.
    """
    key = ["kind", "shape", "prior"]
    numbers = drafted.select(F.explode("numbers").alias("x")).select("x.*")
    whole = cut(numbers.groupBy(*key, "word", "words").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")))
    short = whole.groupBy(*key, "word").agg(F.sum("n").alias("n1"), F.sum("hits").alias("h1"))
    held = F.broadcast(short.where("h1 > 0").groupBy("kind").agg((F.sum("h1") / F.sum("n1")).alias("held")))
    before = F.when(F.col("prior") == "label", LIKELY).otherwise(UNLIKELY)
    share = lambda hits, n, prior: (F.col(hits) / F.coalesce("held", F.lit(1.0)) + PRIOR * prior) / (F.col(n) + PRIOR)
    short = short.join(held, "kind", "left").withColumn("q0", before).withColumn("q1", share("h1", "n1", F.col("q0")))
    long = whole.where("words <> word").join(short, [*key, "word"]).withColumn("q2", share("hits", "n", F.col("q1")))
    flips = lambda t, now, was, c: t.where((F.col(now) >= TERM_SHARE) != (F.col(was) >= TERM_SHARE)).select(*key, F.col(c).alias("context"), (F.col(now) >= TERM_SHARE).alias("item"))
    return {(r["kind"], r["shape"], r["prior"], r["context"]): r["item"] for r in _bounded(flips(short, "q1", "q0", "word").union(flips(long, "q2", "q1", "words")))}


def settle(drafted: DataFrame, contexts: dict[tuple[str, ...], bool], texts: bool = True) -> DataFrame:
    """(result_id, field_name, [masked,] items<kind, start_pos, end_pos>): drafts with their numbers judged by context.

    start_pos counts characters from 1, end_pos is the last character. Only drafts that hold numbers leave the JVM, without their texts'
    being touched.
    """
    shared = drafted.sparkSession.sparkContext.broadcast(contexts)
    columns = ["result_id", "field_name", *(["text"] if texts else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            found = []
            for items, numbers in zip(b["items"].tolist(), b["numbers"].tolist(), strict=True):
                sure = [Item(i["start"], i["end"], i["kind"]) for i in items]
                found.append(Draft(sure, [Number(*(n[c] for c in ("kind", "start", "end", "shape", "prior", "word", "words"))) for n in numbers]).settled(known))
            yield b[columns].assign(items=[[(i.kind, i.start + 1, i.end) for i in f] for f in found])

    schema = f"result_id bigint, field_name string, {'text string, ' if texts else ''}items array<struct<kind:string,start_pos:int,end_pos:int>>"
    plain = F.transform("items", lambda i: F.struct(i["kind"].alias("kind"), (i["start"] + 1).alias("start_pos"), i["end"].alias("end_pos")))
    ordered = F.array_sort(plain, lambda x, y: x["start_pos"] - y["start_pos"])
    sure = drafted.where(F.size("numbers") == 0).select(*columns, ordered.alias("items"))
    both = sure.union(drafted.where(F.size("numbers") > 0).select(*columns, "items", "numbers").mapInPandas(run, schema))
    return both.select("result_id", "field_name", mask(F.col("text"), F.col("items")).alias("masked"), "items") if texts else both


def mask(text: Column, items: Column) -> Column:
    """masked() as an expression, of items<kind, start_pos, end_pos> in order."""
    names = F.create_map(*[F.lit(x) for item in PLACEHOLDER.items() for x in item])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    put = lambda a, i: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, i["start_pos"] - a["at"] - 1), names[i["kind"]]).alias("out"), i["end_pos"].alias("at"))
    return F.aggregate(items, start, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def scan(results: DataFrame, bits: list[dict[str, float]], words: PlaceWords, texts: bool = True) -> DataFrame:
    """Drafts of all texts and values, settled by the contexts learned from them; see drafts() and settle()."""
    drafted = cut(drafts(results, bits, words))
    return settle(drafted, learn_contexts(drafted), texts)
