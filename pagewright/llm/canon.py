"""Mapping freely typed values to a reference list (problem 1).

Method: a trie of the reference entries, with alias paths (abbreviated and decorated forms), is searched with a
Levenshtein automaton: a depth-first walk that carries the row of edit distances (swaps of neighbours count once) and
leaves a branch when no cell is within the limit. The limit depends on the length of the entry. All entries within the
limit come out of search(); match() takes the nearest.

A value is no misspelling of an entry if the words in which they differ are common words of their own: word counts
over all values are made in Spark. To the tasks go the words that the decision needs, those with a share of OWN_SHARE or more of
their field, at most 1 / OWN_SHARE of them, and the words of the entries. The reference list is checked to be small.

Alias paths: words that may decorate any value of a field are those that stand before or after a good part of its entries in
the corpus (see learn_decorations()), beside some stated below; job titles are abbreviated by a rule, see abbreviations().
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import remove_accents
from ..plans.persist import cut
from .textkit import osa_distance, strip_marks

MAX_ENTRIES = 100_000
#: What stands beside this part of a field's entries, and beside so many, is a decoration.
DECORATED, LEAST_DECORATED = 0.25, 3
#: A word of a value counts as a word of its own beside the entry's if it is at least so common against it, in the field.
OWN_WORD = 0.05
#: ... and makes up at least this share of the field's words.
OWN_SHARE = 0.0008

# Words that may stand before or after a value of a field (folded, only letters).
DECORATIONS = {
    "tinh_thanh": (("tinh", "thanhpho", "tp", "t"), ("province", "tinh", "vn", "vietnam")),
    "hang_may": (("hieu", "hang", "may", "hangmay"), ("coltd", "corp", "co", "ltd", "inc")),
    "chuc_danh": (("chucvu", "chucdanh"), ()),
}
#: Fields whose values are abbreviated word by word.
ABBREVIATED = ("chuc_danh",)


def limit_for(length: int) -> int:
    """Edits allowed for an entry of so many letters."""
    return 0 if length <= 3 else 1 if length <= 5 else 2 if length <= 13 else 3


def compact(text: str) -> str:
    """Folded text without white space and punctuation; signs that stand for letters stay."""
    return "".join(c for c in strip_marks(text) if c.isalnum() or c in "@$|")


def words_of_value(value: str) -> list[str]:
    """The words of a value, without marks and punctuation."""
    value = re.sub(r"[®™()\[\]{}\"'“”*]", " ", value).strip()
    return [w for w in re.split(r"[\s,;:._/\-]+", value) if w]


def abbreviations(name: str) -> set[str]:
    """Forms of a folded name: runs of two words or more given by their initials, the first word by its first consonants."""
    words = name.split()

    def forms(k: int) -> list[list[str]]:
        if k == len(words):
            return [[]]
        out = [[words[k], *rest] for rest in forms(k + 1)]
        for e in range(k + 2, len(words) + 1):
            out += [["".join(w[0] for w in words[k:e]), *rest] for rest in forms(e)]
        return out

    found = {" ".join(f) for f in forms(0)}
    onset = re.match(r"[b-df-hj-np-tv-xz]{2,}", words[0]) if len(words) > 1 else None
    return found | ({" ".join([onset[0], *f]) for f in forms(1)} if onset else set())


class Trie:
    """Words with the entries they lead to: (entry, limit) at each end."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def add(self, word: str, entry: int, limit: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        ends = node.setdefault("", {})
        ends[entry] = max(limit, ends.get(entry, 0))
        self.size += 1

    def exact(self, word: str) -> set[int]:
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return set()
        return set(node.get("", ()))

    def search(self, word: str, most: int) -> dict[int, int]:
        """Entry -> least distance, of all entries within their own limit and most."""
        found: dict[int, int] = {}
        n = len(word)

        def walk(node: dict, row: list[int], before: list[int] | None, last: str) -> None:
            for entry, limit in node.get("", {}).items():
                if row[n] <= min(limit, most) and row[n] < found.get(entry, 99):
                    found[entry] = row[n]
            for c, child in node.items():
                if not c:
                    continue
                left = row[0] + 1
                new = [left]
                low = left
                for j in range(1, n + 1):
                    x = word[j - 1]
                    v = row[j - 1] if x == c else 1 + min(row[j - 1], row[j], left)
                    if before is not None and j > 1 and x == last and word[j - 2] == c and before[j - 2] + 1 < v:
                        v = before[j - 2] + 1
                    left = v
                    new.append(v)
                    if v < low:
                        low = v
                if low <= most:
                    walk(child, new, row, c)

        walk(self.root, list(range(n + 1)), None, "")
        return found


class Canon:
    """The entries of one field, ready to match."""

    def __init__(self, field: str, entries: Iterable[tuple[int, str]], counts: WordCounts | None = None, decorations: tuple[Iterable[str], Iterable[str]] = ((), ())) -> None:
        self.names = {i: name for i, name in entries}
        self.counts, self.folded, total = counts or ({}, {}, 0)
        self.least = OWN_SHARE * total
        before, after = DECORATIONS.get(field, ((), ()))
        self.before = sorted({*before, *decorations[0]}, key=len, reverse=True)
        self.after = sorted({*after, *decorations[1]}, key=len, reverse=True)
        self.trie = Trie()
        of: dict[str, set[int]] = {}
        for i, name in self.names.items():
            plain = " ".join(strip_marks(name).split())
            for form in {plain, *(abbreviations(plain) if field in ABBREVIATED and plain else ())}:
                of.setdefault(compact(form), set()).add(i)
        whole = {compact(n): i for i, n in self.names.items()}
        for word, ids in of.items():
            if not word or (len(ids) > 1 and word not in whole):  # an abbreviation that several entries share says nothing
                continue
            limit = limit_for(len(word))
            for i in ids:
                self.trie.add(word, i, limit)
                for d in self.before:
                    self.trie.add(d + word, i, limit)
                for d in self.after:
                    self.trie.add(word + d, i, limit)
        self.match = lru_cache(200_000)(self._match)

    def bare(self, value: str) -> str:
        """The value in lower case, without marks of decoration and without decorating words, however many."""
        words = words_of_value(value)
        changed = True
        while changed and len(words) > 1:
            changed = False
            for k in (2, 1):  # a decoration may be two words (Co., Ltd)
                if len(words) > k and compact("".join(words[:k])) in self.before:
                    words, changed = words[k:], True
                elif len(words) > k and compact("".join(words[-k:])) in self.after:
                    words, changed = words[:-k], True
        return " ".join(words).lower()

    def search(self, value: str) -> dict[int, int]:
        """Entry -> distance, of all entries within their length-dependent distance."""
        word = compact(self.bare(value))
        if not word:
            return {}
        exact = self.trie.exact(word) or self.trie.exact(compact(value))
        if exact:
            return dict.fromkeys(exact, 0)
        return self.trie.search(word, limit_for(len(word) + 3))

    def _differs(self, bare: str, entry: int) -> bool:
        """Whether the words in which the value differs from the entry are common words of their own."""
        mine, own = bare.split(), self.names[entry].lower().split()
        if len(mine) != len(own):
            return False
        folded = strip_marks(bare) == bare
        different = 0
        for a, b in zip(mine, own, strict=True):
            fa, fb = strip_marks(a), strip_marks(b)
            if fa == fb:
                continue
            seen, usual = (self.folded.get(fa, 0), self.folded.get(fb, 1)) if folded else (self.counts.get(a, 0), self.counts.get(b, 1))
            if seen < max(OWN_WORD * usual, self.least):
                return False
            different += 1
        return different > 0

    def _match(self, value: str) -> int:
        """The nearest entry, or -1. Of equally near ones, that whose letters with accents are nearer, then the first."""
        bare = self.bare(value)
        found = {e: d for e, d in self.search(value).items() if d == 0 or not self._differs(bare, e)}
        if not found:
            return -1
        near = min(found.values())
        return min(
            (e for e, d in found.items() if d == near), key=lambda e: (osa_distance(bare, self.names[e].lower(), 9), e)
        )


#: Counts of words as written and of folded words, and the number of all words, of a field.
WordCounts = tuple[dict[str, int], dict[str, int], int]
Entry = tuple[int, str, str]


def entries(reference: DataFrame) -> list[Entry]:
    """(ref_id, field_name, canonical) of the reference list, after a check of its size; rows with a null are left out."""
    rows = reference.where("canonical is not null and field_name is not null and ref_id is not null").select("ref_id", "field_name", "canonical").distinct()
    out = rows.limit(MAX_ENTRIES + 1).collect()
    if len(out) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} reference entries")
    return sorted(tuple(r) for r in out)


def word_counts(values: DataFrame, listed: list[Entry]) -> dict[str, WordCounts]:
    """Field -> counts of its words over all values (field_name, value), of those that a decision may need.

    These are the words that make up OWN_SHARE of a field's words, at most 1 / OWN_SHARE of them, and those of the entries.
    """
    words = values.select(F.col("field_name").alias("f"), F.explode(F.split(F.lower(F.col("value")), "[\\s,;:._/\\-()]+")).alias("w")).where("w <> ''")
    counted = words.groupBy("f", "w").agg(F.count("*").alias("n"))
    both = counted.select("f", F.explode(F.array(
        F.struct(F.lit("as written").alias("form"), F.col("w").alias("w")), F.struct(F.lit("folded").alias("form"), F.lower(remove_accents("w")).alias("w")), F.struct(F.lit("all").alias("form"), F.lit("").alias("w")),
    )).alias("x"), "n").groupBy("f", "x.form", "x.w").agg(F.sum("n").alias("n"))
    both = cut(both)
    total = F.broadcast(both.where("form = 'all'").select("f", F.col("n").alias("total")))
    needed = {(f, form, w) for _, f, name in listed for form, text in (("as written", name.lower()), ("folded", strip_marks(name))) for w in text.split()}
    listed_words = values.sparkSession.createDataFrame(sorted(needed), "f string, form string, w string").withColumn("listed", F.lit(True)) if needed else None
    kept = both.join(total, "f")
    if listed_words is not None:
        kept = kept.join(F.broadcast(listed_words), ["f", "form", "w"], "left")
    else:
        kept = kept.withColumn("listed", F.lit(None).cast("boolean"))
    out: dict[str, WordCounts] = {}
    for r in kept.where((F.col("n") >= OWN_SHARE * F.col("total")) | F.col("listed")).collect():
        written, folded, n = out.setdefault(r["f"], ({}, {}, r["total"]))
        if r["form"] != "all":
            (written if r["form"] == "as written" else folded)[r["w"]] = r["n"]
    return out


def learn_decorations(values: DataFrame, listed: list[Entry]) -> dict[str, tuple[set[str], set[str]]]:
    """Field -> what may stand before and after its entries: what stands in the corpus beside DECORATED of them, and LEAST_DECORATED."""
    forms: dict[str, dict[str, int]] = {}
    for i, f, name in listed:
        forms.setdefault(f, {})[compact(name)] = i
    shared = values.sparkSession.sparkContext.broadcast(forms)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = set()
            for f, v in zip(b["field_name"], b["value"], strict=True):
                words = [compact(w) for w in words_of_value(v)]
                own, n = shared.value.get(f, {}), len(words)
                run = next(((k, k + size) for size in range(n - 1, 0, -1) for k in range(n - size + 1) if "".join(words[k : k + size]) in own), None)
                if run:
                    entry = own["".join(words[run[0] : run[1]])]
                    found |= {(f, side, part, entry) for side, part in (("before", "".join(words[: run[0]])), ("after", "".join(words[run[1] :]))) if part}
            yield pd.DataFrame(list(found), columns=["field_name", "side", "part", "entry"])

    beside = values.mapInPandas(find, "field_name string, side string, part string, entry int").groupBy("field_name", "side", "part").agg(F.countDistinct("entry").alias("n"))
    n_entries = F.create_map(*[F.lit(x) for f, own in forms.items() for x in (f, len(own))]) if forms else F.create_map().cast("map<string,int>")
    usual = beside.where((F.col("n") >= LEAST_DECORATED) & (F.col("n") >= DECORATED * n_entries[F.col("field_name")])).limit(MAX_ENTRIES + 1).collect()
    if len(usual) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} decorations")
    out: dict[str, tuple[set[str], set[str]]] = {f: (set(), set()) for f in forms}
    for r in usual:
        out[r["field_name"]][r["side"] == "after"].add(r["part"])
    return out


def field_values(results: DataFrame, fields: list[str] | None = None, key: str = "result_id", column: str = "extracted_fields") -> DataFrame:
    """(result_id, field_name, value) of the non-blank map values; null maps, null keys and blank values give no rows."""
    values = results.select(key, F.explode(column).alias("field_name", "value")).where(F.col("value").rlike("\\S"))
    return values.where(F.col("field_name").isin(*fields)) if fields else values


def map_values(
    values: DataFrame, listed: list[Entry], counts: dict[str, WordCounts], keys: list[str], decorations: dict[str, tuple[set[str], set[str]]] | None = None
) -> DataFrame:
    """(keys..., field_name, ref_id): each value with its entry of the same field, -1 if it stands for none.

    Rows are matched where they lie, without a shuffle; equal values of a task are matched once. Values of a field
    without entries get -1; blank and null values are left out. listed is that of entries().
    """
    shared = values.sparkSession.sparkContext.broadcast((listed, counts, decorations or {}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, words, beside = shared.value
        canons = {f: Canon(f, [(i, n) for i, g, n in rows if g == f], words.get(f), beside.get(f, ((), ()))) for f in {g for _, g, _ in rows}}
        for batch in batches:
            out = batch[[*keys, "field_name"]].copy()
            out["ref_id"] = [
                canons[f].match(v) if f in canons else -1
                for f, v in zip(batch["field_name"].tolist(), batch["value"].tolist(), strict=True)
            ]
            yield out

    schema = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
    return (
        values.where(F.col("value").rlike("\\S"))
        .select(*keys, "field_name", "value")
        .mapInPandas(run, f"{schema}, field_name string, ref_id int")
    )


def unmatched(values: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    """(field_name, value, n): the values that stand for no entry, with their counts."""
    return (
        values.join(mapped.where("ref_id = -1"), [*keys, "field_name"], "left_semi")
        .groupBy("field_name", F.trim("value").alias("value")).agg(F.count("*").alias("n"))
    )
