"""Same or near-same records across splits (problem 5).

Method: a compressed full-text index (FM index: Burrows-Wheeler transform with bit-packed ranks, numpy) of each shard
of the evaluation texts, labels and paths alike; the texts of train stream through backward search, a shard at a time. Their
maximal matches with a record are merged into spans and counted; the records are compared where spans leave gaps.

Two labels count as the same if their letters, without case, accents, spaces and signs, are within EDITS of each other
and their digits are equal. Two paths count as the same if the folders and the name of one are the last ones of the other.

Shards lose no pair. Paths go by their last folder and name. Labels with digits go by their digits, unless more than HOT labels
share these; those and labels without digits go by their EDITS * (GRAM + 1) + 1 rarest letter groups and by their length: two
labels within EDITS share one of these groups (prefix filter; a swap of letters changes GRAM + 1 groups) and differ by at most
EDITS in length. Shards that are too large all the same are split into a grid of train parts and evaluation parts, so that no task
holds more than PART texts of either side. Distinct texts are matched, not rows.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_key
from ..plans.persist import cut
from .textkit import osa_distance

#: Letters that may differ: two for each of two rewritings.
EDITS = 4
GRAM = 3
#: Characters from which a label says enough to be compared.
LEAST_CHARS = 30
#: Texts of a shard, about, and at most of either side in a task.
SHARD_ROWS, PART = 20_000, 50_000
#: Labels of the same digits from which letters tell them apart, in routing and in a shard.
HOT, FEW = 1_000, 32
#: Lengths of labels that share a shard.
LENGTHS = 16
_SYMBOLS = 40  # 0 end of record, 1 mark before the digits, 2..27 letters, 28..37 digits


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (max(n, int(text.max(initial=0))) + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        rank = fresh
        step *= 2
        if rank.max() == n - 1 or step >= n:
            return order


class FullTextIndex:
    """FM index of records; counts and locates patterns for many queries at once."""

    def __init__(self, records: list[np.ndarray], symbols: int = _SYMBOLS) -> None:
        lengths = np.array([len(r) for r in records])
        self.starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(records) else np.array([], np.int64)
        text = np.concatenate(records)
        n = len(text)
        self.sa = suffix_array(text)
        bwt = text[self.sa - 1]
        counts = np.bincount(text, minlength=symbols)
        self.c = np.r_[0, np.cumsum(counts)[:-1]]
        blocks = n // 64 + 1
        padded = np.full(blocks * 64, 65535, np.uint16)
        padded[:n] = bwt
        grid = padded.reshape(blocks, 64)
        self.bits = np.zeros((blocks, symbols), np.uint64)
        self.before = np.zeros((blocks, symbols), np.int32)
        for s in range(symbols):
            if counts[s]:
                hit = grid == s
                self.bits[:, s] = np.packbits(hit, axis=1, bitorder="little").view(np.uint64)[:, 0]
                self.before[1:, s] = np.cumsum(hit.sum(1))[:-1]
        self.n = n

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, inside = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << inside) - np.uint64(1)
        return self.before[block, symbol] + np.bitwise_count(self.bits[block, symbol] & mask).astype(np.int64)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        return self.c[symbol] + self.rank(symbol, lo), self.c[symbol] + self.rank(symbol, hi)

    def record_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def located(self, lo: np.ndarray, hi: np.ndarray, block: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the interval, place in the text) of all occurrences in intervals, a block of them at a time."""
        count = np.maximum(hi - lo, 0)
        ends = np.cumsum(count)
        k = 0
        while k < len(count):
            e = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + block, side="right")))
            c = count[k:e]
            yield np.repeat(np.arange(k, e), c), self.sa[np.repeat(lo[k:e] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            k = e


#: Symbol of each byte: the end, the mark, letters, digits.
_CODES = np.zeros(128, np.uint8)
_CODES[1], _CODES[97:123], _CODES[48:58] = 1, np.arange(2, 28), np.arange(28, 38)


def encode(label: str) -> np.ndarray:
    """Symbols of a folded label: its letters, then the mark, its digits in order, and the end."""
    letters, digits = _split(label)
    return _CODES[np.frombuffer(f"{letters}\1{digits}\0".encode("ascii"), np.uint8)]


def _cut(index: FullTextIndex, texts: list[np.ndarray], most: int) -> tuple[np.ndarray, ...]:
    """Cut every text from its end into pieces that occur at most `most` times: arrays text, start, end, lo, hi, swapped lo, hi.

    A piece grows to the left until it is rare enough or the text begins; a piece that stays common is given too. The swapped
    interval is that of the piece with its first letter replaced by the one before it: a swap of the two leaves the rest intact.
    """
    m = len(texts)
    length = np.array([len(t) for t in texts])
    flat, base = np.concatenate(texts), np.r_[0, np.cumsum(length)[:-1]]
    lo, hi, end = np.zeros(m, np.int64), np.full(m, index.n, np.int64), length.copy()
    out: list[tuple[np.ndarray, ...]] = []
    for step in range(int(length.max(initial=0))):
        live = np.flatnonzero(length > step)
        pos = length[live] - 1 - step
        was_lo, was_hi = lo[live], hi[live]
        lo[live], hi[live] = index.extend(was_lo, was_hi, flat[base[live] + pos])
        done = (hi[live] - lo[live] <= most) | (pos == 0)
        cut_, at = live[done], pos[done]
        swap_lo, swap_hi = index.extend(was_lo[done], was_hi[done], flat[base[cut_] + np.maximum(at - 1, 0)])
        swap_hi = np.where(at > 0, swap_hi, swap_lo)
        out.append((cut_, at, end[cut_].copy(), lo[cut_].copy(), hi[cut_].copy(), swap_lo, swap_hi))
        lo[cut_], hi[cut_], end[cut_] = 0, index.n, at
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.array([], np.int64),) * 7


def _equal_pieces(index: FullTextIndex, texts: list[np.ndarray], pieces: int) -> tuple[np.ndarray, ...]:
    """Cut every text into equal pieces, whatever their number of occurrences; arrays as those of _cut()."""
    length = np.array([len(t) for t in texts])
    flat, base = np.concatenate(texts), np.r_[0, np.cumsum(length)[:-1]]
    edges = (length[:, None] * np.arange(pieces + 1)[None]) // pieces
    of = np.repeat(np.arange(len(texts)), pieces)
    start, end = edges[:, :-1].ravel(), edges[:, 1:].ravel()
    full = end > start
    of, start, end = of[full], start[full], end[full]
    lo, hi = np.zeros(len(of), np.int64), np.full(len(of), index.n, np.int64)
    swap_lo, swap_hi = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    for step in range(int((end - start).max(initial=0))):
        live = np.flatnonzero(end - start > step)
        pos = base[of[live]] + end[live] - 1 - step
        last = (end - start)[live] == step + 1
        swap = live[last & (start[live] > 0)]
        swap_lo[swap], swap_hi[swap] = index.extend(lo[swap], hi[swap], flat[base[of[swap]] + start[swap] - 1])
        lo[live], hi[live] = index.extend(lo[live], hi[live], flat[pos])
    return of, start, end, lo, hi, swap_lo, swap_hi


def _letters_near(train: list[str], held: list[str], edits: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(train text, record, matches) of texts of letters that share a piece which all texts within `edits` share, at nearly the same place.

    A text is cut into more pieces than the edits allowed, so that one stands in the record unchanged, or with its first letter
    swapped with the one before: rare pieces where the text is long enough for them, equal ones otherwise. Pairs whose counts
    of letters differ too much are dropped. A match is (start in the text, start in the record, length).
    """
    records = [np.append(_symbols(h), 0).astype(np.uint8) for h in held]
    index = FullTextIndex(records)
    texts = [_symbols(t) for t in train]
    size_t, size_h = np.array([len(t) for t in texts]), np.array([len(h) - 1 for h in records])
    bags_t, bags_h = _bags(texts), _bags([h[:-1] for h in records])
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def take(names: np.ndarray, of, start, end, lo, hi, swap_lo, swap_hi) -> None:
        for first, a, b in ((0, lo, hi), (1, swap_lo, swap_hi)):
            for piece, place in index.located(a, b):
                text, record = names[of[piece]], index.record_of(place)
                off = place - index.starts[record] - start[piece]
                near = (np.abs(off) <= edits) & (np.abs(size_h[record] - size_t[text]) <= edits)
                text, record, off, piece = text[near], record[near], off[near], piece[near]
                alike = np.abs(bags_t[text] - bags_h[record]).sum(1) <= 2 * edits
                for t, r, o, p in zip(text[alike].tolist(), record[alike].tolist(), off[alike].tolist(), piece[alike].tolist(), strict=True):
                    a_, n = int(start[p]) + first, int(end[p] - start[p]) - first
                    found.setdefault((t, r), []).append((a_, a_ + o, n))

    rest = np.flatnonzero(size_t > 0)
    for most in (8, 64, 512):
        if not len(rest):
            break
        cuts = _cut(index, [texts[k] for k in rest], most)
        rare = cuts[4] - cuts[3] <= most
        enough = np.bincount(cuts[0][rare], minlength=len(rest)) > edits
        keep = rare & enough[cuts[0]]
        take(rest, *(x[keep] for x in cuts))
        rest = rest[~enough]
    for k in range(0, len(rest), 256):
        some = rest[k : k + 256]
        take(some, *_equal_pieces(index, [texts[j] for j in some], edits + 1))
    for (t, r), matches in found.items():
        yield t, r, matches


def _symbols(letters: str) -> np.ndarray:
    return (np.frombuffer(letters.encode("ascii"), np.uint8) - 95).astype(np.uint8)


def _bags(texts: list[np.ndarray]) -> np.ndarray:
    """How often each letter stands in each text."""
    length = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), 28), np.int16)
    if length.sum():
        np.add.at(out, (np.repeat(np.arange(len(texts)), length), np.concatenate(texts)), 1)
    return out


def spans(a: str, b: str, matches: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Number of spans and characters of a that maximal matches cover: matches grown both ways, those of one offset merged."""
    grown: dict[int, list[tuple[int, int]]] = {}
    for x, y, n in set(matches):
        while x and y and a[x - 1] == b[y - 1]:
            x, y, n = x - 1, y - 1, n + 1
        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
            n += 1
        grown.setdefault(y - x, []).append((x, x + n))
    total, covered = 0, bytearray(len(a))
    for runs in grown.values():
        at = -1
        for x, e in sorted(runs):
            if x > at:
                total += 1
            at = max(at, e)
            covered[x:e] = b"\1" * (e - x)
    return total, sum(covered)


_NO_DIGITS, _NO_LETTERS = str.maketrans("", "", string.digits), str.maketrans("", "", string.ascii_lowercase)


def _split(label: str) -> tuple[str, str]:
    """The letters and the digits of a folded label."""
    return label.translate(_NO_DIGITS), label.translate(_NO_LETTERS)


Match = tuple[str, str, int, int, int]


def match_labels(train: list[str], held: list[str], edits: int = EDITS) -> list[Match]:
    """(train label, evaluation label, distance, spans, characters in spans) of the folded labels that are the same.

    Digits are looked up in the index of all records, from the end of the record: where few records have them, each is
    compared; where many have, their letters get an index of their own.
    """
    if not train or not held:
        return []
    index = FullTextIndex([encode(x) for x in held])
    parts, own = [_split(x) for x in held], [_split(x) for x in train]
    tails = [encode(d)[:-1] if d else np.array([1], np.uint8) for _, d in own]
    lo, hi = _whole(index, [np.append(t, 0).astype(np.uint8) for t in tails])
    out: list[Match] = []

    def compare(t: int, r: int, matches: list[tuple[int, int, int]]) -> None:
        a, b = own[t][0], parts[r][0]
        if (d := osa_distance(a, b, edits)) <= edits:
            x, y = f"{a}\1{own[t][1]}", f"{b}\1{parts[r][1]}"
            out.append((train[t], held[r], d, *spans(x, y, [*matches, (len(a), len(b), len(x) - len(a))])))

    few = (hi > lo) & (hi - lo <= FEW)
    for piece, place in index.located(np.where(few, lo, 0), np.where(few, hi, 0)):
        for t, r in zip(piece.tolist(), index.record_of(place).tolist(), strict=True):
            compare(t, r, [])
    many: dict[str, list[int]] = {}
    for t in np.flatnonzero(hi - lo > FEW).tolist():
        many.setdefault(own[t][1], []).append(t)
    if many:
        of_digits: dict[str, list[int]] = {d: [] for d in many}
        for r, (_, d) in enumerate(parts):
            if d in of_digits:
                of_digits[d].append(r)
        for d, ts in many.items():
            rs = of_digits[d]
            for t, r, matches in _letters_near([own[t][0] for t in ts], [parts[r][0] for r in rs], edits):
                compare(ts[t], rs[r], matches)
            for t in [t for t in ts if len(own[t][0]) <= edits]:  # so short that no piece need be left
                for r in [r for r in rs if len(parts[r][0]) <= 2 * edits]:
                    compare(t, r, [])
    return list({x[:2]: x for x in out}.values())


def _whole(index: FullTextIndex, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of whole patterns."""
    length = np.array([len(p) for p in patterns])
    flat, base = np.concatenate(patterns), np.r_[0, np.cumsum(length)[:-1]]
    lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), index.n, np.int64)
    for step in range(int(length.max(initial=0))):
        live = np.flatnonzero((length > step) & (hi > lo))
        lo[live], hi[live] = index.extend(lo[live], hi[live], flat[base[live] + length[live] - 1 - step])
    return lo, hi


def match_paths(train: list[str], held: list[str]) -> list[Match]:
    """(train path, evaluation path, 0, 1, matched characters) of paths of which one ends with the other's folders and name.

    Each train path runs through backward search from its end; wherever a folder begins, the records that begin there are
    ends of it, and those that go on to the left when it is used up end with it. A path of a name alone matches only its like.
    """
    if not train or not held:
        return []
    raw = [h.encode() for h in held]
    alphabet = np.zeros(256, np.uint16)
    present = np.unique(np.frombuffer(b"".join(raw) + b"/", np.uint8))
    alphabet[present] = np.arange(1, len(present) + 1)
    begin, unknown, slash = len(present) + 1, len(present) + 2, int(alphabet[47])
    index = FullTextIndex([np.r_[begin, alphabet[np.frombuffer(r, np.uint8)], 0].astype(np.uint16) for r in raw], len(present) + 3)
    texts = [alphabet[np.frombuffer(t.encode(), np.uint8)] for t in train]
    length = np.array([len(t) for t in texts])
    flat, base = np.concatenate(texts).astype(np.int64), np.r_[0, np.cumsum(length)[:-1]]
    flat[flat == 0] = unknown
    lo, hi = index.extend(np.zeros(len(texts), np.int64), np.full(len(texts), index.n, np.int64), np.zeros(len(texts), np.int64))
    folders = np.zeros(len(texts), np.int64)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(int(length.max(initial=0))):
        live = np.flatnonzero((length > step) & (hi > lo))
        if not len(live):
            break
        pos = length[live] - 1 - step
        symbol = flat[base[live] + pos]
        inner = live[(symbol == slash) & (folders[live] > 0)]  # what follows this slash is a whole end of the path
        hits.append((inner, *index.extend(lo[inner], hi[inner], np.full(len(inner), begin))))
        folders[live] += symbol == slash
        lo[live], hi[live] = index.extend(lo[live], hi[live], symbol)
        done = live[(pos == 0) & (hi[live] > lo[live])]
        for s in (begin, slash):
            some = done if s == begin else done[folders[done] > 0]
            hits.append((some, *index.extend(lo[some], hi[some], np.full(len(some), s))))
    out: dict[tuple[str, str], Match] = {}
    for names, a, b in hits:
        for piece, place in index.located(a, b):
            for t, r in zip(names[piece].tolist(), index.record_of(place).tolist(), strict=True):
                x, y = train[t], held[r]
                out[x, y] = (x, y, 0, 1, min(len(x), len(y)))
    return list(out.values())


def _grams(letters: str) -> set[str]:
    return {letters[k : k + GRAM] for k in range(max(1, len(letters) - GRAM + 1))}


def label_routes(label: str, hot: bool, side: str, rank: dict[str, int]) -> list[str]:
    """Keys of a folded label, of which two labels that are the same share one; rank orders the letter groups, rare ones first."""
    letters, digits = _split(label)
    if digits and not hot:
        return [digits]
    first = sorted(_grams(letters), key=lambda g: (rank.get(g, 0), g))[: EDITS * (GRAM + 1) + 1]
    near = {len(letters) // LENGTHS} if side == "held" else {(len(letters) - EDITS) // LENGTHS, (len(letters) + EDITS) // LENGTHS}
    return [f"{digits}:{g}:{n}" for g in first for n in near] + ([f"{digits}::"] if len(_grams(letters)) <= EDITS * (GRAM + 1) else [])


def path_route(path: str) -> str:
    """The last folder and the name of a path."""
    return "/".join(path.split("/")[-2:])


def same_texts(texts: DataFrame, shard_rows: int = SHARD_ROWS, part: int = PART) -> DataFrame:
    """(kind, train_text, held_text, distance, spans, chars) of texts that are the same.

    texts has (kind, side, text): kind 'label' (folded) or 'path' (as of path_key), side 'train' or 'held'. Null and empty texts match
    nothing, repeated ones count once.
    """
    digits = F.when(F.col("kind") == "label", F.regexp_replace("text", "[a-z]+", "")).otherwise("")
    texts = cut(texts.where("text is not null and text <> ''").groupBy("kind", "side", "text").agg(F.lit(1).alias("one")).withColumn("digits", digits))
    shards = max(1, -(-texts.count() // shard_rows))
    hot = texts.where("digits <> ''").groupBy("digits").count().where(F.col("count") > HOT).select("digits", F.lit(True).alias("hot"))
    flagged = texts.join(hot, "digits", "left").select("kind", "side", "text", F.coalesce("hot", F.lit(False)).alias("hot"), "digits")

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                counts.update(_grams(_split(t)[0]))
        yield pd.DataFrame(list(counts.items()), columns=["gram", "n"])

    by_letters = flagged.where("kind = 'label' and (hot or digits = '')").select("text")
    # At most 27 ** GRAM groups of letters, whatever the data.
    rank = {r["gram"]: r["n"] for r in by_letters.mapInPandas(count_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    shared = texts.sparkSession.sparkContext.broadcast(rank)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for kind, side, text, is_hot in zip(b["kind"], b["side"], b["text"], b["hot"], strict=True):
                for key in [path_route(text)] if kind == "path" else label_routes(text, is_hot, side, shared.value):
                    rows.add((kind, xxhash.xxh64_intdigest(key) % shards, side, text))
            yield pd.DataFrame(list(rows), columns=["kind", "shard", "side", "text"])

    routed = cut(flagged.select("kind", "side", "text", "hot").mapInPandas(route, "kind string, shard bigint, side string, text string"))
    size = lambda s: F.ceil(F.greatest(F.lit(1), F.count_if(F.col("side") == s)) / F.lit(part)).cast("int")
    both = F.bool_or(F.col("side") == "train") & F.bool_or(F.col("side") == "held")
    parts = routed.groupBy("kind", "shard").agg(size("train").alias("n_train"), size("held").alias("n_held"), both.alias("both")).where("both").drop("both")
    mine, other = (F.when(F.col("side") == "train", F.col(x)).otherwise(F.col(y)) for x, y in (("n_train", "n_held"), ("n_held", "n_train")))
    own = F.pmod(F.xxhash64("text"), mine).cast("int")
    # Each part of one side meets each part of the other in a task of its own.
    grid = routed.join(parts, ["kind", "shard"]).withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), other - 1))).select(
        "kind", "shard", F.when(F.col("side") == "train", F.col("own")).otherwise(F.col("met")).alias("i"),
        F.when(F.col("side") == "train", F.col("met")).otherwise(F.col("own")).alias("j"), "side", "text",
    )

    def run(texts: pd.DataFrame) -> pd.DataFrame:
        kind = texts["kind"].iloc[0]
        train, held = (texts.loc[texts["side"] == side, "text"].tolist() for side in ("train", "held"))
        found = (match_paths if kind == "path" else match_labels)(train, held)
        return pd.DataFrame([(kind, *x) for x in found], columns=["kind", "train_text", "held_text", "distance", "spans", "chars"], dtype=object)

    met = grid.groupBy("kind", "shard", "i", "j")
    columns = "kind string, train_text string, held_text string, distance int, spans int, chars int"
    return met.applyInPandas(run, columns).groupBy("kind", "train_text", "held_text").agg(*[F.max(c).alias(c) for c in ("distance", "spans", "chars")])


def path_key(col: str) -> Column:
    """Folders and name of a crop: separators, case, drives, a leading dot, extensions and marks of copies don't count.

    Null and empty paths are null.
    """
    path = F.lower(F.regexp_replace(F.trim(col), r"[\\/]+", "/"))
    path = F.regexp_replace(path, r"^(?:[a-z]{2,}:|[a-z]:)?/?(?:\./)*", "")
    path = F.regexp_replace(path, r"\.[a-z0-9]{2,5}$", "")
    path = F.regexp_replace(path, r"(\s*-\s*copy|\s*\(\d+\)|\s*-\s*bản sao)+$", "")
    return F.nullif(path, F.lit(""))


def record_texts(annotations: DataFrame) -> DataFrame:
    """(sample_id, side, kind, text): the path and the label of each record by which it may be found.

    Rows with a null split or id are left out; null paths and labels, and labels under LEAST_CHARS, give no row.
    """
    rows = annotations.where("sample_id is not null and split is not null").select(
        "sample_id", F.when(F.col("split") == "train", "train").otherwise("held").alias("side"),
        F.explode(F.array(
            F.struct(F.lit("path").alias("kind"), path_key("img_path").alias("text")),
            F.struct(F.lit("label").alias("kind"), F.when(F.length(F.trim("label")) >= LEAST_CHARS, F.nullif(fold_key("label"), F.lit(""))).alias("text")),
        )).alias("t"),
    )
    return rows.select("sample_id", "side", "t.kind", "t.text").where("text is not null")


def overlaps(annotations: DataFrame) -> DataFrame:
    """(train_id, held_id, by_path, by_label, distance, spans, chars): a record of train and one of val or test that are the same.

    Nulls: see record_texts(). Repeated rows are records of their own if their ids differ. Pairs come out once, with both ways
    they were found; distance, spans and chars are those of the labels, null for pairs found by path alone.
    """
    rows = cut(record_texts(annotations))
    same = cut(same_texts(rows.select("kind", "side", "text")))
    train = rows.where("side = 'train'").select(F.col("sample_id").alias("train_id"), "kind", F.col("text").alias("train_text"))
    held = rows.where("side = 'held'").select(F.col("sample_id").alias("held_id"), "kind", F.col("text").alias("held_text"))
    both = same.join(train, ["kind", "train_text"]).join(held, ["kind", "held_text"])
    label = lambda c: F.max(F.when(F.col("kind") == "label", F.col(c))).alias(c)
    return both.groupBy("train_id", "held_id").agg(
        F.bool_or(F.col("kind") == "path").alias("by_path"), F.bool_or(F.col("kind") == "label").alias("by_label"), label("distance"), label("spans"), label("chars")
    )


def links(annotations: DataFrame) -> DataFrame:
    """(sample_id, side, class_id, n_links): every record, the class of its exact copies, and the records it is linked to.

    Copies are records of one side with the same path key and the same folded label; their class is the least id among them.
    Links are counted from classes, so that no pair of copies is made: those by path, plus those by label, less those by both.
    """
    rows = cut(record_texts(annotations))
    same = cut(same_texts(rows.select("kind", "side", "text")))
    whole = rows.groupBy("sample_id", "side").agg(F.max(F.when(F.col("kind") == "path", F.col("text"))).alias("path"), F.max(F.when(F.col("kind") == "label", F.col("text"))).alias("label"))
    classes = cut(whole.groupBy("side", "path", "label").agg(F.min("sample_id").alias("class_id"), F.count("*").alias("n")))
    one = same.select("kind", F.col("train_text").alias("a"), F.col("held_text").alias("b"))
    both = one.select("kind", F.explode(F.array(F.struct(F.lit("train").alias("side"), "a", "b"), F.struct(F.lit("held").alias("side"), F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    pairs = both.select("kind", "x.*")
    far = classes.select(F.when(F.col("side") == "train", "held").otherwise("train").alias("side"), F.explode(F.array(
        F.struct(F.lit("path").alias("kind"), F.col("path").alias("b")), F.struct(F.lit("label").alias("kind"), F.col("label").alias("b")))).alias("x"),
        F.col("class_id").alias("far"), "n").select("side", "x.*", "far", "n").where("b is not null")
    near = classes.select("side", "class_id", F.explode(F.array(
        F.struct(F.lit("path").alias("kind"), F.col("path").alias("a")), F.struct(F.lit("label").alias("kind"), F.col("label").alias("a")))).alias("x")).select("side", "class_id", "x.*").where("a is not null")
    met = near.join(pairs, ["side", "kind", "a"]).join(far, ["side", "kind", "b"]).groupBy("side", "class_id", "far").agg(F.max("n").alias("n"))
    total = met.groupBy("side", "class_id").agg(F.sum("n").alias("n_links"))
    counted = classes.join(total, ["side", "class_id"], "left").select("side", "path", "label", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alike = [F.col(f"w.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("side", "path", "label")]
    return whole.alias("w").join(counted.alias("c"), alike[0] & alike[1] & alike[2]).select("w.sample_id", "w.side", "c.class_id", "c.n_links")
