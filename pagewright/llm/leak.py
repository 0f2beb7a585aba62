"""Held-out passages inside corpus documents (problem 8).

Method: greedy string tiling. Documents are read as words of any script without case, accents and punctuation; runs of SEED words
shared with a passage are found by a running Karp-Rabin hash over the whole document (numpy, a batch at a time) and checked
word by word; for each document and passage with enough seeds to reach the threshold, the longest non-overlapping matches are marked repeatedly, and the
part of the passage that the tiles cover is held against a threshold. Tiles may stand in any order in the document.

The passages (a bench table) go to every executor, where a worker builds their table once: their size is checked against
MAX_PASSAGE_BYTES before.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import words_of

#: Words of a seed, the least length of a tile.
SEED = 6
#: Words that a group of neighbouring tiles must have together to count; shorter ones are common phrases.
GROUP = 11
#: Words that may be replaced between two tiles of the same alignment and still count as covered.
BRIDGE = 2
MAX_PASSAGE_BYTES = 32 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def tile(pairs: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in document, start in passage, length) of seed matches (document position, passage position).

    The longest match is marked first; of equally long ones, that which begins first in the document. What is left of
    overlapping matches is put back while it is at least seed words long.
    """
    if not len(pairs):
        return []
    pairs = pairs[np.lexsort((pairs[:, 0], pairs[:, 0] - pairs[:, 1]))]
    diag = pairs[:, 0] - pairs[:, 1]
    cut = np.flatnonzero((np.diff(diag) != 0) | (np.diff(pairs[:, 0]) != 1)) + 1
    starts, ends = np.r_[0, cut], np.r_[cut, len(pairs)]
    heap = [(-(e - s + seed - 1), int(pairs[s, 0]), int(pairs[s, 1])) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    heapq.heapify(heap)
    used_d: set[int] = set()
    used_p: set[int] = set()
    tiles = []
    while heap:
        n, d, p = heapq.heappop(heap)
        n = -n
        free = [d + k not in used_d and p + k not in used_p for k in range(n)]
        if all(free):
            tiles.append((d, p, n))
            used_d.update(range(d, d + n))
            used_p.update(range(p, p + n))
            continue
        k = 0
        while k < n:  # put the free parts back
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= seed:
                    heapq.heappush(heap, (-(e - k), d + k, p + k))
                k = e
            else:
                k += 1
    return tiles


def covered(tiles: list[tuple[int, int, int]], bridge: int = BRIDGE, group: int = GROUP) -> int:
    """Words of the passage under tiles, with gaps of up to bridge words between neighbours of nearly one alignment.

    Neighbouring tiles of nearly one alignment form a group; groups of fewer than group words don't count.
    """
    total, run, last = 0, 0, None
    for d, p, n in sorted(tiles, key=lambda t: t[1]):
        gap_p, gap_d = (p - last[1], d - last[0]) if last else (99, 99)
        if gap_p <= SEED + bridge and abs(gap_d - gap_p) <= bridge and gap_d >= 0:
            run += n + (gap_p if gap_p <= bridge else 0)
        else:
            total += run if run >= group else 0
            run = n
        last = (d + n, p + n)
    return total + (run if run >= group else 0)


class Passages:
    """Passages as word numbers and a sorted table of the hashes of their seeds; built in time linear in their words, but for sorts."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED) -> None:
        self.seed = seed
        self.ids = [i for i, _ in items]
        opened = Counter(t.split(". ", 1)[0] for _, t in items if ". " in t)
        words = [words_of(self._without_standing(t, opened)) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for ws in words for w in ws), 1)}
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.flat = np.array([self.vocabulary[w] for ws in words for w in ws], np.uint64)
        self.base = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64) if items else np.array([], np.int64)
        h = self.rolling(self.flat)
        item = np.repeat(np.arange(len(items)), self.lengths)[: len(h)]
        pos = np.arange(len(h)) - self.base[item]
        inside = pos + seed <= self.lengths[item]  # seeds don't run on into the next passage
        order = np.flatnonzero(inside)[np.argsort(h[inside], kind="stable")]
        self.item, self.pos = item[order], pos[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)

    @staticmethod
    def _without_standing(text: str, opened: Counter) -> str:
        """The text without a first sentence that opens other passages too (an instruction, no part of the passage)."""
        head, stop, rest = text.partition(". ")
        return rest if stop and opened[head] > 2 else text

    def rolling(self, numbers: np.ndarray) -> np.ndarray:
        """Karp-Rabin hash of every run of seed word numbers."""
        n = len(numbers) - self.seed + 1
        if n <= 0:
            return np.array([], np.uint64)
        h = numbers[:n].copy()
        for k in range(1, self.seed):
            h *= _P
            h += numbers[k : k + n]
        return h

    def _seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ids, item, place in the passage) of all seed matches; a hash that is met is checked word by word."""
        h = self.rolling(ids)
        known = ids != 0
        ok = known[: len(h)].copy()
        for k in range(1, self.seed):
            ok &= known[k : k + len(h)]
        at = np.flatnonzero(ok)
        slot = np.searchsorted(self.keys, h[at])
        slot[slot == len(self.keys)] = 0
        hit = self.keys[slot] == h[at]
        at, slot = at[hit], slot[hit]
        rows, where = _spread(self.first[slot], self.count[slot]), np.repeat(at, self.count[slot])
        item, pos = self.item[rows], self.pos[rows]
        same = np.ones(len(where), bool)
        for k in range(self.seed):
            same &= ids[where + k] == self.flat[self.base[item] + pos + k]
        return where[same], item[same], pos[same]

    def _reach(self, key: np.ndarray, pos: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The most words that tiles of seeds at these places (sorted by key, then place) could cover, by key.

        It counts a place once, however often the document repeats it, and leaves out what stands too far from other seeds
        to be part of a group.
        """
        if not len(pos):
            return np.array([])
        apart = np.r_[np.where(np.diff(key) == 0, np.diff(pos), 1 << 30), 1 << 30]
        words = np.minimum(apart, self.seed + BRIDGE)
        words[apart >= 1 << 30] = self.seed
        starts = np.flatnonzero(np.r_[True, apart[:-1] > self.seed + SEED + BRIDGE])
        group = np.add.reduceat(words, starts)
        group[group < GROUP] = 0
        per_key = np.zeros(len(first))
        np.add.at(per_key, np.searchsorted(first, starts, side="right") - 1, group)
        return per_key

    def leaks(self, texts: list[str], least: float) -> Iterator[tuple[int, int, int, int]]:
        """(index of the text, item id, words covered, words of the passage) with covered >= least * words."""
        if not len(self.keys):
            return
        get = self.vocabulary.get
        numbers: list[int] = []
        bounds = [0]
        for t in texts:
            numbers += [get(w, 0) for w in words_of(t)]
            numbers += [0] * self.seed
            bounds.append(len(numbers))
        where, item, pos = self._seeds(np.array(numbers, np.uint64))
        text_of = np.searchsorted(np.array(bounds), where, side="right") - 1
        key = text_of * len(self.ids) + item
        order = np.lexsort((pos, key))
        where, item, pos, key = where[order], item[order], pos[order], key[order]
        pairs, first, count = np.unique(key, return_index=True, return_counts=True)
        need = least * self.lengths[pairs % len(self.ids)]
        enough = self._reach(key, pos, first) >= need
        for pair, f, c, n in zip(pairs[enough].tolist(), first[enough].tolist(), count[enough].tolist(), need[enough].tolist(), strict=True):
            got = covered(tile(np.column_stack([where[f : f + c], pos[f : f + c]]), self.seed))
            if got >= n:
                t, k = divmod(pair, len(self.ids))
                yield t, self.ids[k], got, int(self.lengths[k])


#: The passages that this worker process has built last, by the call they belong to.
_BUILT: dict[str, Passages] = {}


def _built(call: str, items: list[tuple[int, str]]) -> Passages:
    if call not in _BUILT:
        _BUILT.clear()
        _BUILT[call] = Passages(items)
    return _BUILT[call]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges first..first+count-1, one after the other."""
    if not len(first):
        return np.array([], np.int64)
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1])


def passage_list(items: DataFrame) -> list[tuple[int, str]]:
    """The bench table as a list, after a check of its size."""
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > MAX_PASSAGE_BYTES:
        raise ValueError(f"{total} bytes of passages; run leaks() on parts of the bench table of at most {MAX_PASSAGE_BYTES}")
    return [(int(r[0]), r[1]) for r in items.orderBy("item_id").collect()]


def leaks(documents: DataFrame, items: DataFrame, least: float = 0.4) -> DataFrame:
    """(doc_id, item_id, covered, words): documents that carry at least the part `least` of a passage, in words.

    Null, empty and short texts give no rows; texts that repeat give a row each; items without words are never found.
    """
    passages = passage_list(items)
    broadcast = documents.sparkSession.sparkContext.broadcast(passages)
    call = uuid.uuid4().hex

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _built(call, broadcast.value)
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            rows = [(ids[t], i, c, n) for t, i, c, n in index.leaks(texts, least)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "covered", "words"])

    return (
        documents.where("text is not null and doc_id is not null")
        .select("doc_id", "text")
        .mapInPandas(search, "doc_id bigint, item_id bigint, covered int, words int")
    )
