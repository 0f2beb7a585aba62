"""Filling containers of fixed capacity with texts (problem 7).

Method: bounded-space online best fit. Every task packs the rows it reads, as they come; it keeps a
fixed number of open bins in a bitset keyed by free space, puts an item into the open bin with the least
sufficient space, and closes the fullest bin when a new one would exceed the number. What is still open at
the end of a task is sent on as units and packed once more, a bounded number of units per task, so that tasks
with little data don't each leave half-filled bins.

Sizes are computed in the JVM (one token per UTF-8 byte and one closing token); only ids and sizes reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.persist import cut

#: Open bins of a task and kind.
OPEN_BINS = 64
#: Units left open by the first round that one group of the second round packs, about.
UNITS_PER_GROUP = 50_000


class OpenBins:
    """Open bins in a bitset keyed by free space: bit f is set while a bin with f free tokens is open."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.by_free = 0, 0, {}
        self.opened = 0

    def _pop(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id

    def _push(self, free: int, bin_id: int) -> None:
        if free:  # a full bin is closed at once
            self.by_free.setdefault(free, []).append(bin_id)
            self.bits |= 1 << free
            self.count += 1

    def add(self, size: int) -> int:
        """The number of the bin that takes an item of this size (1..capacity)."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._pop(free)
            self._push(free - size, bin_id)
            return bin_id
        if self.count >= self.limit:
            self._pop((self.bits & -self.bits).bit_length() - 1)
        bin_id, self.opened = self.opened, self.opened + 1
        self._push(self.capacity - size, bin_id)
        return bin_id

    def still_open(self) -> dict[int, int]:
        """Number -> free space of the bins that are open."""
        return {b: free for free, bins in self.by_free.items() for b in bins}


def sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens): tokens of a byte-level tokenizer. Rows with a null text or id have no size and are left out."""
    return documents.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text_col).cast("bigint") + 1).alias("tokens"),
    )


def pack(items: DataFrame, kinds: list[tuple[int, int]], open_bins: int = OPEN_BINS) -> DataFrame:
    """Assign every item (doc_id, tokens) to containers of every kind (kind_id, capacity).

    Returns (doc_id, kind_id, piece, first_token, tokens, container): an item no larger than the capacity is one
    piece (piece 1); a larger one is cut into pieces of the full capacity, each alone in its container, and a last
    piece that is packed like an item. container is unique within the kind. Repeated ids are items of their own; ties
    between equally full bins go to the one touched last; an empty table gives no rows; kinds with a null or
    non-positive capacity are an error.
    """
    if any(c is None or c < 1 for _, c in kinds):
        raise ValueError("a container needs a positive capacity")
    names = ["doc_id", "kind_id", "piece", "first_token", "tokens", "container", "unit", "unit_tokens"]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 36
        bins = {k: OpenBins(c, open_bins) for k, c in kinds}
        waiting: dict[tuple[int, int], list] = {}
        used: dict[tuple[int, int], int] = {}
        alone = 0
        for batch in batches:
            ready = []
            for doc_id, tokens in zip(batch["doc_id"].tolist(), batch["tokens"].tolist(), strict=True):
                for kind, capacity in kinds:
                    at, piece = 0, 1
                    while tokens - at > capacity:
                        ready.append((doc_id, kind, piece, at, capacity, task | 1 << 35 | alone, None, None))
                        alone += 1
                        at += capacity
                        piece += 1
                    b = bins[kind].add(tokens - at)
                    waiting.setdefault((kind, b), []).append((doc_id, kind, piece, at, tokens - at))
                    used[kind, b] = used.get((kind, b), 0) + tokens - at
            for kind, capacity in kinds:
                open_now = bins[kind].still_open()
                for key in [k for k in waiting if k[0] == kind and k[1] not in open_now]:
                    ready += [(*row, task | key[1], None, None) for row in waiting.pop(key)]
                    del used[key]
            if ready:
                yield pd.DataFrame(ready, columns=names).astype({"unit": "Int64", "unit_tokens": "Int64"})
        rest = [(*row, task | key[1], task | key[1], used[key]) for key, rows in waiting.items() for row in rows]
        if rest:
            yield pd.DataFrame(rest, columns=names).astype({"unit": "Int64", "unit_tokens": "Int64"})

    return items.select("doc_id", "tokens").mapInPandas(
        first,
        "doc_id bigint, kind_id int, piece int, first_token bigint, tokens bigint, container bigint, unit bigint, unit_tokens bigint",
    )


def repack(packed: DataFrame, kinds: list[tuple[int, int]], open_bins: int = OPEN_BINS, per_group: int = UNITS_PER_GROUP) -> DataFrame:
    """Join the bins that the tasks of pack() left open, whole, into fewer containers.

    The open bins are bounded (open_bins per task and kind); they are packed again in groups of about per_group units,
    and only their new container goes back to the pieces.
    """
    capacity = dict(kinds)

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(pdf["kind_id"].iloc[0])
        bins = OpenBins(capacity[kind], open_bins)
        pdf = pdf.sort_values(["unit_tokens", "unit"], ascending=[False, True])
        to = [bins.add(int(s)) for s in pdf["unit_tokens"]]
        first_unit: dict[int, int] = {}
        for b, unit in zip(to, pdf["unit"], strict=True):
            first_unit.setdefault(b, unit)
        return pd.DataFrame({"kind_id": pdf["kind_id"], "unit": pdf["unit"], "moved": [first_unit[b] for b in to]})

    packed = cut(packed)  # used three times: a task that ran again in another order would number its bins anew
    width = max(1, per_group // open_bins)  # tasks per group
    units = packed.where("unit is not null").select("kind_id", "unit", "unit_tokens").distinct()
    moved = (
        units.withColumn("grp", F.floor(F.shiftright("unit", 36) / F.lit(width)))
        .groupBy("kind_id", "grp")
        .applyInPandas(again, "kind_id int, unit bigint, moved bigint")
    )
    out = ["doc_id", "kind_id", "piece", "first_token", "tokens"]
    closed = packed.where("unit is null").select(*out, "container")  # kept from the join: null is no key to meet by
    return closed.unionByName(packed.where("unit is not null").join(moved, ["kind_id", "unit"]).select(*out, F.col("moved").alias("container")))


def container_kinds(table: DataFrame, most: int = 1000) -> list[tuple[int, int]]:
    """The kinds as a list. They are a table of fixed size; more than `most` rows are an error, not a collect."""
    rows = table.select("kind_id", "capacity").where("kind_id is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} container kinds")
    return sorted((int(r[0]), int(r[1])) for r in rows if r[1] is not None)
