"""Same postal address written differently (problem 2).

Method: top-down hierarchy matching. A gazetteer of provinces, their districts, the districts' wards and streets is
counted from the corpus; each address is linked to it level by level from the province down, each name to the nearest
among the children of what was linked above. A missing level inherits the candidates of the levels around it: one
candidate is taken, several stay open. Numbers are compared exactly. What is open after that is settled by the other
addresses of the same street and number if they agree, and stays explicit (a null level) if they don't.

Names are counted and freed of misspellings in Spark: siblings below one parent in groups, streets of all districts by what is
left of them without two letters, which names two edits apart share. What goes to the tasks are the sound names of a country, which
don't grow with the data; their number is checked. Names are looked up word by word in tries.

Results with equal links form a place (a class with an id and a size); pairs come from the classes, large ones salted.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.persist import cut
from .addressing import PlaceWords, compose, find_addresses, joined
from .canon import Trie
from .textkit import osa_distance

#: Names of the gazetteer, at most: more are an error.
MAX_NAMES = 2_000_000
#: A name next to one that is so many times more frequent is a misspelling of it.
RATIO = 4
#: A district stands below a province at least so often against the province it stands below most.
STRAY = 0.1
#: Results of a place from which its pairs are salted, and the salts.
HOT, SALTS = 500, 16

SCHEMA = "result_id bigint, file_path string, page_index int, number string, street string, ward string, district string, province string, bare array<string>"


def read_addresses(results: DataFrame, words: PlaceWords, column: str = "extracted_fields", text: str = "full_text") -> DataFrame:
    """One row per result that carries an address, its parts gathered from the text and all map values.

    Null and blank texts and values hold none. A page carries at most one place: of several addresses the one with the
    most parts leads, and the others of the same number fill what it lacks.
    """
    shared = results.sparkSession.sparkContext.broadcast((words.places, words.streets))
    rows = results.where("result_id is not null").select(
        "result_id", "file_path", "page_index", F.col(text).alias("t"),
        F.coalesce(F.map_values(column), F.array().cast("array<string>")).alias("v"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = PlaceWords(*shared.value)
        for b in batches:
            out = []
            for rid, f, p, t, vs in zip(b["result_id"].tolist(), b["file_path"], b["page_index"], b["t"], b["v"], strict=True):
                found = [a for v in [t, *vs] if v and any(c.isdigit() for c in v) for a in find_addresses(joined(compose(v))[0], known)]
                if not found:
                    continue
                found.sort(key=lambda a: -(sum(x is not None for x in (a.ward, a.district, a.province)) + len(a.bare) + ("." not in a.street)))
                best = found[0]
                bare = list(best.bare)
                for a in found[1:]:
                    if a.number == best.number:
                        best.ward, best.district, best.province = best.ward or a.ward, best.district or a.district, best.province or a.province
                        if "." in best.street and "." not in a.street:
                            best.street = a.street
                        bare += [x for x in a.bare if x not in bare]
                out.append((rid, f, None if pd.isna(p) else int(p), best.number, best.street, best.ward, best.district, best.province, bare))
            yield pd.DataFrame(out, columns=["result_id", "file_path", "page_index", "number", "street", "ward", "district", "province", "bare"]).astype({"page_index": "Int32"})

    return rows.mapInPandas(run, SCHEMA)


def alike(a: str, b: str) -> int:
    """Edits between two names word by word; an initial stands for any word it begins. 9 if too many, or if numbers differ."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return 9
    total = 0
    for p, q in zip(x, y, strict=True):
        if p == q:
            continue
        if p.isdigit() or q.isdigit():
            return 9
        if p.endswith(".") or q.endswith("."):
            if p[0] != q[0]:
                return 9
            continue
        d = osa_distance(p, q, 2)
        if d > 2 or d >= max(len(p), len(q)):
            return 9
        total += d
    return total


class Names:
    """Names by their words, to look up those near a name: the words in tries by place, the names by their words."""

    def __init__(self, names) -> None:
        self.words: dict[tuple[int, int], dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
        for n in names:
            words = n.split()
            for k, w in enumerate(words):
                self.words[len(words), k][w].add(n)
        self.tries: dict[tuple[int, int], tuple[Trie, list[str]]] = {}
        self.memo: dict[tuple[int, int, str], dict[str, int]] = {}

    def _near_words(self, size: int, k: int, word: str) -> dict[str, int]:
        """Words at a place of names of that size that the word may stand for, and the edits."""
        key = size, k, word
        if key not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            own = self.words.get((size, k), {})
            if word.endswith("."):
                self.memo[key] = {w: 0 for w in own if w[0] == word[0]}
            elif word.isdigit():
                self.memo[key] = {word: 0} if word in own else {}
            else:
                if (size, k) not in self.tries:
                    trie, listed = Trie(), sorted(w for w in own if not w.endswith("."))
                    for i, w in enumerate(listed):
                        trie.add(w, i, 2)
                    self.tries[size, k] = trie, listed
                trie, listed = self.tries[size, k]
                found = {listed[i]: d for i, d in trie.search(word, 2).items()}
                found = {w: d for w, d in found.items() if w == word or (d < max(len(w), len(word)) and not w.isdigit())}
                self.memo[key] = found | {w: 0 for w in own if w.endswith(".") and w[0] == word[0]}
        return self.memo[key]

    def near(self, name: str, most: int) -> dict[str, int]:
        """Names within `most` edits, as alike() counts them, and the edits."""
        words = name.split()
        n = len(words)
        options = [self._near_words(n, k, w) for k, w in enumerate(words)]
        if not words or not all(options):
            return {}
        own = [self.words[n, k] for k in range(n)]
        k = min(range(n), key=lambda k: sum(len(own[k][w]) for w in options[k]))
        out: dict[str, int] = {}
        for w in options[k]:
            for other in own[k][w]:
                d = 0
                for option, x in zip(options, other.split(), strict=True):
                    if x not in option:
                        break
                    d += option[x]
                else:
                    if d <= most:
                        out[other] = d
        return out


@dataclass
class Gazetteer:
    """Counts of provinces, of districts by province, and of wards and streets by district."""

    provinces: Counter = field(default_factory=Counter)
    districts: dict[str, Counter] = field(default_factory=lambda: defaultdict(Counter))
    wards: dict[tuple[str, str], Counter] = field(default_factory=lambda: defaultdict(Counter))
    streets: dict[tuple[str, str], Counter] = field(default_factory=lambda: defaultdict(Counter))

    def index(self) -> None:
        self.of_street: dict[str, list[tuple[str, str]]] = defaultdict(list)
        self.of_district: dict[str, list[str]] = defaultdict(list)
        for (p, d), streets in self.streets.items():
            for s in streets:
                self.of_street[s].append((p, d))
        for p, ds in self.districts.items():
            for d in ds:
                self.of_district[d].append(p)


def sound(names: Counter) -> Counter:
    """Without misspellings: names next to a much more frequent one."""
    index = Names(names)
    kept: Counter = Counter()
    for name, n in names.most_common():
        if not any(kept.get(other, 0) >= RATIO * n for other in index.near(name, 2)):
            kept[name] = n
    return kept


class Linker:
    """Links addresses to a gazetteer; what a name may stand for is looked up once a task."""

    def __init__(self, g: Gazetteer) -> None:
        self.g = g
        self.universe = {
            "province": Names(g.provinces), "district": Names({d for ds in g.districts.values() for d in ds}),
            "ward": Names({w for ws in g.wards.values() for w in ws}), "street": Names(g.of_street),
        }
        self.memo: dict[tuple[str, str], dict[str, int]] = {}

    def near(self, level: str, name: str, most: int = 2) -> dict[str, int]:
        """Names of a level within `most` edits of a name, and the edits, in the order of names."""
        key = level, name
        if key not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[key] = dict(sorted(self.universe[level].near(name, most).items()))
        return self.memo[key]

    def link(self, street: str, ward: str | None, district: str | None, province: str | None, bare: list[str]) -> tuple[str, str | None, str | None, str | None]:
        """(street, ward, district, province) linked top-down; levels that stay open are None.

        The regions are scored by what speaks for them: province, district and street as written or bare; a district
        that is written out must fit. Equal scores leave the district open, and the province too if it differs.
        """
        g = self.g
        near = {level: {b: self.near(level, b) for b in bare} for level in ("province", "district", "ward")}
        p = min(self.near("province", province).items(), key=lambda x: x[1], default=(None, 0))[0] if province else None
        streets = self.near("street", street, 3)
        fits = self.near("district", district) if district else None
        regions: set[tuple[str, str]] = set()
        for d in fits if fits is not None else {d for hits in near["district"].values() for d in hits}:
            regions |= {(x, d) for x in g.of_district[d]}
        for s in streets:
            regions |= set(g.of_street[s])
        options = []
        for x, d in regions:
            if (p is not None and x != p) or (fits is not None and d not in fits):
                continue
            score, left = 0.0, list(bare)
            if p is not None:
                score += 3
            elif hits := [b for b in left if x in near["province"][b]]:
                hit = min(hits, key=lambda b: near["province"][b][x])
                score += 3 - near["province"][hit][x] / 2
                left.remove(hit)
            if fits is not None:
                score += 3 - fits[d] / 2
            elif hits := [b for b in left if d in near["district"][b]]:
                hit = min(hits, key=lambda b: near["district"][b][d])
                score += 3 - near["district"][hit][d] / 2
                left.remove(hit)
            own = [e for s, e in streets.items() if s in g.streets[x, d]]
            if own:
                score += 2 - min(own) / 2
            wards = g.wards[x, d]
            w = ward or next((b for b in left if any(n in wards for n in near["ward"][b])), None)
            if w is not None:
                score += 1 if any(n in wards for n in self.near("ward", w)) else -0.5
            options.append((score, x, d, w))
        top = max((o[0] for o in options), default=0)
        if top <= 0:
            return self._one(streets, None) or street, ward, district, p or province
        best = [o for o in options if o[0] == top]
        if len(best) > 1:
            named = {x for _, x, _, _ in best}
            return self._one(streets, None) or street, ward, None, named.pop() if len(named) == 1 else None
        _, x, d, w = best[0]
        w = (self._one(self.near("ward", w), g.wards[x, d]) or w) if w else None
        return self._one(streets, g.streets[x, d]) or self._one(streets, None) or street, w, d, x

    @staticmethod
    def _one(near: dict[str, int], among: Counter | None) -> str | None:
        """The nearest name, also found in `among` if given; None if there is none or two are as near."""
        found = {n: d for n, d in near.items() if among is None or n in among}
        if not found:
            return None
        least = min(found.values())
        names = [n for n, d in found.items() if d == least]
        return names[0] if len(names) == 1 else None


def _left(name: str) -> set[str]:
    """What is left of a name without up to two letters: names within two edits share one of these."""
    one = {name[:k] + name[k + 1 :] for k in range(len(name))}
    return {name} | one | {x[:k] + x[k + 1 :] for x in one for k in range(len(x))}


def misspelled(names: DataFrame) -> DataFrame:
    """(name) of the names (name, n) that stand next to one RATIO times more frequent."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(xxhash.xxh64_intdigest(v) - (1 << 63), name, n) for name, n in zip(b["name"], b["n"], strict=True) for v in _left(name)]
            yield pd.DataFrame(rows, columns=["v", "name", "n"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = set()
            for names in b["names"]:
                listed = sorted(((x["n"], x["name"]) for x in names), reverse=True)
                for n, name in listed:
                    for m, other in listed:
                        if m < RATIO * n:
                            break
                        if alike(name, other) <= 2:
                            found.add(name)
                            break
            yield pd.DataFrame({"name": sorted(found)})

    # Names that share what is left are few, however many names there are.
    groups = names.mapInPandas(spread, "v bigint, name string, n bigint").groupBy("v").agg(F.collect_list(F.struct("name", "n")).alias("names"), F.max("n").alias("most"), F.min("n").alias("least"))
    return groups.where(F.col("most") >= RATIO * F.col("least")).select("names").mapInPandas(judge, "name string").distinct()


def gazetteer(addresses: DataFrame, words: PlaceWords) -> Gazetteer:
    """Count the hierarchy over all addresses.

    A province counts where it has its word; districts, wards and streets count below the province written with its word
    or as the last (widest) bare name. Only names of known words count.
    """
    wide = F.coalesce("province", F.try_element_at("bare", F.lit(-1)))
    level = lambda kind, p, d, name: F.struct(F.lit(kind).alias("kind"), p.alias("p"), d.alias("d"), name.alias("name"))
    none = F.lit("")
    district = F.col("district")
    names = addresses.select(F.explode(F.array(
        level("province", none, none, F.col("province")), level("district", wide, none, district),
        level("ward", wide, district, F.col("ward")), level("street", wide, district, F.col("street")),
    )).alias("x")).select("x.*").where("name is not null and p is not null and d is not null")
    counted = cut(names.groupBy("kind", "p", "d", "name").agg(F.count("*").alias("n")))
    shared = addresses.sparkSession.sparkContext.broadcast((words.places, words.streets))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, streets = shared.value

        def fit(kind: str, name: str) -> bool:
            if kind == "street":
                return name.split()[0] in streets and "." not in name
            return (kind in ("ward", "district") and name.isdigit()) or all(w in places for w in name.split())

        for b in batches:
            out = []
            for kind, p, d, names in zip(b["kind"], b["p"], b["d"], b["names"], strict=True):
                out += [(kind, p, d, name, n) for name, n in sound(Counter({x["name"]: x["n"] for x in names if fit(kind, x["name"])})).items()]
            yield pd.DataFrame(out, columns=["kind", "p", "d", "name", "n"], dtype=object)

    def siblings(rows: DataFrame) -> DataFrame:
        """The sound names of one kind below one parent; names below one parent are few, however many addresses have them."""
        groups = rows.groupBy("kind", "p", "d").agg(F.collect_list(F.struct("name", "n")).alias("names"))
        return groups.mapInPandas(clean, "kind string, p string, d string, name string, n bigint")

    spark = addresses.sparkSession
    g = Gazetteer(Counter({r["name"]: r["n"] for r in _bounded(siblings(counted.where("kind = 'province'")))}))
    provinces = F.broadcast(spark.createDataFrame([(p,) for p in g.provinces], "p string"))
    for r in _bounded(siblings(counted.where("kind = 'district'").join(provinces, "p"))):
        g.districts[r["p"]][r["name"]] = r["n"]
    # A bare ward taken for a province puts a district below it now and then, far less often than below its own.
    most = Counter()
    for ds in g.districts.values():
        for d, n in ds.items():
            most[d] = max(most[d], n)
    for ds in g.districts.values():
        for d in [d for d, n in ds.items() if n < STRAY * most[d]]:
            del ds[d]
    districts = F.broadcast(spark.createDataFrame([(p, d) for p, ds in g.districts.items() for d in ds], "p string, d string"))
    below = cut(siblings(counted.where("kind in ('ward', 'street')").join(districts, ["p", "d"])))
    # A misspelled street may be alone in its district; against all districts it shows.
    wrong = misspelled(below.where("kind = 'street'").groupBy("name").agg(F.sum("n").alias("n"))).select(F.lit("street").alias("kind"), "name")
    for r in _bounded(below.join(wrong, ["kind", "name"], "left_anti")):
        (g.wards if r["kind"] == "ward" else g.streets)[r["p"], r["d"]][r["name"]] = r["n"]
    g.index()
    return g


def _bounded(rows: DataFrame) -> list:
    out = rows.limit(MAX_NAMES + 1).collect()
    if len(out) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names of places")
    return out


def linked(addresses: DataFrame, g: Gazetteer) -> DataFrame:
    """(result_id, file_path, page_index, number, street, ward, district, province) with levels linked or null."""
    parts = (dict(g.provinces), {p: dict(c) for p, c in g.districts.items()}, {k: dict(c) for k, c in g.wards.items()}, {k: dict(c) for k, c in g.streets.items()})
    shared = addresses.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ps, ds, ws, ss = shared.value
        g = Gazetteer(
            Counter(ps), defaultdict(Counter, {p: Counter(c) for p, c in ds.items()}),
            defaultdict(Counter, {k: Counter(c) for k, c in ws.items()}), defaultdict(Counter, {k: Counter(c) for k, c in ss.items()}),
        )
        g.index()
        linker = Linker(g)
        memo: dict[tuple, tuple] = {}
        for b in batches:
            out = []
            for n, s, w, d, p, bare in zip(b["number"], b["street"], b["ward"], b["district"], b["province"], b["bare"], strict=True):
                key = (s, w, d, p, tuple(bare))
                if key not in memo:
                    if len(memo) > 300_000:
                        memo.clear()
                    memo[key] = linker.link(s, w, d, p, list(bare))
                out.append((n, *memo[key]))
            yield pd.concat(
                [b[["result_id", "file_path", "page_index"]].reset_index(drop=True), pd.DataFrame(out, columns=["number", "street", "ward", "district", "province"])], axis=1
            )

    return addresses.mapInPandas(run, "result_id bigint, file_path string, page_index int, number string, street string, ward string, district string, province string")


def places(links: DataFrame) -> DataFrame:
    """(result_id, file_path, page_index, place): open levels are settled by the other addresses where these agree.

    A district is settled by street and number, a ward by street, number and district; where the others differ, the level
    stays open and the address is a place of its own with the other open ones.
    """
    by_number = links.where("district is not null").groupBy("street", "number").agg(
        F.min("district").alias("d1"), F.max("district").alias("d2"), F.min("province").alias("p1"), F.max("province").alias("p2")
    )
    one = by_number.where("d1 = d2 and p1 <=> p2").select("street", "number", "d1", "p1")
    full = links.join(one, ["street", "number"], "left")
    settle = F.col("district").isNull() & (F.col("province").isNull() | F.col("province").eqNullSafe(F.col("p1")))
    full = full.withColumn("district", F.when(settle, F.col("d1")).otherwise(F.col("district"))).withColumn(
        "province", F.when(F.col("province").isNull() & F.col("district").eqNullSafe(F.col("d1")), F.col("p1")).otherwise(F.col("province"))
    ).drop("d1", "p1")
    key = ["street", "number", F.coalesce("district", F.lit("")).alias("dk"), F.coalesce("province", F.lit("")).alias("pk")]
    full = full.select("result_id", "file_path", "page_index", "ward", *key)
    wards = full.where("ward is not null").groupBy("street", "number", "dk", "pk").agg(F.min("ward").alias("w1"), F.max("ward").alias("w2")).where("w1 = w2").drop("w2")
    full = full.join(wards, ["street", "number", "dk", "pk"], "left")
    ward = F.coalesce("ward", "w1", F.lit(""))
    return full.select(
        "result_id", "file_path", "page_index", F.concat_ws("|", "pk", "dk", ward, "street", "number").alias("place")
    )


def classes(placed: DataFrame) -> DataFrame:
    """placed with n_links, the other results of the same place."""
    sizes = placed.groupBy("place").agg((F.countDistinct("result_id") - 1).alias("n_links"))
    return placed.join(sizes, "place").select("result_id", "file_path", "page_index", "place", "n_links")


def pairs(placed: DataFrame, salts: int = SALTS, hot: int = HOT) -> DataFrame:
    """(result_a, result_b) of one place, or of one page that carries an address both times; the smaller id first.

    Places and pages of more than `hot` results are split: each result meets the others in as many tasks as there are salts.
    """
    by = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    page = F.when(F.col("file_path").isNotNull() & F.col("page_index").isNotNull(), F.concat_ws("\1", "page_index", "file_path"))
    keys = placed.select("result_id", F.explode(F.array(by("place", F.col("place")), by("page", page))).alias("k")).select("result_id", "k.kind", "k.key").where("key is not null").distinct()
    sizes = keys.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("m", F.when(F.col("n") > hot, salts).otherwise(1))
    rows = cut(keys.join(sizes, ["kind", "key"]).select("result_id", "kind", "key", "m"))
    left = rows.select(F.col("result_id").alias("result_a"), "kind", "key", F.pmod(F.xxhash64("result_id"), F.col("m")).alias("salt"))
    right = rows.select(F.col("result_id").alias("result_b"), "kind", "key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m").cast("bigint") - 1)).alias("salt"))
    return left.join(right, ["kind", "key", "salt"]).where("result_a < result_b").select("result_a", "result_b").distinct()
