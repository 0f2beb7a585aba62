"""Correction of text word by word in its context, by rules, and of place names; for text that a recogniser read.

What depends on the word just corrected can't be a plain expression: a text is folded from left to right in an Arrow
batch, with the lexicon and the n-grams broadcast. Their size is checked; beyond it, correct_by_joins() brings each text what it needs of
them.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import peel, typography
from ..plans.persist import cut
from . import domains, entities, lexicon

MAX_TABLE_ROWS = 5_000_000
# Score from which a known word is replaced, and by how much it must be better.
SURE, MARGIN = 50.0, 35.0
# Words without accents that are words as they are.
PLAIN_WORDS = frozenset({"va", "la", "co", "ra", "cho", "di"})
_BYPASS = re.compile(r"[@/:#$%]")
# Phrases of forms and papers that a text is snapped to, whatever accents it lost.
PHRASES = (
    "Cộng hòa xã hội chủ nghĩa Việt Nam", "Độc lập - Tự do - Hạnh phúc", "Ủy ban nhân dân", "Hội đồng nhân dân", "Căn cước công dân", "Chứng minh nhân dân",
    "Họ và tên", "Ngày sinh", "Quê quán", "Quốc tịch", "Giới tính", "Dân tộc", "Tôn giáo", "Nơi thường trú", "Nơi tạm trú", "Nơi cấp", "Ngày cấp",
    "Mã số thuế", "Số tài khoản", "Ngân hàng", "Số điện thoại", "Địa chỉ", "Hóa đơn", "Hợp đồng", "Báo giá", "Biên bản", "Giấy biên nhận",
    "Phiếu giao hàng", "Phiếu xuất kho", "Phiếu nhập kho", "Kiêm phiếu xuất kho", "Mã hàng", "Tên hàng", "Số lượng", "Đơn vị tính", "Đơn giá", "Thành tiền",
    "Cộng tiền hàng", "Tiền thuế GTGT", "Tổng cộng", "Tổng tiền thanh toán", "Số tiền viết bằng chữ", "Chiết khấu", "Ghi chú", "Diễn giải", "Địa điểm giao hàng",
    "Người nhận", "Người gửi", "Người mua", "Người bán", "Người lập phiếu", "Tên người liên hệ", "Mã vận đơn", "Trọng lượng", "Khối lượng",
    "Khách hàng ký nhận", "Nhân viên kỹ thuật", "Phòng kế toán", "Kế toán trưởng", "Thủ kho", "Thủ quỹ", "Giám đốc", "Hồ Chí Minh",
)


@lru_cache(200_000)
def fold(text: str) -> str:
    """Without accents; đ becomes d."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")


def phrase_rules(phrases: tuple[str, ...] = PHRASES) -> list[tuple[str, str]]:
    """(pattern, replacement) for each phrase: its letters with any or no accent, its blanks of any width."""
    rules = []
    of: dict[str, set[str]] = {}
    for x in (*range(0xC0, 0x1B5), *range(0x1EA0, 0x1EFA)):
        of.setdefault(fold(chr(x)).lower(), set()).add(chr(x))
    for phrase in phrases:
        parts = []
        for c in fold(phrase).lower():
            variants = {c} | of.get(c, set())
            parts.append(r"\s+" if c == " " else f"[{''.join(sorted(variants))}]" if c.isalpha() else re.escape(c))
        rules.append((r"\b" + "".join(parts) + r"\b", phrase))
    return rules


def lint_rules(rules: list[tuple[str, str]]) -> list[str]:
    """What is wrong with rules: patterns that don't compile, repeat, match nothing at all or everything."""
    out, seen = [], set()
    for n, (pattern, replacement) in enumerate(rules, 1):
        try:
            compiled = re.compile(pattern, re.I)
        except re.error as e:
            out.append(f"{n}: {e}")
            continue
        if pattern in seen:
            out.append(f"{n}: repeated pattern")
        if compiled.fullmatch(""):
            out.append(f"{n}: matches the empty text")
        if max([0, *map(int, re.findall(r"\\(\d)", replacement))]) > compiled.groups:
            out.append(f"{n}: a group that isn't there")
        seen.add(pattern)
    return out


#: A rule ready for use: pattern, replacement, and what the folded text must hold for the pattern to match (None if that isn't known).
Rule = tuple[re.Pattern, str, str | None]


def compiled(rules: list[tuple[str, str]] | None = None) -> list[Rule]:
    """Rules ready for use; without any, those of the phrases, each of which is tried only where its letters stand."""
    if rules is not None:
        return [(re.compile(p, re.I), r, None) for p, r in rules]
    return [(re.compile(p, re.I), r, _plain(r)) for p, r in phrase_rules()]


def _plain(text: str) -> str:
    return " ".join(fold(text).lower().split())


def apply_rules(text: str, rules: list[Rule]) -> str:
    """Ordered rewriting; groups are expanded, a match in capitals gives capitals, a colon stays only if it was there."""
    plain = _plain(text)
    for pattern, replacement, needed in rules:
        if needed is not None and needed not in plain:
            continue

        def put(m: re.Match, replacement: str = replacement) -> str:
            out = m.expand(replacement)
            if out.endswith(":") and ":" not in m[0]:
                out = out[:-1]
            return out.upper() if m[0].isupper() else out

        text = pattern.sub(put, text)
    return text


def rewrite(col: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """The text after ordered rules, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        own = compiled(rules)
        return s.map(lambda t: None if t is None else apply_rules(t, own))

    return run(col)


class Boosts(dict):
    """Word -> boost of a text, by the scores of its domains; texts of equal scores share one."""

    scores: tuple[float, ...] | None = None


@dataclass
class Model:
    """Lexicon and n-gram counts, ready to decode."""

    words: dict[str, int]
    bigrams: dict[tuple[str, str], int]
    trigrams: dict[tuple[str, str, str], int]
    loose: dict[str, list[str]] = field(default_factory=dict)
    memo: dict[tuple, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for w in self.words:
            self.loose.setdefault(fold(w), []).append(w)

    def candidates(self, token: str) -> set[str]:
        plain = fold(token)
        stems = {token, plain, plain.replace("d", "đ")}
        for wrong, right in lexicon.HOMOGLYPHS:
            if wrong in plain:
                fixed = plain.replace(wrong, right)
                stems |= {fixed, fixed.replace("d", "đ")}
        return {s for s in stems if s in self.words} | {w for s in stems for w in self.loose.get(s, ())}

    def context(self, p2: str | None, p1: str | None, w: str, n1s: list[str | None], n2: str | None) -> float:
        """The best score over the forms of the next word; the parts without it are added once."""
        a, b, c, d, e = lexicon.CONTEXT_WEIGHTS
        left = a * self.bigrams.get((p1, w), 0) + c * self.trigrams.get((p2, p1, w), 0)
        return left + max(b * self.bigrams.get((w, n), 0) + d * self.trigrams.get((p1, w, n), 0) + e * self.trigrams.get((w, n, n2), 0) for n in n1s)

    def correct(self, token: str, p2: str | None, p1: str | None, n1: str | None, n2: str | None, boosts: dict[str, float]) -> str:
        """The token, or the word that fits its context better. Equal scores: the more frequent word, then the first."""
        if len(token) < 2 or token.isdigit() or token.startswith("__SHIELD_ENT_") or _BYPASS.search(token):
            return token
        low = token.lower()
        among = self.candidates(low)
        if not among:
            return token
        if p1 or n1:
            p1s = [p1.lower(), *(w for w in self.loose.get(fold(p1.lower()), ()) if w != p1.lower())] if p1 else [None]
            n1s = [n1.lower(), *(w for w in self.loose.get(fold(n1.lower()), ()) if w != n1.lower())] if n1 else [None]
            p2, n2 = p2.lower() if p2 else None, n2.lower() if n2 else None
            now = max(self.context(p2, p, low, n1s, n2) for p in p1s)
            scored = [(max(self.context(p2, p, w, n1s, n2) for p in p1s) * boosts.get(w, 1.0), self.words[w], w) for w in among]
            best, _, word = min(scored, key=lambda x: (-x[0], -x[1], x[2]))
            stands = low in self.words and (low != fold(low) or low in PLAIN_WORDS)
            if best > 0 and (best >= SURE and best >= now + MARGIN if stands else best > now):
                return _cased(token, word)
        if low in self.words:
            return token
        only = self.loose.get(fold(low), [])
        return _cased(token, only[0]) if len(only) == 1 else token

    def _known(self, token: str, p2: str | None, p1: str | None, n1: str | None, n2: str | None, boosts: dict[str, float]) -> str:
        """correct(), worked out once for each context and set of domain scores."""
        scores = getattr(boosts, "scores", None)
        if scores is None:
            return self.correct(token, p2, p1, n1, n2, boosts)
        key = token, p2, p1, n1, n2, scores
        if key not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[key] = self.correct(token, p2, p1, n1, n2, boosts)
        return self.memo[key]

    def decode(self, text: str, boosts: dict[str, float]) -> str:
        """A text from left to right; what was corrected is the context of what follows."""
        parts = [re.fullmatch(r"([(\[{\"']*)(.*?)([.,;:!?)'\"}\]]*)", t, re.S).groups() for t in text.split()]
        stems = [p[1] for p in parts]
        done: list[str] = []
        for k, stem in enumerate(stems):
            p2, p1 = (done[k - 2] if k > 1 else None), (done[k - 1] if k else None)
            n1, n2 = (stems[k + 1] if k + 1 < len(stems) else None), (stems[k + 2] if k + 2 < len(stems) else None)
            done.append(self._known(stem, p2 or None, p1 or None, n1 or None, n2 or None, boosts))
        return " ".join(a + w + c for (a, _, c), w in zip(parts, done, strict=True))


def _cased(token: str, word: str) -> str:
    return word.upper() if token.isupper() else word.capitalize() if token.istitle() else word


def load_model(lex: DataFrame, bigrams: DataFrame, trigrams: DataFrame, most: int = MAX_TABLE_ROWS) -> Model:
    """Collect the tables after a check of their size; where it fails, correct_by_joins() is the way."""
    out = []
    for t in (lex.select("word", "n"), bigrams.select("w1", "w2", "cnt"), trigrams.select("w1", "w2", "w3", "cnt")):
        rows = t.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows; use correct_by_joins()")
        out.append({r[0] if len(r) == 2 else tuple(r[:-1]): r[-1] for r in rows})
    return Model(*out)


def _boosts(text: str) -> Boosts:
    low = text.lower()
    return _boosts_of(tuple(w * sum(k in low for k in keywords) for w, keywords in domains.DOMAINS.values()))


@lru_cache(10_000)
def _boosts_of(scores: tuple[float, ...]) -> Boosts:
    out = Boosts()
    out.scores = scores
    for score, words in zip(scores, (domains.DOMAIN_WORDS[d] for d in domains.DOMAINS), strict=True):
        if score > 0:
            for w in words:
                out[w] = max(out.get(w, 1.0), 1 + min(score * domains.BOOST_STEP, domains.BOOST_MOST))
    return out


def correct(df: DataFrame, keys: list[str], model: Model, text: str = "text", rules: list[tuple[str, str]] | None = None, places: list[str] | None = None) -> DataFrame:
    """(keys..., corrected): shield, decode in context, phrase rules, place name of the last part, typography, unshield.

    Entities are put back last, so that no step changes them. Null stays null, blank text becomes empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = places or []
    shielded = df.select(*keys, entities.shield(text).alias("s"))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        own = compiled(rules)
        for b in batches:
            b = b.copy()
            b["t"] = [
                None if t is None else snap_last(apply_rules(m.decode(unicodedata.normalize("NFC", t), _boosts(t)), own), names) for t in b["t"]
            ]
            yield b

    rows = shielded.select(*keys, F.col("s.shielded").alias("t"), F.col("s.saved").alias("saved"))
    decoded = rows.mapInPandas(run, f"{schema}, t string, saved array<string>")
    return decoded.select(*keys, entities.unshield(typography("t"), F.coalesce("saved", F.array().cast("array<string>"))).alias("corrected"))


def correct_by_joins(
    df: DataFrame, keys: list[str], lex: DataFrame, bigrams: DataFrame, trigrams: DataFrame, text: str = "text", rules: list[tuple[str, str]] | None = None, places: list[str] | None = None
) -> DataFrame:
    """(keys..., corrected): as correct(), for tables too large to be sent to tasks. keys must identify a row.

    Each text is joined with the words its tokens may stand for, and with the counts of the n-grams that these can form; with no more than those
    it is decoded.
    """
    shielded = cut(df.select(*keys, entities.shield(text).alias("s")).select(*keys, F.col("s.shielded").alias("t"), F.col("s.saved").alias("saved")))
    stems = F.transform(F.filter(F.split(F.col("t"), r"\s+"), lambda w: w != ""), lambda w: F.lower(peel(w)["stem"]))
    toks = shielded.select(*keys, F.posexplode(stems).alias("pos", "token")).where("token <> ''")
    own = toks.select("token").distinct()
    may = cut(lexicon.candidates(own, lex).union(own.select("token", "token")).distinct())
    forms = cut(toks.join(may, "token").select(*keys, "pos", F.col("candidate").alias("w")).distinct())

    def counted(table: DataFrame, n: int) -> DataFrame:
        """(keys..., entries<key, value>) of the n-grams of a table that the forms at neighbouring places make."""
        rows = forms.select(*keys, F.col("pos").alias("p"), F.col("w").alias("w1"))
        for k in range(1, n):
            rows = rows.join(forms.select(*keys, (F.col("pos") - k).alias("p"), F.col("w").alias(f"w{k + 1}")), [*keys, "p"])
        names = [f"w{k + 1}" for k in range(n)]
        hits = rows.select(*keys, *names).distinct().join(table, names)
        count = "n" if n == 1 else "cnt"
        return hits.groupBy(*keys).agg(F.collect_list(F.struct(F.array(*names).alias("key"), F.col(count).alias("value"))).alias(f"e{n}"))

    rows = shielded
    for n, table in ((1, lex.select(F.col("word").alias("w1"), "n")), (2, bigrams), (3, trigrams)):
        rows = rows.join(counted(table, n), keys, "left")
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = places or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = compiled(rules)
        for b in batches:
            out = []
            for t, *tables in zip(b["t"], b["e1"], b["e2"], b["e3"], strict=True):
                if t is None:
                    out.append(None)
                    continue
                words, twos, threes = ({tuple(e["key"]): int(e["value"]) for e in (x if x is not None else ())} for x in tables)
                m = Model({k[0]: n for k, n in words.items()}, twos, threes)
                out.append(snap_last(apply_rules(m.decode(unicodedata.normalize("NFC", t), dict(_boosts(t))), own), names))
            yield b[[*keys, "saved"]].assign(t=out)

    decoded = rows.mapInPandas(run, f"{schema}, saved array<string>, t string")
    return decoded.select(*keys, entities.unshield(typography("t"), F.coalesce("saved", F.array().cast("array<string>"))).alias("corrected"))


def snap_last(text: str, places: list[str], least: float = 0.8) -> str:
    """The text with its part after the last comma replaced by the most similar place name, if similar enough; the first of equal ones."""
    head, comma, tail = text.rpartition(",")
    if not comma or not places or not tail.strip():
        return text
    name = nearest_place(tail.strip(), places, least)
    return f"{head}, {name}" if name else text


def nearest_place(value: str, places: list[str], least: float = 0.8) -> str | None:
    """The place name with the highest matching-blocks ratio to a value, from `least` on; the first of equal ones."""
    best, found = 0.0, None
    low = value.lower()
    for p in places:
        m = difflib.SequenceMatcher(None, low, p.lower())
        if m.real_quick_ratio() < least or m.quick_ratio() < least:
            continue
        r = m.ratio()
        if r >= least and r > best:
            best, found = r, p
    return found


def place_names(names: DataFrame, most: int = 100_000) -> list[str]:
    """The names of a list of places in its order, after a check of its size; nulls are left out."""
    rows = names.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} place names")
    return [r[0] for r in rows if r[0] is not None]


def snap_places(df: DataFrame, col: str, places: list[str], least: float = 0.8) -> DataFrame:
    """(value, place): each distinct value with its nearest place name, or null; equal names are found in the JVM first."""
    values = df.select(F.trim(col).alias("value")).where("value <> ''").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": b["value"], "place": [nearest_place(v, places, least) for v in b["value"]]})

    return values.mapInPandas(run, "value string, place string")
