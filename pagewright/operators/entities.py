"""Sensitive entities in text: found, shielded by placeholders and put back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order in which they are tried at a place, and their forms.
KINDS = (
    ("url", r"https?://[^\s,;]+"),
    ("www", r"www\.[^\s,;]+"),
    ("email", r"[\w\.-]+@[\w\.-]+\.[a-zA-Z]{2,}"),
    ("currency", r"\b\d{1,3}(?:\.\d{3})+(?:\s*[đĐ]|\s*VND|\s*vnd)?\b"),
    ("tax_id", r"\b\d{10}(?:-\d{3})?\b"),
    ("account", r"\b\d{9,16}\b"),
    ("sku", r"\b[A-Z0-9]{2,8}-[A-Z0-9]{2,8}(?:-[A-Z0-9]+)?\b"),
    ("bracketed", r"\b\([A-Z0-9\-]{4,12}\)\b"),
    ("code", r"\b[A-Z]{2,}\d{2,}\b"),
    ("date", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
)
#: The leftmost place wins, then the first kind: one alternation in that order. Word limits are those of Unicode.
PATTERN = "(?U)" + "|".join(p for _, p in KINDS)
_FREE = "\u0001"


def entities(text: Column | str) -> Column:
    """Array of the entities of a text, from left to right; null for null."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(PATTERN), F.lit(0))


def kind_of(entity: Column) -> Column:
    """Kind of an entity: the first whose form it has as a whole."""
    out = None
    for kind, pattern in KINDS:
        hit = entity.rlike(f"(?U)^(?:{pattern.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def shield(text: Column | str) -> Column:
    """(shielded, saved): each entity replaced by __SHIELD_ENT_n__, and the entities in order."""
    c = F.col(text) if isinstance(text, str) else text
    saved = entities(c)
    pieces = F.split(F.regexp_replace(c, PATTERN, _FREE), _FREE, -1)
    marked = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("__SHIELD_ENT_"), (i - 1).cast("string"), F.lit("__"), p)))
    return F.struct(F.array_join(marked, "").alias("shielded"), saved.alias("saved"))


def unshield(shielded: Column, saved: Column) -> Column:
    """The text with its entities put back."""
    numbered = F.transform(saved, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.aggregate(numbered, shielded, lambda t, e: F.replace(t, F.concat(F.lit("__SHIELD_ENT_"), e["i"].cast("string"), F.lit("__")), e["v"]))


def entity_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., position, entity, kind), one row per entity; position counts from 1. Rows without entities give none."""
    rows = df.select(*keys, F.posexplode(entities(text)).alias("position", "entity"))
    return rows.select(*keys, (F.col("position") + 1).alias("position"), "entity", kind_of(F.col("entity")).alias("kind"))


def entity_summary(df: DataFrame, by: str, key: str, text: str = "text") -> DataFrame:
    """(by, kind, n_entities, n_rows) over all rows."""
    return entity_rows(df, [key, by], text).groupBy(by, "kind").agg(F.count("*").alias("n_entities"), F.countDistinct(key).alias("n_rows"))
