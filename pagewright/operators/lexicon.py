"""Lexicon and n-gram tables: built from a corpus or read from files, and looked up by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfc, remove_accents

# What recognisers confuse; each pair is applied on its own.
HOMOGLYPHS = (("cl", "d"), ("rn", "m"), ("vv", "w"), ("ri", "n"), ("0", "o"), ("1", "l"), ("1", "i"), ("1", "t"), ("5", "s"), ("8", "b"))
# Weights of the five-word context: bigram before, after; trigram before, around, after.
CONTEXT_WEIGHTS = (1.5, 1.2, 2.5, 3.0, 2.0)


def tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., pos, token): lower-case words parted by anything but letters, marks and digits; pos counts from 0."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return df.select(*keys, F.posexplode(words).alias("pos", "token"))


def lexicon(df: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """(word, n) of the words of letters only that stand at least `least` times."""
    return tokens(df, [], text).where("token rlike '^[\\\\p{L}\\\\p{M}]+$'").groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def lexicon_from_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(word): composed, trimmed, lower-case, distinct, without blanks, of a file with one word a line."""
    word = F.lower(F.trim(nfc(col)))
    return lines.select(word.alias("word")).where("word <> ''").distinct()


def by_unaccented(words: DataFrame) -> DataFrame:
    """(unaccented, words): the words of each form without accents, sorted."""
    return words.groupBy(remove_accents("word").alias("unaccented")).agg(F.sort_array(F.collect_set("word")).alias("words"))


def ngrams(df: DataFrame, keys: list[str], n: int, text: str = "text") -> DataFrame:
    """(w1..wn, cnt) over all rows. The n-grams come from each row's own array of words: no window, no sort."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    at = F.sequence(F.lit(0), F.size("ws") - n)
    grams = F.when(F.size("ws") >= n, F.transform(at, lambda i: F.struct(*[F.get("ws", i + k).alias(f"w{k + 1}") for k in range(n)])))
    rows = df.select(words.alias("ws")).select(F.explode(grams).alias("g")).select("g.*")
    return rows.groupBy(*[f"w{k + 1}" for k in range(n)]).agg(F.count("*").alias("cnt"))


def overlay(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables; where a key is in both, those of `over`."""
    return base.join(over.select(*keys).distinct(), keys, "left_anti").unionByName(over)


def candidate_stems(token: Column) -> Column:
    """Forms that a lower-case token may stand for: itself, without accents, with each confusion undone, d also as đ."""
    plain = remove_accents(token)
    forms = [token, plain, F.replace(plain, F.lit("d"), F.lit("đ"))]
    for wrong, right in HOMOGLYPHS:
        fixed = F.replace(plain, F.lit(wrong), F.lit(right))
        forms += [F.when(F.contains(plain, F.lit(wrong)), fixed), F.when(F.contains(plain, F.lit(wrong)), F.replace(fixed, F.lit("d"), F.lit("đ")))]
    return F.array_sort(F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull())))


def bypass(token: Column) -> Column:
    """Whether a token is left as it is: under two characters, a placeholder, a number, or part of an address, date or amount."""
    return (F.length(token) < 2) | token.startswith("__SHIELD_ENT_") | token.rlike(r"^\d+$") | token.rlike("[@/:#$%]")


def candidates(words: DataFrame, lex: DataFrame) -> DataFrame:
    """(token, candidate): the words of the lexicon that distinct tokens may stand for, by their stems with and without accents."""
    stems = words.select("token", F.explode(candidate_stems(F.col("token"))).alias("stem"))
    known = lex.select(F.col("word").alias("candidate"))
    exact = stems.join(known, stems["stem"] == known["candidate"]).select("token", "candidate")
    loose = stems.join(known.withColumn("plain", remove_accents("candidate")), F.col("stem") == F.col("plain")).select("token", "candidate")
    return exact.union(loose).distinct()


def context_scores(toks: DataFrame, key: str, bigrams: DataFrame, trigrams: DataFrame) -> DataFrame:
    """toks (key, pos, token) with the score of the token's five-word context; n-grams that aren't counted score 0."""
    w = Window.partitionBy(key).orderBy("pos")
    c = toks.select(
        key, "pos", "token", F.lag("token", 2).over(w).alias("p2"), F.lag("token").over(w).alias("p1"),
        F.lead("token").over(w).alias("n1"), F.lead("token", 2).over(w).alias("n2"),
    )
    score = F.lit(0.0)
    for k, (names, table) in enumerate(
        ((("p1", "token"), bigrams), (("token", "n1"), bigrams), (("p2", "p1", "token"), trigrams), (("p1", "token", "n1"), trigrams), (("token", "n1", "n2"), trigrams))
    ):
        t = table.select(*[F.col(f"w{i + 1}").alias(f"j{k}_{i}") for i in range(len(names))], F.col("cnt").alias(f"c{k}"))
        on = None
        for i, n in enumerate(names):
            e = F.col(n) == F.col(f"j{k}_{i}")
            on = e if on is None else on & e
        c = c.join(t, on, "left").drop(*[f"j{k}_{i}" for i in range(len(names))])
        score = score + F.coalesce(f"c{k}", F.lit(0)) * CONTEXT_WEIGHTS[k]
    return c.select(key, "pos", "token", F.round(score, 4).alias("score"))


def confidence(df: DataFrame, keys: list[str], lex: DataFrame, text: str = "text") -> DataFrame:
    """(keys..., n_words, confidence): .70 + .25 of the share of words that are known or hold a digit, at most .98; .5 without words."""
    known = lex.select(F.col("word").alias("token"), F.lit(1).alias("hit"))
    words = tokens(df, keys, text).join(known, "token", "left")
    valid = F.avg(F.when(F.col("hit").isNotNull() | F.col("token").rlike("[0-9]"), 1.0).otherwise(0.0))
    scored = words.groupBy(*keys).agg(F.count("*").alias("n_words"), F.round(F.least(F.lit(0.98), 0.70 + 0.25 * valid), 6).alias("confidence"))
    return df.select(*keys).join(scored, keys, "left").select(*keys, F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
