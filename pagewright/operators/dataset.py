"""Building recognition training sets: gates, cleaning, oversampling, splits, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc
from ..plans.persist import cut
from .decode import phrase_rules
from .pages import numbered

# Fixed values of the gates.
LEAST_CROP, LEAST_SAMPLE, MOST_LABEL = (10, 12), (8, 8), 120


def is_copy(path: Column) -> Column:
    """Whether a file's name says that it is a copy."""
    return F.contains(F.lower(F.regexp_extract(path, r"[^/\\]*$", 0)), F.lit(" - copy"))


def crop_gate(h: Column, w: Column) -> Column:
    """Large enough to be read; false for null."""
    return F.coalesce((h >= LEAST_CROP[0]) & (w >= LEAST_CROP[1]), F.lit(False))


def text_gate(text: Column) -> Column:
    """At least two characters in composed form after trimming, one of them a letter or digit; false for null."""
    t = F.trim(nfc(text))
    return F.coalesce((F.length(t) >= 2) & t.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def sample_gate(h: Column, w: Column, label: Column) -> Column:
    return F.coalesce((h >= LEAST_SAMPLE[0]) & (w >= LEAST_SAMPLE[1]) & (F.length(label) <= MOST_LABEL), F.lit(False))


def with_files(labels: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Labels that aren't empty and whose file is there."""
    return labels.where(F.length(F.trim("label")) > 0).join(files.select(path).distinct(), path, "left_semi")


def oversample(df: DataFrame, weight: Column) -> DataFrame:
    """Each row `weight` times, with copy_no from 0; a weight of null counts as 1, one of 0 drops the row."""
    n = F.coalesce(weight.cast("int"), F.lit(1))
    return df.where(n > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(0), n - 1)))


def hash_order(key: Column, seed: int) -> Column:
    """A seeded order of rows that any engine can repeat: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def split(df: DataFrame, key: str, seed: int = 42, val_share: float = 0.15) -> DataFrame:
    """df with split train or val by the hash of the key: no sort, and copies of a key never part."""
    share = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(16**8)
    return df.withColumn("split", F.when(share < val_share, "val").otherwise("train"))


def split_exact(df: DataFrame, key: str, seed: int = 42, val_share: float = 0.15, least: int = 10) -> DataFrame:
    """(key, split): exactly max(least, share of all) keys, at most all, in val: the first in hash order.

    The border is found by counts of hash prefixes (at most 65,536); only the keys that share its prefix are sorted.
    """
    keys = cut(df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__h", hash_order(F.col(key), seed)))
    prefix = F.substring("__h", 1, 4)
    counts = sorted((r["p"], r["count"]) for r in keys.groupBy(prefix.alias("p")).count().collect())
    n = sum(c for _, c in counts)
    wanted = min(n, max(least, int(n * val_share)))
    seen = 0
    for p, c in counts:
        if seen + c >= wanted:
            break
        seen += c
    if not wanted:
        return keys.select(key, F.lit("train").alias("split"))
    last = keys.where(prefix == p).orderBy("__h", key).limit(wanted - seen).orderBy(F.desc("__h"), F.desc(key)).first()
    first = (F.col("__h") < last["__h"]) | ((F.col("__h") == last["__h"]) & (F.col(key) <= F.lit(last[key])))
    return keys.select(key, F.when(first, "val").otherwise("train").alias("split"))


def first_documents(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded hash order."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def char_dictionary(df: DataFrame, text: str, base: str = "") -> DataFrame:
    """(ch, n): the characters of the texts and of a base alphabet but white space, with counts. Each text is counted first."""
    own = df.select(F.explode(F.split(text, "")).alias("ch")).where("ch <> '' and not ch rlike '\\\\s'").groupBy("ch").agg(F.count("*").alias("n"))
    if not base:
        return own
    rest = df.sparkSession.createDataFrame([(c, 0) for c in sorted(set(base)) if not c.isspace()], "ch string, n bigint")
    return own.union(rest).groupBy("ch").agg(F.sum("n").alias("n"))


def crop_names(df: DataFrame, order: list[str]) -> DataFrame:
    """df with crop_name: crop_ and a running number of six digits or more through all rows, in the given order, which must tell rows apart."""
    return numbered(df, order, "__number").withColumn("crop_name", F.format_string("crop_%06d.jpg", "__number")).drop("__number")


#: Phrases that labels are snapped to.
LABEL_PHRASES = (
    "Mã hàng", "Tên hàng", "Đơn giá", "Thành tiền", "Số lượng", "Ghi chú", "Tổng cộng", "Tổng tiền thanh toán", "Cộng tiền hàng", "Đơn vị tính", "Diễn giải",
    "Phiếu giao hàng", "Phiếu xuất kho", "Thủ kho", "Phòng kế toán", "Người nhận", "Người gửi", "Người lập phiếu", "Địa điểm giao hàng", "Số tiền viết bằng chữ",
    "Mã số thuế", "Số tài khoản", "Ngân hàng", "Khách hàng ký nhận",
)


def clean_label(text: Column, phrases: tuple[str, ...] = LABEL_PHRASES) -> Column:
    """The label in composed form, trimmed, with each phrase as it should be, whatever accents, case or blanks it had; in order.

    A phrase counts only as whole words. Null stays null.
    """
    out = F.trim(nfc(text))
    for pattern, phrase in phrase_rules(phrases):
        out = F.regexp_replace(out, f"(?iU)(?<![\\p{{L}}\\p{{M}}\\p{{N}}_]){pattern.removeprefix(BOUND).removesuffix(BOUND)}(?![\\p{{L}}\\p{{M}}\\p{{N}}_])", phrase)
    return F.trim(out)


BOUND = r"\b"


def changed_labels(df: DataFrame, text: str) -> DataFrame:
    """(n_rows, n_changed) of cleaning a label column; a change is null-safe."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(~clean_label(F.col(text)).eqNullSafe(F.col(text))).alias("n_changed"))
