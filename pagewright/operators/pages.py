"""The work list of pages: order, labels, moves, latest results, finding text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key, stem_of_file
from ..plans.persist import cut


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with a running number from 1 in the given order, without one task that sees all rows.

    Rows are parted by ranges of the order and written; a row's number is its place in its part after the rows of the parts before. The
    order must tell rows apart; nulls come first.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = cut(parts.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["__part"], r["count"]) for r in kept.groupBy("__part").count().collect())
    before, total = {}, 0
    for part, n in counts:
        before[part] = total
        total += n
    ahead = F.create_map(*[F.lit(x) for item in before.items() for x in item])[F.col("__part")] if before else F.lit(0)
    return kept.withColumn(name, (ahead + F.col("__place") + 1).cast("bigint")).drop("__part", "__place")


def ordinals(files: DataFrame, path: str = "path") -> DataFrame:
    """files with folder, name and ordinal: by folder, then by name as people sort. Paths must be distinct; a large folder is no single task."""
    parted = files.withColumn("folder", F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)).withColumn("name", F.regexp_extract(path, r"[^/\\]*$", 0))
    keyed = numbered(parted.withColumn("__natural", natural_key("name")), ["folder", "__natural", "name"], "__number").drop("__natural")
    first = keyed.groupBy("folder").agg(F.min("__number").alias("__first"))
    return keyed.join(first, "folder").withColumn("ordinal", (F.col("__number") - F.col("__first") + 1).cast("int")).drop("__number", "__first")


def page_labels(pages: DataFrame, path: str = "file_path", index: str = "page_index") -> DataFrame:
    """(path, index, total_pages, label, output_name): 'name (Trang i/N)' for files of several pages; the output name is a safe one."""
    one = pages.select(path, index).where(F.col(path).isNotNull() & F.col(index).isNotNull()).distinct()
    totals = one.groupBy(path).agg(F.count("*").alias("total_pages"))
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    number = (F.col(index) + 1).cast("string")
    label = F.when(F.col("total_pages") > 1, F.concat(name, F.lit(" (Trang "), number, F.lit("/"), F.col("total_pages").cast("string"), F.lit(")"))).otherwise(name)
    return one.join(totals, path).select(
        path, index, "total_pages", label.alias("label"), F.concat(stem_of_file(path), F.lit("_p"), F.lpad(number, 4, "0"), F.lit("_highres.pdf")).alias("output_name")
    )


def latest(results: DataFrame, keys: list[str], request: str) -> DataFrame:
    """The row with the highest request of each key, of equal ones always the same; an aggregate, so a hot key is reduced map-side."""
    rest = [c for c in results.columns if c not in keys]
    row = F.struct(*rest)
    return results.groupBy(*keys).agg(F.max_by(row, F.struct(F.col(request), F.to_json(row))).alias("r")).select(*keys, "r.*")


def rotated(rotation: Column, by: Column) -> Column:
    """A rotation turned further, in 0..359."""
    return F.pmod(rotation + by, F.lit(360))


def moved(pages: DataFrame, ordinal: str, frm: int, to: int) -> DataFrame:
    """pages with one page moved from a place to another and the others closed up (places from 1)."""
    o = F.col(ordinal)
    if frm < to:
        new = F.when(o == frm, to).when((o > frm) & (o <= to), o - 1).otherwise(o)
    else:
        new = F.when(o == frm, to).when((o >= to) & (o < frm), o + 1).otherwise(o)
    return pages.withColumn(ordinal, new)


def find_text(df: DataFrame, keys: list[str], text: str, query: str, ignore_case: bool = True) -> DataFrame:
    """(keys..., n_found, first_pos) of the texts that hold the query; places count from 1, hits don't overlap."""
    t, q = (F.lower(text), query.lower()) if ignore_case else (F.col(text), query)
    n = (F.length(t) - F.length(F.replace(t, F.lit(q), F.lit("")))) / len(q)
    return df.where(F.contains(t, F.lit(q))).select(*keys, n.cast("bigint").alias("n_found"), F.locate(q, t).cast("bigint").alias("first_pos"))


def with_cached(pages: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """pages with the cached value where there is one, and needs_run where there is none."""
    one = cache.groupBy(*keys).agg(F.max(value).alias(value))
    return pages.join(one, keys, "left").withColumn("needs_run", F.col(value).isNull())
