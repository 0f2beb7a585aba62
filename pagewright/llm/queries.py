"""Queries of the operators in this subpackage: name -> (spark, folder of tables) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.persist import cut
from . import addressing, canon, leak, overlap, packing, personal, places, plainform, reading, scannoise


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _p1_values(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    entries = canon.entries(_read(spark, folder, "ref_value"))
    values = canon.field_values(_read(spark, folder, "ocr_result"), sorted({f for _, f, _ in entries}))
    return values, canon.map_values(values, entries, canon.word_counts(values, entries), ["result_id"], canon.learn_decorations(values, entries))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p1_values(spark, folder)[1].distinct()


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that stand for no entry, with their counts."""
    values, mapped = _p1_values(spark, folder)
    return canon.unmatched(values, mapped, ["result_id"])


def _place_words(spark: SparkSession, folder: str) -> addressing.PlaceWords:
    provinces = [name for _, field, name in canon.entries(_read(spark, folder, "ref_value")) if field == "tinh_thanh"]
    return addressing.place_words(_read(spark, folder, "ocr_result"), reference=provinces)


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    words = _place_words(spark, folder)
    addresses = cut(places.read_addresses(_read(spark, folder, "ocr_result"), words))
    return cut(places.places(cut(places.linked(addresses, places.gazetteer(addresses, words)))))


def p2_places(spark: SparkSession, folder: str) -> DataFrame:
    """Every result with an address, the place it denotes, and the number of other results there."""
    return places.classes(_placed(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return places.pairs(_placed(spark, folder))


def _personal(spark: SparkSession, folder: str, texts: bool) -> DataFrame:
    results = _read(spark, folder, "ocr_result")
    return personal.scan(results, personal.learn_names(results), _place_words(spark, folder), texts)


def p3_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every text and map value with placeholders for its personal items, and the items."""
    return _personal(spark, folder, True)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    items = _personal(spark, folder, False).select("result_id", "field_name", F.explode("items").alias("i"))
    return items.select("result_id", "field_name", "i.kind", "i.start_pos").distinct()


def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's text, from its lines and from its boxes, in paragraphs, with the noisy spots."""
    results, boxes = _read(spark, folder, "ocr_result"), _read(spark, folder, "ocr_box")
    pages = cut(scannoise.text_pages(results).unionByName(scannoise.box_pages(boxes, results)))
    running, openers, page_words = scannoise.running_lines(pages)
    return scannoise.repair(pages, running, scannoise.vocabulary(results), openers, page_words)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The noisy spots but feet, which have no kind of their own there."""
    return p4_texts(spark, folder).select("result_id", "unit", F.explode("spots").alias("s")).select("result_id", "unit", "s.pos", "s.kind").where("kind <> 'footer'")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = overlap.overlaps(_read(spark, folder, "train_annotation"))
    return found.select(F.least("train_id", "held_id").alias("sample_a"), F.greatest("train_id", "held_id").alias("sample_b"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps, distinct held-out records, and spans of their labels, by split and source of the held-out record and way of finding."""
    rows = _read(spark, folder, "train_annotation")
    held = rows.select(F.col("sample_id").alias("held_id"), "split", "source")
    return (
        overlap.overlaps(rows).join(held, "held_id").groupBy("split", "source", "by_path", "by_label")
        .agg(F.count("*").alias("n_pairs"), F.countDistinct("held_id").alias("n_records"), F.sum("spans").alias("n_spans"), F.sum("chars").alias("n_chars"))
    )


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the class of its exact copies and the number of records of the other side that it overlaps with."""
    return overlap.links(_read(spark, folder, "train_annotation"))


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of train and ocr_box whose plain form differs, with that form."""
    rows = _read(spark, folder, "train").select(F.lit("train").alias("origin"), F.col("line_id").alias("row_id"), "text").unionByName(
        _read(spark, folder, "ocr_box").select(F.lit("ocr_box").alias("origin"), F.col("box_key").alias("row_id"), "text")
    )
    return plainform.plain_form(rows, ["origin", "row_id"]).where("plain <> raw")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_texts(spark, folder).select("origin", "row_id")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in containers of every kind."""
    kinds = packing.container_kinds(_read(spark, folder, "container_kind"))
    return packing.repack(packing.pack(packing.sizes(_read(spark, folder, "documents")), kinds), kinds)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that the packing had to cut, by kind: those with a second piece."""
    kinds = packing.container_kinds(_read(spark, folder, "container_kind"))
    packed = packing.pack(packing.sizes(_read(spark, folder, "documents")), kinds)
    return packed.where("piece = 2").select("doc_id", "kind_id").distinct()


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry two fifths of a held-out passage or more, with the words covered."""
    return leak.leaks(_read(spark, folder, "documents"), _read(spark, folder, "bench_item"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents")
    texts, levels = reading.rated_sample(documents, _read(spark, folder, "level_label"))
    return reading.bands(documents, reading.fit(texts, levels)).select("doc_id", "band").distinct()


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and words of each band, by source."""
    documents = _read(spark, folder, "documents")
    texts, levels = reading.rated_sample(documents, _read(spark, folder, "level_label"))
    banded = reading.bands(documents.select("doc_id", "text"), reading.fit(texts, levels))
    return banded.join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "band").agg(F.count("*").alias("n_docs"), F.sum("words").alias("n_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_places, p3_found, p3_masked, p4_found, p4_texts, p5_found, p5_report, p5_links, p6_found, p6_texts, p7_found, p7_containers, p8_found, p8_leaks, p9_found, p9_profile)}

_MARKED = "[\\x{300}-\\x{36f}\\x{a0}\\x{ad}\\x{1680}\\x{2000}-\\x{200f}\\x{202a}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}\\x{ff01}-\\x{ff5e}\\x{fb00}-\\x{fb06}ɑıɡÐðƉɖ]"
# A word that mixes Latin letters with those of an alphabet that has look-alikes of them, said without the operator's table.
_OTHER = "\\p{Greek}\\p{Cyrillic}\\p{Armenian}\\p{Cherokee}"
_WORDPART = "[\\p{L}\\p{M}\\p{N}\\p{Cf}]*"
_MIXED = f"\\p{{Latin}}{_WORDPART}[{_OTHER}]|[{_OTHER}]{_WORDPART}\\p{{Latin}}"

SQL = {
    "p6_found": f"""
        SELECT origin, row_id FROM (
            SELECT 'train' AS origin, line_id AS row_id, text FROM train
            UNION ALL SELECT 'ocr_box', box_key, text FROM ocr_box)
        WHERE regexp_matches(text, '{_MARKED}') OR regexp_matches(text, '{_MIXED}')""",
    "p7_found": """
        SELECT DISTINCT doc_id, kind_id FROM documents, container_kind
        WHERE strlen(text) + 1 > capacity""",
}
