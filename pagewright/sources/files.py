"""Scans: folders of images and documents, label files, lexicons, n-gram files, options."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key, nfc

# Extensions of images, and of documents of several pages.
IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "webp", "jfif", "jxl", "gif", "jp2", "ppm", "pgm")
PAGED_TYPES = ("tiff", "tif", "pdf")
ALL_TYPES = IMAGE_TYPES + PAGED_TYPES
#: Files of a folder from which a first part may be taken, and how many that is.
LARGE_FOLDER, FIRST_PART = 150, 100


def scan_folder(spark: SparkSession, root: str, types: tuple[str, ...] = ALL_TYPES, content: bool = False) -> DataFrame:
    """(path, folder, name, ext, length[, content], natural) of the files below a folder with these extensions.

    The content is read only if asked for: the filter stands on the path, before it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = files.where(ext.isin(*types)).select(
        "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"[^/]*$", 0).alias("name"), ext.alias("ext"), "length",
        *([F.col("content")] if content else []),
    )
    return out.withColumn("natural", natural_key("name"))


def file_list(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The given files in the order of folder and name as people sort; paths without a file are an error."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    parted = files.select("path", "length", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"[^/]*$", 0).alias("name"))
    return parted.orderBy("folder", natural_key("name"), "name")


def first_part(files: DataFrame, large: int = LARGE_FOLDER, first: int = FIRST_PART) -> DataFrame:
    """The first files of a large list in natural order; a list that isn't large stays whole."""
    if files.limit(large + 1).count() <= large:
        return files
    return files.orderBy("folder", "natural", "name").limit(first)


def sample_files(files: DataFrame, types: tuple[str, ...] = ("png", "jpg"), each: int = 3) -> DataFrame:
    """The first files of each of some extensions."""
    out = None
    for t in types:
        part = files.where(F.col("ext") == t).orderBy("folder", "natural").limit(each)
        out = part if out is None else out.unionByName(part)
    return out


#: A decoder: bytes and extension -> list of pages (width, height, channels, pixels).
Decoder = Callable[[bytes, str], list[tuple[int, int, int, bytes]]]


def pages(files: DataFrame, decode: Decoder) -> DataFrame:
    """One row per page of each file, read with the decoder that is given; a file that fails gives one row with an error.

    files must hold content. No page is made up: what can't be read has a null image.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, ext, content in zip(b["path"], b["ext"], b["content"], strict=True):
                try:
                    read = decode(bytes(content), ext)
                    rows += [(path, k, len(read), w, h, c, px, None) for k, (w, h, c, px) in enumerate(read)]
                except Exception as e:
                    rows.append((path, 0, 0, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "page_index", "total_pages", "width", "height", "channels", "data", "error"]).astype(
                {"width": "Int32", "height": "Int32", "channels": "Int32"}
            )

    return files.select("path", "ext", "content").mapInPandas(
        run, "path string, page_index int, total_pages int, width int, height int, channels int, data binary, error string"
    )


def decode_portable(content: bytes, ext: str) -> list[tuple[int, int, int, bytes]]:
    """Decoder of binary PGM and PPM files (one or more images in a file); other codecs are given by the caller."""
    out, at = [], 0
    while at < len(content):
        words: list[bytes] = []
        while len(words) < 4:
            while at < len(content) and content[at : at + 1].isspace():
                at += 1
            if content[at : at + 1] == b"#":
                at = content.index(b"\n", at) + 1
                continue
            end = at
            while end < len(content) and not content[end : end + 1].isspace():
                end += 1
            if end == at:
                raise ValueError("no portable image")
            words.append(content[at:end])
            at = end
        at += 1
        if words[0] not in (b"P5", b"P6") or words[3] != b"255":
            raise ValueError("no portable image of eight bits")
        w, h, c = int(words[1]), int(words[2]), 1 if words[0] == b"P5" else 3
        data = content[at : at + w * h * c]
        if len(data) < w * h * c:
            raise ValueError("image cut short")
        out.append((w, h, c, data))
        at += w * h * c
        while at < len(content) and content[at : at + 1].isspace():
            at += 1
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(rel_img, text) of a file of tab-separated lines; lines with less than two fields are left out, more are cut off.

    Read as text, not CSV: quotes in labels are text.
    """
    parts = F.split(F.trim("value"), "\t")
    return spark.read.text(path).where(F.size(parts) >= 2).select(parts[0].alias("rel_img"), nfc(parts[1]).alias("text"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(rel_img, text) of a file that holds one JSON object of image and text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("rel_img", "t")).select("rel_img", nfc("t").alias("text"))


def read_ngrams(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(w1..wn, cnt) of a JSON object of words joined by '_' and counts; keys of another length are left out."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("key", "cnt")).withColumn("w", F.split("key", "_"))
    return rows.where(F.size("w") == n).select(*[F.col("w")[k].alias(f"w{k + 1}") for k in range(n)], "cnt")


def read_options(path: str, defaults: dict, renamed: dict[str, dict] | None = None) -> dict:
    """Options of a JSON file over defaults; renamed maps old values of a key to new ones. A missing or broken file gives the defaults."""
    out = dict(defaults)
    try:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        out.update(own if isinstance(own, dict) else {})
    except (OSError, ValueError):
        pass
    for key, values in (renamed or {}).items():
        out[key] = values.get(out.get(key), out.get(key))
    return out


def first_existing(paths: list[str], least_bytes: int = 0) -> str | None:
    """The first of these files that is there and large enough."""
    import os

    return next((p for p in paths if os.path.isfile(p) and os.path.getsize(p) > least_bytes), None)
