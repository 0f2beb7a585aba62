"""Recognition as pluggable functions: detector, two recognisers, and their composition. No weights are bundled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..plans.persist import cut
from .arbitrate import arbitrate
from .layout import bounding_box, page_text
from .lexicon import confidence as words_known
from .raster import crop_polygon

#: What a caller brings: a loader, called once a worker, that gives the function itself.
Detector = Callable[[np.ndarray], list[list[tuple[float, float]]]]
Recognizer = Callable[[np.ndarray], tuple[str, float]]
MODES = ("dual", "vietocr", "paddleocr")


def _image(w, h, c, d) -> np.ndarray:
    return np.frombuffer(d, np.uint8).reshape((int(h), int(w)) if c == 1 else (int(h), int(w), int(c)))


def detect(images: DataFrame, key: str, load: Callable[[], Detector]) -> DataFrame:
    """(key, box_id, polygon, error): the polygons of each image from the top; a failing image has one row with the error and no polygon."""
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            rows = []
            for k, w, h, c, d in zip(b[key], b["width"], b["height"], b["channels"], b["data"], strict=True):
                try:
                    found = sorted(model(_image(w, h, c, d)), key=lambda p: (min(y for _, y in p), min(x for x, _ in p)))
                    rows += [(k, n, [{"x": float(x), "y": float(y)} for x, y in p], None) for n, p in enumerate(found)]
                except Exception as e:
                    rows.append((k, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=[key, "box_id", "polygon", "error"]).astype({"box_id": "Int32"})

    return images.select(key, "width", "height", "channels", "data").mapInPandas(run, f"{key} {kind}, box_id int, polygon array<struct<x:double,y:double>>, error string")


def crops(images: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """(key, box_id, width, height, channels, data): the padded, upright crop of each polygon of four corners and five pixels or more."""
    joined = boxes.where("size(polygon) = 4").select(key, "box_id", "polygon").join(images.select(key, "width", "height", "channels", "data"), key)
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, i, polygon, w, h, c, d in zip(*(b[x] for x in (key, "box_id", "polygon", "width", "height", "channels", "data")), strict=True):
                cut_out = crop_polygon(_image(w, h, c, d), np.array([(p["x"], p["y"]) for p in polygon]))
                if cut_out is not None:
                    rows.append((k, i, cut_out.shape[1], cut_out.shape[0], 1 if cut_out.ndim == 2 else cut_out.shape[2], np.ascontiguousarray(cut_out).tobytes()))
            yield pd.DataFrame(rows, columns=[key, "box_id", "width", "height", "channels", "data"])

    return joined.mapInPandas(run, f"{key} {kind}, box_id int, width int, height int, channels int, data binary")


def recognize(images: DataFrame, keys: list[str], load: Callable[[], Recognizer], prefix: str) -> DataFrame:
    """(keys..., prefix_text, prefix_conf) of each crop; a failure reads as empty with confidence 0. The model is loaded once a worker."""
    schema = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            out = []
            for w, h, c, d in zip(b["width"], b["height"], b["channels"], b["data"], strict=True):
                try:
                    out.append(model(_image(w, h, c, d)))
                except Exception:
                    out.append(("", 0.0))
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(out, columns=[f"{prefix}_text", f"{prefix}_conf"])], axis=1)

    return images.select(*keys, "width", "height", "channels", "data").mapInPandas(run, f"{schema}, {prefix}_text string, {prefix}_conf double")


def read_crops(images: DataFrame, keys: list[str], viet: Callable[[], Recognizer] | None, paddle: Callable[[], Recognizer] | None, mode: str = "dual") -> DataFrame:
    """(keys..., text, conf, winner) with one recogniser, or both and the choice between them; an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    one = {"vietocr": viet, "paddleocr": paddle}
    if mode != "dual":
        r = recognize(images, keys, one[mode], "r")
        return r.select(*keys, F.col("r_text").alias("text"), F.col("r_conf").alias("conf"), F.lit(mode).alias("winner"))
    both = recognize(images, keys, paddle, "p").join(recognize(images, keys, viet, "v"), keys)
    return both.select(*keys, arbitrate(F.col("p_text"), F.col("p_conf"), F.col("v_text"), F.col("v_conf")).alias("a")).select(*keys, "a.*")


def read_pages(
    images: DataFrame, key: str, detector: Callable[[], Detector], viet: Callable[[], Recognizer] | None, paddle: Callable[[], Recognizer] | None, mode: str = "dual",
    correct: Callable[[DataFrame], DataFrame] | None = None, lexicon: DataFrame | None = None,
) -> DataFrame:
    """(key, full_text, n_boxes, char_count, word_count, confidence, error) of each image: detect, crop, read, correct, order, join.

    correct takes and gives (key, box_id, text). Boxes that read blank are left out. With a lexicon, confidence is the least of what the
    recognisers say on average and what the share of known words says. Images without text have an empty one; those that fail, an error.
    """
    found = cut(detect(images.where("data is not null"), key, detector))
    boxes = found.where("polygon is not null").select(key, "box_id", "polygon")
    read = cut(read_crops(crops(images, boxes, key), [key, "box_id"], viet, paddle, mode))
    if correct is not None:
        read = correct(read.select(key, "box_id", "text")).join(read.select(key, "box_id", "conf"), [key, "box_id"])
    size = images.select(key, F.col("width").alias("img_w"))
    placed = boxes.join(read.where("trim(text) <> ''"), [key, "box_id"]).join(size, key).select(key, "box_id", "text", "conf", "img_w", bounding_box(F.col("polygon")).alias("r")).select(key, "box_id", "text", "conf", "img_w", "r.*")
    texts = page_text(placed, key, "box_id").select(key, F.col("text").alias("full_text"))
    totals = placed.groupBy(key).agg(F.count("*").alias("n_boxes"), F.avg("conf").alias("c"))
    errors = found.where("error is not null").groupBy(key).agg(F.min("error").alias("e"))
    out = images.select(key, F.col("data").isNull().alias("gone")).join(texts, key, "left").join(totals, key, "left").join(errors, key, "left")
    text = F.coalesce("full_text", F.lit(""))
    rows = out.select(
        key, text.alias("full_text"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), F.length(text).alias("char_count"), word_count(text).alias("word_count"),
        F.coalesce("c", F.lit(0.0)).alias("confidence"), F.when(F.col("gone"), "no image").otherwise(F.col("e")).alias("error"),
    )
    if lexicon is None:
        return rows
    known = words_known(rows, [key], lexicon, "full_text").select(key, F.col("confidence").alias("k"))
    return rows.join(known, key).withColumn("confidence", F.least("confidence", "k")).drop("k")


def compare(base: DataFrame, tuned: DataFrame, corrected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., base_text, tuned_text, corrected_text, tuned_changed, corrected_changed) of three tables (keys..., text)."""
    named = [t.select(*keys, F.col("text").alias(f"{n}_text")) for t, n in ((base, "base"), (tuned, "tuned"), (corrected, "corrected"))]
    rows = named[0].join(named[1], keys).join(named[2], keys)
    return rows.select("*", (~F.col("base_text").eqNullSafe(F.col("tuned_text"))).alias("tuned_changed"), (~F.col("tuned_text").eqNullSafe(F.col("corrected_text"))).alias("corrected_changed"))
