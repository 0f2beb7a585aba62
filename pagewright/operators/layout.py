"""Columns, lines and reading order of the text boxes of a page.

The column search is a histogram, a gap search and a top 1, all in the JVM: a page's boxes are gathered once into an
array (a page holds few) and the rest are expressions on it, so finding columns takes one shuffle, by page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import let

# Fixed values of the layout rules.
BINS, FIRST_BIN, END_BIN, GUTTER_BINS = 100, 15, 85, 3
LEAST_DENSITY, DENSITY_SHARE = 0.5, 0.08
X_OVERLAP, Y_OVERLAP, LEAST_GAP, GAP_SHARE = 0.25, 0.35, 8.5, 0.60


def bounding_box(polygon: Column) -> Column:
    """(x, y, w, h) of a polygon; null for an empty or null one."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.when(F.size(polygon) > 0, F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h")))


def extent(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, n, img_w, left, right): boxes of a page and what they span, inside the image."""
    return boxes.groupBy(page).agg(
        F.count("*").alias("n"), F.max("img_w").alias("img_w"),
        F.greatest(F.lit(0.0), F.min("x")).alias("left"), F.least(F.max("img_w").cast("double"), F.max(F.col("x") + F.col("w"))).alias("right"),
    )


def _gathered(boxes: DataFrame, page: str) -> DataFrame:
    """(page, b, e): the boxes of each page as an array of structs, and what they span. A page's boxes are few."""
    all_boxes = boxes.groupBy(page).agg(F.collect_list(F.struct(*[c for c in boxes.columns if c != page])).alias("b"))
    values = lambda f: F.transform("b", f)
    e = F.struct(
        F.size("b").alias("n"), F.array_max(values(lambda x: x["img_w"])).alias("img_w"), F.greatest(F.lit(0.0), F.array_min(values(lambda x: x["x"]))).alias("left"),
        F.least(F.array_max(values(lambda x: x["img_w"])).cast("double"), F.array_max(values(lambda x: x["x"] + x["w"]))).alias("right"),
    )
    return all_boxes.withColumn("e", e)


def _density(b: Column, e: Column) -> Column:
    """How many boxes stand over each of 100 bins of the page's extent; null for pages of less than four boxes or without an extent."""
    step = (e["right"] - e["left"]) / BINS
    spans = F.transform(b, lambda x: F.struct(
        F.greatest(F.lit(0), ((x["x"] - e["left"]) / step).cast("int")).alias("a"), F.least(F.lit(BINS - 1), ((x["x"] + x["w"] - e["left"]) / step).cast("int")).alias("z")
    ))
    counted = let(spans, lambda s: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.size(F.filter(s, lambda x: (x["a"] <= k) & (k <= x["z"])))))
    return F.when((e["n"] >= 4) & (e["right"] > e["left"]), counted)


def projection(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, bin, density): how many boxes stand over each of 100 bins of the page's extent; bins without are left out."""
    bins = _gathered(boxes, page).select(page, F.posexplode(_density(F.col("b"), F.col("e"))).alias("bin", "density"))
    return bins.where("density > 0").select(page, "bin", F.col("density").cast("bigint").alias("density"))


def _widest_gap(density: Column, e: Column) -> Column:
    """(start_bin, end_bin, gutter_x) of the widest empty strip, the first of equal ones; null where there is none."""
    mean = F.aggregate(density, F.lit(0.0), lambda a, d: a + d) / BINS
    fits = (e["img_w"] >= 100) & (e["right"] - e["left"] >= 0.4 * e["img_w"])

    def gap(most: Column) -> Column:
        # A strip grows bin by bin; the widest so far is kept.
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("best"), F.lit(0).alias("width"))

        def grow(a: Column, k: Column) -> Column:
            empty = F.get(density, k) <= most
            at, n = F.when(a["n"] > 0, a["at"]).otherwise(k), F.when(empty, a["n"] + 1).otherwise(0)
            wider = empty & (a["n"] + 1 > a["width"])
            return F.struct(at.alias("at"), n.alias("n"), F.when(wider, at).otherwise(a["best"]).alias("best"), F.when(wider, a["n"] + 1).otherwise(a["width"]).alias("width"))

        return F.aggregate(F.sequence(F.lit(FIRST_BIN), F.lit(END_BIN - 1)), start, grow)

    def placed(g: Column) -> Column:
        center = e["left"] + (2 * g["best"] + g["width"]) / 2.0 * (e["right"] - e["left"]) / BINS
        return F.when(g["width"] >= GUTTER_BINS, F.struct(g["best"].alias("start_bin"), (g["best"] + g["width"]).alias("end_bin"), center.alias("gutter_x")))

    return F.when(density.isNotNull() & fits, let(F.greatest(F.lit(LEAST_DENSITY), DENSITY_SHARE * mean), lambda most: let(gap(most), placed)))


def gutters(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, start_bin, end_bin, gutter_x): the widest empty strip of each page that has one; the first of equal ones."""
    found = _with_gutters(boxes, page).select(page, F.explode(F.filter(F.array("g"), lambda g: g.isNotNull())).alias("g"))
    return found.select(page, "g.start_bin", "g.end_bin", "g.gutter_x")


def _with_gutters(boxes: DataFrame, page: str) -> DataFrame:
    dense = _gathered(boxes, page).withColumn("d", _density(F.col("b"), F.col("e")))
    return dense.withColumn("g", _widest_gap(F.col("d"), F.col("e")))


def columns(boxes: DataFrame, page: str = "page_id", box: str = "box_id") -> DataFrame:
    """boxes with col_id: 0, or 1 right of a gutter that leaves two boxes and 50 pixels of height on either side."""
    pages = _with_gutters(boxes, page)
    side = lambda x: F.when(x["x"] + x["w"] / 2.0 < F.col("g.gutter_x"), 0).otherwise(1)

    def enough(k: int) -> Column:
        return let(F.filter("b", lambda x: side(x) == k), lambda own: (F.size(own) >= 2) & (
            F.array_max(F.transform(own, lambda x: x["y"] + x["h"])) - F.array_min(F.transform(own, lambda x: x["y"])) >= 50))

    two = F.coalesce(F.col("g").isNotNull() & enough(0) & enough(1), F.lit(False))
    rows = pages.select(page, "g", two.alias("two"), F.explode("b").alias("x"))
    return rows.select(*[F.col(page) if c == page else F.col(f"x.{c}").alias(c) for c in boxes.columns], F.when(F.col("two"), side(F.col("x"))).otherwise(0).alias("col_id"))


def group_lines(rows: list[tuple[float, float, float, float, int]]) -> list[list[int]]:
    """Lines of one column from (x, y, w, h, id) of its boxes, greedily from the top; boxes of a line from left to right."""
    lines: list[dict] = []
    for x, y, w, h, i in sorted(rows, key=lambda r: (r[1], r[0], r[4])):
        best, near = None, float("inf")
        for line in lines:
            if any(min(w, b[2]) > 0 and (min(x + w, b[0] + b[2]) - max(x, b[0])) / min(w, b[2]) > X_OVERLAP for b in line["boxes"]):
                continue
            low = min(h, line["h"])
            apart = abs(y + h / 2 - line["sum"] / len(line["boxes"]))
            if (min(y + h, line["bottom"]) - max(y, line["top"]) > Y_OVERLAP * low or apart < max(LEAST_GAP, GAP_SHARE * low)) and apart < near:
                best, near = line, apart
        if best is None:
            best = {"boxes": [], "top": y, "bottom": y + h, "h": h, "sum": 0.0}
            lines.append(best)
        best["boxes"].append((x, y, w, h, i))
        best["top"], best["bottom"], best["h"] = min(best["top"], y), max(best["bottom"], y + h), min(best["h"], h)
        best["sum"] += y + h / 2
    lines.sort(key=lambda n: n["sum"] / len(n["boxes"]))
    return [[b[4] for b in sorted(n["boxes"], key=lambda b: b[0])] for n in lines]


def lines(boxes: DataFrame, page: str = "page_id", box: str = "box_id") -> DataFrame:
    """(page, box, col_id, line_no, box_no): reading order of the boxes that have a place; line_no runs over the columns.

    Which line takes a box depends on the boxes before it, so a column of a page is grouped in Python; boxes with a null
    place are left out.
    """
    placed = columns(boxes.where("x is not null and y is not null and w is not null and h is not null"), page, box)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, cols, xs, ys, ws, hs, ids in zip(*(b[c] for c in ("p", "c", "x", "y", "w", "h", "i")), strict=True):
                rows = list(zip(xs.tolist(), ys.tolist(), ws.tolist(), hs.tolist(), ids.tolist(), strict=True))
                number = 0
                for col in sorted(set(cols.tolist())):
                    for line in group_lines([r for r, c in zip(rows, cols.tolist(), strict=True) if c == col]):
                        out += [(p, i, col, number, k) for k, i in enumerate(line)]
                        number += 1
            yield pd.DataFrame(out, columns=[page, box, "col_id", "line_no", "box_no"])

    kind = {c: boxes.schema[c].dataType.simpleString() for c in (page, box)}
    whole = placed.groupBy(F.col(page).alias("p")).agg(F.collect_list(F.struct(F.col("col_id").alias("c"), "x", "y", "w", "h", F.col(box).alias("i"))).alias("b"))
    return whole.select("p", "b.c", "b.x", "b.y", "b.w", "b.h", "b.i").mapInPandas(
        run, f"{page} {kind[page]}, {box} {kind[box]}, col_id int, line_no int, box_no int"
    )


def page_text(boxes: DataFrame, page: str = "page_id", box: str = "box_id") -> DataFrame:
    """(page, text, n_lines): boxes of a line parted by two blanks, lines by line feeds; null texts count as empty."""
    order = lines(boxes, page, box).join(boxes.select(page, box, F.coalesce("text", F.lit("")).alias("text")), [page, box])
    one = order.groupBy(page, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_no", "text"))), lambda s: s["text"]), "  ").alias("line"))
    return one.groupBy(page).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"), F.count("*").alias("n_lines")
    )
