"""Lines, quadrilaterals, crops and page geometry as arithmetic on columns. Points are structs (x, y)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A4 in points, margin, and limits of the text layer.
A4 = (595.28, 841.89)
MARGIN, FONT_SHARE, FONT_LEAST, FONT_MOST, BASELINE = 20.0, 0.78, 4.0, 36.0, 0.82
# Limits of a quadrilateral that is a document.
SIDE_SHARE, ASPECT, PARALLEL_DEGREES, AREA_SHARE = 0.35, (0.35, 2.8), 14.0, 0.20
APART, LEAST_AREA = 15.0, 100.0


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line_of(p: Column, q: Column) -> Column:
    """(a, b, c) with a*x + b*y + c = 0 through two points."""
    return F.struct((q["y"] - p["y"]).alias("a"), (p["x"] - q["x"]).alias("b"), (q["x"] * p["y"] - p["x"] * q["y"]).alias("c"))


def intersection(m: Column, n: Column) -> Column:
    """The point where two lines meet, null for (nearly) parallel ones."""
    def meet(m: Column, n: Column) -> Column:
        det = m["a"] * n["b"] - n["a"] * m["b"]
        return F.when(F.abs(det) >= 1e-6, F.struct(((m["b"] * n["c"] - n["b"] * m["c"]) / det).alias("x"), ((n["a"] * m["c"] - m["a"] * n["c"]) / det).alias("y")))

    return let(F.struct(m.alias("m"), n.alias("n")), lambda b: meet(b["m"], b["n"]))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2))


def area(points: Column) -> Column:
    """Area of a polygon (shoelace)."""
    n = F.size(points)
    turns = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda a, t: a + t)) / 2


def order_points(points: Column) -> Column:
    """(top left, top right, bottom right, bottom left) of four points, null if two are nearer than 15 or the area is under 100.

    Equal sums or differences: the point written first.
    """

    def pick(ps: Column, key: Callable[[Column], Column]) -> Column:
        return F.array_min(F.transform(ps, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))

    def corners(ps: Column) -> Column:
        best = [pick(ps, k) for k in (lambda p: p["x"] + p["y"], lambda p: p["y"] - p["x"], lambda p: -(p["x"] + p["y"]), lambda p: p["x"] - p["y"])]
        return F.transform(F.array(*best), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))

    def checked(four: Column) -> Column:
        near = F.lit(False)
        for a in range(4):
            for b in range(a + 1, 4):
                near = near | (distance(four[a], four[b]) < APART)
        return F.when(~near & (area(four) >= LEAST_AREA), four)

    return F.when(F.size(points) == 4, let(points, lambda ps: let(corners(ps), checked)))


def is_document(four: Column, width: Column, height: Column) -> Column:
    """Whether ordered corners (as of order_points) can be a document in an image of this size; null for null corners."""
    return let(four, lambda q: _is_document(q, width, height))


def _is_document(four: Column, width: Column, height: Column) -> Column:
    top, right, bottom, left = (distance(four[a], four[b]) for a, b in ((0, 1), (1, 2), (3, 2), (0, 3)))
    across, down = (top + bottom) / 2, (left + right) / 2
    angle = lambda a, b: F.degrees(F.atan2(four[b]["y"] - four[a]["y"], four[b]["x"] - four[a]["x"]))

    def turn(m: Column, n: Column) -> Column:
        d = F.abs(m - n) % 180.0
        return F.least(d, 180.0 - d)

    return (
        (across >= SIDE_SHARE * width) & (down >= SIDE_SHARE * height) & (down > 0)
        & (across / F.when(down > 0, down)).between(*ASPECT)
        & (turn(angle(0, 1), angle(3, 2)) <= PARALLEL_DEGREES) & (turn(angle(0, 3), angle(1, 2)) <= PARALLEL_DEGREES)
        & (area(four) >= AREA_SHARE * width * height)
    )


def four_of_five(points: Column) -> Column:
    """Corners of a convex five-gon with one corner cut off: the shortest side goes, its neighbours are made to meet."""

    def turned(ps: Column) -> Column:
        """The points from the beginning of the shortest side on."""
        sides = F.transform(ps, lambda p, i: F.struct(distance(p, F.get(ps, (i + 1) % 5)).alias("d"), i.alias("i")))
        return let(F.array_min(sides)["i"], lambda k: F.concat(F.slice(ps, k + 1, F.lit(5)), F.slice(ps, F.lit(1), k)))

    def corners(q: Column) -> Column:
        meet = intersection(line_of(q[4], q[0]), line_of(q[1], q[2]))
        return let(meet, lambda m: F.when(m.isNotNull(), order_points(F.array(m, q[2], q[3], q[4]))))

    return F.when(F.size(points) == 5, let(points, lambda ps: let(turned(ps), corners)))


def crop_padding(h: Column, padding: Column | None = None, adaptive: bool = True) -> Column:
    """(pad_y, pad_x) of a crop: as given, or by its height (marks stand above and below, less beside) and at least 4, or 3."""
    y, x = (F.greatest(F.lit(4), F.floor(h * 0.16)), F.greatest(F.lit(4), F.floor(h * 0.08))) if adaptive else (F.lit(3), F.lit(3))
    given = F.lit(None).cast("bigint") if padding is None else padding.cast("bigint")
    return F.struct(F.coalesce(given, y.cast("bigint")).alias("pad_y"), F.coalesce(given, x.cast("bigint")).alias("pad_x"))


def detection_scale(width: Column, height: Column) -> Column:
    """Factor by which a small page is enlarged before detection."""
    low = F.least(width, height)
    return F.when((low < 1400) & (low > 0), F.least(F.lit(2.0), 1600.0 / low)).otherwise(1.0)


def unscaled(points: Column, scale: Column) -> Column:
    """Points found in an enlarged page, in the page's own pixels."""
    return F.transform(points, lambda p: F.struct((p["x"] / scale).alias("x"), (p["y"] / scale).alias("y")))


def enough_polygon(points: Column, w: Column, h: Column) -> Column:
    """Whether a detected polygon is worth a crop: four points, five pixels either way."""
    return (F.size(points) == 4) & (w >= 5) & (h >= 5)


def page_geometry(width: Column, height: Column, mode: Column, dpi: Column) -> Column:
    """(page_w, page_h, x, y, shown_w, shown_h) in points of an image on a page: as large as the image, or fitted on A4."""
    points_w, points_h = width * 72.0 / dpi, height * 72.0 / dpi
    turned = mode == "a4_landscape"
    page_w = F.when(mode == "fit_image", points_w).when(turned, A4[1]).otherwise(A4[0])
    page_h = F.when(mode == "fit_image", points_h).when(turned, A4[0]).otherwise(A4[1])
    scale = F.least((page_w - 2 * MARGIN) / width, (page_h - 2 * MARGIN) / height)
    shown_w, shown_h = F.when(mode == "fit_image", points_w).otherwise(width * scale), F.when(mode == "fit_image", points_h).otherwise(height * scale)
    r = lambda c: F.round(c, 4)
    return F.struct(
        r(page_w).alias("page_w"), r(page_h).alias("page_h"), r((page_w - shown_w) / 2).alias("x"), r((page_h - shown_h) / 2).alias("y"),
        r(shown_w).alias("shown_w"), r(shown_h).alias("shown_h"),
    )


def text_position(x: Column, y: Column, w: Column, h: Column, coord_w: Column, coord_h: Column, page: Column) -> Column:
    """(x, baseline, w, font_size) in points of a box; coord_w and coord_h are the size of the image the box was found in."""
    sx, sy = page["shown_w"] / coord_w, page["shown_h"] / coord_h
    r = lambda c: F.round(c, 3)
    return F.struct(
        r(page["x"] + x * sx).alias("x"), r(page["y"] + (y + BASELINE * h) * sy).alias("baseline"), r(w * sx).alias("w"),
        r(F.least(F.lit(FONT_MOST), F.greatest(F.lit(FONT_LEAST), FONT_SHARE * h * sy))).alias("font_size"),
    )
