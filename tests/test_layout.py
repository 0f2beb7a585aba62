import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import dataset as D
from pagewright.operators import geometry as G
from pagewright.operators import layout, pages, raster, stats

BOX = "page_id bigint, img_w int, img_h int, box_id int, x double, y double, w double, h double, text string"


def test_two_columns(spark):
    rows = [(1, 1000, 1200, k, float(x), float(y), 300.0, 30.0, f"{x}-{y}") for k, (x, y) in enumerate((x, y) for x in (50, 620) for y in (100, 150, 200))]
    boxes = spark.createDataFrame(rows, BOX)
    got = layout.lines(boxes).orderBy("line_no").collect()
    assert len({r["line_no"] for r in got}) == 6 and [r["box_id"] for r in got] == list(range(6))
    assert [r["col_id"] for r in got] == [0, 0, 0, 1, 1, 1]


def test_table_row_is_one_line(spark):
    cells = [(70, 280, 20, 15), (100, 282, 200, 18), (400, 284, 30, 14), (470, 284, 15, 14), (500, 276, 55, 16), (620, 282, 50, 15)]
    boxes = spark.createDataFrame([(1, 800, 1000, k, *map(float, c), str(k)) for k, c in enumerate(cells)], BOX)
    assert layout.page_text(boxes).first()["text"] == "0  1  2  3  4  5"


def test_empty_boxes(spark):
    boxes = spark.createDataFrame([], BOX)
    assert layout.lines(boxes).count() == 0 and layout.columns(boxes).count() == 0


def test_geometry(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    quad = F.array(p(950, 80), p(120, 100), p(80, 820), p(980, 800))
    df = spark.range(1).select(
        G.intersection(G.line_of(p(0, 0), p(2, 2)), G.line_of(p(0, 2), p(2, 0))).alias("i"),
        G.intersection(G.line_of(p(0, 0), p(1, 1)), G.line_of(p(0, 1), p(1, 2))).alias("none"),
        G.order_points(quad).alias("q"), G.is_document(G.order_points(quad), F.lit(1100), F.lit(900)).alias("doc"), G.area(quad).alias("area"),
        G.order_points(F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1))).alias("tiny"),
        G.four_of_five(F.array(p(20, 0), p(200, 0), p(200, 100), p(0, 100), p(0, 20))).alias("five"),
    )
    r = df.first()
    assert (r["i"]["x"], r["i"]["y"]) == (1, 1) and r["none"] is None and r["tiny"] is None
    assert [(a["x"], a["y"]) for a in r["q"]] == [(120, 100), (950, 80), (980, 800), (80, 820)]
    assert r["doc"] is True
    assert [(a["x"], a["y"]) for a in r["five"]] == [(0, 0), (200, 0), (200, 100), (0, 100)]


def test_adaptive_padding(spark):
    r = spark.range(1).select(G.crop_padding(F.lit(40.0)).alias("a"), G.crop_padding(F.lit(40.0), F.lit(2)).alias("b")).first()
    assert r["a"]["pad_y"] == 6 and r["a"]["pad_x"] == 4 and r["b"]["pad_y"] == 2


def test_splits_never_leak(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").unionAll(spark.range(1000).withColumnRenamed("id", "k"))
    s = D.split(df, "k")
    assert s.groupBy("k").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    exact = D.split_exact(df, "k")
    assert exact.where("split = 'val'").count() == 150 and exact.count() == 1000
    assert D.split_exact(df.limit(4), "k").where("split = 'train'").count() == 0


def test_numbers_run_through_all_rows(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("number")).repartition(7)
    got = pages.numbered(rows, ["k"], "n").collect()
    assert len(got) == 5000 and all(r["n"] == r["k"] + 1 for r in got)
    assert pages.numbered(rows.limit(0), ["k"], "n").count() == 0
    boxes = spark.createDataFrame([(k, f"p{k % 3}", float(k)) for k in range(30)], "box int, page string, y double")
    assert len({r["crop_name"] for r in D.crop_names(boxes, ["page", "y", "box"]).collect()}) == 30


def test_latest_is_repeatable(spark):
    df = spark.createDataFrame([(1, 5, "b", {"x": 1}), (1, 5, "a", {"x": 2}), (2, 1, None, None)], "k int, r int, v string, m map<string,int>")
    assert {(r["k"], r["v"]) for n in (1, 4) for r in pages.latest(df.repartition(n), ["k"], "r").collect()} == {(1, "b"), (2, None)}


def test_gates_and_labels(spark):
    df = spark.createDataFrame([("a",), (None,), ("..",), ("don gia",), ("GHI  CHÚ: 5",), ("đơn giá ghi chu",), ("xdon gia",), ("e\u0301",)], "t string")
    got = [r[0] for r in df.select(D.text_gate(F.col("t"))).collect()]
    assert got == [False, False, False, True, True, True, True, False]
    assert [r[0] for r in df.select(D.clean_label(F.col("t"))).collect()] == ["a", None, "..", "Đơn giá", "Ghi chú: 5", "Đơn giá Ghi chú", "xdon gia", "é"]


def test_pages(spark):
    df = spark.createDataFrame([("d/doc_10.png",), ("d/doc_2.png",), ("c/x.png",)], "path string")
    assert {r["name"]: r["ordinal"] for r in pages.ordinals(df).collect()} == {"doc_10.png": 2, "doc_2.png": 1, "x.png": 1}
    p = spark.createDataFrame([("a/f.pdf", 0), ("a/f.pdf", 1), ("g.png", 0)], "file_path string, page_index int")
    assert sorted(r["label"] for r in pages.page_labels(p).collect()) == ["f.pdf (Trang 1/2)", "f.pdf (Trang 2/2)", "g.png"]
    moved = pages.moved(spark.createDataFrame([(k, k) for k in range(1, 6)], "id int, o int"), "o", 4, 2)
    assert [r["id"] for r in moved.orderBy("o").collect()] == [1, 4, 2, 3, 5]


def test_skew(spark):
    rows = [(1, a, 10.0) for a in (2.0, 2.1, 2.2, 2.3, 1.9, 2.0, 45.0)] + [(2, 0.1, 1.0)] * 6 + [(3, 9.0, 1.0)]
    got = {r["k"]: r["skew"] for r in stats.weighted_median_angle(spark.createDataFrame(rows, "k int, a double, w double"), "k", "a", "w").collect()}
    assert got == {1: 2.0, 2: 0.0}


def page(h=300, w=500):
    img = np.full((h, w), 235, np.uint8)
    for y in range(40, h - 40, 30):
        img[y : y + 8, 40 : w - 40] = 40
    return img


def test_rasters():
    img = page()
    turned = img
    for _ in range(4):
        turned = raster.rotate(turned, 90)
    assert (turned == img).all() and (raster.rotate(img, 45) == img).all()
    assert raster.upscale(img, 2).shape == (600, 1000) and raster.upscale(img, 1.01) is img
    blurred = raster.gaussian(img, 2).astype(np.uint8)
    edge = lambda x: np.abs(np.diff(x.astype(float), axis=0)).var()
    assert edge(raster.sharpen(blurred, 1.0)) > edge(blurred)
    shaded = (img * np.linspace(1, 0.6, img.shape[1])[None]).astype(np.uint8)
    assert raster.whiten(shaded, 0.9)[5].astype(float).std() < shaded[5].astype(float).std()
    for f in (raster.contrast, raster.denoise, raster.whiten, raster.sharpen):
        assert f(img, 0.0) is img and f(img, 0.5).shape == img.shape
    color = np.stack([img] * 3, 2)
    assert raster.enhance(color, raster.PRESETS["clean_scan"]).shape == (600, 1000)
    assert raster.enhance(color, raster.PRESETS["natural"], stop=lambda: True) is color


def test_deskew():
    img = page(400, 600)
    assert raster.skew_angle(img) == 0.0
    h, w = img.shape
    a = np.radians(5)
    m = np.array([[np.cos(a), -np.sin(a), w / 2 * (1 - np.cos(a)) + h / 2 * np.sin(a)], [np.sin(a), np.cos(a), h / 2 * (1 - np.cos(a)) - w / 2 * np.sin(a)], [0, 0, 1]])
    tilted = raster.warp(img, m, w, h, np.array(235))
    assert abs(raster.skew_angle(tilted)) > 3
    assert abs(raster.skew_angle(raster.deskew(tilted))) < 1


def test_flatten_and_corners():
    img = np.zeros((900, 1100, 3), np.uint8) + np.array([45, 75, 115], np.uint8)
    assert not raster.is_full_page(img) and raster.is_full_page(np.full((50, 50), 240, np.uint8))
    y, x = np.mgrid[0:900, 0:1100]
    img[(x > 120) & (x < 950) & (y > 100) & (y < 800)] = 250
    img[300:320, 300:800] = 10
    flat = raster.flatten(img, np.array([[121, 101], [949, 101], [949, 799], [121, 799]]))
    assert 650 < flat.shape[0] < 900 and 750 < flat.shape[1] < 1100
    assert raster.shrink(np.zeros((4000, 10), np.uint8)).shape == (2000, 5)


def test_find_document():
    img = np.zeros((900, 1100, 3), np.uint8) + np.array([45, 75, 115], np.uint8)
    y, x = np.mgrid[0:900, 0:1100]
    inside = (y > 100 - (x - 120) * 20 / 830) & (y < 820 - (x - 80) * 20 / 900) & (x > 120 - (y - 100) * 40 / 720) & (x < 950 + (y - 80) * 30 / 720)
    img[inside] = 245
    img[300:320, 300:800] = 10  # a blank sheet would be left as it is
    corners = raster.find_document(img)
    assert np.abs(corners - np.array([[120, 100], [950, 80], [980, 800], [80, 820]])).max() < 15
    out = raster.crop_and_flatten(img)
    assert 650 < out.shape[0] < 900 and 750 < out.shape[1] < 1000
    full = np.full((300, 300), 240, np.uint8)
    assert raster.find_document(full) is None and raster.crop_and_flatten(full) is full
