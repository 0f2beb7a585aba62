import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import models
from pagewright.sources import files, sinks
from pagewright.streaming import results as S


def pgm(w=12, h=10, fill=7):
    return sinks.encode_portable(w, h, 1, bytes([fill]) * (w * h))


def test_scan_and_pages(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in ("doc_10.pgm", "doc_2.pgm"):
        (tmp_path / "a" / n).write_bytes(pgm())
    (tmp_path / "a" / "two.ppm").write_bytes(pgm() + b"\n" + pgm(fill=9))
    (tmp_path / "bad.pgm").write_bytes(b"nothing")
    (tmp_path / "x.txt").write_text("no image")
    found = files.scan_folder(spark, str(tmp_path), content=True)
    assert found.count() == 4
    assert [r["name"] for r in found.orderBy("folder", "natural").collect()] == ["bad.pgm", "doc_2.pgm", "doc_10.pgm", "two.ppm"]
    read = files.pages(found, files.decode_portable)
    assert read.where("error is null").count() == 4
    assert read.where("error is not null and data is null").count() == 1
    assert files.first_part(found, large=2, first=2).count() == 2 and files.first_part(found).count() == 4
    assert files.sample_files(found, ("pgm", "ppm"), 1).count() == 2
    assert files.file_list(spark, [str(tmp_path / "a" / "doc_10.pgm"), str(tmp_path / "a" / "doc_2.pgm")]).first()["name"] == "doc_2.pgm"


def test_labels(spark, tmp_path):
    f = tmp_path / "l.tsv"
    f.write_text('a.png\t"quoted\tmore\nonly\nb.png\tế\n', encoding="utf-8")
    assert {r["rel_img"]: r["text"] for r in files.read_labels(spark, str(f)).collect()} == {"a.png": '"quoted', "b.png": "ế"}
    j = tmp_path / "m.json"
    j.write_text(json.dumps({"x.png": "một", "y.png": None}), encoding="utf-8")
    assert files.read_label_map(spark, str(j)).count() == 2
    n = tmp_path / "n.json"
    n.write_text(json.dumps({"a_b": 3, "a_b_c": 4}))
    assert [tuple(r) for r in files.read_ngrams(spark, str(n), 2).collect()] == [("a", "b", 3)]
    sinks.write_labels(spark.createDataFrame([("a", "x\ty", "val"), ("b", "z", "train")], "rel_img string, text string, split string"), str(tmp_path / "out"), "split")
    assert files.read_labels(spark, str(tmp_path / "out" / "split=val")).first()["text"] == "x y"
    sinks.write_dictionary(spark.createDataFrame([("b",), ("a",), ("ế",)], "ch string"), str(tmp_path / "dict"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "dict")).collect()] == ["a", "b", "ế"]
    with pytest.raises(ValueError):
        sinks.write_texts(spark.createDataFrame([(" ",)], "text string"), str(tmp_path / "t"))


def test_options(tmp_path):
    p = tmp_path / "o.json"
    sinks.write_options(str(p), {"engine": "old", "x": 1})
    assert files.read_options(str(p), {"x": 0, "y": 2}, {"engine": {"old": "new"}}) == {"engine": "new", "x": 1, "y": 2}
    assert files.read_options(str(tmp_path / "none"), {"y": 2}) == {"y": 2}
    assert files.first_existing(["/nowhere", str(p)]) == str(p) and files.first_existing([str(p)], 10**6) is None


def test_rewrite_is_idempotent(spark, tmp_path):
    src = spark.range(5)
    for _ in range(2):
        sinks.rewrite_from_source(lambda d: d.select((F.col("id") * 2).alias("v")), src, str(tmp_path / "t"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 2, 4, 6, 8]


def test_document_layers(spark):
    df = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "doc string, n int, layer string")
    assert sinks.document_layers(df, "doc", "n", "layer").first()["layers"] == ["a", "b"]


def test_write_bytes_reports(spark, tmp_path):
    folder = str(tmp_path)

    def put(name, data):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)

    df = spark.createDataFrame([("a", bytearray(b"xy")), ("b", None)], "name string, data binary")
    got = {r["name"]: (r["n_bytes"], r["error"]) for r in sinks.write_bytes(df, "name", "data", put).collect()}
    assert got["a"] == (2, None) and got["b"][1] and (tmp_path / "a").read_bytes() == b"xy"


def test_recognition(spark):
    img = spark.createDataFrame([(1, 40, 30, 1, bytearray(b"\x50" * 1200))], "page int, width int, height int, channels int, data binary")
    boxes = models.detect(img, "page", lambda: lambda x: [[(5, 5), (25, 5), (25, 20), (5, 20)]])
    assert boxes.first()["box_id"] == 0
    crops = models.crops(img, boxes, "page")
    assert (crops.first()["width"], crops.first()["height"]) == (28, 23)
    r = models.read_crops(crops, ["page", "box_id"], lambda: lambda x: ("số", 0.8), lambda: lambda x: ("so", 0.9)).first()
    assert r["winner"] == "cross_verified" and r["text"] == "số" and r["conf"] == 0.98
    with pytest.raises(ValueError):
        models.read_crops(crops, ["page"], None, None, "other")


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    data.write.parquet(str(tmp_path / "in"))
    latest = S.latest_results(S.read_stream(spark, str(tmp_path / "in"), data.schema), ["k"], "n")
    got = S.run_once(latest, "complete")
    assert {(r["k"], r["v"]) for r in got.collect()} == {(1, "b"), (2, "c")}
    assert S.run_once(S.read_stream(spark, str(tmp_path / "in"), data.schema), "append").count() == 3
    (tmp_path / "none").mkdir()
    assert S.run_once(S.read_stream(spark, str(tmp_path / "none"), data.schema), "append").count() == 0


def test_reading_whole_pages(spark):
    size = 60 * 40
    rows = [(1, 60, 40, 1, bytearray(b"\x09" * size)), (2, 60, 40, 1, None), (3, 60, 40, 1, bytearray(b"\x07" * size)), (4, 60, 40, 1, bytearray(b"\x00" * size))]
    images = spark.createDataFrame(rows, "page int, width int, height int, channels int, data binary")

    def detector():
        def find(img):
            if img[0, 0] == 7:
                raise RuntimeError("no boxes")
            return [] if img[0, 0] == 0 else [[(30, 5), (50, 5), (50, 15), (30, 15)], [(5, 5), (25, 5), (25, 15), (5, 15)], [(5, 20), (50, 20), (50, 30), (5, 30)]]

        return find

    def reader():
        return lambda x: (" " if x.shape[1] > 40 else f"so {x.shape[1]}", 0.6)

    def corrected(t):
        return t.withColumn("text", F.replace("text", F.lit("so"), F.lit("số")))

    lexicon = spark.createDataFrame([("số",)], "word string")
    got = {r["page"]: r for r in models.read_pages(images, "page", detector, reader, reader, "dual", corrected, lexicon).collect()}
    assert got[1]["full_text"] == "số 28  số 28" and (got[1]["n_boxes"], got[1]["word_count"], got[1]["error"]) == (2, 4, None) and got[1]["confidence"] == 0.95
    assert got[2]["error"] == "no image" and "no boxes" in got[3]["error"] and got[4]["full_text"] == "" and got[4]["error"] is None


def test_pdf_bytes():
    page = {"page_w": 595.28, "page_h": 841.89, "x": 20.0, "y": 30.0, "shown_w": 100.0, "shown_h": 50.0, "texts": [("Hóa đơn (số) 7", 20.0, 40.0, 9.0), (" ", 0.0, 0.0, 4.0), (None, 0.0, 0.0, 4.0)]}
    pdf = sinks.searchable_pdf([{**page, "image": (2, 1, 1, b"\x00\xff")}, {**page, "image": (1, 1, 3, b"\x01\x02\x03"), "texts": []}])
    assert sinks.pdf_texts(pdf) == [["Hóa đơn (số) 7"], []] and pdf.startswith(b"%PDF-") and pdf.endswith(b"%%EOF\n") and b"/Count 2" in pdf
    table = int(pdf.rsplit(b"startxref\n", 1)[1].split()[0])
    places = [int(line[:10]) for line in pdf[table:].split(b"\n")[3:] if line.endswith(b" n ")]
    assert [pdf[at:].split()[0] for at in places] == [str(k).encode() for k in range(1, len(places) + 1)]


def test_shared_folder(spark):
    from pagewright.plans.persist import cut, shared_folder

    assert shared_folder(spark) != shared_folder(spark)
    df = cut(spark.range(10).select("id", F.array().cast("array<int>").alias("a"), F.lit(None).cast("string").alias("n")))
    assert df.count() == 10 and df.columns == ["id", "a", "n"]
